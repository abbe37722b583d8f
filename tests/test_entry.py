import importlib
import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_llm_package():
    for p in (ROOT / "pointmill").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"(from|import) pointmill\.llm", p.read_text())


def test_cli_lists_commands(capsys):
    import pytest

    from pointmill.plans.cli import main

    with pytest.raises(SystemExit):
        main(["--help"])
    assert "segment" in capsys.readouterr().out


def test_cli_wrong_usage_ends_with_one(capsys):
    import pytest

    from pointmill.plans.cli import main

    for argv in (["segment", "a", "b", "--nope", "1"], ["segment", "a", "b", "--normal_radius"], [], ["visualize", "a"]):
        with pytest.raises(SystemExit) as end:
            main(argv)
        assert end.value.code == 1 and "usage" in capsys.readouterr().err


def test_cli_end_to_end(spark, tmp_path, capsys):
    """Scene files by name: a whole run, the evaluation of its labels alone, and inputs that do not fit together."""
    from pointmill.plans.cli import main

    raw = tmp_path / "raw" / "semantic3d"
    raw.mkdir(parents=True)
    spots = [(0.11 * (i % 15), 0.11 * (i // 15 % 15), 5.0 * (i // 225)) for i in range(450)]
    (raw / "s.txt").write_text("".join(f"{x:.6f} {y:.6f} {z:.6f} 7 1 2 3\n" for x, y, z in spots))
    (raw / "s.labels").write_text("".join(f"{1 + i // 225}\n" for i in range(450)))
    args = ["experiment", "--scene_name", "s", "--data_root", str(tmp_path)]
    assert main([*args, "--eval_only"]) == 1 and "is missing" in capsys.readouterr().err
    assert main(args) == 0
    out = tmp_path / "results"
    names = {"s_downsampled.txt", "s_downsampled_predicted.labels", "s_final_predicted.labels", "s_final_mapped.labels", "s_raw_clusters_visualization.txt", "s_semantic_visualization.txt"}
    assert {f.name for f in out.iterdir() if f.name[0] != "."} == names and all(f.is_file() for f in out.iterdir())
    first = capsys.readouterr().out
    assert "ground truth man-made terrain: 225 points (50.00%)" in first and "noise 0 (0.00%)" in first
    assert len((out / "s_final_predicted.labels").read_text().splitlines()) == 450
    assert len((out / "s_raw_clusters_visualization.txt").read_text().splitlines()) == len((out / "s_downsampled.txt").read_text().splitlines())
    assert main([*args, "--eval_only", "--no-visualize"]) == 0 and capsys.readouterr().out == first
    assert main(["visualize", str(raw / "s.txt"), str(raw / "s.labels"), str(tmp_path / "v.txt")]) == 0
    assert (tmp_path / "v.txt").read_text().splitlines()[0] == "0.000000 0.000000 0.000000 7 1 2 3 1"
    (raw / "short.labels").write_text("1\n2\n")
    assert main(["visualize", str(raw / "s.txt"), str(raw / "short.labels"), str(tmp_path / "w.txt")]) == 1 and not (tmp_path / "w.txt").exists()
    assert main(["evaluate", str(raw / "s.labels"), str(raw / "short.labels")]) == 1
    (raw / "none.txt").write_text("# nothing\n")
    assert main(["segment", str(raw / "none.txt"), str(tmp_path / "l")]) == 1
    assert main(["segment", str(out / "s_downsampled.txt"), str(tmp_path / "l.labels")]) == 0
    assert len((tmp_path / "l.labels").read_text().splitlines()) == len((out / "s_downsampled.txt").read_text().splitlines())


def test_labels_of_another_length_are_not_written(spark, tmp_path):
    import pytest

    from pointmill.sources import points as io

    lab = spark.createDataFrame([(0, 1)], "point_id bigint, segment_id bigint")
    with pytest.raises(ValueError, match="1 labels for 2 points"):
        io.write_labels(lab, str(tmp_path / "l"), of=spark.range(2))
    assert not (tmp_path / "l").exists()

import pytest
from pointmill.sources.raw_lines import failing_lines, parse_lines, strict

CASES = [
    ("xyz", "1 2 3", None), ("xyz", " +1.5\t-.5 3.e2 what ever \r", None), ("xyz", "1 2", "columns"), ("xyz", "1,2,3", "columns"), ("xyz", "1 nan 3", "value"), ("xyz", "1e999 2 3", "value"),
    ("xyz", "１ 2 3", "value"), ("xyz", "1 2 3", "columns"), ("scene7", "1 2 3 -4 0 255 7", None), ("scene7", "1 2 3 4 0 256 7", "value"), ("scene7", "1 2 3 4 0 2", "columns"),
    ("scene7", "1 2 3 4.5 0 2 3", "value"), ("csv6", '"1" , 2,3,0,-1,1.0', None), ("csv6", "1,2,3,0,0,1.01", "value"), ("csv6", '1,2,3,0,0,"0', "quoting"), ("csv6", '1,2,3,0,0"0",1', "quoting"),
    ("csv6", '"1"x,2,3,0,0,1', "quoting"), ("csv6", '1,2,3,"0,0",1', "columns"), ("csv6", '1,2,3,"0""",0,1', "value"), ("csv6", "1,2,3,0,0,", "value"), ("csv7", "1,2,3,0,0,1,7\r", None),
    ("csv7", "1,2,3,0,0,1,-1", "value"), ("csv7", "1,2,3,0,0,1", "columns"), ("csv7", "1,2,3,0,0,1,99999999999999999999", None), ("nope", "1 2 3", "layout"), (None, "1 2 3", "layout"),
    ("xyz", None, "skip"), ("xyz", "  \t ", "skip"), ("csv6", "# 1,2", "skip"), ("xyz", "\r", "skip"), ("xyz", "", "skip"), ("xyz", "7 " * 20_000, None),
    ("scene7", "1 2 3 " + "9" * 5000 + " 0 0 0", None), ("scene7", "1 2 3 -" + "0" * 5000 + " 0 0 0", None), ("scene7", "1 2 3 4 0 0 " + "1" * 5000, "value"), ("scene7", "1 2 3 4 0 0 " + "0" * 5000 + "7", None),
    ("csv7", "1,2,3,0,0,1," + "8" * 5000, None), ("csv7", "1,2,3,0,0,1,-" + "8" * 5000, "value"), ("csv7", "1,2,3,0,0,1,-" + "0" * 5000, None), ("xyz", "9" * 5000 + " 2 3", "value"), ("xyz", "0." + "9" * 5000 + " 2 3", None),
]


@pytest.mark.parametrize("times", [1, 40])
def test_reasons_and_bisection(spark, times):
    rows = [(i, "f", i, lay, line, 1) for i, (lay, line, _) in enumerate(CASES * times)]
    df = spark.createDataFrame(rows, "line_id bigint, file_name string, line_num bigint, layout string, line string, reason int")
    want = {i: r for i, (_, _, r) in enumerate(CASES * times) if r not in (None, "skip")}
    assert {r.line_id: r.reason for r in failing_lines(df).collect()} == want
    good = parse_lines(df).where("reason is null").collect()
    assert {r.line_id for r in good} == {i for i, (_, _, r) in enumerate(CASES * times) if r is None}
    assert all(r.line is None and r.x is not None for r in good)
    assert failing_lines(df.limit(0)).count() == 0


def test_bulk_values_equal_strict_values(spark):
    import random

    rnd = random.Random(1)
    lines = [f"{rnd.uniform(-90, 90):.6f} {rnd.uniform(-9, 9):.3e} {rnd.randint(-5, 5)}" for _ in range(5000)]
    df = spark.createDataFrame([(i, "f", i, "xyz", x) for i, x in enumerate(lines)], "line_id bigint, file_name string, line_num bigint, layout string, line string")
    for r in parse_lines(df).collect():
        assert [r.x, r.y, r.z] == strict(lines[r.line_id], "xyz")[0]


def test_whole_numbers_beyond_a_bigint_are_valid_and_null(spark):
    lines = ["1 2 3 " + "9" * 5000 + " 0 0 7", "1 2 3 -" + "9" * 19 + " 0 0 7", "1 2 3 -" + "0" * 5000 + "12 0 0 7"]
    df = spark.createDataFrame([(i, "f", i, "scene7", x) for i, x in enumerate(lines)], "line_id bigint, file_name string, line_num bigint, layout string, line string")
    assert [(r.intensity, r.b, r.reason) for r in sorted(parse_lines(df).collect())] == [(None, 7, None), (None, 7, None), (-12, 7, None)]

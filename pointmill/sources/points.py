"""Readers and writers of point, label and visualisation files.

Text rows have no key, so every reader numbers lines in file order without an RDD: a split's rows are numbered inside
the split (a window per file block), and the counts of the splits, one small row each, give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUM = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_num from 1 over all files in name order, text) of text files."""
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_m"))
    counts = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("_m"))
    return raw.withColumn("_i", inside).join(offsets, ["file", "block"]).select("file", "block", (F.col("_o") + F.col("_i")).alias("line_num"), "text")


def dense_ids(valid: DataFrame) -> DataFrame:
    """point_id from 0 over the rows of ``valid`` (block, line_num, ...), in line order."""
    counts = valid.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("line_num").alias("_l"))
    before = Window.orderBy("_l").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("line_num"))
    return valid.withColumn("_i", inside).join(offsets, ["file", "block"]).withColumn("point_id", F.col("_o") + F.col("_i") - 1).drop("_i", "_o")


def skipped(text: Column) -> Column:
    """Empty lines and lines that start with #."""
    return (F.length(text) == 0) | (text == "\r") | text.startswith("#")


def parse_xyz(text: Column, single: bool = True) -> list[Column]:
    """x, y, z of a line with at least three numbers; nulls if it has not.

    Coordinates pass through single precision unless ``single`` is False.  A number too large for it is invalid.
    """
    fields = [F.regexp_extract(text, rf"^\s*({NUM})\s+({NUM})\s+({NUM})", i) for i in (1, 2, 3)]
    nums = [f.try_cast("float") if single else f.try_cast("double") for f in fields]
    ok = F.lit(True)
    for n in nums:
        ok = ok & n.isNotNull() & (F.abs(n) != F.lit(float("inf")))
    return [F.when(ok, n.cast("double")) for n in nums]


def read_xyz(spark: SparkSession, path: str, single: bool = True) -> tuple[DataFrame, DataFrame]:
    """(POINTS, REJECTS) of a whitespace-separated cloud; columns after the third are ignored."""
    lines = numbered_lines(spark, path).where(~skipped(F.col("text")))
    x, y, z = parse_xyz(F.col("text"), single)
    at = lines.withColumns({"x": x, "y": y, "z": z})
    return dense_ids(at.where("x is not null")).select("point_id", "x", "y", "z"), at.where("x is null").select("line_num", "text")


def read_oriented_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ORIENTED, REJECTS) of X,Y,Z,NX,NY,NZ lines; any single character may separate, further columns are ignored."""
    lines = numbered_lines(spark, path).where(~skipped(F.col("text")))
    pattern = r"^\s*" + r"\s*\S\s*".join(f"({NUM})" for _ in range(6))
    names = ["x", "y", "z", "nx", "ny", "nz"]
    at = lines.withColumns({n: F.regexp_extract("text", pattern, i + 1).try_cast("double") for i, n in enumerate(names)})
    ok = F.col("x").isNotNull() & F.col("nz").isNotNull()
    return dense_ids(at.where(ok)).select("point_id", *names), at.where(~ok).select("line_num", "text")


def read_matrix(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """point_id and ``columns`` as doubles of a strict numeric text matrix (# starts a comment); a bad line fails the read."""
    lines = numbered_lines(spark, path).withColumn("text", F.trim(F.regexp_replace("text", r"#.*|\r", ""))).where("text <> ''")
    parts = F.split("text", r"\s+")
    bad = F.raise_error(F.concat(F.lit("not a row of numbers, line "), F.col("line_num").cast("string")))
    cols = {c: F.when(F.size(parts) >= len(columns), F.get(parts, F.lit(i)).try_cast("double")) for i, c in enumerate(columns)}
    at = lines.withColumns({c: F.coalesce(v, bad.cast("double")) for c, v in cols.items()})
    return dense_ids(at).select("point_id", *columns)


def read_labels(spark: SparkSession, path: str, name: str = "label") -> DataFrame:
    """(point_id, name) of a file with one whole number per line."""
    return read_matrix(spark, path, ["_v"]).select("point_id", F.col("_v").cast("int").alias(name))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_lines(df: DataFrame, line: Column, path: str, header: str | None = None, single: bool = False) -> None:
    """One line per row in the order of point_id, as a folder of text files in name order or as a ``single`` file.

    The order is kept by a range-partitioned sort, so no single task holds the table; a header is a file of its own
    that sorts first.  A single file is put together from the folder's files as a stream of bytes.
    """
    spark = df.sparkSession
    folder = f"{path.rstrip('/')}.parts" if single else path
    df.orderBy("point_id").select(line.alias("value")).write.mode("overwrite").text(folder)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(folder).getFileSystem(conf)
    if header is not None:
        out = fs.create(at(folder.rstrip("/") + "/part-00000--header.txt"), True)
        out.write(bytearray((header + "\n").encode()))
        out.close()
    if single:
        names = sorted(f.getPath().toString() for f in fs.listStatus(at(folder)) if f.getPath().getName().startswith("part-"))
        out = fs.create(at(path), True)
        for name in names:
            part = fs.open(at(name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
        out.close()
        fs.delete(at(folder), True)


def write_labels(labels: DataFrame, path: str, column: str = "segment_id", of: DataFrame | None = None, single: bool = False) -> None:
    """One label per line.  ValueError, and no file, if ``of``, the points they belong to, differs in length."""
    if of is not None and (n := labels.count()) != (m := of.count()):
        raise ValueError(f"{n} labels for {m} points")
    write_lines(labels, F.format_string("%d", F.col(column)), path, single=single)


def write_xyz(points: DataFrame, path: str, single: bool = False) -> None:
    write_lines(points, F.format_string("%.6f %.6f %.6f", "x", "y", "z"), path, single=single)


def short_number(c: Column) -> Column:
    """Six significant digits without trailing zeros (lossy on purpose)."""
    mag = F.floor(F.log10(F.abs(c)))
    fixed = F.format_string("%.5e", c)
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(fixed, r"^(-?\d\.\d+)e", 1), r"0+$", ""), r"\.$", "")
    power = F.regexp_extract(fixed, r"e([+-]\d+)$", 1)
    exp = power.try_cast("int")
    plain = F.lit("")
    for p in range(-4, 6):
        text = F.format_string(f"%.{5 - p}f", c)
        text = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        plain = F.when(exp == p, text).otherwise(plain)
    return F.when(c == 0, F.lit("0")).when(mag.isNull() | exp.isNull(), c.cast("string")).when((exp < -4) | (exp > 5), F.concat(digits, F.lit("e"), power)).otherwise(plain)


def write_oriented_csv(points: DataFrame, path: str, ids: DataFrame | None = None) -> None:
    """X,Y,Z,NX,NY,NZ lines under a header; points without a row in ``ids`` have no SegmentID field."""
    base = F.concat_ws(",", *[short_number(F.col(c)) for c in ("x", "y", "z", "nx", "ny", "nz")])
    if ids is None:
        return write_lines(points, base, path, "# X,Y,Z,NX,NY,NZ")
    both = points.join(ids.select("point_id", "segment_id"), "point_id", "left")
    line = F.when(F.col("segment_id").isNull(), base).otherwise(F.concat(base, F.lit(","), F.col("segment_id").cast("string")))
    return write_lines(both, line, path, "# X,Y,Z,NX,NY,NZ,SegmentID")


def visualization_lines(points: DataFrame, labels: DataFrame, column: str = "segment_id") -> DataFrame:
    """(point_id, line) with X Y Z label, for viewers that colour by label."""
    return points.join(labels, "point_id").select("point_id", F.format_string("%.6f %.6f %.6f %d", "x", "y", "z", column).alias("line"))


def truth_lines(raw: DataFrame, truth: DataFrame) -> DataFrame:
    """(point_id, line) with the seven raw columns (intensity and colours cut to whole numbers) and the class."""
    cols = ["x", "y", "z", *[F.col(c).cast("int") for c in ("intensity", "r", "g", "b", "class_id")]]
    return raw.join(truth, "point_id").select("point_id", F.format_string("%f %f %f %d %d %d %d %d", *cols).alias("line"))

"""Per-key results when a few keys hold most rows: multi-level tree aggregation.

Level 0 combines fixed-size chunks of input rows where they lie (one state per key and chunk, no shuffle) and writes
the states with their chunk's number.  Every further level merges the states of at most ``fan_in`` neighbouring
chunks, until one state per key is left; so a hot key's states travel through logarithmically many rounds
and no reducer ever receives all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointmill.workspace import Workspace

CHUNK_ROWS = 1 << 17
FAN_IN = 16


def fan_ins(chunks: int, largest: int = FAN_IN) -> list[int]:
    """How many neighbouring states each round merges: as few rounds as ``largest`` allows, two at least beyond two chunks."""
    if chunks <= 1:
        return []
    rounds = max(2 if chunks > 2 else 1, math.ceil(math.log(chunks) / math.log(largest) - 1e-9))
    steps = []
    while chunks > 1:
        steps.append(min(largest, max(2, math.ceil(chunks ** (1 / max(1, rounds - len(steps))) - 1e-9))))
        chunks = -(-chunks // steps[-1])
    return steps


def chunk_states(df: DataFrame, keys: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(keys, _part, _chunk, n): rows per key in each chunk of at least ``chunk_rows`` rows (a partition's last one may be smaller)."""
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_chunk", T.IntegerType()), T.StructField("n", T.LongType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def state(held: list[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            t = t.append_column("n", pa.chunked_array([pa.repeat(pa.scalar(1, pa.int64()), t.num_rows)]))
            t = t.group_by(keys, use_threads=False).aggregate([("n", "sum")])
            at = [pa.chunked_array([pa.repeat(pa.scalar(x, pa.int32()), t.num_rows)]) for x in (part, chunk)]
            yield from pa.table([*[t.column(k) for k in keys], *at, t.column("n_sum")], names=[*keys, "_part", "_chunk", "n"]).combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        rows = chunk = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= chunk_rows:
                yield from state(held, chunk)
                held, rows, chunk = [], 0, chunk + 1
        if rows:
            yield from state(held, chunk)

    return df.mapInArrow(local, schema)


def tree_count(df: DataFrame, keys: list[str], fan_in: int = FAN_IN, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows per key, exact: columns ``keys`` and n.

    Nulls are a key of their own, an empty input gives an empty result, other columns are not read.
    """
    ws = Workspace(df.sparkSession, "tree")
    measures = {"parts": F.coalesce(F.max("_part") + 1, F.lit(0)), "chunks": F.coalesce(F.max("_chunk") + 1, F.lit(0))}
    states, seen = ws.keep(chunk_states(df.select(*keys), keys, chunk_rows), **measures)
    at = F.col("_part").cast("bigint") * F.lit(seen["chunks"]) + F.col("_chunk")
    states = states.select(*keys, at.alias("_at"), "n")
    for step in fan_ins(seen["parts"] * seen["chunks"], fan_in):
        states = states.withColumn("_at", F.expr(f"_at div {step}")).groupBy(*keys, "_at").agg(F.sum("n").alias("n"))
    return states.select(*keys, "n")


def majority(counts: DataFrame, key: str, value: str, n: str = "n") -> DataFrame:
    """(key, value) with the value of the largest count for each key, the smallest value of equals."""
    best = F.max_by(value, F.struct(F.col(n), -F.col(value).cast("bigint")))
    return counts.groupBy(key).agg(best.alias(value))


def segment_majority(predictions: DataFrame, point_classes: DataFrame) -> DataFrame:
    """Class that most predictions of each segment have (p6_found).

    A prediction is one (run_id, point_id); null and negative segments and points without a class do not count.
    """
    kept = predictions.where("segment_id >= 0").select("run_id", "point_id", "segment_id").distinct()
    classes = point_classes.where("class_id is not null").groupBy("point_id").agg(F.min("class_id").alias("class_id"))
    pairs = kept.join(classes, "point_id").select("segment_id", "class_id")
    return majority(tree_count(pairs, ["segment_id", "class_id"]), "segment_id", "class_id")

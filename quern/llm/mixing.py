"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of equal size. With target weight ``w`` (weights
add up to one), its j-th block (from 0) is released at slot ``floor(j / w)`` and
due by slot ``ceil((j + 1) / w)``; in each slot the released block with the
earliest deadline goes first. So at any slot the blocks that a source has got
differ from its share by less than one.

Weights are exact fractions, never rounded to a period: the driver runs the whole
schedule over all blocks. Their number is bounded by ``MOST_BLOCKS`` and one for
each source, since blocks grow with the data beyond that: 64 KB up to 64 GB of
text, 100 MB at 100 TB. Rows find their block's slot by a join. A phase ends when
a source has no blocks left; the others go on from there with their weights
scaled up, and each row comes exactly once.

A row belongs to the block in which its first byte lies when the source's rows
stand in the order of a hash of the id. Rows are dealt to buckets by that hash,
as many as hold ``BUCKET_ROWS`` each; sums are made within a bucket and moved by
the sums of the buckets before, so a hot source spreads over all buckets.

Edge cases: a null source is a source of its own; null and empty texts count one
byte; a text longer than a block takes the place of as many blocks; sources that
are given no weight come after all others, in equal shares; rows that repeat an
id are placed one by one; an empty table gives an empty table; further columns
are ignored by :func:`schedule` and kept by :func:`interleave`.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

#: Bytes of a block at least, and blocks of all sources, but for one of each source, at most.
BLOCK_BYTES, MOST_BLOCKS = 65_536, 1 << 20
#: Rows of a bucket, about, and buckets of each source at least.
BUCKET_ROWS, BUCKETS = 65_536, 256
#: Blocks whose slots are sent to all tasks, at most; more are joined by a shuffle.
BROADCAST_BLOCKS = 200_000


def phase(left: Mapping[int, int], weights: Mapping[int, Fraction]) -> list[int]:
    """The source of each slot until one of them has had all its blocks, ``left``; earliest deadline first, ties by source."""
    scale = lcm(*(weights[s].denominator for s in left))
    share = {s: int(weights[s] * scale) for s in left}  # whole numbers in the weights' proportion
    total, due, out = sum(share.values()), [], []
    later = [(0, s, 0) for s in sorted(share)]
    while True:
        slot = len(out)
        while later and later[0][0] <= slot:
            _, s, j = heapq.heappop(later)
            heapq.heappush(due, (-(-(j + 1) * total // share[s]), s, j))
        _, s, j = heapq.heappop(due)
        out.append(s)
        if j + 1 == left[s]:
            return out
        heapq.heappush(later, ((j + 1) * total // share[s], s, j + 1))


def plan(blocks: Mapping[int, int], weights: Mapping[int, Fraction]) -> tuple[np.ndarray, np.ndarray]:
    """The source and the phase of each slot, until every source has had all its blocks."""
    left, sources, phases = {s: n for s, n in blocks.items() if n}, [], []
    while left:
        active = {s: w for s in left if (w := weights.get(s, Fraction(0))) > 0} or dict.fromkeys(left, Fraction(1))
        got = np.array(phase({s: left[s] for s in active}, active), np.int64)
        sources.append(got)
        phases.append(np.full(len(got), len(phases), np.int64))
        for s, n in zip(*np.unique(got, return_counts=True), strict=True):
            left[int(s)] -= int(n)
        left = {s: n for s, n in left.items() if n}
    none = [np.zeros(0, np.int64)]
    return np.concatenate(sources or none), np.concatenate(phases or none)


def _slots(sources: np.ndarray, phases: np.ndarray) -> pa.Table:
    """of, nth (the source's block), phase and slot."""
    order = np.argsort(sources, kind="stable")
    first = np.searchsorted(sources[order], sources[order])
    return pa.table({"of": sources[order], "nth": np.arange(len(order)) - first, "phase": phases[order], "slot": order})


def schedule(
    df: DataFrame,
    weights: Mapping[str | None, float | Fraction] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    power: float = 1.0,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Each row's id, fp (a hash of its text), ``source``, ``block``, ``phase``, ``slot`` and ``within`` (its first byte in the block).

    Without ``weights`` the target is each source's bytes to the given ``power``.
    Rows in the order of slot, within and id are the mixture.
    """
    docs = pick(df, id_col, text_col, source_col).toDF("id", "text", "source")
    buckets = max(BUCKETS, -(-docs.select("source").count() // BUCKET_ROWS))
    size = F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1)).cast("long")
    rows = docs.select("id", F.xxhash64("text").alias("fp"), "source", size.alias("size"))
    rows = rows.withColumn("hash", F.xxhash64("id", "fp")).withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bytes"))
    by_source = sums.groupBy("source").agg(F.sum("bytes").alias("bytes")).collect()  # a row for each source
    names = [r.source for r in sorted(by_source, key=lambda r: (r.source is not None, r.source))]
    total = {r.source: r.bytes for r in by_source}
    block_bytes = max(block_bytes, -(-sum(total.values()) // MOST_BLOCKS))
    exact = lambda w: w if isinstance(w, Fraction) else Fraction(str(w))
    goal = {k: exact(weights.get(s, 0)) if weights is not None else Fraction(float(total[s]) ** power).limit_denominator(1000) for k, s in enumerate(names)}
    sources, phases = plan({k: -(-total[s] // block_bytes) for k, s in enumerate(names)}, goal)

    spark, kind = df.sparkSession, docs.schema["source"].dataType
    turns = spark.createDataFrame(_slots(sources, phases))
    numbers = spark.createDataFrame([(s, k) for k, s in enumerate(names)], f"name {kind.simpleString()}, number long")

    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    moved = sums.select(F.col("source").alias("source2"), F.col("bucket").alias("bucket2"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("before"))
    moved = moved.join(numbers, F.col("source2").eqNullSafe(F.col("name"))).select("source2", "bucket2", "before", "number")
    inside = Window.partitionBy("source", "bucket").orderBy("hash", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(moved, F.col("source").eqNullSafe(F.col("source2")) & (F.col("bucket") == F.col("bucket2")))
    at = F.col("before") + F.col("inside")
    placed = placed.select("id", "fp", "source", "number", F.floor(at / block_bytes).cast("long").alias("block"), (at % block_bytes).alias("within"))
    turns = F.broadcast(turns) if len(sources) <= BROADCAST_BLOCKS else turns
    found = placed.join(turns, (F.col("number") == F.col("of")) & (F.col("block") == F.col("nth")))
    return found.select(F.col("id").alias(id_col), "fp", "source", "block", "phase", "slot", "within")


def interleave(df: DataFrame, weights: Mapping[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``df``, with all their columns, in the mixture's order, range-partitioned by slot.

    Rows that repeat id, text and source stand together.
    """
    plan = schedule(df, weights, id_col, text_col, source_col, **options)
    plan = plan.groupBy(F.col(id_col).alias("id"), "fp", "source").agg(F.min(F.struct("slot", "within")).alias("at"))
    at = {n: f"_{df.columns.index(n)}" for n in (id_col, text_col, source_col)}
    rows = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    match = rows[at[id_col]].eqNullSafe(plan["id"]) & (F.xxhash64(rows[at[text_col]]) == plan["fp"]) & rows[at[source_col]].eqNullSafe(plan["source"])
    mixed = rows.join(plan.hint("shuffle_hash"), match).orderBy("at.slot", "at.within", "id")
    return mixed.select(*rows.columns).toDF(*df.columns)

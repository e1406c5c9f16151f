"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the graph of each vector's nearest neighbours is cut into
balanced parts (recursive bisection at the median of the graph's second
eigenvector, improved by swaps that cut fewer edges). A small network learns
which parts a vector's neighbours lie in. Every vector of the table is put into
its most probable part; a query goes to its most probable parts, and all vectors
there are ranked by exact Euclidean distance in double precision.

How many parts a query visits is set on the sample: the fewest with which the
share of true neighbours found there reaches ``TARGET``. The number of parts
grows with the table, so that a visit stays selective: up to ``PARTS`` with its
rows, beyond with their square root, up to ``MOST_PARTS`` at 67 million; the
sample grows along, from 4,096 to 16,384 vectors.

A part's vectors are dealt to blocks and its queries to groups of bounded size;
each pair of a block and a group is one task's work, whatever a part's size, and
leaves the nearest few of each query for the merge. A vector travels once for
each ``GROUP_ROWS`` queries of its part (once at all where there are fewer), a
query once for each ``BLOCK_ROWS`` vectors, in the element type of the table.

Edge cases: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part, neither as queries nor as
candidates; ties go to the smaller id; rows that repeat an id are one candidate,
at its least distance, and a query with several vectors gets one answer for all
of them; where fewer candidates exist than are asked for, all are returned; an
empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from .common import pick

#: Sample rows, or so many for each part; table rows for each part at least; parts of a table of moderate size, and of any.
SAMPLE_ROWS, SAMPLE_PART, PART_ROWS, PARTS, MOST_PARTS = 4096, 64, 256, 32, 256
NEIGHBOURS, HIDDEN, EPOCHS, TARGET = 10, 96, 60, 0.985
#: Vectors of a block and queries of a group that one task compares, about.
BLOCK_ROWS, GROUP_ROWS = 8192, 16_384


def sample_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest others of each row."""
    out, norm = np.empty((len(x), k), np.int64), (x * x).sum(1)
    for a in range(0, len(x), 512):
        d = norm[a : a + 512, None] + norm - 2 * x[a : a + 512] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def bisect(nodes: np.ndarray, u: np.ndarray, v: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of ``nodes`` between which few of the edges (u, v) run."""
    at = np.full(int(max(u.max(initial=0), v.max(initial=0), nodes.max())) + 1, -1)
    at[nodes] = np.arange(len(nodes))
    u, v = at[u], at[v]
    inside = (u >= 0) & (v >= 0)
    u, v, n = u[inside], v[inside], len(nodes)
    degree = np.maximum(np.bincount(u, minlength=n) + np.bincount(v, minlength=n), 1)
    root = np.sqrt(degree)
    spread = lambda y: np.bincount(u, y[v], n) + np.bincount(v, y[u], n)
    y, first = rng.standard_normal(n), root / np.linalg.norm(root)
    for _ in range(80):  # power iteration on the lazy walk, away from its first eigenvector
        y = 0.5 * (y + spread(y / root) / root)
        y -= first * (first @ y)
        y /= np.linalg.norm(y) + 1e-300
    side = np.zeros(n)
    side[np.argsort(y / root, kind="stable")[n // 2 :]] = 1
    for _ in range(20):  # swap the pairs that gain most
        other = spread(side)
        gain = np.where(side == 1, degree - 2 * other, 2 * other - degree)
        ones, zeros = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        ones, zeros = ones[np.argsort(-gain[ones], kind="stable")], zeros[np.argsort(-gain[zeros], kind="stable")]
        m = min(len(ones), len(zeros))
        m = min(int((gain[ones[:m]] + gain[zeros[:m]] > 0).sum()), max(1, n // 50))
        if not m or gain[ones[0]] + gain[zeros[0]] <= 0:
            break
        cut = lambda s: int((s[u] != s[v]).sum())
        new = side.copy()
        new[ones[:m]], new[zeros[:m]] = 0, 1
        if cut(new) >= cut(side):
            break
        side = new
    return nodes[side == 0], nodes[side == 1]


def balanced_parts(near: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part from 0 to ``parts`` - 1 (a power of two) for each node of the neighbour graph, of sizes at most one apart by halving."""
    u, v = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
    groups = [np.arange(len(near))]
    while len(groups) < parts:
        groups = [half for g in groups for half in bisect(g, u, v, rng)]
    out = np.empty(len(near), np.int64)
    for k, g in enumerate(groups):
        out[g] = k
    return out


@dataclass(frozen=True)
class Router:
    """A network with one hidden layer; gives the parts' log-odds."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(x: np.ndarray, goal: np.ndarray, rng: np.random.Generator) -> Router:
    """Adam on the cross entropy with the parts' shares among each row's neighbours."""
    scale = 1 / (x.std() + 1e-12)
    p = [rng.standard_normal((x.shape[1], HIDDEN)) * scale * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, goal.shape[1])) * 0.1, np.zeros(goal.shape[1])]
    m, s, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            h = np.maximum(x[at] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(1, keepdims=True))
            d = (z / z.sum(1, keepdims=True) - goal[at]) / len(at)
            back = (d @ p[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((x[at].T @ back, back.sum(0), h.T @ d, d.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.999 * s[i] + 0.001 * g * g
                p[i] = p[i] - (0.003 * (scale if i == 0 else 1)) * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*p)


def fit(x: np.ndarray, parts: int, seed: int = 7) -> tuple[Router, int]:
    """A router for ``parts`` parts, learned on the rows of ``x``, and the number of parts that a query should visit."""
    rng = np.random.default_rng(seed)
    near = sample_graph(x, min(NEIGHBOURS, len(x) - 1))
    part = balanced_parts(near, parts, rng)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), near.shape[1] + 1), np.concatenate([part[near], part[:, None]], 1).ravel()), 1 / (near.shape[1] + 1))
    held = rng.permutation(len(x))
    cut = len(x) * 4 // 5
    trial = train_router(x[held[:cut]], goal[held[:cut]], rng)  # the visits are set on rows that the trial has not seen
    scores = trial(x)
    order, own = np.argsort(-scores[held[cut:]], 1), scores.argmax(1)
    rank = np.argsort(order, 1)
    hit = np.bincount(np.take_along_axis(rank, own[near[held[cut:]]], 1).ravel(), minlength=parts).cumsum() / max(1, near[held[cut:]].size)
    return train_router(x, goal, rng), int(np.searchsorted(hit, TARGET)) + 1


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest rows of ``x`` to one query, exactly, and their distances."""
    rough = (x * x).sum(1) - 2 * (x @ q)
    rough[ids == own] = np.inf
    most = np.partition(rough, min(k, len(rough)) - 1)[min(k, len(rough)) - 1]
    at = np.flatnonzero((rough <= most + 1e-9 * (1 + abs(most))) & (ids != own)) if np.isfinite(most) else np.flatnonzero(ids != own)
    d = np.sqrt(((x[at] - q) ** 2).sum(1))
    order = np.lexsort((ids[at], d))
    return at[order], d[order]


def _compare(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    left, right = left.combine_chunks(), right.combine_chunks()
    out: list[list] = [[], [], []]
    if len(left) and len(right):
        x, ids = _vectors(left["vector"].chunk(0)), left["id"].to_numpy()
        one = np.unique(ids, return_index=True)[1] if len(np.unique(ids)) == len(ids) else None
        for q, query in zip(_vectors(right["vector"].chunk(0)), right["id"].to_numpy(), strict=True):
            at, d = _nearest(q, query, x, ids, k if one is not None else len(ids))
            near, first = np.unique(ids[at], return_index=True)
            first = np.sort(first)[:k]
            out[0].append(np.full(len(first), query))
            out[1].append(ids[at][first])
            out[2].append(d[first])
    return pa.table([np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.int64, np.float64), strict=True)], ["query_id", "vec_id", "score"])


def search(df: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """query_id, ``rank`` from 1, vec_id and ``score`` (the distance) of the nearest found for the rows that meet ``queries``.

    Ids are whole numbers; ``queries`` is a condition on the id column.
    """
    v = F.col(vector_col)
    good = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = pick(df, id_col, vector_col).where(good & F.col(id_col).isNotNull())
    kind = "float" if df.schema[vector_col].dataType.elementType.typeName() == "float" else "double"
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.cast(f"array<{kind}>").alias("vector"), queries.alias("asks"))
    spark, lengths = df.sparkSession, rows.groupBy(F.size("vector").alias("length")).count().collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], result)
    length, n = max(((r["length"], r["count"]) for r in lengths), key=lambda r: (r[1], r[0]))
    rows = rows.where(F.size("vector") == length)

    parts = 1
    while parts < PARTS and n >= 2 * parts * PART_ROWS:
        parts *= 2
    while PARTS <= parts < MOST_PARTS and n >= 4096 * parts * parts:
        parts *= 2
    sample = max(SAMPLE_ROWS, SAMPLE_PART * parts)
    mark = F.xxhash64("id")
    some = rows.where(F.pmod(mark, F.lit(1 << 20)) < F.lit(min(1 << 20, -(-2 * sample * (1 << 20) // n)))).orderBy(mark, "id").limit(sample)
    router, visits = None, 1
    if parts > 1:
        x = np.array([r[0] for r in some.select("vector").collect()], float)  # at most ``sample``
        router, visits = fit(x, parts)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = router(_vectors(b.column(1))).argmax(1) if router else np.zeros(len(b), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32))], ["id", "vector", "asks", "part"])

    placed = materialize(rows.mapInArrow(assign, T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType())])), "placed")
    held = dict(placed.groupBy("part").count().collect())  # a row for each part
    counts = np.array([held.get(i, 0) for i in range(parts)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = np.argsort(-router(_vectors(b.column(1))), 1) if router else np.zeros((len(b), 1), np.int64)
            enough = (counts[order].cumsum(1) < 2 * k + 1).sum(1) + 1  # further parts where the first are too small
            n = np.minimum(np.maximum(visits, enough), parts)
            at = np.repeat(np.arange(len(b)), n)
            part = np.concatenate([o[:m] for o, m in zip(order, n.tolist(), strict=True)]) if len(b) else order.ravel()
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(part.astype(np.int32))], ["id", "vector", "part"])

    asked = placed.where("asks").select("id", "vector").mapInArrow(route, f"id long, vector array<{kind}>, part int")
    asked = materialize(asked, "asked")
    askers = dict(asked.groupBy("part").count().collect())
    blocks = {i: max(1, -(-int(counts[i]) // BLOCK_ROWS)) for i in range(parts)}
    groups = {i: max(1, -(-askers.get(i, 0) // GROUP_ROWS)) for i in range(parts)}
    many = lambda by: F.element_at(F.array(*[F.lit(by[i]) for i in range(parts)]), F.col("part") + 1)
    deal = lambda by: F.pmod(F.xxhash64("id"), many(by)).cast("int")
    spread = lambda by: F.explode(F.sequence(F.lit(0), many(by) - 1))
    left = placed.select("id", "vector", "part", deal(blocks).alias("block")).withColumn("group", spread(groups))
    right = asked.select("id", "vector", "part", deal(groups).alias("group")).withColumn("block", spread(blocks))
    key = ["part", "block", "group"]
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda x, y: _compare(x, y, k), "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

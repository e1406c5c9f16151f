"""Removal of word sequences that recur: Rabin-Karp window hashes counted in Spark.

A window is ``length`` consecutive words of one document. Each word covered by a
window whose word sequence also starts earlier (smaller id, or earlier in the
same document) is removed; overlapping windows merge into maximal intervals.
All windows are judged, on the input as it is.

Shuffling a hash of each window would move several times the input. Two exact
steps come first, both on what the words are and not on where they stand:

1. Each window has an anchor: its ``ANCHOR``-word sequence of least hash. About
   one word in seven is one. Where the anchor moves to one whose hash says so, a
   document's windows are cut into segments, of about 60. A segment whose words
   (with those that its last window reaches) occurred earlier is removed whole,
   which settles copies of any size with one row for each segment. First
   occurrences of all windows lie in first segments.
2. Equal windows have equal anchors, so of the remaining windows only those whose
   anchor occurs in two unlike segments, or twice in one, need comparing.

The hashes of the windows that are left are counted and their first places
found by an aggregation with map-side combine and a join back, which splits hot
hashes; the text itself is shuffled by document only.

Hashes have 64 bits; of ``n`` compared windows about ``n * n / 2 ** 65`` pairs
collide (5e-4 at 130 million).

Edge cases: a null or empty text, or one with fewer words than a window, loses
nothing; long texts are read whole; a null id comes before all others; rows that
repeat an id with the same text are one document, with unlike texts each a
document of its own; an empty table gives an empty table; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, materialize
from .common import Chunk, chunks, mix, pick

LENGTH = 20
#: Words of an anchor.
ANCHOR = 6
#: One anchor in so many begins a segment.
RUNS = 8


def _leftmost_minima(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each ``n`` values on end and the first place where it stands, by doubling."""
    least, where, span = values, np.arange(len(values)), 1
    while span < n and len(least):
        step = min(span, n - span)
        right = least[step:] < least[:-step]
        least, where = np.where(right, least[step:], least[:-step]), np.where(right, where[step:], where[:-step])
        span += step
    return least, where


class _Windows:
    """Windows of a chunk with their segments and anchors; positions are words of the chunk."""

    def __init__(self, chunk: Chunk, length: int) -> None:
        self.chunk, self.length, words = chunk, length, chunk.word_hash()
        k = min(ANCHOR, length)
        self.hash, self.at = chunk.window_hash(words, length)
        grams, gram_at = chunk.window_hash(words, k)
        self.doc = chunk.doc_of_word[self.at]
        self.start = self.at - chunk.words[self.doc]
        gram = np.full(len(words), np.iinfo(np.uint64).max, np.uint64)
        gram[gram_at] = grams
        least, where = _leftmost_minima(gram, length - k + 1)
        self.anchor, self.anchor_at = least[self.at], where[self.at]
        moved = np.append(True, np.diff(self.anchor_at) != 0)[: len(self.at)]
        cut = (moved & (self.anchor % np.uint64(RUNS) == 0)) | (self.start == 0)
        self.segment = np.cumsum(cut) - 1
        self.first = np.flatnonzero(cut)
        self.count = np.bincount(self.segment, minlength=len(self.first))
        a = self.at[self.first]
        self.segment_hash = chunk.range_hash(words, a, a + self.count + length - 1)


def _batch(schema: T.StructType, *columns: pa.Array | np.ndarray) -> pa.RecordBatch:
    made = [c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns]
    return pa.RecordBatch.from_arrays(made, schema.fieldNames())


def _fields(id_field: T.StructField | None, *names: str) -> T.StructType:
    return T.StructType(([T.StructField("doc", id_field.dataType)] if id_field else []) + [T.StructField(n, T.LongType()) for n in names])


def _segments(docs: DataFrame, length: int) -> DataFrame:
    """Every segment: doc, fp, seg, start, n."""
    schema = _fields(docs.schema[0], "fp", "seg", "start", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, chunk in chunks(batch.column(2)):
                w = _Windows(chunk, length)
                doc = pa.array(w.doc[w.first] + part.start)
                yield _batch(schema, batch.column(0).take(doc), batch.column(1).take(doc), w.segment_hash, w.start[w.first], w.count)

    return docs.mapInArrow(run, schema)


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """Anchors by unlike segment: anchor, seg, and whether it stands there twice."""
    schema = _fields(None, "anchor", "seg", "twice")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, chunk in chunks(batch.column(0)):
                w = _Windows(chunk, length)
                if not len(w.at):
                    continue
                new = np.append(True, (np.diff(w.segment) != 0) | (np.diff(w.anchor_at) != 0))
                anchor, of = w.anchor[new], w.segment[new]
                _, at, n = np.unique(anchor ^ mix(of), return_index=True, return_counts=True)
                yield _batch(schema, anchor[at], w.segment_hash[of[at]], (n > 1).astype(np.int64))

    return docs.select("text").mapInArrow(run, schema)


def _windows(docs: DataFrame, length: int) -> DataFrame:
    """Windows to compare: h, doc, fp, start; ``docs`` also has ``look``, the segments and anchors in question."""
    schema = T.StructType([T.StructField("h", T.LongType()), *_fields(docs.schema[0], "fp", "start")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            look = batch.column(3)
            off, inner = look.offsets.to_numpy(), look.flatten()
            seg_start, seg_anchors = inner.field(0).to_numpy(), inner.field(1)
            in_off, known = seg_anchors.offsets.to_numpy(), seg_anchors.flatten().to_numpy().view(np.uint64)
            in_off, off = in_off - in_off[0], off - off[0]
            for part, chunk in chunks(batch.column(2)):
                w = _Windows(chunk, length)
                # the segment of each (document, start) asked for, then each of its anchors
                asked = np.arange(off[part.start], off[part.stop])
                asked_doc = np.repeat(np.arange(chunk.n), np.diff(off[part.start : part.stop + 1]))
                place = chunk.words[asked_doc] + seg_start[asked]
                seg = np.searchsorted(w.at[w.first], place)
                n = in_off[asked + 1] - in_off[asked]
                want = np.empty(int(n.sum()), [("seg", np.int64), ("anchor", np.uint64)])
                want["seg"] = np.repeat(seg, n)
                want["anchor"] = known[np.repeat(in_off[asked] - np.cumsum(n) + n, n) + np.arange(len(want))]
                have = np.empty(len(w.at), want.dtype)
                have["seg"], have["anchor"] = w.segment, w.anchor
                keys = lambda x: x["anchor"] ^ (x["seg"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                hit = np.flatnonzero(np.isin(keys(have), keys(want)))
                doc = pa.array(w.doc[hit] + part.start)
                yield _batch(schema, w.hash[hit], batch.column(0).take(doc), batch.column(1).take(doc), w.start[hit])

    return docs.mapInArrow(run, schema)


def _place(*more: str) -> Column:
    return F.struct("doc", "start", *more)


def _same_doc(a: DataFrame, b: DataFrame) -> Column:
    return a["doc"].eqNullSafe(b["doc"]) & (a["fp"] == b["fp"])


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """For each document that loses words: doc, fp and ``gone``, ranges of window starts (start, n).

    ``docs`` has doc, fp (a hash of the text) and text.
    """
    segments = _segments(docs, length)
    first = segments.groupBy("seg").agg(F.min(_place("fp", "n")).alias("first"), F.count("*").alias("copies"))
    # what is aggregated by a hash is a table of its own, so that the join with it is of plain exchanges, which are split where a hash is hot
    first = materialize(first.select("seg", "first.doc", "first.fp", "first.start", "copies"), "first")
    again = first.where("copies > 1").select(F.col("seg").alias("seg1"), F.col("doc").alias("doc1"), F.col("start").alias("start1"))
    dropped = segments.join(again, F.col("seg") == F.col("seg1")).where(~(F.col("doc").eqNullSafe(F.col("doc1")) & (F.col("start") == F.col("start1"))))
    dropped = materialize(dropped.select("doc", "fp", "start", "n"), "segments")

    anchors = _anchors(docs, length)
    doubtful = anchors.groupBy("anchor").agg(F.min("seg").alias("a"), F.max("seg").alias("b"), F.max("twice").alias("twice")).where("a != b OR twice = 1")
    doubtful = materialize(doubtful.select("anchor"), "doubtful")
    asked = anchors.join(doubtful, "anchor").groupBy("seg").agg(F.collect_set("anchor").alias("anchors"))
    asked = asked.join(first, "seg").select("doc", "fp", "start", "anchors")
    look = materialize(asked.groupBy("doc", "fp").agg(F.collect_list(F.struct("start", "anchors")).alias("look")), "anchors")

    found = docs.join(look.hint("shuffle_hash"), _same_doc(docs, look)).select(docs["doc"], docs["fp"], docs["text"], look["look"])
    windows = materialize(_windows(found, length), "windows")
    discard(first, doubtful)
    again = windows.groupBy("h").agg(F.min(_place()).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    recurring = materialize(again.select(F.col("h").alias("h1"), F.col("first.doc").alias("doc1"), F.col("first.start").alias("start1")), "recurring")
    later = windows.join(recurring, F.col("h") == F.col("h1")).where(~(F.col("doc").eqNullSafe(F.col("doc1")) & (F.col("start") == F.col("start1"))))
    gone = dropped.unionByName(later.select("doc", "fp", "start", F.lit(1).cast("long").alias("n")))
    gone = materialize(gone.groupBy("doc", "fp").agg(F.collect_list(F.struct("start", "n")).alias("gone")), "gone")
    discard(dropped, look, windows, recurring)
    return gone


def _cut(docs: DataFrame, length: int, names: list[str]) -> DataFrame:
    """``docs`` has an id, the text, ``gone`` and further columns; returns id, n_words, n_removed, spans, the text that is left and the further columns, as ``names``."""
    schema = T.StructType([
        docs.schema[0], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]), False)),
        T.StructField("text", T.StringType()), *docs.schema[3:],
    ])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column(2)
            for part, chunk in chunks(batch.column(1)):
                texts = batch.column(1).slice(part.start, chunk.n)
                own, spans, left, lost = gone.slice(part.start, chunk.n), [[] for _ in range(chunk.n)], None, np.zeros(chunk.n, np.int64)
                for i in np.flatnonzero(~np.asarray(own.is_null())):
                    ranges = own[int(i)].values
                    mark = np.zeros(chunk.n_words[i] + 1, np.int64)
                    start = ranges.field(0).to_numpy()
                    np.add.at(mark, start, 1)
                    np.add.at(mark, start + ranges.field(1).to_numpy() + length - 1, -1)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(mark) > 0, [0]]).astype(np.int8)))
                    a, b = edge[::2], edge[1::2]
                    spans[i], lost[i] = [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)], int((b - a).sum())
                    left = texts.to_pylist() if left is None else left
                    base = chunk.words[i]
                    to = np.append(chunk.starts[base : base + chunk.n_words[i]], chunk.off[i + 1])
                    raw, pieces, at = chunk.data, [], int(chunk.off[i])
                    for x, y in zip(to[a].tolist(), to[b].tolist(), strict=True):
                        pieces.append(raw[at:x].tobytes())
                        at = y
                    left[i] = b"".join([*pieces, raw[at : chunk.off[i + 1]].tobytes()]).decode()
                out = texts if left is None else pa.array(left, texts.type)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, chunk.n), pa.array(chunk.n_words), pa.array(lost), pa.array(spans, span), out, *(c.slice(part.start, chunk.n) for c in batch.columns[3:])], schema.fieldNames())

    return docs.mapInArrow(run, schema).toDF(*names)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's id, ``n_words``, ``n_removed``, removed word ``spans`` [start, end), the ``text`` left, and the columns to ``keep``.

    What is left keeps its own white space; a null text stays null.
    """
    rows = pick(df, id_col, text_col, *keep).toDF("doc", "text", *[f"keep{i}" for i in range(len(keep))]).withColumn("fp", F.xxhash64("text"))
    gone = repeated(rows.select("doc", "fp", "text"), length)
    joined = rows.join(gone.hint("shuffle_hash"), _same_doc(rows, gone), "left").select(rows["doc"], rows["text"], gone["gone"], *[rows[f"keep{i}"] for i in range(len(keep))])
    return _cut(joined, length, [id_col, "n_words", "n_removed", "spans", text_col, *keep])

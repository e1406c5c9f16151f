"""Near duplicates: a minwise set-similarity join over word shingles, with an exact one for its large nodes.

A document's set is its distinct word shingles; two documents are linked when
their Jaccard similarity reaches ``share`` percent. Equal sets are collapsed
first. All sets are dealt by several minwise values at a time, of their
``COORDINATES`` (at 0.8 by 20 disjoint threes): a single one is shared by whatever
holds a frequent shingle, so its nodes grow with the corpus. Nodes of at most
``MEMBERS`` members are compared exhaustively; where more than half are known to
belong together, each of the others is compared with the whole node. So are larger
nodes in which few have other labels than the most frequent, in slices.

What stands in any other large node is joined exactly, by prefixes: shingles are put
in one order, rare ones first, and of ``n`` shingles a document is dealt by its first
``n - ceil(share * n / 100) + 1``. Similar sets have one of these in common, so
each pair meets. The frequencies come from ``SAMPLE`` of the documents in question;
any order gives all pairs, they only keep nodes small. A node that is large even so is
cut into slices, and each slice of its members outside the most frequent label
meets each slice of all: no pair is left out, whatever a node's size.

A component needs no more links than span it, and labels come from links that
full sets have confirmed, never from sketches:

1. Members of each first node of more than ``TINY`` meet its smallest one. What
   is confirmed gives labels; large groups of near copies cost one pair a member.
2. Only nodes that hold several labels go on. They give the pairs, most alike
   first, that would connect all their labels.
3. What was refuted may have hidden other links, so with the new labels the
   nodes give every pair across labels that was not confirmed or refuted yet.

Candidates are pairs whose sketches allow the similarity: two bits of each
minwise value, the parities of 768 classes of shingles, which tell how many
shingles two sets do not share, and the sizes. A pair of similarity 0.8 is passed
over with a chance of 3e-5 (``MARGIN`` standard deviations), one of 0.82 with
less than 1e-8; sets of some hundred shingles below 0.76 hardly ever pass.

Recall: at a similarity of exactly ``share`` a pair is missed by all first nodes with
a chance of at most ``MISSED``, 6e-7 at 0.8 (below 0.2 with more, for want of
coordinates); nothing is lost within a node but what sketches pass over. Where many documents are nearly
as alike as links ask, but not linked, pairs grow with the square of their number.
Tests measure recall against all pairs.

Shingle hashes have 64 bits, the sets that are compared 40 of them; a pair of
sets of a thousand shingles is off by one with a chance below 1e-6.

Edge cases: a null or empty text, or one without words, has an empty set and is
linked with nothing; with fewer words than a shingle the whole sequence counts
as one; long texts are read whole; a row with a null id is linked with nothing
and its component is null; rows that repeat an id are one document, linked by
any of its texts, except in ``keep``, which keeps unlike texts apart; an empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, gathered, materialize
from .common import Chunk, chunks, mix, pick, prefix
from .graph import components

COORDINATES, TINY, SMALL, MEMBERS = 64, 4, 64, 4096
#: Chance at most that a pair just similar enough shares no node.
MISSED = 1e-6
#: Pairs across labels of a node larger than ``MEMBERS``, in squares of that, that are compared without prefixes.
SQUARES = 4
#: Documents whose shingles are counted for the order of prefixes, about, and shingles that it holds at most.
SAMPLE, FREQUENT = 4096, 1 << 17
#: Standard deviations by which a sketch may fall short of the similarity asked for.
MARGIN = 4.0
#: Pairs that are compared in one vectorised step, and ids that are sent to all tasks at most.
PAIRS, BROADCAST_IDS = 1 << 17, 500_000
#: Members of nodes that a task compares, about.
TASK_MEMBERS = 2000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SCALE, _SHIFT = (mix(np.arange(1, COORDINATES + 1) * k) for k in (7919, 104729))
_SCALE |= np.uint64(1)
#: Bytes of a sketch: minwise values, parities, size.
_MIN, _ODD, _SIZE = COORDINATES // 4, 96, 4


def _sets(chunk: Chunk, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents one after another, sorted in each, and where each one's begin."""
    chunk = Chunk(_LOWER[chunk.data], chunk.off)
    word = chunk.word_hash()
    grams, at = chunk.window_hash(word, words)
    short = np.flatnonzero((chunk.n_words > 0) & (chunk.n_words < words))
    whole = chunk.range_hash(word, chunk.words[short], chunk.words[short + 1])
    off = prefix(np.bincount(chunk.doc_of_word[at], minlength=chunk.n))
    own = [np.unique(grams[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    for i, h in zip(short.tolist(), whole, strict=True):
        own[i] = np.array([h], np.uint64)
    return (np.concatenate(own) if own else grams), prefix(np.array([len(x) for x in own], np.int64))


def _signatures(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Minwise values, 32 bits of each, of the sets that are not empty."""
    at = off[:-1][np.diff(off) > 0]
    out = np.empty((len(at), COORDINATES), np.uint32)
    for k in range(COORDINATES if len(at) else 0):
        out[:, k] = np.minimum.reduceat(values * _SCALE[k] + _SHIFT[k], at).astype(np.uint32)
    return out


def _sketches(sig: np.ndarray, values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of the sets that are not empty: two bits of each coordinate, parities of classes of shingles, and the size."""
    n = np.diff(off)
    at, low = off[:-1][n > 0], (sig & 3).astype(np.uint8)
    odd = np.zeros((len(at), _ODD // 8), np.uint64)
    bit = np.uint64(1) << (values >> np.uint64(8) & np.uint64(63))
    of = (values >> np.uint64(14) & np.uint64(0xFFFF)) % np.uint64(_ODD // 8)
    for k in range(_ODD // 8 if len(at) else 0):
        odd[:, k] = np.bitwise_xor.reduceat(np.where(of == np.uint64(k), bit, np.uint64(0)), at)
    packed = low[:, ::4] | low[:, 1::4] << 2 | low[:, 2::4] << 4 | low[:, 3::4] << 6
    return np.concatenate([packed, odd.view(np.uint8), n[n > 0].astype(np.uint32)[:, None].view(np.uint8)], 1)


class _Compared:
    """Sketches in parts, and which pairs of them allow a similarity."""

    def __init__(self, raw: np.ndarray) -> None:
        part = lambda a, n, kind: np.ascontiguousarray(raw[:, a : a + n]).view(kind)
        self.low, self.odd = part(0, _MIN, np.uint64), part(_MIN, _ODD, np.uint64)
        self.size = part(_MIN + _ODD, _SIZE, np.uint32).ravel().astype(np.float64)

    def alike(self, other: _Compared, i: np.ndarray, j: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
        """The places in ``i`` and ``j`` of pairs that pass, and how many of the classes that they may differ in each does."""
        n, m = self.size[i], other.size[j]
        most = (n + m) * (100 - share) / (100 + share)  # shingles that they may not share
        at = np.flatnonzero(np.abs(n - m) <= most)
        i, j, most = i[at], j[at], most[at]
        odd = np.bitwise_count(self.odd[i] ^ other.odd[j]).sum(-1, dtype=np.int64)
        bits, e = 8 * _ODD, np.exp(-4 * most / (8 * _ODD))
        mean, spread = bits / 2 * (1 - np.sqrt(e)), np.sqrt(np.maximum(bits / 4 * (1 - e) - most * e, 1))
        good = np.flatnonzero(odd <= mean + MARGIN * spread)
        z = self.low[i[good]] ^ other.low[j[good]]
        unlike = np.bitwise_count((z | z >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(-1, dtype=np.int64)
        good = good[COORDINATES - unlike >= _enough(share)]
        return at[good], odd[good] - mean[good]


def _enough(share: int) -> float:
    """In how many coordinates sketches agree at least if sets are similar, but for ``MARGIN`` deviations."""
    p = share / 100 + (1 - share / 100) / 4
    return COORDINATES * p - MARGIN * float(np.sqrt(COORDINATES * p * (1 - p)))


def _fixed(rows: np.ndarray) -> pa.Array:
    """A binary column with a row for each row of a two-dimensional array."""
    wide = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(wide), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _matrix(column: pa.Array, kind: type, wide: int) -> np.ndarray:
    """The reverse of :func:`_fixed`."""
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, kind, count=(off[-1] - off[0]) // kind().itemsize, offset=off[0]).reshape(len(column), wide) if len(column) else np.zeros((0, wide), kind)


def _sketch_column(column: pa.Array) -> _Compared:
    return _Compared(_matrix(column, np.uint8, _MIN + _ODD + _SIZE))


def _describe(docs: DataFrame, words: int) -> DataFrame:
    """doc, n (set size), h1 and h2 (hashes of the set), sig and sketch, null where the set is empty."""
    schema = T.StructType([docs.schema[0], *(T.StructField(n, T.LongType()) for n in ("n", "h1", "h2")), *(T.StructField(n, T.BinaryType()) for n in ("sig", "sketch"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, chunk in chunks(batch.column(1)):
                values, off = _sets(chunk, words)
                n = np.diff(off)
                h1, h2 = (np.diff(prefix(mix(values ^ np.uint64(k)))[off]) if len(values) else np.zeros(chunk.n, np.uint64) for k in (1, 2))
                row = pa.array(np.cumsum(n > 0) - 1, mask=n == 0)
                sig = _signatures(values, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, chunk.n), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), _fixed(sig).take(row), _fixed(_sketches(sig, values, off)).take(row)], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def _bands(share: int) -> tuple[int, int]:
    """Minwise values of a node's key, as many as ``MISSED`` allows, and keys of a set, as few as it takes."""
    for wide in range(COORDINATES, 1, -1):
        apart = 1 - (share / 100) ** wide
        if apart ** (COORDINATES // wide) <= MISSED:
            return wide, next(n for n in range(1, COORDINATES + 1) if apart**n <= MISSED)
    return 1, COORDINATES


def _nodes(sets: DataFrame, share: int) -> DataFrame:
    """(key, doc): the nodes by disjoint groups of minwise values, of rows with doc and sig."""
    schema = T.StructType([T.StructField("key", T.LongType()), sets.schema["doc"]])
    wide, n = _bands(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _matrix(batch.column("sig"), np.uint32, COORDINATES)
            for k, key in enumerate(mix(np.arange(1, n + 1))):
                for c in range(k * wide, (k + 1) * wide):
                    key = mix(key ^ sig[:, c].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("doc")], ["key", "doc"])

    return sets.mapInArrow(run, schema)


def _frequent(texts: DataFrame, n: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur more than once in a sample of ``n`` documents, ascending, and in how many they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, chunk in chunks(batch.column(0)):
                values, count = np.unique(_sets(chunk, words)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(count)], ["shingle", "n"])

    some = texts.where(F.pmod(F.xxhash64("doc"), F.lit(max(1, n // SAMPLE))) == 0)
    rows = some.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1")
    rows = rows.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    values, count = rows["shingle"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(values)
    return values[order], count[order]


def _prefixes(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], words: int, share: int) -> DataFrame:
    """(key, doc): nodes by the shingles of each document's prefix, of which similar sets have one in common."""
    schema, (known, times) = T.StructType([T.StructField("key", T.LongType()), texts.schema["doc"]]), frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, chunk in chunks(batch.column(1)):
                values, off = _sets(chunk, words)
                order = values >> np.uint64(16)
                if len(known) and len(values):
                    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                    order |= np.where(known[at] == values, np.minimum(times[at], 0xFFFF), 0).astype(np.uint64) << np.uint64(48)
                n = np.diff(off)
                first = np.where(n > 0, n - (share * n + 99) // 100 + 1, 0)
                own = [np.partition(order[a:b], k - 1)[:k] for a, b, k in zip(off[:-1].tolist(), off[1:].tolist(), first.tolist(), strict=True) if k]
                key = mix(np.concatenate(own)) if own else order
                doc = pa.array(np.repeat(np.arange(chunk.n), first) + part.start)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(doc)], ["key", "doc"])

    return texts.mapInArrow(run, schema)


def _alike(pairs: DataFrame, share: int) -> DataFrame:
    """From rows of a, b, sketch, sketch2: the pairs (a, b) whose sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, at = _sketch_column(batch.column(2)), _sketch_column(batch.column(3)), np.arange(len(batch))
            yield batch.select([0, 1]).take(pa.array(x.alike(y, at, at, share)[0]))

    return pairs.select("a", "b", "sketch", "sketch2").mapInArrow(run, pairs.select("a", "b").schema)


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Of pairs of labels, in order, as few as connect all that they connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    out = []
    for k, (p, q) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        p, q = find(p), find(q)
        if p != q:
            root[p] = q
            out.append(k)
    return out


def _inner_pairs(off: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within each range whose labels differ, about ``PAIRS`` at once."""
    size = np.diff(off)
    for m in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():
        at, (i, j) = off[:-1][size == m], np.triu_indices(m, 1)
        step = max(1, PAIRS // len(i))
        for a in range(0, len(at), step):
            x, y = (at[a : a + step, None] + i).ravel(), (at[a : a + step, None] + j).ravel()
            cross = label[x] != label[y]
            yield x[cross], y[cross]
    for k in np.flatnonzero(size > SMALL).tolist():
        own = label[off[k] : off[k + 1]]
        top = np.bincount(own).argmax()
        others, step = np.flatnonzero(own != top), max(1, PAIRS // len(own))
        for a in range(0, len(others), step):
            x, y = (z.ravel() for z in np.broadcast_arrays(others[a : a + step, None], np.arange(len(own))))
            cross = (own[x] != own[y]) & ((x < y) | (own[y] == top))
            yield off[k] + x[cross], off[k] + y[cross]


def _within(nodes: DataFrame, share: int, spanning: bool) -> DataFrame:
    """From rows of one ``members`` array<struct<doc, label, sketch>> each: alike pairs across labels, all or as many as would connect the labels."""
    doc = nodes.schema["members"].dataType.elementType[0].dataType
    schema = T.StructType([T.StructField("a", doc), T.StructField("b", doc)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inner, off = batch.column(0).flatten(), batch.column(0).offsets.to_numpy()
            docs, label = inner.field(0), inner.field(1).dictionary_encode().indices.to_numpy()
            own, found = _sketch_column(inner.field(2)), []
            for i, j in _inner_pairs(off - off[0], label):
                good, apart = own.alike(own, i, j, share)
                found.append((i[good], j[good], apart))
            if found:
                i, j, apart = (np.concatenate(x) for x in zip(*found, strict=True))
                if spanning:
                    order = np.argsort(apart, kind="stable")
                    some = order[_forest(label[i[order]], label[j[order]])]
                    i, j = i[some], j[some]
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(x)) for x in (i, j)], ["a", "b"])

    return nodes.select("members").mapInArrow(run, schema)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _stars(nodes: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The members of nodes that are not tiny with the smallest one, where sketches allow it."""
    pairs = nodes.where(F.col("size") > TINY).select(F.col("hub").alias("a"), F.col("doc").alias("b")).where("a < b").distinct()
    pairs = pairs.join(sets.select(F.col("doc").alias("b"), "sketch"), "b").join(sets.select(F.col("doc").alias("a"), F.col("sketch").alias("sketch2")), "a")
    return _alike(pairs, share).distinct()


def _labels(sets: DataFrame, links: DataFrame) -> DataFrame:
    """doc, label (the least of its component) and sketch."""
    root = components(links)
    out = materialize(sets.select("doc", "sketch").join(root.select(F.col("a").alias("own"), F.col("b").alias("label")), F.col("doc") == F.col("own"), "left").select("doc", F.coalesce("label", "doc").alias("label"), "sketch"), "labels")
    discard(root)
    return out


def _several(nodes: DataFrame, label: DataFrame, every: bool) -> DataFrame:
    """Members of the nodes that hold several labels: key, doc, label, sketch, and whether the node is ``small``, to be compared in full.

    Nodes that one label prevails in are compared in full together, so that a pair
    is met once and not in each of them. Large ones are in slices. With ``every`` all are
    ``small``, else all but large ones with more than ``SQUARES`` squares of pairs.
    """
    n = nodes.count()
    by_label = nodes.select("key", "doc").join(label.select("doc", "label"), "doc").groupBy(F.col("key").alias("k"), "label").agg(F.count("*").alias("n"))
    size = by_label.groupBy("k").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("top")).where("top.n < size")
    few = F.lit(True) if every else (F.col("size") <= MEMBERS) | (F.col("size") * (F.col("size") - F.col("top.n")) <= SQUARES * MEMBERS**2)
    prevails = (F.col("size") > SMALL) & few & (2 * F.col("top.n") > F.col("size"))
    size = size.select("k", F.when(prevails, F.xxhash64(F.lit("label"), "top.label")).otherwise(F.col("k")).alias("node"), prevails.alias("joined"), few.alias("small"))
    size = materialize(gathered(size, n), "several")
    rows = nodes.select("key", "doc").join(size, F.col("key") == F.col("k")).select(F.col("node").alias("key"), "doc", "small", "joined")
    rows = rows.where("NOT joined").unionByName(rows.where("joined").distinct())
    out = materialize(rows.join(label, "doc").select("key", "doc", "label", "sketch", "small"), "rows")
    discard(size)
    return _sliced(out)


def _sliced(rows: DataFrame) -> DataFrame:
    """``rows`` with each ``small`` node of more than ``MEMBERS`` dealt to several, in which all its pairs across labels meet.

    Each slice of the members outside the node's most frequent label meets each slice of all.
    """
    half = max(1, MEMBERS // 2)
    size = rows.where("small").groupBy("key", "label").agg(F.count("*").alias("n")).groupBy(F.col("key").alias("k")).agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("top"))
    cut = lambda n: F.ceil(n / half).cast("int")
    large = size.where(F.col("size") > MEMBERS).select("k", F.col("top.label").alias("most"), cut(F.col("size")).alias("all"), cut(F.col("size") - F.col("top.n")).alias("others"))
    large = materialize(gathered(large, rows.count()), "large")
    if large.isEmpty():
        discard(large)
        return rows
    held = rows.join(large, F.col("key") == F.col("k"))
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = held.withColumn("j", F.pmod(F.xxhash64("doc"), F.col("all")).cast("int")).withColumn("i", up_to("others"))
    two = held.where("label != most").withColumn("i", F.pmod(F.xxhash64("doc"), F.col("others")).cast("int")).withColumn("j", up_to("all"))
    dealt = one.unionByName(two).withColumn("key", F.xxhash64("key", "i", "j")).select(*rows.columns).dropDuplicates(["key", "doc"])
    rest = rows.join(large.select(F.col("k").alias("key")), "key", "left_anti").select(*rows.columns)
    out = materialize(rest.unionByName(dealt), "rows")
    discard(rows, large)
    return out


def _members(rows: DataFrame, n: int) -> DataFrame:
    """A row for each node, all of bounded size, in as many tasks as ``n`` members need."""
    return gathered(_grouped(rows), n, TASK_MEMBERS)


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("doc", "label", "sketch"))).alias("members"))


def _across(nodes: DataFrame, docs: DataFrame, label: DataFrame, words: int, share: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs to confirm across labels, and the rows of the nodes that give them; what stands in large nodes is dealt by prefixes."""
    leaves = [_several(nodes, label, False)]
    large = leaves[0].where("NOT small").select(F.col("doc").alias("id")).distinct()
    ids = materialize(gathered(large, leaves[0].count()), "ids")
    n = ids.count()
    if n:
        texts = _chosen(docs, ids, n)
        dealt = materialize(_prefixes(texts, _frequent(texts, n, words), words, share), "nodes")
        leaves.append(_several(dealt, label, True))
        discard(dealt)
    discard(ids)
    found = []
    for rows in leaves:
        small = rows.where("small")
        found.append(materialize(_within(_members(small, small.count()), share, True), "pairs"))
    every = reduce(DataFrame.unionByName, found)
    pairs = materialize(gathered(_ordered(every), every.count()), "across")
    discard(*found)
    return pairs, leaves


def _chosen(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows of ``docs`` whose doc is one of the ``n`` in ``ids``."""
    return docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids.hint("shuffle_hash"), docs["doc"] == F.col("id"), "left_semi")


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc and its whole set, 40 sorted bits of each shingle."""
    schema = T.StructType([docs.schema[0], T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, chunk in chunks(batch.column(1)):
                values, off = _sets(chunk, words)
                cut = (values >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                own = [cut[5 * a : 5 * b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, chunk.n), pa.array(own, pa.binary())], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def _unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view(np.uint64).ravel()


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, share: int) -> DataFrame:
    """The pairs whose full sets are similar enough; ``docs`` has doc and text."""
    n = pairs.count()
    ids = materialize(gathered(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), 2 * n), "ids")
    full = materialize(_full_sets(_chosen(docs, ids, ids.count()), words), "shingles")
    rows = pairs.join(full.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b").join(full.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = _unpack(x.as_py()), _unpack(y.as_py())
                both = np.sort(np.concatenate([p, q]))
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= share * (len(both) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    # texts of one id may give a pair more than once
    out = materialize(gathered(rows.select("a", "b", "sa", "sb").mapInArrow(run, pairs.select("a", "b").schema).distinct(), n), "confirmed")
    discard(ids, full)
    return out


def _distinct_sets(every: DataFrame) -> DataFrame:
    """From described rows: doc, n, ``rep`` (the least document of an equal set, where there are several), and sig and sketch where the row stands for its set."""
    real = every.where("n > 0 AND doc IS NOT NULL")
    same = real.groupBy("h1", "h2", "n").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    same = materialize(same, "same")  # a table of its own, so that the join may split a hot set
    marked = every.join(same, ["h1", "h2", "n"], "left")
    stands = "doc IS NOT NULL AND n > 0 AND (rep IS NULL OR doc = rep)"
    out = marked.withColumn("first", F.expr(stands)).select("doc", "n", "h1", "h2", "rep", F.when(F.col("first"), F.col("sig")).alias("sig"), F.when(F.col("first"), F.col("sketch")).alias("sketch"))
    out = materialize(out, "marked")
    discard(same)
    return out


def links(table: DataFrame, docs: DataFrame, words: int, share: int) -> DataFrame:
    """(a, b), a < b: confirmed links that connect all documents, of unlike sets, that links connect."""
    sets = table.where("sig IS NOT NULL")
    once, more = sets.where("rep IS NULL"), sets.where("rep IS NOT NULL").dropDuplicates(["doc", "h1", "h2", "n"])
    sets = materialize(once.unionByName(more).select("doc", "sig", "sketch"), "sets")
    nodes = materialize(_nodes(sets, share), "nodes")
    shared = materialize(nodes.groupBy(F.col("key").alias("k")).agg(F.min("doc").alias("hub"), F.count("*").alias("size")).where("size > 1"), "shared")
    met = materialize(nodes.join(shared, F.col("key") == F.col("k")).select("key", "doc", "hub", "size"), "met")
    discard(nodes, shared)
    tested = materialize(_stars(met, sets, share), "stars")
    found = [_confirmed(tested, docs, words, share)]
    label = _labels(sets, found[0])
    pairs, leaves = _across(met, docs, label, words, share)
    discard(met)
    fresh = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "fresh")
    tested = materialize(tested.unionByName(fresh), "tested")
    found.append(_confirmed(fresh, docs, words, share))
    if found[1].count() < pairs.count():  # what the first step refuted counts too
        label = _labels(sets, found[0].unionByName(found[1]))
        again = _several(reduce(DataFrame.unionByName, leaves).where("small"), label, True)
        rest = materialize(_ordered(_within(_members(again, again.count()), share, False)).join(tested, ["a", "b"], "left_anti"), "rest")
        discard(again)
        if not rest.isEmpty():
            found.append(_confirmed(rest, docs, words, share))
    discard(*leaves, sets)
    return reduce(DataFrame.unionByName, found)


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: int = 80) -> DataFrame:
    """Each row's id, ``n_shingles``, ``component_id`` (the smallest id reachable by links) and ``kept`` (it is that one)."""
    docs = pick(df, id_col, text_col).toDF("doc", "text")
    every = materialize(_describe(docs, words), "described")
    table = _distinct_sets(every)
    discard(every)
    copies = table.where("doc > rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    root = components(links(table, docs, words, share).unionByName(copies)).toDF("node", "root")
    out = table.select("doc", "n").join(root, F.col("doc") == F.col("node"), "left")
    own = F.coalesce("root", "doc")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), (F.coalesce(own == F.col("doc"), F.lit(True))).alias("kept"))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df``'s columns as they are numbered, and ``key``: a number for each id and text, in the order of ids; null for null ids."""
    rows = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    rows = rows.withColumn("fp", F.xxhash64(f"_{df.columns.index(text_col)}"))
    own = F.col(f"_{df.columns.index(id_col)}")
    keys = rows.where(own.isNotNull()).select(own.alias("id"), F.col("fp").alias("of")).distinct().orderBy("id", "of")
    keys = materialize(keys.select("id", "of", F.monotonically_increasing_id().alias("key")), "keys")
    return rows.join(keys.hint("shuffle_hash"), (own == F.col("id")) & (F.col("fp") == F.col("of")), "left").drop("fp", "id", "of")


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: int = 80) -> DataFrame:
    """The rows of ``df``, with all their columns, without those whose component has a smaller id.

    Of rows that repeat an id with the same text one is left; with unlike texts
    each text is a document of its own here, and of linked ones of one id that of
    the least hash is left.
    """
    ids = pick(df, id_col).where(F.col(id_col).isNotNull())
    if ids.groupBy(id_col).count().where("count > 1").isEmpty():
        found = materialize(classes(df, id_col, text_col, words, share), "classes")
        rows = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
        own = f"_{df.columns.index(id_col)}"
        gone = found.where(~F.col("kept")).select(F.col(id_col).alias("gone"))
        return rows.join(gone.hint("shuffle_hash"), rows[own] == gone["gone"], "left_anti").toDF(*df.columns)
    rows = _keyed(df, id_col, text_col)
    found = materialize(classes(rows, "key", f"_{df.columns.index(text_col)}", words, share), "classes")
    gone = found.where(~F.col("kept")).select(F.col("key").alias("gone"))
    left = rows.join(gone.hint("shuffle_hash"), rows["key"] == gone["gone"], "left_anti")
    left = left.where("key IS NOT NULL").dropDuplicates(["key"]).unionByName(left.where("key IS NULL"))
    return left.drop("key").toDF(*df.columns)

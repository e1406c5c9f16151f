"""Document scores by masked pseudo-likelihood.

A small network sees the two tokens on each side of a masked one and predicts
it; a document's score is the sum over all its tokens of the logarithm of the
probability given to the token that stands there. The network is trained in
numpy: one hidden layer over the neighbours' vectors, and a softmax in two
levels, first over classes of ``WIDE`` tokens, then over the tokens of the class;
the neighbours decide at both.

Tokens are words, lower-case in A-Z. The ``WORDS`` most frequent ones are tokens
of their own, in classes by rank; any other goes to one of ``BUCKETS`` by its
shape (letters, digits, marks or letters beyond ASCII, and length) and its hash.
The probability of such a word is that of its bucket, by the network, times its
own among all words of the bucket, by its count over all documents. Each word
that occurs ``FLOOR`` times or more has its own count, so their table grows with
the corpus; rarer ones share the mass of their kind evenly, with one more for all
that the corpus does not hold, so over words the probabilities sum to one. What
is left out: the neighbours have no say in which word of a bucket it is, and rare
words of a bucket are alike.

Counting moves one row for each distinct word and task; for each word of the
table the driver gets 32 bytes and a scoring worker holds about 14. A word's
key is a hash of 59 bits with its shape in the rest; of ten million words two
are mistaken for each other with a chance of 1e-4.

All documents train the network, each once. A hash of id and text deals them to
rounds and, within a round, to shards of about ``SHARD_TOKENS`` tokens; copies
of a text are spread. In a round every shard goes through its documents, in the
order of their hash, by gradient descent (AdaGrad) from common weights; the mean
of the shards' weights, by tokens, starts the next round. Shards depend on the
rows alone and sums are made of whole numbers, so neither partitions nor lost
tasks change the model. A task adds up its shards' weights, and what meets of all
tasks is dealt by pieces of the weights: no task holds more than one model and a
batch of pieces.

Edge cases: a null or empty text has no tokens and a sum of 0, and no mean; a
word's neighbours beyond either end of its document are a token of their own;
long texts are read whole; repeated rows are scored one by one; an empty table
gives an untrained network and an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, Chunk, lookup, pick, prefix, runs, text_buffers

WORDS, HIDDEN, SIDE = 3072, 12, 2
#: Tokens of a class.
WIDE = 64
ROUNDS, RATE, BATCH = 3, 0.2, 8192
#: Tokens of a shard, about, and pieces that weights are added up in.
SHARD_TOKENS, PIECES = 700_000, 64
#: Weights are added up in units of 2**-20, tokens of a shard in thousands.
UNIT = 1 << 20
#: Words that occur so often have a count of their own.
FLOOR = 4
#: Tokens scored together, and words counted together at least.
STEP, COUNT_WORDS = 16_384, 2_000_000
#: Kinds of shape times lengths (1 to 7, 8 and more), and of these times parts of the hash.
SHAPES, BUCKETS = 4 * 8, 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bits of a byte: 1 a digit, 2 a mark, 4 beyond ASCII; none a letter or a space.
_BITS = np.where(lookup("0123456789"), 1, np.where(np.arange(256) >= 128, 4, np.where(lookup("abcdefghijklmnopqrstuvwxyz"), 0, 2))).astype(np.uint8)
_BITS[list(SPACES)] = 0
#: Of the bits that a word's bytes have: 1 with a digit, else 2 with a mark, else 3 with one beyond ASCII.
_KIND = np.array([0, 1, 2, 1, 3, 1, 2, 1])


def _lowered(column: pa.Array) -> Iterator[tuple[slice, Chunk]]:
    return runs(*text_buffers(column), table=_LOWER)


def _keys(chunk: Chunk) -> np.ndarray:
    """Of each word: its hash, with its shape in the low bits; the lowest ten tell its bucket."""
    length = chunk.ends - chunk.starts
    # nothing but spaces stands between a word and the next
    kind = _KIND[np.bitwise_or.reduceat(_BITS[chunk.data], chunk.starts)] if len(length) else length
    shape = 8 * kind + np.minimum(length, 8) - 1
    return chunk.word_hash() & ~np.uint64(SHAPES - 1) | shape.astype(np.uint64)


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass(frozen=True)
class Vocabulary:
    """Keys of the frequent words by rank, and how many tokens the corpus has. Ids: 0 beyond the ends, then buckets, then words."""

    ranked: np.ndarray
    tokens: int = 0

    def __post_init__(self) -> None:
        order = np.argsort(self.ranked)
        object.__setattr__(self, "hashes", self.ranked[order])
        object.__setattr__(self, "rank", order)

    @property
    def size(self) -> int:
        """Ids but for that beyond the ends."""
        return BUCKETS + len(self.hashes)

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return 1 + _bucket(keys)
        at = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
        return 1 + np.where(self.hashes[at] == keys, BUCKETS + self.rank[at], _bucket(keys))

    def ids(self, chunk: Chunk) -> np.ndarray:
        return self.of(_keys(chunk))


@dataclass(frozen=True)
class Lexicon:
    """Log probabilities of words among those of their bucket: ``logs`` of the keys ``hashes``, ascending, and ``rare`` by bucket."""

    hashes: np.ndarray
    logs: np.ndarray
    rare: np.ndarray

    def finder(self) -> Callable[[np.ndarray], np.ndarray]:
        """Looks keys up, from where those of the same first bits begin."""
        n, shift = len(self.hashes), np.uint64(64 - max(1, len(self.hashes).bit_length()))
        first = (prefix(np.bincount((self.hashes >> shift).astype(np.int64), minlength=1 << (64 - int(shift))))[:-1]).astype(np.int32)

        def find(keys: np.ndarray) -> np.ndarray:
            out, left, at = self.rare[_bucket(keys)], np.arange(len(keys)), first[(keys >> shift).astype(np.int64)]
            while len(left):
                left, at = left[at < n], at[at < n]
                held, sought = self.hashes[at], keys[left]
                same, on = held == sought, held < sought
                out[left[same]] = self.logs[at[same]]
                left, at = left[on], at[on] + 1
            return out

        return find


def _counts(df: DataFrame, text_col: str) -> DataFrame:
    """Keys of all words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["word", "n"])

        for batch in batches:
            for _, chunk in _lowered(batch.column(0)):
                held.append(_keys(chunk))
                size += len(held[-1])
                if size >= COUNT_WORDS:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return pick(df, text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(df: DataFrame, text_col: str = "text", words: int = WORDS) -> Vocabulary:
    """The most frequent words of all documents; ties by key."""
    return lexicon(df, text_col, words, 1)[0]


def lexicon(df: DataFrame, text_col: str = "text", words: int = WORDS, floor: int = FLOOR) -> tuple[Vocabulary, Lexicon]:
    """The most frequent words, of those that reach ``floor``, and all words' log probabilities within their buckets."""
    own = F.when(F.col("n") >= floor, F.col("word"))
    rows = _counts(df, text_col).groupBy(own.alias("word"), F.col("word").bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()
    named = rows.filter(pc.is_valid(rows["word"]))
    rest = rows.filter(pc.is_null(rows["word"]))
    word, n = named["word"].to_numpy(), named["n"].to_numpy()
    order = np.lexsort((word, -n))
    top, other = order[:words], order[words:]
    keys, count = word.view(np.uint64)[other], n[other].astype(float)
    rare_n, rare_words = np.ones(BUCKETS), np.ones(BUCKETS)  # one for what the corpus does not hold
    rare_n[rest["bucket"].to_numpy()] += rest["n"].to_numpy()
    rare_words[rest["bucket"].to_numpy()] += rest["words"].to_numpy()
    total = np.bincount(_bucket(keys), count, BUCKETS) + rare_n
    at = np.argsort(keys)
    logs = np.log(count / total[_bucket(keys)])[at].astype(np.float32)
    tokens = int(n.sum()) + int((pc.sum(rest["n"]).as_py() or 0))
    return Vocabulary(word.view(np.uint64)[top], tokens), Lexicon(keys[at], logs, np.log(rare_n / rare_words / total).astype(np.float32))


#: Values whose exponentials, and the sums of these, floats hold without a shift.
TAME = 60


def _tame(weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Whether no hidden values, of -1 to 1, give values beyond ``TAME``; by class, if there are several."""
    return (np.abs(weight).sum(-2) + np.abs(bias)).max(-1, initial=0) <= TAME


def _exps(z: np.ndarray) -> np.ndarray:
    """exp of ``z`` in its place; returns the sums of its rows."""
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype)


class Network:
    """Predicts a token, of ``vocab`` ids from 1, from ``SIDE`` tokens on each side."""

    def __init__(self, vocab: int, flat: np.ndarray | None = None) -> None:
        self.vocab, self.classes = vocab, -(-vocab // WIDE)
        shapes = [(2 * SIDE, 1 + vocab, HIDDEN), (HIDDEN, self.classes), (self.classes, HIDDEN, WIDE), (self.classes,), (self.classes, WIDE)]
        sizes = [int(np.prod(s)) for s in shapes]
        if flat is None:
            flat = np.zeros(sum(sizes))
            flat[: sum(sizes[:3])] = np.random.default_rng(11).standard_normal(sum(sizes[:3])) * 0.1
        self.flat = flat.astype(np.float32)
        parts = np.split(self.flat, np.cumsum(sizes)[:-1])
        self.near, self.top, self.out, self.top_bias, self.out_bias = (p.reshape(s) for p, s in zip(parts, shapes, strict=True))
        # places of the last class that are no token's
        self.absent = np.zeros((self.classes, WIDE), np.float32)
        self.absent.reshape(-1)[vocab:] = -np.inf
        self.seen = np.full(len(self.flat), 1e-6, np.float32)  # squares of gradients, for the steps
        self.near_seen, self.top_seen, self.out_seen, self.top_bias_seen, self.out_bias_seen = (p.reshape(s) for p, s in zip(np.split(self.seen, np.cumsum(sizes)[:-1]), shapes, strict=True))

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = self.near[0].take(around[:, 0], axis=0)
        for k in range(1, 2 * SIDE):
            h += self.near[k].take(around[:, k], axis=0)
        return np.tanh(h, out=h)

    def _by_class(self, token: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """An order of tokens by class, and each class with the places of its tokens in that order."""
        own = ((token - 1) // WIDE).astype(np.uint16 if self.classes <= 1 << 16 else np.int64)
        order = np.argsort(own, kind="stable")
        bounds = prefix(np.bincount(own, minlength=self.classes)).tolist()
        return order, [(k, slice(a, b)) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if a < b]

    def _top(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.top
        z += self.top_bias
        return z if _tame(self.top, self.top_bias) else z - z.max(1, keepdims=True)

    def _inner(self, h: np.ndarray, k: int, tame: bool) -> np.ndarray:
        z = h @ self.out[k]
        z += self.out_bias[k] + self.absent[k]
        return z if tame else z - z.max(1, keepdims=True)

    def log_prob(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Of each token, given those around it."""
        out, tame = np.empty(len(token)), _tame(self.out, self.out_bias)
        for a in range(0, len(token), STEP):
            order, parts = self._by_class(token[a : a + STEP])
            order += a
            h, own, at = self.hidden(around.take(order, axis=0)), (token[order] - 1) // WIDE, (token[order] - 1) % WIDE
            z, every = self._top(h), np.arange(len(own))
            log, sums = z[every, own], np.empty(len(own), np.float32)
            log -= np.log(_exps(z))
            for k, part in parts:
                z = self._inner(h[part], k, tame[k])
                log[part] += z[every[: len(z)], at[part]]
                sums[part] = _exps(z)
            out[order] = log - np.log(sums)
        return out

    @staticmethod
    def _step(weight: np.ndarray, seen: np.ndarray, grad: np.ndarray, at: np.ndarray | slice) -> None:
        squares = seen[at] + grad * grad
        seen[at] = squares
        weight[at] -= RATE * grad / np.sqrt(squares)

    def gradients(self, around: np.ndarray, token: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | slice]]:
        """(weights, their squares seen, gradient of minus the mean log probability, its rows) of all parts that a batch touches."""
        order, parts = self._by_class(token)
        around, token = around.take(order, axis=0), token[order] - 1
        n, h, at = len(token), self.hidden(around), token % WIDE
        scale, every, tame = np.float32(1 / n), np.arange(n), _tame(self.out, self.out_bias)
        z = self._top(h)
        z *= (scale / _exps(z))[:, None]
        z[every, token // WIDE] -= scale
        back = z @ self.top.T
        out, out_bias = np.zeros_like(self.out), np.zeros_like(self.out_bias)
        for k, part in parts:
            q = self._inner(h[part], k, tame[k])
            q *= (scale / _exps(q))[:, None]
            q[every[: len(q)], at[part]] -= scale
            back[part] += q @ self.out[k].T
            np.matmul(h[part].T, q, out=out[k])
            out_bias[k] = np.ones(len(q), np.float32) @ q
        yield self.out, self.out_seen, out, slice(None)
        yield self.out_bias, self.out_bias_seen, out_bias, slice(None)
        yield self.top, self.top_seen, h.T @ z, slice(None)
        yield self.top_bias, self.top_bias_seen, z.sum(0), slice(None)
        back *= 1 - h * h
        wide = self.near.shape[1]
        rows = (around + wide * np.arange(2 * SIDE)).T.ravel().astype(np.uint16 if 2 * SIDE * wide <= 1 << 16 else np.int64)
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        grad = np.add.reduceat(back.take(np.tile(every, 2 * SIDE)[order], axis=0), first, axis=0)
        yield self.near.reshape(-1, HIDDEN), self.near_seen.reshape(-1, HIDDEN), grad, rows[first].astype(np.int64)

    def train(self, around: np.ndarray, token: np.ndarray) -> None:
        """One pass in the given order."""
        for a in range(0, len(token), BATCH):
            for part in self.gradients(around[a : a + BATCH], token[a : a + BATCH]):
                self._step(*part)


def _around(chunk: Chunk, ids: np.ndarray) -> np.ndarray:
    """The ids around each word; 0 beyond its document."""
    doc, n = chunk.doc_of_word, len(ids)
    out = np.zeros((n, 2 * SIDE), np.int64)
    for k, step in enumerate([s for s in range(-SIDE, SIDE + 1) if s]):
        at = np.arange(max(0, -step), min(n, n - step))
        at = at[doc[at] == doc[at + step]]
        out[at, k] = ids[at + step]
    return out


def train_shard(texts: pa.Array, vocab: Vocabulary, start: np.ndarray) -> tuple[np.ndarray, int]:
    """Weights after one pass over the texts in their order, and how many tokens they hold."""
    net, seen = Network(vocab.size, start), 0
    for _, chunk in _lowered(texts):
        ids = vocab.ids(chunk)
        mixed = np.random.default_rng(len(ids)).permutation(len(ids))
        net.train(_around(chunk, ids)[mixed], ids[mixed])
        seen += len(ids)
    return net.flat, seen


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each piece: the sum of its rows."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(raw.as_py(), np.int64)
            sums[piece] = sums[piece] + own if piece in sums else own
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["piece", "sums"])


def shards(df: DataFrame, text_col: str, id_col: str, rounds: int, tokens: int, shard_tokens: int) -> DataFrame:
    """Documents with the ``turn`` and ``shard`` that a hash of id and text gives them, and that hash as ``mark``."""
    docs = pick(df, id_col, text_col).toDF("id", "text").where(F.length("text") > 0)
    n = max(1, -(-tokens // (rounds * shard_tokens)))
    mark = F.xxhash64("id", "text")
    return docs.select("text", mark.alias("mark"), F.pmod(mark, F.lit(rounds)).alias("turn"), F.pmod(F.xxhash64(mark, F.lit("shard")), F.lit(n)).alias("shard"))


def fit(df: DataFrame, vocab: Vocabulary, text_col: str = "text", rounds: int = ROUNDS, id_col: str = "doc_id", shard_tokens: int = SHARD_TOKENS) -> np.ndarray:
    """The network's weights after all rounds, among which all documents are parted."""
    dealt, weights = shards(df, text_col, id_col, rounds, vocab.tokens, shard_tokens), Network(vocab.size).flat.astype(np.float64)
    cuts = np.linspace(0, len(weights), PIECES + 1).astype(int)

    def trainer(start: np.ndarray) -> Callable[[pa.Table], pa.Table]:
        def each(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("mark", "ascending"), ("text", "ascending")])
            flat, n = train_shard(rows["text"], vocab, start)
            heavy = -(-n // 1000)
            whole = np.append(np.rint(flat.astype(np.float64) * UNIT).astype(np.int64) * heavy, heavy)
            pieces = [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)] + [whole[-1:]] if n else []
            return pa.table([pa.array(range(len(pieces)), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], ["piece", "sums"])

        return each

    for turn in range(rounds):
        trained = dealt.where(F.col("turn") == turn).groupBy("shard").applyInArrow(trainer(weights), "piece int, sums binary")
        added = trained.mapInArrow(_added, "piece int, sums binary").repartition(PIECES, "piece").mapInArrow(_added, "piece int, sums binary")
        sums = {r.piece: np.frombuffer(r.sums, np.int64) for r in added.collect()}  # one model in pieces
        if sums:
            weights = np.concatenate([sums[k] for k in range(PIECES)]) / (UNIT * sums[PIECES][0])
    return weights


def score(df: DataFrame, vocab: Vocabulary, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", words: Lexicon | None = None) -> DataFrame:
    """Each row's id, ``n_tokens``, ``log_prob`` (the sum) and ``mean_log_prob``.

    Without ``words`` it is the network's part alone, where buckets count as tokens.
    """
    docs = pick(df, id_col, text_col)
    schema = T.StructType([docs.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("mean_log_prob", T.DoubleType())])
    flat = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, find = Network(vocab.size, flat), words and words.finder()
        for batch in batches:
            for part, chunk in _lowered(batch.column(1)):
                keys = _keys(chunk)
                ids = vocab.of(keys)
                each = net.log_prob(_around(chunk, ids), ids)
                if find:
                    shaped = np.flatnonzero(ids <= BUCKETS)
                    each[shaped] += find(keys[shaped])
                total = np.bincount(chunk.doc_of_word, each, chunk.n).astype(np.float64)
                mean = total / np.maximum(chunk.n_words, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, chunk.n), pa.array(chunk.n_words), pa.array(total), pa.array(mean, mask=chunk.n_words == 0)], schema.fieldNames())

    return docs.mapInArrow(run, schema)

"""Cost-balanced packing of documents into training sequences.

A document costs ``linear * n + quadratic * n ** 2`` for its ``n`` tokens, an
estimate of the feed-forward and attention work when attention stays within
documents. Within a window of documents, runs of full capacity become sequences
of their own; what is left of each document is assigned in descending order to
the lowest-cost sequence with enough remaining capacity. As many sequences are
open as the tokens need, so a window pads less than one sequence; a document
that fits nowhere whole is cut over the lowest-cost sequences that have room.

Windows follow the order of the input within a partition and hold a bounded
number of tokens, so nothing is shuffled, memory does not grow with the input,
and a task that runs again after a loss gives the same pieces. A task forgets its
words when it ends, since its worker goes on to tasks of other stages.

Edge cases: a null or empty text is one piece that holds the end id only; texts
of any length are read whole; repeated rows are packed one by one; an empty
table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import gc
import os
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import pick, prefix, release, runs, text_buffers

#: Tokens of one packing window at least, unless the partition ends.
WINDOW_TOKENS = 1 << 21
#: Words whose ids a task remembers at most.
MEMO_WORDS = 600_000
#: Bytes of the words that stay when there are more: short words are the frequent ones.
MEMO_SHORT = 8
#: Bytes of one document that are split into words at a time.
SEGMENT_BYTES = 1 << 20
#: Bytes of text encoded together.
BATCH_BYTES = 1 << 20


def pack_lengths(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> np.ndarray:
    """Pieces (document, start, length, sequence, offset) of documents with the given token counts."""
    lengths = np.asarray(lengths, np.int64)
    full, rest = lengths // capacity, lengths % capacity
    whole = np.repeat(np.arange(len(lengths)), full)
    nth = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
    out = [np.stack([whole, nth * capacity, np.full_like(whole, capacity), np.arange(len(whole)), np.zeros_like(whole)], 1)]
    n = -(-int(rest.sum()) // capacity)
    room, cost = np.full(n, capacity, np.int64), np.zeros(n)
    left: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, size: int, to: int) -> None:
        left.append((doc, start, size, len(whole) + to, capacity - int(room[to])))
        room[to] -= size
        cost[to] += linear * size + quadratic * size * size

    for doc in np.lexsort((np.arange(len(rest)), -rest)):
        start, size = int(full[doc]) * capacity, int(rest[doc])
        if not size:
            break
        to = int(np.argmin(np.where(room >= size, cost, np.inf)))
        if room[to] >= size:
            put(int(doc), start, size, to)
            continue
        while size:
            to = int(np.argmin(np.where(room > 0, cost, np.inf)))
            part = min(size, int(room[to]))
            put(int(doc), start, part, to)
            start, size = start + part, size - part
    return np.concatenate([*out, np.array(left, np.int64).reshape(-1, 5)])


class _Loaded:
    """A vocabulary file and the words met so far."""

    #: How this tokenizer cuts lower-case text (a fixed value of its file).
    CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.parts = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.parts.normalizer = None  # what it is given is in lower case and cut already
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cut, self.words, self.known = regex.compile(self.CUT), {}, {}

    def parts_of(self, raw: bytes) -> list[str] | None:
        """The word's parts in lower case; None where only the whole tokenizer can say."""
        if raw.isalpha():  # true of ASCII letters only
            return [raw.lower().decode()]
        if raw[:-1].isalpha() and raw[-1] in b".,;:!?":
            low = raw.lower().decode()
            return [low[:-1], low[-1]]
        word = raw.decode()
        if not raw.isascii() and max(word) >= "\u0250":
            return None
        low = word.lower()
        if low.isalpha():
            return [low]
        if low[:-1].isalpha() and low[-1] in ".,;:!?":
            return [low[:-1], low[-1]]
        return self.cut.findall(low) if word.isprintable() and "<|" not in word else None

    def learn(self, new: list[bytes]) -> None:
        """Remember the ids of words not met before."""
        if len(self.known) > MEMO_WORDS:
            self.known = {p: ids for p, ids in self.known.items() if len(p) <= MEMO_SHORT}
        known, cuts = self.known, [*map(self.parts_of, new)]
        parts = list({p for cut in cuts if cut for p in cut}.difference(known))
        for a in range(0, len(parts), 1000):
            some = parts[a : a + 1000]
            found = self.parts.encode(" ".join(some), add_special_tokens=False)
            ids, of = np.array(found.ids, "<u4").tobytes(), np.array(found.word_ids)
            ends = (4 * np.searchsorted(of, np.arange(len(some)), "right")).tolist()
            known.update(zip(some, [ids[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True))
        others = [w for w, cut in zip(new, cuts, strict=True) if not cut]
        self.words.update(
            (w, known[cut[0]] if len(cut) == 1 else b"".join([known[p] for p in cut])) for w, cut in zip(new, cuts, strict=True) if cut
        )
        for w, e in zip(others, self.whole.encode_batch_fast([w.decode() for w in others], add_special_tokens=False), strict=True):
            self.words[w] = struct.pack(f"<{len(e)}I", *e.ids)


#: By vocabulary file; a Python worker keeps them from task to task, without the words.
_loaded: dict[str, _Loaded] = {}


class WordEncoder:
    """Token ids by a public tokenizer whose words never join over white space.

    The ids of a text are those of its words one after another, so each distinct
    word is encoded once and remembered. Printable words below U+0250, where
    case and character classes are settled, are first cut as the tokenizer cuts
    them, so that a word and its form with a comma share the work.
    """

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _loaded:
            _loaded[path] = _Loaded(path)
        self.loaded = _loaded[path]
        self.end = np.array([end_id], "<u4").tobytes()

    def encode(self, raw: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Little-endian ids of each UTF-8 text ``raw[off[i]:off[i + 1]]``, the end id last."""
        if len(self.loaded.words) > MEMO_WORDS:
            self.loaded.words = {w: ids for w, ids in self.loaded.words.items() if len(w) <= MEMO_SHORT}
        if off[-1] - off[0] > 2 * SEGMENT_BYTES and len(off) == 2:
            return [b"".join(self._ids(np.ascontiguousarray(part))[0] for part in segments(raw[off[0] : off[1]])) + self.end]
        ids, at = self._ids(raw[off[0] : off[-1]], off - off[0])
        return [ids[4 * i : 4 * j] + self.end for i, j in zip(at[:-1], at[1:], strict=True)]

    def forget(self) -> None:
        """Keep none of the words met."""
        self.loaded.words, self.loaded.known = {}, {}

    def _ids(self, data: np.ndarray, off: np.ndarray | None = None) -> tuple[bytes, list[int]]:
        """Ids of all texts on end, and each one's place there. Each distinct word of them is looked up once."""
        off = np.array([0, len(data)]) if off is None else off
        parts = [(c.word_hash(), c.starts + off[s.start], c.ends + off[s.start], c.n_words) for s, c in runs(data, off)]
        word, starts, ends, n_words = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 4
        _, first, which = np.unique(word, return_index=True, return_inverse=True)
        text, starts, ends = data.tobytes(), starts[first].tolist(), ends[first].tolist()
        words = [text[a:b] for a, b in zip(starts, ends, strict=True)]
        found = [*map(self.loaded.words.get, words)]
        if new := [w for w, ids in zip(words, found, strict=True) if ids is None]:
            self.loaded.learn(new)
            found = [*map(self.loaded.words.__getitem__, words)]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        n = size[which]
        to = prefix(n)
        take = np.repeat((np.cumsum(size) - size)[which] - to[:-1], n) + np.arange(to[-1])
        return flat[take].tobytes(), to[prefix(n_words)].tolist()


def segments(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that end where white space does, of about ``SEGMENT_BYTES``."""
    blank, a = np.flatnonzero((data == 0x20) | (data == 0x0A)), 0
    while a < len(data):
        k = np.searchsorted(blank, a + SEGMENT_BYTES)
        b = int(blank[k]) + 1 if k < len(blank) else len(data)
        yield data[a:b]
        a = b


def pack(
    df: DataFrame,
    encoder: Callable[[], WordEncoder],
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
    window_tokens: int = WINDOW_TOKENS,
) -> DataFrame:
    """Pieces of all documents: id, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` and ``ids``.

    ``ids`` are the piece's token ids, little-endian unsigned 32-bit. A sequence
    is the pieces of one ``sequence_id`` by ``offset``. ``encoder`` is called
    once in each task.
    """
    docs = pick(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        gc.disable()  # words and ids hold no cycles; looking for some among them takes a third of the time
        try:
            yield from packed(batches, enc)
        finally:
            enc.forget()
            gc.enable()
            release()

    def packed(batches: Iterator[pa.RecordBatch], enc: WordEncoder) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        ids, held, tokens = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal first
            n = np.array([len(x) // 4 for x in held])
            p = pack_lengths(n, capacity, linear, quadratic)
            cut = [held[d][4 * s : 4 * (s + k)] for d, s, k in p[:, :3].tolist()]
            out = [pa.array(ids, id_type).take(pa.array(p[:, 0])), p[:, 1], p[:, 2], n[p[:, 0]], first + p[:, 3], p[:, 4], pa.array(cut, pa.binary())]
            first += int(p[:, 3].max()) + 1
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            raw, off = text_buffers(batch.column(1))
            keys, a = batch.column(0).to_pylist(), 0
            while a < len(keys):
                b = max(a + 1, int(np.searchsorted(off, off[a] + BATCH_BYTES, "right")) - 1)
                new = enc.encode(raw, off[a : min(b, len(keys)) + 1])
                ids += keys[a:b]
                held += new
                tokens += sum(map(len, new)) // 4
                a = b
                if tokens >= window_tokens:
                    yield flush()
                    ids, held, tokens = [], [], 0
                    release()
        if held:
            yield flush()

    names = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = T.StructType([docs.schema[0], *(T.StructField(n, T.LongType()) for n in names[1:-1]), T.StructField("ids", T.BinaryType())])
    return docs.mapInArrow(run, schema)

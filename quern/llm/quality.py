"""Quality rules as a short-circuit cascade.

Each rule is a test on counts of one document. On a bounded sample the cost of
each rule and the share of documents it rejects are estimated; rules then run in
the order of rejection per cost, and a document that one rule rejects is not
shown to the rules after it. The verdict does not depend on the order; only the
work does, and the name of the first rule that failed.

A cost is the number of array elements that a rule's counts pass over, by the
bytes and words of the sample (``STEPS``), not a clock's, and the sample is drawn
by a hash of the rows, so the order is the same in every run.

Edge cases: a null or empty text has no words and fails ``words``; repeated rows
are judged one by one; an empty table gives an empty table; further columns are
ignored by :func:`judge` and kept by :func:`keep`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Chunk, chunks, lookup, mix, pick, prefix

#: Documents, drawn by a hash, on which cost and selectivity of the rules are estimated.
SAMPLE_ROWS = 512

_SYMBOL = lookup("#*$%&|<>")
_UPPER = lookup("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | lookup("abcdefghijklmnopqrstuvwxyz")
_DIGIT = lookup("0123456789")


class Counts:
    """Counts by document of one chunk, each made when first asked for."""

    def __init__(self, chunk: Chunk) -> None:
        self.chunk, self.made = chunk, {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.made:
            self.made[name] = COUNTS[name](self.chunk)
        return self.made[name]


def _word_chars(c: Chunk) -> np.ndarray:
    return c.per_doc(c.solid & ((c.data & 0xC0) != 0x80))


def _lines(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of the lines that hold a word."""
    cut = np.flatnonzero(c.data == 0x0A)
    starts = np.sort(np.concatenate([c.off[:-1], cut + 1]), kind="stable")
    doc_of_cut = np.searchsorted(c.off, cut, "right") - 1
    n = np.bincount(doc_of_cut, minlength=c.n) + 1 if c.n else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(c.n), n)
    ends = np.sort(np.concatenate([c.off[1:], cut]), kind="stable")
    solid = prefix(c.solid)
    held = solid[ends] > solid[starts]
    return starts[held], ends[held], doc[held]


def _n_lines(c: Chunk) -> np.ndarray:
    return np.bincount(_lines(c)[2], minlength=c.n)


def _n_dup_lines(c: Chunk) -> np.ndarray:
    starts, ends, doc = _lines(c)
    keys = mix(c.span_hash(starts, ends) ^ mix(doc + 1))
    _, first = np.unique(keys, return_index=True)
    return np.bincount(doc, minlength=c.n) - np.bincount(doc[first], minlength=c.n)


def _n_repeat_words(c: Chunk) -> np.ndarray:
    window, at = c.window_hash(c.word_hash(), 3)
    if not len(at):
        return np.zeros(c.n, np.int64)
    keys = window ^ mix(c.doc_of_word[at] + 1)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    covered = np.zeros(len(c.starts), bool)
    for k in range(3):
        covered[at[again] + k] = True
    return np.diff(prefix(covered)[c.words])


#: What a rule may test, by name.
COUNTS: dict[str, Callable[[Chunk], np.ndarray]] = {
    "n_words": lambda c: c.n_words,
    "word_chars": _word_chars,
    "n_symbols": lambda c: c.per_doc(_SYMBOL[c.data]),
    "n_lines": _n_lines,
    "n_dup_lines": _n_dup_lines,
    "n_repeat_words": _n_repeat_words,
    "n_letters": lambda c: c.per_doc(_LETTER[c.data]),
    "n_upper": lambda c: c.per_doc(_UPPER[c.data]),
    "n_digits": lambda c: c.per_doc(_DIGIT[c.data]),
}


#: Array elements that a count passes over, for each byte and for each word; sorting counts tenfold.
STEPS: dict[str, tuple[float, float]] = {
    "n_words": (0, 1), "word_chars": (4, 0), "n_symbols": (2, 0), "n_lines": (5, 0), "n_dup_lines": (8, 0), "n_repeat_words": (4, 30), "n_letters": (2, 0), "n_upper": (2, 0), "n_digits": (2, 0),
}


class _Told(Counts):
    """Counts that remember which of them were asked for."""

    def __init__(self, chunk: Chunk) -> None:
        super().__init__(chunk)
        self.asked: set[str] = set()

    def __getitem__(self, name: str) -> np.ndarray:
        self.asked.add(name)
        return super().__getitem__(name)

    def steps(self) -> float:
        a, b = (sum(STEPS[n][k] for n in self.asked) for k in (0, 1))
        return a * len(self.chunk.data) + b * len(self.chunk.starts) + self.chunk.n


@dataclass(frozen=True)
class Rule:
    """``passes`` maps counts to true for the documents to keep."""

    name: str
    passes: Callable[[Counts], np.ndarray]


#: At least 50 words, and at most half of them within 3-word windows that recur in the text.
BASE = (
    Rule("words", lambda c: c["n_words"] >= 50),
    Rule("repeats", lambda c: 100 * c["n_repeat_words"] <= 50 * c["n_words"]),
)
#: Base rules and those against symbol runs, shouting, odd word lengths, repeated lines and digit tables.
RULES = BASE + (
    Rule("symbols", lambda c: 10 * c["n_symbols"] <= c["n_words"]),
    Rule("shouting", lambda c: 10 * c["n_upper"] <= 3 * c["n_letters"]),
    Rule("word_length", lambda c: (2 * c["n_words"] <= c["word_chars"]) & (c["word_chars"] <= 40 * c["n_words"])),
    Rule("lines", lambda c: 100 * c["n_dup_lines"] <= 50 * c["n_lines"]),
    Rule("digits", lambda c: 2 * c["n_digits"] <= c["word_chars"]),
)


def ordered(texts: Sequence[str | None], rules: Sequence[Rule]) -> list[tuple[Rule, float, float]]:
    """Rules with steps and rejected share on ``texts``, by descending rejection per step; ties by name."""
    column, out = pa.array(texts, pa.large_string()), []
    for rule in rules:
        spent = rejected = 0.0
        for _, chunk in chunks(column):
            counts = _Told(chunk)
            rejected += int((~rule.passes(counts)).sum())
            spent += counts.steps()
        out.append((rule, spent, rejected / max(1, len(texts))))
    return sorted(out, key=lambda x: (-x[2] / max(x[1], 1e-9), x[0].name))


def _subset(chunk: Chunk, at: np.ndarray) -> Chunk:
    length = np.diff(chunk.off)[at]
    off = np.concatenate([[0], np.cumsum(length)])
    take = np.repeat(chunk.off[at] - off[:-1], length) + np.arange(off[-1])
    return Chunk(chunk.data[take], off)


class _Some(Counts):
    """The counts of some of another's documents."""

    def __init__(self, of: Counts, at: np.ndarray) -> None:
        self.of, self.at = of, at

    def __getitem__(self, name: str) -> np.ndarray:
        return self.of[name][self.at]


def cascade(chunk: Chunk, rules: Sequence[Rule], counts: Counts | None = None) -> np.ndarray:
    """The index of the first rule that rejects each document, -1 where none does."""
    failed, counts = np.full(chunk.n, -1), counts or Counts(chunk)
    at = own = np.arange(chunk.n)  # the survivors, in the chunk and in what ``counts`` covers
    for k, rule in enumerate(rules):
        good = rule.passes(_Some(counts, own))
        failed[at[~good]] = k
        at, own = at[good], own[good]
        if not len(at):
            break
        if len(own) < 0.8 * counts.chunk.n:  # the rules that follow scan the survivors' bytes only
            counts, own = Counts(_subset(counts.chunk, own)), np.arange(len(own))
    return failed


def plan_rules(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The cascade's order, estimated on at most ``sample_rows`` documents."""
    rows, n = df.toDF(*[f"_{i}" for i in range(len(df.columns))]), df.count()
    kinds = (T.StringType, T.NumericType, T.DateType, T.TimestampType, T.BooleanType)
    mark = F.xxhash64(*[f.name for f in rows.schema if isinstance(f.dataType, kinds)])
    some = 4 * sample_rows * (1 << 40) // max(n, 1)  # about four times as many as are wanted, so that few are sorted
    drawn = rows.select(F.col(f"_{df.columns.index(text_col)}").alias("text"), mark.alias("mark"))
    drawn = drawn if some >= 1 << 40 else drawn.where(F.pmod("mark", F.lit(1 << 40)) < some)
    texts = [r[0] for r in drawn.orderBy("mark", "text").limit(sample_rows).select("text").collect()]
    return [rule for rule, _, _ in ordered(texts, rules)]


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, report: Sequence[str] = (), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: its id, the counts named in ``report``, ``kept`` and ``failed_rule`` (null if kept)."""
    docs, chain = pick(df, id_col, text_col), plan_rules(df, text_col, rules, sample_rows)
    report = tuple(report)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([r.name for r in chain] + [None], object)
        for batch in batches:
            ids = batch.column(0)
            for part, chunk in chunks(batch.column(1)):
                counts = Counts(chunk)
                told = [pa.array(counts[n].astype(np.int64)) for n in report]
                failed = cascade(chunk, chain, counts)
                yield pa.RecordBatch.from_arrays(
                    [ids[part.start : part.stop], *told, pa.array(failed < 0), pa.array(names[failed], pa.string())],
                    [id_col, *report, "kept", "failed_rule"],
                )

    schema = T.StructType([docs.schema[0], *(T.StructField(n, T.LongType()) for n in report), T.StructField("kept", T.BooleanType()), T.StructField("failed_rule", T.StringType())])
    return docs.mapInArrow(run, schema)


def keep(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``df``, with all their columns, that every rule passes."""
    chain, at = plan_rules(df, text_col, rules, sample_rows), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [cascade(chunk, chain) < 0 for _, chunk in chunks(batch.column(at))]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    held = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return held.mapInArrow(run, held.schema).toDF(*df.columns)

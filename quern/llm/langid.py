"""Language identification by rank-order profiles of character n-grams.

A language's profile is its ``PROFILE`` most frequent n-grams (one to three
letters, word ends as a space) over all its labelled texts, most frequent first.
A document's own list is made alike, and the language with the least sum of
out-of-place distances wins: for each n-gram of the document, the difference of
its two ranks, or ``PROFILE`` where the language lacks it.

Texts of a task are counted together, so what is shuffled is one row for each
n-gram, language and task; profiles, ``PROFILE`` rows for each language, are all
that comes to the driver.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, as is
any where no language was learned; rows without a language teach nothing; equal
distances go to the language that sorts first, equal counts to the smaller
n-gram; long texts are read whole; repeated rows are judged one by one and teach
each time; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick

PROFILE = 300
#: Characters that are counted together when learning, at least.
LEARN_CHARS = 1 << 20

_RUNS = re.compile(r"[^\W\d_]+")
_SPACE = 0x20


def letters(text: str | None) -> str:
    """Runs of letters in lower case, each between spaces; empty if there are none."""
    if not text:
        return ""
    runs = _RUNS.findall(text.lower())
    if not text.isascii():
        runs = [r if r.isalpha() else "".join(c for c in r if c.isalpha()) for r in runs]
        runs = [r for r in runs if r]
    return f" {' '.join(runs)} " if runs else ""


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of one to three characters, ascending, and their counts; none has a space within or is one."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    used = np.flatnonzero(np.bincount(code))
    n = len(used)
    place = np.zeros(used[-1] + 1, np.int64)
    place[used] = np.arange(n)
    a = place[code]
    space = place[_SPACE]
    solid = a != space
    one = np.bincount(a, minlength=n)
    one[space] = 0
    pair = a[:-1] * n + a[1:]
    triple = (pair[:-1] * n + a[2:])[solid[1:-1]]
    out = [(used[at := np.flatnonzero(one)], one[at])]
    for grams, decode in ((pair, lambda g: used[g // n] << 21 | used[g % n]), (triple, lambda g: used[g // (n * n)] << 42 | used[g // n % n] << 21 | used[g % n])):
        if n**3 <= 1 << 20:
            count = np.bincount(grams)
            at = np.flatnonzero(count)
            count = count[at]
        else:
            at, count = np.unique(grams, return_counts=True)
        out.append((decode(at), count))
    codes, counts = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(codes)
    return codes[order], counts[order]


def ranked(text: str) -> np.ndarray:
    """The most frequent n-grams of a text, at most ``PROFILE``."""
    codes, counts = gram_counts(text)
    return codes[np.argsort(-counts, kind="stable")[:PROFILE]]


@dataclass(frozen=True)
class Profiles:
    """Languages, all n-grams of their profiles, and the rank of each in each profile (``PROFILE`` where absent)."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]]) -> Profiles:
        """From rows of language, n-gram and rank from 0."""
        langs = sorted({r[0] for r in rows})
        grams = np.unique(np.array([r[1] for r in rows], np.int64))
        ranks = np.full((len(langs), len(grams)), PROFILE)
        for lang, gram, rank in rows:
            ranks[langs.index(lang), np.searchsorted(grams, gram)] = rank
        return cls(langs, grams, ranks)

    def closest(self, text: str) -> tuple[str, float]:
        """The language of a text made by :func:`letters`, and one minus its distance as a share of the greatest."""
        if not text or not self.langs:
            return "und", 0.0
        own = ranked(text)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        there = np.where(self.grams[at] == own, self.ranks[:, at], PROFILE)
        distance = np.where(there < PROFILE, np.abs(there - np.arange(len(own))), PROFILE).sum(1)
        best = int(np.argmin(distance))
        return self.langs[best], 1.0 - float(distance[best]) / (PROFILE * len(own))


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", where: Column | None = None) -> Profiles:
    """Profiles from all rows that have a language and meet ``where`` (over the columns of ``df``)."""
    rows = pick(df if where is None else df.where(where), text_col, lang_col).where(F.col(lang_col).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[str]] = {}

        def count(lang: str) -> None:
            texts = "".join(waiting.pop(lang))
            if not texts:
                return
            codes, counts = gram_counts(texts)
            if lang in totals:
                codes, at = np.unique(np.concatenate([codes, totals[lang][0]]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, totals[lang][1]])).astype(np.int64)
            totals[lang] = codes, counts

        size: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                made = letters(text.as_py())
                waiting.setdefault(lang, []).append(made)
                size[lang] = size.get(lang, 0) + len(made)
                if size[lang] >= LEARN_CHARS:
                    count(lang)
                    size[lang] = 0
        for lang in list(waiting):
            count(lang)
        for lang, (codes, counts) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"])

    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return Profiles.of([tuple(r) for r in counts.withColumn("rank", best).where(F.col("rank") <= PROFILE).select("lang", "gram", F.col("rank") - 1).collect()])


def predict(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, ``lang_pred`` and ``score``."""
    docs = pick(df, id_col, text_col)
    schema = T.StructType([docs.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.closest(letters(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema.fieldNames())

    return docs.mapInArrow(run, schema)

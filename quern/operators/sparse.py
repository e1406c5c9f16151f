"""Lexical retrieval: BM25 over tables of postings, one index for each language.

An index is three tables: weighted postings, which a query only joins and sums;
document lengths; statistics. Terms of all queries are joined with the postings
at once, so a batch costs one shuffle by term and one by query.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import detect_script, tokenize, tokenize_legacy
from ..storage import materialize
from .ranking import by_score, top_k

K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass(frozen=True)
class Index:
    """``postings``: lang, term, chunk_id, tf, weight; ``lengths``: lang, chunk_id, dl; ``stats``: lang, n, avgdl, mean_idf; ``terms``: lang, term, df, idf."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    terms: DataFrame


def build_index(chunks: DataFrame, variant: str = "lucene", text: str = "text", k1: float = K1, b: float = B, epsilon: float = EPSILON, staged: bool = False) -> Index:
    """From chunks (chunk_id, lang, text). ``lucene``: idf never negative; ``okapi``: negative ones become a share of the mean.

    ``staged`` writes term counts and lengths first, so that texts are read twice
    and not for each of the index's tables.
    """
    stage = materialize if staged else lambda df, _: df
    words = (tokenize_legacy if variant == "okapi" else tokenize)(text)
    each = chunks.select("lang", "chunk_id", words.alias("words"))
    lengths = stage(each.select("lang", "chunk_id", F.size("words").cast("long").alias("dl")), "lengths")
    stats = lengths.groupBy("lang").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = each.select("lang", "chunk_id", F.explode("words").alias("term")).groupBy("lang", "chunk_id", "term").agg(F.count("*").alias("tf"))
    tf = stage(tf, "counts")
    terms = tf.groupBy("lang", "term").agg(F.count("*").alias("df")).join(stats, "lang")
    if variant == "okapi":
        raw = terms.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.groupBy("lang").agg(F.avg("raw").alias("mean_idf"))
        terms = raw.join(mean, "lang").withColumn("idf", F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw")))
        stats = stats.join(mean, "lang")
    else:
        terms = terms.withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    terms = terms.select("lang", "term", "df", "idf")
    scale = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    weight = F.col("idf") * F.col("tf") * ((k1 + 1) if variant == "okapi" else 1) / scale
    postings = tf.join(lengths, ["lang", "chunk_id"]).join(stats.select("lang", "avgdl"), "lang").join(terms, ["lang", "term"])
    return Index(postings.select("lang", "term", "chunk_id", "tf", weight.alias("weight")), lengths, stats, terms)


def route_languages(text: Column | str, languages: list[tuple[str, str]], pinned: Column | None = None) -> Column:
    """Language codes to search: the pinned one (``xx-YY``) if served, else those written in the text's script, else all."""
    script = detect_script(text)
    all_codes = F.array(*[F.lit(code) for code, _ in languages])
    own = reduce(lambda other, s: F.when(script == s, F.array(*[F.lit(c) for c, written in languages if written == s])).otherwise(other), sorted({s for _, s in languages}), all_codes)
    if pinned is None:
        return own
    code = F.lower(F.substring_index(pinned, "-", 1))
    return F.when(F.array_contains(all_codes, code), F.array(code)).otherwise(own)


def search(index: Index, queries: DataFrame, k: int, variant: str = "lucene", per_language: bool = False, only: DataFrame | None = None, overfetch: int = 0) -> DataFrame:
    """Hits (qid, rank, chunk_id, lang, score) of queries (qid, text, and ``langs`` to restrict them); repeated query words count each time.

    ``per_language`` ranks within each language; else all of a query's hits are one list.
    ``only`` (chunk_id) are the candidates; with ``overfetch`` it filters the best
    ``overfetch * k`` afterwards, which may leave fewer than ``k``.
    """
    words = (tokenize_legacy if variant == "okapi" else tokenize)("text")
    restrict = "langs" in queries.columns
    asked = queries.select("qid", F.explode(words).alias("term"), *(["langs"] if restrict else []))
    asked = asked.groupBy("qid", "term", *(["langs"] if restrict else [])).agg(F.count("*").alias("times"))
    found = asked.join(index.postings.select("lang", "term", "chunk_id", "weight"), "term")
    if restrict:
        found = found.where(F.array_contains("langs", F.col("lang")))
    scores = found.groupBy("qid", "lang", "chunk_id").agg(F.round(F.sum(F.col("times") * F.col("weight")), 6).alias("score")).where("score > 0")
    by, order = ["qid", "lang"] if per_language else ["qid"], by_score("score", "chunk_id")
    if only is not None and overfetch:
        scores = top_k(scores, overfetch * k, by, order).drop("rank")
    return top_k(scores if only is None else scores.join(only.select("chunk_id").distinct(), "chunk_id", "left_semi"), k, by, order)

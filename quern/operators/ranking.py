"""Top-k, merging and sampling of ranked rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, by: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank from 1; Spark limits groups before it shuffles them."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def by_score(score: str = "score", *ties: str) -> list[Column]:
    return [F.desc(score), *[F.asc(t) for t in ties]]


def merge_ranked(hits: DataFrame, k: int, score: str = "score") -> DataFrame:
    """One list for each query from lists by language, ranked anew by score."""
    return top_k(hits.drop("rank"), k, ["qid"], by_score(score, "chunk_id"))


def cap_per_document(hits: DataFrame, cap: int, order: Sequence[Column], document: str = "document_id") -> DataFrame:
    """At most ``cap`` rows of a query's document, those that come first; no cap if it is not positive, nor on rows without a document."""
    if cap <= 0:
        return hits
    nth = F.row_number().over(Window.partitionBy("qid", document).orderBy(*order))
    return hits.withColumn("_nth", nth).where((F.col("_nth") <= cap) | F.col(document).isNull()).drop("_nth")


def first_per_document(hits: DataFrame, document: str = "document_id") -> DataFrame:
    """Documents in the order of their first chunk, with a rank among documents."""
    best = hits.groupBy("qid", document).agg(F.min("rank").alias("chunk_rank"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("chunk_rank")))


def seeded_order(key: Column, seed: int) -> Column:
    """A fixed pseudo-random order of keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 12345) -> DataFrame:
    """``n`` rows in a fixed pseudo-random order of the key."""
    return df.orderBy(seeded_order(F.col(key), seed), key).limit(n)


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, seed: int = 12345) -> DataFrame:
    """About ``n`` rows, each stratum in proportion (rounded down), what is left from the largest; all rows if ``n`` is not less."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    everything = Window.partitionBy()
    share = counts.withColumn("_total", F.sum("_size").over(everything)).withColumn("_quota", F.floor(F.col("_size") * n / F.col("_total")).cast("long"))
    largest = F.row_number().over(everything.orderBy(F.desc("_size"), stratum)) == 1
    rest = F.lit(n) - F.sum("_quota").over(everything)
    quota = F.least(F.col("_quota") + F.when(largest, rest).otherwise(0), F.col("_size"))
    share = share.select(F.col(stratum).alias("_stratum"), F.when(F.col("_total") <= n, F.col("_size")).otherwise(quota).alias("_quota"))
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy(seeded_order(F.col(key), seed), key))
    return df.withColumn("_nth", nth).join(share, F.col(stratum) == F.col("_stratum")).where(F.col("_nth") <= F.col("_quota")).drop("_nth", "_stratum", "_quota")


def evenly_spaced(df: DataFrame, index: str, n: int) -> DataFrame:
    """``n`` rows at equal steps of an index that runs from 0, the first and the last among them; all if there are no more."""
    total = df.count()
    steps = sorted({i * (total - 1) // max(1, n - 1) for i in range(min(n, total))})
    return df.where(F.col(index).isin(steps)) if n < total else df


def is_contiguous(df: DataFrame, index: str) -> DataFrame:
    """One row: whether the index runs from 0 without gaps or repeats."""
    return df.agg(((F.min(index) == 0) & (F.max(index) == F.count("*") - 1) & (F.countDistinct(index) == F.count("*"))).alias("contiguous"))

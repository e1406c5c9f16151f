"""Retrieval quality, sweeps and latency over whole batches in one plan each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fusion import rrf
from .ranking import first_per_document

KS = (1, 3, 5, 10)
#: Stages of a request, in order.
STAGES = ("encode_ms", "dense_ms", "sparse_ms", "fuse_ms", "hydrate_ms", "guard_ms", "extractive_ms", "generation_ms")


def relevant_documents(passages: DataFrame, query: str = "query_id", document: str = "document_id") -> DataFrame:
    """(qid, document_id) of documents labelled as answering a query."""
    return passages.where("is_selected = 1").select(F.col(query).alias("qid"), F.col(document).alias("document_id")).distinct()


def holding(documents: DataFrame, items: DataFrame, lead: int = 6, document: str = "doc_id") -> DataFrame:
    """(qid, document_id) of documents that contain an item's text.

    An item's second to last-but-one words, ``lead`` of them, must stand in the
    document whole; their hash is joined with those of the document's windows that
    some item has, and ``contains`` decides. Items of fewer words meet all documents.
    """
    words = lambda c: F.split(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+")
    asked = items.where(F.length("text") > 0).select("qid", F.col("text").alias("_t"), words(F.col("text")).alias("_w"))
    long, short = asked.where(F.size("_w") >= lead + 2), asked.where(F.size("_w") < lead + 2)
    keyed = long.select("qid", "_t", F.xxhash64(F.array_join(F.slice("_w", 2, lead), " ")).alias("_h"))
    docs = documents.select(F.col(document).alias("document_id"), F.col("text").alias("_text"))
    windows = F.transform(F.sequence(F.lit(1), F.size("_w") - (lead - 1)), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, F.lit(lead)), " ")))
    each = docs.withColumn("_w", words(F.col("_text"))).where(F.size("_w") >= lead).select("document_id", F.explode(F.array_distinct(windows)).alias("_h"))
    likely = each.join(keyed, "_h").select("document_id", "qid", "_t")
    found = likely.join(docs, "document_id").where(F.contains("_text", "_t")).select("qid", "document_id")
    rest = docs.join(short, F.contains("_text", "_t")).select("qid", "document_id")
    return found.unionByName(rest).distinct()


def evaluated_queries(queries: DataFrame, qrels: DataFrame, text: str = "text") -> DataFrame:
    """Queries with a text and at least one relevant document."""
    return queries.where(F.coalesce(F.trim(text), F.lit("")) != "").join(qrels.select("qid").distinct(), "qid", "left_semi")


def document_recall(hits: DataFrame, qrels: DataFrame, queries: DataFrame, ks: Sequence[int] = KS, by: Sequence[str] = ()) -> DataFrame:
    """Share of queries with a relevant document among the first k documents (chunks of a document count once), for each group of hits."""
    ranked = first_per_document(hits) if not by else _first_by(hits, by)
    return _recall(ranked.join(qrels, ["qid", "document_id"]), queries, ks, by)


def _first_by(hits: DataFrame, by: Sequence[str]) -> DataFrame:
    best = hits.groupBy(*by, "qid", "document_id").agg(F.min("rank").alias("chunk_rank"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "qid").orderBy("chunk_rank")))


def chunk_recall(hits: DataFrame, qrels: DataFrame, queries: DataFrame, ks: Sequence[int] = (1, 5, 10), by: Sequence[str] = ()) -> DataFrame:
    """Share of queries with a relevant chunk among the first k chunks; qrels hold qid and chunk_id."""
    return _recall(hits.join(qrels, ["qid", "chunk_id"]), queries, ks, by)


def _recall(found: DataFrame, queries: DataFrame, ks: Sequence[int], by: Sequence[str]) -> DataFrame:
    """Means over all ``queries`` (qid), of which those without a relevant hit count 0."""
    best = found.groupBy(*by, "qid").agg(F.min("rank").alias("best"))
    n = queries.select("qid").distinct().agg(F.count("*").alias("n_queries"))
    sums = best.groupBy(*by).agg(*[F.sum((F.col("best") <= k).cast("long")).alias(f"hit{k}") for k in ks])
    share = lambda k: F.when(F.col("n_queries") > 0, F.round(F.coalesce(F.col(f"hit{k}"), F.lit(0)) / F.col("n_queries"), 4)).otherwise(0.0)
    joined = n.join(sums, how="left") if not by else sums.crossJoin(F.broadcast(n))  # one row
    return joined.select(*by, "n_queries", *[share(k).alias(f"recall_{k}") for k in ks])


def ablation(dense_hits: DataFrame, sparse_hits: DataFrame, qrels: DataFrame, queries: DataFrame, ks: Sequence[int] = KS, **fusion) -> DataFrame:
    """Recall by mode: dense, sparse and hybrid, over the same queries."""
    own = [h.select("qid", "rank", "document_id").withColumn("mode", F.lit(m)) for h, m in ((dense_hits, "dense"), (sparse_hits, "sparse"), (rrf(dense_hits, sparse_hits, **fusion), "hybrid"))]
    return document_recall(own[0].unionByName(own[1]).unionByName(own[2]), qrels, queries, ks, ["mode"])


def weight_sweep(dense_hits: DataFrame, sparse_hits: DataFrame, qrels: DataFrame, queries: DataFrame, weights: Sequence[tuple[float, float]], rrf_k: int = 60, ks: Sequence[int] = KS) -> DataFrame:
    """Recall by (dense_weight, sparse_weight): lists are made once and fused for all weights in one aggregation."""
    spark = dense_hits.sparkSession
    table = F.broadcast(spark.createDataFrame([(float(a), float(b)) for a, b in weights], "dense_weight double, sparse_weight double"))
    tagged = dense_hits.select("qid", "chunk_id", "document_id", "rank", F.lit(True).alias("is_dense")).unionByName(sparse_hits.select("qid", "chunk_id", "document_id", "rank", F.lit(False).alias("is_dense")))
    by = ["dense_weight", "sparse_weight"]
    each = tagged.crossJoin(table).withColumn("part", F.when(F.col("is_dense"), F.col("dense_weight")).otherwise(F.col("sparse_weight")) / (rrf_k + F.col("rank")))
    fused = each.groupBy(*by, "qid", "chunk_id").agg(F.round(F.sum("part"), 12).alias("score"), F.max("document_id").alias("document_id"), F.min(F.when(F.col("is_dense"), F.col("rank"))).alias("dense_rank"), F.min(F.when(~F.col("is_dense"), F.col("rank"))).alias("sparse_rank"))
    order = Window.partitionBy(*by, "qid").orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), "chunk_id")
    return document_recall(fused.withColumn("rank", F.row_number().over(order)), qrels, queries, ks, by)


def best_setting(results: DataFrame, label: Sequence[str], keys: Sequence[str] = ("recall_10", "recall_5", "recall_1")) -> DataFrame:
    """One row: the setting with the best key, compared in order; the least label among equals."""
    return results.orderBy(*[F.desc(k) for k in keys], *label).limit(1)


def percentiles(values: str, at: Sequence[float]) -> list[Column]:
    """Exact percentiles (linear), null without values."""
    found = F.percentile(values, F.array(*[F.lit(p / 100) for p in at]))
    return [F.round(found[i], 4).alias(f"p{p:g}") for i, p in enumerate(at)]


def latency(df: DataFrame, by: Sequence[str], ms: str = "ms", at: Sequence[float] = (50, 70)) -> DataFrame:
    """By group: n, percentiles, the true maximum as p100, and the mean."""
    return df.groupBy(*by).agg(F.count(ms).alias("n"), *percentiles(ms, at), F.round(F.max(ms), 4).alias("p100"), F.round(F.avg(ms), 4).alias("mean"))


def latency_rollup(df: DataFrame, stage: str, group: str, ms: str = "ms", at: Sequence[float] = (50, 70)) -> DataFrame:
    """By stage and group, and by stage over all groups (null), in one aggregation; pooled percentiles are made of all values."""
    return df.groupingSets([[F.col(stage), F.col(group)], [F.col(stage)]], F.col(stage), F.col(group)).agg(F.count(ms).alias("n"), *percentiles(ms, at), F.round(F.max(ms), 4).alias("p100"), F.round(F.avg(ms), 4).alias("mean"))


def budget_verdict(df: DataFrame, by: Sequence[str], budget: float, ms: str = "ms") -> DataFrame:
    """By group: mean, p50, p95, p99 and whether p95 keeps the budget."""
    out = df.groupBy(*by).agg(F.count(ms).alias("n"), F.round(F.avg(ms), 4).alias("mean"), *percentiles(ms, (50, 95, 99)))
    return out.withColumn("verdict", F.when(F.col("p95") <= budget, "PASS").otherwise("FAIL"))


def decision_tally(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.groupBy(reason).agg(F.count("*").alias("n"))


def provider_comparison(df: DataFrame, by: Sequence[str], first: str, total: str, script_ok: str) -> DataFrame:
    """By provider and language: median times to the first token and in all, and replies in the right script."""
    median = lambda c: F.round(F.percentile(c, F.lit(0.5)), 4)
    return df.groupBy(*by).agg(F.count("*").alias("n"), median(first).alias("first_p50"), median(total).alias("total_p50"), F.sum(F.col(script_ok).cast("long")).alias("script_ok"))


def retrieval_signals(hits: DataFrame) -> DataFrame:
    """By query: hits, best fused score, best cosine (0 if none is dense) and the margin of the first over the second (1 if alone)."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("rrf_score")))
    return hits.groupBy("qid").agg(
        F.count("*").alias("n_hits"), F.max("rrf_score").alias("best_rrf"), F.coalesce(F.max("dense_score"), F.lit(0.0)).alias("best_cosine"),
        F.when(F.count("*") < 2, 1.0).otherwise(F.round(at(1) - at(2), 6)).alias("score_margin"),
    )


def cross_lingual(hits: DataFrame, queries: DataFrame, documents: DataFrame, k: int = 10) -> DataFrame:
    """Recall at ``k`` for each ordered pair of languages: (source, target, n_queries, recall).

    ``hits`` are lists by language (qid, lang, rank, document_id); ``queries``
    have qid, source and group, ``documents`` document_id, lang and group: what
    answers a query in another language is in its group. Queries that have an
    answer in the target language count.
    """
    there = documents.select(F.col("lang").alias("target"), "group").distinct()
    asked = queries.join(there, "group").where("source <> target").select("qid", "source", "target", "group")
    own = documents.select("document_id", F.col("group").alias("g"))
    found = hits.where(F.col("rank") <= k).join(own, "document_id").select("qid", F.col("lang").alias("target"), F.col("g").alias("group"), F.lit(1).alias("hit")).distinct()
    rows = asked.join(found, ["qid", "target", "group"], "left").groupBy("source", "target", "qid").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return rows.groupBy("source", "target").agg(F.count("*").alias("n_queries"), F.round(F.avg("hit"), 4).alias("recall"))


def by_request(stages: DataFrame) -> DataFrame:
    """A row for each request (request, lang) with its stages' times; a stage that is missing took none. ``stages`` has request, lang, stage, ms."""
    return stages.groupBy("request", "lang").agg(*[F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("ms"))), F.lit(0.0)).alias(s) for s in STAGES])


def _retrieval() -> Column:
    return F.col("encode_ms") + F.col("dense_ms") + F.col("sparse_ms") + F.col("fuse_ms") + F.col("hydrate_ms")


def coarse_timings(stages: DataFrame) -> DataFrame:
    """By request: embed_ms, search_ms (both lists, fusion and texts) and total_ms."""
    return by_request(stages).select("request", "lang", F.col("encode_ms").alias("embed_ms"), (_retrieval() - F.col("encode_ms")).alias("search_ms"), _retrieval().alias("total_ms"))


def latency_tiers(stages: DataFrame, warmup: int = 0, request: str = "request") -> DataFrame:
    """Times of three tiers by language and pooled (null): A retrieval, B the first answer, C the generated one. The first ``warmup`` requests do not count."""
    tiers = {"A": _retrieval(), "B": _retrieval() + F.col("guard_ms") + F.col("extractive_ms"), "C": _retrieval() + F.col("generation_ms")}
    each = by_request(stages).where(F.col(request) >= warmup).select("lang", F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), ms.alias("ms")) for t, ms in tiers.items()])).alias("x")).select("lang", "x.tier", "x.ms")
    return latency_rollup(each, "tier", "lang")

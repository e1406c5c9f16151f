"""Queries over retrieval quality, samples and latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, ranking, sparse
from . import served, views
from .q_corpus import _fixed_sql, _packed_sql
from .q_retrieval import bm25_cte, ranked_lists, rrf_cte, vectors_cte
from .registry import query
from .views import PASSAGES, QUESTIONS

QRELS = "(SELECT b.item_id AS qid, d.doc_id AS document_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


#: Words by whose hash a benchmark text is looked for in documents.
LEAD = 6


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text."""
    return evaluate.holding(views.table(spark, sf_dir, "documents"), views.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), LEAD)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.evaluated_queries(views.questions(spark, sf_dir), qrels(spark, sf_dir))


@query(f"SELECT qid, document_id FROM {QRELS}")
def ground_truth(spark, sf_dir):
    return qrels(spark, sf_dir)


@query(f"SELECT query_id AS qid, document_id FROM {PASSAGES} WHERE is_selected = 1")
def relevant_documents(spark, sf_dir):
    return evaluate.relevant_documents(views.passages(spark, sf_dir))


def _recall_sql(hits: str, ks=(1, 3, 5, 10), by: str = "") -> str:
    """Recall of ``hits`` (qid, document_id, rank and ``by``) over all labelled queries."""
    group = f"{by}, " if by else ""
    cols = ", ".join(f"round(count(*) FILTER (best <= {k}) / max(n), 4) AS recall_{k}" for k in ks)
    n = f"(SELECT count(DISTINCT qid) AS n FROM {QRELS})"
    return f"""SELECT {group}max(n) AS n_queries, {cols} FROM (SELECT {group}qid, min(rank) AS best FROM
  (SELECT {group}qid, document_id, row_number() OVER (PARTITION BY {group}qid ORDER BY min(rank)) AS rank FROM {hits} GROUP BY {group}qid, document_id) r JOIN {QRELS} USING (qid, document_id) GROUP BY {group}qid), {n} n
  {f'GROUP BY {by}' if by else ''}"""


@query(f"WITH {vectors_cte()}, s AS (SELECT qid, chunk_id AS document_id, rank FROM sparse_hits) {_recall_sql('s')}")
def recall_doc(spark, sf_dir):
    _, words = ranked_lists(spark, sf_dir)
    return evaluate.document_recall(words, qrels(spark, sf_dir), labelled(spark, sf_dir))


@query(f"WITH {vectors_cte()} SELECT (SELECT count(DISTINCT qid) FROM {QRELS}) AS n_queries, {', '.join(f'round(count(*) FILTER (best <= {k}) / (SELECT count(DISTINCT qid) FROM {QRELS}), 4) AS recall_{k}' for k in (1, 5, 10))} FROM (SELECT qid, min(rank) AS best FROM dense_hits JOIN {QRELS} q USING (qid) WHERE dense_hits.chunk_id = q.document_id GROUP BY qid)")
def recall_chunk(spark, sf_dir):
    near, _ = ranked_lists(spark, sf_dir)
    relevant = qrels(spark, sf_dir).withColumnRenamed("document_id", "chunk_id")
    return evaluate.chunk_recall(near, relevant, labelled(spark, sf_dir))


@query(f"""WITH {vectors_cte()}, {rrf_cte(cap=2)}, lists AS (SELECT 'dense' AS mode, qid, chunk_id AS document_id, rank FROM dense_hits UNION ALL SELECT 'sparse', qid, chunk_id, rank FROM sparse_hits
  UNION ALL SELECT 'hybrid', qid, chunk_id, rank FROM fused) {_recall_sql('lists', by='mode')}""")
def ablation(spark, sf_dir):
    near, words = ranked_lists(spark, sf_dir)
    return evaluate.ablation(near, words, qrels(spark, sf_dir), labelled(spark, sf_dir))


WEIGHTS = [(1.0, w) for w in (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)]
_SWEEP = f"""WITH {vectors_cte()}, {', '.join(rrf_cte(dw=a, sw=b, name=f'f{i}_') for i, (a, b) in enumerate(WEIGHTS))},
lists AS ({' UNION ALL '.join(f'SELECT {a}::DOUBLE AS dense_weight, {b}::DOUBLE AS sparse_weight, qid, chunk_id AS document_id, rank FROM f{i}_' for i, (a, b) in enumerate(WEIGHTS))})
{_recall_sql('lists', by='dense_weight, sparse_weight')}"""


@query(_SWEEP)
def weight_sweep(spark, sf_dir):
    near, words = ranked_lists(spark, sf_dir)
    return evaluate.weight_sweep(near, words, qrels(spark, sf_dir), labelled(spark, sf_dir), WEIGHTS)


CONFIGURED = {"dense_only": (1.0, 0.0), "d1.0_b0.25": (1.0, 0.25), "d1.0_b0.5": (1.0, 0.5), "d1.0_b1.0": (1.0, 1.0), "d2.0_b1.0": (2.0, 1.0)}
_CONFIGURED = f"""WITH {vectors_cte()}, {', '.join(rrf_cte(dw=a, sw=b, name=f'c{i}_') for i, (a, b) in enumerate(CONFIGURED.values()))},
lists AS ({' UNION ALL '.join(f"SELECT '{label}' AS label, qid, chunk_id AS document_id, rank FROM c{i}_" for i, label in enumerate(CONFIGURED))}) {_recall_sql('lists', by='label')}"""


@query(_CONFIGURED)
def weight_configurations(spark, sf_dir):
    near, words = ranked_lists(spark, sf_dir)
    swept = evaluate.weight_sweep(near, words, qrels(spark, sf_dir), labelled(spark, sf_dir), list(CONFIGURED.values()))
    names = spark.createDataFrame([(label, a, b) for label, (a, b) in CONFIGURED.items()], "label string, dense_weight double, sparse_weight double")
    return swept.join(names, ["dense_weight", "sparse_weight"]).drop("dense_weight", "sparse_weight")


@query(f"SELECT * FROM ({_SWEEP}) ORDER BY recall_10 DESC, recall_5 DESC, recall_1 DESC, dense_weight, sparse_weight LIMIT 1")
def best_weight(spark, sf_dir):
    return evaluate.best_setting(weight_sweep(spark, sf_dir), ["dense_weight", "sparse_weight"])


@query(f"""WITH {bm25_cte()}, hits AS (SELECT qid, lang, chunk_id, row_number() OVER (PARTITION BY qid, lang ORDER BY score DESC, chunk_id) AS rank FROM scores QUALIFY rank <= 10),
asked AS (SELECT DISTINCT q.qid, d.lang AS source, d.doc_id // 10 AS g FROM {QRELS} q JOIN documents d ON d.doc_id = q.document_id),
pairs AS (SELECT DISTINCT a.qid, a.source, d.lang AS target, a.g FROM asked a JOIN documents d ON d.doc_id // 10 = a.g AND d.lang <> a.source)
SELECT source, target, count(*) AS n_queries, round(avg(hit), 4) AS recall FROM (SELECT source, target, qid, max(CAST(EXISTS (SELECT 1 FROM hits h WHERE h.qid = p.qid AND h.lang = p.target AND h.chunk_id // 10 = p.g) AS INT)) AS hit FROM pairs p GROUP BY ALL) GROUP BY ALL""")
def cross_lingual(spark, sf_dir):
    chunks = views.chunks(spark, sf_dir)
    docs = chunks.select("document_id", "lang", F.floor(F.col("document_id") / 10).cast("long").alias("group"))
    hits = sparse.search(served.lexical(spark, sf_dir), views.questions(spark, sf_dir), 10, per_language=True).withColumnRenamed("chunk_id", "document_id")
    asked = qrels(spark, sf_dir).join(docs, "document_id").select("qid", F.col("lang").alias("source"), "group").distinct()
    return evaluate.cross_lingual(hits, asked, docs)


@query("SELECT doc_id FROM documents ORDER BY md5('12345:' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark, sf_dir):
    return ranking.seeded_sample(views.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50)


@query("""WITH s AS (SELECT lang, count(*) AS size, sum(count(*)) OVER () AS total FROM documents GROUP BY lang), q AS (SELECT *, CAST(floor(size * 100 / total) AS BIGINT) AS quota FROM s),
  f AS (SELECT *, least(quota + CASE WHEN row_number() OVER (ORDER BY size DESC, lang) = 1 THEN 100 - sum(quota) OVER () ELSE 0 END, size) AS n FROM q)
  SELECT doc_id, d.lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('12345:' || doc_id), doc_id) AS nth FROM documents) d JOIN f ON f.lang = d.lang WHERE nth <= n""")
def stratified_sample(spark, sf_dir):
    return ranking.stratified_sample(views.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 100)


@query("SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT i * ((SELECT count(*) FROM embeddings) - 1) // 19 FROM range(20) AS r(i))")
def evenly_spaced(spark, sf_dir):
    return ranking.evenly_spaced(views.table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 20)


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.concat(F.lit("g"), F.col("user_id") % 3).alias("grp"), F.col("value").alias("ms"))


_EVENTS = "(SELECT event_type AS stage, 'g' || (user_id % 3) AS grp, value AS ms FROM events)"
_LATENCY = "count(ms) AS n, round(quantile_cont(ms, 0.5), 4) AS p50, round(quantile_cont(ms, 0.7), 4) AS p70, round(max(ms), 4) AS p100, round(avg(ms), 4) AS mean"


@query(f"SELECT stage, {_LATENCY} FROM {_EVENTS} GROUP BY stage")
def latency_percentiles(spark, sf_dir):
    return evaluate.latency(timings(spark, sf_dir), ["stage"])


@query(f"SELECT stage, grp, {_LATENCY} FROM {_EVENTS} GROUP BY GROUPING SETS ((stage, grp), (stage))")
def latency_rollup(spark, sf_dir):
    return evaluate.latency_rollup(timings(spark, sf_dir), "stage", "grp")


@query(f"SELECT stage, count(ms) AS n, round(avg(ms), 4) AS mean, round(quantile_cont(ms, 0.5), 4) AS p50, round(quantile_cont(ms, 0.95), 4) AS p95, round(quantile_cont(ms, 0.99), 4) AS p99, CASE WHEN quantile_cont(ms, 0.95) <= 200 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM {_EVENTS} GROUP BY stage")
def budget_verdict(spark, sf_dir):
    return evaluate.budget_verdict(timings(spark, sf_dir), ["stage"], 200.0)


@query("SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1")
def decision_tally(spark, sf_dir):
    return evaluate.decision_tally(views.table(spark, sf_dir, "events").select(F.col("event_type").alias("reason")))


@query("""SELECT event_type AS provider, 'g' || (user_id % 3) AS lang, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS first_p50, round(quantile_cont(value * 2, 0.5), 4) AS total_p50,
  CAST(sum(CAST(user_id % 2 = 0 AS INT)) AS BIGINT) AS script_ok FROM events GROUP BY ALL""")
def provider_comparison(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.concat(F.lit("g"), F.col("user_id") % 3).alias("lang"), F.col("value").alias("first"), (F.col("value") * 2).alias("total"), (F.col("user_id") % 2 == 0).alias("ok"))
    return evaluate.provider_comparison(rows, ["provider", "lang"], "first", "total", "ok")


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_property(spark, sf_dir):
    return views.table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


STRATEGIES = ("fixed", "semantic", "adaptive")


def _strategies_sql() -> str:
    """Chunks of all strategies, their vectors, and recall of the first 30 by cosine."""
    bucket = "CAST('0x' || substr(md5(term), 1, 2) AS INT) % 64"
    fixed = _fixed_sql("text", 256, 32)
    side = lambda name, src, key: f"{name}0 AS (SELECT {key}, {bucket} AS b, count(*) AS c FROM (SELECT {key}, unnest({views.tokens_sql('text')}) AS term FROM {src}) GROUP BY ALL), {name} AS (SELECT {key}, b, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS x FROM {name}0)"
    return f"""WITH RECURSIVE {_packed_sql(384)},
lists0 AS (SELECT 'fixed' AS strategy, doc_id, {fixed} AS c FROM documents UNION ALL SELECT 'semantic', z.doc_id, CASE WHEN t <= 384 THEN [text] ELSE c END FROM sized z JOIN packed p ON p.doc_id = z.doc_id
  UNION ALL SELECT 'adaptive', z.doc_id, CASE WHEN t <= 128 THEN [text] WHEN t <= 512 THEN CASE WHEN t <= 384 THEN [text] ELSE c END ELSE {fixed} END FROM sized z JOIN packed p ON p.doc_id = z.doc_id),
made AS (SELECT strategy, doc_id, strategy || ':' || doc_id || '_c' || (i - 1) AS chunk_id, c[i] AS text FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM lists0)),
{side('mv', 'made', 'strategy, doc_id, chunk_id')}, {side('qv', QUESTIONS, 'qid')},
hits AS (SELECT strategy, qid, doc_id AS document_id, row_number() OVER (PARTITION BY strategy, qid ORDER BY round(sum(qv.x * mv.x), 6) DESC, chunk_id) AS rank FROM qv JOIN mv USING (b) GROUP BY strategy, qid, doc_id, chunk_id QUALIFY rank <= 30)
{_recall_sql('hits', by='strategy')}"""


@query(_strategies_sql())
def chunk_strategies(spark, sf_dir):
    """Recall of dense retrieval over chunks of each strategy."""
    from ..operators import chunking, dense

    docs, found = views.passages(spark, sf_dir).select("document_id", "text", "lang"), None
    asked = dense.encode(views.questions(spark, sf_dir), vector="qvec", kind="query", max_tokens=0)
    for name in STRATEGIES:
        made = chunking.chunk_corpus(docs, name, id_col="document_id").withColumn("chunk_id", F.concat(F.lit(f"{name}:"), "chunk_id"))
        own = dense.knn(asked, dense.encode(made, max_tokens=0), 30, ("document_id",)).select("qid", "rank", "document_id", F.lit(name).alias("strategy"))
        found = own if found is None else found.unionByName(own)
    return evaluate.document_recall(found, qrels(spark, sf_dir), labelled(spark, sf_dir), by=["strategy"])


# ---- stages of requests ------------------------------------------------------


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stages of requests, eight to each."""
    rows = views.table(spark, sf_dir, "events")
    request = F.floor(F.col("event_id") / len(evaluate.STAGES)).cast("long")
    return rows.select(request.alias("request"), F.concat(F.lit("g"), request % 3).alias("lang"), F.element_at(F.array(*map(F.lit, evaluate.STAGES)), (F.col("event_id") % len(evaluate.STAGES) + 1).cast("int")).alias("stage"), F.col("value").alias("ms"))


_STAGED = f"(SELECT event_id // 8 AS request, 'g' || (event_id // 8 % 3) AS lang, ['{"', '".join(evaluate.STAGES)}'][event_id % 8 + 1] AS stage, value AS ms FROM events)"
_REQUESTS = f"(SELECT request, lang, {', '.join(f"coalesce(sum(ms) FILTER (stage = '{s}'), 0) AS {s}" for s in evaluate.STAGES)} FROM {_STAGED} GROUP BY ALL)"


@query(f"SELECT request, round(encode_ms, 4) AS embed_ms, round(dense_ms + sparse_ms + fuse_ms + hydrate_ms, 4) AS search_ms, round(encode_ms + dense_ms + sparse_ms + fuse_ms + hydrate_ms, 4) AS total_ms FROM {_REQUESTS}")
def stage_timings(spark, sf_dir):
    return evaluate.coarse_timings(staged(spark, sf_dir)).select("request", *[F.round(c, 4).alias(c) for c in ("embed_ms", "search_ms", "total_ms")])


@query(f"""WITH t AS (SELECT request, lang, unnest([{{'tier': 'A', 'ms': encode_ms + dense_ms + sparse_ms + fuse_ms + hydrate_ms}}, {{'tier': 'B', 'ms': encode_ms + dense_ms + sparse_ms + fuse_ms + hydrate_ms + guard_ms + extractive_ms}},
  {{'tier': 'C', 'ms': encode_ms + dense_ms + sparse_ms + fuse_ms + hydrate_ms + generation_ms}}]) AS x FROM {_REQUESTS})
SELECT x.tier AS tier, lang, count(*) AS n, round(quantile_cont(x.ms, 0.5), 4) AS p50, round(quantile_cont(x.ms, 0.7), 4) AS p70, round(max(x.ms), 4) AS p100, round(avg(x.ms), 4) AS mean
FROM t WHERE request >= 3 GROUP BY GROUPING SETS ((x.tier, lang), (x.tier))""")
def latency_tiers(spark, sf_dir):
    return evaluate.latency_tiers(staged(spark, sf_dir), warmup=3)

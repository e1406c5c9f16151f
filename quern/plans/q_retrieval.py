"""Queries over lexical, vector and fused retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import rules
from ..operators import dense, fusion, sparse
from ..storage import materialize
from . import served, views
from .registry import query, values
from .views import QUESTIONS, tokens_sql

CONFIG = Config()
NORM = "sqrt(list_sum(list_transform({v}, lambda x: CAST(x AS DOUBLE) * x)))"
DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

ROUTED = [(1, "what is this", None), (2, "यह क्या है", None), (3, "यह क्या है", "mr-IN"), (4, "12345", None), (5, "hello", "fr-FR"), (6, "Привет", None)]
SERVED = [("hi", "Devanagari"), ("en", "Latin"), ("mr", "Devanagari")]


@query(f"""SELECT id, array_to_string(CASE WHEN split_part(pinned, '-', 1) IN ('hi', 'en', 'mr') THEN [split_part(pinned, '-', 1)]
  WHEN regexp_matches(text, '[\\x{{0904}}-\\x{{0939}}]') THEN ['hi', 'mr'] WHEN regexp_matches(text, '[A-Za-z]') THEN ['en'] ELSE ['hi', 'en', 'mr'] END, ',') AS langs
  FROM {values(ROUTED, 'id, text, pinned')}""")
def route_languages(spark, sf_dir):
    rows = spark.createDataFrame(ROUTED, "id int, text string, pinned string")
    return rows.select("id", F.array_join(sparse.route_languages("text", SERVED, F.col("pinned")), ",").alias("langs"))


# ---- lexical -----------------------------------------------------------------


def bm25_cte(okapi: bool = False, global_index: bool = False, suffix: str = "", asked: str = QUESTIONS) -> str:
    """``scores{suffix}``: qid, lang, chunk_id, score."""
    strip, lang = (rules.STRIP_SHORT if okapi else rules.STRIP), ("'all'" if global_index else "lang")
    x = suffix
    idf = "CASE WHEN ln(n - df + 0.5) - ln(df + 0.5) < 0 THEN 0.25 * m ELSE ln(n - df + 0.5) - ln(df + 0.5) END" if okapi else "ln(1 + (n - df + 0.5) / (df + 0.5))"
    return f"""
w{x} AS (SELECT {lang} AS lang, doc_id AS chunk_id, {tokens_sql('text', strip)} AS words FROM documents),
len{x} AS (SELECT lang, chunk_id, len(words) AS dl FROM w{x}),
st{x} AS (SELECT lang, count(*) AS n, avg(dl) AS avgdl FROM len{x} GROUP BY lang),
tf{x} AS (SELECT lang, chunk_id, term, count(*) AS tf FROM (SELECT lang, chunk_id, unnest(words) AS term FROM w{x}) GROUP BY ALL),
df{x} AS (SELECT lang, term, count(*) AS df FROM tf{x} GROUP BY ALL),
mean{x} AS (SELECT lang, avg(ln(n - df + 0.5) - ln(df + 0.5)) AS m FROM df{x} JOIN st{x} USING (lang) GROUP BY lang),
idf{x} AS (SELECT lang, term, {idf} AS idf, avgdl FROM df{x} JOIN st{x} USING (lang) JOIN mean{x} USING (lang)),
qt{x} AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({tokens_sql('text', strip)}) AS term FROM {asked}) GROUP BY ALL),
scores{x} AS (SELECT qid, lang, chunk_id, round(sum(times * idf * tf{' * 2.5' if okapi else ''} / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qt{x} JOIN tf{x} USING (term) JOIN idf{x} USING (lang, term) JOIN len{x} USING (lang, chunk_id) GROUP BY ALL HAVING score > 0)"""


@query(f"WITH {bm25_cte()} SELECT lang, n, round(avgdl, 6) AS avgdl, count(*) AS terms, CAST(sum(df) AS BIGINT) AS postings, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5))), 4) AS idf_sum FROM df JOIN st USING (lang) GROUP BY ALL")
def bm25_stats(spark, sf_dir):
    index = served.lexical(spark, sf_dir)
    terms = index.terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("df").alias("postings"), F.round(F.sum("idf"), 4).alias("idf_sum"))
    return index.stats.select("lang", "n", F.round("avgdl", 6).alias("avgdl")).join(terms, "lang")


_TOP = "SELECT qid, CAST(row_number() OVER (PARTITION BY {by} ORDER BY score DESC, chunk_id) AS INT) AS rank, chunk_id, lang, score FROM {t} QUALIFY rank <= {k}"


@query(f"WITH {bm25_cte(global_index=True)} {_TOP.format(by='qid', t='scores', k=20)}")
def bm25_topk(spark, sf_dir):
    return sparse.search(served.lexical(spark, sf_dir, by_language=False), views.questions(spark, sf_dir), 20).select("qid", "rank", "chunk_id", "lang", "score")


@query(f"WITH {bm25_cte(okapi=True, global_index=True)} {_TOP.format(by='qid', t='scores', k=20)}")
def bm25_okapi_topk(spark, sf_dir):
    index = served.lexical(spark, sf_dir, "okapi", False)
    return sparse.search(index, views.questions(spark, sf_dir), 20, "okapi").select("qid", "rank", "chunk_id", "lang", "score")


@query(f"WITH {bm25_cte()}, l AS ({_TOP.format(by='qid, lang', t='scores', k=20)}) {_TOP.format(by='qid', t='(SELECT qid, chunk_id, lang, score FROM l)', k=20)}")
def bm25_per_lang_merge(spark, sf_dir):
    from ..operators.ranking import merge_ranked

    hits = sparse.search(served.lexical(spark, sf_dir), views.questions(spark, sf_dir), 20, per_language=True)
    return merge_ranked(hits, 20).select("qid", "rank", "chunk_id", "lang", "score")


@query(f"WITH {bm25_cte()} {_TOP.format(by='qid', t='''(SELECT * FROM scores WHERE lang IN ('en', 'fr'))''', k=20)}")
def bm25_restricted(spark, sf_dir):
    asked = views.questions(spark, sf_dir).withColumn("langs", F.array(F.lit("en"), F.lit("fr")))
    return sparse.search(served.lexical(spark, sf_dir), asked, 20).select("qid", "rank", "chunk_id", "lang", "score")


_CHOSEN = "(SELECT doc_id FROM labels WHERE quality = 1)"


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.passages(spark, sf_dir).where("is_selected = 1").select(F.col("document_id").alias("chunk_id"))


@query(f"WITH {bm25_cte()} {_TOP.format(by='qid', t=f'(SELECT * FROM scores WHERE chunk_id IN {_CHOSEN})', k=10)}")
def bm25_only_selected(spark, sf_dir):
    return sparse.search(served.lexical(spark, sf_dir), views.questions(spark, sf_dir), 10, only=chosen(spark, sf_dir)).select("qid", "rank", "chunk_id", "lang", "score")


@query(f"WITH {bm25_cte()} {_TOP.format(by='qid', t=f'(SELECT * FROM (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) <= 40) WHERE chunk_id IN {_CHOSEN})', k=10)}")
def bm25_overfetch(spark, sf_dir):
    return sparse.search(served.lexical(spark, sf_dir), views.questions(spark, sf_dir), 10, only=chosen(spark, sf_dir), overfetch=4).select("qid", "rank", "chunk_id", "lang", "score")


# ---- vectors -----------------------------------------------------------------

_PAIRS = f"(SELECT q.vec_id AS qid, q.label AS qlabel, v.vec_id AS chunk_id, v.label, round({DOT.format(a='q.embedding', b='v.embedding')}, 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)"
_KNN = "SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INT) AS rank, chunk_id, score FROM {t} QUALIFY rank <= {k}"


@query(_KNN.format(t=_PAIRS, k=10))
def knn_exact(spark, sf_dir):
    return dense.knn(views.vector_queries(spark, sf_dir), views.vectors(spark, sf_dir), 10)


@query(_KNN.format(t=f"(SELECT * FROM {_PAIRS} WHERE label = 3)", k=10))
def knn_only_selected(spark, sf_dir):
    return dense.knn(views.vector_queries(spark, sf_dir), views.vectors(spark, sf_dir), 10, ("label",), F.col("label") == 3).drop("label")


@query(_KNN.format(t=f"(SELECT * FROM (SELECT * FROM {_PAIRS} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) <= 40) WHERE label = 3)", k=10))
def knn_overfetch(spark, sf_dir):
    return dense.knn(views.vector_queries(spark, sf_dir), views.vectors(spark, sf_dir), 10, ("label",), F.col("label") == 3, overfetch=4).drop("label")


@query()
def knn_lsh(spark, sf_dir):
    return dense.knn_lsh(views.vector_queries(spark, sf_dir), views.vectors(spark, sf_dir), 10)


@query("SELECT 10 * count(*) AS n_exact, true AS recall_90 FROM embeddings WHERE vec_id % 50 = 0")
def ann_recall(spark, sf_dir):
    near = dense.knn_lsh(views.vector_queries(spark, sf_dir), views.vectors(spark, sf_dir), 10)
    found = dense.ann_recall(near, dense.knn(views.vector_queries(spark, sf_dir), views.vectors(spark, sf_dir), 10))
    return found.select("n_exact", (F.col("recall") >= 0.9).alias("recall_90"))


@query(f"""SELECT count(*) AS n, CAST(min(len(embedding)) AS INT) AS dim_min, CAST(max(len(embedding)) AS INT) AS dim_max, max(abs({NORM.format(v='embedding')} - 1)) <= 0.01 AS unit_norm,
  CAST(sum(CAST({NORM.format(v='embedding')} = 0 AS INT)) AS BIGINT) AS zero_vectors, count(DISTINCT vec_id) = count(*) AS unique_index, min(vec_id) = 0 AND max(vec_id) = count(*) - 1 AS contiguous FROM embeddings""")
def vector_checks(spark, sf_dir):
    return dense.vector_checks(views.vectors(spark, sf_dir), "vector", "chunk_id")


@query("SELECT vec_id AS chunk_id, label FROM embeddings WHERE vec_id >= 100 AND vec_id < 250")
def vector_range_scan(spark, sf_dir):
    return dense.range_scan(views.vectors(spark, sf_dir), "chunk_id", 100, 250).select("chunk_id", "label")


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE label >= 5")
def resume_encoding(spark, sf_dir):
    rows = views.vectors(spark, sf_dir).select("chunk_id", "label")
    return dense.resume(rows, rows.where("label < 5")).select("chunk_id")


# ---- fusion ------------------------------------------------------------------

def vectors_cte(asked: str = QUESTIONS) -> str:
    """``dense_hits``: qid, chunk_id, score, rank of the hashed encoder's cosines, and ``sparse_hits`` of the languages' lexical indexes."""
    bucket = "CAST('0x' || substr(md5(term), 1, 2) AS INT) % 64"
    side = lambda name, src, key: f"""
{name}0 AS (SELECT {key}, {bucket} AS b, count(*) AS c FROM (SELECT {key}, unnest({tokens_sql('text')}) AS term FROM {src}) GROUP BY ALL),
{name} AS (SELECT {key}, b, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS x FROM {name}0)"""  # noqa: E731
    return f"""{side('dv', '(SELECT doc_id AS chunk_id, text FROM documents)', 'chunk_id')},
{side('qv', asked, 'qid')},
cosines AS (SELECT qid, chunk_id, round(sum(qv.x * dv.x), 6) AS score FROM qv JOIN dv USING (b) GROUP BY ALL),
dense_hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM cosines QUALIFY rank <= 20),
{bm25_cte(asked=asked)},
sparse_hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM scores QUALIFY rank <= 20)"""


def rrf_cte(dw: float = 1.0, sw: float = 0.1, cap: int = 0, owner: str = "doc_id", name: str = "fused") -> str:
    """``fused``: ranked by reciprocal ranks."""
    order = "round(raw, 12) DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST, chunk_id"
    limit = f"QUALIFY row_number() OVER (PARTITION BY qid, document_id ORDER BY {order}) <= {cap}" if cap else ""
    return f"""
{name}0 AS (SELECT qid, chunk_id, sum(w / (60 + rank)) AS raw, max(rank) FILTER (l = 'd') AS dense_rank, max(rank) FILTER (l = 's') AS sparse_rank, max(score) FILTER (l = 'd') AS dense_score, max(score) FILTER (l = 's') AS sparse_score
  FROM (SELECT qid, chunk_id, rank, score, 'd' AS l, {dw}::DOUBLE AS w FROM dense_hits UNION ALL SELECT qid, chunk_id, rank, score, 's', {sw}::DOUBLE FROM sparse_hits) GROUP BY ALL),
{name}1 AS (SELECT f.*, d.{owner} AS document_id FROM {name}0 f JOIN documents d ON d.doc_id = f.chunk_id {limit}),
{name} AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY {order}) AS INT) AS rank, chunk_id, document_id, CAST(dense_rank AS INT) AS dense_rank, CAST(sparse_rank AS INT) AS sparse_rank, dense_score, sparse_score, round(raw, 6) AS rrf_score FROM {name}1)"""


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their vectors and the languages that their script is routed to."""
    asked = dense.encode(views.questions(spark, sf_dir), vector="qvec", kind="query", max_tokens=0)
    return asked.withColumn("langs", sparse.route_languages("text", views.LANGUAGES))


def ranked_lists(spark: SparkSession, sf_dir: str, owner: str = "document_id", k: int = 20) -> tuple[DataFrame, DataFrame]:
    chunks = views.chunks(spark, sf_dir)
    owners = chunks.select("chunk_id", F.col(owner).alias("document_id"))
    asked = asked_vectors(spark, sf_dir)
    near = dense.knn(asked, served.vectors(spark, sf_dir), k).join(owners, "chunk_id")
    words = sparse.search(served.lexical(spark, sf_dir), asked, k).join(owners, "chunk_id")
    return materialize(near, "near"), materialize(words, "words")


FUSED = "qid, rank, chunk_id, document_id, dense_rank, sparse_rank, dense_score, sparse_score, rrf_score"


@query(f"WITH {vectors_cte()}, {rrf_cte()} SELECT {FUSED} FROM fused")
def rrf_fuse(spark, sf_dir):
    return fusion.rrf(*ranked_lists(spark, sf_dir), cap=0)


@query(f"WITH {vectors_cte()}, {rrf_cte(cap=2, owner='source')} SELECT {FUSED} FROM fused WHERE rank <= 10")
def rrf_cap(spark, sf_dir):
    return fusion.rrf(*ranked_lists(spark, sf_dir, "source"), cap=2, k=10)


@query(f"WITH {vectors_cte()}, {rrf_cte(sw=1.0)} SELECT qid, rank, chunk_id, document_id, dense_rank, sparse_rank AS bm25_rank, dense_score, sparse_score AS bm25_score, rrf_score FROM fused WHERE rank <= 10")
def rrf_legacy(spark, sf_dir):
    return fusion.rrf_legacy(*ranked_lists(spark, sf_dir), k=10)


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.hybrid_search(views.chunks(spark, sf_dir), served.vectors(spark, sf_dir), served.lexical(spark, sf_dir), asked_vectors(spark, sf_dir), CONFIG)


@query(f"WITH {vectors_cte()}, {rrf_cte(cap=2)} SELECT {FUSED}, md5(d.text) AS digest FROM fused f JOIN documents d ON d.doc_id = f.chunk_id WHERE rank <= 5")
def hybrid_search(spark, sf_dir):
    found = hybrid(spark, sf_dir)
    return found.select(*[c.strip() for c in FUSED.split(",")], F.md5("text").alias("digest"))


@query(f"WITH {bm25_cte(global_index=True)}, l AS ({_TOP.format(by='qid', t='scores', k=3)}) SELECT l.qid, l.rank, l.chunk_id, d.lang, length(d.text) AS n_chars FROM l JOIN documents d ON d.doc_id = l.chunk_id")
def hydrate(spark, sf_dir):
    chunks = views.chunks(spark, sf_dir)
    hits = sparse.search(served.lexical(spark, sf_dir, by_language=False), views.questions(spark, sf_dir), 3).drop("lang")
    return fusion.hydrate(hits, chunks).select("qid", "rank", "chunk_id", "lang", F.length("text").cast("long").alias("n_chars"))

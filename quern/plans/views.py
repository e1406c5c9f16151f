"""The test tables in the shape that the operators take, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import count_tokens
from ..sources.tables import spread
from .registry import quoted

#: Tables whose rows cost enough to deal them to all cores.
TEXTS = ("documents",)
LANGUAGES = [("de", "Latin"), ("en", "Latin"), ("es", "Latin"), ("fr", "Latin")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")) if name in TEXTS else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as passages: ten to a query, labelled by quality."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), "quality")
    docs = table(spark, sf_dir, "documents")
    return docs.join(labels, docs["doc_id"] == labels["_id"], "left").select(
        F.col("doc_id").alias("document_id"), F.floor(F.col("doc_id") / 10).cast("long").alias("query_id"), (F.col("doc_id") % 10).cast("int").alias("passage_index"),
        "lang", F.coalesce("quality", F.lit(0)).cast("byte").alias("is_selected"), "text", "source",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as chunks; a source owns them where a cap by owner is asked for."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), "lang", "text", "source")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), F.col("label").alias("qlabel"))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", count_tokens("text").alias("n_tokens"), F.length("text").alias("n_chars"))


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as rows of parallel lists."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t")).select(
        "conv_id", F.transform("t", lambda x: x["text"]).alias("texts"), F.transform("t", lambda x: x["role"]).alias("roles"), F.transform("t", lambda x: (x["role"] == "user").cast("int")).alias("is_user"),
    )


# ---- the same in SQL ---------------------------------------------------------

PASSAGES = """(SELECT d.doc_id AS document_id, d.doc_id // 10 AS query_id, CAST(d.doc_id % 10 AS INT) AS passage_index, d.lang,
  coalesce(l.quality, 0) AS is_selected, d.text, d.source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
QUESTIONS = "(SELECT item_id AS qid, text FROM benchmark)"
LENGTHS = r"(SELECT doc_id, lang, len(regexp_extract_all(text, '\S+')) AS n_tokens, length(text) AS n_chars FROM documents)"


def tokens_sql(text: str, strip: str = rules.STRIP) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array(coalesce({text}, ''), '\s+'), lambda w: lower(trim(w, {quoted(strip)}))), lambda w: length(w) >= 2)"


def terms_sql(text: str) -> str:
    stop = ", ".join(quoted(w) for w in rules.STOPWORDS)
    return f"list_filter({tokens_sql(text)}, lambda w: NOT list_contains([{stop}], w))"


def sentences_sql(text: str) -> str:
    opening = rules.OPENING.replace("'", "''")
    closing = rules.CLOSING.replace("'", "''")
    ends = rf"({rules.TERMINATOR}{closing})(\s|$)|(\.{closing})(\s+{opening})"
    return rf"list_filter(string_split(regexp_replace(coalesce({text}, ''), '{ends}', '\1\3' || chr(1) || '\2\4', 'g'), chr(1)), lambda s: regexp_matches(s, '\S'))"

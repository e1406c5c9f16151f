"""Indexes that queries share: built from a table by the first that asks, written, and loaded by all others.

They lie below ``spark.quern.index.dir`` where that is set, and stay; else in the
shared folder, until the interpreter ends. A table's files (names, lengths, times)
name its folder, so changed rows are indexed anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dense, sparse
from ..sources import tables
from ..storage import drop_at_exit, shared_dir
from . import views


def place(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Where an index over the documents of a folder lies."""
    root = spark.conf.get("spark.quern.index.dir", None)
    path = f"{(root or shared_dir(spark) + '/quern').rstrip('/')}/served-{tables.fingerprint(spark, f'{sf_dir}/documents.parquet')}/{name}"
    if root is None:
        drop_at_exit(spark, path)
    return path


def one_index(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("lang", F.lit("all"))


def lexical(spark: SparkSession, sf_dir: str, variant: str = "lucene", by_language: bool = True) -> sparse.Index:
    """A lexical index over the documents, one for each language or one for all."""
    chunks = views.chunks(spark, sf_dir)
    build = lambda: sparse.build_index(chunks if by_language else one_index(chunks), variant, staged=True)
    return tables.load_index(spark, place(spark, sf_dir, f"{variant}-{'languages' if by_language else 'all'}"), build)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id and vector of all documents, of their whole texts."""
    path = place(spark, sf_dir, "vectors")
    if not tables.exists(spark, f"{path}/_SUCCESS"):
        dense.encode(views.chunks(spark, sf_dir), max_tokens=0).select("chunk_id", "vector").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

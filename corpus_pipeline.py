"""A corpus pipeline: each stage takes the documents that the one before it kept.

Edge cases: null and empty texts fail the quality rules; repeated rows are one
document after near-dedup, unlike texts of one id are documents of their own; a
null id, source or language is kept as it is, and a null source is a source of
its own; long texts are read whole; ties go to the smaller id, or by a hash where
ids are alike; further columns, also with clashing names, are carried to the last
stage, which gives sequences; an empty table gives an empty table.

Each stage sets the session's Arrow batches to ``BATCH_ROWS`` rows at most, since
it is run by whoever writes its result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import mixing, neardup, packing, quality, substring
from quern.llm.queries import MIX_POWER, tokenizer
from quern.storage import materialize

#: Rows that a worker gets at a time. Spark's 10,000 are about 30 MB of text, held by the executor and by the worker.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` in a session whose Arrow batches are small; smaller ones stay as they are set."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
            spark.conf.set(_BATCH, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule passes."""
    return quality.keep(docs)


@small_batches
def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by 0.8 of their five-word shingles."""
    return neardup.keep(docs)


@small_batches
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 20 words or more that stand earlier; ``n_chars`` follows the text."""
    at = {n: docs.columns.index(n) for n in ("doc_id", "text", "n_chars")}
    rows = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    left = substring.dedup(rows, f"_{at['doc_id']}", f"_{at['text']}", keep=tuple(c for i, c in enumerate(rows.columns) if i not in (at["doc_id"], at["text"])))
    n, text = f"_{at['n_chars']}", f"_{at['text']}"
    left = left.withColumn(n, F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col(n)))
    return left.select(*rows.columns).toDF(*docs.columns)


@small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, in which part files follow one another."""
    return mixing.interleave(docs, power=MIX_POWER)


@small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of at most 2,048, windows following the mixture."""
    return packing.pack(docs, tokenizer)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", minhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has no counterpart of the tokenizer and of packing; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

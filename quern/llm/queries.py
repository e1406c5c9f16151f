"""The registered queries of this subpackage: thin digests over the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, licenses, lmscore, mixing, neardup, packing, quality, sharding, substring


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: The tokenizer's vocabulary file and the id that ends a document.
TOKENIZER, END_ID = "word_bpe_49k.json", 1


def tokenizer() -> packing.WordEncoder:
    import public_tokenizers

    return packing.WordEncoder(public_tokenizers.path(TOKENIZER), END_ID)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), tokenizer)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(documents(spark, sf_dir), carry={"text_crc32": F.crc32(F.coalesce("text", F.lit("")))})
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    vocab, words = lmscore.lexicon(docs)
    return lmscore.score(docs, vocab, lmscore.fit(docs, vocab), words=words)


#: Target weights follow the sources' bytes to this power, so small sources weigh more than they are.
MIX_POWER = 0.5


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    profiles = langid.learn(docs, where=~held_out)
    return langid.predict(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(documents(spark, sf_dir), power=MIX_POWER).drop("fp")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, F.col("vec_id") % 100 == 0)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.dedup(documents(spark, sf_dir))
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    base, own = F.transform("places", lambda p: p["label"]), F.transform("matches", lambda m: m["template"])
    words = F.transform("places", lambda p: p["word"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir), words=2)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality.judge(documents(spark, sf_dir), report=counts)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *counts, failed.alias("base_failed"), "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_sharding": op2_sharding,
    "op3_langid": op3_langid,
    "op4_lmscore": op4_lmscore,
    "op5_mixing": op5_mixing,
    "op6_ann": op6_ann,
    "op7_substring": op7_substring,
    "op8_licenses": op8_licenses,
    "op9_neardup": op9_neardup,
    "op10_quality": op10_quality,
}

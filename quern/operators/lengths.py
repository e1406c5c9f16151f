"""Length profiles of texts, and the chunk sizes that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Percentiles of a profile.
PERCENTILES = (1, 5, 25, 50, 75, 80, 90, 95, 99, 99.5)
#: Bounds of the derived sizes.
SHORT_RANGE, MEDIUM_RANGE, SEMANTIC_FACTOR = (64, 256), (256, 1024), 1.5


def label(p: float) -> str:
    return f"p{p:g}".replace(".", "_")


def length_profile(df: DataFrame, tokens: str = "n_tokens", chars: str = "n_chars", by: str = "lang") -> DataFrame:
    """By language: exact percentiles (linear), least, most and mean of tokens and characters, and characters for each token."""
    found = [F.count("*").alias("n")]
    for column, name in ((tokens, "tokens"), (chars, "chars")):
        at = F.percentile(column, F.array(*[F.lit(p / 100) for p in PERCENTILES]))
        found += [F.round(at[i], 4).alias(f"{name}_{label(p)}") for i, p in enumerate(PERCENTILES)]
        found += [F.min(column).cast("long").alias(f"{name}_min"), F.max(column).cast("long").alias(f"{name}_max"), F.round(F.avg(column), 4).alias(f"{name}_mean")]
    return df.groupBy(by).agg(*found, F.round(F.sum(chars) / F.sum(tokens), 4).alias("chars_per_token"))


def _clip(x: Column, low: Column | int, high: Column | int) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, as_col(low)), as_col(high))


def derive_thresholds(profile: DataFrame, by: str = "lang") -> DataFrame:
    """By language: short, medium and semantic sizes; halves round to even."""
    short = _clip(F.bround("tokens_p80").cast("int"), *SHORT_RANGE)
    medium = _clip(F.bround("tokens_p99_5").cast("int"), F.greatest(F.lit(MEDIUM_RANGE[0]), 2 * F.col("short")), MEDIUM_RANGE[1])
    semantic = F.least(SEMANTIC_FACTOR * F.col("short"), F.col("medium").cast("double")).cast("int")
    return profile.select(by, "tokens_p80", "tokens_p99_5").withColumn("short", short).withColumn("medium", medium).withColumn("semantic", semantic).select(by, "short", "medium", "semantic")


def band_shares(df: DataFrame, thresholds: DataFrame, tokens: str = "n_tokens", by: str = "lang") -> DataFrame:
    """By language: texts of up to the short size, above the medium one, and between, with percentages. ``thresholds`` has a row for each language."""
    joined = df.join(thresholds, by)
    n, out = F.count("*"), []
    bands = {"short": F.col(tokens) <= F.col("short"), "long": F.col(tokens) > F.col("medium")}
    bands["medium"] = ~bands["short"] & ~bands["long"]
    for name, test in bands.items():
        count = F.sum(test.cast("long"))
        out += [count.alias(f"n_{name}"), F.round(100 * count / n, 2).alias(f"pct_{name}")]
    return joined.groupBy(by).agg(*out)


def length_ratio(profile: DataFrame) -> DataFrame:
    """One row: the largest median over the smallest."""
    return profile.agg(F.round(F.max("tokens_p50") / F.min("tokens_p50"), 4).alias("ratio"))

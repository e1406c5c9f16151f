"""Registered queries of the subpackage against SQL, and the pipeline against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm.queries import QUERIES, tokenizer
from quern.llm.sql import ORACLE

from ..compare import database, rows, sql
from . import brute


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), sql(database(sf), ORACLE[name])
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for d, t in texts.items():
        n, chars, symbols, dup, repeat = brute.quality(t)
        lines = sum(1 for x in t.split("\n") if brute.WORD.search(x))
        upper, letters, digits = (sum(f(c) for c in t if c.isascii()) for f in (str.isupper, str.isalpha, str.isdigit))
        if n >= 50 and 100 * repeat <= 50 * n and 10 * symbols <= n and 10 * upper <= 3 * letters and 2 * n <= chars <= 40 * n and 100 * dup <= 50 * lines and 2 * digits <= chars:
            kept[d] = t
    root = brute.components(sorted(kept.items()), 5)
    kept = {d: t for d, t in kept.items() if root[d] == d}
    left = {d: [w for i, w in enumerate(words) if i not in gone] for d, (words, gone) in brute.cut_repeats(sorted(kept.items())).items()}

    stage, at = docs, {}
    for name, f in corpus_pipeline.STAGES:
        stage = f(spark, stage, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert stage.columns == docs.columns
            at[name] = {r.doc_id: r for r in stage.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert set(at[names[1]]) == set(kept) and {d: brute.WORD.findall(r.text) for d, r in at[names[2]].items()} == left
    assert all(r.n_chars == len(r.text) for r in at[names[2]].values()) and set(at[names[3]]) == set(left)
    whole = tokenizer().loaded.whole
    want = sum(len(whole.encode(" ".join(w), add_special_tokens=False).ids) + 1 for w in left.values())
    assert stage.agg(F.sum("length")).head()[0] == want
    assert stage.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    got = corpus_pipeline.run(spark, sf)
    assert got.agg(F.sum("length")).head()[0] == want and got.select("doc_id").distinct().count() == len(left)
    assert np.frombuffer(got.head().ids, "<u4").size == got.head().length


@pytest.mark.parametrize("name", ["odd", "none", "nulls"])
def test_pipeline_takes_anything(spark, sf, name, request):
    stage = request.getfixturevalue(name)
    columns = stage.columns
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        stage = f(spark, stage, sf)
        if k < 4:
            assert stage.columns == columns
    got = stage.collect()
    assert (len(got) == 0) == (name != "odd")


@pytest.mark.parametrize("given, want", [("10000", "1000"), ("0", "1000"), ("300", "300")])
def test_pipeline_hands_few_rows_to_workers(spark, sf, given, want):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs, before = spark.read.parquet(f"{sf}/documents.parquet").limit(40), spark.conf.get(key)
    try:
        for _, f in corpus_pipeline.STAGES:
            spark.conf.set(key, given)
            f(spark, docs, sf)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)

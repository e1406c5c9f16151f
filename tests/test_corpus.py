import json
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import schemas
from quern.config import LANGUAGES, Config
from quern.functions import text
from quern.operators import chunking, corpus, dense, evaluate, ranking, sparse, validate
from quern.plans.q_answers import answered
from quern.plans.served import one_index
from quern.sources import tables
from quern.streaming.answers import read_questions, stream_answers

RAW = "source_lang string, target_lang string, query_id long, query_type string, passages struct<English_passages:array<string>,Translated_passages:array<string>,is_selected:array<long>>, Eng_Query string, Eng_Answer string, query string, Answer string, row_index long"


def raw(spark, rows):
    return spark.createDataFrame([("eng_Latn", lang, q, "D", (en, tr, sel), f"q{q}", "a", None if q == 2 else f"प्रश्न{q}", "उ", i) for i, (lang, q, en, tr, sel) in enumerate(rows)], RAW)


ROWS = [("hin_Deva", 1, ["a", "b"], ["अ", " "], [0, 1]), ("mar_Deva", 2, ["c"], ["क"], [0]), ("tam_Taml", 1, [], [], []), ("hin_Deva", 3, ["x", "y", "z"], ["प", "फ", "ब"], [1])]


def test_extraction_keeps_places_and_skips_empty_texts(spark):
    got = {r.passage_uid: r for r in corpus.extract_passages(raw(spark, ROWS), LANGUAGES[0], 10).collect()}
    assert set(got) == {"hi_q1_p0", "hi_q2_p0", "hi_q3_p0", "hi_q3_p1", "hi_q3_p2"}
    assert got["hi_q3_p2"].is_selected == 0 and got["hi_q3_p0"].is_selected == 1
    english = corpus.extract_passages(raw(spark, ROWS), LANGUAGES[1], 1)
    assert sorted(r.text for r in english.collect()) == ["a", "b"]
    report = corpus.extraction_report(raw(spark, ROWS), LANGUAGES[0], 10).head()
    assert (report.rows, report.passages, report.skipped_empty, report.misaligned, report.repeats) == (4, 6, 1, 1, 1)


def test_repeated_queries_get_a_suffix(spark):
    got = corpus.extract_passages(raw(spark, [ROWS[0], ROWS[0]]), LANGUAGES[1], 10)
    assert {r.document_id for r in got.collect()} == {"q1_p0", "q1_p1", "q1d2_p0", "q1d2_p1"}


def test_normalize(spark):
    got = {r.document_id: r for r in corpus.normalize(raw(spark, ROWS[:3]), source="s").collect()}
    assert set(got) == {"hi_1_p0", "hi_1_p1", "mr_2_p0"}
    assert got["hi_1_p0"].answerable and not got["mr_2_p0"].answerable and got["mr_2_p0"].language == "mr"
    with pytest.raises(Exception, match="unlike length"):
        corpus.normalize(raw(spark, [ROWS[3]])).collect()


def test_schemas_are_checked(spark):
    df = spark.createDataFrame([], schemas.CHUNK)
    assert schemas.assert_schema(df, schemas.CHUNK, exact=True) is df
    with pytest.raises(schemas.SchemaMismatch):
        schemas.assert_schema(df.drop("text"), schemas.CHUNK)


def test_chunks_are_valid_for_each_strategy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("document_id"), "lang", "text").limit(40)
    sizes = spark.createDataFrame([("en", 64, 256, 96)], "lang string, short int, medium int, semantic int")
    for name in ("fixed", "semantic", "adaptive"):
        made = chunking.chunk_corpus(docs, name, sizes, "document_id").withColumn("n_tokens", F.lit(1))
        report = {r.check: r.passed for r in validate.validate_chunks(made, docs, name, 256).collect()}
        assert all(report.values()), (name, report)
    blank = spark.createDataFrame([(1, "en", "  "), (2, "en", None)], "document_id long, lang string, text string")
    assert chunking.chunk_corpus(blank, "adaptive", id_col="document_id").count() == 0


def test_lexical_index_survives_a_round_trip(spark, tmp_path):
    rows = [(1, "hi", "मैनहट्टन परियोजना की सफलता"), (2, "hi", "आर्थिक विकास"), (3, "en", "hip replacement cost"), (4, "en", "")]
    chunks = spark.createDataFrame(rows, "chunk_id long, lang string, text string")
    index = tables.load_index(spark, f"file://{tmp_path}/ix", lambda: sparse.build_index(chunks))
    asked = spark.createDataFrame([(1, "परियोजना"), (2, "cost of hip hip"), (3, "nothing here")], "qid long, text string")
    got = [(r.qid, r.chunk_id) for r in sparse.search(index, asked, 5).collect()]
    assert sorted(got) == [(1, 1), (2, 3)]
    again = tables.load_index(spark, f"file://{tmp_path}/ix")
    assert again.stats.count() == 2 and again.lengths.where("dl = 0").count() == 1


def test_upsert_twice_changes_nothing(spark):
    old, new = (spark.createDataFrame(r, "k long, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    once = tables.upsert(old, new, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, tables.upsert(once, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_reports_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, "ok"), (2, None)], "n long, reason string")
    tables.write_report(df, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())[0] == {"n": 1, "reason": "ok"}
    assert tables.markdown(df).splitlines()[0] == "| n | reason |"
    for _ in range(2):
        tables.append_log(df, f"file://{tmp_path}/log")
    assert tables.read_log(spark, f"file://{tmp_path}/log", df.schema).count() == 4
    tables.write_table(df, f"file://{tmp_path}/t", rows_per_file=1)
    assert tables.table_metadata(spark, f"file://{tmp_path}/t").agg(F.sum("rows")).head()[0] == 2
    placed = tables.read_with_position(spark, f"file://{tmp_path}/t")
    assert {"source_file", "row_index"} <= set(placed.columns)
    ready = {r.artefact: r.ready for r in tables.readiness(spark, {"t": f"file://{tmp_path}/t", "x": f"file://{tmp_path}/x"}).collect()}
    assert ready == {"t": True, "x": False}


def test_recall(spark):
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "b"), (1, 4, "c"), (2, 1, "x")], "qid long, rank int, document_id string")
    qrels = spark.createDataFrame([(1, "c"), (2, "y"), (3, "z")], "qid long, document_id string")
    got = evaluate.document_recall(hits, qrels, qrels.select("qid")).head()
    assert (got.n_queries, got.recall_1, got.recall_3, got.recall_5) == (3, 0.0, 0.3333, 0.3333)
    none = evaluate.document_recall(hits, qrels, qrels.select("qid").limit(0)).head()
    assert none.n_queries == 0 and none.recall_1 == 0.0
    texts = spark.createDataFrame([(1, "q"), (2, " "), (4, "q"), (3, None)], "qid long, text string")
    assert [r.qid for r in evaluate.evaluated_queries(texts, qrels).collect()] == [1]


def test_latency_of_nothing_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "stage string, ms double")
    got = {r.stage: r for r in evaluate.latency(df, ["stage"]).collect()}
    assert got["a"].p50 == 2.0 and got["a"].p100 == 3.0 and got["b"].n == 0 and got["b"].p50 is None


def test_confidence_levels(spark):
    from quern.operators.answers import confidence

    df = spark.createDataFrame([([0.9] + [0.8] * 19,), ([0.8] * 20,), ([],)], "s array<double>")
    assert [r[0] for r in df.select(confidence(F.col("s"))["level"]).collect()] == ["high", "low", "none"]


def test_queries_are_encoded_once_and_searched_in_blocks(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = vectors.where("chunk_id < 20").select(F.col("chunk_id").alias("qid"), F.col("vector").alias("qvec"))
    whole, parts = (sorted(map(tuple, dense.knn(asked, vectors, 3, block=b).collect())) for b in (100, 7))
    assert whole == parts and len(whole) == 60
    texts = spark.createDataFrame([(1, "same words"), (2, "same words"), (3, None)], "qid long, text string")
    got = {r.qid: r.v for r in dense.encode(texts, vector="v", kind="query").collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-12 and sum(got[3]) == 0


def test_stream_answers_each_question_once(spark, sf, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.json").write_text('{"qid": 1, "text": "the of and in"}\n{"qid": 2, "text": "hi"}\n')
    run = lambda: stream_answers(read_questions(spark, str(source)), lambda b: answered(spark, sf, b), f"file://{out}", f"file://{tmp_path}/cp").awaitTermination()
    run()
    run()
    got = spark.read.parquet(f"file://{out}")
    assert got.where("event = 'done'").count() == 2 and got.where("qid = 2").count() == 2
    assert got.where("event = 'done' AND qid = 2").head().payload.startswith('{"answer_mode":"refused","reason":"query_too_short"')


def test_health_of_an_empty_index(spark):
    from quern.plans.answering import health

    chunks = spark.createDataFrame([], "chunk_id long, lang string, text string")
    vectors = spark.createDataFrame([], "chunk_id long, vector array<double>")
    assert health(sparse.build_index(one_index(chunks)), vectors, Config()).head().status == "empty"


def test_scripts_are_those_of_all_texts(spark):
    rows = [(i, "hi", "short latin text") for i in range(60)] + [(100 + i, "hi", "नमस्ते दुनिया " * 60) for i in range(60)]
    rows += [(300, "ru", "x" * 400 + "Привет мир " * 100), (301, "no", "123 ?!"), (302, "no", None), (303, "tie", "αβγ"), (304, "tie", "abc"), (305, None, "ελληνικά")]
    docs = spark.createDataFrame(rows, "document_id long, lang string, text string").repartition(3)
    got = {r.lang: r.script for r in corpus.script_by_language(docs, "document_id").collect()}
    assert got == {"hi": "DEVANAGARI", "ru": "CYRILLIC", "no": "UNKNOWN", "tie": "GREEK", None: "GREEK"}
    heads = {r.lang: r.script for r in corpus.script_by_language(docs, "document_id", 50).collect()}
    assert heads["hi"] == heads["ru"] == "LATIN"


def test_offsets_and_tokens_by_the_parent(spark):
    rows = [(1, "  ab cd  ef ", ["ab cd", "ef", "", "gone now"]), (2, None, ["x y"]), (3, "", []), (4, "aa aa aa", ["aa", "aa aa"])]
    df = spark.createDataFrame(rows, "id int, text string, pieces array<string>")
    got = {r.id: r for r in chunking.with_chunk_tokens(df, tokens="n").select("id", text.token_offsets("text").alias("at"), "n").collect()}
    assert [(a.start, a.end) for a in got[1].at] == [(2, 4), (5, 7), (9, 11)] and got[2].at == got[3].at == []
    assert got[1].n == [2, 1, 0, 2] and got[2].n == [2] and got[3].n == [] and got[4].n == [1, 2]


def test_words_as_one_pattern_finds_them(spark):
    rows = [("İ ΑΣ' 'ok' a -- \"quoted,\" (x) it's a,b …end… 1. ab .cd. \U0001f600\U0001f600 ,a",), (None,), ("",), (" . ",)]
    got = [r.w for r in spark.createDataFrame(rows, "t string").select(text.tokenize("t").alias("w")).collect()]
    assert got == [["i̇", "ας", "ok", "quoted", "it's", "a,b", "end", "ab", "cd", "\U0001f600\U0001f600"], [], [], []]
    one = spark.createDataFrame([("a .b cd.",)], "t string")
    assert one.select(text.tokenize("t", shortest=1).alias("w")).head().w == ["a", "b", "cd"] and one.select(text.tokenize("t", shortest=3).alias("w")).head().w == []


def test_footers_dimensions_and_reports(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    df = spark.range(10).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    tables.assert_dimension(df, path)
    df.repartition(2).write.parquet(path)
    found = tables.footers(spark, path).collect()
    assert sum(r.rows for r in found) == 10 and len(found) == 2 and "vector" in found[0].fields and all(r.bytes > 0 for r in found)
    tables.assert_dimension(df, path)
    with pytest.raises(ValueError):
        tables.assert_dimension(df.withColumn("vector", F.array(F.lit(1.0))), path)
    tables.drop_table(spark, path)
    assert not tables.exists(spark, path)
    tables.write_report(df.select("id"), f"file://{tmp_path}/deep/r.json")
    assert "9" in (tmp_path / "deep" / "r.json").read_text()


def test_evenly_spaced_follows_the_rows(spark):
    for n, k in ((500, 20), (2000, 20), (7, 3), (3, 20), (5, 1)):
        got = sorted(r.id for r in ranking.evenly_spaced(spark.range(n), "id", k).collect())
        assert got == ([i * (n - 1) // max(1, k - 1) for i in range(k)] if k < n else list(range(n)))


def test_exact_search_in_blocks_of_queries(spark):
    rows = [(i, [float(i % 7), float(i % 3), 1.0], i % 2) for i in range(60)] + [(99, None, 1), (98, [1.0], 1)]
    vectors = spark.createDataFrame(rows, "chunk_id int, vector array<double>, label int").repartition(3)
    queries = spark.createDataFrame([(i, [float(i), 1.0, -1.0]) for i in range(9)], "qid int, qvec array<double>")
    want = {}
    for q in range(9):
        scored = [(-round(q * v[0] + v[1] - v[2], 6), i, label) for i, v, label in rows if v and len(v) == 3]
        want[q] = [(i, -s) for s, i, _ in sorted(scored)[:5]]
        want[q, "odd"] = [(i, -s) for s, i, label in sorted(scored)[:20] if label == 1][:5]
    for block in (4096, 4):
        for name, options in (((), {}), (("odd",), {"extra": ("label",), "where": F.col("label") == 1, "overfetch": 4})):
            got = defaultdict(list)
            for r in dense.knn(queries, vectors, 5, block=block, **options).orderBy("qid", "rank").collect():
                got[(r.qid, *name) if name else r.qid].append((r.chunk_id, r.score))
            assert all(got[k] == v for k, v in want.items() if isinstance(k, tuple) == bool(name))
    assert dense.knn(queries.limit(0), vectors, 5).count() == 0


def test_documents_that_hold_a_text(spark):
    docs = spark.createDataFrame([(1, "x  one two three four five six seven eight nine y"), (2, "one two three four five six seven eight"), (3, "tiny item here"), (4, None), (5, "")], "doc_id int, text string")
    items = spark.createDataFrame([(10, "one two three four five six seven eight"), (11, "tiny item"), (12, "one two three four five six seven  eight"), (13, "")], "qid int, text string")
    got = sorted(tuple(r) for r in evaluate.holding(docs, items).collect())
    assert got == [(10, 1), (10, 2), (11, 3)]


def test_hashed_neighbours_make_no_rows_for_pairs(spark):
    rng = np.random.default_rng(4)
    unit = rng.standard_normal((400, 16))
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(unit.tolist())] + [(400, None), (401, [None] * 16)], "chunk_id long, vector array<double>").repartition(3)
    queries = vectors.where("chunk_id % 20 = 0 AND chunk_id < 400").toDF("qid", "qvec")
    apart = np.sqrt(np.maximum(2 - 2 * unit @ unit.T, 0))
    line = np.random.default_rng(7).standard_normal((16, 3))
    bucket = np.floor(unit @ (line / np.sqrt((line * line).sum(0))) / 0.2)
    near = (apart < 1.1) & (bucket[:, None] == bucket[None]).any(-1)
    want = [(q, rank + 1, c) for q in range(0, 400, 20) for rank, c in enumerate(sorted(np.flatnonzero(near[q]).tolist(), key=lambda c: (apart[q, c], c))[:5])]
    for block in (100, 6):
        found = dense.knn_lsh(queries, vectors, 5, threshold=1.1, bucket_length=0.2, tables=3, block=block)
        assert sorted((r.qid, r.rank, r.chunk_id) for r in found.collect()) == want
        assert all(abs(r.score - (1 - apart[r.qid, r.chunk_id] ** 2 / 2)) < 1e-6 for r in found.collect())
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Generate" not in plan
    assert 0 < len(want) and dense.knn_lsh(queries.limit(0), vectors, 5).count() == 0

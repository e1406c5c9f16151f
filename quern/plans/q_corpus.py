"""Queries over texts, corpora, lengths and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import chunking, corpus, lengths, ranking, validate
from . import views
from .registry import query, quoted, values
from .views import LENGTHS, PASSAGES, sentences_sql, terms_sql, tokens_sql

SCRIPTS = [(1, "नमस्ते दुनिया"), (2, "hello नमस्ते दुनिया"), (3, "Привет мир"), (4, "12345 !?"), (5, "hello world"), (6, "ab कख")]
DEVA_SQL = r"[\x{0904}-\x{0939}\x{093D}\x{0950}\x{0958}-\x{0961}\x{0971}-\x{0980}]"
LATIN_SQL = r"[A-Za-zªº\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}]"
CYRILLIC_SQL = r"[\x{0400}-\x{0481}\x{048A}-\x{052F}]"
SCRIPT_TEXTS = f"(SELECT doc_id AS id, text FROM documents UNION ALL SELECT -id, text FROM {values(SCRIPTS, 'id, text')})"
SCRIPT_COUNTS = f"""(SELECT id, text, len(regexp_extract_all(head, '{DEVA_SQL}')) AS deva, len(regexp_extract_all(head, '{LATIN_SQL}')) AS latin,
  len(regexp_extract_all(head, '{CYRILLIC_SQL}')) AS cyr, head FROM (SELECT id, text, substr(text, 1, {{n}}) AS head FROM {SCRIPT_TEXTS}))"""


def script_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-i, t) for i, t in SCRIPTS], "id long, text string")
    return views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(own)


@query(f"SELECT doc_id, CAST(len(w) AS INT) AS n_terms, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {tokens_sql('text')} AS w FROM documents)")
def tokenize_terms(spark, sf_dir):
    words = views.table(spark, sf_dir, "documents").select("doc_id", text.tokenize("text").alias("w"))
    return words.select("doc_id", F.size("w").alias("n_terms"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(f"SELECT doc_id, CAST(len(w) AS INT) AS n_terms, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {tokens_sql('text', rules.STRIP_SHORT)} AS w FROM documents)")
def tokenize_legacy(spark, sf_dir):
    words = views.table(spark, sf_dir, "documents").select("doc_id", text.tokenize_legacy("text").alias("w"))
    return words.select("doc_id", F.size("w").alias("n_terms"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(f"SELECT doc_id, CAST(len(list_distinct(w)) AS INT) AS n_terms, md5(array_to_string(list_sort(list_distinct(w)), ' ')) AS digest FROM (SELECT doc_id, {terms_sql('text')} AS w FROM documents)")
def content_terms(spark, sf_dir):
    terms = views.table(spark, sf_dir, "documents").select("doc_id", text.content_terms("text").alias("w"))
    return terms.select("doc_id", F.size("w").alias("n_terms"), F.md5(F.array_join(F.array_sort("w"), " ")).alias("digest"))


@query(f"SELECT doc_id, CAST(len(s) AS INT) AS n_sentences, md5(array_to_string(s, chr(1))) AS digest FROM (SELECT doc_id, {sentences_sql('text')} AS s FROM documents)")
def sentence_split(spark, sf_dir):
    parts = views.table(spark, sf_dir, "documents").select("doc_id", text.split_sentences("text").alias("s"))
    return parts.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "\u0001")).alias("digest"))


@query(f"SELECT id, CASE WHEN deva = 0 AND latin = 0 THEN 'Unknown' WHEN deva >= latin THEN 'Devanagari' ELSE 'Latin' END AS script FROM {SCRIPT_COUNTS.replace('{n}', '120')}")
def script_detect(spark, sf_dir):
    return script_texts(spark, sf_dir).select("id", text.detect_script("text").alias("script"))


@query(f"""SELECT id, CASE WHEN deva + latin + cyr = 0 THEN 'NONE' WHEN latin > deva AND latin > cyr OR latin = deva AND regexp_matches(head, '^[^\\x{{0904}}-\\x{{0980}}]*{LATIN_SQL}') THEN 'LATIN'
  WHEN deva > cyr THEN 'DEVANAGARI' ELSE 'CYRILLIC' END AS script, CASE WHEN deva + latin + cyr = 0 THEN 0.0 ELSE round(greatest(deva, latin, cyr) / (deva + latin + cyr), 6) END AS share
  FROM {SCRIPT_COUNTS.replace('{n}', '160')}""")
def script_dominant(spark, sf_dir):
    found = script_texts(spark, sf_dir).select("id", text.dominant_script("text").alias("s"))
    return found.select("id", "s.script", F.round("s.share", 6).alias("share"))


@query("""SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.1f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) ELSE printf('%.1f MB', n / 1048576) END AS size
  FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) AS n FROM documents)""")
def human_size(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", text.human_size("n_chars").alias("size"))


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS passage_idx, text, role, CAST(role = 'user' AS INT) AS is_user FROM conversations")
def explode_parallel(spark, sf_dir):
    rows = corpus.explode_parallel(views.nested(spark, sf_dir), ["texts", "roles", "is_user"])
    return rows.select("conv_id", "passage_idx", F.col("texts").alias("text"), F.col("roles").alias("role"), "is_user")


@query("SELECT conv_id, max(CAST(role = 'user' AS INT)) = 1 AS answerable FROM conversations GROUP BY conv_id")
def answerable_flag(spark, sf_dir):
    return views.nested(spark, sf_dir).select("conv_id", corpus.is_answerable("is_user").alias("answerable"))


CODES = [(1, "eng_Latn"), (2, "hin_Deva"), (3, "mar_Deva"), (4, "tam_Taml"), (5, None)]


@query(f"SELECT id, CASE code WHEN 'eng_Latn' THEN 'en' WHEN 'hin_Deva' THEN 'hi' WHEN 'mar_Deva' THEN 'mr' ELSE 'und' END AS lang FROM {values(CODES, 'id, code')}")
def map_language(spark, sf_dir):
    return spark.createDataFrame(CODES, "id int, code string").select("id", corpus.map_language("code").alias("lang"))


@query("""SELECT doc_id, CASE WHEN n = 1 THEN 'q' || k ELSE 'q' || k || 'd' || n END || '_p0' AS document_id
  FROM (SELECT doc_id, doc_id % 97 AS k, row_number() OVER (PARTITION BY doc_id % 97 ORDER BY doc_id) AS n FROM documents)""")
def occurrence_suffix(spark, sf_dir):
    keyed = views.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 97).alias("k"))
    return corpus.with_occurrence(keyed, "k", ["doc_id"]).select("doc_id", F.concat("doc_stem", F.lit("_p0")).alias("document_id"))


@query(f"""SELECT lang, count(*) AS passages, count(DISTINCT query_id) AS queries, CAST(sum(is_selected) AS BIGINT) AS selected,
  count(DISTINCT CASE WHEN is_selected = 1 THEN query_id END) AS queries_with_selected, count(DISTINCT document_id) AS documents, count(DISTINCT text) AS distinct_texts,
  round(count(*) / count(DISTINCT query_id), 4) AS passages_per_query FROM {PASSAGES} GROUP BY lang""")
def corpus_stats(spark, sf_dir):
    return corpus.corpus_stats(views.passages(spark, sf_dir))


@query(f"""WITH t AS (SELECT id, CASE WHEN id < 0 THEN 'own' || (id % 3) ELSE lang END AS lang, text FROM (SELECT doc_id AS id, lang, text FROM documents UNION ALL SELECT -id, NULL, text FROM {values(SCRIPTS, 'id, text')})),
  n AS (SELECT lang, s.script AS script, sum(s.n) AS n, min(id) FILTER (s.n > 0) AS first FROM (SELECT lang, id, unnest([{{'script': 'LATIN', 'n': len(regexp_extract_all(text, '{LATIN_SQL}'))}}, {{'script': 'DEVANAGARI', 'n': len(regexp_extract_all(text, '{DEVA_SQL}'))}},
    {{'script': 'CYRILLIC', 'n': len(regexp_extract_all(text, '{CYRILLIC_SQL}'))}}]) AS s FROM t) GROUP BY ALL)
  SELECT lang, CASE WHEN n = 0 THEN 'UNKNOWN' ELSE script END AS script FROM n QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, first, script) = 1""")
def corpus_scripts(spark, sf_dir):
    own = spark.createDataFrame([(-i, f"own{-(i % 3)}", t) for i, t in SCRIPTS], "document_id long, lang string, text string")
    return corpus.script_by_language(views.chunks(spark, sf_dir).select("document_id", "lang", "text").unionByName(own), "document_id")


@query("""SELECT 'lang' AS "column", lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL
  SELECT 'source', source, count(*) FROM documents GROUP BY source""")
def value_distribution(spark, sf_dir):
    return corpus.value_distribution(views.table(spark, sf_dir, "documents"), ["lang", "source"])


@query("SELECT CAST(size AS INT) AS size, count(*) AS n FROM (SELECT count(*) AS size FROM conversations GROUP BY conv_id) GROUP BY size")
def list_size_histogram(spark, sf_dir):
    return corpus.size_histogram(views.nested(spark, sf_dir), "texts")


@query(f"""SELECT a.lang AS lang_a, b.lang AS lang_b, count(*) AS shared FROM (SELECT DISTINCT query_id, lang FROM {PASSAGES}) a
  JOIN (SELECT DISTINCT query_id, lang FROM {PASSAGES}) b ON a.query_id = b.query_id AND a.lang < b.lang GROUP BY ALL""")
def lang_overlap(spark, sf_dir):
    return corpus.language_overlap(views.passages(spark, sf_dir), "query_id")


def _profile_sql() -> str:
    cols = ["count(*) AS n"]
    for c, name in (("n_tokens", "tokens"), ("n_chars", "chars")):
        cols += [f"round(quantile_cont({c}, {p / 100}), 4) AS {name}_{lengths.label(p)}" for p in lengths.PERCENTILES]
        cols += [f"min({c}) AS {name}_min, max({c}) AS {name}_max, round(avg({c}), 4) AS {name}_mean"]
    return f"SELECT lang, {', '.join(cols)}, round(sum(n_chars) / sum(n_tokens), 4) AS chars_per_token FROM {LENGTHS} GROUP BY lang"


_THRESHOLDS = f"""SELECT lang, short, medium, CAST(floor(least(1.5 * short, medium)) AS INT) AS semantic FROM (
  SELECT lang, short, CAST(least(greatest(round_even(p995, 0), greatest(256, 2 * short)), 1024) AS INT) AS medium FROM (
  SELECT lang, CAST(least(greatest(round_even(tokens_p80, 0), 64), 256) AS INT) AS short, tokens_p99_5 AS p995 FROM ({_profile_sql()})))"""


def profile(spark, sf_dir):
    return lengths.length_profile(views.lengths(spark, sf_dir))


@query(_profile_sql())
def length_profile(spark, sf_dir):
    return profile(spark, sf_dir)


@query(_THRESHOLDS)
def derive_thresholds(spark, sf_dir):
    return lengths.derive_thresholds(profile(spark, sf_dir))


@query(f"""SELECT l.lang, {', '.join(f"CAST(sum(CAST({t} AS INT)) AS BIGINT) AS n_{n}, round(100 * sum(CAST({t} AS INT)) / count(*), 2) AS pct_{n}" for n, t in
  (("short", "n_tokens <= short"), ("long", "n_tokens > medium"), ("medium", "(n_tokens > short AND n_tokens <= medium)")))} FROM {LENGTHS} l JOIN ({_THRESHOLDS}) t ON t.lang = l.lang GROUP BY l.lang""")
def band_shares(spark, sf_dir):
    return lengths.band_shares(views.lengths(spark, sf_dir), lengths.derive_thresholds(profile(spark, sf_dir)))


@query(f"SELECT round(max(tokens_p50) / min(tokens_p50), 4) AS ratio FROM ({_profile_sql()})")
def length_ratio(spark, sf_dir):
    return lengths.length_ratio(profile(spark, sf_dir))


def _fixed_sql(text_sql: str, size: int, overlap: int) -> str:
    """A list of windows; ``text_sql`` may be any expression."""
    p, stride = rf"regexp_extract_all({text_sql}, '\S+\s*')", size - overlap
    last = f"greatest(CAST(ceil((len({p}) - {size}) / {stride}.0) AS BIGINT), 0)"
    cut = rf"regexp_replace(array_to_string(({p})[k * {stride} + 1 : k * {stride} + {size}], ''), '\s+$', '')"
    return f"CASE WHEN len({p}) = 0 THEN [] ELSE list_transform(range(0, {last} + 1), lambda k: {cut}) END"


def _digest(spark, sf_dir, made) -> DataFrame:
    rows = views.table(spark, sf_dir, "documents").select("doc_id", made.alias("c"))
    return rows.select("doc_id", F.size("c").alias("n_chunks"), F.md5(F.array_join("c", "\u0001")).alias("digest"))


@query(f"SELECT doc_id, CAST(len(c) AS INT) AS n_chunks, md5(array_to_string(c, chr(1))) AS digest FROM (SELECT doc_id, {_fixed_sql('text', 64, 8)} AS c FROM documents)")
def chunk_fixed(spark, sf_dir):
    return _digest(spark, sf_dir, chunking.fixed("text", 64, 8))


@query(f"SELECT doc_id, CAST(len(c) AS INT) AS n_chunks, md5(array_to_string(c, chr(1))) AS digest FROM (SELECT doc_id, {_fixed_sql('text', 256, 32)} AS c FROM documents)")
def chunk_fixed_default(spark, sf_dir):
    return _digest(spark, sf_dir, chunking.fixed("text"))


def _packed_sql(limit: int, size: int = 256, overlap: int = 32) -> str:
    """doc_id and the list of packed sentences, by a recursive walk over each document's sentences."""
    return rf"""
s AS (SELECT doc_id, ss, len(ss) AS m FROM (SELECT doc_id, {sentences_sql('text')} AS ss FROM documents)),
walk AS (
  SELECT doc_id, 0 AS i, CAST([] AS VARCHAR[]) AS done, '' AS cur, 0 AS n FROM s
  UNION ALL
  SELECT doc_id, i + 1,
    CASE WHEN k > {limit} THEN list_concat(CASE WHEN n > 0 THEN list_append(done, cur) ELSE done END, {_fixed_sql('x', size, overlap)})
         WHEN n + k > {limit} THEN CASE WHEN n > 0 THEN list_append(done, cur) ELSE done END ELSE done END,
    CASE WHEN k > {limit} THEN '' WHEN n + k > {limit} THEN x ELSE cur || x END,
    CASE WHEN k > {limit} THEN 0 WHEN n + k > {limit} THEN k ELSE n + k END
  FROM (SELECT w.doc_id, w.i, w.done, w.cur, w.n, s.ss[w.i + 1] AS x, len(regexp_extract_all(s.ss[w.i + 1], '\S+')) AS k
        FROM walk w JOIN s ON s.doc_id = w.doc_id WHERE w.i < s.m)
),
packed AS (SELECT w.doc_id, CASE WHEN w.n > 0 THEN list_append(w.done, w.cur) ELSE w.done END AS c FROM walk w JOIN s ON s.doc_id = w.doc_id WHERE w.i = s.m),
sized AS (SELECT doc_id, text, len(regexp_extract_all(text, '\S+')) AS t FROM documents)"""


@query(f"""WITH RECURSIVE {_packed_sql(96)}
SELECT z.doc_id, CAST(len(c2) AS INT) AS n_chunks, md5(array_to_string(c2, chr(1))) AS digest
FROM (SELECT z.doc_id, CASE WHEN t <= 96 THEN [text] ELSE c END AS c2 FROM sized z JOIN packed p ON p.doc_id = z.doc_id) z""")
def chunk_semantic(spark, sf_dir):
    return _digest(spark, sf_dir, chunking.semantic("text", 96))


@query(f"""WITH RECURSIVE {_packed_sql(96)}
SELECT z.doc_id, CAST(len(c2) AS INT) AS n_chunks, md5(array_to_string(c2, chr(1))) AS digest
FROM (SELECT z.doc_id, CASE WHEN t <= 64 THEN [text] WHEN t <= 256 THEN CASE WHEN t <= 96 THEN [text] ELSE c END ELSE {_fixed_sql('text', 256, 32)} END AS c2
      FROM sized z JOIN packed p ON p.doc_id = z.doc_id) z""")
def chunk_adaptive(spark, sf_dir):
    return _digest(spark, sf_dir, chunking.adaptive("text", 64, 256, 96))


@query(f"SELECT lang, route, count(*) AS n FROM (SELECT lang, CASE WHEN n_tokens <= 128 THEN 'whole' WHEN n_tokens <= 512 THEN 'semantic' ELSE 'fixed' END AS route FROM {LENGTHS}) GROUP BY ALL")
def chunk_route(spark, sf_dir):
    return views.lengths(spark, sf_dir).groupBy("lang", chunking.route("n_tokens").alias("route")).agg(F.count("*").alias("n"))


def fixed_chunks(spark, sf_dir):
    made = views.passages(spark, sf_dir).withColumn("pieces", chunking.fixed("text", 64, 8))
    return corpus.make_chunks(made, "pieces", "document_id").withColumns({"n_tokens": text.count_tokens("text"), "chunk_strategy": F.lit("fixed")})


_CHUNKS = f"(SELECT doc_id, lang, c, len(regexp_extract_all(c, '\\S+')) AS t FROM (SELECT doc_id, lang, unnest({_fixed_sql('text', 64, 8)}) AS c FROM documents))"


@query(f"""SELECT lang, parents, chunks, round(chunks / parents, 4) AS chunks_per_parent, round(100 * single / parents, 4) AS one_chunk_pct,
  round(100 * (2 - least(chunks / parents, 2.0)), 4) AS single_chunk_proxy, tokens_min, tokens_p50, tokens_p90, tokens_p95, tokens_max, tokens_mean
  FROM (SELECT lang, count(*) AS parents, CAST(sum(n) AS BIGINT) AS chunks, CAST(sum(CAST(n = 1 AS INT)) AS BIGINT) AS single FROM (SELECT lang, doc_id, count(*) AS n FROM {_CHUNKS} GROUP BY ALL) GROUP BY lang)
  JOIN (SELECT lang, min(t) AS tokens_min, max(t) AS tokens_max, quantile_disc(t, 0.5) AS tokens_p50, quantile_disc(t, 0.9) AS tokens_p90, quantile_disc(t, 0.95) AS tokens_p95, round(avg(t), 4) AS tokens_mean FROM {_CHUNKS} GROUP BY lang) USING (lang)""")
def chunk_stats(spark, sf_dir):
    return chunking.chunk_stats(fixed_chunks(spark, sf_dir), "lang")


@query(f"""SELECT doc_id, CAST(len(list_filter(range(1, len(c)), lambda i: list_contains(list_transform(range(1, least(length(c[i]), length(c[i + 1])) + 1), lambda n: right(c[i], n) = left(c[i + 1], n)), true))) AS INT) AS overlapping
  FROM (SELECT doc_id, {_fixed_sql('text', 64, 8)} AS c FROM documents)""")
def chunk_overlap(spark, sf_dir):
    rows = views.table(spark, sf_dir, "documents").select("doc_id", chunking.fixed("text", 64, 8).alias("c"))
    pairs = F.filter(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c")), lambda a, b: text.longest_overlap(a, b)), lambda n: n > 0)
    return rows.select("doc_id", F.when(F.size("c") < 2, 0).otherwise(F.size(pairs)).alias("overlapping"))


_CHECKS = ["document_id_present", "text_present", "text_trimmed", "label_binary", "language_served", "index_not_negative", "document_unique", "not_empty", "places_contiguous"]


@query(f"""WITH p AS {PASSAGES}, v AS (SELECT 'document_id_present' AS "check", count(*) FILTER (document_id IS NULL) AS n FROM p UNION ALL
  SELECT 'text_present', count(*) FILTER (trim(text) = '') FROM p UNION ALL SELECT 'text_trimmed', count(*) FILTER (text <> trim(text)) FROM p UNION ALL
  SELECT 'label_binary', count(*) FILTER (is_selected NOT IN (0, 1)) FROM p UNION ALL SELECT 'language_served', count(*) FILTER (lang NOT IN ('de', 'en', 'es', 'fr')) FROM p UNION ALL
  SELECT 'index_not_negative', count(*) FILTER (passage_index < 0) FROM p UNION ALL SELECT 'document_unique', count(*) - count(DISTINCT (document_id, lang)) FROM p UNION ALL
  SELECT 'not_empty', CAST(count(*) = 0 AS INT) FROM p UNION ALL SELECT 'both_labels', 2 - count(DISTINCT is_selected) FROM p UNION ALL SELECT 'query_types', abs(3 - count(DISTINCT source)) FROM p UNION ALL
  SELECT 'answerable_correct', count(*) FILTER (answerable <> known) FROM (SELECT document_id % 11 <> 0 AND is_selected = 1 AS answerable, max(is_selected) OVER (PARTITION BY query_id) = 1 AS known FROM p) UNION ALL SELECT 'fields', 2 UNION ALL SELECT 'places_contiguous', count(*) FILTER (m >= c) FROM (SELECT max(passage_index) AS m, count(*) AS c FROM p GROUP BY query_id))
  SELECT "check", n = 0 AS passed, CAST(n AS BIGINT) AS violations FROM v""")
def validate_corpus(spark, sf_dir):
    rows = views.passages(spark, sf_dir).withColumn("answerable", (F.col("document_id") % 11 != 0) & (F.col("is_selected") == 1)).withColumnRenamed("source", "query_type")
    return validate.validate_passages(rows, [c for c, _ in views.LANGUAGES], types=3, fields=[c for c in rows.columns if c != "answerable"] + ["answer"])


def damaged_chunks(spark, sf_dir) -> DataFrame:
    """Fixed chunks of which some are wrong in each way that is checked."""
    d, i = F.col("document_id"), F.col("chunk_index")
    return fixed_chunks(spark, sf_dir).withColumns({
        "text": F.when((d % 13 == 0) & (i == 0), F.concat(F.lit("~"), "text")).when(d % 41 == 0, " ").otherwise(F.col("text")), "lang": F.when(d % 17 == 0, "xx").otherwise(F.col("lang")),
        "chunk_index": F.when((d % 19 == 0) & (i == 1), 7001).otherwise(i), "chunk_id": F.when(d % 23 == 0, "same").otherwise(F.col("chunk_id")),
        "document_id": F.when(d % 29 == 0, -d - 1).otherwise(d), "chunk_strategy": F.when(d % 31 == 0, "other").otherwise(F.col("chunk_strategy")), "n_tokens": F.when(d % 37 == 0, 99).otherwise(F.col("n_tokens")),
        "query_id": F.when(d % 43 == 0, -1).otherwise(F.col("query_id")), "is_selected": F.when(d % 47 == 0, 7).otherwise(F.col("is_selected")),
    })


_DAMAGED = f"""good AS (SELECT doc_id, i - 1 AS ix, doc_id || '_c' || (i - 1) AS chunk_id, c[i] AS text, lang FROM (SELECT doc_id, lang, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, lang, {_fixed_sql('text', 64, 8)} AS c FROM documents))),
par AS {PASSAGES},
bad AS (SELECT CASE WHEN g.doc_id % 13 = 0 AND ix = 0 THEN '~' || g.text WHEN g.doc_id % 41 = 0 THEN ' ' ELSE g.text END AS text, CASE WHEN g.doc_id % 17 = 0 THEN 'xx' ELSE g.lang END AS lang, CASE WHEN g.doc_id % 19 = 0 AND ix = 1 THEN 7001 ELSE ix END AS ix,
  CASE WHEN g.doc_id % 23 = 0 THEN 'same' ELSE chunk_id END AS chunk_id, CASE WHEN g.doc_id % 29 = 0 THEN -g.doc_id - 1 ELSE g.doc_id END AS id, g.doc_id % 31 = 0 AS other, CASE WHEN g.doc_id % 37 = 0 THEN 99 ELSE len(regexp_extract_all(g.text, '\\S+')) END AS n,
  CASE WHEN g.doc_id % 43 = 0 THEN -1 ELSE p.query_id END AS query_id, CASE WHEN g.doc_id % 47 = 0 THEN 7 ELSE p.is_selected END AS is_selected FROM good g JOIN par p ON p.document_id = g.doc_id),
joined AS (SELECT bad.*, p.document_id AS pid, p.text AS ptext, p.lang AS plang, p.query_id AS pquery, p.is_selected AS pselected FROM bad LEFT JOIN par p ON p.document_id = bad.id),
c AS (SELECT 'parent_known' AS "check", count(*) FILTER (pid IS NULL) AS n FROM joined UNION ALL SELECT 'same_language', count(*) FILTER (coalesce(lang <> plang, true)) FROM joined
  UNION ALL SELECT 'exact_substring', count(*) FILTER (coalesce(NOT contains(ptext, text), true)) FROM joined UNION ALL SELECT 'text_present', count(*) FILTER (trim(text) = '') FROM joined
  UNION ALL SELECT 'strategy_named', count(*) FILTER (other) FROM joined UNION ALL SELECT 'within_size', count(*) FILTER (n > 64) FROM joined UNION ALL SELECT 'chunk_unique', count(*) - count(DISTINCT chunk_id) FROM bad
  UNION ALL SELECT 'chunk_id_present', 0 UNION ALL SELECT 'same_query', count(*) FILTER (coalesce(query_id <> pquery, true)) FROM joined UNION ALL SELECT 'same_label', count(*) FILTER (coalesce(is_selected <> pselected, true)) FROM joined
  UNION ALL SELECT 'index_contiguous', count(*) FILTER (a <> 0 OR z <> m - 1) FROM (SELECT id, min(ix) AS a, max(ix) AS z, count(*) AS m FROM bad GROUP BY id)
  UNION ALL SELECT 'parents_kept', count(*) FROM par WHERE trim(text) <> '' AND document_id NOT IN (SELECT id FROM bad)
  UNION ALL SELECT 'neighbours_overlap', count(*) FROM (SELECT id, ix, text, lead(text) OVER (PARTITION BY id ORDER BY ix, chunk_id) AS next FROM bad) WHERE next IS NOT NULL AND NOT list_contains(list_transform(range(1, least(length(text), length(next)) + 1), lambda k: right(text, k) = left(next, k)), true)
  UNION ALL SELECT 'same_when_repeated', (SELECT count(*) FROM (SELECT chunk_id, text FROM bad EXCEPT ALL SELECT chunk_id, text FROM good)) + (SELECT count(*) FROM (SELECT chunk_id, text FROM good EXCEPT ALL SELECT chunk_id, text FROM bad)))"""


@query(f"WITH {_DAMAGED} SELECT \"check\", n = 0 AS passed, CAST(n AS BIGINT) AS violations FROM c")
def validate_chunks(spark, sf_dir):
    return validate.validate_chunks(damaged_chunks(spark, sf_dir), views.passages(spark, sf_dir), "fixed", 64, fixed_chunks(spark, sf_dir))


@query(f"SELECT doc_id, list_transform(c, lambda x: CAST(len(regexp_extract_all(x, '\\S+')) AS INT)) AS tokens FROM (SELECT doc_id, {_fixed_sql('text', 64, 8)} AS c FROM documents)")
def chunk_tokens(spark, sf_dir):
    rows = views.table(spark, sf_dir, "documents").select("doc_id", "text", chunking.fixed("text", 64, 8).alias("c"))
    return chunking.with_chunk_tokens(rows, "text", "c").select("doc_id", "tokens")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n, CAST(length(regexp_extract(text, '^\s*')) AS INT) AS first, CAST(length(regexp_replace(text, '\s+$', '')) AS INT) AS last FROM documents WHERE regexp_matches(text, '\S')")
def token_offsets(spark, sf_dir):
    rows = views.table(spark, sf_dir, "documents").select("doc_id", text.token_offsets("text").alias("t")).where(F.size("t") > 0)
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.col("t")[0]["start"].alias("first"), F.element_at("t", -1)["end"].alias("last"))


@query("SELECT count(*) AS rows, true AS groups_cover_rows FROM documents")
def parquet_footer(spark, sf_dir):
    from ..sources import tables

    groups = tables.footers(spark, f"{sf_dir}/documents.parquet")
    n = views.table(spark, sf_dir, "documents").count()
    return groups.agg(F.sum("rows").alias("rows"), ((F.sum("rows") == n) & (F.min("bytes") > 0)).alias("groups_cover_rows"))


@query("SELECT count(*) AS n, CAST(min(vec_id) = 0 AND max(vec_id) = count(*) - 1 AND count(DISTINCT vec_id) = count(*) AS BOOLEAN) AS contiguous FROM embeddings")
def index_contiguous(spark, sf_dir):
    vectors = views.table(spark, sf_dir, "embeddings")
    return vectors.agg(F.count("*").alias("n")).crossJoin(ranking.is_contiguous(vectors, "vec_id"))  # one row each

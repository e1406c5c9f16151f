import pytest
from pyspark.sql import functions as F

from quern.functions import rules, text
from quern.operators import chunking


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).head()[0]


@pytest.mark.parametrize(("given", "want"), [
    ("Hello, World!", ["hello", "world"]), ("a bb c ddd", ["bb", "ddd"]), ("परियोजना। थी।", ["परियोजना", "थी"]), ("well-known x", ["well-known"]), ("", []), (None, []), ("  \n ", []),
])
def test_tokenize(spark, given, want):
    assert one(spark, text.tokenize("t"), t=given) == want


def test_stopwords_are_left_out(spark):
    assert len(rules.STOPWORDS) == len(set(rules.STOPWORDS)) == 81
    assert one(spark, text.content_terms("t"), t="What is the hip hip operation?") == ["hip", "operation"]


@pytest.mark.parametrize(("given", "n"), [("पहला वाक्य। दूसरा वाक्य। तीसरा वाक्य।", 3), ("Pi is 3.14 today. Next one here.", 2), ("Really? Yes! ok", 3), ("", 0), ("no end", 1), ("Mr. smith went", 1)])
def test_sentences(spark, given, n):
    parts = one(spark, text.split_sentences("t"), t=given)
    assert len(parts) == n and "".join(parts) == given


@pytest.mark.parametrize(("given", "script", "guard"), [("hello", "Latin", "LATIN"), ("नमस्ते", "Devanagari", "DEVANAGARI"), ("123", "Unknown", "NONE"), ("ab कख", "Devanagari", "LATIN"), ("Привет", "Unknown", "CYRILLIC"), (None, "Unknown", "NONE")])
def test_scripts(spark, given, script, guard):
    assert one(spark, text.detect_script("t"), t=given) == script
    assert one(spark, text.dominant_script("t")["script"], t=given) == guard


def test_overlap_and_sizes(spark):
    assert one(spark, text.longest_overlap("a", "b"), a="one two three", b="three four") == 5
    assert one(spark, text.longest_overlap("a", "b"), a="abc", b="xyz") == 0
    assert one(spark, text.human_size(F.lit(3 * 1024**2)), t="x") == "3.0 MB"


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 120, 121, 500])
def test_fixed_windows(spark, n):
    words = [f"w{i}" for i in range(n)]
    made = one(spark, chunking.fixed("t", 64, 8), t="  " + " \n".join(words) + " ")
    assert [w for i, c in enumerate(made) for w in c.split()[8 if i else 0:]] == words
    assert all(len(c.split()) <= 64 for c in made) and (n == 0) == (not made)


def test_semantic_and_adaptive(spark):
    sentences = [" ".join([f"a{i}"] * 9) + " Z." for i in range(8)]
    full = " ".join(f"{s[0].upper()}{s[1:]}" for s in sentences)
    pieces = one(spark, chunking.semantic("t", 25), t=full)
    assert "".join(pieces) == full and all(len(p.split()) <= 25 for p in pieces) and len(pieces) == 4
    assert one(spark, chunking.semantic("t", 500), t=full) == [full]
    assert one(spark, chunking.adaptive("t", 100, 200), t=full) == [full]
    assert len(one(spark, chunking.adaptive("t", 10, 20), t=full)) == 1
    assert one(spark, chunking.route(F.lit(129)), t="") == "semantic"

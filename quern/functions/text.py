"""Text operators as Column expressions; all run in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from . import rules

#: Runs of non-blank characters: the offline stand-in for a model's sub-word tokens.
TOKEN = r"\S+"

#: Scripts told apart by name, and the property that holds their letters.
SCRIPTS = {
    "LATIN": "IsLatin", "DEVANAGARI": "IsDevanagari", "CYRILLIC": "IsCyrillic", "ARABIC": "IsArabic", "GREEK": "IsGreek",
    "HEBREW": "IsHebrew", "CJK": "IsHan", "HANGUL": "IsHangul", "HIRAGANA": "IsHiragana", "KATAKANA": "IsKatakana",
    "THAI": "IsThai", "TAMIL": "IsTamil", "TELUGU": "IsTelugu", "BENGALI": "IsBengali",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(text: Column | str) -> Column:
    """Without blanks at either end; null becomes empty."""
    return F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"(?U)^\s+|\s+$", "")


def squeezed(text: Column | str) -> Column:
    """Runs of blanks as single spaces."""
    return F.regexp_replace(_col(text), r"(?U)\s+", " ")


def tokenize(text: Column | str, strip: str = rules.STRIP, shortest: int = 2) -> Column:
    """Words between blanks, without punctuation at the edges, in lower case, of ``shortest`` characters or more; null gives none."""
    edge = r"[^\s" + "".join(c if c.isalnum() else "\\" + c for c in strip) + "]"
    # from the first to the last character of a word that is no punctuation; what stands between may be any
    core = f"(?U){edge}" if shortest < 2 else f"(?U){edge}(?=\\S{{{shortest - 1}}})\\S*{edge}"
    words = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(core if shortest >= 2 else f"{core}(?:\\S*{edge})?"), F.lit(0))
    return words if shortest <= 2 else F.filter(words, lambda w: F.length(w) >= shortest)


def tokenize_legacy(text: Column | str) -> Column:
    return tokenize(text, rules.STRIP_SHORT)


def content_terms(text: Column | str) -> Column:
    """Distinct words in order, without those that say nothing."""
    return F.array_except(F.array_distinct(tokenize(text)), F.array(*[F.lit(w) for w in rules.STOPWORDS]))


def split_sentences(text: Column | str) -> Column:
    """Sentences with their terminators; concatenated they give the text again, but for blank ones, which are dropped."""
    ends = f"(?U)({rules.TERMINATOR}{rules.CLOSING}(?=\\s|$)|\\.{rules.CLOSING}(?=\\s+{rules.OPENING}))"
    parts = F.split(F.regexp_replace(F.coalesce(_col(text), F.lit("")), ends, "$1\u0001"), "\u0001")
    return F.filter(parts, lambda s: s.rlike(r"(?U)\S"))


def letters_of(text: Column, prop: str) -> Column:
    return F.regexp_count(text, F.lit(f"[\\p{{L}}&&[\\p{{{prop}}}]]"))


def detect_script(text: Column | str, sample: int = 120) -> Column:
    """``Devanagari`` or ``Latin``, whichever has more letters at the head (Devanagari if equal), or ``Unknown``."""
    head = F.substring(F.coalesce(_col(text), F.lit("")), 1, sample)
    deva, latin = letters_of(head, "IsDevanagari"), letters_of(head, "IsLatin")
    return F.when((deva == 0) & (latin == 0), "Unknown").when(deva >= latin, "Devanagari").otherwise("Latin")


def dominant_script(text: Column | str, sample: int = 160) -> Column:
    """struct<script, share> of the head's letters; ties go to the script that occurs first; (``NONE``, 0) without letters."""
    head = F.substring(F.coalesce(_col(text), F.lit("")), 1, sample)
    letters = F.regexp_count(head, F.lit(r"\p{L}"))
    other = "[\\p{L}" + "".join(f"&&[^\\p{{{p}}}]" for p in SCRIPTS.values()) + "]"
    entry = lambda name, n, pattern: F.struct(n.alias("n"), (-F.regexp_instr(head, F.lit(pattern))).alias("first"), F.lit(name).alias("script"))
    found = [entry(name, letters_of(head, p), f"[\\p{{L}}&&[\\p{{{p}}}]]") for name, p in SCRIPTS.items()]
    top = F.array_max(F.array(*found, entry("OTHER", F.regexp_count(head, F.lit(other)), other)))
    return F.when(letters == 0, F.struct(F.lit("NONE").alias("script"), F.lit(0.0).alias("share"))).otherwise(F.struct(top["script"].alias("script"), (top["n"] / letters).alias("share")))


def script_letters(text: Column | str) -> Column:
    """map<script, letters> of the whole text; what is not ASCII is cut out once for all scripts."""
    other = "[\\p{L}" + "".join(f"&&[^\\p{{{p}}}]" for p in SCRIPTS.values()) + "]"

    def counted(x: Column) -> Column:
        counts = {name: letters_of(x["rest"], p) for name, p in SCRIPTS.items()} | {"OTHER": F.regexp_count(x["rest"], F.lit(other))}
        counts["LATIN"] += F.regexp_count(x["whole"], F.lit("[A-Za-z]"))
        return F.create_map(*[y for name, n in counts.items() for y in (F.lit(name), n.cast("long"))])

    whole = F.coalesce(_col(text), F.lit(""))
    return F.transform(F.array(F.struct(whole.alias("whole"), F.regexp_replace(whole, r"[\x00-\x7F]+", "").alias("rest"))), counted)[0]


def corpus_script(texts: Column | str, sample_texts: int = 50, sample: int = 400) -> Column:
    """The dominant script of the heads of an array of texts, ``UNKNOWN`` without letters."""
    heads = F.array_join(F.transform(F.slice(_col(texts), 1, sample_texts), lambda t: F.substring(F.coalesce(t, F.lit("")), 1, sample)), "")
    script = dominant_script(heads, sample_texts * sample)["script"]
    return F.when(script == "NONE", "UNKNOWN").otherwise(script)


def count_tokens(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(_col(text), F.lit(TOKEN)), F.lit(0))


@F.arrow_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def token_offsets(texts: pa.Array) -> pa.Array:
    """Where each token begins and ends, in characters; null has none. No JVM expression tells places of all matches."""
    found = [[{"start": m.start(), "end": m.end()} for m in re.finditer(TOKEN, t or "")] for t in texts.to_pylist()]
    return pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


def contains(parent: Column | str, chunk: Column | str) -> Column:
    return F.contains(_col(parent), _col(chunk))


def longest_overlap(left: Column | str, right: Column | str) -> Column:
    """Characters of the longest end of ``left`` with which ``right`` begins."""
    a, b = _col(left), _col(right)
    lengths = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.array_max(F.filter(lengths, lambda n: (n == 0) | (F.substr(b, F.lit(1), n) == F.right(a, n))))


def human_size(n: Column | str) -> Column:
    """Bytes with a unit and one decimal."""
    value = _col(n).cast("double")
    shown = lambda unit, power: F.format_string(f"%.1f {unit}", F.bround(value / 1024.0**power, 1))
    out = shown("TB", 4)
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(value < 1024.0 ** (power + 1), shown(unit, power)).otherwise(out)
    return out


def matches_any(text: Column | str, patterns: Iterable[str]) -> Column:
    """Whether one of the patterns occurs, whatever the case."""
    out = F.lit(False)
    for p in patterns:
        out = out | _col(text).rlike(f"(?i){p}")
    return out

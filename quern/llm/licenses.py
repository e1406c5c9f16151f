"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line, or a window of as many words as the template has that runs
over line ends, so that a notice is found however it wraps. It matches a template
when it holds at least ``THRESHOLD`` of the template's distinct words. All words of templates are put in one global
order, rarest in the corpus first, by document counts over all documents. A
block that matches must share one of the first ``|T| - need + 1`` words of the
template in that order (prefix filter), hold ``need`` words of templates at all
(length filter), and have enough words left on both sides after a shared one
(positional filter); what passes is compared in full, so the join is exact.

Each place of a prefix word takes the best window that holds it, the first of
equals; a window counts if no line that it touches matches by itself, and goes by
the line where it begins.

Templates are constants, so both the order and the index of prefixes are small
literals; a document whose text holds no prefix word is done after one pattern
match. Everything runs in the JVM on the row at hand, and nothing is shuffled
but the counts of template words.

Besides, every place of the base phrases is found, where their words follow one
another with any other characters between.

Edge cases: a null or empty text has no words, no places and no labels; long
texts are read whole; repeated rows are scanned one by one; an empty table gives
an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.8

#: Phrases that are looked for word by word, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices by which texts name their license.
NOTICES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "cc-by-4.0": "Licensed under the Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
    "mpl-2.0": "This source code form is subject to the terms of the Mozilla Public License, version 2.0.",
}

#: What licenses themselves say, a passage of each that the others do not share.
TEXTS = {
    "agpl-3.0-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause-text": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "boost-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.",
    "cc0-1.0-text": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1-text": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-text": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
}
TEMPLATES = NOTICES | TEXTS

_OTHER = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    """Lower-case words, in order."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(f"([^{_OTHER}]+)"), F.lit(1))


def _any_of(words: list[str]) -> str:
    """A pattern of words, branching by letter, so that each letter of a text is looked at about once."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(node: dict) -> str:
        ways = [c + pattern(below) for c, below in sorted(node.items()) if c]
        if not ways:
            return ""
        joined = ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"
        return f"(?:{joined})?+" if "" in node else joined

    return pattern(tree)


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often a lambda within names it."""
    return F.transform(F.array(value), use)[0]


def _split(template: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in template.lower()).split()


def _distinct(template: str) -> list[str]:
    return list(dict.fromkeys(_split(template)))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def word_order(text: Column, docs: DataFrame, words: list[str]) -> list[str]:
    """``words`` by the number of documents that hold them, rarest first; ties by the word."""
    held = F.array_intersect(F.split(F.lower(text), f"[{_OTHER}]+"), _strings(words))
    counts = dict(docs.select(F.explode(held).alias("word")).groupBy("word").count().collect())  # at most len(words) rows
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def _matches(text: Column, order: list[str], templates: dict[str, str], threshold: float) -> Column:
    """array<struct<block, template, containment>> of a text."""
    rank = {w: i for i, w in enumerate(order)}
    known, prefixes = [], set()
    for name, template in templates.items():
        own = sorted(rank[w] for w in _distinct(template))
        need = ceil(round(threshold * len(own), 9))
        prefix = own[: len(own) - need + 1]
        prefixes |= {order[r] for r in prefix}
        known.append(F.struct(
            F.lit(name).alias("name"), F.array(*map(F.lit, own)).alias("ranks"), F.array(*map(F.lit, prefix)).alias("prefix"), F.lit(need).alias("need"),
            _strings(_distinct(template)).alias("words"), _strings([order[r] for r in prefix]).alias("rare"), F.lit(len(_split(template))).alias("width"),
        ))
    may = text.rlike(f"(?i)(?<![^{_OTHER}]){_any_of(sorted(prefixes))}(?![^{_OTHER}])")

    ordered = _strings(order)
    ranks = lambda words: F.array_sort(F.transform(F.array_intersect(words, ordered), lambda w: F.array_position(ordered, w).cast("int") - 1))
    rare = _strings(sorted(prefixes))

    def parts(lines: Column, words: Column) -> Column:
        """The lines' ranks; all words, their lines, and the places of prefix words."""
        blocks = F.transform(lines, lambda line, i: F.struct(i.alias("block"), ranks(line).alias("ranks")))
        places = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(rare, w), i)), lambda i: i.isNotNull())
        return F.struct(blocks.alias("blocks"), words.alias("words"), F.flatten(F.transform(lines, lambda line, i: F.array_repeat(i, F.size(line)))).alias("line"), places.alias("places"))

    def passes(block: Column, t: Column) -> Column:
        b, own = block["ranks"], t["ranks"]
        shared = F.array_min(F.array_intersect(t["prefix"], b))  # null: the prefix filter rejects
        i, j = F.array_position(own, shared), F.array_position(b, shared)
        return (F.size(b) >= t["need"]) & shared.isNotNull() & (1 + F.least(F.size(own) - i, F.size(b) - j) >= t["need"])

    def found(t: Column, blocks: Column) -> Column:
        likely = F.filter(blocks, lambda b: passes(b, t))
        full = F.transform(likely, lambda b: F.struct(b["block"].alias("block"), t["name"].alias("template"), (F.size(F.array_intersect(b["ranks"], t["ranks"])) / F.size(t["ranks"])).alias("containment")))
        return F.filter(full, lambda m: m["containment"] * F.size(t["ranks"]) >= t["need"] - F.lit(1e-9))

    def wrapped(t: Column, x: Column, own: Column) -> Column:
        words, line, width, n = x["words"], x["line"], t["width"], F.size(x["words"])
        held = lambda start, length: F.size(F.array_intersect(F.slice(words, start + 1, length), t["words"]))
        first, last = lambda p: F.greatest(p - width + 1, F.lit(0)), lambda start: F.least(start + width, n) - 1
        likely = F.filter(x["places"], lambda p: F.array_contains(t["rare"], F.get(words, p)) & (F.get(line, first(p)) != F.get(line, last(p))) & (held(first(p), 2 * width - 1) >= t["need"]))
        best = F.transform(likely, lambda p: F.array_max(F.transform(F.sequence(first(p), p), lambda s: F.struct(held(s, width).alias("held"), (-s).alias("back")))))
        spans = F.transform(best, lambda b: F.struct(b["held"].alias("held"), F.get(line, -b["back"]).alias("a"), F.get(line, last(-b["back"])).alias("b")))
        alone = F.filter(spans, lambda w: (w["held"] >= t["need"]) & (w["a"] != w["b"]) & ~F.exists(own, lambda m: m["block"].between(w["a"], w["b"])))
        return F.array_distinct(F.transform(alone, lambda w: F.struct(w["a"].alias("block"), t["name"].alias("template"), (w["held"] / F.size(t["words"])).alias("containment"))))

    def both(t: Column, x: Column) -> Column:
        return _bind(found(t, x["blocks"]), lambda own: F.concat(own, wrapped(t, x, own)))

    none = F.array().cast("array<struct<block:int,template:string,containment:double>>")
    every = lambda x: F.flatten(F.transform(F.array(*known), lambda t: both(t, x)))
    lines = F.transform(F.split(text, "\n"), _words)
    return F.coalesce(F.when(may, _bind(lines, lambda ls: _bind(F.flatten(ls), lambda ws: _bind(parts(ls, ws), every)))), none)


def _places(text: Column, phrases: dict[str, str]) -> Column:
    """array<struct<word, label>> of the phrases' places."""
    ends = {p.split()[-2] for p in phrases}
    may = text.rlike(f"(?i)(?:{'|'.join(sorted(ends))})[{_OTHER}]+(?:{'|'.join(sorted({p.split()[-1] for p in phrases}))})")
    none = F.array().cast("array<struct<word:bigint,label:string>>")

    def at(words: Column, phrase: str, label: str) -> Column:
        own = phrase.split()
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(own)), lambda i: _all(F.get(words, i + k) == w for k, w in enumerate(own)))
        return F.when(F.size(words) >= len(own), F.transform(starts, lambda i: F.struct(i.cast("long").alias("word"), F.lit(label).alias("label"))))

    found = lambda words: F.flatten(F.array(*[F.coalesce(at(words, p, x), none) for p, x in phrases.items()]))
    return F.coalesce(F.when(may, _bind(_words(text), found)), none)


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Each row's id, ``n_words``, ``places`` of the phrases and ``matches`` of the templates."""
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    docs, text = pick(df, id_col, text_col), F.col(text_col)
    order = word_order(text, docs, sorted({w for t in templates.values() for w in _distinct(t)}))
    n_words = F.coalesce(F.regexp_count(text, F.lit(f"[^{_OTHER}]+")), F.lit(0)).cast("long")
    return docs.select(id_col, n_words.alias("n_words"), _places(text, phrases).alias("places"), _matches(text, order, templates, threshold).alias("matches"))

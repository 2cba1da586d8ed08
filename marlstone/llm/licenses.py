"""Licence notices by Dice similarity of word bigrams."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.text import NOT_ALNUM, ascii_lower, row_key, words

# Wording of public licences and of usual notices, one sentence each.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0."),
    ("apache-2.0", "You may not use this file except in compliance with the License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "Licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
]
# The texts of short public licences.
TEXTS = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("zlib", """This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
]
#: Where paragraphs end: at lines without words.
BLANK = r"\n[\x20\x09\x0D]*\n"
#: Where sentences end: a full stop, question or exclamation mark before white space. Lines end inside them.
SENTENCE = r"(?<=[.!?])[\x20\x09-\x0D]+"


def bigrams(w):
    """The distinct word bigrams; a single word is its own."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))
    return F.array_distinct(F.when(F.size(w) >= 2, pairs).otherwise(F.transform(w, lambda x: F.xxhash64(x))))


def templates(spark, rows=TEMPLATES) -> DataFrame:
    """license, bigram, n (its template's bigrams), template of every bigram of every template."""
    values = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(x).alias("license"), F.lit(t).alias("text")) for i, (x, t) in enumerate(rows)])
    # The words are made before the rows, else each bigram would make them again.
    made = F.transform(values, lambda x: F.struct(x["template"].alias("template"), x["license"].alias("license"), words(ascii_lower(x["text"]), NOT_ALNUM).alias("w")))
    df = spark.range(1).select(F.inline(made))
    df = df.withColumn("b", bigrams(F.col("w")))
    return df.select("template", "license", F.size("b").alias("n"), F.explode_outer("b").alias("bigram"))


def known_bigrams(spark, rows) -> list[int]:
    """The distinct bigrams of the templates: a rule table's, so as many at every size of the input."""
    return [r[0] for r in templates(spark, rows).select("bigram").distinct().collect()]


def stretches(sentences: DataFrame, most: int, known: list[int]) -> DataFrame:
    """k, o, id, first, last and words w of the lines of each sentence s, and of its runs of lines of up to most words.

    Lines without words don't count. Only lines with a bigram of a template, the one across their end included, start
    a stretch: without its first line any other has the same shared bigrams and not more of its own, so it is at least
    as similar and shorter. Each start is a row by itself and sees most lines at most, however long the sentence.
    """
    line = lambda s: F.struct(F.xxhash64(s).alias("id"), words(ascii_lower(s), NOT_ALNUM).alias("w"))
    lines = F.filter(F.transform(F.split("s", "\n"), line), lambda x: F.size(x["w"]) > 0)
    shared = lambda w: F.exists(bigrams(w), lambda b: b.isin(known))

    def touches(x, i):
        after = F.get(F.col("lines"), i + 1)
        return shared(x["w"]) | F.coalesce(F.xxhash64(F.element_at(x["w"], -1), F.get(after["w"], 0)).isin(known), F.lit(False))

    at = F.filter(F.transform(F.col("lines"), lambda x, i: F.when(touches(x, i), i)), lambda i: i.isNotNull())
    df = sentences.withColumn("lines", lines).withColumn("at", at).filter(F.size("at") > 0)
    # The outer form: the plain one infers a filter that would make all bigrams once more.
    df = df.select("k", "o", "lines", F.explode_outer("at").alias("first"))
    df = df.select("k", "o", "first", F.slice("lines", F.col("first") + 1, F.lit(most)).alias("near"))
    one = F.get("near", F.lit(0))
    struct = lambda key, j, w: F.struct(key.alias("id"), j.alias("last"), w.alias("w"))
    single = struct(one["id"], F.col("first"), one["w"])
    start = F.struct(one["w"].alias("w"), F.col("first").alias("last"), F.lit(False).alias("full"), F.array(single).alias("out"))

    def longer(a, y):
        """Words are added until there are too many."""
        w, j = F.concat(a["w"], y["w"]), a["last"] + 1
        more = F.struct(w.alias("w"), j.alias("last"), F.lit(False).alias("full"), F.concat(a["out"], F.array(struct(F.xxhash64(w), j, w))).alias("out"))
        end = F.struct(a["w"].alias("w"), a["last"].alias("last"), F.lit(True).alias("full"), a["out"].alias("out"))
        return F.when(~a["full"] & (F.size(a["w"]) + F.size(y["w"]) <= most), more).otherwise(end)

    runs = F.aggregate(F.slice("near", 2, most), start, longer, lambda a: a["out"])
    return df.select("k", "o", "first", F.inline_outer(runs))


def passages(rows) -> list[tuple[str, str]]:
    """The texts, each whole and by its paragraphs."""
    return [(name, x) for name, text in rows for x in [text, *(text.split("\n\n") if "\n\n" in text else [])]]


def best_matches(units: DataFrame, keys: list[str], rows, min_dice: float) -> DataFrame:
    """keys and best (dice, license) of the units whose words w are as similar as min_dice to a template.

    Dice >= t needs sizes within t/(2-t) of each other: what has more or fewer distinct bigrams than all templates
    allow is dropped before its bigrams are looked up, the rest of the pairs before their score.
    """
    low, high = min_dice / (2 - min_dice), (2 - min_dice) / min_dice
    t = templates(units.sparkSession, rows)  # as many rows as the templates have bigrams: fixed
    sizes = [len(x) for x in ({*zip(w, w[1:])} or {*w} for w in (re.findall("[a-z0-9]+", text.lower()) for _, text in rows))]
    known = known_bigrams(units.sparkSession, rows)
    df = units.select(*keys, bigrams(F.col("w")).alias("b")).filter(F.size("b").between(min(sizes) * low, max(sizes) * high))
    df = df.select(*keys, F.size("b").alias("m"), F.filter("b", lambda x: x.isin(known)).alias("b"))
    # Not fewer than a template of one's own size and similarity must share: m <= (2-t)/t shared.
    df = df.filter(F.size("b") >= F.greatest(F.lit(1), F.floor(F.col("m") * low)))
    # The outer form: the plain one infers a filter that would make all bigrams once more.
    pairs = df.select(*keys, "m", F.explode_outer("b").alias("bigram")).join(F.broadcast(t), "bigram")
    pairs = pairs.filter((F.col("n") >= F.col("m") * low) & (F.col("n") <= F.col("m") * high))
    same = pairs.groupBy(*keys, "template", "license", "m", "n").agg(F.count_distinct("bigram").alias("shared"))
    same = same.withColumn("dice", 2 * F.col("shared") / (F.col("m") + F.col("n"))).filter(F.col("dice") >= min_dice)
    return same.groupBy(*keys).agg(F.max(F.struct("dice", "license")).alias("best"))


def license_texts(docs: DataFrame, rows=TEXTS, min_dice: float = 0.8) -> DataFrame:
    """k and best (dice, license) of the documents that are, or have a paragraph that is, as similar to a licence's
    text or one of its paragraphs."""
    text = F.coalesce("text", F.lit(""))
    own = F.array_distinct(F.array_append(F.split(text, BLANK), text))
    made = F.transform(own, lambda s: F.struct(words(ascii_lower(s), NOT_ALNUM).alias("w")))
    units = docs.select(row_key().alias("k"), F.inline(made))
    return best_matches(units.filter(F.size("w") > 0), ["k"], passages(rows), min_dice)


def license_notices(docs: DataFrame, rows=TEMPLATES, min_dice: float = 0.8) -> DataFrame:
    """k, sentence, license and dice of every notice as similar as min_dice to a template, best first.

    A line of a sentence is a notice by itself. Where none of its lines is, a run of lines of one sentence is,
    as in wrapped text, up to twice the bigrams of the longest template in words; of runs that overlap the most similar
    stays, then the shortest, then the first.
    """
    longest = max(len(x.split()) for _, x in rows) * 2
    most = int(longest * (2 - min_dice) / min_dice) + 1
    df = docs.select(row_key().alias("k"), F.posexplode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), SENTENCE))).alias("o", "s"))
    units = stretches(df, most, known_bigrams(docs.sparkSession, rows))
    best = best_matches(units, ["k", "o", "id", "first", "last"], rows, min_dice)
    is_line = F.col("first") == F.col("last")
    run = F.struct((-F.col("best.dice")).alias("worse"), (F.col("last") - F.col("first")).alias("more"), "first", "last", "id", "best")
    found = best.groupBy("k", "o").agg(
        F.collect_set(F.when(is_line, F.struct("id", "best"))).alias("singles"),
        F.collect_set(F.when(is_line, F.col("first"))).alias("taken"),
        F.collect_list(F.when(~is_line, run)).alias("runs"),
    )
    free = F.filter("runs", lambda x: ~F.arrays_overlap(F.sequence(x["first"], x["last"]), F.col("taken")))
    apart = lambda a, x: ~F.exists(a, lambda y: (x["first"] <= y["last"]) & (y["first"] <= x["last"]))
    found = found.withColumn("runs", F.array_sort(free))
    none = F.filter("runs", lambda x: F.lit(False))
    kept = F.aggregate("runs", none, lambda a, x: F.when(apart(a, x), F.concat(a, F.array(x))).otherwise(a))
    notices = F.concat("singles", F.transform(kept, lambda x: F.struct(x["id"].alias("id"), x["best"].alias("best"))))
    return found.select("k", F.explode(notices).alias("x")).select("k", F.col("x.id").alias("sentence"), "x.best.*").distinct()


def license_scan(docs: DataFrame, rows=TEMPLATES, min_dice: float = 0.8, texts=TEXTS) -> DataFrame:
    """doc_id, n_notices (distinct ones), license (of the best notice), dice and licenses of every document; text_license
    and text_dice of the licence whose text or paragraph it holds.

    A document without a notice, null text included, has n_notices 0, null license and empty licenses. Equal
    scores go to the greater name. Equal rows get equal results. Texts are scanned whole, however long; other columns,
    whatever their names, play no part; an empty table gives no rows.
    """
    found = license_notices(docs, rows, min_dice).groupBy("k").agg(
        F.count("*").alias("n_notices"),
        F.max(F.struct("dice", "license")).alias("best"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
    )
    whole = license_texts(docs, texts, min_dice).select("k", F.col("best.license").alias("text_license"), F.col("best.dice").alias("text_dice"))
    return docs.select("doc_id", row_key().alias("k")).join(found, "k", "left").join(whole, "k", "left").select(
        "doc_id",
        F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"),
        F.col("best.license").alias("license"),
        F.col("best.dice").alias("dice"),
        F.coalesce("licenses", F.lit("")).alias("licenses"),
        "text_license",
        "text_dice",
    )


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    from marlstone.sources.tables import table

    return license_scan(table(spark, sf_dir, "documents"))


def _sql(rows=TEMPLATES, texts=TEXTS) -> str:
    values = lambda rows: ", ".join(f"({i}, '{x}', '{t}')" for i, (x, t) in enumerate(rows))
    bag = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    two = "list_distinct(case when len(w) >= 2 then [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] else w end)"
    return rf"""
with t0(kind, template, license, txt) as (
  select 'notice', * from (values {values(rows)}) union all select 'text', * from (values {values(passages(texts))})),
t1 as (select kind, template, license, {bag.format("txt")} as w from t0),
t as (select kind, template, license, {two} as b from t1),
s0 as (select distinct 'notice' as kind, doc_id, s from (
  select doc_id, unnest(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), '\n')) as s from documents)
  union select distinct 'text', doc_id, s from (
  select doc_id, unnest(list_append(string_split_regex(coalesce(text, ''), '{BLANK}'), coalesce(text, ''))) as s from documents)),
s1 as (select kind, doc_id, s, {bag.format("s")} as w from s0),
s2 as (select kind, doc_id, s, {two} as b from s1 where len(w) > 0),
p as (select s2.kind, doc_id, s, license, 2 * len(list_intersect(s2.b, t.b)) / (len(s2.b) + len(t.b)) as dice
      from s2 join t on s2.kind = t.kind and len(s2.b) * 2 >= len(t.b) and len(t.b) * 2 >= len(s2.b) where list_has_any(s2.b, t.b)),
n as (select kind, doc_id, s, max(struct_pack(dice := dice, license := license)) as best from p where dice >= 0.8 group by kind, doc_id, s),
f as (select doc_id, count(*) as n_notices, max(best) as best, string_agg(distinct best.license, ',' order by best.license) as licenses from n where kind = 'notice' group by doc_id),
x as (select doc_id, max(best) as best from n where kind = 'text' group by doc_id)
select d.doc_id, coalesce(n_notices, 0) as n_notices, f.best.license as license, f.best.dice as dice, coalesce(licenses, '') as licenses,
  x.best.license as text_license, x.best.dice as text_dice
from documents d left join f using (doc_id) left join x using (doc_id)
"""


OP10_SQL = _sql()

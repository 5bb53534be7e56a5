"""Licence scanning: Dice coefficient over word bigrams against licence templates.

Text is normalised to lower-case words of ASCII letters and digits, one stream for
the whole document, so that line breaks, comment marks and what stands before or
after a notice don't matter. A template of L words is compared with a window of L
words: the one in which most of its bigrams stand where the template has them.

A window of n bigrams reaches a Dice coefficient of t with a template of m only if it
shares t * m / (2 - t) of them or more. That bound prunes in two steps:

1. Any so many of a template's bigrams include one of its anchors, the few that are
   left over. Texts without any anchor of any template go after one expression.
2. Of the others, templates whose bigrams a text does not hold often enough, or that
   are longer than it, go before any window is built.

All of it is DataFrame functions, on the JVM.
"""

import re
from functools import cache
from importlib.resources import files
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, written

#: Short notices of licences, as they stand in files.
NOTICES = {
    "MIT": ("Released under the MIT License.", "This project is licensed under the terms of the MIT license."),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
}


@cache
def standard_templates() -> dict[str, tuple[str, ...]]:
    """The notices, and the whole texts that stand in the folder ``licences`` by name."""
    texts = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in (files(__package__) / "licences").iterdir() if f.name.endswith(".txt")}
    return {n: NOTICES.get(n, ()) + ((texts[n],) if n in texts else ()) for n in sorted({*NOTICES, *texts})}


def normal_words(text: str) -> list[str]:
    """The words of a template, as ``normalised`` leaves them."""
    return re.findall("[a-z0-9]+", text.lower())


class Template:
    """A template's words, its distinct bigrams with the place where each stands first, and what a match must share."""

    def __init__(self, name: str, text: str, threshold: float):
        words = normal_words(text)
        if len(words) < 2:
            raise ValueError(f"a template of {name} has fewer than two words")
        self.name, self.length = name, len(words)
        self.first: dict[str, int] = {}
        for i, pair in enumerate(zip(words, words[1:])):
            self.first.setdefault(" ".join(pair), i)
        self.needed = ceil(threshold * len(self.first) / (2 - threshold) - 1e-9)

    def anchors(self) -> list[str]:
        """So many bigrams that any ``needed`` of them include one: the longest, which are the rarest as a rule."""
        return sorted(self.first, key=lambda g: (-len(g), g))[: len(self.first) - self.needed + 1]


def of_templates(templates: dict[str, tuple[str, ...]], threshold: float) -> list[Template]:
    return [Template(n, t, threshold) for n in sorted(templates) for t in templates[n]]


def any_of(grams: list[str]) -> str:
    """An expression for any of the bigrams in lower-case text, with common beginnings taken together."""
    tree: dict = {}
    for g in grams:
        node = tree
        for c in g:
            node = node.setdefault(c, {})
        node[""] = {}

    def written_out(node: dict) -> str:
        if "" in node:  # what goes on from here is found by the shorter one
            return ""
        parts = [("[^a-z0-9]+" if c == " " else c) + written_out(node[c]) for c in sorted(node)]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return "[^a-z0-9]" + written_out(tree)


def normalised(text: Column) -> Column:
    """Lower-cased words with one blank between."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def bigrams(words: Column) -> Column:
    """Pairs of neighbouring words, in order. ``words`` is a column of a row, not an expression: it is used more than once."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def template_tables(spark: SparkSession, templates: list[Template]) -> tuple[DataFrame, DataFrame]:
    """(template, name, length, needed, grams), and (template, gram, place), from texts that stand in the plan."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(t.name).alias("name"), F.lit(t.length).alias("length"), F.lit(t.needed).alias("needed"), F.lit("|".join(f"{place}:{g}" for g, place in t.first.items())).alias("placed")) for i, t in enumerate(templates)]
    table = spark.range(1).select(F.inline(F.array(*rows))).withColumn("placed", F.split("placed", "[|]"))
    places = table.select("template", "length", "needed", F.explode("placed").alias("p")).select("template", "length", "needed", F.substring_index("p", ":", -1).alias("gram"), F.substring_index("p", ":", 1).cast("int").alias("place"))
    return table.select("template", "name", "length", F.transform("placed", lambda p: F.substring_index(p, ":", -1)).alias("grams")), places


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None, threshold: float = 0.8) -> DataFrame:
    """One row per document: doc_id, n_matched, licenses (sorted names), best_license, best_dice, best_start, best_end.

    A template matches a document when the window of as many words as it has, in which
    most of its bigrams stand where the template first has them (of several the first),
    has a Dice coefficient of ``threshold`` or more with it; windows end where the
    document does. n_matched counts templates; ties for the best go to the first name,
    then to the first window. best_start and best_end (exclusive) count words. Null,
    empty and wordless texts match nothing and have null for the best. Repeated rows
    are each scanned. An empty table gives no rows. Other columns of ``docs`` are not
    read. ``templates`` (by default short notices and whole texts of common licences)
    is a small parameter that stands in the plan; each text needs two words.
    """
    known = of_templates(standard_templates() if templates is None else templates, threshold)
    text = F.coalesce(F.col("text"), F.lit(""))
    suspect = F.concat(F.lit(" "), F.lower(text)).rlike(any_of([g for t in known for g in t.anchors()])) if known else F.lit(False)
    rows = id_and_text(docs, id_col, text_col).withColumn("row_id", F.monotonically_increasing_id())
    rows = written(rows.select("doc_id", "row_id", F.when(suspect, F.split(normalised(text), " ")).alias("words")), "license-suspects")
    if not known:
        return rows.select("doc_id", F.lit(0).cast("long").alias("n_matched"), F.lit("").alias("licenses"), *(F.lit(None).cast(k).alias(c) for c, k in (("best_license", "string"), ("best_dice", "double"), ("best_start", "long"), ("best_end", "long"))))
    suspects = rows.where("words IS NOT NULL").select("row_id", "words", F.size("words").alias("n_words"))
    table, places = template_tables(docs.sparkSession, known)
    hits = suspects.select("row_id", "n_words", F.posexplode(bigrams(F.col("words"))).alias("at", "gram")).join(F.broadcast(places), "gram").where("n_words > needed")
    starts = hits.groupBy("row_id", "template", (F.col("at") - F.col("place")).alias("start")).agg(F.count("*").alias("votes"), F.first("needed").alias("needed"))
    best = starts.groupBy("row_id", "template").agg(F.sum("votes").alias("held"), F.first("needed").alias("needed"), F.min(F.struct((-F.col("votes")).alias("less"), "start")).alias("window")).where("held >= needed")
    windows = best.select("row_id", "template", F.col("window.start").alias("start")).join(F.broadcast(table), "template").join(suspects, "row_id")
    begin, end = F.greatest(F.col("start"), F.lit(0)), F.least(F.col("start") + F.col("length"), F.col("n_words"))
    windows = windows.select("row_id", "name", "grams", begin.alias("begin"), end.alias("end"), F.slice("words", begin + 1, F.greatest(end - begin, F.lit(0))).alias("part"))
    windows = windows.select("row_id", "name", "grams", "begin", "end", F.array_distinct(bigrams(F.col("part"))).alias("own"))
    scored = windows.select("row_id", "name", "begin", "end", (2.0 * F.size(F.array_intersect("own", "grams")) / (F.size("own") + F.size("grams"))).alias("dice")).where(F.col("dice") >= threshold)
    found = scored.groupBy("row_id").agg(F.count("*").alias("n_matched"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("licenses"), F.min(F.struct((-F.col("dice")).alias("less"), "name", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))).alias("best"))
    out = rows.select("doc_id", "row_id").join(found, "row_id", "left")
    return out.select("doc_id", F.coalesce("n_matched", F.lit(0).cast("long")).alias("n_matched"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.col("best.name").alias("best_license"), (-F.col("best.less")).alias("best_dice"), F.col("best.begin").alias("best_start"), F.col("best.end").alias("best_end"))

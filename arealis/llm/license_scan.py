"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A unit (a line, a whole text, or a run of consecutive words inside a text) and a template are sets of distinct adjacent word
pairs; their score is twice the common pairs over the sum of both sizes. A score of t needs t / (2 - t) of a template's pairs
and sizes within that factor and its inverse of each other. So texts without any of the words that such a share must hold
(`probes`) are dropped first, units outside the bounds of every template before pairs are formed, and each unit meets only
templates within bounds. Runs start and end at pairs of their template, may cross lines, and are looked for only in texts
with enough of the template's pairs.

Only pairs that a template has are joined, and common pairs are counted by partial sums. The templates are a fixed table
whose pairs are counted before they are broadcast.

Defined results: null and empty texts have no units; a unit of one word has no pair and matches nothing; ties go to the
template whose name sorts first; repeated rows give repeated results. Of runs that overlap, the best of a template stays (by
score, then common pairs), and one of another template unless half of it lies in a run that stays. A run in a line or text that
matches the same template is left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from arealis.llm.common import store, text_or_empty

#: Short notices by which texts state their licence or rights.
NOTICES = {
    "All-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Whole licence bodies, named by their file.
BODIES = {f"{p.stem}-text": p.read_text("utf-8") for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))}
TEMPLATES = NOTICES | BODIES
#: Words that tell texts with a match from others too badly to look for.
COMMON = set("a an all and any are as at be been but by for from has have if in is it its may more must no not of on one or other same such than that the their them then there these they this those to under up use was we when where which who will with work you your".split())
MOST_PAIRS = 100_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _pairs(words: str) -> Column:
    return F.expr(f"array_distinct(zip_with(slice({words}, 1, greatest(size({words}) - 1, 0)), slice({words}, 2, greatest(size({words}) - 1, 0)), (x, y) -> concat(x, ' ', y)))")


def template_pairs(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    rows = spark.createDataFrame(list(templates.items()), "license string, body string")
    return rows.select("license", _words(F.col("body")).alias("w")).where(F.size("w") > 1).select("license", F.size("w").alias("words"), _pairs("w").alias("pairs")).withColumn("size", F.size("pairs"))


def needed(pairs: int, threshold: float) -> int:
    """The pairs of a template that any unit scoring the threshold has: n of them in a unit of n pairs or more."""
    return math.ceil(threshold / (2 - threshold) * pairs - 1e-9)


def probes(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which every text with a matching unit has one: fewer pairs than a match needs are without them."""
    chosen: set[str] = set()
    for body in templates.values():
        words = [w for w in re.split("[^a-z0-9]+", body.lower()) if w]
        left = set(zip(words, words[1:], strict=False))
        most_left = needed(len(left), threshold)
        left = {p for p in left if not chosen.intersection(p)}
        while left and len(left) >= most_left:
            count = Counter(w for p in left for w in set(p))
            best = min(count, key=lambda w: (w in COMMON or len(w) < 2, -count[w], -len(w), w))
            chosen.add(best)
            left = {p for p in left if best not in p}
    return sorted(chosen)


def _placed(texts: DataFrame) -> DataFrame:
    """Each pair with its place: row, p, a and b (lines of both words), pair."""
    words = F.flatten(F.transform(F.split("body", "\n"), lambda t, i: F.transform(_words(t), lambda x: F.struct((i + 1).alias("line"), x.alias("word")))))
    paired = F.expr("zip_with(slice(w, 1, greatest(size(w) - 1, 0)), slice(w, 2, greatest(size(w) - 1, 0)), (x, y) -> struct(x.line as a, y.line as b, concat(x.word, ' ', y.word) as pair))")
    return texts.select("row", words.alias("w")).select("row", F.posexplode(paired).alias("p", "e")).select("row", "p", "e.a", "e.b", "e.pair")


def _live(texts: DataFrame, parts: DataFrame, least: float) -> DataFrame:
    """Rows and templates that may match: row, license, other, words; any matching unit has `least` of the template's pairs."""
    pairs = texts.select("row", _words(F.col("body")).alias("w")).select("row", F.explode(_pairs("w")).alias("pair"))
    met = pairs.join(parts, "pair").groupBy("row", "license", "other", "words").agg(F.count(F.lit(1)).alias("n"))
    return met.where(F.col("n") >= least * F.col("other") - 1e-9).drop("n")


def _runs(texts: DataFrame, parts: DataFrame, live: DataFrame, threshold: float) -> DataFrame:
    """Per run: row, place (line of its start), stop (line of its end), license, dice.

    A best run starts where a stretch of template pairs starts and ends where one ends: a neighbouring pair of the template
    never lowers the score. A run is at most `most` times the template's words long. So places are cut into blocks of that length, starts
    meet the ends of their own block and the next, and only those of blocks that hold enough of the template's distinct pairs together
    with the next: a long text is many blocks, and its work grows with its length.
    """
    most = (2 - threshold) / threshold
    pairs = _placed(texts)
    same = Window.partitionBy("row", "pair").orderBy("p")
    near = pairs.withColumn("prev", F.coalesce(F.lag("p").over(same), F.lit(-1)))
    known = parts.select("license", "pair", F.lit(1).alias("hit"))
    by_place = Window.partitionBy("row", "license").orderBy("p")
    spots = near.join(live, "row").join(known, ["license", "pair"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    width = F.ceil(F.greatest(F.col("words") * most, F.col("words") + 1))
    edges = {"first": (F.col("hit") == 1) & (F.coalesce(F.lag("hit").over(by_place), F.lit(0)) == 0), "last": (F.col("hit") == 1) & (F.coalesce(F.lead("hit").over(by_place), F.lit(0)) == 0)}
    spots = store(spots.withColumns(edges).drop("pair").withColumn("width", width).withColumn("block", F.floor(F.col("p") / F.col("width"))), "license-spots")
    # distinct pairs of the template in a block and the next, counted in the block
    seen = F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("block")
    dense = spots.where("hit = 1").select("row", "license", "prev", "width", "other", seen).where(F.col("prev") < F.col("block") * F.col("width"))
    dense = dense.groupBy("row", "license", "block", "other").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold / (2 - threshold) * F.col("other") - 1e-9)
    starts = spots.where("first").select("row", "license", "block", F.col("p").alias("s"), F.col("a").alias("place")).join(dense.select("row", "license", "block"), ["row", "license", "block"], "left_semi")
    starts = starts.withColumn("block", F.explode(F.array(F.col("block"), F.col("block") + 1)))
    grown = starts.join(spots, ["row", "license", "block"]).where((F.col("p") >= F.col("s")) & (F.col("p") - F.col("s") + 2 <= F.greatest(F.col("words") * most, F.col("words") + 1)))
    so_far = Window.partitionBy("row", "license", "s").orderBy("p")
    fresh = F.when(F.col("prev") < F.col("s"), 1).otherwise(0)
    scored = grown.withColumns({"n": F.sum(fresh * F.col("hit")).over(so_far), "size": F.sum(fresh).over(so_far)}).where("last").withColumn("dice", 2 * F.col("n") / (F.col("size") + F.col("other"))).where(F.col("dice") >= threshold)
    best = Window.partitionBy("row", "license", "s").orderBy(F.desc("dice"), "p")
    tops = scored.withColumn("rank", F.row_number().over(best)).where("rank = 1")
    # runs that overlap, directly or by others between them, are one island
    before = F.max("p").over(Window.partitionBy("row").orderBy("s", "p").rowsBetween(Window.unboundedPreceding, -1))
    apart = tops.withColumn("apart", F.when(F.col("s") <= F.coalesce(before, F.lit(-1)), 0).otherwise(1))
    islands = apart.withColumn("island", F.sum("apart").over(Window.partitionBy("row").orderBy("s", "p").rowsBetween(Window.unboundedPreceding, 0)))
    listed = islands.groupBy("row", "island").agg(F.array_sort(F.collect_list(F.struct((-F.col("dice")).alias("dice"), (-F.col("n")).alias("n"), "license", "s", F.col("p").alias("e"), "place", F.col("b").alias("stop")))).alias("found"))

    def covers(o: Column, c: Column) -> Column:
        common = F.least(o["e"], c["e"]) - F.greatest(o["s"], c["s"]) + 1
        return F.when(o["license"] == c["license"], common > 0).otherwise(2 * common >= c["e"] - c["s"] + 1)

    kept = F.aggregate("found", F.filter("found", lambda c: F.lit(False)), lambda out, c: F.when(F.exists(out, lambda o: covers(o, c)), out).otherwise(F.concat(out, F.array(c))))
    return listed.select("row", F.explode(kept).alias("r")).select("row", "r.place", "r.stop", "r.license", (-F.col("r.dice")).alias("dice"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per unit that matches: id, unit ('line', 'text' or 'run'), place (line number of its start, 0 for the text), license, dice."""
    templates = TEMPLATES if templates is None else templates
    known = template_pairs(docs.sparkSession, templates)
    total, low, high = known.agg(F.coalesce(F.sum("size"), F.lit(0)), F.min("size"), F.max("size")).first()
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    text = text_or_empty(text_col)
    words = probes(templates, threshold)
    maybe = F.lower(text).rlike(f"(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])") if words else F.lit(False)
    texts = store(docs.where(maybe).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("body")), "license-texts")
    parts = known.select("license", F.col("size").alias("other"), "words", F.explode("pairs").alias("pair"))
    parts = F.broadcast(parts) if total <= MOST_PAIRS else parts
    live = store(_live(texts, parts, least), "license-live")
    texts = texts.join(live.select("row").distinct(), "row", "left_semi")
    lines = texts.select("row", F.posexplode(F.split("body", "\n")).alias("place", "body")).select("row", F.lit("line").alias("unit"), (F.col("place") + 1).alias("place"), "body")
    whole = texts.where(F.instr("body", "\n") > 0).select("row", F.lit("text").alias("unit"), F.lit(0).alias("place"), "body")
    #: A unit within bounds has at least so many characters.
    units = lines.unionAll(whole).where(F.length("body") >= 2 * least * (low or 0)).select("row", "unit", "place", _words(F.col("body")).alias("w")).where(F.size("w") - 1 >= F.greatest(F.lit(1.0), F.lit(least * (low or 0))))
    sized = units.select("row", "unit", "place", _pairs("w").alias("pairs")).withColumn("size", F.size("pairs")).where(F.col("size") <= most * (high or 0))
    met = sized.select("row", "unit", "place", "size", F.explode("pairs").alias("pair")).join(parts, "pair").where((F.col("size") >= least * F.col("other")) & (F.col("size") <= most * F.col("other")))
    scored = met.groupBy("row", "unit", "place", "size", "license", "other").agg(F.count(F.lit(1)).alias("n")).withColumn("dice", 2 * F.col("n") / (F.col("size") + F.col("other"))).where(F.col("dice") >= threshold)
    best = Window.partitionBy("row", "unit", "place").orderBy(F.desc("dice"), "license")
    told = store(scored.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("row", "unit", "place", "license", "dice"), "license-units")
    runs = _runs(texts, parts, live, threshold)
    over = told.select("row", F.col("place").alias("at"), F.col("license").alias("named"))
    explained = (runs["row"] == over["row"]) & ((over["at"] == 0) | ((over["at"] == runs["place"]) & (runs["place"] == runs["stop"]))) & (over["named"] == runs["license"])
    more = runs.join(over, explained, "left_anti").select("row", F.lit("run").alias("unit"), "place", "license", "dice")
    found = told.unionByName(more)
    return found.join(texts.select("row", "id"), "row").select(F.col("id").alias(id_col), "unit", "place", "license", "dice")

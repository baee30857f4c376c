"""Licence scans: a paragraph classifier trained on templates, confirmed against them; DataFrame operations only."""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm._common import read, stash

#: Short notices by family, as they stand in files (fixed values).
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is available under the terms of the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute this library under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "Released under the LGPL.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Released under the AGPL.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ),
    "bsd": (
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Licensed under the BSD 3-Clause License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org under the terms of the Mozilla Public License.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc0": (
        "Released into the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work, which is dedicated to the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "proprietary": (
        "All rights reserved.",
        "All rights reserved. Unauthorized copying of this file is strictly prohibited.",
        "Proprietary and confidential. All rights reserved; no license is granted.",
    ),
}
#: Paragraphs of no family that use the same words (fixed values).
OTHER = (
    "The driver must carry a valid licence and the papers of the car.",
    "Copyright law differs from country to country.",
    "She asked for permission to leave the room early.",
    "The warranty covers repairs for two years from the date of purchase.",
    "A fishing license costs forty dollars a year in this state.",
    "He works for a public company that sells software and hardware.",
    "The foundation published a report on the general state of public health.",
    "Version 2.0 of the program is faster than version 1.0.",
    "Under the terms of the agreement the library may lend its books to any person.",
    "Free of charge and without conditions, the museum is open to the public.",
    "The use of this source of water is subject to the following conditions.",
    "They were granted the right to work in the country.",
    "The license of the restaurant was revoked after the inspection.",
    "Redistribution of income is a matter of general public debate.",
    "All of the files were copied to a new disk.",
    "The apache helicopter was released from the hangar.",
    "Students at mit wrote a work on commons.",
    "International attribution of the painting remains unknown.",
    "See the license file for details.",
    "The domain of the function is the set of real numbers.",
)
#: Words by which a paragraph is reported as worded.
LICENCE_WORDS = ("licen", "copyright", "permission is", "redistribut", "public domain", "warrant", "all rights reserved", "gpl", "unencumbered", "spdx")
#: Of OTHER, every so many are kept from the learner and calibrate it.
HELD_OTHER = 4
#: Word n-grams of 1 to ORDERS words.
ORDERS = 3
#: A family counts from this calibrated probability and this part of a template's n-grams.
PROBABILITY, CONFIRMED = 0.5, 0.6
UNKNOWN = "unknown"
#: Most lines of a run that is tried as one notice, besides whole paragraphs; a template has some 200 characters at most.
RUN = 12
PASSES, RATE, L2, COPIES, SEED = 30, 0.5, 1e-4, 6, 3


def words_of(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9.]+", " ", text.lower()).replace(". ", " ").strip(" .").split()


def grams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({" ".join(words[k : k + n]) for n in range(1, ORDERS + 1) for k in range(len(words) - n + 1)})


def wording() -> tuple[str, ...]:
    """LICENCE_WORDS, and pairs of words of the templates, of which any paragraph that CONFIRMED of a template can confirm has one.

    Pairs are added to a template until its n-grams without any of them are too few to confirm it; long words that OTHER
    lacks come first, as fewer paragraphs have them.
    """
    out = list(LICENCE_WORDS)
    prose = [f" {' '.join(words_of(t))} " for t in OTHER]
    for t in sorted((t for group in TEMPLATES.values() for t in group), key=len, reverse=True):
        grams, words = grams_of(t), words_of(t)
        while len(left := [g for g in grams if not any(w in g for w in out)]) >= CONFIRMED * len(grams) - 1e-9:
            pairs = [p for p in map(" ".join, zip(words, words[1:])) if any(p in g for g in left)]  # noqa: B905
            out.append(max(pairs, key=lambda p: (not any(f" {p} " in o for o in prose), -sum(len(w) < 4 for w in p.split()), sum(p in g for g in left), len(p), p)))  # noqa: B023
    return tuple(out)


#: Only paragraphs with one of these are judged.
WORDING = wording()


def pattern(words) -> str:
    """A pattern of any of the words in lower-cased text, whatever signs stand between those of a pair; a pair starts with a word, and pairs are grouped by their first letter."""
    body = lambda w: re.escape(w).replace(r"\ ", "[^a-z0-9]+")
    pairs: dict[str, list[str]] = {}
    for w in words:
        if w not in LICENCE_WORDS:
            pairs.setdefault(w[0], []).append(body(w[1:]))
    alone = [body(w) for w in words if w in LICENCE_WORDS]
    return "|".join(alone + ([f"(?<![a-z0-9])(?:{'|'.join(k + '(?:' + '|'.join(sorted(v)) + ')' for k, v in sorted(pairs.items()))})"] if pairs else []))


@dataclass(frozen=True)
class Model:
    """weights: (gram, family, weight) of families and UNKNOWN; bias by family; grams of each template."""

    families: tuple[str, ...]
    weights: dict[str, dict[str, float]]
    bias: dict[str, float]
    temperature: float
    templates: tuple[tuple[str, frozenset[str]], ...]

    def logits(self, grams) -> dict[str, float]:
        z = dict(self.bias)
        for g in grams:
            for f, w in self.weights.get(g, {}).items():
                z[f] += w
        return z


def probabilities(z: dict[str, float], temperature: float) -> dict[str, float]:
    top = max(z.values())
    e = {f: math.exp((v - top) / temperature) for f, v in z.items()}
    return {f: v / sum(e.values()) for f, v in e.items()}


def train() -> Model:
    """Multinomial logistic regression by stochastic descent over the templates and OTHER, whole and with words left out.

    Copies with one word in seven left out (never one that a single family uses) make the model less sure of any single word; a second
    set of copies, and the paragraphs of OTHER that it doesn't learn from, set the temperature, with targets smoothed by one error.
    """
    families = (*TEMPLATES, UNKNOWN)
    rng = random.Random(SEED)
    texts = [(t, f) for f, group in (*TEMPLATES.items(), (UNKNOWN, (*OTHER, ""))) for t in group]

    users: dict[str, set[str]] = {}
    for t, f in texts:
        for w in words_of(t):
            users.setdefault(w, set()).add(f)

    def thinned(text: str) -> str:
        return " ".join(w for w in words_of(text) if len(users[w]) == 1 or rng.random() > 1 / 7)

    kept = {t for t in OTHER[::HELD_OTHER]}
    known = [(t, f) for t, f in texts if t not in kept]
    fit = [(grams_of(t), f) for t, f in known] + [(grams_of(thinned(t)), f) for t, f in known for _ in range(COPIES)]
    held = [(grams_of(thinned(t)), f) for t, f in known for _ in range(2)] + [(grams_of(t), f) for t, f in texts if t in kept for _ in range(2)]
    weights: dict[str, dict[str, float]] = {}
    bias = dict.fromkeys(families, 0.0)
    for step in range(PASSES):
        rng.shuffle(fit)
        rate = RATE / (1 + step / 5)
        for grams, family in fit:
            model = Model(families, weights, bias, 1.0, ())
            p = probabilities(model.logits(grams), 1.0)
            p[family] -= 1
            each = rate / math.sqrt(len(grams) + 1)
            for f, slope in p.items():
                if abs(slope) > 1e-3:
                    bias[f] -= each * slope
                    for g in grams:
                        own = weights.setdefault(g, {})
                        own[f] = own.get(f, 0.0) * (1 - each * L2) - each * slope
    model = Model(families, weights, bias, 1.0, ())
    logits = [(model.logits(g), f) for g, f in held]
    miss = 1 / (len(held) + 2)

    def loss(t: float) -> float:
        total = 0.0
        for z, family in logits:
            for f, p in probabilities(z, t).items():
                total -= (1 - miss if f == family else miss / (len(families) - 1)) * math.log(max(p, 1e-300))
        return total

    temperature = min((0.25 * 1.15**k for k in range(25)), key=loss)
    templates = tuple((f, frozenset(grams_of(t))) for f, group in TEMPLATES.items() for t in group)
    return Model(families, weights, bias, temperature, templates)


def gram_column(text: Column) -> Column:
    """grams_of() as an expression."""
    spaced = F.regexp_replace(F.lower(text), "[^a-z0-9.]+", " ")
    split = F.filter(F.split(F.btrim(F.replace(spaced, F.lit(". "), F.lit(" ")), F.lit(" .")), " "), lambda w: w != "")

    def runs(words: Column, k: int) -> Column:
        n = F.size(words)
        return F.transform(F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(words, i, k), " "))

    # bound to a variable, so that a text is split once and not again for each n-gram
    return F.array_distinct(F.flatten(F.transform(F.array(split), lambda words: F.concat(*[runs(words, k) for k in range(1, ORDERS + 1)]))))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_paragraphs, n_worded, n_unknown, licences, best_probability, best_template) for every row of docs(doc_id, text).

    Paragraphs are the lines of the whole text that aren't blank. One with any of WORDING, which none that a template can
    confirm lacks, gets the family of highest calibrated probability; if that is UNKNOWN, has less than PROBABILITY, or no
    template of the family has CONFIRMED of its n-grams in the paragraph, the paragraph has none, and is unknown if it is
    worded, that is, has any of LICENCE_WORDS. Notices with hard line breaks
    are read, too: all runs of up to RUN lines without a blank one between them, and all lines between two blank
    ones, are judged in the same way, and worded lines of the shortest runs that have a family aren't unknown. licences joins
    the families found in alphabetical order ('' if none); best_probability and best_template are the
    greatest of a family that counts (null if none does). Null and empty texts have no paragraphs;
    repeated rows are each reported; ties between families go to the first in the alphabet.
    No rows give no rows. The model has some thousand n-grams, whatever the corpus.
    """
    model = model or train()
    spark = docs.sparkSession
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    picks = lambda p: F.lower(p).rlike(pattern(WORDING))
    worded = lambda p: F.lower(p).rlike(pattern(LICENCE_WORDS))
    # most documents have none of it in their whole text and need no look at their lines; signs and line breaks may stand within a pair
    lean = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole.alias("whole")).withColumn("hit", picks(F.col("whole")))
    split = lean.select("row", "doc_id", "whole", "hit", F.filter(F.split("whole", "\r?\n"), lambda p: F.btrim(p) != "").alias("paragraphs"))
    wrapped = F.transform(F.filter(F.split("whole", r"\r?\n\s*\r?\n"), lambda p: F.btrim(p, F.lit("\r\n ")).contains("\n") & picks(p)), lambda p: F.filter(F.split(p, "\r?\n"), lambda x: F.btrim(x) != ""))
    none = F.array()
    found = stash(split.select("row", "doc_id", F.size("paragraphs").cast("long").alias("n_paragraphs"), F.when(F.col("hit"), F.filter("paragraphs", picks)).otherwise(none.cast("array<string>")).alias("picked"), F.when(F.col("hit"), wrapped).otherwise(none.cast("array<array<string>>")).alias("wrapped")), "licences")
    # the bias is the weight of an n-gram that every paragraph has
    table = [(g, f, float(w)) for g, own in [("", model.bias), *model.weights.items()] for f, w in own.items()]
    weights = spark.createDataFrame(table, "gram string, family string, weight double")
    parts = [(f, k, g, 1.0 / len(grams)) for k, (f, grams) in enumerate(model.templates) for g in grams]
    templates = spark.createDataFrame(parts, "family string, template int, gram string, part double")

    def matched(grams: DataFrame, *key: str) -> DataFrame:
        """By family, the greatest part of a template's n-grams that each key has."""
        return grams.join(F.broadcast(templates), "gram").groupBy(*key, "family", "template").agg(F.sum("part").alias("part")).groupBy(*key, "family").agg(F.max("part").alias("matched"))

    def judged(each: DataFrame, *key: str) -> DataFrame:
        """(*key, family, probability, matched, sure) of every text of each(*key, text)."""
        grams = each.select(*key, F.explode(F.array_append(gram_column(F.col("text")), F.lit(""))).alias("gram"))
        z = grams.join(F.broadcast(weights), "gram").groupBy(*key, "family").agg(F.sum("weight").alias("z"))
        top = z.groupBy(*key).agg(F.max("z").alias("top"), F.collect_list(F.struct("z", "family")).alias("all"))  # one for each family
        best = F.array_min(F.transform("all", lambda x: F.struct((-x["z"]).alias("z"), x["family"].alias("family"))))
        shares = F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp((x["z"] - F.col("top")) / F.lit(model.temperature)))
        best = top.select(*key, best["family"].alias("family"), (F.lit(1.0) / shares).alias("probability"))
        sure = F.coalesce((F.col("family") != UNKNOWN) & (F.col("probability") >= PROBABILITY) & (F.col("matched") >= CONFIRMED - 1e-9), F.lit(False))
        return best.join(matched(grams, *key), [*key, "family"], "left").select(*key, "family", "probability", "matched", sure.alias("sure"))

    lines = found.where(F.size("picked") > 0).select("row", F.posexplode("picked").alias("place", "text")).withColumn("worded", worded(F.col("text")))
    single = stash(judged(lines, "row", "place").join(lines, ["row", "place"]), "licences-lines")
    # a run has no more of a template than its whole paragraph, and where lines alone tell all there is nothing to look for
    blocks = found.where(F.size("wrapped") > 0).select("row", F.posexplode("wrapped").alias("block", "lines"))
    likely = matched(blocks.select("row", "block", F.explode(gram_column(F.array_join("lines", "\n"))).alias("gram")), "row", "block").where(F.col("matched") >= CONFIRMED - 1e-9)
    told = single.groupBy("row").agg(F.collect_set(F.when(F.col("sure"), F.col("family"))).alias("told"), F.bool_or(~F.col("sure") & F.col("worded")).alias("left"))
    open_ = likely.join(told, "row", "left").where(F.coalesce(F.col("left") | ~F.array_contains("told", F.col("family")), F.lit(True))).select("row", "block").distinct()
    n = F.size("lines")
    # a line whose longest run has no wording starts no shorter one that has
    starts = F.filter(F.sequence(F.lit(1), n), lambda s: picks(F.array_join(F.slice("lines", s, F.lit(RUN)), "\n")))
    spans = F.filter(F.array_distinct(F.array_append(F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(2), F.lit(RUN)), lambda k: F.struct(s.alias("at"), k.alias("k"))))), F.struct(F.lit(1).alias("at"), n.alias("k")))), lambda x: (x["at"] + x["k"] <= n + 1) & (x["k"] > 1))
    runs = blocks.join(open_, ["row", "block"]).select("row", "block", "lines", F.explode(spans).alias("s")).select("row", "block", "s.at", "s.k", F.slice("lines", F.col("s.at"), F.col("s.k")).alias("lines")).withColumn("text", F.array_join("lines", "\n")).where(picks(F.col("text")))
    runs = stash(runs, "licences-runs")
    sure = judged(runs, "row", "block", "at", "k").where("sure").join(runs, ["row", "block", "at", "k"])
    own = F.struct("at", "k", "lines", "probability", "matched")
    inner = lambda x, y: (y["at"] >= x["at"]) & (y["at"] + y["k"] <= x["at"] + x["k"]) & (y["k"] < x["k"])
    shortest = sure.groupBy("row", "block", "family").agg(F.collect_list(own).alias("all")).select("row", "family", F.explode(F.filter("all", lambda x: ~F.exists("all", lambda y: inner(x, y)))).alias("x")).select("row", "family", "x.*")
    held = stash(shortest.select("row", "family", "probability", "matched", "lines"), "licences-runs")
    covered = held.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("covered"))
    counted = single.join(covered, "row", "left").select("row", "family", "probability", "matched", "sure", (F.col("worded") & ~F.col("sure") & ~F.coalesce(F.array_contains("covered", F.col("text")), F.lit(False))).alias("unknown"))
    counted = counted.unionByName(held.select("row", "family", "probability", "matched", F.lit(True).alias("sure"), F.lit(False).alias("unknown")))
    of_doc = counted.groupBy("row").agg(
        F.count_if("unknown").alias("n_unknown"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("sure"), F.col("family")))), ",").alias("licences"),
        F.max(F.when(F.col("sure"), F.col("probability"))).alias("best_probability"),
        F.max(F.when(F.col("sure"), F.col("matched"))).alias("best_template"),
    )
    return found.join(of_doc, "row", "left").select(
        "doc_id", "n_paragraphs", F.size(F.filter("picked", worded)).cast("long").alias("n_worded"), F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"), F.coalesce("licences", F.lit("")).alias("licences"), "best_probability", "best_template"
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() of the whole documents table; nulls, empty texts, repeated rows and an empty table as there."""
    return scan(read(spark, sf_dir, "documents", "doc_id", "text"))

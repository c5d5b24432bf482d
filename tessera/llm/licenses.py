"""Licence scans, in DataFrame functions only.

Paragraphs (the sentences of every line, and a line as a whole where none of its sentences is confirmed) with a licence
word are classified by a sparse logistic regression over
their word 1- to 3-grams. It is trained on the driver from the templates below and from everyday sentences with the same
words (the unknown class), with words dropped for robustness; its softmax is calibrated by a temperature on held-out
variants, and a family counts only above THRESHOLD. A prediction is confirmed by comparison with the family's templates:
at least half of the paragraph's 3-grams, or four of them, are theirs, or it holds SHARE of those of one template. Distinct paragraphs are classified once, however
many documents hold them; the model is a table of a few thousand grams, whose size the templates fix.

Cases: null and empty texts, and texts without a licence, have the licence "none"; null doc_id is kept (its rows are taken
together); a text may be of any length (its patterns take linear time); rows with one doc_id share their findings; ties between families go to the first by name; an empty table gives
an empty table; extra columns are ignored.
"""

from __future__ import annotations

import json
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

THRESHOLD, CONFIRM, SHARE = 0.6, 0.5, 0.6
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0", "This project is released under the Apache 2.0 license."],
    "MIT": ["Released under the MIT License.", "This project is licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Released under the BSD 3-Clause License.", "Licensed under the BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Released under the GNU GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "Proprietary": ["All rights reserved.", "Copyright, all rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
UNKNOWN = [
    "He renewed his driving license last week and drove to work.", "The licensed plumber came to fix the sink.", "Copyright law was debated in parliament.", "The warranty on my phone has expired.", "The minister asked for a redistribution of income.", "The castle gardens are in the public domain of the town.", "She studied physics at MIT before the war.", "Apache helicopters flew over the valley.", "A fishing licence costs ten pounds a year.", "The copyright of the song belongs to the band.", "The creative commons room is open to all pupils.", "The general public was not admitted.", "Police have a warrant for his arrest.", "The software licence fee rose again this year.", "Version 2.0 of the game was released.", "Poetic license allows such lines.", "The bar lost its license to sell alcohol.", "Read the license before you install the program.", "Our terms of use may change.", "The author kept the copyright and the royalties.",
]
TRIGGER = r"(?i)licen[sc]e|copyright|copyleft|warrant|redistribut|public domain|rights reserved|\bgpl\b|\bspdx\b|creative commons|\bcc[ -]by|permission (?:is|to|notice)|unencumbered|proprietary|apache\.org"
SPLIT = r"(?<=[.!?])\s+(?=[\p{Lu}(])"
WORD = r"[a-z0-9.]+"  # without the dots at its end
FAMILIES = [*sorted(TEMPLATES), "unknown"]


def grams(text: str) -> set[str]:
    w = [x for x in (m.rstrip(".") for m in re.findall(WORD, text.lower())) if x]
    return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def train(rounds: int = 300, seed: int = 5) -> tuple[dict[str, list[float]], list[float]]:
    """(weights by gram, bias), already divided by the temperature."""
    rng = random.Random(seed)
    rows: list[tuple[set[str], int, bool]] = []
    for k, family in enumerate(FAMILIES):
        for text in TEMPLATES.get(family, UNKNOWN):
            words = text.split()
            for variant in range(8):
                kept = words if variant == 0 or len(words) < 5 else [w for w in words if rng.random() > 0.1]
                extra = rng.choice(UNKNOWN).split()[: rng.randrange(4)] if variant > 4 and family != "unknown" else []
                rows.append((grams(" ".join([*extra, *kept])), k, variant == 7))
    vocabulary = sorted(set().union(*(g for g, _, _ in rows)))
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)))
    for r, (g, _, _) in enumerate(rows):
        x[r, [at[w] for w in g]] = 1 / np.sqrt(len(g))
    y, held = np.eye(len(FAMILIES))[[k for _, k, _ in rows]], np.array([h for _, _, h in rows])
    w, b = np.zeros((len(vocabulary), len(FAMILIES))), np.zeros(len(FAMILIES))
    share = np.where(y[:, -1] > 0, 2.0, 1.0)[:, None]

    def softmax(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for _ in range(rounds):
        g = (softmax(x[~held] @ w + b) - y[~held]) * share[~held] / (~held).sum()
        w -= 20 * (x[~held].T @ g + 1e-5 * w)
        b -= 20 * g.sum(0)
    loss = lambda t: -np.log((softmax((x[held] @ w + b) / t) * y[held]).sum(1) + 1e-12).mean()
    t = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0), key=loss)
    return {g: (w[i] / t).round(6).tolist() for g, i in at.items()}, (b / t).round(6).tolist()


def _constants(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of constants as one JSON literal: no Python data source in the plan."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("x")).select("x.*")


def _grams(words, n: int):
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def classify(paragraphs: DataFrame) -> DataFrame:
    """(key, family, probability, confirmed) of a table of distinct paragraphs (key, paragraph)."""
    spark = paragraphs.sparkSession
    weights, bias = train()
    model = _constants(spark, [{"gram": g, "w": w} for g, w in weights.items()], "gram: string, w: array<double>")
    threes = [(f, sorted(g for g in grams(t) if g.count(" ") == 2)) for f, texts in TEMPLATES.items() for t in texts]
    shapes = [{"gram": g, "families": sorted({f for f, of in threes if g in of}), "templates": [i for i, (_, of) in enumerate(threes) if g in of]} for g in sorted({g for _, of in threes for g in of})]
    shapes = _constants(spark, shapes, "gram: string, families: array<string>, templates: array<int>")
    words = F.filter(F.transform(F.regexp_extract_all(F.lower("paragraph"), F.lit(WORD), F.lit(0)), lambda m: F.rtrim(m, F.lit("."))), lambda x: x != "")
    held = paragraphs.withColumn("words", words)
    held = held.withColumn("grams", F.array_distinct(F.concat(_grams(F.col("words"), 1), _grams(F.col("words"), 2), _grams(F.col("words"), 3)))).drop("words")
    each = held.select("key", F.greatest(F.size("grams"), F.lit(1)).alias("n"), F.explode_outer("grams").alias("gram"))
    joined = each.join(F.broadcast(model), "gram", "left").join(F.broadcast(shapes), "gram", "left")
    k = len(FAMILIES)
    sums = joined.groupBy("key", "n").agg(
        *[F.sum(F.coalesce(F.get("w", F.lit(i)), F.lit(0.0))).alias(f"s{i}") for i in range(k)],
        *[F.count_if(F.array_contains("families", f)).alias(f"m{i}") for i, f in enumerate(FAMILIES[:-1])],
        F.count_if(F.size(F.split("gram", " ")) == 3).alias("threes"),
        F.flatten(F.collect_list("templates")).alias("seen"),
    )
    z = F.array(*[F.struct((F.col(f"s{i}") / F.sqrt("n") + F.lit(bias[i])).alias("z"), F.lit(-i).alias("order"), F.lit(f).alias("family"), (F.col(f"m{i}") if i < k - 1 else F.lit(0).cast("long")).alias("match")) for i, f in enumerate(FAMILIES)])
    best = sums.withColumn("z", z).withColumn("top", F.array_max("z"))
    probability = 1 / F.aggregate("z", F.lit(0.0), lambda a, e: a + F.exp(e["z"] - F.col("top.z")))
    confirmed = (F.col("top.match") >= F.lit(CONFIRM) * F.greatest("threes", F.lit(1))) | (F.col("top.match") >= 4)
    for family, own in ((f, [(i, len(of)) for i, (g, of) in enumerate(threes) if g == f and of]) for f in sorted(TEMPLATES)):
        held_by = [F.size(F.filter("seen", lambda x, i=i: x == i)) >= SHARE * total for i, total in own]
        confirmed = confirmed | ((F.col("top.family") == family) & F.greatest(*held_by, F.lit(False)))
    return best.select("key", F.col("top.family").alias("family"), probability.alias("probability"), (confirmed & (F.col("top.family") != "unknown") & (probability >= THRESHOLD)).alias("confirmed"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, license (most paragraphs, then first by name; "none"), families, n_paragraphs, confidence."""
    text = F.col("text").cast("string")
    lines = docs.where(text.rlike(TRIGGER)).select("doc_id", F.explode(F.split(text, "\n")).alias("line")).where(F.col("line").rlike(TRIGGER))
    split = lines.select("doc_id", F.md5("line").alias("at"), "line", F.split("line", SPLIT).alias("of"))
    one = lambda p, whole: F.struct(F.trim(p).alias("paragraph"), F.lit(whole).alias("whole"))
    units = F.concat(F.transform("of", lambda p: one(p, False)), F.when(F.size("of") > 1, F.array(one(F.col("line"), True))).otherwise(F.array().cast("array<struct<paragraph:string,whole:boolean>>")))
    parts = split.select("doc_id", "at", F.explode(units).alias("u")).select("doc_id", "at", "u.*").where(F.col("paragraph").rlike(TRIGGER)).withColumn("key", F.md5("paragraph"))
    found = parts.groupBy("doc_id", "at", "key", "whole").count()
    known = classify(parts.select("key", "paragraph").distinct()).where("confirmed")
    first = F.min("whole").over(Window.partitionBy("doc_id", "at"))
    hits = found.join(known, "key").withColumn("first", first).where(F.col("whole") == F.col("first")).groupBy("doc_id", "family").agg(F.sum("count").alias("n"), F.max("probability").alias("p"))
    per = hits.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.struct(-F.col("n"), "family", "p")).alias("first"), F.array_sort(F.collect_set("family")).alias("families"), F.sum("n").alias("n"), F.lit(True).alias("has"))
    out = docs.select("doc_id").join(per, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("has"), "left")
    return out.select("doc_id", F.coalesce("first.family", F.lit("none")).alias("license"), F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("n", F.lit(0)).cast("long").alias("n_paragraphs"), F.round(F.coalesce("first.p", F.lit(0.0)), 6).alias("confidence"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))

"""Licence scan: a trained paragraph classifier over word n-grams, confirmed by template comparison.

Fitting uses Spark ML (CountVectorizer and multinomial logistic regression) on
the phrases below (licence texts, headers, and names in usual short notices),
notices of other licences as the class "unknown", and ordinary sentences about
licences with a bounded sample of corpus paragraphs as the class "none".  Scanning uses DataFrame functions only.
"""

from __future__ import annotations

import json
import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import id_text

NONE = "none"
#: How notices of each family are commonly worded (our training templates).
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This software is distributed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Released under the BSD License.",
        "This code is licensed under the 3-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "Released under the GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Released under the LGPL, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the MPL 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Shared under CC BY-NC-SA 3.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike license, CC BY-SA 3.0.",
    ],
    "public-domain": [
        "This work has been released into the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
    ],
}
#: Further families, and more of the wording of the others (parts of the licence texts themselves).
for _family, _texts in {
    "apache-2.0": [
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "bsd": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "gpl": [
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "mpl": [
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    ],
    "artistic": [
        "You may redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    ],
    "zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    ],
}.items():
    TEMPLATES.setdefault(_family, []).extend(_texts)
#: How the families are called in short notices.
NAMES = {
    "apache-2.0": ["Apache 2.0", "Apache License 2.0", "Apache-2.0", "Apache License, Version 2.0", "Apache Software License"],
    "mit": ["MIT", "MIT License", "Expat License", "MIT/X11 License"],
    "bsd": ["BSD", "BSD License", "BSD-style license", "3-clause BSD", "BSD-2-Clause", "BSD 3-Clause License", "New BSD License"],
    "gpl": ["GPLv2", "GPLv3", "GPL v3", "GNU GPL", "GNU General Public License", "GPL-2.0", "GPL 3.0"],
    "lgpl": ["LGPLv2.1", "LGPLv3", "LGPL v3", "GNU LGPL", "GNU Lesser General Public License", "LGPL-2.1"],
    "mpl": ["MPL 2.0", "MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 3.0", "Creative Commons Attribution-NonCommercial"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0", "CC BY-SA 4.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution-ShareAlike"],
    "public-domain": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "the Unlicense"],
    "isc": ["ISC", "ISC License"],
    "epl": ["EPL 2.0", "EPL-1.0", "Eclipse Public License"],
    "boost": ["Boost Software License", "Boost License", "BSL-1.0"],
    "artistic": ["Artistic License", "Artistic License 2.0", "Artistic-2.0"],
    "zlib": ["zlib license", "zlib/libpng license"],
}
#: Short notices that a name is put into.
FRAMES = ["Licensed under {}.", "Licensed under the {} license.", "License: {}", "Released under {}.", "Released under the {} license.",
          "Distributed under the {}.", "{} licensed", "This file is covered by the {}; see LICENSE for details."]
#: Names of licences that are no family here: put into the same frames, the examples of the class "unknown".
OTHER_NAMES = ["Acme Community License", "custom license", "vendor agreement", "Open Software License 3.0", "European Union Public Licence", "Affero General Public License",
               "Business Source License 1.1", "Server Side Public License", "Elastic License 2.0", "proprietary terms", "commercial license agreement", "Academic Free License",
               "SIL Open Font License", "WTFPL", "Microsoft Reciprocal License", "Q Public License", "Sleepycat License", "end user license agreement"]
UNKNOWN = "unknown"
#: Notices of no family here that fit no frame.
OTHER_NOTICES = [
    "This document is licensed under a custom license.",
    "Licensed under the proprietary terms of the vendor agreement.",
    "Use of this software is governed by the license agreement that came with it.",
    "This font software is licensed under the SIL Open Font License, Version 1.1.",
    "You may use these files for evaluation only, as your license agreement allows.",
    "This program is subject to the terms of the GNU Affero General Public License, version 3.",
]
#: Sentences that name licences, permission or copyright without being a notice.
NOT_NOTICES = [
    "You need a license to drive a truck in this state.",
    "The license plate was found near the river.",
    "Permission to enter the building was granted by the council.",
    "All rights reserved.",
    "Copyright 2021 by the author. All rights reserved.",
    "The software was installed on the public library computers.",
    "Fishing licenses are issued under the terms of the state code.",
    "The apache helicopter landed at the general hospital.",
    "Version 2.0 of the report was released to the public.",
    "He works at MIT and lives in Boston.",
    "The fishing vessel is licensed under the laws of Panama.",
    "Licensed under the proprietary terms of the vendor agreement.",
    "This document is licensed under a custom license.",
    "She studied at the MIT media lab in Cambridge.",
    "The Apache people lived in the south west.",
    "Her driving license was suspended for a year.",
    "The artistic director of the theatre resigned.",
    "The band got a boost from the radio.",
    "An eclipse of the sun is seen by the public.",
    "The mozilla browser was released in 2002.",
    "The pharmacy is licensed by the board of health.",
    "The nature of the attribution is disputed by scholars.",
    "The commons voted against the bill.",
    "A gnu is a large animal of the plains.",
    "Permission is required to copy the exhibits of the museum.",
    "The council granted a liquor license to the hotel.",
    "The zip code is printed on the form.",
    "Proof of purchase and your license number are required.",
    "The general public is invited to the lesser hall.",
    "The files were distributed to all members of the committee.",
]
#: Words of ordinary texts ("mit" is also German, "nd" and "sa" are syllables): an n-gram of nothing else is no feature, and none
#: of them alone opens a paragraph.
COMMON = ("a above all along also an and any anyone appear are as at available be been binary both but by can charge clause code "
          "conditions copy covered details distributed each either file files following for form forms free from general granted has have "
          "her here his hereby how i if in into is it its later library may met mit modify must nc nd neither no nor not of on one "
          "only or other our out own person program project provided public released sa see shared she so some source subject such "
          "terms text than that the their them then there these they this those to too under up use v version was we were what when "
          "where which who will with without work would you your").split()
#: Paragraphs of the corpus read when fitting (lowest hashes; whole ones, of at most so many words).
FIT_PARAGRAPHS, FIT_WORDS = 2000, 120
#: Copies of each phrase when fitting, with words around them taken from corpus paragraphs.
FIT_COPIES = 3
#: Share of a template's 3-grams that confirms a prediction.
CONFIRM = 0.6
#: What the share of a short notice counts: its name alone, inside another sentence, confirms nothing.
SHORT = 0.75
#: Weight of all examples of "none" against all others, and share of the held-back ones that may pass for a known family.
NONE_WEIGHT, FALSE_KNOWN = 0.4, 0.01
#: Words that name no family: the common ones but "mit", and these.
GENERIC = {*COMMON, "license", "licensed"} - {"mit"}


def tokens(text: Column) -> Column:
    """Lower-case ASCII words and numbers."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))


def ngrams(words: Column) -> Column:
    """Distinct 1-, 2- and 3-grams that hold at least one word that is no function word."""
    every = F.concat(words, _grams(words, 2), _grams(words, 3))
    dull = "^(?:" + "|".join(COMMON) + ")(?: (?:" + "|".join(COMMON) + "))*$"
    return F.array_distinct(F.filter(every, lambda g: ~g.rlike(dull) & ~g.rlike("^[0-9 ]+$")))


class LicenceModel:
    """Weights by n-gram, biases, the unknown threshold, and the templates' 3-grams.  Plain lists, a few hundred entries."""

    def __init__(self, classes: list[str], features: dict[str, list[float]], bias: list[float], threshold: float):
        self.classes, self.features, self.bias, self.threshold = classes, features, bias, threshold
        self.content = sorted({w for g in features for w in g.split() if w not in COMMON and not w.isdigit()})

    @classmethod
    def fit(cls, docs: DataFrame) -> LicenceModel:
        """Fit on the phrases of all families, on notices of other licences ("unknown"), on ``NOT_NOTICES`` and on at
        most ``FIT_PARAGRAPHS`` corpus paragraphs ("none").

        Corpus paragraphs that hold most of a template's 3-grams are left out of "none".  Every third sentence of
        "none" and "unknown" is held back whole: no copy of it is fitted.  The threshold for a
        known family is calibrated on them: the share FALSE_KNOWN of them gives some family a
        higher probability (0.5 at least, 0.95 at most), so what resembles no family stays unknown.
        """
        spark = docs.sparkSession
        order = F.xxhash64(F.lit(11), "doc_id")
        # only hashes low enough to be among the lowest go to the sort, so its size does not grow with the corpus
        low = -float(1 << 63) + float(1 << 64) * min(1.0, 4 * FIT_PARAGRAPHS / max(docs.count(), 1))
        paras = (id_text(docs).where(order <= F.lit(low)).where("text != ''").select(order.alias("o"), F.explode(F.split("text", "\n")).alias("p"))
                 .select("o", tokens(F.col("p")).alias("w")).where((F.size("w") > 0) & (F.size("w") <= FIT_WORDS))
                 .orderBy(F.xxhash64("o", "w")).limit(FIT_PARAGRAPHS).select("w"))
        around = [list(r.w) for r in paras.collect()]
        own = phrases()
        known = [_threes(t) for ts in own.values() for t in ts]
        none = [w for w in around if not any(len(_threes(w) & k) >= CONFIRM * len(k) for k in known if k)]
        plain = [_plain_words(t) for t in NOT_NOTICES if t not in OTHER_NOTICES]
        other = [_plain_words(t) for t in OTHER_NOTICES] + [_plain_words(f.format(n)) for n in OTHER_NAMES for f in FRAMES]

        def copies(t: list[str], n: int, seed: int) -> list[list[str]]:
            """``t`` alone, then among words of corpus paragraphs."""
            got = [t]
            for j in range(1, n):
                extra = around[(seed * 7 + j) % len(around)] if around else []
                got.append([*extra[:j], *t, *extra[j:2 * j]])
            return got
        rows = [(NONE, w, int(i % 3 == 2)) for i, w in enumerate(none)]
        rows += [(NONE, c, int(i % 3 == 2)) for i, t in enumerate(plain) for c in copies(t, 2 * FIT_COPIES, i)]
        rows += [(UNKNOWN, c, int(i % 3 == 2)) for i, t in enumerate(other) for c in copies(t, FIT_COPIES, i)]
        rows += [(f, c, 0) for f, ts in own.items() for i, t in enumerate(ts) for c in copies(t, FIT_COPIES, i)]
        classes = [NONE, *own, UNKNOWN]
        frame = spark.createDataFrame([(classes.index(c), w, side) for c, w, side in rows], "label int, w array<string>, side int")
        frame = frame.select("label", "side", ngrams(F.col("w")).alias("grams")).checkpoint()
        # features are n-grams of the phrases themselves: corpus words placed around a copy must not become
        # features, or a frequent one ("en") would send most of a corpus through the classifier
        counts = CountVectorizerModel.from_vocabulary(_vocabulary({**own, UNKNOWN: other}), inputCol="grams", outputCol="x")
        counts.setBinary(True)
        x = counts.transform(frame)
        lr = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", regParam=0.0005, elasticNetParam=0.1, maxIter=80)
        n_none = sum(c == NONE and not side for c, _, side in rows)
        weight = F.when(F.col("label") == 0, NONE_WEIGHT * len(rows) / max(1, n_none)).otherwise(1.0)  # so that "none" wins without features
        model = lr.setWeightCol("weight").fit(x.where("side = 0").withColumn("weight", weight))
        held = model.transform(x.where("side = 1")).select(vector_to_array("probability").alias("p"))
        worst = held.agg(F.percentile(F.array_max(F.slice("p", 2, len(own))), 1 - FALSE_KNOWN)).first()[0] or 0.0  # held back: a bounded sample
        coef = model.coefficientMatrix.toArray()
        features = {g: [round(float(v), 6) for v in coef[:, i]] for i, g in enumerate(counts.vocabulary) if abs(coef[:, i]).max() > 1e-6}
        return cls(classes, features, [float(b) for b in model.interceptVector], max(0.5, min(worst, 0.95)))


def short_notices(family: str) -> list[list[str]]:
    """Words of the family's names in all frames."""
    return [_plain_words(x.format(n)) for n in NAMES.get(family, ()) for x in FRAMES]


def phrases() -> dict[str, list[list[str]]]:
    """Words of every family's templates and short notices."""
    return {f: [_plain_words(t) for t in ts] + short_notices(f) for f, ts in TEMPLATES.items()}


def _plain_words(text: str) -> list[str]:
    import re
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def _vocabulary(own: dict[str, list[list[str]]]) -> list[str]:
    """The n-grams of all templates that ``ngrams`` keeps, in order (a few hundred, whatever the corpus)."""
    every = {tuple(t[i:i + n]) for ts in own.values() for t in ts for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    return sorted(" ".join(g) for g in every if not all(w in COMMON for w in g) and not all(w.isdigit() for w in g))


def _threes(words: list[str]) -> set[str]:
    return {" ".join(words[i:i + 3]) for i in range(len(words) - 2)} or {" ".join(words)}


def _own(family: str) -> list[str]:
    """3-grams of the family's templates that no other family has and that hold a naming word.

    A header of a kindred licence ("GNU Lesser General ...") holds most 3-grams of the other's template but none of these.
    """
    own = phrases()
    others = {g for f, ts in own.items() if f != family for t in ts for g in _threes(t)}
    mine = {g for t in own[family] for g in _threes(t)}
    return sorted(g for g in mine - others if not all(w in GENERIC or w.isdigit() for w in g.split()))


def _constant(value, kind: str) -> Column:
    """A folded literal of a nested type."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where a lambda inside uses it."""
    return F.transform(F.array(value), body)[0]


def _units(lines: Column) -> Column:
    """(block, joined, paragraph, w): every visible line, and every block of several visible lines as one.

    A block is a run of lines that hold a letter or digit (a line of comment marks alone ends it, and marks beside
    words are no tokens); ``block`` and a joined ``paragraph`` are the index of its first line.
    """
    rows = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.regexp_replace(x, r"(?i)^\s*(?:dnl|rem)\s", "").alias("x")))
    rows = F.transform(rows, lambda r: F.struct(r["at"].alias("at"), r["x"].rlike(r"[\p{L}\p{N}]").alias("shown"), tokens(r["x"]).alias("w")))

    def split(r: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: F.get(r, i)["shown"] & ~F.coalesce(F.get(r, i - 1)["shown"], F.lit(False)))
        return _bound(starts, lambda s: F.transform(s, lambda at, k: F.filter(
            F.slice(r, at + 1, F.coalesce(F.get(s, k + 1), F.size(r)) - at), lambda x: x["shown"])))

    def units(b: Column) -> Column:
        at = b[0]["at"]
        single = F.transform(b, lambda r: F.struct(at.alias("block"), F.lit(False).alias("joined"), r["at"].alias("paragraph"), r["w"].alias("w")))
        whole = F.struct(at.alias("block"), F.lit(True).alias("joined"), at.alias("paragraph"), F.flatten(b["w"]).alias("w"))
        return F.when(F.size(b) > 1, F.concat(single, F.array(whole))).otherwise(single)
    return F.flatten(F.transform(_bound(rows, split), units))


def _chosen(entries: Column) -> Column:
    """A block adds the families that none of its lines confirms, and then replaces its unconfirmed
    lines; where nothing of a block was found by line, it counts as it was judged."""
    def name(e: Column) -> Column:
        return F.struct(e["block"].alias("block"), e["family"].alias("family"))

    def choose(e: Column) -> Column:
        by_line = F.array_distinct(F.transform(F.filter(e, lambda x: ~x["joined"] & x["confirmed"]), name))
        seen = F.array_distinct(F.transform(F.filter(e, lambda x: ~x["joined"]), lambda x: x["block"]))
        return _bound(F.struct(by_line.alias("by_line"), seen.alias("seen")), lambda k: _bound(
            F.array_distinct(F.transform(F.filter(e, lambda x: x["joined"] & x["confirmed"] & ~F.array_contains(k["by_line"], name(x))), lambda x: x["block"])),
            lambda new: F.filter(e, lambda x: F.when(x["joined"] & x["confirmed"], ~F.array_contains(k["by_line"], name(x)))
                                 .when(x["joined"], ~F.array_contains(k["seen"], x["block"]))
                                 .otherwise(x["confirmed"] | ~F.array_contains(new, x["block"])))))
    return _bound(entries, choose)


def scan_paragraphs(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """(doc_id, found): the paragraphs of every text that read like a licence notice.

    ``found`` is an array of (paragraph, family, score, likeness, confirmed).
    Paragraphs are the single lines and the blocks of consecutive non-blank
    lines (a notice wrapped over lines); ``paragraph`` is the index of the
    (first) line.  A paragraph is scored by the classifier.  Every family of
    which it holds at least ``CONFIRM`` of a template's 3-grams, one that names
    the family among them, is confirmed with an entry of its own.  Without
    any, the entry has the likeliest family, `unknown` where its probability
    is under the calibrated threshold and "none" does not win.  Paragraphs
    without any word of a feature have the bias alone, which is "none", so
    they are passed over.  Null and empty texts find nothing; ids may be null
    or repeated; texts are read whole; other columns are ignored.  No shuffle.
    """
    if max(model.bias) != model.bias[0]:
        raise ValueError("without features the class must be 'none'")
    content = F.array(*[F.lit(w) for w in model.content])
    words = F.split(F.lower("text"), "[^a-z0-9]+")
    weights = _constant([{"g": g, "w": w} for g, w in model.features.items()], "array<struct<g:string,w:array<double>>>")
    known = _constant(list(model.features), "array<string>")
    bias = _constant(model.bias, "array<double>")
    cut = {f: [sorted(_threes(_plain_words(t))) for t in ts] for f, ts in TEMPLATES.items()}
    short = {f: [sorted(_threes(t)) for t in short_notices(f)] for f in TEMPLATES}
    forms = _constant([{"f": f, "t": cut[f], "s": short[f], "own": _own(f)} for f in TEMPLATES],
                      "array<struct<f:string,t:array<array<string>>,s:array<array<string>>,own:array<string>>>")
    every = _constant(sorted({g for ts in (*cut.values(), *short.values()) for t in ts for g in t}), "array<string>")

    # each step's values are bound by a transform of its own, so that no lambda computes them again per feature
    def keep(p: Column) -> list[Column]:
        return [p[c].alias(c) for c in ("block", "joined", "paragraph")]

    def bind(p: Column) -> Column:
        threes = F.array_intersect(F.when(F.size(p["w"]) >= 3, _grams(p["w"], 3)).otherwise(F.array(F.array_join(p["w"], " "))), every)
        grams = F.array_intersect(F.concat(p["w"], _grams(p["w"], 2), _grams(p["w"], 3)), known)  # what no feature names weighs nothing
        return F.struct(*keep(p), threes.alias("threes"), grams.alias("grams"))

    def score(p: Column) -> Column:
        z = F.aggregate(F.filter(weights, lambda x: F.array_contains(p["grams"], x["g"])), bias,
                        lambda acc, x: F.zip_with(acc, x["w"], lambda a, b: a + b))
        return F.struct(*keep(p), p["threes"].alias("threes"), z.alias("z"))

    def soft(s: Column) -> Column:
        e = F.transform(s["z"], lambda v: F.exp(v - F.array_max(s["z"])))
        total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
        prob = F.transform(e, lambda v: v / total)
        return F.struct(*keep(s), s["threes"].alias("threes"), prob.alias("prob"))

    def judge(s: Column) -> Column:
        def most(ts: Column) -> Column:
            return F.coalesce(F.array_max(F.transform(ts, lambda t: F.size(F.array_intersect(t, s["threes"])) / F.size(t))), F.lit(0.0))
        each = F.transform(forms, lambda x, k: F.struct(
            x["f"].alias("family"), F.get(s["prob"], k + 1).alias("score"), F.greatest(most(x["t"]), SHORT * most(x["s"])).alias("likeness"),
            F.arrays_overlap(x["own"], s["threes"]).alias("own")))

        def entry(x: Column, family: Column, confirmed: bool) -> Column:
            return F.struct(*keep(s), family.alias("family"), x["score"].alias("score"), x["likeness"].alias("likeness"), F.lit(confirmed).alias("confirmed"))

        def entries(e: Column) -> Column:
            best = F.array_max(e["score"])
            sure = F.filter(e, lambda x: (x["likeness"] >= CONFIRM) & x["own"])
            first = F.filter(e, lambda x: x["score"] == best)[0]
            return F.when(F.size(sure) > 0, F.transform(sure, lambda x: entry(x, x["family"], True))).otherwise(
                F.array(entry(first, F.when(best >= model.threshold, first["family"]).otherwise(F.lit(UNKNOWN)), False)))
        return _bound(each, entries)
    d = id_text(docs).select("doc_id", F.when(F.arrays_overlap(words, content), F.filter(_units(F.split("text", "\n")), lambda p: F.arrays_overlap(p["w"], content))).alias("paras"))
    d = d.select("doc_id", F.when(F.size("paras") > 0, F.transform(F.transform("paras", bind), score)).alias("scored"))
    d = d.select("doc_id", F.transform("scored", soft).alias("scored"))
    d = d.select("doc_id", F.filter("scored", lambda s: s["prob"][0] < 0.5).alias("scored"))
    d = d.select("doc_id", _chosen(F.flatten(F.transform("scored", judge))).alias("found"))
    fields = ("paragraph", "family", "score", "likeness", "confirmed")
    return d.select("doc_id", F.coalesce(F.transform("found", lambda f: F.struct(*[f[c].alias(c) for c in fields])),
                                         F.expr("cast(array() as array<struct<paragraph:int,family:string,score:double,likeness:double,confirmed:boolean>>)")).alias("found"))


def scan(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """One row per document: its confirmed families (comma-joined, sorted), how many paragraphs
    read like a notice, how many of them are of unknown family, and the best score (0 without any)."""
    d = scan_paragraphs(docs, model)
    sure = F.filter("found", lambda f: f["confirmed"])
    return d.select("doc_id",
                    F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda f: f["family"]))), ",").alias("licences"),
                    F.size(F.array_distinct(F.transform("found", lambda f: f["paragraph"]))).cast("long").alias("n_notices"),
                    F.size(F.filter("found", lambda f: f["family"] == "unknown")).cast("long").alias("n_unknown"),
                    F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0)).alias("best_score"))


def load_model(spark: SparkSession, path: str) -> LicenceModel:
    """A model saved by ``save_model``."""
    r = spark.read.json(path).first()
    return LicenceModel(list(r.classes), {g: list(w) for g, w in zip(r.grams, r.weights)}, list(r.bias), r.threshold)


def save_model(spark: SparkSession, model: LicenceModel, path: str) -> None:
    """One JSON line: classes, n-grams, weights, biases, threshold."""
    if not math.isfinite(model.threshold):
        raise ValueError("threshold")
    spark.createDataFrame([(model.classes, list(model.features), list(model.features.values()), model.bias, model.threshold)],
                          "classes array<string>, grams array<string>, weights array<array<double>>, bias array<double>, threshold double").coalesce(1).write.json(path)

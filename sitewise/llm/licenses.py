"""Find licence paragraphs with a trained classifier, and confirm them by templates.

A sparse multinomial logistic regression over word one- and two-grams tells the families and "none" apart. It is
trained on the templates, on variants that lack a word each, and on paragraphs of the corpus: all that nearly are
a template, and half of all others with a cue as "none". The probability from which a family is believed is calibrated on
the other half; below it, or if the family's templates look different, the family is unknown. Only SQL
functions and the library's own JVM transformers run.
"""
from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.session import settle

# Families and what their notices say.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "SPDX-License-Identifier: MPL-2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("public-domain", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
    ("proprietary", "Copyright. All rights reserved. No part of this work may be reproduced without written permission of the owner."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("proprietary", "All rights reserved."),
)
NONE = "none"
UNKNOWN = "unknown"
FEATURES = 1 << 14
PACKED = 7  # counts of templates in one long, a byte each
# Share of ordinary paragraphs with a cue that may pass for a family.
FALSE_SHARE = 0.001
LEAST_PROBABILITY = 0.5
LEAST_SIMILARITY = 0.6
# Template words that tell nothing; every other template word is a cue, however often the corpus has it.
PLAIN_WORDS = frozenset("a all and any are be been by except for has in is it may as at do either if includes including on one see so was whom above kind law can list must no not of or out that the this to under use with without you".split())
# Paragraphs with one of these words, or with "rights reserved", are notices: reported at least as unknown, never learnt as ordinary.
NOTICE_WORDS = ("license", "licence", "licensed", "licenced", "copyright", "copyrighted", "spdx-license-identifier")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.+-]+|[.](?=\s|$|[^\p{N}])"), lambda w: w != "")


def _grams(words: str) -> Column:
    return F.expr(f"concat({words}, if(size({words}) > 1, transform(sequence(0, size({words}) - 2), i -> concat({words}[i], ' ', {words}[i + 1])), cast(array() as array<string>)))")


def _notice(words: str) -> Column:
    return F.arrays_overlap(words, F.lit(list(NOTICE_WORDS))) | F.expr(
        f"size(filter({words}, (w, i) -> w = 'reserved' and i > 0 and {words}[greatest(i - 1, 0)] = 'rights')) > 0")


def _jaccard(of: str, words: str) -> str:
    return f"size(array_intersect({of}, {words})) / size(array_union({of}, {words}))"


def _known(words: list[str]) -> str:
    return "array(" + ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words)) + ")"


def _places(words: str, every: list[str]) -> Column:
    return F.expr(f"transform({words}, w -> cast(array_position({_known(every)}, w) as int))")


def _counts(places: str, every: list[str], templates: list[tuple[str, list[str]]]) -> Column:
    """How many of ``places`` (from 1, in ``every``) each template has. A template word adds 1 to a byte for each template that has it,
    so that all are counted by a few additions; no template has more than 255 different words."""
    each = []
    for first in range(0, len(templates), PACKED):
        packed = [sum(1 << 8 * i for i, (_, known) in enumerate(templates[first:first + PACKED]) if w in known) for w in every]
        total = f"aggregate({places}, 0L, (a, p) -> a + array({', '.join(f'{x}L' for x in packed)})[p - 1])"
        each.append(f"transform(array({total}), a -> array({', '.join(f'cast(shiftright(a, {8 * i}) & 255L as int)' for i in range(len(templates[first:first + PACKED])))}))[0]")
    return F.expr(f"concat({', '.join(each)})")


def _windows(templates: list[tuple[str, list[str]]]) -> Column:
    """By ``shared`` (and ``ahead``, the same of ``stream``), for each template the best of ``words`` and of the windows of the template's length that begin in them, as an
    array of (s, f, start, n); start -1 is ``words`` itself. Windows within ``words`` begin an eighth of the template
    apart. Those that run on in ``stream``, which begins with ``words``, begin like the template, so that a notice of
    the next line is not found in this one. Templates whose words are missing are not looked for."""
    each = []
    for i, (family, words) in enumerate(templates):
        n = len(words)
        known = _known(words)
        enough = LEAST_SIMILARITY * len(set(words))
        whole = f"shared[{i}] / (shared[{len(templates)}] + {len(set(words))} - shared[{i}])"
        each.append(f"""array_max(concat(array(named_struct('s', {whole}, 'f', '{family}', 'start', -1, 'n', size(words))),
            if(shared[{i}] >= {enough}, transform(sequence(0, size(words) - 1, {max(1, n // 8)}), p ->
               named_struct('s', {_jaccard(f"slice(words, p + 1, {n})", known)}, 'f', '{family}', 'start', p, 'n', least({n}, size(words) - p))), null_windows),
            if(ahead[{i}] >= {enough}, transform(
               filter(sequence(greatest(0, size(words) - {n - 1}), size(words) - 1), p -> array_contains(slice({known}, 1, 3), words[p])
                      and size(array_except(slice(words, p + 1, {n}), {known})) <= (size(words) - p) / 4), p ->
               named_struct('s', {_jaccard(f"slice(stream, p + 1, {n})", known)}, 'f', '{family}', 'start', p, 'n', {n})), null_windows)))""")
    empty = "cast(array() as array<struct<s:double,f:string,start:int,n:int>>)"
    return F.expr("array(" + ", ".join(each).replace("null_windows", empty) + ")")


def _candidates(docs: DataFrame, key: str, text: str, cues: list[str], longest: int) -> DataFrame:
    """(key, paragraph, words, stream) of the lines with a cue. ``stream`` goes on over following lines up to a blank
    one, by as many words as the longest template has."""
    # generated, not projected: a filter or a later use would split and tokenize the whole text again for every line
    lined = docs.select(F.col(key), F.explode(F.array(F.transform(F.split(F.col(text).cast("string"), "\n"), lambda line: _words(line)))).alias("_lines"))
    at = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: F.arrays_overlap(F.col("_lines")[i], F.lit(cues)))
    marked = lined.select(key, "_lines", F.explode(F.array(at)).alias("_at"))  # again, for the filter below
    after = f"slice(_lines, i + 2, {longest})"
    blank = f"array_position(transform({after}, x -> size(x)), 0)"
    stream = f"slice(concat(_lines[i], flatten(slice({after}, 1, if({blank} = 0, {longest}, cast({blank} as int) - 1)))), 1, size(_lines[i]) + {longest})"
    return marked.where("size(_at) > 0").select(key, F.explode(F.expr(
        f"transform(_at, i -> named_struct('paragraph', i, 'words', _lines[i], 'stream', {stream}))")).alias("_c")).select(key, "_c.*")


def find_licences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, paragraph, family, probability, similarity, confirmed) of every paragraph that looks like a licence.

    A paragraph is a line; a notice that begins in it may end in a later one, and may be a part of it. A line is reported if it is a notice by NOTICE_WORDS, or holds a cue word and the classifier
    finds some family likelier than none. Cue words come from the templates alone. family is `unknown` unless its probability reaches the calibrated limit and a template of that family is
    similar enough, which is what ``confirmed`` says. Null and empty texts give no rows; rows that repeat a key give
    theirs each. Extra columns are ignored.
    """
    spark = docs.sparkSession
    templates = spark.createDataFrame(TEMPLATES, "label string, body string").withColumn("words", _words(F.col("body")))
    listed = [(r["label"], r["words"]) for r in templates.select("label", "words").collect()]
    every = sorted({w for _, words in listed for w in words})
    cues = [w for w in every if len(w) > 1 and w not in PLAIN_WORDS]
    cues += [w for w in NOTICE_WORDS if w not in cues]
    # what follows reads paragraphs with a cue only
    best = F.array_max("each")
    found = _candidates(docs, key, text, cues, max(len(w) for _, w in listed))
    found = found.withColumn("_ahead", F.array_intersect("stream", F.lit(every)))
    found = found.withColumn("_own", F.array_intersect("words", "_ahead")).withColumns({c: _places(c, every) for c in ("_own", "_ahead")})
    found = found.withColumn("shared", F.concat(_counts("_own", every, listed), F.array(F.size(F.array_distinct("words"))))).withColumn("ahead", _counts("_ahead", every, listed))
    found = found.withColumn("each", _windows(listed)).withColumn("best", best)
    order = [NONE, *sorted({f for f, _ in TEMPLATES})]
    # the best of each family is all that is asked for later: a third of the table's width
    of_family = [f"array_max(array({', '.join(f'each[{i}].s' for i, (f, _) in enumerate(listed) if f == family)}))" for family in order[1:]]
    # a notice within a longer line or over several is judged by its own words
    found = settle(found.withColumn("words", F.expr(f"if(best.s >= {LEAST_SIMILARITY} and best.start >= 0, slice(stream, best.start + 1, best.n), words)"))
                   .select(key, "paragraph", "words", F.expr(f"array_max(slice(shared, 1, {len(listed)})) / greatest(1, shared[{len(listed)}])").alias("within"), F.col("best.s").alias("similarity"), F.col("best.f").alias("nearest"),
                           F.expr(f"array({', '.join(of_family)})").alias("families")))
    close = found.where(f"similarity >= {LEAST_SIMILARITY}").groupBy("words").agg(F.min("nearest").alias("label")).select("label", "words")
    lacking = templates.select("label", F.explode(F.expr(
        "transform(sequence(0, size(words)), i -> filter(words, (w, j) -> j <> i))")).alias("words"))
    # every other paragraph with a cue; ``within`` is the largest share of its different words that one template has
    plain = settle(found.where(F.col("similarity") < LEAST_SIMILARITY / 2).where(~_notice("words"))
                   .where((F.size("words") < 4) | (F.col("within") < LEAST_SIMILARITY)).select("words").distinct())
    nothing = templates.limit(1).select(F.lit(NONE).alias("label"), F.expr("cast(array() as array<string>)").alias("words"))
    train = lacking.union(close).union(nothing).union(plain.where("pmod(hash(words), 2) = 0").select(F.lit(NONE).alias("label"), "words"))
    number = F.array_position(F.lit(order), F.col("label")) - 1
    hasher = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features")
    train = settle(train.withColumn("grams", _grams("words")).withColumn("y", number.cast("double")).select("label", "y", "grams"))
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weight = F.create_map(*[x for f, n in sizes.items() for x in (F.lit(f), F.lit(sum(sizes.values()) / len(sizes) / n))])
    model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", family="multinomial", regParam=2e-4, elasticNetParam=0.5,
                               maxIter=40, probabilityCol="p", predictionCol="best", rawPredictionCol="raw").fit(
        hasher.transform(train.withColumn("weight", weight[F.col("label")])))

    def judged(frame: DataFrame) -> DataFrame:
        out = model.transform(hasher.transform(frame.withColumn("grams", _grams("words")))).withColumn("p", vector_to_array("p"))
        # a notice is given the likeliest family even if none is likelier
        likeliest = F.array_position("p", F.array_max(F.slice("p", 2, len(order) - 1))).cast("int")
        best = F.when(_notice("words"), likeliest).otherwise(F.col("best").cast("int") + 1)
        return out.withColumn("family", F.element_at(F.lit(order), best)).withColumn("probability", F.element_at("p", best))

    tested = judged(plain.where("pmod(hash(words), 2) = 1").select("words")).withColumn("any", F.lit(1.0) - F.col("p")[0])
    limit = tested.agg(F.percentile_approx("any", 1 - FALSE_SHARE, 10_000)).first()[0]
    limit = max(LEAST_PROBABILITY, limit or 0.0)
    own = F.get("families", (F.array_position(F.lit(order[1:]), F.col("family")) - 1).cast("int"))
    result = judged(found).where(F.col("family") != NONE).withColumn("similarity", own)
    sure = (F.col("probability") >= limit) & (F.col("similarity") >= LEAST_SIMILARITY)
    return result.select(key, F.col("paragraph").cast("long").alias("paragraph"), F.when(sure, F.col("family")).otherwise(UNKNOWN).alias("family"),
                         F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), sure.alias("confirmed"))

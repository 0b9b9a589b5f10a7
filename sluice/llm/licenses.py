"""License scan by diagonal voting, with DataFrame functions only.

Every word k-gram of every text is hashed and joined to the places it has in the license templates; the words of a hit
are compared, too.  A hit votes for the diagonal text place - template place, and neighbouring diagonals (insertions
and deletions) are merged.  The span of a merged diagonal is then verified: the template's words that stand in it are
counted, each once however often it was voted for, and must be `COVERAGE` per cent of the template and `WHOLE` words
(or all of a shorter template); the span's words that agree, each counted once, must be `DENSITY` per cent of it.

Notices of one family differ by a word or two.  So each place of a text votes only once, for the verified span that has
most words of its template there (of equal ones the greater share, then the earlier template), and a span stands if it
wins half of its places.  Words that tell notices apart (`MARKS`) must agree as well: a template's own must stand in the
span, those of another license must not stand in it or in the stretch the whole template would cover.  Exact phrases
(the base) and these words are found in the same pass.

The template table has a fixed size and is broadcast.  A text's hits are bounded by its own length, so no group grows
with the corpus.  Defined results: null and empty texts have no words and no labels; repeated rows are scanned each;
between spans that agree alike the earlier template wins, then the later run; very long texts take time in proportion;
other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.runtime import Scratch, columns
from sluice.llm.words import alnum_words, spots, word

K, NEIGHBOUR = 3, 2
COVERAGE, WHOLE, DENSITY = 60, 6, 60

#: Phrases and labels of the base.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Well-known license notices, as they stand in files.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    (
        "apache",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Words, one after another, that tell notices apart, and what they say; short forms only after others.
MARKS = {
    "noncommercial": "nc", "non commercial": "nc", "by nc": "nc",
    "sharealike": "sa", "share alike": "sa", "by sa": "sa", "nc sa": "sa",
    "noderivatives": "nd", "noderivs": "nd", "no derivatives": "nd", "no derivs": "nd", "by nd": "nd", "nc nd": "nd",
    "gnu lesser": "lesser", "gnu library": "lesser", "gnu affero": "affero",
}
#: By label: all that must be said in the span, and what must not.
NEEDS = {"cc-by-nc": ["nc"], "cc-by-sa": ["sa"], "cc-by-nd": ["nd"], "cc-by-nc-sa": ["nc", "sa"], "cc-by-nc-nd": ["nc", "nd"], "lgpl": ["lesser"], "agpl": ["affero"]}
BARS = {
    "cc-by": ["nc", "sa", "nd"], "cc-by-nc": ["sa", "nd"], "cc-by-sa": ["nc", "nd"], "cc-by-nd": ["nc", "sa"], "cc-by-nc-sa": ["nd"], "cc-by-nc-nd": ["sa"],
    "gpl": ["lesser", "affero"], "lgpl": ["affero"], "agpl": ["lesser"],
}


def _gram(words: str, at: Column) -> Column:
    return F.xxhash64(*[word(words, at + j) for j in range(K)])


def _phrase_at(phrases: dict[str, str]) -> Column:
    """What the phrase that begins at place i stands for; null if none does."""
    out = F.lit(None).cast("string")
    for phrase, label in phrases.items():
        match = F.lit(True)
        for j, part in enumerate(phrase.split()):
            match = match & word("words", F.col("i") + j).eqNullSafe(F.lit(part))
        out = F.when((F.col("i") >= 0) & match, F.lit(label)).otherwise(out)
    return out


def _marks_of(table: dict[str, list[str]]) -> Column:
    """The table's list for a row's label; none for other labels."""
    out = F.array().cast("array<string>")
    for label, marks in table.items():
        out = F.when(F.col("label") == label, F.array(*map(F.lit, marks))).otherwise(out)
    return out


def _gram_words(words: str, at: Column) -> Column:
    return F.concat_ws(" ", *[word(words, at + j) for j in range(K)])


def template_grams(spark: SparkSession) -> DataFrame:
    """gram -> its places: array of (template, label, place, words of the template), and its words."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(TEMPLATES)], "template int, label string, text string")
    rows = rows.withColumn("words", alnum_words(F.col("text"))).select("template", "label", "words", spots("words", 0, K - 1).alias("place"))
    rows = rows.select("template", "label", "place", F.size("words").alias("size"), _gram("words", F.col("place")).alias("gram"), _gram_words("words", F.col("place")).alias("gram_words"))
    return rows.groupBy("gram", "gram_words").agg(F.collect_list(F.struct("template", "label", "place", "size")).alias("places"))


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), alnum_words(F.col("text")).alias("words"))
    # One place more, -1, stands for the text itself, so that one pass gives texts without hits too.
    at = rows.select("doc_id", "row", "words", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("i"))
    base, mark = _phrase_at(PHRASES), _phrase_at(MARKS)
    gram = F.when((F.col("i") >= 0) & (F.col("i") + K <= F.size("words")), _gram("words", F.col("i")))
    at = at.select("doc_id", "row", "words", "i", F.size("words").alias("n"), base.alias("base"), mark.alias("mark"), gram.alias("gram"))
    hits = at.join(F.broadcast(template_grams(spark)), "gram", "left").filter("i = -1 or base is not null or mark is not null or places is not null")
    places = F.when(F.col("gram_words") == _gram_words("words", F.col("i")), F.col("places"))
    hits = scratch.keep(hits.select("doc_id", "row", "i", "n", "base", "mark", places.alias("places")))

    per_text = hits.groupBy("row", "doc_id").agg(
        F.max("n").cast("long").alias("n_words"),
        F.count("base").alias("n_base"),
        F.min(F.when(F.col("base").isNotNull(), F.col("i"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base").isNotNull(), F.col("i"))).cast("long").alias("last_word"),
        F.collect_set("base").alias("base_set"),
    )
    line = Window.partitionBy("row", "template").orderBy("diagonal", "i")
    votes = (
        hits.filter("places is not null")
        .select("row", "i", F.explode("places").alias("p"))
        .select("row", "i", F.col("p.template").alias("template"), F.col("p.label").alias("label"), F.col("p.size").alias("size"), F.col("p.place").alias("place"), (F.col("i") - F.col("p.place")).alias("diagonal"))
        .withColumn("fresh", F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= NEIGHBOUR, 0).otherwise(1))
        .withColumn("run", F.sum("fresh").over(line))
    )
    covered = lambda spots_: F.size(F.array_distinct(F.flatten(F.transform(F.collect_set(spots_), lambda p: F.sequence(p, p + K - 1)))))
    merged = votes.groupBy("row", "template", "label", "size", "run").agg(
        covered("place").alias("matched"), covered("i").alias("agreeing"), F.min("i").alias("lo"), (F.max("i") + K).alias("hi"), F.min("diagonal").alias("begin"), (F.max("diagonal") + F.col("size")).alias("end")
    )
    verified = merged.filter((100 * F.col("matched") >= COVERAGE * F.col("size")) & (F.col("matched") >= F.least(F.col("size"), F.lit(WHOLE))) & (100 * F.col("agreeing") >= DENSITY * (F.col("hi") - F.col("lo"))))
    marks = hits.filter("mark is not null").groupBy("row").agg(F.collect_list(F.struct("i", "mark")).alias("marks"))
    told = verified.join(marks, "row", "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<struct<i:int,mark:string>>"))).withColumn("needs", _marks_of(NEEDS)).withColumn("bars", _marks_of(BARS))
    says = F.forall("needs", lambda need: F.exists("marks", lambda m: (m["mark"] == need) & (m["i"] >= F.col("lo")) & (m["i"] < F.col("hi"))))
    denies = F.exists("marks", lambda m: F.array_contains("bars", m["mark"]) & (m["i"] >= F.least("lo", "begin")) & (m["i"] < F.greatest("hi", "end")))
    strength = F.struct("matched", (F.col("matched") / F.col("size")).alias("coverage"), (-F.col("template")).alias("order"), "run")
    told = told.filter(says & ~denies).select("row", "template", "run", "label", "lo", "hi", strength.alias("strength"))
    own = votes.select("row", "template", "run", "i").distinct().join(told, ["row", "template", "run"])
    won = own.withColumn("won", F.col("strength") == F.max("strength").over(Window.partitionBy("row", "i")))
    stands = won.groupBy("row", "template", "run", "label", "lo", "hi").agg(F.first("strength.coverage").alias("coverage"), F.count_if("won").alias("wins"), F.count(F.lit(1)).alias("of")).filter("2 * wins >= of")
    found = stands.groupBy("row").agg(F.collect_set("label").alias("own_set"), F.max("coverage").alias("coverage"), F.sort_array(F.collect_list(F.struct("lo", "hi", "label"))).alias("spans"))
    joined = per_text.join(found, "row", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.sort_array("base_set"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base_set", F.coalesce("own_set", none))), ",").alias("labels"),
        F.greatest(F.coalesce("coverage", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int,label:string>>")).alias("spans"),
    )

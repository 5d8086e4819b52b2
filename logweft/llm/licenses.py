"""License scans: rolling word k-grams joined to template positions, votes counted by diagonal.

A place where a template stands shows as many k-grams with one difference
between their position in the text and in the template, its diagonal.  Words
put in or left out shift the diagonal a little, so neighbouring diagonals of
one template are merged; a span is accepted by the share of the template's
words that it covers.  All of it is joins, groupings and windows.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower

#: Words of a k-gram, for notices and for phrases (templates under LONG words).
LONG, SHORT = 5, 2
#: Diagonals this far apart are one place; so many words may lie between their parts.
SHIFT, GAP = 8, 12
#: The share of a notice's words that a span has to cover.
LEAST_COVER = 0.6
#: What stands between words, in lower-cased text.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    label: str
    text: str
    #: A phrase counts only whole, and each place of it is reported.
    phrase: bool = False


#: Phrases that name a license.
PHRASES = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
]

#: The notices that licenses ask for, in their public wording.
NOTICES = [
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""),
    Template("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"""),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3"),
    Template("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"""),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"""),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies"""),
    Template("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/"""),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software"""),
]


def words_of(text: str) -> list[str]:
    """A template's words, by the rule that holds for texts."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split(_BETWEEN, low) if w]


def _positions(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """(k, gram, hash, start, template, at, size, label, phrase): every k-gram of every template; ``start`` hashes its first two words."""
    rows = []
    for t, template in enumerate(templates):
        words = words_of(template.text)
        k = LONG if len(words) >= LONG else SHORT
        if len(words) < SHORT:
            raise ValueError(f"a template needs {SHORT} words: {template.text!r}")
        rows += [(k, " ".join(words[i : i + k]), words[i : i + k], t, i, len(words), template.label, template.phrase) for i in range(len(words) - k + 1)]
    grams = spark.createDataFrame(rows, "k int, gram string, words array<string>, template int, at int, size int, label string, phrase boolean")
    whole = F.when(F.col("k") == SHORT, _hash(F.col("words"), SHORT)).otherwise(_hash(F.col("words"), LONG))
    return grams.select("k", "gram", whole.alias("hash"), _hash(F.col("words"), SHORT).alias("start"), "template", "at", "size", "label", "phrase")


def _hash(words: Column, k: int, at: Column | int = 0) -> Column:
    """The hash of the ``k`` words from ``at`` on."""
    return F.xxhash64(*(F.get(words, (at if isinstance(at, Column) else F.lit(at)) + j) for j in range(k)))


def _grams(words: Column, starts: list[int]) -> Column:
    """(hash, place, said) of the k-grams of a text that can join.

    Every two words in a row are hashed; where a template's k-gram starts with
    the same hash, the k-grams of both lengths leave the row, spelled out.
    """
    places = F.when(F.size(words) >= SHORT, F.sequence(F.lit(0), F.size(words) - SHORT)).otherwise(F.array().cast("array<int>"))
    kept = F.filter(places, lambda i: _hash(words, SHORT, i).isin(starts))

    def gram(i: Column, k: int) -> Column:
        return F.struct(_hash(words, k, i).alias("hash"), i.alias("place"), F.concat_ws(" ", *(F.get(words, i + j) for j in range(k))).alias("said"))

    return F.flatten(F.transform(kept, lambda i: F.array(gram(i, SHORT), gram(i, LONG))))


def scan(docs: DataFrame, templates: list[Template] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, spans) of every row; ``spans`` are (label, phrase, start, end, cover) in words from 0, ``end`` exclusive, by start, then end and label.

    A word is a run of lower-cased ASCII letters, digits and characters beyond
    ASCII.  A phrase is found at every place where all its words stand one
    after the other, overlapping or not; a notice where a span covers
    LEAST_COVER of its words, with up to SHIFT words more or less between its
    parts.  Null and empty texts have no words and no spans.  Repeated rows and
    repeated or null ids give a row each; further columns are left aside.

    ``templates`` (PHRASES and NOTICES, unless given) is a list in the driver, so
    its k-grams are a table of bounded size and are broadcast; grams are met by
    hash and compared as words.  No text is shuffled: what leaves the scan is
    one row for each gram that is found, and one for each text.
    """
    positions = _positions(docs.sparkSession, templates or PHRASES + NOTICES)
    starts = [r.start for r in positions.select("start").distinct().collect()]  # as many as the templates' words
    low = F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), _BETWEEN)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.array_remove(low, "").alias("words"))
    grams = rows.select("doc_id", "row", F.size("words").alias("n_words"), F.explode_outer(_grams(F.col("words"), starts)).alias("g")).select("doc_id", "row", "n_words", "g.*")
    met = grams.join(F.broadcast(positions), (grams.hash == positions.hash) & (grams.said == positions.gram), "left")
    # A text without any is there with no template.
    found = met.select("doc_id", "row", "n_words", F.coalesce("template", F.lit(-1)).alias("template"), "label", "phrase", "size", "at", (F.col("place") - F.col("at")).alias("diagonal"))

    one = ["doc_id", "row", "n_words", "template", "label", "phrase", "size"]
    lines = found.groupBy(*one, "diagonal").agg(F.collect_set("at").alias("ats"))
    k = F.when(F.col("size") >= LONG, LONG).otherwise(SHORT)
    covered = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + k - 1))))
    lines = lines.withColumns({"begin": F.col("diagonal") + F.array_min("ats"), "end": F.col("diagonal") + F.array_max("ats") + k, "covered": covered})

    by = Window.partitionBy("row", "template").orderBy("begin", "diagonal")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    near = (F.col("begin") <= F.max("end").over(before) + GAP) & (F.abs(F.col("diagonal") - F.lag("diagonal").over(by)) <= SHIFT) & ~F.col("phrase")
    places = lines.withColumn("new", F.when(near, 0).otherwise(1)).withColumn("place", F.sum("new").over(by))
    spans = places.groupBy(*one, "place").agg(F.min("begin").alias("start"), F.max("end").alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n"))

    cover = F.col("n") / F.col("size")
    good = (F.col("template") >= 0) & (cover >= F.when(F.col("phrase"), 1.0).otherwise(LEAST_COVER))
    span = F.when(good, F.struct("start", "end", "label", "phrase", cover.alias("cover")))
    done = spans.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.collect_set(span)).alias("s"))
    return done.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.transform("s", lambda x: F.struct(x["label"].alias("label"), x["phrase"].alias("phrase"), x["start"].alias("start"), x["end"].alias("end"), x["cover"].alias("cover"))).alias("spans"))

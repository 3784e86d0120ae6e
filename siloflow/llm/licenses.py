"""License scans by diagonal voting, in DataFrame operations only.

All rolling runs of K words of a text are joined to the positions they have in known statements (whole licence texts and their
standard headers); short notices and the contract's phrases are met by their word pairs, as a single word may tell them apart. A run at
word i of the text and word j of a statement votes for diagonal i - j; a whole statement puts all its
votes on one diagonal, an edited one on a few neighbouring ones. Votes are gathered before the
shuffle, neighbouring diagonals are merged, and a merged span is verified: the statement's positions that it
holds, each once and in the text's order, must be enough of the statement and lie
within a short stretch. The join compares the words as well as their hash, so votes are exact.

Runs are made inside the scan stage and meet a broadcast table whose size is fixed in this file;
what is shuffled is one row for each text and each diagonal that got a vote, with the statement's positions on it.

Edge cases: null text counts as empty and gives n_words 0, no label and score 0. Rows are told apart by
a number given in the scan stage, which is not used twice, so null or repeated ids and repeated rows do no harm:
each row gives one result row. An empty table gives an empty result. Extra columns are ignored by ``op5``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siloflow.llm.common import lower_ascii, words

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a run, and of those that phrases of less than LONG words are met by.
K, PAIR, LONG = 4, 2, 16

# The contract's phrases and their labels.
BASE = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]
# Public licence texts, their standard headers and the notices that point to them.
_DISCLAIMER = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_1 = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_2 = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_GNU = "is free software you can redistribute it and or modify it under the terms of the gnu {0} as published by the free software foundation either version {1} of the license or at your option any later version"
_GNU_2 = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0} for more details"
STATEMENTS = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _DISCLAIMER),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", _GNU.format("general public license", "3")),
    ("gpl-2.0", _GNU.format("general public license", "2")),
    ("gpl", _GNU_2.format("general public license")),
    ("lgpl", "gnu lesser general public license version"),
    ("lgpl-3.0", _GNU.format("lesser general public license", "3")),
    ("lgpl-2.1", _GNU.format("lesser general public license", "2 1")),
    ("agpl", "gnu affero general public license version"),
    ("agpl-3.0", _GNU.format("affero general public license", "3")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", f"{_BSD} {_BSD_1} {_BSD_2}"),
    ("bsd-3-clause", f"{_BSD} {_BSD_1} {_BSD_2} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
]
#: The share of a statement's runs that a span must hold, and how far apart merged diagonals may be.
MIN_COVER = {K: 0.6, PAIR: 0.75}
MAX_SHIFT = 2
#: A statement of n words may stretch over STRETCH * n + MAX_SHIFT words of the text.
STRETCH = 1.5
#: No span of a statement stretches further.
LONGEST = int(STRETCH * max(len(phrase.split()) for _, phrase in STATEMENTS)) + MAX_SHIFT


def templates(spark: SparkSession) -> DataFrame:
    """One row for each run of each statement (a pair of each phrase), and a row that catches every text's own marker."""
    rows = []
    for t, (label, phrase) in enumerate([*BASE, *STATEMENTS]):
        said, base = phrase.split(), t < len(BASE)
        k = K if len(said) >= LONG else PAIR
        rows += [(t, label, j, k, len(said) - k + 1, base, *(said[j : j + k] + [None] * (K - k))) for j in range(len(said) - k + 1)]
    known = spark.createDataFrame(rows, "t int, label string, j int, k int, pairs int, base boolean, " + ", ".join(f"w{i} string" for i in range(K)))
    known = known.withColumn("_h", F.xxhash64("k", *(f"w{i}" for i in range(K))))
    mark = spark.range(1).select(F.lit(-1).alias("t"), F.lit("").alias("label"), F.lit(0).alias("j"), F.lit(0).alias("k"), F.lit(0).alias("pairs"), F.lit(False).alias("base"), *(F.lit("").alias(f"w{i}") for i in range(K)), F.lit(0).cast("long").alias("_h"))
    return known.unionByName(mark)


def votes(docs: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, t, label, k, pairs, base, d, js, n_words): the statement's positions on each diagonal.

    ``keys`` must tell rows apart. Every text also has a row with t = -1, votes or not.
    """
    cut = docs.select(*keys, words(lower_ascii(text), SEPARATOR).alias("_w"))
    placed = cut.select(*keys, "_w", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("_w") - PAIR, F.lit(-1)))).alias("_i"))
    here = [F.get("_w", F.col("_i") + j) for j in range(K)]
    # the pair of a phrase and the run of a statement that start here; the marker before the first word
    runs = F.array(F.xxhash64(F.lit(PAIR), *here[:PAIR]), F.xxhash64(F.lit(K), *here))
    hashed = placed.withColumn("_h", F.explode(F.when(F.col("_i") < 0, F.array(F.lit(0).cast("long"))).otherwise(runs)))
    met = hashed.join(F.broadcast(templates(docs.sparkSession)), "_h")
    same = [F.col(f"w{j}").isNull() | (here[j] == F.col(f"w{j}")) for j in range(K)]
    met = met.where(((F.col("t") < 0) & (F.col("_i") < 0)) | ((F.col("_i") >= 0) & same[0] & same[1] & F.coalesce(same[2] & same[3], F.lit(False))))
    met = met.select(*keys, "t", "label", "k", "pairs", "base", F.when(F.col("t") < 0, 0).otherwise(F.col("_i") - F.col("j")).alias("d"), "j", F.size("_w").alias("n"))
    return met.groupBy(*keys, "t", "label", "k", "pairs", "base", "d").agg(F.collect_set("j").alias("js"), F.max("n").alias("n_words"))


def _in_order(places: Column) -> Column:
    """Of places (i, j), by i, how many have a larger j than all before: positions of the statement, each once and in the text's order."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n"))
    step = lambda a, x: F.when(x["j"] > a["last"], F.struct(x["j"].alias("last"), (a["n"] + 1).alias("n"))).otherwise(a)
    return F.aggregate(F.array_sort(places), start, step, lambda a: a["n"])


def spans(found: DataFrame, keys: list[str]) -> DataFrame:
    """Merge neighbouring diagonals of a text and statement and say which merged spans hold the statement."""
    line = Window.partitionBy(*keys, "t").orderBy("d")
    found = found.withColumn("_new", F.coalesce((F.col("d") - F.lag("d").over(line) > MAX_SHIFT).cast("int"), F.lit(1)))
    found = found.withColumn("_run", F.sum("_new").over(line))
    whole = F.col("base") & (F.size("js") == F.col("pairs"))
    places = F.transform("js", lambda j: F.struct((F.col("d") + j).alias("i"), j.alias("j")))
    merged = found.groupBy(*keys, "t", "label", "k", "pairs", "base", "_run").agg(
        F.flatten(F.collect_list(F.when(~F.col("base"), places))).alias("_places"),  # as long as the statement, for each diagonal
        F.min(F.col("d") + F.array_min("js")).alias("first"), F.max(F.col("d") + F.array_max("js")).alias("last"),
        F.max("n_words").alias("n_words"),
        F.sum(whole.cast("long")).alias("places"), F.min(F.when(whole, F.col("d"))).alias("first_place"), F.max(F.when(whole, F.col("d"))).alias("last_place"),
    )
    cover = _in_order(F.col("_places")) / F.greatest(F.col("pairs"), F.lit(1))
    short = F.col("last") - F.col("first") + F.col("k") <= STRETCH * (F.col("pairs") + F.col("k") - 1) + MAX_SHIFT
    enough = (F.col("t") >= 0) & F.when(F.col("base"), F.col("places") > 0).otherwise((cover >= F.when(F.col("k") == K, MIN_COVER[K]).otherwise(MIN_COVER[PAIR])) & short)
    merged = merged.withColumn("cover", F.when(enough, F.when(F.col("base"), 1.0).otherwise(cover)).otherwise(0.0)).drop("_places")
    # wordings of one family differ in a word or two: of those that overlap the best held one stands
    rivals = Window.partitionBy(*keys, "base", F.split("label", "-").getItem(0)).orderBy("first").rangeBetween(-LONGEST, LONGEST)
    near = F.collect_list(F.when(F.col("cover") > 0, F.struct("first", "last", "cover"))).over(rivals)
    merged = merged.withColumn("_near", F.when(F.col("base"), F.array().cast("array<struct<first:int,last:int,cover:double>>")).otherwise(near))
    better = F.exists("_near", lambda x: (x["first"] <= F.col("last")) & (x["last"] >= F.col("first")) & (x["cover"] > F.col("cover")))
    return merged.withColumn("verified", (F.col("cover") > 0) & ~better).drop("_near")


def op5(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; a row for each input row."""
    keys = ["_row", "doc_id"]
    named = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    seen = spans(votes(named, keys, F.col("_text")), keys)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    out = seen.groupBy(*keys).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum("places").alias("n_base"),
        F.min("first_place").cast("long").alias("first_word"),
        F.max("last_place").cast("long").alias("last_word"),
        joined(F.col("base") & F.col("verified")).alias("base_labels"),
        joined(F.col("verified")).alias("labels"),
        F.max("cover").alias("score"),
    )
    return out.drop("_row")

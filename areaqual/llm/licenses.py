"""Licence scans by sentence rules.

A text is cut into pieces, these are normalised, and where a known sentence of a licence begins, the pieces that follow
are compared with it; the identifiers found, in order, are matched against rules, which are ordered lists of
identifiers. All of it is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areaqual.llm.common import only

# The wording of public licences and licence notices, by identifier.
SENTENCES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-grant": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-2.0-grant-full": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-2.0-obtain": "You may obtain a copy of the License at",
    "apache-2.0-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-2.0-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Released under the MIT License.",
    "mit-notice-licensed": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-name": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-include": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "cc-by-nc-4-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-names-university": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mpl-2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2-notice-short": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "spdx-apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-gpl-3.0": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-bsd-3": "SPDX-License-Identifier: BSD-3-Clause",
}
# Rule, licence, and the identifiers in the order in which the sentences stand.
RULES = [
    ("apache-2.0-notice", "Apache-2.0", ["apache-2.0-notice"]),
    ("apache-2.0-grant", "Apache-2.0", ["apache-2.0-grant"]),
    ("apache-2.0-header", "Apache-2.0", ["apache-2.0-grant-full", "apache-2.0-obtain", "apache-2.0-as-is", "apache-2.0-see"]),
    ("apache-2.0-header-short", "Apache-2.0", ["apache-2.0-grant-full", "apache-2.0-as-is", "apache-2.0-see"]),
    ("apache-2.0-spdx", "Apache-2.0", ["spdx-apache-2.0"]),
    ("mit-notice", "MIT", ["mit-notice"]),
    ("mit-notice-licensed", "MIT", ["mit-notice-licensed"]),
    ("mit-text", "MIT", ["mit-grant", "mit-include"]),
    ("mit-titled-text", "MIT", ["mit-title", "mit-grant", "mit-include"]),
    ("mit-named-text", "MIT", ["mit-name", "mit-grant", "mit-include"]),
    ("mit-spdx", "MIT", ["spdx-mit"]),
    ("gpl-3-notice", "GPL-3.0", ["gpl-3-notice"]),
    ("gpl-2-notice", "GPL-2.0", ["gpl-2-notice"]),
    ("gpl-3-header", "GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-see"]),
    ("gpl-2-header", "GPL-2.0-or-later", ["gpl-2-free", "gpl-hope", "gpl-see"]),
    ("gpl-3-spdx", "GPL-3.0-or-later", ["spdx-gpl-3.0"]),
    ("cc-by-nc-4-notice", "CC-BY-NC-4.0", ["cc-by-nc-4-notice"]),
    ("cc-by-4-notice", "CC-BY-4.0", ["cc-by-4-notice"]),
    ("cc-by-sa-4-notice", "CC-BY-SA-4.0", ["cc-by-sa-4-notice"]),
    ("cc-by-nc-4-work", "CC-BY-NC-4.0", ["cc-by-nc-4-work"]),
    ("cc-by-4-work", "CC-BY-4.0", ["cc-by-4-work"]),
    ("cc-by-sa-4-work", "CC-BY-SA-4.0", ["cc-by-sa-4-work"]),
    ("bsd-2-text", "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("bsd-3-text", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("bsd-3-text-university", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names-university"]),
    ("mpl-2-notice", "MPL-2.0", ["mpl-2-notice"]),
    ("mpl-2-notice-short", "MPL-2.0", ["mpl-2-notice-short"]),
    ("bsd-3-spdx", "BSD-3-Clause", ["spdx-bsd-3"]),
]

#: A text may be cut at a line end or behind one of these marks and white space.
ENDS = r"([.!?;:])[ \t\r\n]+"


def normalised_pieces(text: Column) -> Column:
    """The pieces between cuts: letters A-Z in lower case and digits; everything else is one space, none at the ends."""
    cut = F.regexp_replace(text, ENDS, "$1\n")
    return F.split(F.trim(F.lower(F.regexp_replace(cut, "[^A-Za-z0-9\n]+", " "))), " ?\n ?")


def plain(sentence: str) -> str:
    """The fixed sentences in the form that ``normalised_pieces`` gives, in one piece."""
    kept = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in sentence)
    return " ".join(kept.split())


def known_sentences(spark: SparkSession) -> DataFrame:
    rows = [(s.split()[0], s, len(s.split()), k) for k, s in ((k, plain(s)) for k, s in SENTENCES.items())]
    return spark.createDataFrame(rows, "head string, sentence string, words int, sid string")


def rule_steps(spark: SparkSession) -> DataFrame:
    rows = [(rule, licence, sid, k, len(sids)) for rule, licence, sids in RULES for k, sid in enumerate(sids)]
    return spark.createDataFrame(rows, "rule string, licence string, sid string, step int, steps int")


def known_places(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), sid, and the numbers of the first and last piece (at, to) of every known sentence.

    A known sentence stands where pieces that follow each other give it together, so it may hold marks and be wrapped;
    an empty line is an empty piece and ends it. Only as many pieces as it has words are looked at.
    """
    rows = only(docs, "doc_id", "text").filter("text is not null")
    rows = rows.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), normalised_pieces(F.col("text")).alias("pieces"))
    # Outer, as the optimizer would else cut each text a second time to see that there are pieces.
    each = rows.select("doc_id", "h", "pieces", F.posexplode_outer("pieces").alias("at", "piece"))
    begun = each.join(F.broadcast(known_sentences(docs.sparkSession)), F.substring_index("piece", " ", 1) == F.col("head"))
    ahead = begun.withColumn("ahead", F.array_join(F.slice("pieces", F.col("at") + 1, F.col("words")), "\n"))
    size = F.length("sentence")
    found = F.substring("ahead", F.lit(1), size)
    whole = (F.translate(found, "\n", " ") == F.col("sentence")) & F.substring("ahead", size + 1, F.lit(1)).isin("", "\n")
    to = F.col("at") + size - F.length(F.translate(found, "\n", ""))
    return ahead.filter(whole).select("doc_id", "h", "sid", "at", to.alias("to")).distinct()


def scan_licences(docs: DataFrame, max_gap: int = 4) -> DataFrame:
    """doc_id, licence, rule, first_sentence and last_sentence of every match.

    These are numbers (from 0) of the pieces of a text, which is cut at line ends and behind marks; known sentences may
    go over several pieces. A rule matches where its sentences follow each other among the known sentences of a text,
    with ``max_gap`` other pieces, empty lines too, between them in all at most; known sentences that overlap share a
    place. Of matches of which one lies within the other the longer is given; of equal ones all are. Texts that are null
    or empty match nothing, repeated rows are one document, and a text is scanned whole. The tables of sentences and
    rules are fixed; only known sentences are shuffled.
    """
    spark = docs.sparkSession
    known = known_places(docs)
    order = Window.partitionBy("doc_id", "h").orderBy("at", "to", "sid")
    before = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = known.withColumn("apart", (F.col("at") > F.coalesce(before, F.lit(-1))).cast("int"))
    numbered = apart.withColumn("place", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    met = numbered.join(F.broadcast(rule_steps(spark)), "sid").groupBy(
        "doc_id", "h", "rule", "licence", "steps", (F.col("place") - F.col("step")).alias("start")
    ).agg(
        F.count("*").alias("n"), F.min("at").alias("first_sentence"), F.max("to").alias("last_sentence"),
        F.sum(F.col("to") - F.col("at") + 1).alias("own"),
    )
    span = F.col("last_sentence") - F.col("first_sentence") + 1
    matches = met.filter((F.col("n") == F.col("steps")) & (span <= F.col("own") + max_gap))
    # What starts earlier, or at the same sentence and ends later, and reaches as far, holds the match.
    longest = matches.groupBy("doc_id", "h", "first_sentence").agg(F.max("last_sentence").alias("reach"))
    earlier = Window.partitionBy("doc_id", "h").orderBy("first_sentence").rowsBetween(Window.unboundedPreceding, -1)
    reached = longest.withColumn("before", F.coalesce(F.max("reach").over(earlier), F.lit(-1)))
    outer = matches.alias("m").join(
        reached.alias("r"),
        F.col("m.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("m.h") == F.col("r.h"))
        & (F.col("m.first_sentence") == F.col("r.first_sentence")),
    ).filter("m.last_sentence = r.reach and m.last_sentence > r.before")
    return outer.select("m.doc_id", "m.licence", "m.rule", "m.first_sentence", "m.last_sentence")

"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences (at line ends, and after full stops, question and exclamation marks before white space),
each normalised to its runs of letters and digits in lower case. A normalised sentence that is in the table of known
licence sentences becomes that sentence's identifier; the others break the sequence. A rule is a licence with an ordered
list of identifiers that must follow one another in a text. Every sentence at which a rule's sequence begins is a match,
and of the rules that fit there the longest is taken (then the licence that is last in order).

Notices are often wrapped over several lines. A text in which a line ends within a sentence is therefore cut a second time, at
blank lines and after end marks only; of that cut those matches count that hold a sentence of more than one line (``wrapped``),
since the others are matches of the first cut already.

Sentences are looked up in one equi-join on their hash, confirmed by the sentence, whose other side is the rule table: its
size is that of the rules, not of the corpus. What is shuffled is a row for each licence sentence found.

Defined results: null and empty texts have no sentences; a document without a match has no row; null and repeated ids are
kept apart by row; sentences longer than the longest known one are never looked up, since they can't be equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintlake.llm.common import table

#: Identifiers and texts of known sentences, one sentence each (fixed values).
SENTENCES = (
    ("apache-2-short", "Licensed under the Apache License, Version 2.0."),
    ("apache-2-use", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2-you", "You may not use this file except in compliance with the License."),
    ("apache-2-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0."),
    ("mit-short", "Released under the MIT License."),
    ("mit-licensed", "Licensed under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("mit-as-is", "The software is provided \"as is\", without warranty of any kind, express or implied."),
    ("gpl-3-short", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."),
    ("mit-grant-whole", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-as-is-whole", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("gpl-2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-warranty-whole", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("cc-by-nc-4-short", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4-short", "Licensed under CC BY 4.0."),
)
#: Licence and the identifiers that must follow one another.
RULES = (
    ("Apache-2.0", ("apache-2-short",)),
    ("Apache-2.0", ("apache-2-use",)),
    ("Apache-2.0", ("apache-2-short", "apache-2-you", "apache-2-copy")),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-grant", "mit-as-is")),
    ("GPL-3.0", ("gpl-3-short",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-warranty")),
    ("MIT", ("mit-grant-whole", "mit-notice", "mit-as-is-whole")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-warranty-whole")),
    ("GPL-2.0-or-later", ("gpl-2-free", "gpl-warranty-whole")),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-short",)),
    ("CC-BY-4.0", ("cc-by-4-short",)),
)
END, BREAK, SEPARATORS = r"([.!?])[ \t\n\r]+", r"[\n\r]+", r"[^\p{L}\p{N}]+"
#: Line ends of one form, blank lines, a line that ends within a sentence, and what the second cut puts between sentences.
LINE_END, BLANK, WRAPPED, CUT = r"\r\n?", r"\n[ \t]*\n[ \t\n]*", r"[^ \t\n\r.!?][ \t]*\r?\n[ \t]*[^ \t\n\r]", "\x1e"


def sentences_of(text: str) -> Column:
    return F.split(F.regexp_replace(text, END, "$1\n"), BREAK)


def unwrapped_sentences_of(text: str) -> Column:
    whole = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, LINE_END, "\n"), END, "$1" + CUT), BLANK, CUT)
    return F.split(whole, CUT + "+")


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), SEPARATORS, " "))


def scan(docs: DataFrame, sentences: DataFrame, rules: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """``doc_id, license, sentence, n_sentences, wrapped``: each match of a rule, and at which sentence of the text it begins.

    docs: doc_id, text; sentences: sid, text (one sentence); rules: license, sids (array). ``sentence`` counts from 0 over
    the split text, empty sentences included; where ``wrapped``, over the text cut at blank lines and end marks. Rule tables of up to
    broadcast_rows rows go to all tasks, larger ones are joined by a shuffle.
    """
    known = sentences.select("sid", normalised(F.col("text")).alias("norm")).filter("norm <> ''").select(F.xxhash64("norm").alias("key"), "norm", "sid")
    wanted = rules.filter(F.size("sids") > 0).select("license", F.concat_ws("\n", "sids").alias("rule"), F.size("sids").alias("n"), F.posexplode("sids").alias("i", "sid"))
    size = known.agg(F.count("*").alias("rows"), F.coalesce(F.max(F.length("norm")), F.lit(0)).alias("longest")).first()
    small = F.broadcast if size["rows"] + wanted.count() <= broadcast_rows else lambda df: df
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))  # before the texts are taken apart
    cuts = F.array(
        F.struct(F.lit(False).alias("again"), sentences_of("text").alias("s")),
        F.struct(F.lit(True).alias("again"), F.when(F.col("text").rlike(WRAPPED), unwrapped_sentences_of("text")).alias("s")),
    )
    each = rows.select("_row", "doc_id", F.explode(cuts).alias("c")).select("_row", "doc_id", "c.again", F.posexplode("c.s").alias("pos", "raw"))
    each = each.select("_row", "doc_id", "again", "pos", (F.col("again") & F.col("raw").rlike(WRAPPED)).alias("over"), normalised(F.col("raw")).alias("norm")).filter((F.col("norm") != "") & (F.length("norm") <= size["longest"]))
    found = each.withColumn("key", F.xxhash64("norm")).join(small(known), ["key", "norm"]).select("_row", "doc_id", "again", "pos", "over", "sid")
    # each sentence found says where the rules that hold it would begin; a rule fits where all its places say the same
    begins = found.join(small(wanted), "sid").select("_row", "doc_id", "again", (F.col("pos") - F.col("i")).alias("pos"), "over", "license", "rule", "n", "i")
    match = begins.groupBy("_row", "doc_id", "again", "pos", "license", "rule", "n").agg(F.countDistinct("i").alias("held"), F.max("over").alias("over")).filter("held = n and over = again")
    best = match.groupBy("_row", "doc_id", "again", "pos").agg(F.max(F.struct("n", "license")).alias("best"))
    return best.select("doc_id", F.col("best.license").alias("license"), F.col("pos").alias("sentence"), F.col("best.n").alias("n_sentences"), F.col("again").alias("wrapped"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences named in every document."""
    sentences = spark.createDataFrame(list(SENTENCES), "sid string, text string")
    rules = spark.createDataFrame([(name, list(sids)) for name, sids in RULES], "license string, sids array<string>")
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), sentences, rules)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = rf"""
WITH known AS (
  SELECT sid, trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS norm
  FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in SENTENCES)}) AS t(sid, text)),
rules AS (
  SELECT row_number() OVER () AS rule, * FROM (VALUES {", ".join(f"({_quoted(a)}, [{', '.join(map(_quoted, b))}])" for a, b in RULES)}) AS t(license, sids)),
parts AS (
  SELECT doc_id, r, false AS again, string_split_regex(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(10), 'g'), '[\n\r]+') AS parts FROM (SELECT doc_id, text, row_number() OVER () AS r FROM documents WHERE text IS NOT NULL)
  UNION ALL
  SELECT doc_id, r, true, string_split_regex(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '([.!?])[ \t\n\r]+', '\1' || chr(30), 'g'), '\n[ \t]*\n[ \t\n]*', chr(30), 'g'), chr(30) || '+')
  FROM (SELECT doc_id, text, row_number() OVER () AS r FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(text, '{WRAPPED}')),
s AS (SELECT doc_id, r, again, CAST(unnest(range(len(parts))) AS INTEGER) AS pos, unnest(parts) AS raw FROM parts),
f AS (
  SELECT doc_id, r, again, pos, again AND regexp_matches(raw, '{WRAPPED}') AS over, sid FROM s JOIN known ON trim(regexp_replace(lower(raw), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) = norm WHERE norm <> ''),
step AS (SELECT rule, license, len(sids) AS n, unnest(range(len(sids))) AS i, unnest(sids) AS sid FROM rules),
hit AS (
  SELECT doc_id, r, again, license, n, rule, pos - i AS pos, count(DISTINCT i) AS held, bool_or(over) AS over
  FROM f JOIN step USING (sid) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY r, again, pos ORDER BY n DESC, license DESC) AS k FROM hit WHERE held = n AND over = again)
SELECT doc_id, license, CAST(pos AS INTEGER) AS sentence, CAST(n AS INTEGER) AS n_sentences, again AS wrapped FROM best WHERE k = 1
"""

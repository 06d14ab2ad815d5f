"""License scans by diagonal voting, with DataFrame functions only.

Method: the hashes of all rolling word pairs are joined with the pairs of a fixed, small table of templates (broadcast:
its size is a constant of this module). A hit at word p of the text and word t of the template votes for the diagonal
p - t. Votes are counted by diagonal; diagonals that neighbour each other (a word put in or left out moves the text to
the next one) are merged; a merged span is kept if it holds enough of its template's pairs, compared as words, within
a length near the template's.

Base phrases are templates of their own: they count where all their pairs lie on one diagonal. Of a whole licence's text
only the pairs with a word of six letters or more vote: those of short words alone stand everywhere.

Defined results: null and empty texts have no words, no places and empty labels; repeated rows, also of one id, each
give a row; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Label, base phrase.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Label, words of its notice.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "gnu general public license as published by the free software foundation"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc", "licensed under a creative commons attribution"),
)
#: Label, words of the licence's whole text or of the whole notice that it asks for.
BODIES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program",
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
)
#: Letters that a word of a whole licence's voting pairs has at least.
LONG = 6
#: Diagonals this far apart are merged; least share of a notice's pairs; longest span in lengths of the notice.
DRIFT, SHARE, STRETCH = 2, 0.7, 1.5


def templates() -> list[tuple[int, str, bool, int, str, int, int]]:
    """Template, label, whether base, position, word pair, number of pairs, number of words."""
    out = []
    for n, (label, text, kind) in enumerate([*((a, b, "base") for a, b in BASE), *((a, b, "notice") for a, b in NOTICES), *((a, b, "body") for a, b in BODIES)]):
        tokens = text.split()
        at = [j for j in range(len(tokens) - 1) if kind != "body" or max(len(tokens[j]), len(tokens[j + 1])) >= LONG]
        out += [(n, label, kind == "base", j, f"{tokens[j]} {tokens[j + 1]}", len(at), len(tokens)) for j in at]
    return out


def words(text: Column) -> Column:
    """Words with A-Z lower-cased; the Kelvin sign, of which lower() makes a k, becomes another letter first."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138"))), F.lit(WORD), F.lit(0))


def hits(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each word pair that a template has, and one for each text without its first pair among them."""
    table = docs.sparkSession.createDataFrame(templates(), "template int, label string, base boolean, tpos int, pair string, pairs int, length int")
    table = F.broadcast(table.withColumn("hash", F.xxhash64("pair")).withColumnRenamed("pair", "tpair"))
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    n = F.size("w")
    pairs = F.when(n > 1, F.zip_with(F.slice("w", 1, n - 1), F.slice("w", 2, n - 1), lambda a, b: F.concat_ws(" ", a, b)))
    rolled = rows.select("key", "id", n.cast("long").alias("n_words"), F.posexplode_outer(pairs).alias("pos", "pair")).withColumn("hash", F.xxhash64("pair"))
    joined = rolled.join(table, "hash", "left")
    real = F.col("template").isNotNull() & (F.col("pair") == F.col("tpair"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    null = F.lit(None)
    return joined.where(real | first).select("key", "id", "n_words", "pos", *[F.when(real, F.col(c)).otherwise(null).alias(c) for c in ("template", "label", "base", "tpos", "pairs", "length")])


def spans(found: DataFrame) -> DataFrame:
    """``key, id, n_words, template, label, base, start, stop, share``: verified spans in words; texts without have nulls."""
    by = ["key", "id", "n_words", "template", "label", "base", "pairs", "length"]
    diagonals = found.groupBy(*by, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("met"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    # a base phrase stands on one diagonal; a notice's diagonals merge while they are near
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("base"), 0).otherwise(DRIFT), F.lit(True))
    runs = diagonals.withColumn("run", F.sum(apart.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(*by, "run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("met")))).alias("met"), F.min("lo").alias("start"), (F.max("hi") + 1).alias("stop"))
    share = F.col("met") / F.col("pairs")
    good = F.when(F.col("base"), F.col("met") == F.col("pairs")).otherwise((share >= SHARE) & (F.col("stop") - F.col("start") <= STRETCH * F.col("length")))
    kept = [F.when(good, F.col(c)).alias(c) for c in ("template", "label", "base", "start", "stop")]
    return merged.select("key", "id", "n_words", *kept, F.when(good, share).alias("share"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: words, base places with the first and last start, labels, and the best share of a template."""
    found = spans(hits(docs, id_col, text_col))
    base = F.col("base") & F.col("template").isNotNull()
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = found.groupBy("key", "id", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start").cast("long"))).alias("first_word"),
        F.max(F.when(base, F.col("start").cast("long"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    return out.drop("key").withColumnRenamed("id", id_col)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """The scan over every whole text of documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_VALUES = ", ".join(f"({n}, '{label}', {base}, {j}, '{pair}', {pairs}, {length})" for n, label, base, j, pair, pairs, length in templates())
ORACLE_SQL = rf"""
WITH t(template, label, base, tpos, pair, pairs, length) AS (VALUES {_VALUES}),
d AS (SELECT doc_id, regexp_extract_all(lower(replace(coalesce(text, ''), chr(8490), chr(312))), '{WORD}') AS w FROM documents),
e AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d) x),
v AS (SELECT doc_id, template, label, base, pairs, length, i - 1 - tpos AS diagonal, list(DISTINCT tpos) AS met, min(i - 1) AS lo, max(i - 1) AS hi
  FROM e JOIN t ON e.pair = t.pair GROUP BY ALL),
g AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= CASE WHEN base THEN 0 ELSE {DRIFT} END THEN 0 ELSE 1 END AS apart FROM v),
r AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM g),
m AS (SELECT doc_id, template, label, base, pairs, length, len(list_distinct(flatten(list(met)))) AS met, min(lo) AS start, max(hi) + 1 AS stop FROM r GROUP BY doc_id, template, label, base, pairs, length, run),
s AS (SELECT *, met / CAST(pairs AS DOUBLE) AS share FROM m
  WHERE CASE WHEN base THEN met = pairs ELSE met / CAST(pairs AS DOUBLE) >= {SHARE} AND stop - start <= {STRETCH} * length END)
SELECT d.doc_id, CAST(max(len(d.w)) AS BIGINT) AS n_words, count(CASE WHEN s.base THEN 1 END) AS n_base,
  CAST(min(CASE WHEN s.base THEN s.start END) AS BIGINT) AS first_word, CAST(max(CASE WHEN s.base THEN s.start END) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT CASE WHEN s.base THEN s.label END, ',' ORDER BY CASE WHEN s.base THEN s.label END), '') AS base_labels,
  coalesce(string_agg(DISTINCT s.label, ',' ORDER BY s.label), '') AS labels, CAST(coalesce(max(s.share), 0) AS DOUBLE) AS score
FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""

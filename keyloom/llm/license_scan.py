"""License scans by diagonal voting (operator 7, DataFrame functions only).

Every rolling k-gram of words is hashed and joined to the positions of the same k-grams in notice
templates. A hit at text position i and template position j votes for diagonal i - j; votes are counted
per (document, template, diagonal), neighbouring diagonals are merged (words put in, changed or left out shift
the rest by a few), and a span is accepted if its hits, each of which was compared word by word, cover
enough of the template's words. A template of fewer than k words is a single gram of all its words.

Documents are read once, row by row; of a text only its hits leave the row, never its words. While there are at
most LISTED different template grams, a list of their hashes drops the others before they become rows. Beyond it, texts are
written once and all their grams meet the templates' in the join. That broadcasts the template side if it has at most
MAX_GRAMS grams, else both sides are shuffled.

Defined results: null, empty or wordless text has no words, places or labels and score 0; a null doc_id
is a document like others; repeated rows get equal results; other columns are left alone.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import LOWER, UPPER, cut, let, table

NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and labels, fixed by the contract.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices and whole licenses by label; the words of public license texts.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", """unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions
     of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"""),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software
     without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons
     to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or
     substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
     merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability
     whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
     either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the
     implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general
     public license along with this program if not see"""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source
     code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice
     this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this
     permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of
     merchantability and fitness"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
     permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"""),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
    ("proprietary", "all rights reserved"),
)
K = 4
#: Diagonals this near belong to one span.
GAP = 2
COVER = 0.8
MAX_GRAMS, LISTED = 200_000, 4096
_HIT = "array<struct<at:bigint,label:string>>"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, NOT_WORD), lambda w: w != "")


def _folded(text: Column) -> Column:
    """A-Z lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _gram_at(ws: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(ws, i + d) for d in range(k)])


def template_grams(templates: DataFrame, k: int = K) -> DataFrame:
    """t, label, n_template (words), j, gram (words), g (hash) of all k-grams of templates (label, body)."""
    t = templates.select("label", F.xxhash64("label", "body").alias("t"), _words(_folded(F.col("body"))).alias("ws")).filter(F.size("ws") > 0).distinct()
    t = t.withColumns({"n_template": F.size("ws"), "width": F.least(F.size("ws"), F.lit(k))})
    t = t.select("t", "label", "n_template", "width", "ws", F.explode(F.sequence(F.lit(0), F.col("n_template") - F.col("width"))).alias("j"))
    hash_ = reduce(lambda rest, m: F.when(F.col("width") == m, _gram_at(F.col("ws"), F.col("j"), m)).otherwise(rest), range(1, k), _gram_at(F.col("ws"), F.col("j"), k))
    return t.select("t", "label", "n_template", "width", "j", F.expr("slice(ws, j + 1, width)").alias("gram"), hash_.alias("g"))


def _templates(spark: SparkSession, templates) -> DataFrame:
    return templates if isinstance(templates, DataFrame) else spark.createDataFrame(list(templates), "label string, body string")


def _places(ws: Column, phrase: list[str], label: str) -> Column:
    """Where the words of a phrase stand consecutively, as (at, label)."""

    def here(i: Column) -> Column:
        return reduce(and_, [F.coalesce(F.get(ws, i + d) == x, F.lit(False)) for d, x in enumerate(phrase)])

    starts = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), here)
    return F.transform(starts, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


_GRAMS = "array<struct<i:int,g:bigint,gram:array<string>>>"


def _grams(ws: Column, width: int, known: list[tuple[int, str]] | None) -> Column:
    """Position, hash and words of the grams of a text; known: hashes and first words of the grams that matter."""
    at = F.sequence(F.lit(0), F.size(ws) - width)
    if known is not None:
        firsts = sorted({w for _, w in known})
        at = F.filter(at, lambda i: F.get(ws, i).isin(firsts))
    out = F.transform(at, lambda i: F.struct(i.alias("i"), _gram_at(ws, i, width).alias("g"), F.slice(ws, i + 1, width).alias("gram")))
    if known is not None:
        out = F.filter(out, lambda x: x["g"].isin(sorted({g for g, _ in known})))
    return F.when(F.size(ws) >= width, out).otherwise(F.array()).cast(_GRAMS)


def _base(ws: Column, text: Column) -> Column:
    """Places of the base phrases; only texts with their common word are searched."""
    found = F.when(F.contains(text, F.lit("license")) & (F.size(ws) > 0), F.flatten(F.array(*[_places(ws, p.split(), label) for p, label in PHRASES])))
    return F.coalesce(found, F.array().cast(_HIT))


def read(docs: DataFrame, templates=TEMPLATES, k: int = K, listed: int = LISTED, max_grams: int = MAX_GRAMS) -> tuple[DataFrame, DataFrame]:
    """(rows, hits). rows: uid, doc_id, n_words, base (places of the base phrases). hits: uid, i, t, label, n_template, width, j of grams that are equal word by word."""
    spark = docs.sparkSession
    tpl = cut(template_grams(_templates(spark, templates), k))
    known: dict[int, list[tuple[int, str]]] = {}
    for width, g, first in tpl.select("width", "g", F.col("gram")[0]).distinct().limit(listed + 1).collect():
        known.setdefault(width, []).append((g, first))
    few = sum(map(len, known.values())) <= listed
    widths = sorted(known) if few else range(1, k + 1)
    n_words, doc = lambda ws: F.size(ws).cast("long").alias("n_words"), [F.monotonically_increasing_id().alias("uid"), "doc_id"]
    grams = lambda ws: F.flatten(F.array(F.array().cast(_GRAMS), *[_grams(ws, m, known[m] if few else None) for m in widths])).alias("grams")
    of = lambda parts: let(_folded(F.col("text")), lambda x: let(_words(x), lambda ws: F.struct(*parts(ws, x)))).alias("x")
    if few:
        # one pass: of the grams, only those that some template has are left
        rows = cut(docs.select(*doc, of(lambda ws, x: (n_words(ws), _base(ws, x).alias("base"), grams(ws)))).select("uid", "doc_id", "x.*"))
        found = rows.select("uid", F.explode("grams").alias("x"))
    else:
        texts = cut(docs.select(*doc, "text"))
        rows = texts.select("uid", "doc_id", of(lambda ws, x: (n_words(ws), _base(ws, x).alias("base")))).select("uid", "doc_id", "x.*")
        found = texts.select("uid", F.explode(of(lambda ws, x: (grams(ws),))["grams"]).alias("x"))
    found = found.select("uid", "x.i", "x.g", F.col("x.gram").alias("own"))
    hits = found.join(F.broadcast(tpl) if tpl.count() <= max_grams else tpl, "g").filter("own = gram")
    return rows.select("uid", "doc_id", "n_words", "base"), hits.select("uid", "i", "t", "label", "n_template", "width", "j")


def vote(hits: DataFrame, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """uid, label, start, end (words, end exclusive) and score (share of the template's words) of every verified span."""
    # a gram that the template holds twice votes on two diagonals; min and max keep each one's extent
    t = ["uid", "t", "label", "n_template", "width"]
    diag = hits.groupBy(*t, (F.col("i") - F.col("j")).alias("diag")).agg(F.collect_set("j").alias("js"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    w = Window.partitionBy("uid", "t").orderBy("diag")
    # a single gram can't be shifted against itself
    far = (F.col("diag") - F.lag("diag").over(w) > F.when(F.col("n_template") > F.col("width"), gap).otherwise(0)).cast("int")
    runs = diag.withColumn("run", F.sum(F.coalesce(far, F.lit(0))).over(w))
    merged = runs.groupBy(*t, "run").agg(F.flatten(F.collect_list("js")).alias("js"), F.min("lo").cast("long").alias("start"), (F.max("hi") + F.col("width")).cast("long").alias("end"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("js", lambda j: F.sequence(j, j + F.col("width") - 1)))))
    return merged.withColumn("score", covered / F.col("n_template")).filter(F.col("score") >= cover).select("uid", "label", "start", "end", "score")


def spans(docs: DataFrame, templates=TEMPLATES, k: int = K, gap: int = GAP, cover: float = COVER, listed: int = LISTED, max_grams: int = MAX_GRAMS) -> DataFrame:
    """doc_id, label, start, end and score of every verified span."""
    rows, hits = read(docs, templates, k, listed, max_grams)
    return rows.select("uid", "doc_id").join(vote(hits, gap, cover), "uid").drop("uid")


def scan(docs: DataFrame, templates=TEMPLATES, k: int = K, gap: int = GAP, cover: float = COVER, listed: int = LISTED, max_grams: int = MAX_GRAMS) -> DataFrame:
    """Base columns, labels and score for every row of docs."""
    rows, hits = read(docs, templates, k, listed, max_grams)
    found = vote(hits, gap, cover).groupBy("uid").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    base = F.array_sort(F.array_distinct(F.col("base.label")))
    both = F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>"))))
    return rows.join(found, "uid", "left").select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.col("base.at")).alias("first_word"), F.array_max(F.col("base.at")).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))

"""License scan by diagonal voting, in DataFrame functions alone.

Every rolling word k-gram of every text is hashed and joined to the k-grams of the license
templates (a table of at most MAX_WORDS words, broadcast); the first and the last word of
a match are compared as well, so a run of matches is compared word by word. A match votes for the diagonal place minus template place; votes are summed by
diagonal, diagonals at most SLACK apart are merged, and the span of a merged run is verified by its
words: it must hold LEAST words of the template in all (or the whole template, if that is shorter), COVER of
the words between its ends, and the words that tell the template from its neighbours, together in one k-gram. Base phrases are templates whose whole
diagonal must match without a gap.

Defined results: null text counts as empty; texts of fewer than k words have no k-grams;
repeated rows and ids are scanned row by row; overlapping and repeated places all count; an
empty table gives none; extra columns are passed over, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import table

#: Fixed by the query's contract: phrase, label.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Public licenses or the notices by which works name them: words, label, words that must be there.
TEMPLATES = [
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
        "the software or the use or other dealings in the software",
        "mit",
        "free of charge",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "apache-2",
        "",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "bsd",
        "",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gpl",
        "gnu general",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "mpl-2",
        "",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "isc",
        "without fee",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
        "unlicense",
        "",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "zlib",
        "",
    ),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc", "noncommercial"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa", "sharealike"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by", "attribution 4"),
    ("licensed under cc by nc", "cc-by-nc", "by nc"),
    ("licensed under cc by sa", "cc-by-sa", "by sa"),
]
LEAST = 10
MAX_WORDS = 100_000
K = 3
SLACK = 2
COVER = 0.7
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z alone. lower() does the same but for two characters whose lower case is ASCII."""
    odd = c.contains("K") | c.contains("İ")
    return F.when(odd, F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def gram(words: Column, i: Column) -> Column:
    return F.xxhash64(*(F.get(words, i + j) for j in range(K)))


def template_grams(spark: SparkSession, base=BASE, templates=TEMPLATES) -> DataFrame:
    """_h, _t, _tpos, _first, _last, _words, _must, _base, _label: a row for each k-gram of a template; _must
    are the places of the words that must be there."""
    rows = []
    for n, (phrase, label, *must) in enumerate([*base, *templates]):
        words, need = phrase.split(), "".join(must).split()
        at = [i for i in range(len(words) - len(need) + 1) if words[i : i + len(need)] == need] if need else [0]
        if len(words) < K or not at:
            raise ValueError(f"templates need {K} words and hold those that must be there")
        rows.append((n, words, label, n < len(base), list(range(at[0], at[0] + len(need)))))
    if sum(len(r[1]) for r in rows) > MAX_WORDS:
        raise ValueError(f"templates of more than {MAX_WORDS} words are not broadcast")
    schema = T.StructType([T.StructField("_t", T.IntegerType()), T.StructField("_w", T.ArrayType(T.StringType())), T.StructField("_label", T.StringType()), T.StructField("_base", T.BooleanType()), T.StructField("_must", T.ArrayType(T.IntegerType()))])
    df = spark.createDataFrame(rows, schema).withColumn("_words", F.size("_w"))
    df = df.withColumn("_tpos", F.explode(F.sequence(F.lit(0), F.col("_words") - K)))
    return df.select(gram(F.col("_w"), F.col("_tpos")).alias("_h"), "_t", "_tpos", F.get("_w", "_tpos").alias("_first"), F.get("_w", F.col("_tpos") + K - 1).alias("_last"), "_words", "_must", "_base", "_label")


def scan_spans(df: DataFrame, text: str = "text", key: str = "doc_id", base=BASE, templates=TEMPLATES) -> DataFrame:
    """Verified spans: _row, _key, _n (words), _t, _base, _label, _cover, _from, _to (words from 0,
    both included); a row without a span has one line with null _t."""
    docs = df.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), words_of(F.col(text)).alias("_w")).withColumn("_n", F.size("_w"))
    grams = F.transform(F.sequence(F.lit(0), F.col("_n") - K), lambda i: F.struct(i.alias("p"), gram(F.col("_w"), i).alias("h"), F.get("_w", i).alias("a"), F.get("_w", i + K - 1).alias("z")))
    none = F.array(F.struct(F.lit(-1).alias("p"), F.lit(0).cast("bigint").alias("h"), F.lit("").alias("a"), F.lit("").alias("z")))
    places = docs.select("_row", "_key", "_n", F.explode(F.when(F.col("_n") >= K, F.concat(none, grams)).otherwise(none)).alias("g"))
    places = places.select("_row", "_key", "_n", F.col("g.p").alias("_p"), F.col("g.h").alias("_h"), F.col("g.a").alias("_a"), F.col("g.z").alias("_z"))
    known = F.broadcast(template_grams(df.sparkSession, base, templates))
    hits = places.join(known, "_h", "left").where((F.col("_p") < 0) | ((F.col("_a") == F.col("_first")) & (F.col("_z") == F.col("_last")))).withColumn("_t", F.when(F.col("_p") >= 0, F.col("_t")))
    hits = hits.select("_row", "_key", "_n", "_p", "_t", "_tpos", "_words", "_must", "_base", "_label", (F.col("_p") - F.col("_tpos")).alias("_diag")).repartition("_row")
    whole = ["_row", "_key", "_n", "_t", "_words", "_must", "_base", "_label"]
    diagonals = hits.groupBy(*whole, "_diag").agg(F.collect_set("_tpos").alias("_seen"), F.min("_p").alias("_from"), (F.max("_p") + K - 1).alias("_to"))
    step = F.col("_diag") - F.lag("_diag").over(Window.partitionBy("_row", "_t").orderBy("_diag"))
    runs = diagonals.withColumn("_new", (F.col("_base") | (F.coalesce(step, F.lit(1 << 30)) > SLACK)).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(Window.partitionBy("_row", "_t").orderBy("_diag")))
    spans = runs.groupBy(*whole, "_run").agg(F.flatten(F.collect_list("_seen")).alias("_starts"), F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    seen = F.array_distinct(F.flatten(F.transform("_starts", lambda p: F.sequence(p, p + K - 1))))
    spans = spans.withColumn("_seen", F.when(F.col("_t").isNotNull(), seen)).withColumn("_held", F.size("_seen"))
    share = F.col("_held") / (F.array_max("_seen") - F.array_min("_seen") + 1)
    told = (F.size("_must") == 0) | F.exists("_starts", lambda p: (p <= F.array_min("_must")) & (p + K > F.array_max("_must")))
    good = (F.col("_held") >= F.least(F.lit(LEAST), F.col("_words"))) & (share >= COVER) & told
    spans = spans.withColumn("_cover", F.col("_held") / F.col("_words"))
    return spans.where(F.col("_t").isNull() | F.when(F.col("_base"), F.col("_held") == F.col("_words")).otherwise(good))


def scan_licenses(df: DataFrame, text: str = "text", key: str = "doc_id", base=BASE, templates=TEMPLATES) -> DataFrame:
    """A row for each row of df: key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    based = F.col("_base") & F.col("_t").isNotNull()
    joined = lambda c: F.concat_ws(",", F.sort_array(F.collect_set(c)))
    out = scan_spans(df, text, key, base, templates).groupBy("_row", "_key", "_n").agg(
        F.count_if(based).alias("n_base"),
        F.min(F.when(based, F.col("_from"))).cast("bigint").alias("first_word"),
        F.max(F.when(based, F.col("_from"))).cast("bigint").alias("last_word"),
        joined(F.when(based, F.col("_label"))).alias("base_labels"),
        joined(F.when(F.col("_t").isNotNull(), F.col("_label"))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("_t").isNotNull(), F.col("_cover"))), F.lit(0.0)).alias("score"),
    )
    return out.select(F.col("_key").alias(key), F.col("_n").cast("bigint").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op6_license_diagonals": op6_license_diagonals}
SQL: dict[str, str] = {}

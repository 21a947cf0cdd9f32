"""License scan by diagonal voting: word k-grams join template positions, and offsets vote.

Neighbouring diagonals are merged; then the span around the one of most votes is verified: what counts is how many
different positions of the notice stand on diagonals close to it, so a repeated phrase counts once.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, read

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Phrases that must stand word by word, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Openings of public licence notices, in the words this scan sees.
TEMPLATES = {
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Template words up to which their table is broadcast; a larger one is joined by a shuffle.
MOST_TEMPLATE_WORDS = 200_000
MARK = "\x00"  # no word holds it


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _grams(spark: SparkSession, phrases: Mapping[str, str], templates: Mapping[str, str]) -> DataFrame:
    """Template positions: phrases by 2-grams (w3 null), notices by 3-grams, and the mark that every document has once."""
    rows = [(-1, "", 0, 0, MARK, None, None)]
    for n, (text, label) in enumerate([*phrases.items(), *((t, k) for k, t in templates.items())]):
        w, k = text.split(), 2 if n < len(phrases) else 3
        if len(w) < k:
            raise ValueError(f"a template needs {k} words: {text!r}")
        rows += [(n, label, len(w) - k + 1, i, w[i], w[i + 1], w[i + 2] if k == 3 else None) for i in range(len(w) - k + 1)]
    table = spark.createDataFrame(rows, "tpl int, label string, need int, tpos int, t1 string, t2 string, t3 string").withColumn("h", F.when(F.col("t1") == MARK, F.lit(0).cast("long")).otherwise(F.xxhash64("t1", "t2")))
    return F.broadcast(table) if len(rows) <= MOST_TEMPLATE_WORDS else table


def license_scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, *, doc_id: str = "doc_id", text: str = "text", coverage: float = 0.5, gap: int = 3) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Every place where a phrase stands word by word counts in n_base. The 3-grams of a notice vote for diagonals (place in
    the document less place in the notice); diagonals at most gap apart are one run. A notice is found where different
    3-grams of it within 2 * gap of a run's fullest diagonal (of several the first) cover at least the given part. score is the largest coverage of anything found, 1 for a phrase. spans has (label, first, last, coverage).

    Null and empty texts, and texts without words, have n_words 0, empty labels, null places and score 0. Repeated rows
    and repeated or null ids give a row each. Columns other than the two named are not read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("id"), F.monotonically_increasing_id().alias("row"), words(F.col(text)).alias("w"))
    own = own.select("id", "row", F.size("w").cast("long").alias("n_words"), F.concat(F.array(F.lit(MARK)), "w").alias("w"))
    zipped = F.arrays_zip(F.col("w").alias("w1"), F.slice("w", 2, F.size("w")).alias("w2"), F.slice("w", 3, F.size("w")).alias("w3"))
    rolled = own.select("id", "row", "n_words", F.posexplode(zipped).alias("at", "g")).select("id", "row", "n_words", "at", "g.*")
    rolled = rolled.withColumn("gh", F.when(F.col("w1") == MARK, F.lit(0).cast("long")).otherwise(F.xxhash64("w1", "w2")))
    table = _grams(spark, phrases, templates)
    same = (F.col("gh") == F.col("h")) & (F.col("w1") == F.col("t1")) & (F.col("t2").isNull() | (F.col("t2") == F.col("w2"))) & (F.col("t3").isNull() | (F.col("t3") == F.col("w3")))
    hits = rolled.join(table, same).select("id", "row", "n_words", "tpl", "label", "need", "tpos", (F.col("at") - 1 - F.col("tpos")).cast("long").alias("diag"), (F.col("at") - 1).cast("long").alias("at"))
    n = len(phrases)
    votes = hits.repartition("row").groupBy("row", "tpl", "diag").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.first("label").alias("label"), F.first("need").alias("need"), F.count("*").alias("votes"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.collect_list("tpos").alias("places"))
    by = Window.partitionBy("row", "tpl").orderBy("diag")
    fresh = (F.col("tpl") < n) | (F.col("diag") - F.lag("diag").over(by) > gap) | F.lag("diag").over(by).isNull()
    merged = votes.withColumn("run", F.sum(fresh.cast("int")).over(by)).groupBy("row", "tpl", "run").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.first("label").alias("label"), F.first("need").alias("need"), F.sum("votes").alias("votes"), F.min("diag").alias("diag"), F.collect_list(F.struct("votes", F.negative("diag").alias("back"), "lo", "hi", "places")).alias("all"))
    peak = F.array_max(F.transform("all", lambda x: F.struct(x["votes"], x["back"])))["back"]
    merged = merged.withColumn("peak", peak).withColumn("near", F.filter("all", lambda x: F.abs(x["back"] - F.col("peak")) <= 2 * gap))
    merged = merged.withColumn("lo", F.array_min("near.lo")).withColumn("hi", F.array_max("near.hi")).withColumn("held", F.size(F.array_distinct(F.flatten("near.places"))))
    part = F.when(F.col("need") > 0, F.col("held") / F.col("need")).otherwise(0.0)
    base = F.col("tpl").between(0, n - 1) & (F.col("votes") == F.col("need"))
    notice = (F.col("tpl") >= n) & (part >= coverage)
    scored = F.when(F.col("tpl") >= n, part).when(base, F.lit(1.0)).otherwise(0.0)
    width = F.when(F.col("tpl") < n, F.col("need")).otherwise(F.col("hi") - F.col("lo") + 2)
    start = F.when(F.col("tpl") < n, F.col("diag")).otherwise(F.col("lo"))
    span = F.struct("label", start.alias("first"), (start + width).alias("last"), part.alias("coverage"))
    joined = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    return merged.groupBy("row").agg(
        F.first("id").alias(doc_id),
        F.first("n_words").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("diag"))).alias("first_word"),
        F.max(F.when(base, F.col("diag"))).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(base | notice).alias("labels"),
        F.max(scored).alias("score"),
        F.sort_array(F.collect_list(F.when(base | notice, span))).alias("spans"),
    ).drop("row")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents")).drop("spans")

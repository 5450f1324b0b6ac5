"""License notices in texts, by votes on diagonals, in DataFrame functions throughout.

Every run of GRAM words of a text is hashed and joined with the places of that run in the templates. A hit at word p of
the text and word t of a template votes for the diagonal p - t, where the template would begin. A place where a phrase
stands word for word is a diagonal with a vote for each of its runs. Words left out, put in or changed move the later
votes to a diagonal near by, so neighbouring diagonals are merged to one span, which is verified: enough of
the template's runs must be in it, in not many more words than the template has.

Runs without a hit end in the task that read them; what is shuffled is one row per text and the votes. Votes of one text
and template meet in one task: they are at most a few per word of a single text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from millrace.errors import InvalidInput

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What parts words, and the phrases whose places are counted, with their labels.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

# The notices that the licenses themselves ask for, and customary short forms of them.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "under the gnu general public license version 2"),
    ("gpl-3", "under the gnu general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

GRAM, NEAR, SHARE = 3, 4, 0.85
# Runs of the templates up to which they are sent to every executor.
BROADCAST_RUNS = 100_000

FIELDS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def _runs(spark: SparkSession, phrases, notices, gram: int) -> tuple[DataFrame, int]:
    """t_words, t_id, t_label, t_place, t_runs, t_size, t_base: every run of every template. A row each, made on the driver from
    the parameters."""
    rows = []
    for number, (label, text, base) in enumerate([*((*p, True) for p in phrases), *((*n, False) for n in notices)]):
        words = text.split()
        if len(words) < gram:
            raise InvalidInput(f"a template needs {gram} words: {text!r}")
        count = len(words) - gram + 1
        rows += [(words[t : t + gram], number, label, t, count, len(words), base) for t in range(count)]
    schema = "t_words array<string>, t_id int, t_label string, t_place int, t_runs int, t_size int, t_base boolean"
    return spark.createDataFrame(rows, schema), len(rows)


def scan(docs: DataFrame, name: str, text: str = "text", keep: list[str] | None = None, phrases=PHRASES, notices=NOTICES,
         gram: int = GRAM, near: int = NEAR, share: float = SHARE) -> DataFrame:
    """The columns `keep` of `docs` (all if None) and a struct column `name`, one row per row of `docs`.

    n_words; n_base, first_word, last_word: number, smallest and largest start of all places of the `phrases`, the starts
    null where there is none; base_labels: their labels; labels: those and the labels of verified spans, both distinct,
    sorted and comma-joined; score: the largest part of a template's runs that one span holds; spans: the verified ones
    by (first_word, last_word, label).
    A span's votes lie on diagonals at most `near` apart; it is verified from a part of `share` on if it has at most a
    quarter and `near` more words than its template. A null or empty text has no words, no labels (empty text) and score
    0; repeated rows are judged one by one; other columns of any name are kept; an empty table gives no rows.
    """
    kept = docs.columns if keep is None else keep
    if name.lower() in {c.lower() for c in kept}:
        raise InvalidInput(f"there is a column {name} already")
    templates, size = _runs(docs.sparkSession, phrases, notices, gram)
    templates = templates.withColumn("t_hash", F.xxhash64(*(F.col("t_words")[k] for k in range(gram))))
    if size <= BROADCAST_RUNS:
        templates = F.broadcast(templates)

    folded = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    # All of a row's other columns travel as one value, in one of its rows, so no name can clash.
    rows = docs.select(F.struct(*(F.col(c) for c in kept)).alias("kept"), F.array_remove(F.split(folded, NOT_WORD), "").alias("words"))
    rows = rows.withColumn("id", F.monotonically_increasing_id())
    lead = [F.slice("words", k + 1, F.greatest(F.size("words"), F.lit(1))).alias(f"w{k}") for k in range(gram)]
    runs = rows.select("id", "kept", F.size("words").alias("n"), F.posexplode_outer(F.arrays_zip(*lead)).alias("p", "run"))
    words = [F.col(f"run.w{k}") for k in range(gram)]
    runs = runs.select("id", "kept", "n", "p", *(w.alias(f"w{k}") for k, w in enumerate(words)), F.when(words[-1].isNotNull(), F.xxhash64(*words)).alias("hash"))
    same = reduce(lambda a, b: a & b, (F.col(f"w{k}") == F.col("t_words")[k] for k in range(gram)), F.col("hash") == F.col("t_hash"))
    hits = runs.join(templates, same, "left").filter("t_id IS NOT NULL OR coalesce(p, 0) = 0")
    hits = hits.select("id", F.when(F.coalesce("p", F.lit(0)) == 0, F.struct("kept", "n")).alias("row"), *(c for c in templates.columns if c not in ("t_words", "t_hash")),
                       "p", (F.col("p") - F.col("t_place")).alias("diagonal"))
    template = ["t_id", "t_label", "t_runs", "t_size", "t_base"]
    row = F.first("row", ignorenulls=True).alias("row")
    votes = hits.groupBy("id", *template, "diagonal").agg(row, F.collect_list("t_place").alias("places"), F.min("p").alias("low"), F.max("p").alias("high"))

    by = W.partitionBy("id", "t_id").orderBy("diagonal")
    votes = votes.withColumn("starts", (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by), F.lit(near + 1)) > near).cast("int"))
    votes = votes.withColumn("span", F.sum("starts").over(by))
    full = F.col("t_base") & (F.size("places") == F.col("t_runs"))
    spans = votes.groupBy("id", *template, "span").agg(
        row, F.count_if(full).alias("n_base"), F.min(F.when(full, F.col("diagonal"))).alias("first"), F.max(F.when(full, F.col("diagonal"))).alias("last"),
        F.min("low").alias("low"), (F.max("high") + gram - 1).alias("high"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"))
    part = F.col("held") / F.col("t_runs")
    fits = (F.col("high") - F.col("low") + 1 <= F.col("t_size") * 1.25 + near) & (part >= share)
    span = F.struct(F.col("low").cast("long").alias("first_word"), F.col("high").cast("long").alias("last_word"), F.col("t_label").alias("label"), part.alias("share"))
    found = spans.groupBy("id").agg(
        row, F.sum("n_base").alias("n_base"), F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("n_base") > 0, F.col("t_label"))).alias("base"), F.collect_set(F.when((F.col("n_base") > 0) | fits, F.col("t_label"))).alias("any"),
        F.coalesce(F.max(part), F.lit(0.0)).alias("score"), F.collect_list(F.when(fits, span)).alias("spans"))
    made = F.struct(F.col("row.n").cast("long").alias("n_words"), "n_base", "first_word", "last_word", F.array_join(F.sort_array("base"), ",").alias("base_labels"),
                    F.array_join(F.sort_array("any"), ",").alias("labels"), "score", F.sort_array("spans").alias("spans"))
    out = found.select(F.col("row.kept").alias("kept"), made.alias("made"))
    return out.select(*(F.col("kept").getField(c).alias(c) for c in kept), F.col("made").alias(name))

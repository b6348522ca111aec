"""Licence notices in texts by a positional index of rare words, in DataFrame operations only.

The words of all templates are posted with their positions.  Every template is looked up by
its own ``top`` words that are rarest among all files, and by the ``votes`` rarest words of
its key phrases: every place of such a word that is posted at position p of the template
votes for the template to begin p words earlier.  A beginning with votes of enough words is
a candidate; it counts if the key phrases stand at their places behind it.  Where they do,
their own words vote for it, so no other words of the file can crowd a notice out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.llm.native_words import places, words
from gradeloom.staging import stage

# Phrases and labels that the scan always reports.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, notice, and the phrases of the notice that have to be there.  Words as in
# native_words; the wordings are those of the public licence notices.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted free of charge", "associated documentation files"),
    ),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        ("is free software", "gnu general public license"),
    ),
    ("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("affero general public license",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        ("source and binary forms", "are permitted"),
    ),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-4.0", "creative commons attribution 4 0 international", ("attribution 4 0 international",)),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0 international", ("noncommercial 4 0 international",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("reserved", "all rights reserved", ("all rights reserved",)),
)

TOP = 4
VOTES = 2


def _marked(found: Column, phrase: str, name: str, mark: str | int) -> Column:
    """Places of a phrase, each with a mark."""
    return F.transform(places(found, phrase), lambda s: F.struct(F.lit(mark).alias(name), s.alias("start")))


def _words_needed(votes: int) -> list[int]:
    """Different words that have to vote for a beginning of each template."""
    return [min(votes, len(set(" ".join(phrases).split(" ")))) for _, _, phrases in TEMPLATES]


def _looked_up(idf: dict[str, float], top: int, votes: int) -> list[tuple[int, str, str, int, float]]:
    """(template, label, word, position, weight) of the words each template is looked up by.

    Only its ``top`` rarest words have a weight; words of the key phrases alone have 0.
    """
    rows = []
    for t, (label, notice, phrases) in enumerate(TEMPLATES):

        def rarest(words: str, n: int) -> set[str]:
            return set(sorted(set(words.split(" ")), key=lambda w: (-idf[w], w))[:n])

        rare = rarest(notice, top)
        asked = rare | rarest(" ".join(phrases), votes)
        rows += [(t, label, w, p, idf[w] if w in rare else 0.0) for p, w in enumerate(notice.split(" ")) if w in asked]
    return rows


def _word_offset(notice: str, phrase: str) -> int:
    return f" {notice} "[: f" {notice} ".index(f" {phrase} ")].count(" ")


def _keys() -> list[str]:
    """Words one of which is in every file that can have a label: the last of each base phrase and key phrases."""
    first = {phrase.split(" ")[-1] for phrase in BASE}
    return sorted(first | {max(phrases[0].split(" "), key=len) for _, _, phrases in TEMPLATES})


def scan_licenses(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", top: int = TOP, votes: int = VOTES) -> DataFrame:
    """(doc_id, text_hash, n_words, n_base, first_word, last_word, base_labels, labels, found, score).

    ``n_base`` counts the places of the phrases in ``BASE``, ``first_word`` and
    ``last_word`` are the least and largest of them in words from 0.  ``found`` are
    (label, start) of verified templates.  ``labels`` has their labels and the base ones;
    both lists are distinct and sorted.  ``score`` is the largest share of a verified
    template's rare words, by inverse document frequency, that voted for it; 0.5 for base
    phrases alone, else 0.

    Null and empty texts have no words.  Rows that share an id are told apart by
    ``text_hash``, equal rows have equal results.  An empty table gives an empty result.
    """
    spark = documents.sparkSession
    vocabulary = sorted({w for _, notice, _ in TEMPLATES for w in notice.split(" ")})
    keyed = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    split = keyed.withColumn("words", words(F.col("text")))
    present = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    scanned = stage(split.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), present.alias("present")), "present")
    plain = scanned.select("doc_id", "text_hash", "n_words")
    # One row per word of the templates.
    counted = scanned.select(F.explode("present").alias("word")).groupBy("word").agg(F.count("*").alias("files")).collect()
    n_files, files = scanned.count(), dict(counted)
    idf = {w: float(_idf(n_files, files.get(w, 0))) for w in vocabulary}
    chosen = _looked_up(idf, top, votes)
    suspects = scanned.filter(F.arrays_overlap("present", F.lit(_keys()))).select("doc_id", "text_hash").distinct()
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("doc_id", "text_hash")]
    suspects = stage(suspects, "suspects")
    small = suspects.count() <= 1_000_000
    texts = keyed.alias("t").join(F.broadcast(suspects).alias("s") if small else suspects.alias("s"), same)
    rows = texts.select("t.doc_id", "t.text_hash", words(F.col("t.text")).alias("words")).distinct()
    asked = sorted({word for _, _, word, _, _ in chosen})
    votes_of = F.filter(
        F.transform("words", lambda w, i: F.when(w.isin(asked), F.struct(w.alias("word"), i.alias("place")))),
        lambda vote: vote.isNotNull(),
    )
    phrases = sorted({phrase for _, _, chosen in TEMPLATES for phrase in chosen})
    base = F.concat(*(_marked(F.col("words"), phrase, "label", label) for phrase, label in BASE.items()))
    standing = F.concat(*(_marked(F.col("words"), phrase, "phrase", k) for k, phrase in enumerate(phrases)))
    looked_up = stage(
        rows.select(
            "doc_id", "text_hash", base.alias("base"), standing.alias("standing"), votes_of.alias("votes")
        ),
        "looked_up",
    )
    postings = spark.createDataFrame(chosen, "template int, label string, word string, position int, weight double")
    voted = (
        looked_up.select("doc_id", "text_hash", "standing", F.inline("votes"))
        .join(F.broadcast(postings), "word")
        .withColumn("begin", F.col("place") - F.col("position"))
        .groupBy("doc_id", "text_hash", "template", "label", "begin")
        .agg(F.collect_set(F.struct("word", "weight")).alias("words"), F.first("standing").alias("standing"))
    )
    needed = F.create_map(*(F.lit(x) for t, n in enumerate(_words_needed(votes)) for x in (t, n)))
    verified = voted.filter((F.size("words") >= F.element_at(needed, F.col("template"))) & _verified(phrases))
    gained = F.aggregate(F.col("words")["weight"], F.lit(0.0), lambda a, b: a + b)
    most = postings.select("template", "word", "weight").distinct().groupBy("template").agg(F.sum("weight").alias("most"))
    labelled = (
        verified.join(F.broadcast(most), "template")
        .withColumn("share", F.least(F.lit(1.0), gained / F.col("most")))
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_set(F.struct("label", F.col("begin").alias("start")))).alias("found"), F.max("share").alias("share"))
    )
    judged = _with_same(looked_up.select("doc_id", "text_hash", "base"), labelled, ["base"], ["found", "share"])
    judged = stage(judged, "judged")
    done = _with_same(plain, F.broadcast(judged) if small else judged, ["n_words"], ["base", "found", "share"])
    none = F.array().cast("array<struct<label:string,start:int>>")
    found = F.coalesce("found", none)
    base = F.coalesce("base", F.array().cast("array<struct<label:string,start:int>>"))
    base_labels = F.array_sort(F.array_distinct(base["label"]))
    return done.select(
        "doc_id",
        "text_hash",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).cast("long").alias("first_word"),
        F.array_max(base["start"]).cast("long").alias("last_word"),
        base_labels.alias("base_labels"),
        F.array_sort(F.array_union(base_labels, found["label"])).alias("labels"),
        found.alias("found"),
        F.coalesce("share", F.when(F.size(base) > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def _idf(n_files: int, with_word: int) -> float:
    return math.log((n_files + 1) / (with_word + 1)) + 1e-6


def _verified(phrases: list[str]) -> Column:
    """Whether every key phrase of the template stands at its place behind ``begin``."""
    number = {phrase: k for k, phrase in enumerate(phrases)}
    result = F.lit(False)
    for t, (_, notice, chosen) in enumerate(TEMPLATES):
        standing = F.lit(True)
        for phrase in chosen:
            place = F.struct(F.lit(number[phrase]).alias("phrase"), (F.col("begin") + _word_offset(notice, phrase)).alias("start"))
            standing = standing & F.array_contains("standing", place)
        result = F.when(F.col("template") == t, standing).otherwise(result)
    return result


def _with_same(left: DataFrame, right: DataFrame, from_left: list[str], from_right: list[str]) -> DataFrame:
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("doc_id", "text_hash")]
    columns = [F.col(f"l.{c}") for c in ("doc_id", "text_hash", *from_left)] + [F.col(f"r.{c}") for c in from_right]
    return left.alias("l").join(right.alias("r"), same, "left").select(*columns)

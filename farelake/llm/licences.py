"""Licence scans by a positional rare-token index.

The index holds licence templates: for each word its template and position. A
text's licence words (the templates' words except function words) are taken with
their positions; how many documents have each word gives its inverse document
frequency over the whole corpus. A template is looked up from the rarest word of its
mandatory key phrase on: a place of that word in the text says where the template would have to start, and the
places of the next rarest words, moved back by their positions, are intersected with it until the
whole key phrase is verified. At the starts that are left the template's other
postings are intersected too: the label's score is the share of the template's licence words, by IDF,
that stand where they should. All of a text's licence words are looked up, and the work is linear in
their number, but for a sort.

Everything is array work inside a row; only the word counts are shuffled, and
they are one row a licence word. Base phrases are looked up in the same rows.

Defined results: a NULL or empty text has no words, no labels and score 0. Rows
do not bear on each other but through the word counts. Other columns are not
looked at. No rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farelake.llm.common import table
from farelake.session import durable

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Licence templates: label, template words, mandatory key phrase.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "apache license version 2 0", "apache license version 2"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("cc-by", "licensed under cc by 4 0", "cc by"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "creative commons attribution license", "creative commons attribution"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "source and binary forms"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("reserved", "all rights reserved", "all rights reserved"),
)
FUNCTION_WORDS = frozenset("the and to of is in a this any or with".split())
LEAST_SCORE = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Runs of digits, letters and everything beyond ASCII, in the original spelling.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

VOCABULARY = sorted({w for _, t, _ in TEMPLATES for w in t.split()} - FUNCTION_WORDS
                    | {w for p, _ in BASE for w in p.split()})


def licence_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Stored rows (doc_id, n_words, hits: array of (at, word)) and the carried columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Words of other scripts are never looked up, so lower-casing all letters does no harm; the dotted capital I and
    # the Kelvin sign, whose small letters hold ASCII letters, are kept apart.
    low = F.lower(F.regexp_replace(text, "[İK]", "ÿ"))
    # A text that starts with a separator would give an empty first word.
    words = F.split(F.regexp_replace(low, "^" + _GAP, ""), _GAP)
    placed = F.transform(words, lambda w, i: F.when(w.isin(VOCABULARY), F.struct(i.alias("at"), w.alias("word"))))
    return durable(docs.select(
        F.col(id_col).alias("doc_id"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("n_words"),
        F.filter(placed, lambda h: h.isNotNull()).alias("hits"), *carry), "licence-words")


def word_weights(rows: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each licence word; one row a vocabulary word comes to the driver."""
    n = rows.count()
    counts = dict(rows.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word"))
                  .groupBy("word").agg(F.count(F.lit(1))).collect())
    return {w: math.log((n + 1) / (counts.get(w, 0) + 0.5)) for w in VOCABULARY}


def _places(word: str, back: int) -> Column:
    """Where a phrase would start that has ``word`` at place ``back``."""
    return F.transform(F.filter("hits", lambda h: h["word"] == word), lambda h: h["at"] - back)


def _best(starts: Column, words: list[tuple[int, str]], weight: dict[str, float]) -> Column:
    """(start, score) of the start with the largest share of the words, by weight, that stand where they should.

    Each word's agreeing starts are one set intersection; the agreements of all words are
    sorted and added up run by run, so the work is linear but for the sort.
    """
    total = sum(weight[w] for _, w in words)

    def agreeing(k: int, w: str) -> Column:
        return F.transform(F.array_intersect(starts, _places(w, k)), lambda s: F.struct(s.alias("s"), F.lit(weight[w] / total).alias("x")))

    agreed = F.flatten(F.array(*[agreeing(k, w) for k, w in words]))
    none = F.struct(F.lit(-1).alias("s"), F.lit(0.0).alias("sum"), F.lit(-1).alias("start"), F.lit(0.0).alias("score"))

    def add(a: Column, h: Column) -> Column:
        run = F.when(a["s"] == h["s"], a["sum"]).otherwise(F.lit(0.0)) + h["x"]
        more = run > a["score"]
        return F.struct(h["s"].alias("s"), run.alias("sum"), F.when(more, h["s"]).otherwise(a["start"]).alias("start"),
                        F.when(more, run).otherwise(a["score"]).alias("score"))

    return F.aggregate(F.array_sort(agreed), none, add, lambda a: F.struct(a["start"].alias("start"), a["score"].alias("score")))


def _places_back(places: Column, by: int) -> Column:
    return F.transform(places, lambda s: s - by)


def _starts(phrase: str, weight: dict[str, float]) -> Column:
    """Places where the phrase's words stand one after the other, from its rarest word on; function words are not looked at."""
    words = sorted(((k, w) for k, w in enumerate(phrase.split()) if w in VOCABULARY), key=lambda x: (-weight[x[1]], x[0]))
    places = F.array_distinct(_places(words[0][1], words[0][0]))
    for k, w in words[1:]:
        places = F.array_intersect(places, _places(w, k))
    return places


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
         least_score: float = LEAST_SCORE) -> DataFrame:
    """Per document counts, places and labels of base phrases, the method's labels, and ``found``: (label, start, score) of each template's best place."""
    rows = licence_words(docs, id_col, text_col, carry)
    idf = word_weights(rows)
    weight = {w: idf[w] for w in VOCABULARY}
    some = F.size("hits") > 0
    nowhere = F.array().cast("array<int>")
    # Where each template's key phrase says that the template starts.
    rows = rows.withColumns({f"keyed{i}": F.when(some, _places_back(_starts(key, weight), _offset(template.split(), key.split()))).otherwise(nowhere)
                             for i, (_, template, key) in enumerate(TEMPLATES)})
    rows = rows.withColumns({f"best{i}": F.when(
        F.size(f"keyed{i}") > 0, _best(F.col(f"keyed{i}"), [(k, w) for k, w in enumerate(template.split()) if w in weight], weight))
        for i, (_, template, _) in enumerate(TEMPLATES)})
    found = F.filter(F.array(*[F.when(F.col(f"best{i}.score") >= least_score, F.struct(
        F.lit(label).alias("label"), F.col(f"best{i}.start").alias("start"), F.col(f"best{i}.score").alias("score")))
        for i, (label, _, _) in enumerate(TEMPLATES)]), lambda x: x.isNotNull())
    base = [(_starts(phrase, weight), label) for phrase, label in BASE]
    rows = rows.select(
        "doc_id", "n_words", *carry,
        found.alias("found"),
        *[F.when(some, places).otherwise(nowhere).alias(f"base{k}") for k, (places, _) in enumerate(base)])
    all_places = F.flatten(F.array(*[F.col(f"base{k}") for k in range(len(base))]))
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"base{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(base)]))
    return rows.select(
        "doc_id", "n_words", F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"), F.array_max(all_places).cast("long").alias("last_word"),
        F.array_sort(base_labels).alias("base_labels"),
        F.array_sort(F.array_union(base_labels, F.transform("found", lambda x: x["label"]))).alias("labels"),
        F.when(F.size(base_labels) > 0, F.lit(1.0)).otherwise(
            F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0))).alias("score"),
        "found", *carry)


def _offset(template: list[str], key: list[str]) -> int:
    """Place of the key phrase in its template."""
    return next(k for k in range(len(template)) if template[k:k + len(key)] == key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", "labels").alias("labels"), F.least(F.lit(1.0), F.round("score", 9)).alias("score"))

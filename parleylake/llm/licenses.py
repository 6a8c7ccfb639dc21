"""License scans by a positional index of licence words, in DataFrame functions only.

Every text is cut into words once and only the places of licence words are kept. A file looks up
the templates by all its licence words but the commonest (STOP); postings
are intersected by relative position (place in the file less place in the template), and a template
counts where enough of its words agree on one offset and its mandatory key phrase stands inside the words that it covers
there, SLACK words more or less. Every offset at which enough words agree is tried; the best that holds the phrase is given.

Defined results: null and empty texts have no words, no labels and score 0. A template that stands
several times counts once. Repeated rows each get an answer under their own id (rows of an equal
id are told apart inside); a null id stays null. Columns of other names pass by.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Template:
    """``words``: the licence sentence; ``key``: the phrase it must hold; ``share``: of its words, how many must agree."""

    label: str
    words: str
    key: str
    share: float = 0.7


TEMPLATES = (
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0", 0.8),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0", 0.8),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0", 0.8),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
)

#: Words by which a phrase may stand before or after a template's own span.
SLACK = 3

#: Words too common to look a licence up by; they still count when a template is verified.
STOP = ("the", "is", "to", "a", "of", "and", "in", "or", "this", "any", "with", "are", "use", "0", "2", "3", "4", "v")


def vocabulary() -> list[str]:
    found = {w for t in TEMPLATES for w in t.words.split()} | {w for p, _ in BASE for w in p.split()}
    return sorted(found)


def _phrase_places(hits: Column, phrase: str) -> Column:
    """Places where the phrase's words follow one another, from the (place, word) pairs of licence words in text order."""
    words = phrase.split()

    def starts(hit: Column, i: Column) -> Column:
        whole = hit["word"] == words[0]
        for k, word in enumerate(words[1:], 1):
            later = F.try_element_at(hits, i + k + 1)
            whole = whole & F.coalesce((later["word"] == word) & (later["place"] == hit["place"] + k), F.lit(False))
        return whole

    return F.transform(F.filter(hits, starts), lambda h: h["place"])


def licence_words(files: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with n_words and hits: array of (place, word) for licence words."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    cut = files.select(*keep, F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("words"))
    known = vocabulary()
    pairs = F.filter(F.transform("words", lambda w, i: F.struct(i.cast("long").alias("place"), w.alias("word"))), lambda p: p["word"].isin(known))
    some = F.arrays_overlap("words", F.array(*(F.lit(w) for w in known if w not in STOP)))
    empty = F.array().cast("array<struct<place:bigint,word:string>>")
    return cut.select(*keep, F.size("words").cast("long").alias("n_words"), F.when(some, pairs).otherwise(empty).alias("hits"))


def scan(files: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score and matches (label, place, share)."""
    spark = files.sparkSession
    source = files.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    table = scratch.table(licence_words(source, "text", ["row", "id"]), "words")
    some = table.where(F.size("hits") > 0)

    postings = spark.createDataFrame(
        [(n, t.label, w, p) for n, t in enumerate(TEMPLATES) for p, w in enumerate(t.words.split())], "template int, label string, word string, at int"
    )
    sizes = F.create_map(*(x for n, t in enumerate(TEMPLATES) for x in (F.lit(n), F.lit(len(t.words.split())))))
    shares = F.create_map(*(x for n, t in enumerate(TEMPLATES) for x in (F.lit(n), F.lit(t.share))))

    # 1. the file's licence words find the templates
    distinct = F.array_distinct(F.transform("hits", lambda h: h["word"]))
    usable = F.filter(distinct, lambda w: ~w.isin(list(STOP)))
    templates_of = {w: sorted({n for n, t in enumerate(TEMPLATES) if w in t.words.split()}) for w in vocabulary() if w not in STOP}
    index = F.create_map(*(x for w, ns in sorted(templates_of.items()) for x in (F.lit(w), F.array(*(F.lit(n) for n in ns)))))
    found = some.withColumn("candidates", F.array_distinct(F.flatten(F.transform(usable, lambda w: F.element_at(index, w)))))

    # 2. their postings, intersected by relative position; a file's hits of one template stay in that file's row group
    hits = found.select("row", "candidates", F.explode("hits").alias("hit")).select("row", "candidates", "hit.place", "hit.word")
    agreed = (
        hits.join(F.broadcast(postings), "word")
        .where(F.array_contains("candidates", F.col("template")))
        .groupBy("row", "template", "label", (F.col("place") - F.col("at")).alias("start"))
        .agg(F.count("*").alias("n"))
        .withColumn("share", F.col("n") / F.element_at(sizes, F.col("template")))
        .where(F.col("share") >= F.element_at(shares, F.col("template")))
    )

    # 3. the mandatory key phrase, inside the span that the template covers
    some_keys = some.select("row", F.array(*(_phrase_places(F.col("hits"), t.key) for t in TEMPLATES)).alias("key_at"))
    spans = F.create_map(*(x for n, t in enumerate(TEMPLATES) for x in (F.lit(n), F.lit(len(t.words.split()) - len(t.key.split())))))
    last = F.col("start") + F.element_at(spans, F.col("template")) + SLACK
    inside = F.exists(F.element_at("key_at", F.col("template") + 1), lambda k: (k >= F.col("start") - SLACK) & (k <= last))
    held = agreed.join(some_keys, "row").where(inside)
    verified = held.groupBy("row", "template", "label").agg(F.max(F.struct("share", (-F.col("start")).alias("neg"))).alias("top"))
    matched = verified.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", (-F.col("top.neg")).alias("place"), F.col("top.share").alias("share")))).alias("matches"))

    places = F.flatten(F.array(*(_phrase_places(F.col("hits"), p) for p, _ in BASE)))
    labels = F.array_compact(F.array(*(F.when(F.size(_phrase_places(F.col("hits"), p)) > 0, F.lit(label)) for p, label in BASE)))
    based = table.withColumn("places", places).withColumn("base", F.array_sort(F.array_distinct(labels)))
    joined = based.join(matched, "row", "left").withColumn("matches", F.coalesce("matches", F.array().cast("array<struct<label:string,place:bigint,share:double>>")))
    own = F.transform("matches", lambda m: m["label"])
    score = F.greatest(F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)), F.when(F.size("base") > 0, F.lit(0.9)).otherwise(0.0))
    return joined.select(
        F.col("id").alias(key),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", own))), ",").alias("labels"),
        F.least(score, F.lit(1.0)).alias("score"),
        "matches",
    )

"""Operator 3, licence scans. DataFrame functions only.

A positional index of rare licence words: of each template's mandatory words the one with the highest inverse document
frequency over the corpus is looked up; where the next rarest stand at the same relative position, the file's words around
are compared with the template, and an alignment counts once the mandatory phrase stands in place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, text_of
from .url_filter import LOWER, UPPER

#: Words of whole texts once A-Z is lower-cased: this is the class before that.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label, notice, mandatory phrase of the notice.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
)
#: Words of the notices that carry no evidence and are not indexed unless a phrase needs them.
FUNCTION_WORDS = frozenset("a and any are in is of or that the this to under use with".split())
#: Mandatory words looked up per template: the rarest leads to a place, the others must agree on it (an accepted alignment has all, so none is missed). Share of a template's indexed words that must stand in place.
LOOKED_UP, ALIGNED = 2, 0.5


def _index(templates):
    """Indexed words of each template by position, and its mandatory positions."""
    out = []
    for n, (label, notice, phrase) in enumerate(templates):
        words, need = notice.split(), phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(need)] == need)
        must = list(range(at, at + len(need)))
        out.append((n, label, {i: w for i, w in enumerate(words) if w not in FUNCTION_WORDS or i in must}, must))
    return out


def postings(index, idf: dict[str, float], looked_up: int = LOOKED_UP) -> list[tuple]:
    """(lead, template, label, rare, must, words) of each template: the word that leads to it, and which words stand how far from that one:
    the looked up, the mandatory and all indexed ones."""
    out = []
    for n, label, indexed, must in index:
        rarest = sorted({indexed[i] for i in must}, key=lambda w: (-idf[w], w))
        first = {w: next(i for i in must if indexed[i] == w) for w in rarest}
        lead = first[rarest[0]]
        out.append((rarest[0], n, label, [(w, first[w] - lead) for w in rarest[: max(looked_up, 1)]], [(indexed[i], i - lead) for i in must], [(w, i - lead) for i, w in indexed.items()]))
    return out


def probes(files: DataFrame, leads: list[str], reach: int) -> DataFrame:
    """(row, w, near) of every place of a leading word in files (row, hits): near has the vocabulary's words within reach of it, and how far off they stand.

    Hits are in order of place, so what is within reach is among as many neighbours.
    """
    hits = F.col("hits")

    def near(x, j):
        own = F.slice(hits, F.greatest(j - reach, F.lit(0)) + 1, F.lit(2 * reach + 1))
        return F.when(x["w"].isin(leads), F.struct(x["w"].alias("w"), F.transform(own, lambda y: F.struct(y["w"].alias("w"), (y["i"] - x["i"]).alias("at"))).alias("near")))

    return files.select("row", F.explode(F.filter(F.transform(hits, near), lambda x: x.isNotNull())).alias("p")).select("row", "p.w", "p.near")


def _places(hits: Column, parts: list[str]) -> Column:
    """Where the words of a phrase stand one after another."""

    def stands(x, j):
        ok = x["w"] == parts[0]
        for n, p in enumerate(parts[1:], 1):
            y = F.get(hits, j + n)
            ok = ok & F.coalesce((y["w"] == p) & (y["i"] == x["i"] + n), F.lit(False))
        return ok

    return F.transform(F.filter(hits, stands), lambda x: x["i"])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, looked_up: int = LOOKED_UP, aligned: float = ALIGNED) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score): one row per row of docs.

    score is the largest share of an accepted template's indexed words found in place; a base phrase counts as 1;
    nothing found: 0 and empty labels. Null text has no words. Rows that repeat a key are judged one by one. Empty
    table: no rows. Document frequencies are counted over all rows.
    """
    spark = docs.sparkSession
    scratch, index = Scratch(spark, "licenses"), _index(templates)
    vocabulary = sorted({w for _, _, words, _ in index for w in words.values()} | {w for p, _ in BASE for w in p.split()})
    words = docs.select(F.col(key).alias("k"), F.regexp_extract_all(text_of(text), F.lit(f"({LICENSE_WORD})"), 1).alias("w"))
    # lower() also folds a few letters beyond A-Z onto ASCII, so what it lets through is folded again by translate()
    hit = F.filter(F.transform("w", lambda x, i: F.struct(F.lower(x).alias("w"), i.alias("i"), x.alias("raw"))), lambda x: x["w"].isin(vocabulary))
    hit = F.filter(F.transform(hit, lambda x: F.struct(F.translate(x["raw"], UPPER, LOWER).alias("w"), x["i"].alias("i"))), lambda x: x["w"].isin(vocabulary))
    files = scratch.write(words.select("k", F.monotonically_increasing_id().alias("row"), F.size("w").cast("long").alias("n_words"), hit.alias("hits")))

    # at most one row per vocabulary word comes to the driver
    present = files.select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["w"]))).alias("w")).groupBy("w").count()
    frequency = {r["w"]: r["count"] for r in present.collect()}
    total = max(files.count(), 1)
    idf = {w: math.log((1 + total) / (1 + frequency.get(w, 0))) for w in vocabulary}
    shape = "array<struct<w:string,at:int>>"
    post = spark.createDataFrame(postings(index, idf, looked_up), f"w string, template int, label string, rare {shape}, must {shape}, words {shape}")
    # each template's rarest mandatory word says where to look; one row per template is broadcast: a proven bound
    reach = max((len(notice.split()) for _, notice, _ in templates), default=0)
    met = probes(files, sorted({r[0] for r in postings(index, idf, looked_up)}), reach).join(F.broadcast(post), "w")
    # rows whose rare words agree on the place are verified, on the words around it
    met = met.where(F.size(F.array_except("rare", "near")) == 0).where(F.size(F.array_except("must", "near")) == 0)
    found = met.select("row", "label", (F.size(F.array_intersect("words", "near")) / F.size("words").cast("double")).alias("share")).where(F.col("share") >= aligned)
    found = found.groupBy("row").agg(F.max("share").alias("share"), F.collect_set("label").alias("found"))

    names = [name for _, name in BASE]
    starts = [_places(F.col("hits"), phrase.split()).alias(name) for phrase, name in BASE]
    # base places are read off the same hits: words that stand together are neighbours among them
    based = files.select("k", "row", "n_words", *starts)
    every = F.concat(*[F.col(f"`{n}`") for n in names])
    labels = F.filter(F.array(*[F.when(F.size(F.col(f"`{n}`")) > 0, F.lit(n)) for n in names]), lambda x: x.isNotNull())
    based = based.select("k", "row", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_sort(labels).alias("base"))
    return based.join(found, "row", "left").select(
        F.col("k").alias(key), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))

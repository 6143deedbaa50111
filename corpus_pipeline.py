"""The corpus pipeline: raw documents in, token ids of a clean, deduplicated, mixed corpus out."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialwise.llm import bpe, jaccard, line_dedup, mixing, quality
from trialwise.llm.common import WORD, KeyFilter, Scratch, freed, table

KEY = "doc_id"


def text_hash() -> Column:
    return F.xxhash64("text")


def mark() -> Column:
    """What tells rows apart that repeat a key: the key and a hash of the text."""
    return F.struct(F.col(KEY), text_hash().alias("h"))


def marked(docs: DataFrame) -> DataFrame:
    """(id, text, lang, source): what the operators read, by key and hash of the text."""
    return docs.select(mark().alias("id"), *[c for c in docs.columns if c in ("text", "lang", "source")])


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of docs has, whatever its case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose key and hash are those of an id (a struct column id). Columns of docs may have any names."""
    key, h = free_names(docs, "picked_key", "picked_hash")
    keys = ids.select(F.col(f"id.{KEY}").alias(key), F.col("id.h").alias(h)).distinct()
    return docs.join(keys, F.col(KEY).eqNullSafe(F.col(key)) & text_hash().eqNullSafe(F.col(h)), "left_semi")


def parted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(rows that have none of the ids, the others and by chance some of the first): by a bitmap where rows are read, so texts are not shuffled. ids is a written table of struct column id.
    Beyond the bitmap's bound: (None, docs)."""
    some = KeyFilter(ids.select(F.xxhash64(f"id.{KEY}", "id.h").alias("h")))
    if not some.fits:
        return None, docs
    may, names, (own,) = some.has(), docs.columns, free_names(docs, "picked_hash")
    hashed = docs.withColumn(own, F.xxhash64(F.col(KEY), text_hash()))

    def only(wanted: bool) -> DataFrame:
        def work(batches):
            for batch in batches:
                hit = pa.array(may(batch.column(own).to_numpy()))
                yield batch.filter(hit if wanted else pc.invert(hit)).select(names)

        return hashed.mapInArrow(freed(work), docs.schema)

    return only(False), only(True)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go. Rows that repeat a key stay or go by their own text's verdict; null texts
    have no words and go. Empty table: no rows."""
    return picked(docs, quality.assess(marked(docs), key="id").where("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that repeat an earlier one of the corpus, and n_chars follows; every document stays, null texts as they are. Empty table: no rows."""
    names = free_names(docs, "lines", "dropped", "kept_in")
    out = line_dedup.dedup_lines(docs, names=tuple(names))
    return out.select(*[F.when(F.col(names[1]).isNull(), F.col(c)).otherwise(F.length("text")).cast("long").alias(c) if c == "n_chars" else out[c] for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the least id stays, once; documents without words are linked with nothing and stay.

    Rows that repeat an id with other texts are documents of their own. Empty table: no rows.
    """
    scratch = Scratch(spark, "pipeline")
    links = scratch.write(jaccard.link_documents(marked(docs), key="id", size=5, percent=80))
    # a document that is alone in its component stays as it is: only texts of the others are joined and compared
    shared = links.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("component_id").alias("own"))
    alone, some = parted(docs, scratch.write(links.join(shared, F.col("component_id").eqNullSafe(F.col("own")), "left_semi").select("id").distinct()))
    some = scratch.write(some) if alone is not None else some
    out = picked(some, links.where(F.col("id") == F.col("component_id")))
    worded = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) > 0
    out = out.where(worded).dropDuplicates([KEY, "text"]).unionByName(out.where(~worded))
    return alone.unionByName(out) if alone is not None else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; null texts have no words, and are taken as often as their source's others. Empty table: no rows."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids): each document's token ids, a row per row of docs; null texts have none. Empty table: no rows."""
    out = bpe.encode(docs.select(F.struct(KEY, "source").alias("id"), "text"), key="id")
    return out.select(F.col(f"id.{KEY}").alias(KEY), F.col("id.source").alias("source"), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding", encode),
]

#: The outlier test, the edit join and the encoder are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "stages")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = scratch.write(docs)
            # what a stage made on its way is not read again
            Scratch.clear(keep=(scratch.root,))
    return docs

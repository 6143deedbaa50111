"""Operator 5, mixing sources to target weights. DataFrame functions only.

Tokens are aggregated per source, targets and repetition rates follow, and each document is emitted floor(rate)
times plus one more copy when a number hashed from its id and the seed falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, n_words, table, text_of

WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources: (source, source_size, target), from (source, source_size).

    Sources in code-point order, null last, take the weights in turn and share budget * all sizes; a target stops at
    most * its source's size and the excess goes to the others by weight. Sorted by cap over weight, the capped
    sources come first, so running sums find where capping ends. One row per source, so the windows are small.
    """
    turn = Window.orderBy(F.col("source").isNull(), "source")
    k = (F.row_number().over(turn) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (k + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    shared = weighed.select(
        "source", "source_size", "w", "cap",
        (F.sum("source_size").over(everything) * F.lit(budget)).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("caps"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("rest"),
    )
    # level: what one unit of weight gets if all sources from here on are uncapped; it is the true level at the first such source
    shared = shared.withColumn("level", (F.col("total") - F.col("caps")) / F.col("rest"))
    first = F.min(F.when(F.col("cap") > F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"]
    return shared.withColumn("level", first).select(
        "source", F.col("source_size").cast("long").alias("source_size"), F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target")
    )


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) that key and seed alone decide: 52 bits of an MD5, which other SQL engines have too."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(mark, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _rated(docs: DataFrame, key: str, source: str, text: str, weights, budget: float, most: float, seed: int) -> tuple[DataFrame, Column]:
    """Targets (source, source_size, target), written, and the copies of a row whose key, source and target are columns k, s and target."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sums = docs.select(F.col(source).alias("source"), n_words(text_of(text)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    # A written table has a size that the planner knows: it is broadcast below the session's threshold and merge-joined above it, where skewed sources are split.
    targets = scratch.write(source_targets(sums, weights, budget, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(unit_hash(F.col("k"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return targets, copies.cast("long")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, budget: float = 1.5, most: float = 2.0, seed: int = 20) -> DataFrame:
    """(key, source, size, source_size, target, copies): one row per row of docs.

    Null text has size 0; null source is a source of its own; a null or repeated key gets the same draw each time; a
    source without words takes none; an empty table gives no rows. Other columns of docs are not read.
    """
    targets, copies = _rated(docs, key, source, text, weights, budget, most, seed)
    sized = docs.select(F.col(key).alias("k"), F.col(source).alias("s"), n_words(text_of(text)).alias("size"))
    return sized.join(targets, F.col("s").eqNullSafe(F.col("source"))).select(F.col("k").alias(key), F.col("s").alias("source"), "size", "source_size", "target", copies.alias("copies"))


def mix_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, budget: float = 1.5, most: float = 2.0, seed: int = 20) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mix takes it, columns unchanged. Odd cases are those of mix().

    A row's copies follow from its key and its source's rate, so rows stay where they are but for the join with the targets.
    """
    targets, copies = _rated(docs, key, source, text, weights, budget, most, seed)
    # all of docs in one column, so that no name can clash
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(key).alias("k"), F.col(source).alias("s"))
    rows = rows.join(targets, F.col("s").eqNullSafe(F.col("source"))).withColumn("n", copies).where("n > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")

"""Positions, ranks and quantiles without a task that holds a whole key: rows are numbered inside ranges of the order, and
ranges are offset by the sizes of those before. Range bounds are constants of the plan, so every run of it makes the same ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about; ranges at most; values sampled for each bound.
ROWS, RANGES, SAMPLED = 1 << 16, 256, 64


def _on(keys: list[str], mark: str):
    on = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"{mark}{k}"))
        on = eq if on is None else on & eq
    return on


#: Keys whose statistics are sent to every task. With more, rows are dealt out by key, of which each then has few.
SENT = 1 << 14


def few_keys(df: DataFrame, keys: list[str]) -> bool:
    return not keys or df.select(*keys).distinct().limit(SENT + 1).count() <= SENT


def sent(stats: DataFrame, few: bool) -> DataFrame:
    """Statistics as they meet rows: beside each task's where keys are few, which no shuffle by key then gathers."""
    return F.broadcast(stats) if few else stats


def bounds(df: DataFrame, value: Column, rows: int | None = None, ranges: int = RANGES) -> list:
    """Values that cut a column into ranges of about so many rows: from a bounded sample by hash. They decide who does the work, not what comes out."""
    sized = df.select(value.alias("v")).where("v is not null")
    count = sized.count()
    n = min(ranges, math.ceil(count / (rows or ROWS)))
    if n < 2:
        return []
    # by the hash of a value, so that one that many rows have counts once
    some = F.pmod(F.xxhash64("v"), F.lit(max(1, count // (16 * SAMPLED * n)))) == 0
    sample = sorted({r["v"] for r in sized.where(some).distinct().orderBy(F.xxhash64("v"), "v").limit(SAMPLED * n).collect()})
    if len(sample) < n:
        return sample
    return sorted({sample[len(sample) * i // n] for i in range(1, n)})


def range_of(value: Column, cuts: list) -> Column:
    """The number of the range that a value is in, by a tree of comparisons; null is before all."""
    if not cuts:
        return F.lit(0)

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value >= F.lit(cuts[mid]), tree(mid + 1, high)).otherwise(tree(low, mid))

    return tree(0, len(cuts))


def before(df: DataFrame, keys: list[str], order: list[Column], out: str, weight: Column | None = None, rows: int | None = None, cuts: list | None = None) -> DataFrame:
    """Adds the sum of weight (1 each by default, so the 0-based position) of the rows before each, within keys. Null keys are keys; rows equal in order come in any order."""
    weight, cuts = F.lit(1) if weight is None else weight, bounds(df, order[0], rows) if cuts is None else cuts
    ranged = df.withColumn("__range", range_of(order[0], cuts)).withColumn("__weight", weight.cast("long"))
    upto = Window.unboundedPreceding, -1
    inside = F.coalesce(F.sum("__weight").over(Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(*upto)), F.lit(0))
    if not cuts:
        return ranged.withColumn(out, inside).drop("__range", "__weight")
    # one row per key and range
    sizes = ranged.groupBy(*keys, "__range").agg(F.sum("__weight").alias("__n"))
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(*upto)), F.lit(0)))
    sizes = sizes.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__range").alias("__r"), "__before")
    on = F.col("__range") == F.col("__r")
    on = on & _on(keys, "__k_") if keys else on
    return ranged.withColumn("__i", inside).join(sizes, on).withColumn(out, F.col("__before") + F.col("__i")).drop("__range", "__weight", "__i", "__r", "__before", *[f"__k_{k}" for k in keys])


def counted(df: DataFrame, keys: list[str], value: str, rows: int | None = None) -> DataFrame:
    """(keys, value, n, before): each distinct value of a key, how many rows have it, and how many come before."""
    each = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return before(each, keys, [F.col(value)], "before", F.col("n"), rows, bounds(df, F.col(value), rows))


def ranked(df: DataFrame, keys: list[str], value: str, out: str = "rank", rows: int | None = None) -> DataFrame:
    """Adds 1-based ranks within keys; ties get their average. Nulls are first, and equal."""
    each = counted(df.select(*keys, value), keys, value, rows)
    each = each.select(*[F.col(c).alias(f"__c_{c}") for c in [*keys, value]], (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias(out))
    return df.join(each, _on([*keys, value], "__c_")).drop(*[f"__c_{c}" for c in [*keys, value]])


#: A quantile is looked for among the rows within SLACK of its share, by a sketch whose error is a quarter of that; keys of up to FEW rows are searched whole.
SLACK, FEW = 0.002, 2000


def quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], odd_lower: bool = False, slack: float = SLACK, few: int = FEW, beside: bool | None = None) -> DataFrame:
    """(keys, n, q array<double>): exact quantiles of a key's values, interpolated between neighbours; with odd_lower an odd count takes the lower
    neighbour alone. Nulls are left out; no values, no row.

    A sketch brackets each quantile; rows below the bracket are counted, and only the few values inside it are sorted, in one pass. The values are not dealt out, unless there are
    more keys than SENT (beside: whether there are not, where that is known).
    """
    beside = few_keys(df, keys) if beside is None else beside
    df = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    ends = [e for q in qs for e in (max(0.0, q - slack), min(1.0, q + slack))]
    sketch = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", F.array(*map(F.lit, ends)), int(4 / slack)).alias("__m")).where("__n > 0")
    inf = F.lit(float("inf"))
    bracket = F.array(*[F.struct(F.when(F.col("__n") <= few, -inf).otherwise(F.col("__m")[2 * i]).alias("lo"), F.when(F.col("__n") <= few, inf).otherwise(F.col("__m")[2 * i + 1]).alias("hi")) for i in range(len(qs))])
    sketch = sketch.select(*[F.col(k).alias(f"__s_{k}") for k in keys], "__n", bracket.alias("__b"))
    rows = df.join(sent(sketch, beside), _on(keys, "__s_")).drop(*[f"__s_{k}" for k in keys]) if keys else df.join(F.broadcast(sketch))  # without keys one row
    v, b = F.col("__v"), F.col("__b")
    # Rows below a bracket are one value, null, before those inside it. Both come from one evaluation of the sketch: its brackets depend on the order in which parts are merged, and a
    # second evaluation may give others. NaN is beyond all, and inside the bracket that ends at infinity
    place = lambda i, value: F.struct(F.lit(i).alias("i"), value.alias("v"))
    hits = F.array_compact(F.array(*[F.when(v < b[i]["lo"], place(i, F.lit(None).cast("double"))).when((v <= b[i]["hi"]) | (b[i]["hi"] == inf), place(i, v)) for i in range(len(qs))]))
    inside = rows.select(*keys, "__n", F.explode(hits).alias("__h")).select(*keys, "__n", F.col("__h.i").alias("__i"), F.col("__h.v").alias("__v"))
    inside = inside.groupBy(*keys, "__i", "__v").agg(F.count(F.lit(1)).alias("__c"), F.max("__n").alias("__all"))
    upto = Window.partitionBy(*keys, "__i").orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("__before", F.coalesce(F.sum("__c").over(upto), F.lit(0)))
    first = F.col("__before")
    at = F.get(F.array(*map(F.lit, map(float, qs))), F.col("__i")) * (F.col("__all") - 1)
    there = lambda k: F.max(F.when((first <= k) & (k < first + F.col("__c")), v))
    found = inside.groupBy(*keys, "__i").agg(F.max("__all").alias("n"), there(F.floor(at)).alias("low"), there(F.ceil(at)).alias("high"), F.max(at - F.floor(at)).alias("part"))
    between = F.when(F.col("part") == 0, F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("part"))
    found = found.withColumn("q", F.when(F.col("n") % 2 == 1, F.col("low")).otherwise(between) if odd_lower else between)
    return found.groupBy(*keys).agg(F.max("n").alias("n"), F.array(*[F.max(F.when(F.col("__i") == i, F.col("q"))) for i in range(len(qs))]).alias("q"))

"""Splitters. assign(df) adds fold (and repeat) to a table with one row per trial: the fold that tests it. Positions come from
ranges of the order, so no task sees all rows of a table or class unless they are few; shuffled orders are hashes of trial, repeat and seed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import before as positions


def contiguous(i: Column, n: Column, k: int) -> Column:
    """Fold of position i of n: k runs, the first n % k of them one longer."""
    q, r = F.floor(n / k), n % k
    return F.when(i < r * (q + 1), F.floor(i / (q + 1))).otherwise(r + F.floor((i - r * (q + 1)) / F.greatest(q, F.lit(1)))).cast("int")


def _hash(trial: str, repeat: int, seed) -> Column:
    """A number in [0, 1) that trial, repeat and seed decide: 52 bits of an MD5, which other SQL engines have too."""
    mark = F.md5(F.concat_ws(":", F.lit(str(repeat)), F.lit(str(seed or 0)), F.coalesce(F.col(trial).cast("string"), F.lit(""))))
    return F.conv(F.substring(mark, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


@dataclass
class KFold:
    n_splits: int = 5
    shuffle: bool = False
    random_state: int | None = None
    n_repeats = 1

    def _check(self, df: DataFrame) -> int:
        n = df.count()
        if n < self.n_splits:
            raise ValueError("more folds than trials")
        return n

    def assign(self, df: DataFrame, trial: str = "trial") -> DataFrame:
        n = self._check(df)
        if self.shuffle:
            df = df.withColumn("__hash", _hash(trial, 0, self.random_state))
        order = [F.col("__hash"), F.col(trial)] if self.shuffle else [F.col(trial)]
        return positions(df, [], order, "__pos").drop("__hash").withColumn("fold", contiguous(F.col("__pos"), F.lit(n), self.n_splits)).drop("__pos")


@dataclass
class RepeatedKFold:
    n_splits: int = 5
    n_repeats: int = 1
    random_state: int | None = None

    def assign(self, df: DataFrame, trial: str = "trial") -> DataFrame:
        return _repeat(self, df, trial, lambda seed: KFold(self.n_splits, True, seed))


def _repeat(spec, df: DataFrame, trial: str, make) -> DataFrame:
    parts = [make((spec.random_state or 0) * 1000 + r).assign(df, trial).withColumn("repeat", F.lit(r)) for r in range(spec.n_repeats)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class StratifiedKFold:
    """Classes are numbered by their first trial; a class's share of each fold is that of every k-th element of the sorted class numbers."""

    n_splits: int = 5
    shuffle: bool = False
    random_state: int | None = None
    y: str = "y"
    n_repeats = 1

    def assign(self, df: DataFrame, trial: str = "trial") -> DataFrame:
        k = self.n_splits
        classes = df.groupBy(self.y).agg(F.min(trial).alias("__first"), F.count("*").alias("__m"))
        top = classes.agg(F.max("__m")).first()[0]
        if top is None or top < k:
            raise ValueError("every class has fewer members than folds")
        # one row per class; __start is the position of its first member once classes stand one after another
        classes = positions(classes, [], [F.col("__first")], "__start", F.col("__m"))
        # positions start .. start + m - 1 of the sorted numbers: bucket f gets those that are f modulo k
        low = [F.floor((F.col("__start") + F.col("__m") - 1 - f) / F.lit(k)) - F.floor((F.col("__start") - 1 - f) / F.lit(k)) for f in range(k)]
        classes = classes.withColumn("__alloc", F.array(*low)).select(F.col(self.y).alias("__y"), F.col("__start").alias("__c"), "__alloc")
        # no forced broadcast: the planner knows the size of what it has aggregated
        rows = df.join(classes, F.col(self.y).eqNullSafe(F.col("__y")))
        if self.shuffle:
            rows = rows.withColumn("__hash", _hash(trial, 1, self.random_state))
        order = [F.col("__hash"), F.col(trial)] if self.shuffle else [F.col(trial)]
        rows = positions(rows, ["__c"], order, "__pos").drop("__hash")
        upto = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda f: F.aggregate(F.slice("__alloc", F.lit(1), f), F.lit(0).cast("long"), lambda a, v: a + v))
        return rows.withColumn("fold", F.size(F.filter(upto, lambda u: u <= F.col("__pos"))).cast("int")).drop("__y", "__c", "__alloc", "__pos")


@dataclass
class RepeatedStratifiedKFold:
    n_splits: int = 5
    n_repeats: int = 1
    random_state: int | None = None
    y: str = "y"

    def assign(self, df: DataFrame, trial: str = "trial") -> DataFrame:
        return _repeat(self, df, trial, lambda seed: StratifiedKFold(self.n_splits, True, seed, self.y))


@dataclass
class LeaveGroupsOut:
    """Shuffled folds of the distinct groups; trials follow their group."""

    n_splits: int = 5
    n_repeats: int = 1
    random_state: int | None = None
    groups: str = "group"

    def assign(self, df: DataFrame, trial: str = "trial") -> DataFrame:
        folds = RepeatedKFold(self.n_splits, self.n_repeats, self.random_state).assign(df.select(self.groups).distinct(), self.groups)
        return df.join(folds.withColumnRenamed(self.groups, "__g"), F.col(self.groups).eqNullSafe(F.col("__g"))).drop("__g")

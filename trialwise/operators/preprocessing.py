"""Scaling, clamping and label encoding. Each is fit(df) -> model and model.transform(df); fitted values are tables of one row per kept key and position.

dims: the key columns that statistics are shared over besides the rows of a trial; keys not named in `by` are reduced. With per_feature False, array positions are reduced as well.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import few_keys, quantiles, sent


def _exploded(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    return df.select(*by, F.posexplode(x).alias("i", "v")).withColumn("v", F.col("v").cast("double"))


def _collected(stats: DataFrame, by: list[str], names: list[str], per_feature: bool) -> DataFrame:
    """Statistics by position to arrays by key; without positions, scalars as they are."""
    if not per_feature:
        return stats
    rows = F.array_sort(F.collect_list(F.struct("i", *names)))
    return _arrays(stats.groupBy(*by).agg(rows.alias("__s")), by, names)


def _arrays(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    return df.select(*by, *[F.col("__s").getField(n).alias(n) for n in names])


@dataclass
class Fitted:
    """A model: table holds what was fitted, apply makes the column."""

    table: DataFrame
    by: list[str]
    x: str
    per_feature: bool
    forward: object
    backward: object
    few: bool = False

    def _map(self, df: DataFrame, f) -> DataFrame:
        names = [c for c in self.table.columns if c not in self.by]
        fitted = self.table.select(*[F.col(c).alias(f"__k_{c}") for c in self.by], *[F.col(c).alias(f"__p_{c}") for c in names])
        if self.by:
            cond = None
            for c in self.by:
                eq = F.col(c).eqNullSafe(F.col(f"__k_{c}"))
                cond = eq if cond is None else cond & eq
            joined = df.join(sent(fitted, self.few), cond)
        else:
            joined = df.join(F.broadcast(fitted))  # one row
        at = lambda n, i: F.element_at(F.col(f"__p_{n}"), i + 1) if self.per_feature else F.col(f"__p_{n}")
        value = F.transform(self.x, lambda v, i: f(v.cast("double"), {n: at(n, i) for n in names}))
        return joined.select(*[value.alias(c) if c == self.x else F.col(c) for c in df.columns])

    def transform(self, df: DataFrame) -> DataFrame:
        return self._map(df, self.forward)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self._map(df, self.backward)


class _Transformer:
    def fit_transform(self, df: DataFrame, **kw) -> DataFrame:
        return self.fit(df, **kw).transform(df)

    def clone(self):
        return replace(self)

    copy = clone

    def transform(self, df: DataFrame) -> DataFrame:
        raise ValueError(f"{type(self).__name__} is not fitted: use what fit() returns")

    inverse_transform = transform


def _one(scale: Column) -> Column:
    return F.when(scale.isNull() | F.isnan(scale) | (scale == 0), F.lit(1.0)).otherwise(scale)


@dataclass
class Scaler(_Transformer):
    """(x - mean) / std with n - 1 in the denominator; scale 0 or undefined becomes 1. weight: a column of sample weights."""

    with_mean: bool = True
    with_std: bool = True
    by: list[str] = field(default_factory=list)
    per_feature: bool = True
    x: str = "x"

    def fit(self, df: DataFrame, weight: str | None = None) -> Fitted:
        keys, few = [*self.by, "i"] if self.per_feature else self.by, few_keys(df, self.by)
        if weight is None:
            stats = _exploded(df, self.x, self.by).groupBy(*keys).agg(F.avg("v").alias("mean"), F.var_samp("v").alias("var"))
        else:
            e = df.select(*self.by, F.col(weight).cast("double").alias("w"), F.posexplode(self.x).alias("i", "v"))
            mean = e.groupBy(*keys).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean"), F.sum("w").alias("w_all"), F.sum((F.col("w") != 0).cast("double")).alias("n"))
            e = e.join(sent(mean, few), keys) if keys else e.crossJoin(F.broadcast(mean))
            stats = e.groupBy(*keys).agg(F.first("mean").alias("mean"), F.try_divide(F.sum(F.col("w") * F.pow(F.col("v") - F.col("mean"), F.lit(2))), F.first((F.col("n") - 1) / F.col("n") * F.col("w_all"))).alias("var"))
        stats = stats.withColumn("scale", _one(F.sqrt("var"))).withColumn("var", F.coalesce("var", F.lit(float("nan"))))
        m, s = self.with_mean, self.with_std

        def forward(v, p):
            return ((v - p["mean"]) if m else v) / (p["scale"] if s else F.lit(1.0))

        def backward(v, p):
            v = v * (p["scale"] if s else F.lit(1.0))
            return v + p["mean"] if m else v

        return Fitted(_collected(stats, self.by, ["mean", "var", "scale"], self.per_feature), self.by, self.x, self.per_feature, forward, backward, few)


@dataclass
class RobustScaler(_Transformer):
    """(x - median) / (high quantile - low quantile). Quantiles of an odd count are the element floor(q (n - 1)), of an even count interpolated."""

    with_centering: bool = True
    with_scaling: bool = True
    quantile_range: tuple[float, float] = (25.0, 75.0)
    by: list[str] = field(default_factory=list)
    per_feature: bool = True
    x: str = "x"

    def fit(self, df: DataFrame) -> Fitted:
        keys, few = [*self.by, "i"] if self.per_feature else self.by, few_keys(df, self.by)
        qs = [self.quantile_range[0] / 100, 0.5, self.quantile_range[1] / 100]
        stats = quantiles(_exploded(df, self.x, self.by), keys, "v", qs, odd_lower=True, beside=few)
        stats = stats.select(*keys, F.col("q")[1].alias("centre"), _one(F.col("q")[2] - F.col("q")[0]).alias("scale"))
        m, s = self.with_centering, self.with_scaling

        def forward(v, p):
            return ((v - p["centre"]) if m else v) / (p["scale"] if s else F.lit(1.0))

        def backward(v, p):
            v = v * (p["scale"] if s else F.lit(1.0))
            return v + p["centre"] if m else v

        return Fitted(_collected(stats, self.by, ["centre", "scale"], self.per_feature), self.by, self.x, self.per_feature, forward, backward, few)


@dataclass
class Clamp(_Transformer):
    """Clips to bounds: given, or Q1 - k IQR and Q3 + k IQR ('iqr'), the k and 1 - k quantiles ('quantile'), or median -+ k MAD ('mad'). A span below eps is widened around its centre. The inverse is the identity."""

    lower: float | None = None
    upper: float | None = None
    method: str = "iqr"
    k: float | None = None
    eps: float = 1e-9
    by: list[str] = field(default_factory=list)
    per_feature: bool = True
    x: str = "x"

    def fit(self, df: DataFrame) -> Fitted:
        if self.method not in ("iqr", "quantile", "mad"):
            raise ValueError(f"no method {self.method}")
        k = self.k if self.k is not None else {"iqr": 1.5, "quantile": 0.05, "mad": 3.0}[self.method]
        keys, few = [*self.by, "i"] if self.per_feature else self.by, few_keys(df, self.by)
        e = _exploded(df, self.x, self.by)
        if self.method == "mad":
            mid = quantiles(e, keys, "v", [0.5], beside=few).select(*keys, F.col("q")[0].alias("m"))
            e = e.join(sent(mid, few), keys) if keys else e.join(F.broadcast(mid))  # without keys one row
            off = quantiles(e.withColumn("v", F.abs(F.col("v") - F.col("m"))), [*keys, "m"], "v", [0.5], beside=few)
            stats = off.select(*keys, "m", F.col("q")[0].alias("d"))
            low, high = F.col("m") - k * F.col("d"), F.col("m") + k * F.col("d")
        else:
            stats = quantiles(e, keys, "v", [0.25, 0.75] if self.method == "iqr" else [k, 1 - k], beside=few)
            wide = k * (F.col("q")[1] - F.col("q")[0]) if self.method == "iqr" else F.lit(0.0)
            low, high = F.col("q")[0] - wide, F.col("q")[1] + wide
        low = F.lit(float(self.lower)) if self.lower is not None else low
        high = F.lit(float(self.upper)) if self.upper is not None else high
        narrow, centre = high - low < self.eps, (high + low) / 2
        stats = stats.select(*keys, F.when(narrow, centre - self.eps / 2).otherwise(low).alias("lower"), F.when(narrow, centre + self.eps / 2).otherwise(high).alias("upper"))
        return Fitted(_collected(stats, self.by, ["lower", "upper"], self.per_feature), self.by, self.x, self.per_feature, lambda v, p: F.least(F.greatest(v, p["lower"]), p["upper"]), lambda v, p: v, few)


@dataclass
class LabelBinariser(_Transformer):
    """One-hot codes per label feature, concatenated; labels in ascending order. An unknown label is an error."""

    neg_label: int = 0
    pos_label: int = 1
    y: str = "y"
    #: One-hot codes are as long as there are labels, and labels are constants of the plan: more are an error.
    most_labels: int = 10_000

    def fit(self, df: DataFrame) -> "FittedLabels":
        if self.pos_label <= self.neg_label:
            raise ValueError("pos_label must exceed neg_label")
        labels = df.select(F.posexplode(self.y).alias("i", "v")).where("v is not null").distinct()
        if labels.limit(self.most_labels + 1).count() > self.most_labels:
            raise ValueError(f"more than {self.most_labels} labels: y is no label")
        found = labels.groupBy("i").agg(F.array_sort(F.collect_set("v")).alias("l")).orderBy("i").collect()
        return FittedLabels([r["l"] for r in found], self.neg_label, self.pos_label, self.y)


@dataclass
class FittedLabels:
    labels: list[list]
    neg: int
    pos: int
    y: str

    def _codes(self, known: Column, v: Column) -> Column:
        return F.transform(known, lambda c: F.when(c == v, F.lit(self.pos)).otherwise(F.lit(self.neg)))

    def transform(self, df: DataFrame) -> DataFrame:
        parts = []
        for i, own in enumerate(self.labels):
            v = F.col(self.y)[i]
            known = F.array(*map(F.lit, own))
            code = self._codes(known, v)
            parts.append(F.when(F.array_contains(known, v), code).otherwise(F.raise_error(F.lit("unknown label")).cast("array<int>")))
        return df.withColumn(self.y, F.concat(*parts))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        out, at = [], 0
        for own in self.labels:
            code = F.transform(F.slice(self.y, at + 1, len(own)), lambda v: (v == self.pos).cast("int"))
            where = F.greatest(F.array_position(code, F.array_max(code)), F.lit(1)).cast("int")
            out.append(F.element_at(F.array(*map(F.lit, own)), where))
            at += len(own)
        return df.withColumn(self.y, F.array(*out))

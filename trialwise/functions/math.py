"""Row-wise mathematics. The array form reduces two array columns of a row; the long form (in grouped()) reduces two scalar
columns over a key. Nothing raises on degenerate input: 0/0 is NaN, as in IEEE arithmetic.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import ranked

NAN = float("nan")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(a: Column, b: Column, other: float = NAN) -> Column:
    """a / b, other where b is 0: Spark's ANSI mode raises there."""
    return F.when(b != 0, a / b).otherwise(F.lit(other))


def total(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v)


def dot(x, y) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: a.cast("double") * b.cast("double")))


def mean(x) -> Column:
    return safe_div(total(F.transform(_c(x), lambda v: v.cast("double"))), F.size(_c(x)))


def _pair(x, y, f) -> Column:
    """f on columns of equal length; an error where lengths differ."""
    return F.when(F.size(_c(x)) == F.size(_c(y)), f).otherwise(F.raise_error(F.lit("arrays differ in length")).cast("double"))


def accuracy(x, y) -> Column:
    return _pair(x, y, mean(F.zip_with(_c(x), _c(y), lambda a, b: (a == b).cast("double"))))


def cosine(x, y) -> Column:
    return _pair(x, y, safe_div(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))))


def cosine_d(x, y) -> Column:
    return 1 - cosine(x, y)


def euclidean(x, y) -> Column:
    return _pair(x, y, F.sqrt(total(F.zip_with(_c(x), _c(y), lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))))))


def let(value: Column, f) -> Column:
    """f(value) with value made once: inside other lambdas an expression would be made again for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _corr(a: Column, b: Column) -> Column:
    def centred(m):
        parts = F.zip_with(a, b, lambda u, v: F.struct((u.cast("double") - m["a"]).alias("a"), (v.cast("double") - m["b"]).alias("b")))
        zero = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"))
        return F.aggregate(parts, zero, lambda s, v: F.struct((s["xy"] + v["a"] * v["b"]).alias("xy"), (s["xx"] + v["a"] * v["a"]).alias("xx"), (s["yy"] + v["b"] * v["b"]).alias("yy")), lambda s: safe_div(s["xy"], F.sqrt(s["xx"]) * F.sqrt(s["yy"])))

    return let(F.struct(mean(a).alias("a"), mean(b).alias("b")), centred)


def pearsonr(x, y) -> Column:
    """Centred first: moments of raw values lose digits."""
    return _pair(x, y, _corr(_c(x), _c(y)))


def pearsonr_d(x, y) -> Column:
    return 1 - pearsonr(x, y)


def rank_rows(X: np.ndarray) -> np.ndarray:
    """1-based ranks along the last axis, ties get their average."""
    order, at = np.argsort(X, -1, kind="stable"), np.arange(X.shape[-1])
    s = np.take_along_axis(X, order, -1)
    new = np.concatenate([np.ones((*X.shape[:-1], min(1, len(at))), bool), s[..., 1:] != s[..., :-1]], -1)
    first = np.maximum.accumulate(np.where(new, at, 0), -1)
    end = np.concatenate([new[..., 1:], np.ones((*X.shape[:-1], min(1, len(at))), bool)], -1)
    last = np.minimum.accumulate(np.where(end, at, len(at))[..., ::-1], -1)[..., ::-1]
    out = np.empty(X.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, -1)
    return out


def _by_length(columns: list[pa.Array]):
    """(rows, matrices) of rows of one length, without nulls; an error where lengths of a row differ."""
    lengths = [c.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) for c in columns]
    there = np.all([n >= 0 for n in lengths], 0)
    if any((n[there] != lengths[0][there]).any() for n in lengths):
        raise ValueError("arrays differ in length")
    for n in np.unique(lengths[0][there]):
        at = np.flatnonzero(there & (lengths[0] == n))
        yield at, [c.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), n) for c in columns]


# Ranks need a sort of every row: batches of rows in numpy took 1.7 s where expressions on arrays took 4.9 (80,000 pairs of 64 numbers, 4 threads).


def _ranks(a: pa.Array) -> pa.Array:
    out: list = [None] * len(a)
    for at, (X,) in _by_length([a]):
        for i, r in zip(at, rank_rows(X)):
            out[i] = r
    return pa.array(out, pa.list_(pa.float64()))


def _spearman(a: pa.Array, b: pa.Array) -> pa.Array:
    out, known = np.zeros(len(a)), np.zeros(len(a), bool)
    for at, (X, Y) in _by_length([a, b]):
        x, y = (v - v.mean(1, keepdims=True) if v.shape[1] else v for v in (rank_rows(X), rank_rows(Y)))
        with np.errstate(all="ignore"):
            out[at], known[at] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))), True
    return pa.array(out, mask=~known)


for _f in (_ranks, _spearman):
    _f.__annotations__ = dict.fromkeys(_f.__annotations__, pa.Array)


def rank(x) -> Column:
    """1-based ranks, ties get their average. A null array has none."""
    return F.arrow_udf(_ranks, "array<double>")(_c(x).cast("array<double>"))


def spearmanr(x, y) -> Column:
    return F.arrow_udf(_spearman, "double")(_c(x).cast("array<double>"), _c(y).cast("array<double>"))


def spearmanr_d(x, y) -> Column:
    return 1 - spearmanr(x, y)


def r2(y, y_h, y_b=None) -> Column:
    """1 - SS_residual / SS_baseline; baseline is y's own mean or y_b (scalar column); 0 where SS_baseline is 0."""

    def value(b):
        rest = total(F.zip_with(_c(y), _c(y_h), lambda a, p: (a - p) * (a - p)))
        base = total(F.transform(_c(y), lambda a: (a - b) * (a - b)))
        return F.when(base != 0, 1 - rest / base).otherwise(F.lit(0.0))

    return _pair(y, y_h, let(mean(y) if y_b is None else _c(y_b), value))


def mahalanobis(x, y, precision: list[list[float]]) -> Column:
    """sqrt(d P d'), P as given (callers pass a precision matrix); NaN where the form is negative."""
    d = F.zip_with(_c(x), _c(y), lambda a, b: a.cast("double") - b.cast("double"))
    rows = F.array(*[F.array(*map(F.lit, map(float, r))) for r in precision])
    form = let(d, lambda v: dot(F.transform(rows, lambda r: dot(r, v)), v))
    return F.when(form >= 0, F.sqrt(form)).otherwise(F.lit(NAN))


def kernel(x, y, name: str = "linear", gamma: float = 1.0, coef0: float = 0.0, degree: float = 2.0) -> Column:
    """A kernel of two arrays: linear, poly, rbf or sigmoid."""
    xy = dot(x, y)
    if name == "linear":
        return xy
    if name == "poly":
        return F.pow(coef0 + gamma * xy, F.lit(degree))
    if name == "rbf":
        return F.exp(-gamma * F.greatest(F.lit(0.0), dot(x, x) + dot(y, y) - 2 * xy))
    if name == "sigmoid":
        return F.tanh(coef0 + gamma * xy)
    raise ValueError(f"no kernel {name}")


def kernel_linear(x, y) -> Column:
    return kernel(x, y)


def kernel_poly(x, y, gamma: float, coef0: float, degree: float) -> Column:
    return kernel(x, y, "poly", gamma, coef0, degree)


def kernel_rbf(x, y, gamma: float) -> Column:
    return kernel(x, y, "rbf", gamma)


def kernel_sigmoid(x, y, gamma: float, coef0: float) -> Column:
    return kernel(x, y, "sigmoid", gamma, coef0)


# Long form: one pair of numbers a row, reduced over keys.


def grouped(df: DataFrame, keys: list[str], x: str, y: str, name: str, out: str = "value", y_b: str | None = None) -> DataFrame:
    """(keys, out): the named measure of columns x and y over each key, by partial aggregates; ranks need a window."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    if name.endswith("_d"):
        return grouped(df, keys, x, y, name[:-2], out).withColumn(out, 1 - F.col(out))
    if name == "spearmanr":
        df = ranked(ranked(df, keys, x, "__rx"), keys, y, "__ry")
        return grouped(df, keys, "__rx", "__ry", "pearsonr", out)
    if name == "roc_auc":
        # x: truth, its larger value positive; y: score
        # one row per key and label: sums of ranks, of which the larger label's count
        each = ranked(df, keys, y, "__r").groupBy(*keys, F.col(x).alias("__label")).agg(F.sum("__r").alias("__s"), F.count("*").cast("double").alias("__n"))
        top = F.max_by(F.struct("__s", "__n"), "__label")
        both = each.groupBy(*keys).agg(top.alias("__top"), F.sum("__n").alias("__all"))
        n1 = F.col("__top.__n")
        return both.select(*keys, safe_div(F.col("__top.__s") - n1 * (n1 + 1) / 2, n1 * (F.col("__all") - n1)).alias(out))
    pearson = safe_div(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))
    if name == "r2":
        base = F.sum((a - F.col(y_b)) * (a - F.col(y_b))) if y_b else F.var_pop(a) * F.count("*")
        value = F.when(base != 0, 1 - F.sum((a - b) * (a - b)) / base).otherwise(F.lit(0.0))
    else:
        value = {
            "accuracy": F.avg((F.col(x) == F.col(y)).cast("double")),
            "cosine": safe_div(F.sum(a * b), F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b))),
            "euclidean": F.sqrt(F.sum((a - b) * (a - b))),
            "pearsonr": pearson,
        }[name]
    return df.groupBy(*keys).agg(value.alias(out))


def roc_auc_one_vs_rest(df: DataFrame, keys: list[str], truth: str, label: str, score: str, out: str = "value") -> DataFrame:
    """(keys, out): mean over labels of the area for one label against the rest, from rows of a sample's truth, a label, and the score for that label.
    A label that all or none of a key's samples have counts in no mean; NaN if there is no other."""
    each = df.withColumn("__hit", (F.col(truth) == F.col(label)).cast("int"))
    both = F.max("__hit") > F.min("__hit")
    area = grouped(each, [*keys, label], "__hit", score, "roc_auc", "__a").join(each.groupBy(*keys, label).agg(both.alias("__both")), [*keys, label])
    return area.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("__both"), F.col("__a"))), F.lit(NAN)).alias(out))


def cross_validated(df: DataFrame, keys: list[str], x: str, y: str, precision: list[list[float]] | None = None, out: str = "value") -> DataFrame:
    """Cross-validated squared distance of arrays x and y over the rows of each key: (s P s' - sum d P d') / N^2 with d = x - y and s its sum.

    This is the mean over the whole N x N table of products of different rows, its diagonal zero. One aggregate, not N^2
    products; precision must be symmetric (None: identity).
    """
    d = F.zip_with(F.col(x), F.col(y), lambda a, b: a.cast("double") - b.cast("double"))
    if precision is None:
        own = dot("__d", "__d")
    else:
        n = len(precision)
        if any(not math.isclose(precision[i][j], precision[j][i], rel_tol=1e-9, abs_tol=1e-12) for i in range(n) for j in range(i)):
            raise ValueError("the matrix must be symmetric")
        rows = F.array(*[F.array(*map(F.lit, map(float, r))) for r in precision])
        own = dot(F.transform(rows, lambda r: dot(r, F.col("__d"))), "__d")
    flat = df.withColumn("__d", d).withColumn("__own", own)
    n = flat.groupBy(*keys).agg(F.sum("__own").alias("__own"), F.count("*").alias("__n"))
    sums = flat.select(*keys, F.posexplode("__d").alias("__i", "__v")).groupBy(*keys, "__i").agg(F.sum("__v").alias("__v"))
    sums = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__v"))), lambda v: v["__v"]).alias("__d"))
    return sums.withColumn("__s", own).join(n, keys).select(*keys, ((F.col("__s") - F.col("__own")) / (F.col("__n") * F.col("__n"))).alias(out))

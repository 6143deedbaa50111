"""Lagged regression over long tables of series: designs by lag windows over ranges of series, models from sums. No series meets others in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import before
from . import gram, rsa
from .local import ReceptiveField, lag_window
from .splits import contiguous


def time_delayed(df: DataFrame, keys: list[str], t_min: float, t_max: float, fs: float, alphas=1.0, t: str = "t", x: str = "x", y: str = "y", edge: str = "replicate", patterns: bool = False, span: int = 1 << 16) -> DataFrame:
    """(coef array<array<array<double>>>, intercept, alpha[, pattern]): ridge of y on lagged copies of x, from (keys, t, x, y), by ranges of series. coef is by target, feature and lag, flipped
    along lags; so is pattern, the covariance of the lagged copies times coef' times the inverse covariance of y (with one target, over n - 1)."""
    window = lag_window(t_min, t_max, fs).tolist()
    design = rsa.lagged_ranges(df, window, keys, t, x, edge, span).select(F.col("design").alias("x"), F.col(y).cast("array<double>").alias("y"))
    m = gram.ridge_cv(design, [], alphas)
    n = len(window)
    lags = F.transform("coef", lambda c: F.transform(F.sequence(F.lit(0), (F.size(c) / n - 1).cast("int")), lambda f: F.reverse(F.slice(c, f * n + 1, n))))
    if not patterns:
        return m.select(lags.alias("coef"), "intercept", "alpha")
    model = m.first()
    if model is None:
        return m.select(lags.alias("coef"), "intercept", "alpha", F.lit(None).cast("array<array<array<double>>>").alias("pattern"))
    both = gram.moments(gram.whole(design, "x", "y").select(F.concat("x", "y").alias("x"), F.array(F.lit(1.0)).alias("y")), [])[()]
    p, N = len(both[1]) - len(model["coef"]), both[0]
    C = (both[3] - np.outer(both[1], both[1]) / N) / (N - 1)
    B = C[:p, :p] @ np.array(model["coef"]).T
    B = B @ np.linalg.pinv(C[p:, p:]) if len(model["coef"]) > 1 else B / (N - 1)
    shown = B.T.reshape(len(model["coef"]), -1, n)[:, :, ::-1].tolist()
    kind = "coef array<array<double>>, intercept array<double>, alpha array<double>, pattern array<array<array<double>>>"
    return df.sparkSession.createDataFrame([(model["coef"], model["intercept"], model["alpha"], shown)], kind).select(lags.alias("coef"), "intercept", "alpha", "pattern")


def _means(df: DataFrame, name: str) -> np.ndarray:
    """The mean of each array position: one row per position."""
    rows = df.select(F.posexplode(F.col(name).cast("array<double>")).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()
    return np.array([r["m"] for r in rows])


class Lags:
    """Sums of the products of lagged copies, by folds of series: from Fourier correlations of ranges of each series, which hold the rows they need of their neighbours.

    rows are (keys, __fold, __pos, __n, x, y), centred; __n is the length of a series. Products of two lags depend on their difference alone, but for the rows that a lag moves beyond an
    end of the series: those near the ends are taken off (edge), or stay, as if series were padded.
    """

    def __init__(self, rows: DataFrame, keys: list[str], lags: list[int], edge: bool, span: int):
        w, low = len(lags), lags[0]
        halo = max(w - 1, max(map(abs, lags)), 1)
        span = max(span, halo)
        at, own = F.col("__pos") % span, F.floor(F.col("__pos") / span)
        into = F.array_compact(F.array(own, F.when(at >= span - halo, own + 1), F.when((at < halo) & (own > 0), own - 1)))
        near = rows.withColumn("__range", F.explode(into)).select(*keys, "__range", "__fold", "__pos", "__n", "x", "y")

        def work(t: pa.Table) -> pa.Table:
            r, n = t.column("__range")[0].as_py(), t.column("__n")[0].as_py()
            start, x, y = r * span - halo, gram._matrix(t.column("x")), gram._matrix(t.column("y"))
            place = t.column("__pos").to_numpy() - start
            # a short series is not padded to a whole range
            held = max(min(span, n - r * span), 0)
            X, Y = np.zeros((held + 2 * halo, x.shape[1])), np.zeros((held + 2 * halo, y.shape[1]))
            X[place], Y[place] = x, y
            mine = np.zeros(len(X), bool)
            mine[halo : halo + held] = True
            mine[max(0, n - start) :] = False
            size, f = 1 << int(np.ceil(np.log2(2 * len(X)))), x.shape[1]
            wide, inner, target = np.fft.rfft(X, size, axis=0), np.fft.rfft(X * mine[:, None], size, axis=0), np.fft.rfft(Y * mine[:, None], size, axis=0)
            moved = lambda u, v, by: np.fft.irfft(np.conj(u)[:, :, None] * v[:, None, :], size, axis=0)[by]
            R = moved(inner, wide, np.arange(1 - w, w))  # differences, features, features
            C = moved(target, wide, -np.array(lags))  # lags, targets, features
            E = np.zeros((f, w, f, w))
            places = np.flatnonzero(mine)
            for i, a in enumerate(lags) if edge else ():
                out = places[places + start >= n - a] if a > 0 else places[places + start < -a]
                for j, b in enumerate(lags) if len(out) else ():
                    to = out + a - b
                    ok = (to >= 0) & (to < len(X))
                    E[:, i, :, j] += X[out[ok]].T @ X[to[ok]]
            v = np.concatenate([[mine.sum()], (Y[mine].T @ Y[mine]).ravel(), C.ravel(), R.ravel(), E.ravel()])
            return pa.table([t.column("__fold").slice(0, 1), pa.array([f], pa.int32()), pa.array([y.shape[1]], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["fold", "f", "d", "v"])

        def add(batches):
            sums: dict = {}
            for b in batches:
                for r in b.to_pylist():
                    k = r["fold"], r["f"], r["d"]
                    sums[k] = sums.get(k, 0) + np.frombuffer(r["v"])
            for (fold, f, d), v in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([f], pa.int32()), pa.array([d], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["fold", "f", "d", "v"])

        kind = "fold int, f int, d int, v binary"
        self.n, self.xx, self.xy, self.yy = {}, {}, {}, {}
        # a row for each task and fold: matrices as large as the model's
        for r in near.groupBy(*keys, "__range").applyInArrow(work, kind).mapInArrow(add, kind).toLocalIterator():
            f, d, v = r["f"], r["d"], np.frombuffer(r["v"])
            n, yy, C, R, E = np.split(v, np.cumsum([1, d * d, w * d * f, (2 * w - 1) * f * f]))
            R, k = R.reshape(2 * w - 1, f, f), r["fold"]
            i, j = np.indices((w, w))
            full = R[i - j + w - 1].transpose(2, 0, 3, 1) - E.reshape(f, w, f, w)
            for into_, value in ((self.n, n[0]), (self.yy, yy.reshape(d, d)), (self.xy, C.reshape(w, d, f).transpose(2, 0, 1).reshape(f * w, d)), (self.xx, full.reshape(f * w, f * w))):
                into_[k] = into_.get(k, 0) + value
        self.low = low

    def total(self, name: str, without: int | None = None):
        return sum(v for k, v in getattr(self, name).items() if k != without)


def receptive_field(df: DataFrame, keys: list[str], t_min: float, t_max: float, fs: float, alpha=1.0, reg_type: str = "ridge", fit_intercept: bool = True, t: str = "t", x: str = "x", y: str = "y", reg_cv=5, patterns: bool = False, edge_correction: bool = True, span: int = 1 << 14) -> DataFrame:
    """(coef array<array<array<double>>>, intercept, alpha[, pattern]): y(t) from x(t - lag), lags int(t_min fs) to int(t_max fs), zeros beyond a series' ends; ridge or
    Laplacian penalty. coef is by target, feature and lag, as is pattern. Products of lagged copies are additive over ranges of series: see Lags.

    Of several alphas the first of the best: by the mean over times and targets of correlations over a fold's series, for reg_cv folds of series in the order of their keys, or by closed-form
    leave-one-out errors ('LOO'). Rows with nulls are left out. Empty table: no rows.
    """
    lags, al = list(range(int(t_min * fs), int(t_max * fs) + 1)), np.atleast_1d(np.asarray(alpha, float))
    kind = "coef array<array<array<double>>>, intercept array<double>, alpha double" + ", pattern array<array<array<double>>>" * patterns
    df = gram.whole(df.select(*keys, t, F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")), "x", "y")
    if df.isEmpty():
        return df.sparkSession.createDataFrame([], kind)
    mx, my = (_means(df, "x"), _means(df, "y")) if fit_intercept else (None, None)
    off = lambda c, m: F.col(c) if m is None else F.zip_with(c, F.array(*map(F.lit, map(float, m))), lambda a, b: a - b)
    each = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    folds = len(al) > 1 and reg_cv != "LOO"
    if folds:
        n = each.count()
        k = min(reg_cv, n)
        each = before(each, [], [F.col(c) for c in keys], "__i").withColumn("__fold", contiguous(F.col("__i"), F.lit(n), k)).drop("__i")
    else:
        each = each.withColumn("__fold", F.lit(0))
    each = each.select(*[F.col(c).alias(f"__k_{c}") for c in keys], "__n", "__fold")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    rows = before(df.withColumns({"x": off("x", mx), "y": off("y", my)}), list(keys), [F.col(t)], "__pos").join(each, same)
    sums = Lags(rows, keys, lags, edge_correction, span)
    f, w, d = len(sums.total("xx")) // len(lags), len(lags), sums.total("xy").shape[1]
    R = ReceptiveField(reg_type=reg_type)._penalty(f, w)
    solve = lambda a, without=None: np.linalg.lstsq(sums.total("xx", without) + a * R, sums.total("xy", without), rcond=None)[0]
    best = 0
    if len(al) > 1:
        # features by lags, as the sums have them
        design = rsa.lagged_ranges(rows.drop("__pos"), [-v for v in lags], keys, t, "x", "zero", span).select(*keys, t, "__fold", F.col("design").alias("x"), "y")
        if folds:
            best = _by_folds(design, keys, t, {(k_, i): solve(a, k_) for k_ in sums.n for i, a in enumerate(al)}, len(al), k)
        else:
            sent = df.sparkSession.sparkContext.broadcast([(np.linalg.pinv(sums.total("xx") + a * R), sums.total("xy")) for a in al])

            def errors(batches):
                out: dict = {}
                for _, X, Y in gram._blocks(batches, ["__fold"]):
                    for i, (inv, xy) in enumerate(sent.value):
                        with np.errstate(all="ignore"):
                            e = (((Y - X @ (inv @ xy)) / (1 - ((X @ inv) * X).sum(1))[:, None]) ** 2).sum()
                        out[i] = out.get(i, 0) + e
                return out

            best = int(np.argmin([float(v[0]) for _, v in sorted(gram._summed(design, errors).items())]))
    b = solve(al[best])
    coef = b.T.reshape(d, f, w)
    icpt = my - np.einsum("cfw,f->c", coef, mx) if fit_intercept else np.zeros(d)
    row = [coef.tolist(), icpt.tolist(), float(al[best])]
    if patterns:
        N = sums.total("n")
        by = np.linalg.pinv(sums.total("yy") / (N - 1)) if d > 1 else np.ones((1, 1)) / (N - 1)
        row.append((sums.total("xx") / (N - 1) @ b @ by).T.reshape(coef.shape).tolist())
    return df.sparkSession.createDataFrame([tuple(row)], kind)


def _by_folds(design: DataFrame, keys: list[str], t: str, coefs: dict, n: int, k: int) -> int:
    """The alpha with the greatest mean correlation: of each time and target over the series of a fold, by one pass of sums."""
    sent = design.sparkSession.sparkContext.broadcast(coefs)

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            X, Y, fold, at = gram._matrix(b.column("x")), gram._matrix(b.column("y")), b.column("__fold").to_numpy(), b.column("__pos").to_numpy()
            for k_ in np.unique(fold):
                own = fold == k_
                for i in range(n):
                    p, v = X[own] @ sent.value[k_, i], Y[own]
                    m = p.size
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, k_, np.int32)), pa.array(np.full(m, i, np.int32)), pa.array(np.repeat(at[own], v.shape[1])), pa.array(np.tile(np.arange(v.shape[1], dtype=np.int32), len(v))), pa.array(p.ravel()), pa.array(v.ravel())], ["fold", "a", "pos", "c", "p", "v"])

    rows = before(design, list(keys), [F.col(t)], "__pos").select("__fold", "__pos", "x", "y").mapInArrow(work, "fold int, a int, pos long, c int, p double, v double")
    r = F.try_divide(F.covar_pop("p", "v"), F.sqrt(F.var_pop("p")) * F.sqrt(F.var_pop("v")))
    each = rows.groupBy("fold", "a", "pos", "c").agg(r.alias("r")).where(~F.isnan("r"))
    score = np.full((k, n), np.nan)
    for s in each.groupBy("fold", "a").agg(F.avg("r").alias("r")).collect():  # folds x alphas rows
        score[s["fold"], s["a"]] = s["r"]
    return int(np.nan_to_num(score.sum(0) / k, nan=-2).argmax())

"""Ridge from sums. n, sums and products of x and y are additive over rows, so one pass gives them for every key and fold; models of
training folds are differences, models of feature groups are submatrices, and a second pass sums leave-one-out errors for all alphas.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .local import ridge_from_moments

#: A key's matrices come to the driver: features allowed there.
MOST_FEATURES = 4096


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def whole(df: DataFrame, *names: str) -> DataFrame:
    """Rows whose arrays are there and hold no null: a trial that lacks a number has no place in sums."""
    for n in names:
        df = df.where(F.col(n).isNotNull() & ~F.exists(n, lambda v: v.isNull()))
    return df


def moments(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> dict[tuple, tuple]:
    """{key: (n, sum x, sum y, x'x, x'y)} of few keys, by partial sums in each task, which are added up in parts of bounded size. Rows with nulls are left out."""
    from .keyed import Keyed, opened, sums

    keys = list(keys)
    rows = whole(df.select(*keys, F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")), "x", "y")
    found: dict = {}
    for r in sums(rows, Keyed(df, keys)).toArrow().to_pylist():
        found.setdefault((tuple(r[k] for k in keys), r["p"], r["d"]), []).append((r["part"], r["v"]))
    if any(p > MOST_FEATURES for _, p, _ in found):
        raise ValueError("too many features for a driver's matrix")
    if len(found) != len({k for k, _, _ in found}):
        raise ValueError("a key's trials have different numbers of features or targets")
    return {k: opened(b"".join(v for _, v in sorted(parts)), p, d) for (k, p, d), parts in found.items()}


def minus(a: tuple, b: tuple) -> tuple:
    """Sums of what is in a but not in b: training rows, from all and a fold."""
    return tuple(x - y for x, y in zip(a, b))


def subset(m: tuple, mask: np.ndarray) -> tuple:
    """Sums for the features of a mask."""
    n, sx, sy, xx, xy = m
    return n, sx[mask], sy, xx[np.ix_(mask, mask)], xy[mask]


def ridge_cv(df: DataFrame, keys: list[str] = (), alphas=1.0, fit_intercept: bool = True, alpha_per_target: bool = False, x: str = "x", y: str = "y") -> DataFrame:
    """(keys, coef array<array<double>>, intercept, alpha): a ridge model per key, alpha by leave-one-out error, without gathering trials. Sums are
    solved by key on executors. Without keys, more than MOST_FEATURES features are solved by the products of trials instead. Rows with nulls are left out; a key of
    which none is left has no model, so an empty table gives no rows."""
    from . import keyed, tiles

    keys = list(keys)
    if not keys and (df.agg(F.max(F.size(x))).first()[0] or 0) > MOST_FEATURES:
        return tiles.wide_ridge(df, alphas, fit_intercept, alpha_per_target, x, y)
    return keyed.ridge_cv(df, keys, alphas, fit_intercept, alpha_per_target, x, y)


def _summed(rows: DataFrame, work) -> dict[int, np.ndarray]:
    """{id: array}: the arrays that work yields as {id: array} for its batches, added up over all tasks."""

    def part(batches):
        for k, v in work(batches).items():
            yield pa.RecordBatch.from_pydict({"id": pa.array([k], pa.int64()), "v": pa.array([np.asarray(v, float).tobytes()], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        out: dict = {}
        for k, v in zip(t.column("id").to_pylist(), t.column("v").to_pylist()):
            out[k] = out[k] + np.frombuffer(v) if k in out else np.frombuffer(v)
        return pa.table({"id": pa.array([*out], pa.int64()), "v": pa.array([v.tobytes() for v in out.values()], pa.binary())})

    parts = rows.mapInArrow(part, "id long, v binary").groupBy(F.pmod("id", F.lit(64))).applyInArrow(add, "id long, v binary")
    return {r["id"]: np.frombuffer(r["v"]) for r in parts.toArrow().to_pylist()}


def _blocks(batches, names: list[str]):
    """(key, X, Y) of each key in each batch."""
    for b in batches:
        if b.num_rows:
            X, Y, found = _matrix(b.column("x")), _matrix(b.column("y")), list(zip(*[b.column(c).to_pylist() for c in names]))
            number = {k: i for i, k in enumerate(dict.fromkeys(found))}
            at = np.array([number[k] for k in found])
            for k, i in number.items():
                yield k, X[at == i], Y[at == i]


#: Numbers that a driver holds for the models of a validation (512 MB).
MOST_NUMBERS = 1 << 26


def fits_driver(df: DataFrame, names: list[str], n_masks: int, x: str = "x") -> bool:
    """Whether the sums of all keys and folds, and the models of all masks, are small enough for validate()."""
    p = df.agg(F.max(F.size(x))).first()[0] or 0
    groups = df.select(*names).distinct().limit(MOST_NUMBERS).count()
    return p <= MOST_FEATURES and groups * p * p * (1 + n_masks) <= MOST_NUMBERS


class FoldModels:
    """Ridge models of every fold and mask, by sums: no trial is gathered.

    rows have keys, repeat and own, the fold that tests them. One pass sums moments per fold: training sums are all folds' less one's,
    a mask's are submatrices. With several alphas a second pass adds up leave-one-out errors. wanted(repeat, mask) says which masks a repeat is for.
    """

    def __init__(self, rows: DataFrame, keys: list[str], own: str, model, masks: list | None = None, x: str = "x", y: str = "y", wanted=None):
        self.groups = groups = [*keys, "repeat", own]
        self.own, self.masked = own, masks is not None
        rows = whole(rows.select(*groups, F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")), "x", "y")
        sums, al = moments(rows, groups), np.atleast_1d(np.asarray(model.alphas, float))
        everything: dict = {}
        for k, m in sums.items():
            everything[k[:-1]] = tuple(a + b for a, b in zip(everything[k[:-1]], m)) if k[:-1] in everything else m
        p, d = next(iter(sums.values()))[4].shape if sums else (0, 0)
        chosen = [np.ones(p, bool)] if masks is None else [np.asarray(m, bool) for m in masks]
        tasks = [(k, n, minus(everything[k[:-1]], m)) for k, m in sums.items() if everything[k[:-1]][0] > m[0] for n in range(len(chosen)) if wanted is None or wanted(k[-2], n)]  # a fold that holds all has no model
        by_set: dict = {}
        for i, (k, _, _) in enumerate(tasks):
            by_set.setdefault(k[:-1], []).append(i)
        solved, intercept = [], model.fit_intercept
        for _, n, train in tasks:
            count, sx, sy, xx, xy = subset(train, chosen[n])
            mx, my = (sx / count, sy / count) if intercept else (np.zeros_like(sx), np.zeros_like(sy))
            w, q = np.linalg.eigh(xx - count * np.outer(mx, mx))
            solved.append((count, mx, my, np.maximum(w, 0), q, q.T @ (xy - count * np.outer(mx, my))))
        losses = {i: np.zeros(len(al) * d) for i in range(len(tasks))}
        if len(al) > 1 and tasks:
            shared = rows.sparkSession.sparkContext.broadcast(([(k[-1], n) for k, n, _ in tasks], by_set, solved, chosen))

            def errors(batches):
                (of, sets, models, mask), out = shared.value, {}
                for k, X, Y in _blocks(batches, groups):
                    for i in sets.get(k[:-1], ()):
                        fold, n = of[i]
                        if fold != k[-1]:
                            count, mx, my, w, q, z = models[i]
                            A, B = (X[:, mask[n]] - mx) @ q, Y - my
                            own_ = out.setdefault(i, np.zeros((len(al), d)))
                            for j, a in enumerate(al):
                                g = 1 / np.where(w + a > 0, w + a, np.inf)
                                e = (B - A @ (g[:, None] * z)) / (1 - (1 / count if intercept else 0) - (A * A) @ g)[:, None]
                                own_[j] += (e * e).sum(0)
                return out

            losses |= _summed(rows, errors)
        fitted = []
        for i, (_, n, train) in enumerate(tasks):
            coef, icpt, _ = ridge_from_moments(*subset(train, chosen[n]), al, losses[i].reshape(len(al), d), intercept, model.alpha_per_target)
            full = np.zeros((d, p))
            full[:, chosen[n]] = coef
            fitted.append((full, icpt, train[2] / train[0]))
        self.rows, self.tasks, self.d, self.models_of = rows, tasks, d, {}
        for i, (k, _, _) in enumerate(tasks):
            self.models_of.setdefault(k, []).append(i)
        self.sent = rows.sparkSession.sparkContext.broadcast((self.models_of, fitted))

    def scores(self, names: list[str]) -> list[tuple]:
        """[(key, mask, repeat, fold, metric, target, score)] of r2 (against the training mean) and pearsonr, by one pass of sums."""
        sent, groups, d, tasks = self.sent, self.groups, self.d, self.tasks

        def squares(batches):
            (of, models), out = sent.value, {}
            for k, X, Y in _blocks(batches, groups):
                for i in of.get(k, ()):
                    coef, icpt, mean = models[i]
                    b, q = Y - mean, X @ coef.T + icpt - mean
                    out[i] = out.get(i, 0) + np.stack([np.full(d, len(X)), b.sum(0), q.sum(0), (b * b).sum(0), (q * q).sum(0), (b * q).sum(0), ((b - q) ** 2).sum(0)])
            return out

        out = []
        for i, v in sorted(_summed(self.rows, squares).items()) if tasks else ():
            k, n, _ = tasks[i]
            count, b, q, bb, qq, bq, rest = v.reshape(7, d)
            with np.errstate(all="ignore"):
                scores = {"r2": np.where(bb != 0, 1 - rest / np.where(bb != 0, bb, 1), 0.0), "pearsonr": (bq - b * q / count) / np.sqrt((bb - b * b / count) * (qq - q * q / count))}
            out += [(k[:-2], n, k[-2], k[-1], name, t, float(scores[name][t])) for name in names for t in range(d)]
        return out

    def predictions(self) -> DataFrame:
        """(keys, mask, repeat, fold, target, y, p): every trial's targets and what the models that have not seen it say, of all folds and masks in one pass. Rank measures are taken from these rows."""
        sent, groups, of_task = self.sent, self.groups, [n for _, n, _ in self.tasks]
        kinds = ", ".join(f"`{c}` {self.rows.schema[c].dataType.simpleString()}" for c in groups)
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(self.rows.schema[c].dataType) for c in groups]

        def work(batches):
            of, models = sent.value
            for k, X, Y in _blocks(batches, groups):
                for i in of.get(k, ()):
                    coef, icpt, _ = models[i]
                    P = X @ coef.T + icpt
                    columns = [pa.array([v] * P.size, t) for v, t in zip(k, types)]
                    columns += [pa.array(np.full(P.size, of_task[i], np.int32)), pa.array(np.tile(np.arange(P.shape[1], dtype=np.int32), len(P))), pa.array(Y.ravel()), pa.array(P.ravel())]
                    yield pa.RecordBatch.from_arrays(columns, [*groups, "mask", "target", "y", "p"])

        return self.rows.mapInArrow(work, kinds + ", mask int, target int, y double, p double").withColumnRenamed(self.own, "fold")


def validate(rows: DataFrame, keys: list[str], own: str, model, names: list[str], masks: list | None = None) -> list[tuple]:
    """[(key, mask, repeat, fold, metric, target, score)] of a ridge model: see FoldModels."""
    return FoldModels(rows, keys, own, model, masks).scores(names)


def ridge_encoder(df: DataFrame, time: str = "t", alphas=1.0, fit_intercept: bool = True, alpha_per_target: bool = False, x: str = "x", y: str = "y") -> DataFrame:
    """(time, coef array<array<double>>, intercept, alpha): a ridge model with coefficients of its own at each time, one intercept and one alpha for all.

    The design holds a row's features in its time's columns and zeros elsewhere; it is never made. Its products are a block per time, which
    moments() gives, less the outer product of its column means: solved by blocks and a rank-one correction. A second pass adds up leave-one-out
    errors. Null time is a time. Empty table: no rows.
    """
    al, sums = np.atleast_1d(np.asarray(alphas, float)), moments(df, [time], x, y)
    if not sums:
        return df.sparkSession.createDataFrame([], f"`{time}` {df.schema[time].dataType.simpleString()}, coef array<array<double>>, intercept array<double>, alpha array<double>")
    times, N = list(sums), sum(m[0] for m in sums.values())
    my = sum(m[2] for m in sums.values()) / N if fit_intercept else np.zeros(len(sums[times[0]][2]))
    # of the design's columns: mean, products, products with centred y
    m = {k: v[1] / N if fit_intercept else np.zeros_like(v[1]) for k, v in sums.items()}
    c = {k: v[4] - np.outer(v[1], my) for k, v in sums.items()}
    eigen, solved = {k: np.linalg.eigh(v[3]) for k, v in sums.items()}, []
    for a in al:
        inv = {k: (q / np.where(w + a > 1e-12, w + a, np.inf)) @ q.T for k, (w, q) in eigen.items()}
        u = {k: inv[k] @ m[k] for k in times}
        s = sum(m[k] @ u[k] for k in times)
        du = sum(c[k].T @ u[k] for k in times)
        beta = {k: inv[k] @ c[k] + np.outer(u[k], du) * N / (1 - N * s) if fit_intercept else inv[k] @ c[k] for k in times}
        solved.append((inv, u, s, beta, sum(beta[k].T @ m[k] for k in times)))
    shared = df.sparkSession.sparkContext.broadcast((solved, my))
    rows = whole(df.select(F.col(time).alias("k"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")), "x", "y")

    def errors(batches):
        (models, mean), out = shared.value, {}
        for k, X, Y in _blocks(batches, ["k"]):
            for i, (inv, u, s, beta, shift) in enumerate(models):
                p, q = ((X @ inv[k]) * X).sum(1), X @ u[k]
                h = (p - 2 * q + s + N * (q - s) ** 2 / (1 - N * s) + 1 / N) if fit_intercept else p
                e = (Y - mean - X @ beta[k] + shift) / (1 - h)[:, None]
                out[i] = out.get(i, 0) + (e * e).sum(0)
        return out

    loss = _summed(rows, errors) if len(al) > 1 else {0: np.zeros(len(my))}
    loss = np.stack([loss[i] for i in range(len(al))])
    pick = loss.argmin(0) if alpha_per_target else np.full(loss.shape[1], loss.mean(1).argmin())
    icpt = [float(my[t] - solved[a][4][t]) for t, a in enumerate(pick)]
    out = [(*k, [solved[a][3][k][:, t].tolist() for t, a in enumerate(pick)], icpt, al[pick].tolist()) for k in times]
    return df.sparkSession.createDataFrame(out, f"`{time}` {df.schema[time].dataType.simpleString()}, coef array<array<double>>, intercept array<double>, alpha array<double>")


def predict(df: DataFrame, model: DataFrame, keys: list[str] = (), x: str = "x", out: str = "prediction") -> DataFrame:
    """df with x . coef + intercept, by expression; models are one row per key."""
    from ..functions.math import dot

    keys = list(keys)
    m = model.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("coef").alias("__coef"), F.col("intercept").alias("__icpt"))
    joined = df.join(m, [F.col(k) == F.col(f"__k_{k}") for k in keys]) if keys else df.join(F.broadcast(m))
    value = F.zip_with(F.transform("__coef", lambda c: dot(c, x)), "__icpt", lambda a, b: a + b)
    return joined.withColumn(out, value).drop("__coef", "__icpt", *[f"__k_{k}" for k in keys])


def back_to_back(df: DataFrame, keys: list[str] = (), alphas=1.0, trial: str = "trial", x: str = "x", y: str = "y") -> DataFrame:
    """(keys, causal array<double>, pattern array<array<double>>): back-to-back regression from sums, without gathering trials.

    On the first half of a key's trials, in their order, y is decoded from x (an alpha for each target); on the second half, y is encoded from the decoder's scaled answers z. Sums of z and of its products with y
    follow from those of x and the decoder; each half is read once more for its leave-one-out errors. causal is the diagonal of the encoder, pattern (features, targets) that of the
    decoder. Keys and their matrices must fit a driver: else an error. Rows with nulls are left out; keys with fewer than two trials have no row. Empty table: no rows.
    """
    from ..functions.order import before

    keys, al = list(keys), np.atleast_1d(np.asarray(alphas, float))
    rows = whole(df.select(*keys, F.col(trial).alias("__t"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")), "x", "y")
    n = rows.groupBy(*keys).agg(F.floor(F.count("*") / 2).alias("__h")).select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__h")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    placed = before(rows, keys, [F.col("__t")], "__pos")
    placed = placed.join(n, same) if keys else placed.join(F.broadcast(n))  # without keys one row
    groups = [*keys, "__half"]
    halves = placed.withColumn("__half", (F.col("__pos") >= F.col("__h")).cast("int")).select(*groups, "x", "y")
    kind = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys) + "causal array<double>, pattern array<array<double>>"
    if not fits_driver(halves, groups, 2):
        raise ValueError("too many keys or features for a driver: see tasks.Sliding with local.B2B")
    both = moments(halves.select(*groups, F.concat("x", "y").alias("x"), "y"), groups)
    ready = sorted({k[:-1] for k in both if (*k[:-1], 0) in both and (*k[:-1], 1) in both}, key=repr)

    def parts(k):
        m, sx, sy, xx, _ = both[k]
        p = len(sx) - len(sy)
        return m, sx[:p], sy, xx[:p, :p], xx[:p, p:], xx[p:, p:]

    def errors_of(half: int, models: dict):
        """Leave-one-out errors (alphas, targets) of models {key: (n, mean, mean y, w, q, z, map of x)} on a half of the trials."""
        number = {k: i for i, k in enumerate(models)}
        sent = rows.sparkSession.sparkContext.broadcast((number, models))

        def work(batches):
            (at, own), out = sent.value, {}
            for k, X, Y in _blocks(batches, groups):
                if k[-1] != half or k[:-1] not in at:
                    continue
                m, mx, my, w, q, z, through = own[k[:-1]]
                A, B = ((X if through is None else X @ through) - mx) @ q, Y - my
                e = out.setdefault(at[k[:-1]], np.zeros((len(al), Y.shape[1])))
                for j, a in enumerate(al):
                    g = 1 / np.where(w + a > 0, w + a, np.inf)
                    with np.errstate(all="ignore"):
                        e[j] += (((B - A @ (g[:, None] * z)) / (1 - 1 / m - (A * A) @ g)[:, None]) ** 2).sum(0)
            return out

        found = _summed(halves, work)
        return {k: found[i].reshape(len(al), -1) for k, i in number.items()}

    def opened_(m, sx, sy, xx, xy, through=None):
        w, q = np.linalg.eigh(xx - m * np.outer(sx / m, sx / m))
        return m, sx / m, sy / m, np.maximum(w, 0), q, q.T @ (xy - m * np.outer(sx / m, sy / m)), through

    first = {k: parts((*k, 0)) for k in ready}
    loss = errors_of(0, {k: opened_(*v[:5]) for k, v in first.items()})
    decoders = {k: ridge_from_moments(*first[k][:5], al, loss[k], True, True) for k in ready}
    second = {}
    for k in ready:
        m, sx, sy, xx, xy, _ = parts((*k, 1))
        W, mx, my = decoders[k][0], sx / m, sy / m
        # of the decoder's answers, less their mean and scaled
        C = W @ (xx - m * np.outer(mx, mx)) @ W.T
        s = np.sqrt(np.maximum(np.diag(C), 0) / (m - 1)) if m > 1 else np.zeros(len(W))
        s = np.where((s == 0) | np.isnan(s), 1.0, s)
        T = W.T / s
        second[k] = (m, np.zeros(len(W)), sy, C / np.outer(s, s), T.T @ (xy - np.outer(sx, my)), T, mx @ T)
    loss = errors_of(1, {k: (lambda o, shift: (*o[:1], shift, *o[2:]))(opened_(*v[:5], v[5]), v[6]) for k, v in second.items()})
    out = []
    for k in ready:
        coef = ridge_from_moments(*second[k][:5], al, loss[k], True, False)[0]
        m, sx, sy, xx, xy, yy = first[k]
        cx = (xx - np.outer(sx, sx) / m) / (m - 1) if m > 1 else xx * np.nan
        W = decoders[k][0]
        p = cx @ W.T @ np.linalg.pinv((yy - np.outer(sy, sy) / m) / (m - 1)) if len(W) > 1 and m > 1 else cx @ W.T / max(m - 1, 1)
        out.append((*k, np.diag(coef).tolist(), p.tolist()))
    return df.sparkSession.createDataFrame(out, kind)

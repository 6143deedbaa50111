"""Fit tasks: metrics, Validator, cross_val_score, Sliding, Hierarchical and Shapley. A task is one (keys, fold, mask); its trials meet in one grouped
function, sorted by trial, so a task's block must fit a worker. Ridge models under r2, pearsonr and spearmanr, and ridge classifiers under accuracy and roc_auc, are validated by sums instead, without
gathering trials. What varies is a table of tasks joined to trials, never a driver loop.
"""

from __future__ import annotations

import functools
import itertools
import random
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import math as M
from ..functions.math import rank_rows
from . import classes, duals, gram, margins
from .gram import _matrix
from .local import SVC, KernelRidgeCV, Pipeline, RidgeClassifier, RidgeCV
from .splits import KFold, RepeatedKFold


@dataclass(frozen=True)
class Metric:
    """A score: f over what request names, each with the dimensions of reduce moved last and flattened. Names are X, y, metadata, or attributes and methods of the model."""

    name: str
    request: tuple = ("y", "predict")
    f: object = None
    reduce: tuple = (0,)
    metadata: dict = field(default_factory=dict)

    def __call__(self, *args):
        return self.f(*args)

    def grant(self, **metadata):
        return replace(self, metadata={**self.metadata, **metadata})

    def mutate(self, **changes):
        return replace(self, **changes)


def reduce_(X, dims) -> np.ndarray:
    """X with the dimensions moved to the end, in their order, and flattened into one."""
    X = np.asarray(X)
    dims = [d + X.ndim if d < 0 else d for d in ((dims,) if isinstance(dims, int) else dims)]
    if len(set(dims)) != len(dims) or any(not 0 <= d < X.ndim for d in dims):
        raise ValueError("dimensions must be different ones of the array")
    rest = [d for d in range(X.ndim) if d not in dims]
    return X.transpose(*rest, *sorted(dims)).reshape(*[X.shape[d] for d in rest], -1)


def score(model, metric, X, y=None):
    """The metric's value for a fitted model, or {name: value} for several. What metrics ask for is made once, and reduced once for each reduce."""
    several = isinstance(metric, (tuple, list))
    known, reduced, out = {"X": X, "y": y}, {}, {}
    for m in metric if several else (metric,):
        args = []
        for r in m.request:
            if r in m.metadata and r not in ("X", "y"):
                value = m.metadata[r]
            else:
                if r not in known:
                    found = getattr(model, r, None)
                    known[r] = found(X) if callable(found) else found
                if (m.reduce, r) not in reduced:
                    v = known[r]
                    reduced[m.reduce, r] = None if v is None else reduce_(np.asarray(v)[:, None] if np.ndim(v) == 1 else v, m.reduce)
                value = reduced[m.reduce, r]
            args.append(value)
        out[m.name] = m.f(*args)
    return out if several else out[metric.name]


def _corr(y, p):
    y, p = y - y.mean(-1, keepdims=True), p - p.mean(-1, keepdims=True)
    with np.errstate(all="ignore"):
        return (y * p).sum(-1) / np.sqrt((y * y).sum(-1) * (p * p).sum(-1))


def _r2(y, p, b=None):
    """b is the baseline of each target, by default its mean."""
    base = ((y - (y.mean(-1, keepdims=True) if b is None else np.asarray(b)[..., None])) ** 2).sum(-1)
    return np.where(base != 0, 1 - ((y - p) ** 2).sum(-1) / np.where(base != 0, base, 1), 0.0)


def _auc(y, s):
    """One value per label feature: decision columns are sliced by its number of labels; two labels use the last one, more are one against the rest."""
    out, at = [], 0
    for t in range(len(y)):
        own = np.unique(y[t])
        cols = s[at : at + len(own)]
        at += len(own)
        each = []
        for c, k in enumerate(own) if len(own) > 2 else [(len(cols) - 1, own[-1])]:
            pos = y[t] == k
            n1, n0 = pos.sum(), (~pos).sum()
            each.append((rank_rows(cols[[c]])[0, pos].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) if n1 and n0 else np.nan)
        out.append(np.nanmean(each) if not np.all(np.isnan(each)) else np.nan)
    return np.array(out)


accuracy = Metric("accuracy", f=lambda y, p: (y == p).mean(-1))
pearsonr = Metric("pearsonr", f=_corr)
spearmanr = Metric("spearmanr", f=lambda y, p: _corr(rank_rows(y), rank_rows(p)))
#: Under cross-validation the baseline y_b is the training mean.
r2 = Metric("r2", ("y", "predict", "y_b"), _r2)
roc_auc = Metric("roc_auc", ("y", "decision_function"), _auc)


def run_tasks(df: DataFrame, keys: list[str], fn, schema: str, trial: str = "trial") -> DataFrame:
    """fn(keys, trials, X, y, table) -> list of tuples of schema, for each key's block, sorted by trial. Tables without y have y None."""

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def work(key, t):
        t = t.sort_by(trial)
        rows = fn(tuple(k.as_py() for k in key), t.column(trial).to_numpy(), _matrix(t.column("x")), _matrix(t.column("y")) if "y" in t.column_names else None, t)
        columns = list(zip(*rows)) or [[] for _ in arrow]
        return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], names=arrow.names)

    return df.groupBy(*keys).applyInArrow(work, schema)


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def _scored(model, metrics, X, y):
    """(metric, index, value) of each metric."""
    for name, v in score(model, tuple(metrics), X, y).items():
        for d, s in enumerate(np.atleast_1d(v).ravel()):
            yield name, d, float(s)


#: Bytes of fitted models that are sent to every task; beyond, models and trials of a key meet in one task.
MOST_MODELS = 256 << 20
#: Trials of a key whose kernel (of all pairs) is made in one task.
MOST_TRIALS = 4096


class Models:
    """Fitted models, one per combination of names: a table (names, model binary), made once. The models are pickled blocks of numbers. Up to
    MOST_MODELS bytes they are sent to every task, so that trials stay where they are."""

    def __init__(self, table: DataFrame, names: list[str], keys: list[str]):
        self.table, self.names, self.keys = table.persist(), names, keys
        self._sent = None

    def sent(self):
        """{key: [(name, model)]} on every worker; None if that is too much to send."""
        if self._sent is None:
            if (self.table.agg(F.sum(F.length("model"))).first()[0] or 0) > MOST_MODELS:
                return None
            found = {}
            for r in self.table.collect():
                found.setdefault(tuple(r[k] for k in self.keys), []).append((tuple(r[n] for n in self.names), bytes(r["model"])))
            self._sent = self.table.sparkSession.sparkContext.broadcast(found)
        return self._sent

    def _beside(self, df: DataFrame, fn, schema: str) -> DataFrame:
        """fn(key, table, [(name, model)]) of each key's rows and models, which meet in one task."""
        keys, names = self.keys, self.names
        left, right = (d if keys else d.withColumn("__all", F.lit(0)) for d in (df, self.table.select(*names, "model")))
        by = keys or ["__all"]

        def work(key, rows, models):
            own = [(tuple(r[n] for n in names), r["model"]) for r in models.to_pylist()]
            return fn(tuple(k.as_py() for k in key) if keys else (), rows, own)

        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(work, schema)

    def call(self, df: DataFrame, method: str, trial: str = "trial", from_step: int | None = None) -> DataFrame:
        """(names, trial, value array<double>): the method of every model of a row's keys, on its x."""
        keys, sent, names = self.keys, self.sent(), self.names
        kinds = {f.name: f.dataType.simpleString() for f in [*df.schema, *self.table.schema]}
        rows = gram.whole(df.select(*keys, F.col(trial).alias("__trial"), F.col("x").cast("array<double>").alias("x")), "x")
        schema = ", ".join([*[f"`{n}` {kinds[n]}" for n in names], f"__trial {kinds[trial]}", "value array<double>"])
        arrow = to_arrow_schema(_parse_datatype_string(schema))

        def answer(name, model, X, trials):
            out = np.asarray(_step(model, from_step, method)(X), float).reshape(len(X), -1)
            ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
            columns = [pa.array([v] * len(out), f.type) for v, f in zip(name, arrow)]
            return [*columns, trials, pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))]

        def work(batches):
            loaded: dict = {}
            for b in batches:
                X, found, trials = _matrix(b.column("x")), list(zip(*[b.column(k).to_pylist() for k in keys])) if keys else [()] * b.num_rows, b.column("__trial")
                for k in dict.fromkeys(found):
                    at = np.array([f == k for f in found])
                    for name, raw in sent.value.get(k, ()):
                        if name not in loaded:
                            loaded[name] = cloudpickle.loads(raw)
                        yield pa.RecordBatch.from_arrays(answer(name, loaded[name], X[at], trials.filter(pa.array(at))), arrow.names)

        def beside(key, t, models):
            trials, X = t.column("__trial").combine_chunks(), _matrix(t.column("x"))
            parts = [pa.table(answer(name, cloudpickle.loads(raw), X, trials), arrow.names) for name, raw in models if len(X)]
            return pa.concat_tables([p.cast(arrow) for p in parts]) if parts else arrow.empty_table()

        out = rows.mapInArrow(work, schema) if sent else self._beside(rows, beside, schema)
        return out.withColumnRenamed("__trial", trial)

    def collect(self, attr, from_step: int | None = None) -> DataFrame:
        """(names, name, shape, value): attributes of each model, or of a step of it."""
        wanted, names = [attr] if isinstance(attr, str) else list(attr), self.names

        def work(batches):
            for b in batches:
                for r in b.to_pylist():
                    model = cloudpickle.loads(r["model"])
                    for a in wanted:
                        v = np.asarray(getattr(_step(model, from_step), a), float)
                        yield pa.RecordBatch.from_arrays([*[pa.array([r[n]], t) for n, t in zip(names, types)], pa.array([a]), pa.array([list(v.shape)], pa.list_(pa.int32())), pa.array([v.ravel().tolist()], pa.list_(pa.float64()))], [*names, "name", "shape", "value"])

        schema = _kinds(self.table, names) + "name string, shape array<int>, value array<double>"
        types = [f.type for f in to_arrow_schema(_parse_datatype_string(schema))][: len(names)]
        return self.table.mapInArrow(work, schema)

    def score(self, df: DataFrame, metrics, trial: str = "trial") -> DataFrame:
        """(names, metric, target, score) of every model of each key on all of the key's trials."""
        sent, keys, names = self.sent(), self.keys, self.names
        schema = _kinds(self.table, names) + "metric string, target int, score double"
        arrow = to_arrow_schema(_parse_datatype_string(schema))

        def rows_of(models, X, y):
            return [(*name, *s) for name, raw in models for s in _scored(cloudpickle.loads(raw), metrics, X, y)]

        def beside(key, t, models):
            t = t.sort_by(trial)
            columns = list(zip(*rows_of(models, _matrix(t.column("x")), _matrix(t.column("y"))))) if t.num_rows else []
            return pa.table([pa.array(list(c), f.type) for c, f in zip(columns or [[] for _ in arrow], arrow)], names=arrow.names)

        df = gram.whole(df, "x", "y")
        if not sent:
            return self._beside(df, beside, schema)
        return run_tasks(df, keys, lambda key, trials, X, y, t: rows_of(sent.value.get(key, ()), X, y), schema, trial)


def _step(model, from_step: int | None, method: str | None = None):
    if from_step is not None and not isinstance(model, Pipeline):
        raise ValueError("only a pipeline has steps")
    own = model if from_step is None else model[from_step]
    if method is None:
        return own
    found = getattr(own, method, None)
    if found is None:
        raise ValueError(f"{type(own).__name__} has no {method}")
    return found


def _several(metric, default=None) -> tuple:
    m = metric or default or r2
    return tuple(m) if isinstance(m, (tuple, list)) else (m,)


@dataclass
class Sliding:
    """One estimator per combination of the keys. The estimator has fit(); or it is a function of a key's (X, y), which is applied without fitting."""

    estimator: object
    keys: list[str]

    def clone(self):
        return replace(self)

    def with_targets(self, df: DataFrame, targets: DataFrame, trial: str = "trial") -> DataFrame:
        """df with y of targets, joined on trial and whatever keys targets have: a key that they lack is shared by all its values."""
        on = [trial, *[k for k in self.keys if k in targets.columns]]
        return df.drop("y").join(targets.select(*on, "y"), on)

    def fit(self, df: DataFrame, trial: str = "trial") -> "FittedSliding":
        if not hasattr(self.estimator, "fit"):
            return FittedSliding(self, None)
        est, keys = self.estimator, self.keys
        table = run_tasks(gram.whole(df, "x", "y"), keys, lambda key, trials, X, y, t: [(*key, cloudpickle.dumps(est.clone().fit(X, y)))], _kinds(df, keys) + "model binary", trial)
        return FittedSliding(self, Models(table, keys, keys))

    def collect(self, df: DataFrame, names: list[str], trial: str = "trial") -> DataFrame:
        """(keys, name, shape, value): fitted parameters of each key's model, in one pass."""
        est, keys = self.estimator, self.keys

        def fit(key, trials, X, y, t):
            m = est.clone().fit(X, y)
            return [(*key, n, list(np.shape(getattr(m, n))), np.asarray(getattr(m, n), float).ravel().tolist()) for n in names]

        return run_tasks(df, keys, fit, _kinds(df, keys) + "name string, shape array<int>, value array<double>", trial)

    def transform(self, df: DataFrame, trial: str = "trial") -> DataFrame:
        """(keys, value): a bare function's result on each key's (X, y)."""
        return FittedSliding(self, None).transform(df, trial)

    def fit_transform(self, df: DataFrame, trial: str = "trial") -> DataFrame:
        return self.fit(df, trial).transform(df, trial)

    def fit_apply(self, df: DataFrame, method: str = "predict", train: str = "train", trial: str = "trial") -> DataFrame:
        """(keys, trial, value): fitted on rows where train is true, applied to the others."""
        est, keys = self.estimator, self.keys

        def fit(key, trials, X, y, t):
            m = t.column(train).to_numpy().astype(bool)
            out = np.asarray(getattr(est.clone().fit(X[m], y[m]), method)(X[~m]))
            return [(*key, int(i), np.atleast_1d(v).astype(float).tolist()) for i, v in zip(trials[~m], out)]

        return run_tasks(df, keys, fit, _kinds(df, keys) + f"`{trial}` long, value array<double>", trial)


@dataclass
class FittedSliding:
    sliding: Sliding
    models: Models | None

    def _call(self, df, method, trial):
        if self.models is None:
            raise ValueError("a bare function has no fitted models")
        return self.models.call(df, method, trial)

    def predict(self, df: DataFrame, trial: str = "trial") -> DataFrame:
        """(keys, trial, value), as are predict_proba, decision_function and, of estimators, transform."""
        return self._call(df, "predict", trial)

    def predict_proba(self, df: DataFrame, trial: str = "trial") -> DataFrame:
        return self._call(df, "predict_proba", trial)

    def decision_function(self, df: DataFrame, trial: str = "trial") -> DataFrame:
        return self._call(df, "decision_function", trial)

    def transform(self, df: DataFrame, trial: str = "trial") -> DataFrame:
        if self.models is not None:
            return self._call(df, "transform", trial)
        f, keys = self.sliding.estimator, self.sliding.keys
        return run_tasks(df, keys, lambda key, trials, X, y, t: [(*key, np.asarray(f(X, y), float).ravel().tolist())], _kinds(df, keys) + "value array<double>", trial)

    def score(self, df: DataFrame, metric=None, trial: str = "trial") -> DataFrame:
        """(keys, metric, target, score)."""
        if self.models is None:
            raise ValueError("a bare function has no fitted models")
        return self.models.score(df, _several(metric), trial)

    def collect(self, attr) -> DataFrame:
        return self.models.collect(attr)


@dataclass
class Validator:
    """Cross-validation of an estimator: per key and fold, fit on the other folds, score on the fold."""

    model: object
    cv: object = 5
    metric: object = None

    def clone(self):
        return replace(self, model=self.model.clone())

    def _dealt(self, df: DataFrame, trial: str) -> tuple[DataFrame, int]:
        """df with repeat and __own, the fold that tests a row, and the number of folds."""
        cv = KFold(self.cv) if isinstance(self.cv, int) else self.cv
        folds = cv.assign(df.select(trial, *[c for c in (getattr(cv, "y", None), getattr(cv, "groups", None)) if c]).distinct(), trial)
        if "repeat" not in folds.columns:
            folds = folds.withColumn("repeat", F.lit(0))
        folds = folds.select(F.col(trial).alias("__t"), F.col("repeat").cast("int").alias("repeat"), F.col("fold").cast("int").alias("__own"))
        return df.join(folds, F.col(trial) == F.col("__t")).drop("__t"), cv.n_splits

    def _by_sums(self) -> RidgeCV | None:
        """The ridge model that sums can validate: kernel ridge with a linear kernel is one without intercept, with the same leave-one-out errors."""
        m = self.model
        if type(m) is KernelRidgeCV and m.kernel == "linear" and (np.asarray(m.alphas, float) > 0).all():
            m = RidgeCV(m.alphas, False, m.alpha_per_target)
        return m if type(m) is RidgeCV and all(x in (r2, pearsonr, spearmanr) for x in _several(self.metric)) else None

    def class_models(self, dealt: DataFrame, keys: list[str]) -> classes.ClassModels | None:
        """A ridge classifier's models of all folds by sums per class, if it is one of a single label and its sums fit the driver; and if the metrics are of such."""
        m, pairs = self.model, getattr(self.model, "method", "") == "OvO"
        if type(m) is not RidgeClassifier or m.normalise or any(x not in ((accuracy,) if pairs else (accuracy, roc_auc)) for x in _several(self.metric, accuracy)):
            return None
        rows = dealt.withColumn("__label", F.col("y")[0])
        if (dealt.agg(F.max(F.size("y"))).first()[0] or 0) != 1 or not classes.fits_driver(rows, [*keys, "repeat", "__own"], "__label", pairs):
            return None
        return classes.ClassModels(rows, keys, "__own", "__label", m.alphas, m.fit_intercept, m.alpha_per_target, m.method)

    def linear_margins(self, dealt: DataFrame, keys: list[str]) -> margins.LinearMargins | None:
        """Linear support vectors of all folds by sums, if a key has more trials than a kernel is made of in one task."""
        m = self.model
        if type(m) is not SVC or m.kernel != "linear" or m.method != "OvR" or any(x is not accuracy for x in _several(self.metric, accuracy)) or (dealt.agg(F.max(F.size("y"))).first()[0] or 0) != 1:
            return None
        sizes = dealt.groupBy(*keys, "repeat").agg(F.count("*").alias("n"), F.count_distinct("__own").alias("f"), F.count_distinct(F.col("y")[0]).alias("l"), F.max(F.size("x")).alias("p"))
        s = sizes.agg(F.max("n").alias("n"), F.sum(F.col("f") * F.col("l") * F.col("p") * F.col("p")).alias("sums")).first()
        if (s["n"] or 0) <= MOST_TRIALS or s["sums"] > margins.MOST_NUMBERS:
            return None
        return margins.LinearMargins(dealt.withColumn("__label", F.col("y")[0]), keys, "__own", "__label", m.C)

    def many_trials(self, dealt: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame] | None:
        """dealt's keys whose kernel is not made in one task, and the others; None if there are none, or if another model or metric is asked for."""
        m = self.model
        if type(m) is not KernelRidgeCV or callable(m.kernel) or not (np.asarray(m.alphas, float) > 0).all() or any(x not in (r2, pearsonr, spearmanr) for x in _several(self.metric)):
            return None
        by = [*keys, "repeat"]
        large = dealt.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > MOST_TRIALS).drop("__n").collect()  # a row for as many trials
        if not large:
            return None
        table = dealt.sparkSession.createDataFrame([tuple(r) for r in large], ", ".join(f"`__k{i}` {dealt.schema[c].dataType.simpleString()}" for i, c in enumerate(by)))
        on = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)])
        return dealt.join(F.broadcast(table), on, "left_semi"), dealt.join(F.broadcast(table), on, "left_anti")

    def scores(self, df: DataFrame, keys: list[str] = (), trial: str = "trial", masks: list | None = None, wanted=None) -> DataFrame:
        """(keys, [mask,] repeat, fold, metric, target, score). masks: feature masks to be fitted each. Ridge models whose sums fit the driver are validated by sums."""
        keys, (dealt, k) = list(keys), self._dealt(df, trial)
        task, metrics, model = ["mask", "repeat", "fold"] if masks is not None else ["repeat", "fold"], _several(self.metric), self.model
        schema = _kinds(df, keys) + ", ".join(f"{t} int" for t in task) + ", metric string, target int, score double"
        if (ridge := self._by_sums()) and gram.fits_driver(dealt, [*keys, "repeat", "__own"], len(masks or [0])):
            fitted = gram.FoldModels(dealt, keys, "__own", ridge, masks, wanted=wanted)
            found = fitted.scores([m.name for m in metrics if m is not spearmanr])
            out = df.sparkSession.createDataFrame([(*key, *((n,) if masks is not None else ()), *rest) for key, n, *rest in found], schema)
            if spearmanr not in metrics:
                return out
            by = [*keys, "mask", "repeat", "fold", "target"]
            ranks = M.grouped(fitted.predictions(), by, "y", "p", "spearmanr", "score").withColumn("metric", F.lit("spearmanr"))
            return out.unionByName(ranks.select(*out.columns))
        if masks is None and (found := self.class_models(dealt, keys)):
            return classes.scores(found.decide(dealt.withColumn("__label", F.col("y")[0]), trial), keys, [m.name for m in metrics])
        if masks is None and (linear := self.linear_margins(dealt, keys)):
            out = df.sparkSession.createDataFrame([(*key, *rest) for key, *rest in linear.accuracies()], schema)
            linear.remove()
            return out
        out = None
        if masks is None and (found := self.many_trials(dealt, keys)):
            out, dealt = df.sparkSession.createDataFrame(duals.scores(found[0], keys, self.model, [m.name for m in metrics], trial), schema), found[1]
        rows = dealt.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        if masks is not None:
            rows = rows.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))))
        chosen = [np.asarray(m, bool) for m in masks] if masks is not None else None

        def fit(key, trials, X, y, t):
            if chosen is not None:
                X = X[:, chosen[key[len(keys)]]]
            return [(*key, *s) for s in _fold(model, metrics, X, y, t.column("__own").to_numpy() == key[-1])[1]]

        rest = run_tasks(rows, [*keys, *task], fit, schema, trial)
        return rest if out is None else out.unionByName(rest)

    def fit(self, df: DataFrame, keys: list[str] = (), trial: str = "trial") -> "FittedValidator":
        """All fold models, with what tested them."""
        keys, (dealt, k) = list(keys), self._dealt(df, trial)
        names, model, metrics = [*keys, "repeat", "fold"], self.model, _several(self.metric)
        rows = dealt.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))

        def fit(key, trials, X, y, t):
            test = t.column("__own").to_numpy() == key[-1]
            m, found = _fold(model, metrics, X, y, test)
            return [(*key, cloudpickle.dumps(m), trials[test].tolist(), *map(list, zip(*found)))] if m else []

        kinds = _kinds(df, keys) + f"repeat int, fold int, model binary, test array<{df.schema[trial].dataType.simpleString()}>, metric array<string>, target array<int>, score array<double>"
        return FittedValidator(self, Models(run_tasks(rows, names, fit, kinds, trial), names, keys))


def _fold(model, metrics, X, y, test):
    """A fold's model and its scores; none where the fold has no trials."""
    if not test.any() or test.all():
        return None, []
    m = model.clone().fit(X[~test], y[~test])
    base = y[~test].mean(0)
    return m, list(_scored(m, [x.grant(y_b=base) if "y_b" in x.request else x for x in metrics], X[test], y[test]))


@dataclass
class FittedValidator:
    """What a validator has fitted: a model per key, repeat and fold."""

    validator: Validator
    models: Models

    def scores(self) -> DataFrame:
        """(keys, repeat, fold, metric, target, score) on the folds."""
        rows = self.models.table.select(*self.models.names, F.explode(F.arrays_zip("metric", "target", "score")).alias("e"))
        return rows.select(*self.models.names, "e.metric", "e.target", "e.score")

    def tests(self, trial: str = "trial") -> DataFrame:
        """(keys, repeat, fold, trial): the trials that tested each model."""
        return self.models.table.select(*self.models.names, F.explode("test").alias(trial))

    def call(self, method: str, df: DataFrame, trial: str = "trial", from_step: int | None = None) -> DataFrame:
        """(keys, repeat, fold, trial, value): the method of every fold's model, or of a step of it, on all rows."""
        return self.models.call(df, method, trial, from_step)

    def predict(self, df: DataFrame, trial: str = "trial", from_step: int | None = None) -> DataFrame:
        return self.call("predict", df, trial, from_step)

    def predict_proba(self, df: DataFrame, trial: str = "trial", from_step: int | None = None) -> DataFrame:
        return self.call("predict_proba", df, trial, from_step)

    def decision_function(self, df: DataFrame, trial: str = "trial", from_step: int | None = None) -> DataFrame:
        return self.call("decision_function", df, trial, from_step)

    def transform(self, df: DataFrame, trial: str = "trial", from_step: int | None = None) -> DataFrame:
        return self.call("transform", df, trial, from_step)

    def score(self, df: DataFrame, trial: str = "trial") -> DataFrame:
        """(keys, repeat, fold, metric, target, score) of every fold's model on other trials."""
        return self.models.score(df, _several(self.validator.metric), trial)

    def collect(self, attr, from_step: int | None = None) -> DataFrame:
        return self.models.collect(attr, from_step)


def cross_val_score(model, df: DataFrame, cv=5, metric=None, keys=(), trial: str = "trial", return_validator: bool = False):
    """Scores of each fold; with return_validator (fitted validator, scores)."""
    v = Validator(model, cv, metric)
    if not return_validator:
        return v.scores(df, keys, trial)
    fitted = v.fit(df, keys, trial)
    return fitted, fitted.scores()


def feature_sets(n_features: int, groups=None, on_underspecified: str = "raise"):
    """(sets, masks): all non-empty sets of predictor groups by size, and their feature masks; of equal masks the first stays."""
    g = np.eye(n_features, dtype=bool) if groups is None else np.asarray(groups, bool)
    if not g.any(0).all():
        if on_underspecified == "raise":
            raise ValueError("a predictor is in no group")
        if on_underspecified == "warn":
            import warnings

            warnings.warn("a predictor is in no group", stacklevel=2)
    sets, masks, seen = [], [], set()
    for k in range(1, len(g) + 1):
        for s in itertools.combinations(range(len(g)), k):
            m = g[list(s)].any(0)
            if m.tobytes() not in seen:
                seen.add(m.tobytes())
                sets.append(s)
                masks.append(m)
    return sets, masks


@dataclass
class Hierarchical:
    """Scores of every set of predictor groups."""

    validator: Validator
    on_underspecified: str = "raise"

    def scores(self, df: DataFrame, n_features: int, groups=None, keys=(), trial: str = "trial") -> tuple[list, DataFrame]:
        sets, masks = feature_sets(n_features, groups, self.on_underspecified)
        return sets, self.validator.scores(df, keys, trial, masks)


def hierarchical_score(model, df: DataFrame, n_features: int, groups=None, cv=5, metric=None, **kw):
    return Hierarchical(Validator(model, cv, metric)).scores(df, n_features, groups, **kw)


@dataclass
class Shapley:
    """Mean marginal gain of each group over random orders that start with group 0; each distinct set is fitted once. With shuffle, every order of groups
    has folds of its own, by an order of trials by chance; the sums of all orders are made in one pass, and an order's sets are fitted on its own folds."""

    validator: Validator
    n_permutations: int = 10
    seed: int = 0
    shuffle: bool = False

    def orders(self, groups) -> tuple[list, list]:
        """Steps (permutation, group, mask, mask before or -1) and the distinct masks."""
        g, rng, steps, masks = np.asarray(groups, bool), random.Random(self.seed), [], {}
        for p in range(self.n_permutations):
            order, last = [0, *rng.sample(range(1, len(g)), len(g) - 1)], -1
            for n in range(len(order)):
                m = g[order[: n + 1]].any(0)
                at = masks.setdefault(m.tobytes(), (len(masks), m))[0]
                steps.append((p, order[n], at, last))
                last = at
        return steps, [m for _, m in sorted(masks.values(), key=lambda v: v[0])]

    def scores(self, df: DataFrame, groups, keys=(), trial: str = "trial") -> DataFrame:
        """(permutation, group, keys, repeat, fold, metric, target, score): group 0 has the baseline's score, others what they add."""
        steps, masks = self.orders(groups)
        v = self.validator
        own = self.shuffle and isinstance(v.cv, int)
        if own:
            # a repeat for each order, of the sets that it steps through
            v, sets = replace(v, cv=RepeatedKFold(v.cv, self.n_permutations, self.seed)), {(p, n) for p, _, n, _ in steps}
            s = v.scores(df, keys, trial, masks, lambda repeat, n: (repeat, n) in sets)
        else:
            s = v.scores(df, keys, trial, masks)
        plan = F.broadcast(df.sparkSession.createDataFrame(steps, "permutation int, group int, mask int, before int"))  # permutations x groups rows
        same = [*keys, "repeat", "fold", "metric", "target"]
        prior = s.select(*same, F.col("mask").alias("before"), F.col("score").alias("__s"))
        stepped = s.join(plan, "mask")
        if own:
            stepped = stepped.where(F.col("repeat") == F.col("permutation"))
        out = stepped.join(prior, [*same, "before"], "left").select("permutation", "group", *same, (F.col("score") - F.coalesce("__s", F.lit(0.0))).alias("score"))
        return out.withColumn("repeat", F.lit(0)) if own else out


def shapley_score(model, df: DataFrame, groups, cv=5, metric=None, n_permutations: int = 10, **kw) -> DataFrame:
    return Shapley(Validator(model, cv, metric), n_permutations).scores(df, groups, **kw)

"""Ridge classifiers of all folds and class pairs from sums per class.

n, sums and products of x are additive over the trials of a class, and targets of +-1 follow from which classes a model is for. So one pass gives every model, one against
the rest or a pair, of every fold; a second adds up their leave-one-out errors, and a third has every trial decided by the models that have not seen it. No trial is gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import math as M
from .gram import MOST_FEATURES, MOST_NUMBERS, _blocks, _summed, moments, whole
from .local import couple, ridge_from_moments


def fits_driver(df: DataFrame, names: list[str], label: str, pairs: bool) -> bool:
    """Whether the sums of all keys, folds and classes, and the models made of them, are small enough for a driver."""
    p = df.agg(F.max(F.size("x"))).first()[0] or 0
    groups = df.select(*names, label).distinct().limit(MOST_NUMBERS).count()
    classes = df.select(label).distinct().limit(MOST_NUMBERS).count() if pairs else 2
    return p <= MOST_FEATURES and groups * p * p * (2 + classes / 2) <= MOST_NUMBERS


class ClassModels:
    """Models of each (keys, repeat, fold), fitted on the other folds: [(labels, coef (labels, features), intercept)], one for all labels or one for each pair of them."""

    def __init__(self, rows: DataFrame, keys: list[str], own: str, label: str, alphas, fit_intercept: bool, per_target: bool, method: str):
        self.sets, self.own, self.label, self.method = [*keys, "repeat"], own, label, method
        names, al = [*self.sets, own, label], np.atleast_1d(np.asarray(alphas, float))
        rows = whole(rows.where(F.col(label).isNotNull()), "x").withColumn("y", F.array(F.lit(1.0)))
        parts = {k: (m[0], m[1], m[3]) for k, m in moments(rows, names).items()}  # n, sum x, x'x
        by_class: dict = {}
        for k, m in parts.items():
            for at in (k[:-2], None), (k[:-2], k[-2]):
                own_ = by_class.setdefault(at, {})
                own_[k[-1]] = tuple(a + b for a, b in zip(own_[k[-1]], m)) if k[-1] in own_ else m
        self.tasks: list[tuple] = []
        for s, f in by_class:
            if f is None:
                continue
            held = by_class[s, f]
            train = {c: tuple(a - b for a, b in zip(m, held[c])) if c in held else m for c, m in by_class[s, None].items()}
            train = {c: m for c, m in sorted(train.items()) if m[0] > 0}
            labels = [*train]
            for own_ in [(a, b) for j, b in enumerate(labels) for a in labels[:j]] if method == "OvO" else [tuple(labels)] if labels else []:
                self.tasks.append((s, f, own_, self._targets(train, own_)))
        loss = self._losses(rows, al, fit_intercept) if len(al) > 1 else {}
        self.models: dict = {}
        for i, (s, f, labels, m) in enumerate(self.tasks):
            own_ = loss.get(i, np.zeros(len(al) * len(labels))).reshape(len(al), -1)
            coef, icpt, _ = ridge_from_moments(*m, al, own_, fit_intercept, per_target)
            self.models.setdefault((*s, f), []).append((labels, coef, np.broadcast_to(icpt, len(labels))))

    @staticmethod
    def _targets(train: dict, labels: tuple) -> tuple:
        """Sums of a model for some labels: y is +1 for its own and -1 for the others."""
        own = [train[c] for c in labels]
        n, sx, xx = (sum(m[i] for m in own) for i in range(3))
        return n, sx, np.array([2 * m[0] - n for m in own], float), xx, np.stack([2 * m[1] - sx for m in own], 1)

    def _losses(self, rows: DataFrame, al: np.ndarray, fit_intercept: bool) -> dict:
        solved, of = [], {}
        for i, (s, f, labels, (n, sx, sy, xx, xy)) in enumerate(self.tasks):
            mx, my = (sx / n, sy / n) if fit_intercept else (np.zeros_like(sx), np.zeros_like(sy))
            w, q = np.linalg.eigh(xx - n * np.outer(mx, mx))
            solved.append((n, mx, my, np.maximum(w, 0), q, q.T @ (xy - n * np.outer(mx, my)), f, labels))
            for c in labels:
                of.setdefault((*s, c), []).append(i)
        shared = rows.sparkSession.sparkContext.broadcast((of, solved))

        def errors(batches):
            (tasks, models), out = shared.value, {}
            for k, X, _ in _blocks(batches, [*self.sets, self.own, self.label]):
                for i in tasks.get((*k[:-2], k[-1]), ()):
                    n, mx, my, w, q, z, f, labels = models[i]
                    if f == k[-2]:
                        continue
                    A, B = (X - mx) @ q, np.where(np.array(labels) == k[-1], 1.0, -1.0) - my
                    own = out.setdefault(i, np.zeros((len(al), len(labels))))
                    for j, a in enumerate(al):
                        g = 1 / np.where(w + a > 0, w + a, np.inf)
                        with np.errstate(all="ignore"):
                            own[j] += (((B - A @ (g[:, None] * z)) / (1 - (1 / n if fit_intercept else 0) - (A * A) @ g)[:, None]) ** 2).sum(0)
            return out

        return _summed(rows, errors)

    def decide(self, rows: DataFrame, trial: str = "trial", proba: bool = False) -> DataFrame:
        """(keys, repeat, fold, trial, truth, labels, decision, predict): each trial by the models of its own fold. Votes of pairs, ties to the lowest label.

        decision has a number for each label (the votes, for pairs); with proba it has probabilities: sigmoids normalised over labels, or pairwise coupling.
        Trials of a fold that holds all of its key's have no models and no row.
        """
        label, names, pairs = self.label, [*self.sets, self.own], self.method == "OvO"
        rows = whole(rows.where(F.col(label).isNotNull()), "x").select(*names, trial, F.col(label).cast("double").alias("__c"), F.col("x").cast("array<double>").alias("x"))
        shared = rows.sparkSession.sparkContext.broadcast(self.models)
        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*names, trial))
        types = [to_arrow_type(rows.schema[c].dataType) for c in (*names, trial)]

        def work(batches):
            for b in batches:
                found = list(zip(*[b.column(c).to_pylist() for c in names]))
                for k in dict.fromkeys(found):
                    if k not in shared.value:
                        continue
                    at = np.array([z == k for z in found])
                    own = b.filter(pa.array(at))
                    X = own.column("x").flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
                    labels, score = (_paired if pairs else _rest)(shared.value[k], X, proba)
                    columns = [own.column(c).cast(t) for c, t in zip((*names, trial), types)]
                    ends = pa.array(np.arange(len(X) + 1, dtype=np.int32) * len(labels))
                    columns += [own.column("__c"), pa.ListArray.from_arrays(ends, pa.array(np.tile(labels, len(X)))), pa.ListArray.from_arrays(ends, pa.array(score.ravel())), pa.array(labels[score.argmax(1)])]
                    yield pa.RecordBatch.from_arrays(columns, [*names, trial, "truth", "labels", "decision", "predict"])

        out = rows.mapInArrow(work, kinds + ", truth double, labels array<double>, decision array<double>, predict double")
        return out.withColumnRenamed(self.own, "fold")


def _rest(models: list, X: np.ndarray, proba: bool) -> tuple[np.ndarray, np.ndarray]:
    labels, coef, icpt = models[0]
    score = X @ coef.T + icpt
    if proba:
        score = 1 / (1 + np.exp(-score))
        score = score / score.sum(1, keepdims=True)
    return np.array(labels, float), score


def _paired(models: list, X: np.ndarray, proba: bool) -> tuple[np.ndarray, np.ndarray]:
    labels = sorted({c for m in models for c in m[0]})
    at, votes, P = {c: i for i, c in enumerate(labels)}, np.zeros((len(X), len(labels))), np.zeros((len(X), len(labels), len(labels)))
    for own, coef, icpt in models:
        score, (a, b) = X @ coef.T + icpt, [at[c] for c in own]
        first = score.argmax(1) == 0
        votes[:, a] += first
        votes[:, b] += ~first
        P[:, a, b], P[:, b, a] = 1 / (1 + np.exp(-score[:, 0])), 1 / (1 + np.exp(-score[:, 1]))
    return np.array(labels, float), np.stack([couple(p) for p in P]) if proba else votes


def scores(decided: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, repeat, fold, metric, target, score) of decide(): accuracy, and roc_auc as the mean of each label against the rest, ranked over all folds at once."""
    by, out = [*keys, "repeat", "fold"], None
    for name in metrics:
        if name == "accuracy":
            own = decided.groupBy(*by).agg(F.avg((F.col("truth") == F.col("predict")).cast("double")).alias("score"))
        else:
            each = decided.select(*by, "truth", F.explode(F.arrays_zip("labels", "decision")).alias("e")).select(*by, "truth", F.col("e.labels").alias("label"), F.col("e.decision").alias("value"))
            own = M.roc_auc_one_vs_rest(each, by, "truth", "label", "value", "score")
        own = own.select(*by, F.lit(name).alias("metric"), F.lit(0).alias("target"), "score")
        out = own if out is None else out.unionByName(own)
    return out

"""Linear support vectors of many folds from sums: no trial is gathered, and no kernel is made.

The box-constrained dual of local.SVC, max sum a - |sum a l z|^2 / 2 with 0 <= a <= C, is followed along its log barrier. With weight m on the barrier a trial's a is a closed form of its
margin alone, so what is left is smooth in the weights w = sum a l z, and a Newton step needs sums of features, and of their products, over trials. m falls to almost nothing.
At the optimum l (1 - l w z) is zero wherever 0 < a < C, so decisions have no intercept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..steps import Steps
from .gram import _matrix, _summed, whole

#: Numbers that the sums of a step hold in each task; weight of the barrier at the end, in parts of C; steps at most.
MOST_NUMBERS, LAST, STEPS = 1 << 24, 1e-8, 400


def dual_of(g: np.ndarray, m: float, C: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What makes a g + m log a + m log(C - a) greatest, its slope in g, and that value less 2 m log C."""
    S = np.sqrt(g * g * C * C + 4 * m * m)
    # the distance to the nearer end, which a difference would lose
    near = 2 * m * C / (S + 2 * m + np.abs(g) * C)
    a = np.where(g < 0, near, C - near)
    return a, C * C * m / (S * (S + 2 * m)), a * g + m * (np.log(near / C) + np.log1p(-near / C))


class LinearMargins:
    """One-against-rest models of every fold: rows have keys, repeat, own (the fold that tests a row), x and label."""

    def __init__(self, rows: DataFrame, keys: list[str], own: str, label: str, C: float):
        self.steps, groups = Steps(rows.sparkSession, "margins"), [*keys, "repeat"]
        rows = whole(rows.where(F.col(label).isNotNull()).select(*groups, F.col(own).alias("__f"), F.col(label).alias("__l"), F.col("x").cast("array<double>").alias("x")), "x")
        self.rows, self.groups, self.C = self.steps.write(rows), groups, C
        counts = self.rows.groupBy(*groups, "__f", "__l").agg(F.count("*").alias("n")).collect()  # a row for each key, fold and label
        self.labels = sorted({r["__l"] for r in counts})
        by: dict = {}
        for r in counts:
            by.setdefault(tuple(r[k] for k in groups), {}).setdefault(r["__f"], {})[r["__l"]] = r["n"]
        self.systems = [(g, f) for g, folds in by.items() for f in sorted(folds) if len(folds) > 1]  # a fold that holds all has no model
        self.known = [np.array([any(l in by[g][o] for o in by[g] if o != f) for l in self.labels]) for g, f in self.systems]
        self.of: dict = {}
        for s, (g, _) in enumerate(self.systems):
            self.of.setdefault(g, []).append(s)
        if self.systems:
            self._scale()
            self._solve()

    def _sums(self, work, given) -> dict[int, np.ndarray]:
        """Sums of work(s, train, X, label numbers, given) -> {id: array}, over the blocks of every system's group."""
        of, systems, groups, number = self.of, self.systems, self.groups, {l: i for i, l in enumerate(self.labels)}
        sent = self.rows.sparkSession.sparkContext.broadcast(given)

        def each(batches):
            out: dict = {}
            for b in batches:
                if not b.num_rows:
                    continue
                X, fold, L = _matrix(b.column("x")), b.column("__f").to_numpy(), np.array([number[v] for v in b.column("__l").to_pylist()])
                found = list(zip(*[b.column(c).to_pylist() for c in groups]))
                for g in set(found):
                    at = np.array([k == g for k in found])
                    for s in of.get(g, ()):
                        for k, v in work(s, fold[at] != systems[s][1], X[at], L[at], sent.value).items():
                            out[k] = out[k] + v if k in out else v
            return out

        found = _summed(self.rows, each)
        sent.destroy()
        return found

    def _scale(self) -> None:
        first = np.array(self.rows.select("x").first()["x"])  # sums about a point of the data lose less

        def moments(s, train, X, L, first):
            Z = X[train] - first
            return {s: np.stack([np.full(Z.shape[1], len(Z)), Z.sum(0), (Z * Z).sum(0)])}

        self.mean, self.scale = [], []
        for _, v in sorted(self._sums(moments, first).items()):
            n, a, q = v.reshape(3, -1)
            with np.errstate(all="ignore"):
                s = np.sqrt(np.maximum(0, q - a * a / n) / (n - 1))
            self.mean.append(first + a / n)
            self.scale.append(np.where((s == 0) | ~np.isfinite(s), 1.0, s))

    def _solve(self) -> None:
        C, K, d, mean, scale = self.C, len(self.labels), len(self.mean[0]), self.mean, self.scale

        def step(s, train, X, L, given):
            Z, out = (X[train] - mean[s]) / scale[s], {}
            for c in range(K):
                if s * K + c in given:
                    w, m = given[s * K + c]
                    l = np.where(L[train] == c, 1.0, -1.0)
                    g = 1 - l * (Z @ w)
                    a, h, value = dual_of(g, m, C)
                    out[s * K + c] = np.concatenate([[value.sum()], -(l * a) @ Z, ((Z * h[:, None]).T @ Z).ravel()])
            return out

        W = np.zeros((len(self.systems) * K, d))
        state = {i: {"m": C, "t": 1.0, "d": np.zeros(d), "f": np.inf, "slope": 0.0} for i in range(len(W)) if self.known[i // K][i % K]}
        for _ in range(STEPS):
            asked = {i: (W[i] + s["t"] * s["d"], s["m"]) for i, s in state.items()}
            for i, v in self._sums(step, asked).items():
                s, w = state[i], asked[i][0]
                f, g, H = v[0] + w @ w / 2, v[1 : d + 1] + w, v[d + 1 :].reshape(d, d) + np.eye(d)
                if f > s["f"] + 1e-4 * s["t"] * s["slope"] + 1e-12 * abs(f) and s["t"] > 1e-12:
                    s["t"] /= 4
                    continue
                W[i] = w
                s["d"] = -np.linalg.solve(H, g)
                s["t"], s["f"], s["slope"] = 1.0, f, g @ s["d"]
                end = s["m"] <= LAST * C
                if -s["slope"] <= (max(1e-12 * (1 + abs(f)), 1e-3 * s["m"]) if end else 0.25 * s["m"]):
                    if end:
                        del state[i]
                    else:
                        s["m"], s["f"] = max(s["m"] / 10, LAST * C), np.inf
            if not state:
                break
        else:
            raise RuntimeError(f"not settled after {STEPS} steps")
        self.W = W.reshape(len(self.systems), K, d)

    def accuracies(self) -> list[tuple]:
        """[(key, repeat, fold, 'accuracy', 0, score)] on the folds."""
        if not self.systems:
            return []

        def right(s, train, X, L, given):
            if train.all():
                return {}
            W, mean, scale, known = given
            D = np.where(known[s], ((X[~train] - mean[s]) / scale[s]) @ W[s].T, -np.inf)
            return {s: np.array([len(D), (D.argmax(1) == L[~train]).sum()], float)}

        found = self._sums(right, (self.W, self.mean, self.scale, self.known))
        return [(g[:-1], g[-1], f, "accuracy", 0, float(found[s][1] / found[s][0])) for s, (g, f) in enumerate(self.systems)]

    def remove(self) -> None:
        self.steps.remove()

"""Cross-validated kernel ridge of keys with more trials than a kernel is made of in one task.

All keys go together. Trials are packed into blocks of one key and fold; what iterates is a row a block, with columns for each fold, alpha and target. A product with the kernel is made by pairs of
chunks of blocks, whose kernel is made anew and never stored: memory does not grow with a key, the work does with its square.

Dual coefficients come from conjugate gradients on the kernel itself. What the kernel says beyond a few landmarks (Nystroem) is small, so landmarks precondition them, and give the diagonals of the inverses
that leave-one-out errors divide by. These alone are approximate, and only choose alpha: some trials' places are solved for exactly beside the targets, and their deviations
tell how far errors may be off. Where that leaves the choice open, more landmarks are taken, and at last the inverses are made by sweeps (tiles.KernelRidge).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import math as M
from ..steps import Steps
from . import tiles
from .gram import _matrix, whole
from .local import KernelRidgeCV, checked
from .local import gram as kernel_of

#: Rows of a block; blocks of a chunk, and bytes it holds; landmarks, by attempt; trials of a fold whose place is solved for exactly; how many times their deviation an error may be off.
TILE, BLOCKS, HELD, RANKS, EXACT, SAFE = 1024, 16, 48 << 20, (1024, 2048), 6, 3.0


class Unsettled(Exception):
    """Conjugate gradients did not end."""


def positive(m: KernelRidgeCV) -> bool:
    """Whether the kernel has no negative eigenvalue, whatever the trials, and no alpha is zero."""
    by_name = m.kernel in ("linear", "rbf") or m.kernel == "poly" and m.coef0 >= 0 and m.degree >= 0 and float(m.degree).is_integer()
    return by_name and (m.gamma in ("scale", "auto") or float(m.gamma) > 0) and bool((np.asarray(m.alphas, float) > 0).all())


def _rows(table):
    """Rows of a table or batch as dictionaries; bytes are not copied."""
    table = table.combine_chunks() if isinstance(table, pa.Table) else table
    columns = [(c, table.column(c)) for c in table.schema.names]
    for i in range(table.num_rows):
        yield {c: (v[i].as_buffer() if pa.types.is_binary(v.type) else v[i].as_py()) for c, v in columns}


def _array(raw, *shape) -> np.ndarray:
    return np.frombuffer(raw).reshape(shape)


def _bytes(a) -> bytes:
    return np.ascontiguousarray(a, float).tobytes()


def _mapped(df: DataFrame, work, schema: str) -> DataFrame:
    """work(row) -> dictionary, of each row."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for b in batches:
            for r in _rows(b):
                yield pa.RecordBatch.from_pylist([work(r)], arrow)

    return df.mapInArrow(run, schema)


def _added(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """(by, name): the sum of arrays in bytes, added up in each task first."""
    schema = "".join(f"{c} int, " for c in by) + f"{name} binary"

    def give(sums):
        return pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in sums], pa.int32()) for i in range(len(by))], pa.array([s.tobytes() for s in sums.values()], pa.binary())], [*by, name])

    def part(batches):
        sums, held = {}, 0
        for b in batches:
            for r in _rows(b):
                k, v = tuple(r[c] for c in by), np.frombuffer(r[name])
                if k in sums:
                    sums[k] += v
                else:
                    sums[k], held = v.copy(), held + v.nbytes
                if held > HELD:
                    yield give(sums)
                    sums, held = {}, 0
        if sums:
            yield give(sums)

    def add(t: pa.Table) -> pa.Table:
        total = 0
        for r in _rows(t.select([name])):
            total = total + np.frombuffer(r[name])
        return pa.table([*[t.column(c).slice(0, 1) for c in by], pa.array([total.tobytes()], pa.binary())], [*by, name])

    return df.select(*by, name).mapInArrow(part, schema).groupBy(*by).applyInArrow(add, schema)


class DualRidge:
    """Models of all folds of the groups in dealt (g, own, trial, x, y); counts is {(g, own): trials}."""

    def __init__(self, dealt: DataFrame, counts: dict[tuple[int, int], int], model: KernelRidgeCV, trial: str = "trial", most: int = 200, tol: float = 1e-10, seed: int = 0):
        self.spark, self.steps, self.model, self.most, self.tol, self.seed = dealt.sparkSession, Steps(dealt.sparkSession, "duals"), model, most, tol, seed
        self.alphas = np.atleast_1d(np.asarray(model.alphas, float))
        folds = {g: sorted(o for h, o in counts if h == g) for g in {g for g, _ in counts}}
        sizes = dealt.agg(F.max(F.size("x")).alias("p"), F.max(F.size("y")).alias("d")).first()
        p, self.d = max(sizes["p"] or 1, 1), sizes["d"] or 1
        width = max(len(f) for f in folds.values()) * len(self.alphas) * (self.d + EXACT)
        per = max(1, min(BLOCKS, HELD // (8 * TILE * (p + 2 * width))))
        parts, at = [], 0
        for g in sorted(folds):
            first, blocks = at, {o: -(-counts[g, o] // TILE) for o in folds[g]}
            chunks = -(-sum(blocks.values()) // per)
            for o in folds[g]:
                parts.append((g, o, at, blocks[o], first, chunks))
                at += blocks[o]
        names = self.spark.createDataFrame(parts, "g int, own int, at int, blocks int, first int, chunks int")
        rows = dealt.join(F.broadcast(names), ["g", "own"]).withColumn("block", (F.col("at") + F.pmod(F.xxhash64(trial), F.col("blocks"))).cast("int"))
        rows = rows.withColumn("chunk", F.floor((F.col("block") - F.col("first")) / per).cast("int"))

        def pack(t: pa.Table) -> pa.Table:
            t = t.sort_by("trial")
            X, Y = checked(_matrix(t.column("x")), _matrix(t.column("y")))
            one = {c: t.column(c).slice(0, 1) for c in ("g", "own", "block", "chunk", "chunks")}
            told = [[len(X)], [float(X.mean())], [float(X.var())], [Y.sum(0).tolist()], [_bytes(X)], [_bytes(Y)]]
            return pa.table([*one.values(), *[pa.array(v, k) for v, k in zip(told, (pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.binary(), pa.binary()))]], [*one, "n", "mean", "spread", "sum", "xs", "ys"])

        kind = "g int, own int, block int, chunk int, chunks int, n int, mean double, spread double, sum array<double>, xs binary, ys binary"
        packed = rows.select("g", "own", "block", "chunk", "chunks", F.col(trial).alias("trial"), *[F.col(c).cast("array<double>").alias(c) for c in "xy"])
        self.blocks = self.steps.write(packed.groupBy("block").applyInArrow(pack, kind))
        told = self.blocks.select("g", "own", "block", "chunks", "n", "mean", "spread", "sum").collect()  # a few numbers a block
        self.sizes = {r["block"]: r["n"] for r in told}
        self.info = {g: self._about(g, f, [r for r in told if r["g"] == g], p) for g, f in folds.items()}

    def _about(self, g: int, folds: list[int], told: list, p: int) -> dict:
        """A group's folds, and of each its gamma, its mean of y, its number of trials and those (block, row) that are solved for exactly."""
        gammas, bases, counts, picks = [], [], [], []
        for i, f in enumerate(folds):
            own = sorted((r for r in told if r["own"] != f), key=lambda r: r["block"])
            n = np.array([r["n"] for r in own])
            mean = np.array([r["mean"] for r in own])
            spread = np.array([r["spread"] for r in own])
            centre = (n * mean).sum() / n.sum()
            var = (n * (spread + (mean - centre) ** 2)).sum() / n.sum()
            gammas.append(1 / (p * max(var, 1e-12)) if self.model.gamma == "scale" else 1 / p if self.model.gamma == "auto" else float(self.model.gamma))
            bases.append(sum(np.array(r["sum"]) for r in own) / n.sum())
            counts.append(int(n.sum()))
            ends = n.cumsum()
            chosen = np.random.default_rng([self.seed, g, i]).choice(counts[-1], min(EXACT, counts[-1]), replace=False)
            at = np.searchsorted(ends, chosen, side="right")
            picks.append([(own[b]["block"], int(c - ends[b] + n[b])) for b, c in zip(at, chosen)])
        return {"folds": folds, "chunks": max(r["chunks"] for r in told), "gammas": np.array(gammas), "bases": np.array(bases), "counts": counts, "picks": picks}

    def product(self, v: DataFrame) -> DataFrame:
        """(block, product binary): the kernel times v (g, block, chunk, chunks, xs, v binary), whose columns are by fold first."""
        info, sizes, kernel = self.info, self.sizes, _Kernel(self.model.kernel, self.model.coef0, self.model.degree)
        rows = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        rows = rows.select("g", F.least("chunk", "other").alias("ca"), F.greatest("chunk", "other").alias("cb"), "chunk", "block", "xs", "v")

        def work(key, t):
            g, ca, cb = (k.as_py() for k in key)
            own = info[g]
            F_ = len(own["folds"])
            held = [(r["chunk"], r["block"], _array(r["xs"], sizes[r["block"]], -1), _array(r["v"], sizes[r["block"]], F_, -1)) for r in _rows(t)]
            sums = {b: np.zeros_like(w) for _, b, _, w in held}
            for c, a, xa, va in held:
                for e, b, xb, vb in held:
                    if (a > b if ca == cb else (c, e) != (ca, cb)):
                        continue
                    for gamma in np.unique(own["gammas"]):
                        at = own["gammas"] == gamma
                        K = kernel(xa, xb, gamma)
                        sums[a][:, at] += (K @ vb[:, at].reshape(len(xb), -1)).reshape(len(xa), at.sum(), -1)
                        if a != b:
                            sums[b][:, at] += (K.T @ va[:, at].reshape(len(xa), -1)).reshape(len(xb), at.sum(), -1)
            return pa.table({"block": pa.array([*sums], pa.int32()), "product": pa.array([s.tobytes() for s in sums.values()], pa.binary())})

        return _added(rows.groupBy("g", "ca", "cb").applyInArrow(work, "block int, product binary"), ["block"], "product")

    def landmarks(self, rank: int) -> DataFrame:
        """(g, l binary): trials of each group, about rank of them, from all of its blocks."""
        info, seed = self.info, self.seed
        counts = {g: sum(i["counts"]) // max(len(i["folds"]) - 1, 1) for g, i in info.items()}

        def some(r):
            X = _array(r["xs"], r["n"], -1)
            take = min(r["n"], -(-rank * r["n"] // counts[r["g"]]))
            return {"g": r["g"], "block": r["block"], "l": _bytes(X[np.random.default_rng([seed, r["block"], rank]).choice(r["n"], take, replace=False)])}

        def gather(t: pa.Table) -> pa.Table:
            t = t.sort_by("block")
            return pa.table([t.column("g").slice(0, 1), pa.array([b"".join(t.column("l").to_pylist())], pa.binary())], ["g", "l"])

        return self.steps.write(_mapped(self.blocks.select("g", "block", "n", "xs"), some, "g int, block int, l binary").groupBy("g").applyInArrow(gather, "g int, l binary"))

    def _beside(self, rows: DataFrame, marks: DataFrame, rank: int) -> DataFrame:
        near = F.broadcast if len(self.info) * rank * 8 * 64 <= tiles.SENT else lambda d: d
        return rows.join(near(marks), "g")

    def factors(self, marks: DataFrame, rank: int, wanted: dict[int, list[int]]) -> DataFrame:
        """(g, f, h, eig, rest): with k a trial's kernel with the landmarks, the kernel of fold f's trials is about k'h h'k, whose eigenvalues are eig; rest is the mean of what the diagonal lacks."""
        info, kernel = self.info, _Kernel(self.model.kernel, self.model.coef0, self.model.degree)
        rows = self._beside(self.blocks.where(F.col("g").isin([*wanted])).select("g", "own", "chunk", "n", "xs"), marks, rank)

        def products(key, t):
            g, own, _ = (k.as_py() for k in key)
            gammas, L, sums, trace = np.unique(info[g]["gammas"]), None, None, None
            for r in _rows(t):
                X = _array(r["xs"], r["n"], -1)
                L = _array(r["l"], -1, X.shape[1])
                if sums is None:
                    sums, trace = np.zeros((len(gammas), len(L), len(L))), np.zeros(len(gammas))
                for j, gamma in enumerate(gammas):
                    k = kernel(L, X, gamma)
                    sums[j] += k @ k.T
                    trace[j] += kernel.diagonal(X, gamma).sum()
            return pa.table({"g": pa.array([g], pa.int32()), "own": pa.array([own], pa.int32()), "s": pa.array([_bytes(np.r_[trace, sums.ravel()])], pa.binary())})

        sums = self.steps.write(_added(rows.groupBy("g", "own", "chunk").applyInArrow(products, "g int, own int, s binary"), ["g", "own"], "s"))
        asked = self.spark.createDataFrame([(g, info[g]["folds"].index(f), o) for g, fs in wanted.items() for f in fs for o in info[g]["folds"] if o != f], "g int, f int, own int")
        folds = self.spark.createDataFrame([(g, info[g]["folds"].index(f)) for g, fs in wanted.items() for f in fs], "g int, f int")
        each = sums.join(F.broadcast(asked), ["g", "own"])
        each = each.groupBy("g", "f").cogroup(marks.join(F.broadcast(folds), "g").groupBy("g", "f"))

        def factor(key, left, right):
            g, f = (k.as_py() for k in key)
            gammas, gamma = np.unique(info[g]["gammas"]), info[g]["gammas"][f]
            total = 0
            for r in _rows(left.select(["s"])):
                total = total + np.frombuffer(r["s"])
            j, rank_ = int(np.searchsorted(gammas, gamma)), int(round(np.sqrt((len(total) - len(gammas)) / len(gammas))))
            S = total[len(gammas) :].reshape(len(gammas), rank_, rank_)[j]
            L = _array(next(_rows(right))["l"], rank_, -1)
            w, q = np.linalg.eigh(kernel(L, L, gamma))
            on = w > w[-1] * rank_ * 1e-15
            W = q[:, on] / np.sqrt(w[on])
            eig, V = np.linalg.eigh(W.T @ S @ W)
            eig = np.maximum(eig, 0)
            rest = max(0.0, (total[j] - eig.sum()) / info[g]["counts"][f])
            return pa.table({"g": pa.array([g], pa.int32()), "f": pa.array([f], pa.int32()), "h": pa.array([_bytes(W @ V)], pa.binary()), "eig": pa.array([_bytes(eig)], pa.binary()), "rest": pa.array([rest])})

        out = self.steps.write(each.applyInArrow(factor, "g int, f int, h binary, eig binary, rest double"))
        self.steps.drop(sums)
        return out

    def solve(self, marks: DataFrame, factors: DataFrame, rank: int) -> DataFrame:
        """(block, x binary) with columns (fold, alpha, targets and unit vectors): (K + alpha I) x = y over a fold's training trials, by preconditioned conjugate gradients, for all at once."""
        info, sizes, al, d, kernel = self.info, self.sizes, self.alphas, self.d, _Kernel(self.model.kernel, self.model.coef0, self.model.degree)
        S, rests = len(al), {}
        for r in factors.select("g", "f", "rest").collect():
            rests[r["g"], r["f"]] = r["rest"]
        arrays, named = ["x", "r", "u", "p", "s"], ["g", "own", "block", "chunk", "chunks"]

        def kept(r, *more):
            return {c: r[c] for c in named} | {c: r[c].to_pybytes() for c in ("xs", *more)}

        kinds = "g int, own int, block int, chunk int, chunks int, xs binary, " + ", ".join(f"{c} binary" for c in arrays)

        def shaped(g, raw, n):
            return _array(raw, n, len(info[g]["folds"]), S, d + EXACT)

        def first(r):
            own, n, y = info[r["g"]], r["n"], _array(r["ys"], r["n"], d)
            R = np.zeros((n, len(own["folds"]), S, d + EXACT))
            for f, o in enumerate(own["folds"]):
                if o != r["own"]:
                    R[:, f, :, :d] = y[:, None]
                    for j, (b, i) in enumerate(own["picks"][f]):
                        if b == r["block"]:
                            R[i, f, :, d + j] = 1
            zero = _bytes(np.zeros_like(R))
            return kept(r) | {c: zero for c in [*arrays, "w"]} | {"r": _bytes(R)}

        state = self.steps.write(_mapped(self.blocks.select(*named, "n", "xs", "ys"), first, kinds + ", w binary"))
        given, past, start, whole_kind = None, {}, None, kinds + ", w binary, uw array<double>"
        arrow = to_arrow_schema(_parse_datatype_string(whole_kind))
        for _ in range(self.most):

            def update(r, given=given):
                n, g = sizes[r["block"]], r["g"]
                a = {c: shaped(g, r[c], n) for c in [*arrays, "w"]}
                if given:
                    step, back = given[g]
                    a["p"], a["s"] = a["u"] + back * a["p"], a["w"] + back * a["s"]
                    a["x"], a["r"] = a["x"] + step * a["p"], a["r"] - step * a["s"]
                X = _array(r["xs"], n, -1)
                L, R = _array(r["l"], -1, X.shape[1]), a["r"]
                kr = np.zeros((len(L), *R.shape[1:]))
                for gamma in np.unique(info[g]["gammas"]):
                    at = info[g]["gammas"] == gamma
                    kr[:, at] = (kernel(L, X, gamma) @ R[:, at].reshape(n, -1)).reshape(len(L), at.sum(), *R.shape[2:])
                return kept(r) | {"kr": _bytes(kr)} | {c: _bytes(a[c]) for c in ("x", "r", "p", "s")}

            moved = self.steps.write(_mapped(self._beside(state, marks, rank), update, "g int, own int, block int, chunk int, chunks int, xs binary, kr binary, x binary, r binary, p binary, s binary"))

            def within(key, left, right):
                g = key[0].as_py()
                F_ = len(info[g]["folds"])
                kr = _array(next(_rows(left))["kr"], -1, F_, S, d + EXACT)
                t = np.zeros_like(kr)
                for r in _rows(right):
                    H = _array(r["h"], len(kr), -1)
                    inner = (H.T @ kr[:, r["f"]].reshape(len(kr), -1)).reshape(-1, S, d + EXACT)
                    inner = inner / (_array(r["eig"], -1)[:, None] + al + r["rest"])[:, :, None]
                    t[:, r["f"]] = (H @ inner.reshape(len(inner), -1)).reshape(len(kr), S, -1)
                return pa.table({"g": pa.array([g], pa.int32()), "t": pa.array([_bytes(t)], pa.binary())})

            inner = self.steps.write(_added(moved, ["g"], "kr").groupBy("g").cogroup(factors.groupBy("g")).applyInArrow(within, "g int, t binary"))

            def precondition(r):
                n, g = sizes[r["block"]], r["g"]
                X, R = _array(r["xs"], n, -1), shaped(g, r["r"], n)
                L = _array(r["l"], -1, X.shape[1])
                t, u = _array(r["t"], len(L), *R.shape[1:]), np.zeros_like(R)
                for gamma in np.unique(info[g]["gammas"]):
                    at = info[g]["gammas"] == gamma
                    u[:, at] = (kernel(X, L, gamma) @ t[:, at].reshape(len(L), -1)).reshape(n, at.sum(), *R.shape[2:])
                shift = np.array([[rests[g, f]] for f in range(len(info[g]["folds"]))]) + al
                u = (R - u) / shift[:, :, None]
                u[:, info[g]["folds"].index(r["own"])] = 0
                return {"u": _bytes(u), "rr": (R * R).sum(0).ravel().tolist(), "ru": (R * u).sum(0).ravel().tolist()} | kept(r, "x", "r", "p", "s")

            rows = self._beside(moved.drop("kr"), marks, rank).join(F.broadcast(inner) if len(info) * rank * 8 * S * (d + EXACT) * 4 <= tiles.SENT else inner, "g")
            ready = self.steps.write(_mapped(rows, precondition, kinds + ", rr array<double>, ru array<double>"))
            rr, ru = self._sums(ready, "rr"), self._sums(ready, "ru")
            self.steps.drop(inner)
            self.steps.drop(moved)
            self.steps.drop(state)
            start = start or rr
            live = {g: rr[g] > self.tol**2 * start[g] for g in rr}
            if not any(v.any() for v in live.values()):
                return ready.select("block", "x")

            def multiply(left, right):
                r = next(_rows(right))
                n, g = sizes[r["block"]], r["g"]
                w = shaped(g, next(_rows(left))["product"], n).copy()
                w[:, info[g]["folds"].index(r["own"])] = 0
                u = shaped(g, r["u"], n)
                w += al[:, None] * u
                return pa.Table.from_pylist([kept(r, *arrays) | {"w": w.tobytes(), "uw": (u * w).sum(0).ravel().tolist()}], arrow)

            parts = self.product(ready.select("g", "block", "chunk", "chunks", "xs", F.col("u").alias("v")))
            state = self.steps.write(parts.groupBy("block").cogroup(ready.drop("rr", "ru").groupBy("block")).applyInArrow(multiply, whole_kind))
            self.steps.drop(ready)
            uw, given = self._sums(state, "uw"), {}
            with np.errstate(all="ignore"):
                for g in uw:
                    back = np.where(live[g], ru[g] / past[g][0], 0.0) if g in past else np.zeros_like(ru[g])
                    step = ru[g] / (uw[g] - (back * ru[g] / past[g][1] if g in past else 0))
                    step = np.where(live[g] & np.isfinite(step), step, 0.0)
                    past[g] = ru[g], np.where(step == 0, np.inf, step)
                    given[g] = step, np.where(np.isfinite(back), back, 0.0)
        raise Unsettled(f"conjugate gradients did not end in {self.most} steps")

    def _sums(self, df: DataFrame, name: str) -> dict[int, np.ndarray]:
        """{group: sums (folds, alphas, columns)} of numbers that blocks tell."""
        out = {}
        for r in df.select("g", name).toArrow().to_pylist():
            v = np.array(r[name]).reshape(-1, len(self.alphas), self.d + EXACT)
            out[r["g"]] = out[r["g"]] + v if r["g"] in out else v
        return out

    def errors(self, solved: DataFrame, marks: DataFrame, factors: DataFrame, rank: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """{(group, place of fold): (sums of squared leave-one-out errors (alphas, targets), deviations (exact trials, alphas))}."""
        info, sizes, al, d, kernel = self.info, self.sizes, self.alphas, self.d, _Kernel(self.model.kernel, self.model.coef0, self.model.degree)
        S = len(al)
        left = self.blocks.select("g", "own", "block", "chunk", "chunks", "xs").join(solved, "block")
        asked = [(g, f, o) for g, i in info.items() for f, own in enumerate(i["folds"]) for o in i["folds"] if o != own]
        left = left.join(F.broadcast(self.spark.createDataFrame(asked, "g int, f int, own int")), ["g", "own"])
        chunks = self.spark.createDataFrame([(g, c) for g, i in info.items() for c in range(i["chunks"])], "g int, chunk int")
        right = factors.join(marks, "g").join(F.broadcast(chunks), "g")

        def work(key, a, b):
            g, f, _ = (k.as_py() for k in key)
            found = next(_rows(b), None)
            loss, far = np.zeros((S, d)), []
            if found is None or not a.num_rows:
                return pa.table({"g": pa.array([], pa.int32()), "f": pa.array([], pa.int32()), "loss": pa.array([], pa.list_(pa.float64())), "far": pa.array([], pa.list_(pa.float64()))})
            eig, shift, gamma = _array(found["eig"], -1), al + found["rest"], info[g]["gammas"][f]
            H = _array(found["h"], -1, len(eig))
            for r in _rows(a):
                n = sizes[r["block"]]
                X, x = _array(r["xs"], n, -1), _array(r["x"], n, len(info[g]["folds"]), S, d + EXACT)[:, f]
                u = kernel(X, _array(found["l"], len(H), -1), gamma) @ H
                place = (1 - (u * u) @ (1 / (eig[:, None] + shift))) / shift
                # a trial's own place in the diagonal lacks more or less than the mean
                place = 1 / (1 / place + (kernel.diagonal(X, gamma) - (u * u).sum(1) - found["rest"])[:, None])
                loss += ((x[:, :, :d] / place[:, :, None]) ** 2).sum(0)
                for j, (at, i) in enumerate(info[g]["picks"][f]):
                    if at == r["block"]:
                        far += (x[i, :, d + j] / place[i] - 1).tolist()
            return pa.table({"g": pa.array([g], pa.int32()), "f": pa.array([f], pa.int32()), "loss": pa.array([loss.ravel().tolist()], pa.list_(pa.float64())), "far": pa.array([far], pa.list_(pa.float64()))})

        out = {}
        for r in left.groupBy("g", "f", "chunk").cogroup(right.groupBy("g", "f", "chunk")).applyInArrow(work, "g int, f int, loss array<double>, far array<double>").toArrow().to_pylist():
            loss, far = out.get((r["g"], r["f"]), (0.0, np.zeros((0, S))))
            out[r["g"], r["f"]] = loss + np.array(r["loss"]).reshape(S, d), np.concatenate([far, np.array(r["far"]).reshape(-1, S)])
        return out

    def _pick(self, loss: np.ndarray, far: np.ndarray) -> np.ndarray | None:
        """The alpha of each target, by its place; None if errors may be so far off that another would be least."""
        if len(self.alphas) == 1:
            return np.zeros(self.d, int)
        if not np.isfinite(loss).all() or not np.isfinite(far).all():
            return None
        each, off = loss / (1 + far.mean(0))[:, None] ** 2, 2 * SAFE * np.abs(far - far.mean(0)).max(0) + 1e-12
        each = each if self.model.alpha_per_target else each.mean(1, keepdims=True)
        pick = each.argmin(0)
        most = each[pick, range(len(pick))] * (1 + off[pick])
        clear = each * (1 - off[:, None]) > most
        clear[pick, range(len(pick))] = True
        return np.broadcast_to(pick, self.d) if clear.all() else None

    def run(self) -> tuple[DataFrame, dict[tuple[int, int], np.ndarray]]:
        """(g, fold, target, y, p, b) of test trials, b the mean of y over a fold's training trials; and the alphas {(g, fold): by target}. Folds whose alpha stays open are missing in both."""
        info, picks, rank = self.info, {}, RANKS[0]
        marks = self.landmarks(rank)
        factors = self.factors(marks, rank, {g: i["folds"] for g, i in info.items()})
        solved = self.steps.write(self.solve(marks, factors, rank))
        for i, rank in enumerate(RANKS):
            if i:
                wanted = {g: left for g, own in info.items() if (left := [f for f in own["folds"] if (g, f) not in picks])}
                if not wanted:
                    break
                marks = self.landmarks(rank)
                factors = self.factors(marks, rank, wanted)
            for (g, f), (loss, far) in self.errors(solved, marks, factors, rank).items():
                if (found := self._pick(loss, far)) is not None:
                    picks[g, info[g]["folds"][f]] = found
        return self._answers(solved, picks), {k: self.alphas[v] for k, v in picks.items()}

    def _answers(self, solved: DataFrame, picks: dict) -> DataFrame:
        info, sizes, S, d, al = self.info, self.sizes, len(self.alphas), self.d, self.alphas
        taken = {g: np.array([picks.get((g, f), np.zeros(d, int)) for f in i["folds"]]) for g, i in info.items()}

        def chosen(r):
            x = _array(r["x"], sizes[r["block"]], len(info[r["g"]]["folds"]), S, d + EXACT)[..., :d]
            return {"block": r["block"], "v": _bytes(np.take_along_axis(x, taken[r["g"]][None, :, None, :], 2)[:, :, 0])}

        v = self.steps.write(_mapped(solved.join(self.blocks.select("block", "g"), "block"), chosen, "block int, v binary"))
        rows = self.product(self.blocks.select("g", "block", "chunk", "chunks", "xs").join(v, "block")).join(self.blocks.select("g", "own", "block", "ys"), "block").join(v, "block")

        def answer(r):
            n, own = sizes[r["block"]], info[r["g"]]
            p, y, at = _array(r["product"], n, -1, d), _array(r["ys"], n, d), own["folds"].index(r["own"])
            miss = p + al[taken[r["g"]]] * _array(r["v"], n, -1, d) - y[:, None]
            miss[:, at] = 0
            return {"g": r["g"], "own": r["own"], "y": y.tolist(), "p": p[:, at].tolist(), "b": own["bases"][at].tolist(), "miss": float((miss**2).sum()), "all": float((y**2).sum() * (len(own["folds"]) - 1))}

        found = self.steps.write(_mapped(rows, answer, "g int, own int, y array<array<double>>, p array<array<double>>, b array<double>, miss double, all double"))
        worst = found.groupBy("g").agg((F.sum("miss") > 1e-14 * F.sum("all")).alias("far")).where("far").count()
        if worst:
            raise Unsettled("dual coefficients do not solve their equations")
        each = found.select("g", F.col("own").alias("fold"), "b", F.explode(F.arrays_zip("y", "p")).alias("e"))
        return each.select("g", "fold", F.posexplode(F.arrays_zip(F.col("e.y").alias("y"), F.col("e.p").alias("p"), F.col("b").alias("b"))).alias("target", "e")).select("g", "fold", "target", "e.y", "e.p", "e.b")

    def remove(self) -> None:
        self.steps.remove()


class _Kernel:
    """A kernel without its gamma, as tasks take it along."""

    def __init__(self, kind, coef0: float, degree: float):
        self.own = kind, coef0, degree

    def __call__(self, a, b, gamma):
        return kernel_of(self.own[0], a, b, gamma, *self.own[1:])

    def diagonal(self, a, gamma):
        kind, coef0, degree = self.own
        s = (a * a).sum(1)
        return np.ones(len(a)) if kind == "rbf" else (coef0 + gamma * s) ** degree if kind == "poly" else s


def scores(dealt: DataFrame, keys: list[str], model: KernelRidgeCV, metrics: list[str], trial: str = "trial") -> list[tuple]:
    """(keys, repeat, fold, metric, target, score) of kernel ridge on every fold of dealt (keys, repeat, __own, trial, x, y), each of whose keys has many trials."""
    named = [*keys, "repeat"]
    by = [f"__k{i}" for i in range(len(named))]
    rows = whole(dealt.select(*[F.col(c).alias(k) for c, k in zip(named, by)], F.col("__own").cast("int").alias("own"), F.col(trial).alias("trial"), "x", "y"), "x", "y")
    found = rows.groupBy(*by, "own").agg(F.count("*").alias("n")).collect()  # a number a key and fold
    order = {k: g for g, k in enumerate(dict.fromkeys(tuple(r[c] for c in by) for r in found))}
    counts = {(order[tuple(r[c] for c in by)], r["own"]): r["n"] for r in found}
    several = {g for g in order.values() if sum(h == g for h, _ in counts) > 1}
    counts = {k: n for k, n in counts.items() if k[0] in several}
    if not counts:
        return []
    names = {g: k for k, g in order.items()}
    table = dealt.sparkSession.createDataFrame([(*k, g) for k, g in order.items() if g in several], ", ".join(f"__g{k} {rows.schema[k].dataType.simpleString()}" for k in by) + ", g int")
    rows = rows.join(F.broadcast(table), functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__g{k}")) for k in by])).select("g", "own", "trial", "x", "y")
    out, known = [], {}

    def told(answers):
        for m in metrics:
            for r in M.grouped(answers, ["g", "fold", "target"], "y", "p", m, "score", "b").collect():
                score = float("nan") if r["score"] is None else r["score"]
                out.append((*names[r["g"]], r["fold"], m, r["target"], score))

    if positive(model):
        own = DualRidge(rows, counts, model)
        try:
            answers, known = own.run()
            if known:
                done = answers.sparkSession.createDataFrame([*known], "g int, fold int")
                told(answers.join(F.broadcast(done), ["g", "fold"]))
        except Unsettled:
            known = {}
        own.remove()
    for g, f in sorted(set(counts) - set(known)):
        told(_swept(rows.where(F.col("g") == g), g, f, model))
    return out


def _swept(rows: DataFrame, g: int, f: int, model: KernelRidgeCV) -> DataFrame:
    """As DualRidge.run(), of one fold, by inverses over tiles."""
    train, test = rows.where(F.col("own") != f), rows.where(F.col("own") == f)
    found = tiles.KernelRidge(model.alphas, model.kernel, model.gamma, model.coef0, model.degree, model.alpha_per_target).fit(train)
    base = F.array(*[F.lit(float(v)) for v in tiles._mean(train, "y")])
    each = found.predict(test).join(test.select("trial", "y"), "trial").select(F.posexplode(F.arrays_zip(F.col("y").cast("array<double>").alias("y"), F.col("predict").alias("p"), base.alias("b"))).alias("target", "e"))
    out = each.select(F.lit(g).alias("g"), F.lit(f).alias("fold"), "target", "e.y", "e.p", "e.b").localCheckpoint()
    found.tiles.remove()
    return out

"""Kernel methods over more trials than a task holds.

Trials are packed into blocks of about `tile` rows, and the kernel into square tiles of two blocks each, once. What iterates (residuals, dual variables) is a
table of one row a block; a step joins it to the tiles, adds the products up by block, and leaves a few sums to the driver, which
says how far the next step goes. No task holds more than some tiles, and no step moves the kernel.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..steps import Steps
from . import gram, interior, keyed
from .gram import FoldModels, _matrix, fits_driver, whole
from .local import RidgeCV
from .local import gram as kernel_of

#: Rows of a block; bytes of iterates that are sent to every task, beyond which they are joined by block; bytes of sums that a task keeps; pairs of blocks of a task that makes tiles anew.
TILE, SENT, KEPT, PAIRS = 1024, 64 << 20, 64 << 20, 32


def _numbers(raw: bytes, n: int, kind=float) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(n, -1)


def narrow(df: DataFrame, x: str = "x") -> bool:
    """Whether there are no more features than trials, nor than a matrix holds: then sums of features do what products of trials would."""
    e = df.agg(F.max(F.size(x)).alias("p"), F.count("*").alias("n")).first()
    return (e["p"] or 0) <= min(e["n"], gram.MOST_FEATURES)


def pack(df: DataFrame, arrays: list[str], tile: int, trial: str = "trial", less: dict | None = None) -> DataFrame:
    """(block, n, trials, arrays as the bytes of doubles): the rows of df in blocks of about tile rows, by a hash of the trial; in a block they are sorted by trial. less is taken off arrays."""
    less = less or {}
    blocks = max(1, -(-df.count() // tile))
    rows = df.select(F.pmod(F.xxhash64(trial), F.lit(blocks)).cast("int").alias("block"), F.col(trial).alias("trial"), *[F.col(c).cast("array<double>").alias(c) for c in arrays])
    kind = df.schema[trial].dataType.simpleString()

    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by("trial").combine_chunks()
        flat = [(t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1) - less.get(c, 0)).tobytes() for c in arrays]
        return pa.table([t.column("block").slice(0, 1), pa.array([t.num_rows], pa.int32()), pa.array([t.column("trial").to_pylist()], pa.list_(t.schema.field("trial").type)), *[pa.array([b], pa.binary()) for b in flat]], ["block", "n", "trials", *arrays])

    return rows.groupBy("block").applyInArrow(work, f"block int, n int, trials array<{kind}>" + "".join(f", {c} binary" for c in arrays))


class Tiles:
    """The kernel of all trials with each other. df has trial, x and further array columns, which are packed beside. Trials with nulls in them are left out.
    Tiles that are not stored are made anew from x in every product."""

    def __init__(self, df: DataFrame, kernel="linear", gamma: float = 1.0, coef0: float = 0.0, degree: float = 2.0, tile: int = TILE, trial: str = "trial", more: tuple[str, ...] = (), less: dict | None = None, stored: bool = True):
        self.spark, self.steps, self.kernel = df.sparkSession, Steps(df.sparkSession, "tiles"), (kernel, gamma, coef0, degree)
        self.blocks = self.steps.write(pack(whole(df, "x", *more), ["x", *more], tile, trial, less))
        self.sizes = {r["block"]: r["n"] for r in self.blocks.select("block", "n").collect()}  # one number a block
        self.n = sum(self.sizes.values())
        own, name, self.stored = self.kernel, list(self.sizes), stored
        if not stored:
            # block a meets those up to half a round on, so all have as many
            count, half = max(self.sizes, default=0) + 1, (max(self.sizes, default=0) + 1) // 2 + 1
            pairs = self.spark.range(0, count * half, 1, max(self.spark.sparkContext.defaultParallelism, count * half // PAIRS))
            a, k = F.floor(F.col("id") / half).cast("int"), (F.col("id") % half).cast("int")
            self.tiles = pairs.select(a.alias("a"), ((a + k) % count).cast("int").alias("b"), (k * 2 != count).alias("once")).where(F.col("once") | (F.col("a") < F.col("b"))).select("a", "b")
            self.width = len(self.blocks.select("x").first()["x"]) // 8 // next(iter(self.blocks.select("n").first())) if self.sizes else 0
            return
        other = self.blocks.select("block", "n", "x").withColumn("other", F.explode(F.array(*[F.lit(b) for b in name]) if name else F.array().cast("array<int>")))
        pairs = other.select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "n", "x")

        def work(key, t):
            x = {r["block"]: _numbers(r["x"], r["n"]) for r in t.to_pylist()}
            a, b = (k.as_py() for k in key)
            return pa.table({"a": pa.array([a], pa.int32()), "b": pa.array([b], pa.int32()), "k": pa.array([np.ascontiguousarray(kernel_of(own[0], x[a], x[b], *own[1:]), float).tobytes()], pa.binary())})

        self.tiles = self.steps.write(pairs.groupBy("a", "b").applyInArrow(work, "a int, b int, k binary"))

    def _parts(self, state: DataFrame, needs: list[str], vector, m: int) -> DataFrame:
        """(block, product binary): what each task's tiles give to each block; vector(arrays) is what a block's state is multiplied as. A tile serves both of its blocks."""
        sizes = self.sizes
        sent = F.broadcast if self.n * m * 8 * len(needs) <= SENT else lambda d: d
        own, kernel, stored = F.struct(*needs), self.kernel, self.stored
        rows = self.tiles.join(sent(state.select(F.col("block").alias("a"), own.alias("va"))), "a").join(sent(state.select(F.col("block").alias("b"), own.alias("vb"))), "b")

        if not stored:
            near = F.broadcast if self.n * self.width * 8 <= SENT else lambda d: d
            for c in "ab":
                rows = rows.join(near(self.blocks.select(F.col("block").alias(c), F.col("x").alias(f"x{c}"))), c)

        def given(sums):
            return pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "product"])

        def part(batches):
            sums, held, known = {}, 0, {}
            for batch in batches:
                for r in batch.select(["a", "b", *(["k"] if stored else ["xa", "xb"]), "va", "vb"]).to_pylist():
                    a, b = r["a"], r["b"]
                    for at, raw in ((a, r["va"]), (b, r["vb"])):
                        if at not in known:
                            known[at] = vector({c: _numbers(v, sizes[at]) for c, v in raw.items()})
                    K = np.frombuffer(r["k"]).reshape(sizes[a], sizes[b]) if stored else kernel_of(kernel[0], _numbers(r["xa"], sizes[a]), _numbers(r["xb"], sizes[b]), *kernel[1:])
                    for at, add in ((a, K @ known[b]), (b, K.T @ known[a]))[: 1 if a == b else 2]:
                        held += 0 if at in sums else add.nbytes
                        sums[at] = sums[at] + add if at in sums else add
                    if held > KEPT:
                        yield given(sums)
                        sums, held, known = {}, 0, {}
            if sums:
                yield given(sums)

        return rows.mapInArrow(part, "block int, product binary")

    def product(self, v: DataFrame, m: int) -> DataFrame:
        """(block, product binary): the kernel times the m columns of v (block, v binary)."""

        def add(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(w) for w in t.column("product").to_pylist())
            return pa.table([t.column("block").slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["block", "product"])

        return self._parts(v, ["v"], lambda arrays: arrays["v"], m).groupBy("block").applyInArrow(add, "block int, product binary")

    def each(self, rows: DataFrame, work, schema: str) -> DataFrame:
        """work(row, n) -> list of dicts, for every block's row of arrays as bytes."""
        sizes = self.sizes

        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    out = work(r, sizes[r["block"]])
                    if out:
                        yield pa.RecordBatch.from_pylist(out, arrow)

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        arrow = to_arrow_schema(_parse_datatype_string(schema))
        return rows.mapInArrow(run, schema)

    def iterate(self, state: DataFrame, names: list[str], needs: list[str], vector, fresh, after, sums: list[str], m: int, going, most: int) -> DataFrame:
        """Runs steps until going() says None, and returns the state after the last.

        state is (block, names binary). A step multiplies the kernel with vector(arrays, given), of the arrays it needs; then each block's arrays become fresh(arrays, given), and
        after(arrays, product) gives sums of m numbers. going({sum: numbers}) tells from all blocks' sums what is given in the next step. One table is written a step.
        """
        sizes, given, before = self.sizes, None, None
        arrow = pa.schema([("block", pa.int32()), *[(c, pa.binary()) for c in names], *[(c, pa.list_(pa.float64())) for c in sums]])
        kinds = "block int" + "".join(f", {c} binary" for c in names) + "".join(f", {c} array<double>" for c in sums)
        state = self.steps.write(state)
        for _ in range(most):

            def finish(left, right, given):
                r, n = right.to_pylist()[0], sizes[right.column("block")[0].as_py()]
                arrays = fresh({c: _numbers(r[c], n) for c in names}, given)
                found = after(arrays, sum(_numbers(w, n) for w in left.column("product").to_pylist()))
                return pa.Table.from_pylist([_packed(r["block"], {c: arrays[c] for c in names}) | {c: found[c].tolist() for c in sums}], arrow)

            parts = self._parts(state, needs, lambda arrays, given=given: vector(arrays, given), m)
            after_ = self.steps.write(parts.groupBy("block").cogroup(state.select("block", *names).groupBy("block")).applyInArrow(_with(finish, given), kinds))
            self.steps.drop(before)
            before, state = state, after_
            # a row of m numbers from each block
            told = state.select(*sums).toArrow()
            given = going({c: np.array(told.column(c).to_pylist(), float).reshape(-1, m) for c in sums})
            if given is None:
                return state.select("block", *names)
        raise RuntimeError(f"not settled after {most} steps")

    def remove(self) -> None:
        self.steps.remove()


def _with(f, given):
    """f of two tables, given something: Spark looks at how many arguments a function takes."""
    return lambda left, right: f(left, right, given)


def _packed(block: int, arrays: dict) -> dict:
    return {"block": block, **{k: np.ascontiguousarray(v).tobytes() for k, v in arrays.items()}}


def solve(tiles: Tiles, rows: DataFrame, start, shifts: np.ndarray, tol: float = 1e-10, most: int = 1000) -> DataFrame:
    """(block, x binary): conjugate gradients for (M K M + shift I) x = M y, a column for each shift, all at once.

    start(row, n) gives a block's y and M, a mask of trials for each column, from a row of `rows`. Each step takes one product. Columns stop when their residual is tol of y.
    """
    m, names = len(shifts), ["mask", "x", "r", "p", "s", "w"]

    def first(r, n):
        y, mask = start(r, n)
        zero = np.zeros((n, m))
        return [_packed(r["block"], {"mask": np.broadcast_to(mask, (n, m)).astype(float), "x": zero, "r": y * mask, "p": zero, "s": zero, "w": zero})]

    def residual(a, given):
        return a["r"] if given is None else a["r"] - given[0] * (a["w"] + given[1] * a["s"])

    def fresh(a, given):
        if given is None:
            return dict(a)
        step, back = given
        p, s = a["r"] + back * a["p"], a["w"] + back * a["s"]
        return {**a, "p": p, "s": s, "x": a["x"] + step * p, "r": residual(a, given)}

    def after(a, product):
        a["w"] = a["mask"] * product + shifts * a["r"]
        return {"rr": (a["r"] ** 2).sum(0), "rw": (a["r"] * a["w"]).sum(0)}

    past = {}

    def going(sums):
        rr, rw = sums["rr"].sum(0), sums["rw"].sum(0)
        past.setdefault("rr0", rr)
        live = rr > tol**2 * past["rr0"]
        if not live.any():
            return None
        with np.errstate(all="ignore"):
            back = np.where(live, rr / past["rr"], 0.0) if "rr" in past else np.zeros(m)
            step = rr / (rw - (back * rr / past["step"] if "step" in past else 0))
        step = np.where(live & np.isfinite(step), step, 0.0)
        past.update(rr=rr, step=np.where(step == 0, np.inf, step))
        return step, back

    state = tiles.each(rows, first, "block int, " + ", ".join(f"{c} binary" for c in names))
    return tiles.iterate(state, names, ["r", "w", "s"], residual, fresh, after, ["rr", "rw"], m, going, most).select("block", "x")


def swept(tiles: Tiles, blocks: DataFrame, systems: list[tuple[int, float]]) -> DataFrame:
    """(s, a, b, k binary): minus the inverse of K + shift I for each system (fold, shift), of the trials outside its fold; others have ones in the diagonal.

    The tiles of all systems are swept block by block: a step inverts a system's diagonal tile and takes from every other what its row and column hold, so there are as
    many steps as blocks, for any number of systems. blocks has own, the folds.
    """
    sizes = tiles.sizes
    sent = F.broadcast if tiles.n * 8 <= SENT else lambda d: d
    owned = tiles.tiles.join(sent(blocks.select(F.col("block").alias("a"), F.col("own").alias("oa"))), "a").join(sent(blocks.select(F.col("block").alias("b"), F.col("own").alias("ob"))), "b")

    def first(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n, m = sizes[r["a"]], sizes[r["b"]]
                K, left, right = np.frombuffer(r["k"]).reshape(n, m), np.frombuffer(r["oa"]), np.frombuffer(r["ob"])
                for i, (fold, shift) in enumerate(systems):
                    M = K * (left != fold)[:, None] * (right != fold)
                    if r["a"] == r["b"]:
                        M[np.arange(n), np.arange(n)] += np.where(left != fold, shift, 1.0)
                    yield pa.RecordBatch.from_pydict({"s": pa.array([i], pa.int32()), "a": pa.array([r["a"]], pa.int32()), "b": pa.array([r["b"]], pa.int32()), "k": pa.array([M.tobytes()], pa.binary())})

    now = tiles.steps.write(owned.mapInArrow(first, "s int, a int, b int, k binary"))
    for k in sorted(sizes):
        wide, before = sizes[k], now

        def column(batches, k=k, wide=wide):
            for batch in batches:
                for r in batch.to_pylist():
                    T = np.frombuffer(r["k"]).reshape(sizes[r["a"]], sizes[r["b"]])
                    T = np.linalg.inv(T) if r["a"] == r["b"] else T if r["b"] == k else np.ascontiguousarray(T.T)
                    yield pa.RecordBatch.from_pydict({"s": pa.array([r["s"]], pa.int32()), "i": pa.array([r["a"] + r["b"] - k], pa.int32()), "c": pa.array([T.tobytes()], pa.binary())})

        def sweep(batches, k=k, wide=wide):
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    a, b = r["a"], r["b"]
                    D, T = np.frombuffer(r["d"]).reshape(wide, wide), np.frombuffer(r["k"]).reshape(sizes[a], sizes[b])
                    if a == k or b == k:
                        T = -D if a == b else T @ D if b == k else D @ T
                    else:
                        T = T - np.frombuffer(r["ca"]).reshape(-1, wide) @ (D @ np.frombuffer(r["cb"]).reshape(-1, wide).T)
                    out.append(np.ascontiguousarray(T).tobytes())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("s", "a", "b")], pa.array(out, pa.binary())], ["s", "a", "b", "k"])

        cols = tiles.steps.write(now.where((F.col("a") == k) | (F.col("b") == k)).mapInArrow(column, "s int, i int, c binary"))
        near = F.broadcast if tiles.n * wide * 8 * len(systems) <= SENT else lambda d: d
        rows = now.join(near(cols.select("s", F.col("i").alias("a"), F.col("c").alias("ca"))), ["s", "a"]).join(near(cols.select("s", F.col("i").alias("b"), F.col("c").alias("cb"))), ["s", "b"])
        rows = rows.join(near(cols.where(F.col("i") == k).select("s", F.col("c").alias("d"))), "s")
        now = tiles.steps.write(rows.mapInArrow(sweep, "s int, a int, b int, k binary"))
        tiles.steps.drop(cols)
        tiles.steps.drop(before)
    return now


def gamma_of(df: DataFrame, gamma) -> float:
    """A kernel's gamma over all trials: 'scale' is 1 / (features x variance of all numbers), 'auto' 1 / features."""
    if gamma not in ("scale", "auto"):
        return float(gamma)
    e = df.select(F.explode(F.col("x").cast("array<double>")).alias("v"), F.size("x").alias("p")).agg(F.max("p").alias("p"), F.var_pop("v").alias("s")).first()
    p = e["p"] or 1
    return 1 / p if gamma == "auto" else 1 / (p * max(e["s"] or 0.0, 1e-12))


@dataclass
class KernelRidge:
    """Dual ridge over tables, without intercept; alpha by leave-one-out error. The same answers as local.KernelRidgeCV, whose trials meet in one task.

    A trial's leave-one-out error is its dual coefficient over its place in the diagonal of the inverse of K + alpha I. Without probes the inverses of all folds and alphas are made exactly, by
    sweeps over the tiles: n^3 work and n^2 numbers for each, in as many steps as there are blocks. With probes, for more trials, all systems are solved by conjugate gradients, which
    share every product with the tiles, and the diagonal is estimated from so many vectors of random signs.
    """

    alphas: object = 1.0
    kernel: object = "linear"
    gamma: object = "auto"
    coef0: float = 1.0
    degree: float = 3.0
    alpha_per_target: bool = False
    tile: int = TILE
    probes: int | None = None
    tol: float = 1e-10
    seed: int = 0
    share = 0.0

    def _tiles(self, df: DataFrame, trial: str, more: tuple[str, ...]) -> Tiles:
        return Tiles(df, self.kernel, self.gamma_, self.coef0, self.degree, self.tile, trial, more)

    def _dual(self, tiles: Tiles, folds: list[int]) -> tuple[DataFrame, np.ndarray]:
        """(block, a binary) with a column for each fold and target, and the alphas taken (folds, targets). Fold -1 leaves no trial out."""
        al, F_ = np.atleast_1d(np.asarray(self.alphas, float)), len(folds)
        if (al <= 0).any():
            raise ValueError("alphas must be positive")
        first = tiles.blocks.select(F.floor(F.length("y") / (8 * F.col("n"))).alias("d")).first()
        d, S, fold = int(first["d"]) if first else 0, len(al), np.array(folds)
        blocks = tiles.blocks.select("block", "y", "own")

        def trains(r, n):
            return (_numbers(r["own"], n) != fold[None]).astype(float)

        both = (self._exact if self.probes is None else self._estimated)(tiles, blocks, trains, folds, al, d).join(blocks.select("block", "own"), "block")

        def errors(r, n):
            a, g, m = _numbers(r["a"], n).reshape(n, F_, S, d), _numbers(r["g"], n).reshape(n, F_, S, 1), trains(r, n)[:, :, None, None]
            # an intercept takes one in n of a trial more
            rest = g - self.share / al[:, None] if self.share else g
            return [{"block": r["block"], "e": (np.where(m > 0, a / np.where(m > 0, rest, 1), 0) ** 2).sum(0).ravel().tolist()}]

        told = tiles.each(both, errors, "block int, e array<double>").toArrow()  # folds x alphas x targets numbers a block
        loss = np.array(told.column("e").to_pylist()).sum(0).reshape(F_, S, d)
        pick = loss.argmin(1) if self.alpha_per_target else np.repeat(loss.mean(2).argmin(1)[:, None], d, 1)

        def chosen(r, n):
            a = _numbers(r["a"], n).reshape(n, F_, S, d)
            return [_packed(r["block"], {"a": np.take_along_axis(a, pick[None, :, None, :], 2)[:, :, 0].reshape(n, -1)})]

        return tiles.steps.write(tiles.each(both, chosen, "block int, a binary")), al[pick]

    def _exact(self, tiles: Tiles, blocks: DataFrame, trains, folds: list[int], al: np.ndarray, d: int) -> DataFrame:
        """(block, a binary, g binary): dual coefficients (folds, alphas, targets) and places in the diagonal (folds, alphas) of each block's trials."""
        systems, sizes = [(f, a) for f in folds for a in al], tiles.sizes
        inverse = swept(tiles, blocks, systems)
        sent = F.broadcast if tiles.n * (d + 1) * 8 <= SENT else lambda x: x
        beside = lambda c: sent(blocks.select(F.col("block").alias(c), F.struct("y", "own").alias(f"v{c}")))
        rows = inverse.join(beside("a"), "a").join(beside("b"), "b")

        def part(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    a, b, fold = r["a"], r["b"], systems[r["s"]][0]
                    G, y = -np.frombuffer(r["k"]).reshape(sizes[a], sizes[b]), {}
                    for at, v in ((a, r["va"]), (b, r["vb"])):
                        y[at] = _numbers(v["y"], sizes[at]) * (_numbers(v["own"], sizes[at]) != fold)
                    for at, v in ((a, G @ y[b]), (b, G.T @ y[a]))[: 1 if a == b else 2]:
                        g = np.diag(G).tobytes() if a == b else None
                        yield pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "s": pa.array([r["s"]], pa.int32()), "v": pa.array([v.tobytes()], pa.binary()), "g": pa.array([g], pa.binary())})

        def add(t: pa.Table) -> pa.Table:
            n = sizes[t.column("block")[0].as_py()]
            a, g = np.zeros((n, len(systems), d)), np.zeros((n, len(systems)))
            for s, v, own in zip(*[t.column(c).to_pylist() for c in ("s", "v", "g")]):
                a[:, s] += _numbers(v, n)
                if own is not None:
                    g[:, s] = np.frombuffer(own)
            return pa.table([t.column("block").slice(0, 1), pa.array([a.tobytes()], pa.binary()), pa.array([g.tobytes()], pa.binary())], ["block", "a", "g"])

        out = tiles.steps.write(rows.mapInArrow(part, "block int, s int, v binary, g binary").groupBy("block").applyInArrow(add, "block int, a binary, g binary"))
        tiles.steps.drop(inverse)
        return out

    def _estimated(self, tiles: Tiles, blocks: DataFrame, trains, folds: list[int], al: np.ndarray, d: int) -> DataFrame:
        """As _exact(), by conjugate gradients; targets and probes are solved for together."""
        F_, S, c, seed = len(folds), len(al), self.probes, self.seed

        def signs(r, n):
            return np.random.default_rng([seed, r["block"]]).choice([-1.0, 1.0], (n, c))

        def start(r, n):
            return np.concatenate([np.tile(_numbers(r["y"], n), (1, F_ * S)), np.tile(signs(r, n), (1, F_ * S))], 1), np.concatenate([np.repeat(trains(r, n), S * d, 1), np.repeat(trains(r, n), S * c, 1)], 1)

        def split(r, n):
            x = _numbers(r["x"], n)
            z = x[:, F_ * S * d :].reshape(n, F_ * S, c) * signs(r, n)[:, None, :]
            return [_packed(r["block"], {"a": x[:, : F_ * S * d], "g": z.mean(2)})]

        shifts = np.r_[np.tile(np.repeat(al, d), F_), np.tile(np.repeat(al, c), F_)]
        return tiles.steps.write(tiles.each(solve(tiles, blocks, start, shifts, self.tol), split, "block int, a binary, g binary"))

    def fit(self, df: DataFrame, trial: str = "trial") -> "FittedKernelRidge":
        """From (trial, x, y). Trials with nulls are left out; no trials are an error. Trials that repeat a number are trials of their own."""
        new = copy.copy(self)
        new.gamma_ = gamma_of(df, self.gamma)
        tiles = new._tiles(df.withColumn("own", F.array(F.lit(0.0))), trial, ("y", "own"))
        if not tiles.n:
            raise ValueError("no trials to fit")
        dual, alpha = new._dual(tiles, [-1])
        out = FittedKernelRidge(new, tiles, dual, trial)
        out.alpha_ = alpha[0] if self.alpha_per_target else float(alpha[0, 0])
        return out

    def predictions(self, df: DataFrame, own: str = "own", trial: str = "trial") -> DataFrame:
        """(trial, own, y, predict, base): every trial's answer from the model that has not seen its fold `own` (an integer), and the mean of y over that model's trials.

        All folds are solved at once on the tiles of all trials, so gamma is that of all trials. A fold that holds every trial gives none.
        """
        if self.kernel == "linear" and (np.asarray(self.alphas, float) > 0).all() and narrow(df) and fits_driver(df, [own], 1):
            return self._by_sums(df, own, trial)
        new = copy.copy(self)
        new.gamma_ = gamma_of(df, self.gamma)
        tiles = new._tiles(df.withColumn("own", F.array(F.col(own).cast("double"))), trial, ("y", "own"))
        kind = f"`{trial}` {df.schema[trial].dataType.simpleString()}, `{own}` int, y array<double>, predict array<double>, base array<double>"
        found = tiles.each(tiles.blocks.select("block", "own", "y"), lambda r, n: [{"fold": int(f), "n": int((o := _numbers(r["own"], n)[:, 0] == f).sum()), "y": _numbers(r["y"], n)[o].sum(0).tolist()} for f in np.unique(_numbers(r["own"], n))], "fold int, n long, y array<double>").toArrow().to_pylist()
        folds = sorted({r["fold"] for r in found})
        if len(folds) < 2:
            return df.sparkSession.createDataFrame([], kind)
        sums = {f: (sum(r["n"] for r in found if r["fold"] == f), sum(np.array(r["y"]) for r in found if r["fold"] == f)) for f in folds}
        base = np.array([sum(s for g, (_, s) in sums.items() if g != f) / sum(n for g, (n, _) in sums.items() if g != f) for f in folds])
        dual, new.alphas_ = new._dual(tiles, folds)
        answers = tiles.product(dual.select("block", F.col("a").alias("v")), len(folds) * base.shape[1]).join(tiles.blocks.select("block", "trials", "own", "y"), "block")

        def rows(r, n):
            own_, y, p = np.searchsorted(folds, _numbers(r["own"], n)[:, 0]), _numbers(r["y"], n), _numbers(r["product"], n).reshape(n, len(folds), -1)
            return [{trial: t, own: folds[f], "y": y[i].tolist(), "predict": p[i, f].tolist(), "base": base[f].tolist()} for i, (t, f) in enumerate(zip(r["trials"], own_))]

        return tiles.each(answers, rows, kind)


    def _by_sums(self, df: DataFrame, own: str, trial: str) -> DataFrame:
        """As predictions(), for a linear kernel of no more features than trials: ridge without intercept, whose leave-one-out errors are the same, from sums of features."""
        rows = whole(df.select(trial, F.col(own).cast("int").alias(own), F.lit(0).alias("repeat"), *[F.col(c).cast("array<double>").alias(c) for c in "xy"]), "x", "y")
        fitted = FoldModels(rows, [], own, RidgeCV(self.alphas, False, self.alpha_per_target))
        sent, kind = fitted.sent, df.schema[trial].dataType
        out = f"`{trial}` {kind.simpleString()}, `{own}` int, y array<double>, predict array<double>, base array<double>"

        def work(batches):
            of, models = sent.value
            for b in batches:
                X, fold = _matrix(b.column("x")), b.column(own).to_numpy()
                for f in np.unique(fold):
                    for i in of.get((0, f), ()):
                        at, (coef, icpt, mean) = np.flatnonzero(fold == f), models[i]
                        part, p = b.take(pa.array(at)), X[at] @ coef.T + icpt
                        yield pa.RecordBatch.from_arrays([part.column(trial), part.column(own), part.column("y"), pa.array(p.tolist(), pa.list_(pa.float64())), pa.array([mean.tolist()] * len(at), pa.list_(pa.float64()))], [trial, own, "y", "predict", "base"])

        return rows.mapInArrow(work, out)


class FittedKernelRidge:
    """Dual coefficients beside the trials they belong to, as a table of blocks."""

    def __init__(self, model: KernelRidge, tiles: Tiles, dual: DataFrame, trial: str):
        self.model, self.tiles, self.trial, self.gamma_ = model, tiles, trial, model.gamma_
        self.blocks = dual.join(tiles.blocks.select("block", "n", "trials", "x"), "block")

    def dual(self) -> DataFrame:
        """(trial, dual array<double>): a row per trial, by target."""
        name = self.trial
        kind = self.tiles.blocks.schema["trials"].dataType.elementType.simpleString()
        return self.tiles.each(self.blocks, lambda r, n: [{name: t, "dual": a} for t, a in zip(r["trials"], _numbers(r["a"], n).tolist())], f"`{name}` {kind}, dual array<double>")

    def predict(self, df: DataFrame, trial: str = "trial") -> DataFrame:
        """(trial, predict array<double>) of other rows (trial, x): blocks of them meet blocks of the model, and parts are added up."""
        return _decide(self.blocks, self.tiles, df, trial, None)

    def coefficients(self) -> np.ndarray:
        """(targets, features) of a linear kernel."""
        if self.model.kernel != "linear":
            raise ValueError("only a linear kernel has coefficients")
        return _weights(self.blocks, self.tiles)


def _weights(blocks: DataFrame, tiles: Tiles) -> np.ndarray:
    """(columns, features): dual coefficients times trials, from one row of sums a task."""

    def part(batches):
        total = None
        for batch in batches:
            for r in batch.to_pylist():
                own = _numbers(r["a"], r["n"]).T @ _numbers(r["x"], r["n"])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"w": pa.array([total.tolist()], pa.list_(pa.list_(pa.float64())))})

    return sum(np.array(r["w"]) for r in blocks.select("n", "a", "x").mapInArrow(part, "w array<array<double>>").toLocalIterator())


def _decide(blocks: DataFrame, tiles: Tiles, df: DataFrame, trial: str, shift: np.ndarray | None) -> DataFrame:
    own = tiles.kernel
    asked = pack(whole(df, "x"), ["x"], TILE, trial).select(F.col("block").alias("other"), "n", "trials", "x")
    left = asked.withColumn("block", F.explode(F.array(*[F.lit(b) for b in tiles.sizes])))
    kind = df.schema[trial].dataType.simpleString()

    def work(key, a, b):
        out = {trial: [], "v": []}
        for m in b.to_pylist():
            A, X = _numbers(m["a"], m["n"]), _numbers(m["x"], m["n"])
            for r in a.to_pylist():
                out[trial] += r["trials"]
                out["v"] += (kernel_of(own[0], _numbers(r["x"], r["n"]), X, *own[1:]) @ A).tolist()
        return pa.table([pa.array(out[trial], a.schema.field("trials").type.value_type), pa.array(out["v"], pa.list_(pa.float64()))], [trial, "v"])

    parts = left.groupBy("block").cogroup(blocks.select("block", "n", "a", "x").groupBy("block")).applyInArrow(work, f"`{trial}` {kind}, v array<double>")
    sums = parts.select(trial, F.posexplode("v").alias("i", "v")).groupBy(trial, "i").agg(F.sum("v").alias("v"))
    add: Column = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])
    if shift is not None:
        add = F.zip_with(add, F.array(*map(F.lit, map(float, shift))), lambda a, b: a + b)
    return sums.groupBy(trial).agg(add.alias("predict"))


def _mean(rows: DataFrame, name: str) -> np.ndarray:
    """The mean of each array position, from a row of sums a task: as many numbers as the model has."""

    def part(batches):
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                own = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).sum(0)
                total, n = own if total is None else total + own, n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})

    total, n = 0.0, 0
    for r in rows.select(F.col(name).cast("array<double>").alias("v")).mapInArrow(part, "v binary, n long").toLocalIterator():
        total, n = total + np.frombuffer(r["v"]), n + r["n"]
    return total / n


def wide_ridge(df: DataFrame, alphas=1.0, fit_intercept: bool = True, alpha_per_target: bool = False, x: str = "x", y: str = "y", tile: int = TILE) -> DataFrame:
    """(coef array<array<double>>, intercept, alpha): ridge with more features than a task's matrix holds, or than there are trials, by leave-one-out error.

    The dual of centred trials: their products in tiles, inverted for all alphas by sweeps; the coefficients are sums over blocks. With no more features than trials, nor than a matrix
    holds, the same model comes from sums of features. Rows with nulls are left out. Empty table: no rows.
    """
    if narrow(df, x):
        return keyed.ridge_cv(df, [], alphas, fit_intercept, alpha_per_target, x, y)
    al = np.atleast_1d(np.asarray(alphas, float))
    rows = whole(df.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")), "x", "y").withColumn("own", F.array(F.lit(0.0)))
    rows = rows.withColumn("trial", F.xxhash64("x", "y"))
    kind = "coef array<array<double>>, intercept array<double>, alpha array<double>"
    if rows.isEmpty():
        return df.sparkSession.createDataFrame([], kind)
    mx, my = (_mean(rows, "x"), _mean(rows, "y")) if fit_intercept else (0.0, 0.0)
    model = KernelRidge(al, "linear", 1.0, alpha_per_target=alpha_per_target, tile=tile)
    tiles = Tiles(rows, "linear", tile=tile, more=("y", "own"), less={"x": mx, "y": my})
    model.share = 1 / tiles.n if fit_intercept else 0.0
    dual, alpha = model._dual(tiles, [-1])
    coef = _weights(dual.join(tiles.blocks.select("block", "n", "x"), "block"), tiles)
    icpt = my - coef @ mx if fit_intercept else np.zeros(len(coef))
    tiles.remove()
    return df.sparkSession.createDataFrame([(coef.tolist(), icpt.tolist(), alpha[0].tolist())], kind)


@dataclass
class SupportVectors:
    """One-versus-rest support vectors over tables: the box-constrained dual of local.SVC, whose trials meet in one task.

    Dual variables, gradients and directions are a table of blocks. Few enough take proximal steps, others follow the central path (see interior.py), with at most max_iter products of the kernel, which is made anew in each. A sigmoid
    kernel, which may be indefinite, is stored, and a step goes along the projected gradient, as far as the quadratic asks for, with lengths after Barzilai
    and Borwein. Both end when no class violates its optimality conditions by more than tol. Features are scaled as the sums of all trials say.
    """

    C: float = 1.0
    kernel: str = "linear"
    gamma: object = "scale"
    coef0: float = 0.0
    degree: float = 3.0
    tol: float = 1e-3
    max_iter: int = 1000
    tile: int = TILE

    def fit(self, df: DataFrame, trial: str = "trial", label: str = "label") -> "FittedSupportVectors":
        """From (trial, x, label). Trials with nulls are left out; fewer than two labels are an error."""
        df = whole(df.where(F.col(label).isNotNull()), "x")
        labels = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
        if len(labels) < 2:
            raise ValueError("a classifier needs two labels")
        e = df.select(F.posexplode(F.col("x").cast("array<double>")).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"), F.count("*").alias("n")).orderBy("i").collect()
        mean, scale = np.array([r["m"] for r in e]), np.array([r["s"] if r["s"] and r["s"] == r["s"] else 1.0 for r in e])
        n, spread = e[0]["n"], np.array([bool(r["s"]) and r["s"] == r["s"] for r in e])
        gamma = {"scale": 1 / max(len(e) * (n - 1) / n * spread.mean(), 1e-12), "auto": 1 / len(e)}.get(self.gamma, self.gamma)
        code = F.array(*[F.when(F.col(label) == F.lit(k), 1.0).otherwise(-1.0) for k in labels])
        tiles = Tiles(scaled(df, mean, scale).withColumn("l", code), self.kernel, gamma, self.coef0, self.degree, self.tile, trial, ("l",), stored=self.kernel == "sigmoid")
        m, C, names = len(labels), self.C, ["l", "a", "g", "d", "q"]
        if self.kernel != "sigmoid":
            done = interior.settled(tiles, C, m, self.tol, self.max_iter)
            return FittedSupportVectors(self, tiles, done, labels, mean, scale, gamma, trial)

        def first(r, n):
            zero = np.zeros((n, m))
            return [_packed(r["block"], {"l": _numbers(r["l"], n), "a": zero, "g": zero + 1, "d": zero, "q": zero})]

        def fresh(b, given):
            step, size = given or (np.zeros(m), np.full(m, C))
            a, g = np.clip(b["a"] + step * b["d"], 0, C), b["g"] - step * b["q"]
            d = np.clip(a + size * g, 0, C) - a
            return {**b, "a": a, "g": g, "d": d}

        def after(b, product):
            b["q"] = b["l"] * product
            d, q, g, a = b["d"], b["q"], b["g"], b["a"]
            return {"dg": (d * g).sum(0), "dq": (d * q).sum(0), "dd": (d * d).sum(0), "qq": (q * q).sum(0), "far": np.abs(np.clip(a + g, 0, C) - a).max(0)}

        turn = [0]

        def going(s):
            far = s["far"].max(0)
            if (far <= self.tol).all():
                return None
            dg, dq, dd, qq = (s[k].sum(0) for k in ("dg", "dq", "dd", "qq"))
            turn[0] += 1
            with np.errstate(all="ignore"):
                step = np.where(far > self.tol, np.where(dq > 0, np.minimum(1, dg / dq), 1), 0.0)
                size = np.where(dq > 0, dd / dq if turn[0] % 2 else dq / qq, C)
            return step, np.where(np.isfinite(size), size.clip(1e-10, 1e10), C)

        state = tiles.each(tiles.blocks.select("block", "l"), first, "block int, " + ", ".join(f"{c} binary" for c in names))
        done = tiles.iterate(state, names, names, lambda b, given: fresh(b, given)["d"] * b["l"], fresh, after, ["dg", "dq", "dd", "qq", "far"], m, going, self.max_iter)
        return FittedSupportVectors(self, tiles, done, labels, mean, scale, gamma, trial)


def scaled(df: DataFrame, mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    at = F.zip_with(F.col("x").cast("array<double>"), F.array(*map(F.lit, map(float, mean))), lambda a, b: a - b)
    return df.withColumn("x", F.zip_with(at, F.array(*map(F.lit, map(float, scale))), lambda a, b: a / b))


class FittedSupportVectors:
    """labels_, intercept_, gamma_, and the dual variables beside their trials."""

    def __init__(self, model, tiles, done, labels, mean, scale, gamma, trial):
        self.model, self.tiles, self.labels_, self.mean_, self.scale_, self.gamma_, self.trial = model, tiles, labels, mean, scale, gamma, trial
        C, m, eps = model.C, len(labels), 1e-9

        def margins(r, n):
            a, rest = _numbers(r["a"], n), _numbers(r["l"], n) * _numbers(r["g"], n)
            on, top = (a > eps) & (a < C - eps), a.argmax(0)
            return [{"n": on.sum(0).astype(float).tolist(), "s": (rest * on).sum(0).tolist(), "a": a.max(0).tolist(), "r": rest[top, range(m)].tolist()}]

        # four numbers a class from each block
        told = tiles.each(done, margins, "n array<double>, s array<double>, a array<double>, r array<double>").toArrow()
        n, s, a, r = (np.array(told.column(c).to_pylist()) for c in "nsar")
        with np.errstate(all="ignore"):
            self.intercept_ = np.where(n.sum(0) > 0, s.sum(0) / n.sum(0), r[a.argmax(0), range(m)])
        signed = tiles.each(done, lambda r, n: [_packed(r["block"], {"a": _numbers(r["a"], n) * _numbers(r["l"], n)})], "block int, a binary")
        self.blocks = signed.join(tiles.blocks.select("block", "n", "trials", "x"), "block")
        self.state = done

    def dual(self) -> DataFrame:
        """(trial, dual array<double>): signed dual variables by label."""
        return FittedKernelRidge.dual(self)

    def own_sums(self, trial: str = "trial") -> DataFrame:
        """(trial, sums array<double>): for each label the fitted trials' kernels times signed dual variables, without intercept. Pairs of blocks make the kernel anew; no kernel leaves its task."""
        tiles, m = self.tiles, len(self.labels_)
        products = tiles.product(self.blocks.select("block", F.col("a").alias("v")), m).join(self.blocks.select("block", "trials"), "block")
        kind = self.blocks.schema["trials"].dataType.elementType.simpleString()
        return tiles.each(products, lambda r, n: [{trial: t, "sums": v} for t, v in zip(r["trials"], _numbers(r["product"], n).tolist())], f"`{trial}` {kind}, sums array<double>")

    def coefficients(self) -> np.ndarray:
        """(labels, features) of a linear kernel, for features as given."""
        if self.model.kernel != "linear":
            raise ValueError("only a linear kernel has coefficients")
        return _weights(self.blocks, self.tiles) / self.scale_

    def decision_function(self, df: DataFrame, trial: str = "trial") -> DataFrame:
        """(trial, predict array<double>): a number for each label."""
        return _decide(self.blocks, self.tiles, scaled(whole(df, "x"), self.mean_, self.scale_), trial, self.intercept_)

    def predict(self, df: DataFrame, trial: str = "trial") -> DataFrame:
        """(trial, label): the label with the greatest decision, the first of equals."""
        at = F.array_position("predict", F.array_max("predict")).cast("int")
        return self.decision_function(df, trial).select(trial, F.element_at(F.array(*map(F.lit, self.labels_)), at).alias("label"))

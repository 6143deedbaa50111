"""Ridge models of many keys, summed, solved and judged on executors: nothing of a key meets the driver.

Each task adds up the products of its rows by key, in parts of bounded size; parts are added up by bins of keys, and a bin's keys are solved where they meet. For the
leave-one-out errors, a key's rows are dealt into pieces of bounded size, each of which meets the key's decomposition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..steps import Steps
from .gram import MOST_FEATURES, _matrix, whole
from .local import ridge_from_moments

#: Numbers of a part of a key's sums, bytes of sums that a task keeps, rows of a key's piece.
PART, KEPT, ROWS = 1 << 16, 64 << 20, 1 << 16


def groups(table, names: list[str]):
    """(positions, first) of the rows of each combination of the columns; null is a value."""
    if not table.num_rows:
        return
    if not names:
        yield np.arange(table.num_rows), 0
        return
    codes = []
    for c in names:
        column = table.column(c)
        coded = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode(null_encoding="encode")
        codes.append((coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).indices.to_numpy(zero_copy_only=False))
    order = np.lexsort(codes)
    cut = np.flatnonzero(np.r_[True, np.any([c[order][1:] != c[order][:-1] for c in codes], axis=0), True])
    for a, b in zip(cut[:-1], cut[1:]):
        yield order[a:b], int(order[a])


def _bin(bins: int, *names: str) -> Column:
    return F.pmod(F.xxhash64(*names) if names else F.lit(0), F.lit(bins)).alias("__bin")


class Keyed:
    """Names and types of keys, and how their tables are made."""

    def __init__(self, df: DataFrame, keys: list[str]):
        self.keys = list(keys)
        self.kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
        self.types = [to_arrow_type(df.schema[k].dataType) for k in keys]
        # a part of the keys' bins is what one group holds
        self.bins = max(64, 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def table(self, rows: list[tuple], names: list[str], types: list) -> pa.Table:
        columns = list(zip(*rows)) or [[]] * (len(self.keys) + len(names))
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, [*self.types, *types])], [*self.keys, *names])

    def of(self, table, row: int) -> tuple:
        return tuple(table.column(k)[row].as_py() for k in self.keys)


def sums(rows: DataFrame, keyed: Keyed) -> DataFrame:
    """(keys, p, d, part, v binary): parts of each key's n, sums of x and y, x'x and x'y, from rows (keys, x, y)."""
    keys = keyed.keys

    def given(found):
        for (k, p, d), v in found.items():
            for i in range(0, len(v), PART):
                yield (*k, p, d, i // PART, v[i : i + PART].tobytes())

    def part(batches):
        found, held = {}, 0
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for b in batches:
            for at, first in groups(b, keys):
                own = b.take(pa.array(at)) if len(at) < b.num_rows else b
                sizes = np.unique(own.column("x").value_lengths().to_numpy(zero_copy_only=False))
                if len(sizes) > 1:
                    raise ValueError("a key's trials have different numbers of features")
                X, Y, k = _matrix(own.column("x")), _matrix(own.column("y")), keyed.of(b, first)
                v = np.concatenate([[len(X)], X.sum(0), Y.sum(0), (X.T @ X).ravel(), (X.T @ Y).ravel()])
                name = (k, X.shape[1], Y.shape[1])
                held += 0 if name in found else v.nbytes
                found[name] = found[name] + v if name in found else v
            if held > KEPT:
                yield from keyed.table(list(given(found)), ["p", "d", "part", "v"], kinds).to_batches()
                found, held = {}, 0
        yield from keyed.table(list(given(found)), ["p", "d", "part", "v"], kinds).to_batches()

    def add(t: pa.Table) -> pa.Table:
        out, raw = [], t.column("v")
        for at, first in groups(t, [*keys, "p", "d", "part"]):
            total = sum(np.frombuffer(raw[int(i)].as_py()) for i in at)
            out.append((*keyed.of(t, first), *(t.column(c)[first].as_py() for c in ("p", "d", "part")), total.tobytes()))
        return keyed.table(out, ["p", "d", "part", "v"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()])

    kind = keyed.kinds + "p int, d int, part int, v binary"
    parts = rows.select(*keys, "x", "y").mapInArrow(part, kind)
    return parts.withColumn("__bin", _bin(keyed.bins, *keys, "part")).groupBy("__bin").applyInArrow(add, kind)


def opened(raw: bytes, p: int, d: int) -> tuple:
    v, cut = np.frombuffer(raw), np.cumsum([1, p, d, p * p])
    return v[0], v[1 : cut[1]], v[cut[1] : cut[2]], v[cut[2] : cut[3]].reshape(p, p), v[cut[3] :].reshape(p, d)


def models(parts: DataFrame, keyed: Keyed) -> DataFrame:
    """(keys, p, d, n, v binary): each key's sums, put together where they are solved."""
    keys = keyed.keys

    def join(t: pa.Table) -> pa.Table:
        out = []
        for at, first in groups(t, keys):
            own = sorted(at.tolist(), key=lambda i: t.column("part")[i].as_py())
            p, d = t.column("p")[first].as_py(), t.column("d")[first].as_py()
            if p > MOST_FEATURES:
                raise ValueError("too many features for sums of a key: see tiles.wide_ridge")
            raw = b"".join(t.column("v")[i].as_py() for i in own)
            if len(raw) != 8 * (1 + p + d + p * p + p * d):
                raise ValueError("a key's trials have different numbers of features or targets")
            out.append((*keyed.of(t, first), p, d, int(np.frombuffer(raw[:8])[0]), raw))
        return keyed.table(out, ["p", "d", "n", "v"], [pa.int32(), pa.int32(), pa.int64(), pa.binary()])

    return parts.withColumn("__bin", _bin(keyed.bins, *keys)).groupBy("__bin").applyInArrow(join, keyed.kinds + "p int, d int, n long, v binary")


def _same(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return on


def losses(rows: DataFrame, solved: DataFrame, keyed: Keyed, al: np.ndarray, fit_intercept: bool, n_rows: int) -> DataFrame:
    """(keys, e binary): summed squared leave-one-out errors (alphas, targets) of each piece of a key."""
    keys, bins = keyed.keys, max(keyed.bins, -(-n_rows // ROWS))
    pieces = F.ceil(F.col("n") / ROWS).cast("int")
    # few keys can have more than one piece: a row for each ROWS rows at most
    large = solved.where(F.col("n") > ROWS).select(*[F.col(k).alias(f"__k_{k}") for k in keys], pieces.alias("__pieces"))
    left = rows.join(large, _same(keys), "left") if keys else rows.join(F.broadcast(solved.select(pieces.alias("__pieces"))))
    left = left.withColumn("__piece", F.coalesce(F.pmod(F.xxhash64("x", "y"), "__pieces"), F.lit(0)).cast("int"))
    left = left.select(_bin(bins, *keys, "__piece"), *keys, "x", "y")
    right = solved.withColumn("__piece", F.explode(F.sequence(F.lit(0), pieces - 1))).select(_bin(bins, *keys, "__piece"), *keys, "p", "d", "v")

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        known, out = {keyed.of(b, first): first for _, first in groups(b, keys)}, []
        for at, first in groups(a, keys):
            k = keyed.of(a, first)
            r = known[k]
            n, sx, sy, xx, xy = opened(b.column("v")[r].as_py(), b.column("p")[r].as_py(), b.column("d")[r].as_py())
            own = a.take(pa.array(at))
            X, Y = _matrix(own.column("x")), _matrix(own.column("y"))
            mx, my = (sx / n, sy / n) if fit_intercept else (np.zeros_like(sx), np.zeros_like(sy))
            w, q = np.linalg.eigh(xx - n * np.outer(mx, mx))
            w, z, A, B, e = np.maximum(w, 0), q.T @ (xy - n * np.outer(mx, my)), (X - mx) @ q, Y - my, []
            for alpha in al:
                g = 1 / np.where(w + alpha > 0, w + alpha, np.inf)
                with np.errstate(all="ignore"):
                    e.append((((B - A @ (g[:, None] * z)) / (1 - (1 / n if fit_intercept else 0) - (A * A) @ g)[:, None]) ** 2).sum(0))
            out.append((*k, np.array(e).tobytes()))
        return keyed.table(out, ["e"], [pa.binary()])

    return left.groupBy("__bin").cogroup(right.groupBy("__bin")).applyInArrow(work, keyed.kinds + "e binary")


def ridge_cv(df: DataFrame, keys: list[str], alphas=1.0, fit_intercept: bool = True, alpha_per_target: bool = False, x: str = "x", y: str = "y") -> DataFrame:
    """(keys, coef array<array<double>>, intercept, alpha): see gram.ridge_cv."""
    al, keyed = np.atleast_1d(np.asarray(alphas, float)), Keyed(df, keys)
    keys = keyed.keys
    rows = whole(df.select(*keys, F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")), "x", "y")
    solved = Steps(df.sparkSession, "ridge").write(models(sums(rows, keyed), keyed))
    found = solved.select(*keys, "p", "d", "v", F.lit(None).cast("binary").alias("e"))
    if len(al) > 1:
        n = solved.agg(F.sum("n")).first()[0] or 0
        part = losses(rows, solved, keyed, al, fit_intercept, n)
        found = found.unionByName(part.select(*keys, F.lit(None).cast("int").alias("p"), F.lit(None).cast("int").alias("d"), F.lit(None).cast("binary").alias("v"), "e"))

    def choose(t: pa.Table) -> pa.Table:
        out = []
        for at, first in groups(t, keys):
            own = [(t.column("v")[int(i)].as_py(), t.column("e")[int(i)].as_py(), int(i)) for i in at]
            raw, _, r = next(o for o in own if o[0] is not None)
            p, d = t.column("p")[r].as_py(), t.column("d")[r].as_py()
            loss = sum((np.frombuffer(e).reshape(len(al), d) for _, e, _ in own if e is not None), np.zeros((len(al), d)))
            coef, icpt, alpha = ridge_from_moments(*opened(raw, p, d), al, loss, fit_intercept, alpha_per_target)
            out.append((*keyed.of(t, first), coef.tolist(), icpt.tolist(), np.broadcast_to(alpha, len(coef)).tolist()))
        return keyed.table(out, ["coef", "intercept", "alpha"], [pa.list_(pa.list_(pa.float64())), pa.list_(pa.float64()), pa.list_(pa.float64())])

    return found.withColumn("__bin", _bin(keyed.bins, *keys)).groupBy("__bin").applyInArrow(choose, keyed.kinds + "coef array<array<double>>, intercept array<double>, alpha array<double>")

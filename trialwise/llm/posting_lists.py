"""Operator 13, approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample, by splits into clusters of like size until each is small; every vector is then put into the list of its nearest centroid, and
if it lies near a border into those of further ones as well. Centroids are few and are sent to every worker with a graph of their neighbours, which is
searched for the centroids near a vector. A query looks into the lists whose centroids are at most so many times as far as the nearest; lists and
the queries that look into them meet in bins of like size, and give their nearest by exact distances.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, freed, give_back, table

#: Distinct vectors aimed at in a list. Numbers in the sample that centroids are fitted on (32 MB), in all centroids (16 MB), and sampled vectors for each centroid at least.
LIST, SAMPLE_FLOATS, CENTROID_FLOATS, EACH = 96, 1 << 23, 1 << 22, 8
#: Lists that a vector is in at most, and how much farther than the nearest their centroids may be.
REPLICAS, BORDER = 4, 1.08
#: Centroids that a search keeps, for a vector to be put into lists and for a query; neighbours in the graph; nodes looked at in a step.
BEAM, WIDE, DEGREE, STEP = 16, 256, 16, 2
#: Lists looked into: those that hold so many times the wanted neighbours, and those whose centroids are at most so many times as far.
RATIO, ENOUGH = 1.2, 8
#: Rows of a list that one task compares, rows of a bin.
PIECE, ROWS = 8192, 16384
#: Queries audited, recall aimed at, and searches, each with twice the beam and twice the margin, before all lists are looked into.
AUDITED, RECALL, SEARCHES = 64, 0.95, 4


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y."""
    return np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T))


def _divided(x: np.ndarray, k: int, rng) -> np.ndarray:
    """A cluster of k for each row: rounds of means, in which a cluster's size adds to the distance from it."""
    centre, part = x[rng.choice(len(x), k, replace=False)].copy(), None
    for _ in range(8):
        d = _squares(x, centre)
        if part is not None:
            d = d + d.min(1).mean() * (np.bincount(part, minlength=k) * k / len(x) - 1) * 0.5
        part = d.argmin(1)
        for j in range(k):
            if (own := part == j).any():
                centre[j] = x[own].mean(0)
    return part


def fit_centroids(x: np.ndarray, target: float, seed: int = 13) -> np.ndarray:
    """Means of clusters of x, which is split until none has more than 1.5 times the target rows."""
    rng, todo, out = np.random.default_rng(seed), [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= 1.5 * target or len(rows) < 2:
            out.append(x[rows].mean(0))
            continue
        part = _divided(x[rows], k := max(2, min(16, int(np.ceil(len(rows) / target)))), rng)
        if np.bincount(part).max() == len(rows):
            part = np.arange(len(rows)) % k  # all alike: dealt out
        todo += [rows[part == j] for j in np.unique(part)]
    return np.array(out, np.float32)


def neighbour_graph(c: np.ndarray, degree: int = DEGREE, seed: int = 13) -> np.ndarray:
    """(centroids, degree) numbers: near neighbours, of which none is nearer to one taken before than to the centroid, those that have it as theirs, further near ones, and one by chance."""
    rng, n = np.random.default_rng(seed), len(c)
    near = np.empty((n, min(n - 1, 3 * degree)), np.int64)
    for a in range(0, n, 1024):
        d = _squares(c[a : a + 1024], c)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        own = np.argpartition(d, near.shape[1] - 1, 1)[:, : near.shape[1]]
        near[a : a + 1024] = np.take_along_axis(own, np.take_along_axis(d, own, 1).argsort(1), 1)
    links: list[dict] = [{} for _ in range(n)]
    for i in range(n):
        x = c[near[i]]
        between, mine, taken = _squares(x, x), _squares(c[i : i + 1], x)[0], []
        for j in range(len(x)):
            if len(taken) < degree * 3 // 4 and (between[j, taken] >= mine[j]).all():
                taken.append(j)
        links[i].update(dict.fromkeys(near[i, taken].tolist()))
    for i in range(n):
        for j in list(links[i]):
            if len(links[j]) < degree - 1:
                links[j][i] = None
    out = np.empty((n, degree), np.int32)
    for i in range(n):
        own = links[i] | dict.fromkeys(near[i, :degree].tolist())
        own = [*own][: degree - 1]
        out[i] = [*own, *rng.integers(0, n, degree - len(own))]
    return out


class Centroids:
    """Centroids of one vector length, and the graph that is searched for the nearest of a vector."""

    def __init__(self, x: np.ndarray):
        self.x, self.square = x, (x * x).sum(1)
        self.graph = neighbour_graph(x) if len(x) > 2 * BEAM else None
        self.entries = np.random.default_rng(13).permutation(len(x))[: max(BEAM, int(2 * len(x) ** 0.5))]

    def nearest(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the nearest centroids found, nearest first, and their distances: beam of each row, or all where there are few."""
        if self.graph is None or len(self.x) <= 2 * beam:
            d = _squares(q, self.x)
            order = d.argsort(1)[:, :beam]
            return order, np.sqrt(np.take_along_axis(d, order, 1))
        parts = [self._search(q[a : a + 1024], beam) for a in range(0, len(q), 1024)]
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, square = len(q), (q * q).sum(1)[:, None]
        width = min(beam, len(self.entries))
        d = _squares(q, self.x[self.entries])
        top = np.argpartition(d, width - 1, 1)[:, :width]
        ids, dist = np.full((n, beam), -1, np.int64), np.full((n, beam), np.inf, np.float32)
        ids[:, :width], dist[:, :width] = self.entries[top], np.take_along_axis(d, top, 1)
        done, rows = np.isinf(dist), np.arange(n)
        while len(rows):
            open_ = np.where(done[rows], np.inf, dist[rows])
            at = np.argpartition(open_, STEP - 1, 1)[:, :STEP]
            live = np.isfinite(np.take_along_axis(open_, at, 1))
            rows, at, live = rows[live.any(1)], at[live.any(1)], live[live.any(1)]
            if not len(rows):
                break
            done[rows[:, None], at] = True
            nodes = np.where(live, ids[rows[:, None], at], ids[rows[:, None], at[:, :1]])
            new = self.graph[nodes].reshape(len(rows), -1).astype(np.int64)
            far = self.square[new] + square[rows] - 2 * np.einsum("rnd,rd->rn", self.x[new], q[rows])
            all_ids, all_dist = np.concatenate([ids[rows], new], 1), np.concatenate([dist[rows], np.maximum(0, far)], 1)
            all_done = np.concatenate([done[rows], np.zeros(new.shape, bool)], 1)
            # one that is kept already comes first, and its copies are far away
            order = np.argsort(all_ids, 1, kind="stable")
            by = np.take_along_axis(all_ids, order, 1)
            again = np.zeros(by.shape, bool)
            again[:, 1:] = by[:, 1:] == by[:, :-1]
            np.put_along_axis(all_dist, order, np.where(again, np.inf, np.take_along_axis(all_dist, order, 1)), 1)
            best = np.argpartition(all_dist, beam - 1, 1)[:, :beam]
            ids[rows], dist[rows] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_dist, best, 1)
            done[rows] = np.take_along_axis(all_done, best, 1) | np.isinf(dist[rows])
        order = dist.argsort(1)
        return np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(dist, order, 1))

    def lists(self, v: np.ndarray, replicas: int, border: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every list a vector goes into: its nearest centroid's, first, and those of the next ones that are about as far."""
        near, d = (a[:, :replicas] for a in self.nearest(v, BEAM))
        taken = (d <= border * d[:, :1]) & (near >= 0)
        taken[:, 0] = True
        row, at = np.nonzero(taken)
        return row, near[row, at]


def _number(dim: int, lists: np.ndarray) -> np.ndarray:
    """A list's number among all lengths'."""
    return (np.int64(dim) << np.int64(32)) | lists.astype(np.int64)


def _rows(column) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows of it, their vectors)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    return [(int(d), at := np.flatnonzero(sizes == d), flat[starts[at][:, None] + np.arange(d)]) for d in np.unique(sizes)]


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(k, v): rows with a key whose vectors are there, not zero, and hold numbers alone."""
    kind = dict(rows.dtypes)[vector]
    own = rows.select(F.col(key).alias("k"), F.col(vector).cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return own.where(F.col("k").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


class PostingIndex:
    """Posting lists of a table's vectors. Equal vectors are one entry with the smallest of their keys, as many as any answer can hold."""

    def __init__(self, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, size: int = LIST, seed: int = 13):
        """Every usable row is in a list, or beyond the k + 1 smallest keys of its vector, where no answer holds it. k: the most neighbours that may be asked for."""
        self.spark, self.k, self.seed = rows.sparkSession, k, seed
        self.scratch = Scratch(self.spark, "postings")
        vectors = usable(rows, key, vector)
        self.kind = dict(vectors.dtypes)
        if not vectors.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            vectors = vectors.dropDuplicates(["k", "v"])
        vectors = vectors.withColumn("h", F.xxhash64("v"))
        first = F.row_number().over(Window.partitionBy("h", "v").orderBy("k"))
        own = vectors.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("h", "v").agg(F.sort_array(F.collect_list("k")).alias("keys"))
        self.classes = self.scratch.write(own.select("v", "keys"))
        self.centroids = self._fit(size)
        self.sent = self.spark.sparkContext.broadcast(self.centroids)
        self.postings = self.scratch.write(self._put())
        # a row for each list: as many as there are centroids, and one for each length that the sample lacks
        counts = self.postings.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.col("main").cast("long")).alias("main")).toArrow()
        self.sizes = {i: (n, m) for i, n, m in zip(*[counts.column(c).to_pylist() for c in ("list", "n", "main")])}
        self.counted = self.spark.sparkContext.broadcast(self.sizes)

    def _fit(self, size: int) -> dict[int, Centroids]:
        first = self.classes.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("numbers")).first()
        n, numbers = first["n"], first["numbers"] or 1
        wanted = min(n, SAMPLE_FLOATS * n // numbers) if n else 0
        by = F.pmod(F.xxhash64("v", F.lit(self.seed)), F.lit(1 << 30))
        # about SAMPLE_FLOATS numbers; the limit holds whatever chance does
        sample = self.classes.where(by < int((1 << 30) * min(1.0, wanted / max(n, 1)) + 1)).limit(2 * wanted + 1).select(F.col("v").cast("array<float>").alias("v")).toArrow()
        out, total = {}, max(sample.num_rows, 1)
        for d, at, x in _rows(sample.column("v")) if sample.num_rows else ():
            share = len(at) / total
            k = min(-(-n * share // size), CENTROID_FLOATS * share / d, len(at) / (EACH if len(at) < n * share * 0.9 else 1))
            out[d] = Centroids(fit_centroids(x.astype(np.float32), len(at) / max(1, k), self.seed))
        return out

    def _put(self) -> DataFrame:
        sent = self.sent

        def work(batches):
            for batch in batches:
                for d, at, x in _rows(batch.column("v")):
                    own = sent.value.get(d)
                    row, to = own.lists(x.astype(np.float32), REPLICAS, BORDER) if own else (np.arange(len(at)), np.zeros(len(at), np.int64))
                    main, rows = np.r_[True, row[1:] != row[:-1]], pa.array(at[row])
                    yield pa.RecordBatch.from_arrays([pa.array(_number(d, to)), pa.array(main), batch.column("keys").take(rows), batch.column("v").take(rows)], ["list", "main", "keys", "v"])

        return self.classes.select("keys", "v").mapInArrow(freed(work), f"list long, main boolean, keys array<{self.kind['k']}>, v {self.kind['v']}")

    def _probes(self, queries: DataFrame, k: int, beam: int, ratio: float, everything: bool) -> DataFrame:
        """(q, v, list, piece): the lists that each query looks into, and their pieces."""
        sent, counted = self.sent, self.counted

        def chosen(own: Centroids, d: int, x: np.ndarray):
            near, far = own.nearest(x.astype(np.float32), beam)
            sizes = np.array([counted.value.get(int(i), (0, 0))[1] for i in _number(d, np.arange(len(own.x)))])
            held = np.cumsum(np.where(near >= 0, sizes[near], 0), 1)
            # measured from the first that fills what an answer needs: a small tight list may be much nearer than any other
            enough = far[np.arange(len(far)), (held < ENOUGH * (k + 1)).sum(1).clip(max=far.shape[1] - 1)]
            takes = ((far <= ratio * enough[:, None]) | (held - sizes[near] < ENOUGH * (k + 1))) & (near >= 0)
            # what the beam holds may be too few for an answer: then all lists
            short = held[:, -1] < min(ENOUGH * (k + 1), sizes.sum())
            for i in range(len(x)):
                yield np.arange(len(own.x)) if everything or short[i] else near[i][takes[i]]

        def work(batches):
            for batch in batches:
                for d, at, x in _rows(batch.column("v")):
                    own, row, to, piece = sent.value.get(d), [], [], []
                    for i, lists in enumerate(chosen(own, d, x) if own else [np.zeros(1, np.int64)] * len(at)):
                        for j in _number(d, lists).tolist():
                            n = -(-counted.value.get(j, (0, 0))[0] // PIECE)
                            row += [at[i]] * n
                            to += [j] * n
                            piece += range(n)
                    rows = pa.array(np.array(row, np.int64))
                    yield pa.RecordBatch.from_arrays([batch.column("k").take(rows), batch.column("v").take(rows), pa.array(to, pa.int64()), pa.array(piece, pa.int64())], ["q", "v", "list", "piece"])

        return queries.select("k", "v").mapInArrow(freed(work), f"q {self.kind['k']}, v {self.kind['v']}, list long, piece long")

    def _meet(self, probes: DataFrame, k: int) -> DataFrame:
        """(q, key, score): of each query and piece of a list, the nearest by exact distances."""
        n = max(1, -(-sum(s for s, _ in self.sizes.values()) // ROWS))
        bin_ = F.pmod(F.xxhash64("list", "piece"), F.lit(n)).alias("bin")
        large = [(i, -(-s // PIECE)) for i, (s, _) in self.sizes.items() if s > PIECE]
        left = self.postings.select("list", "keys", "v").join(F.broadcast(probes.select("list").distinct()), "list", "left_semi")  # a row for each list
        if large:
            pieces = F.broadcast(self.spark.createDataFrame(large, "list long, pieces long"))
            left = left.join(pieces, "list", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("v"), "pieces"), F.lit(0)))
        else:
            left = left.withColumn("piece", F.lit(0).cast("long"))
        left = left.select(bin_, "list", "piece", "keys", "v")
        right = probes.select(bin_, "list", "piece", "q", F.col("v").alias("qv"))
        kind = self.kind["k"]

        def work(a: pa.Table, b: pa.Table) -> pa.Table:
            a, b = a.combine_chunks(), b.combine_chunks()
            groups: dict = {}
            for side, t in enumerate((a, b)):
                own = np.stack([t.column(c).to_numpy() for c in ("list", "piece")], 1)
                order = np.lexsort((own[:, 1], own[:, 0]))
                cut = np.flatnonzero(np.r_[True, (own[order][1:] != own[order][:-1]).any(1), True]) if len(own) else []
                for i, j in zip(cut[:-1], cut[1:]):
                    groups.setdefault(tuple(own[order[i]]), [None, None])[side] = order[i:j]
            found = []
            for mine, asked in groups.values():
                if mine is not None and asked is not None:
                    x, q = _rows(a.column("v").take(pa.array(mine)))[0][2], _rows(b.column("qv").take(pa.array(asked)))[0][2]
                    found += [(asked[i], mine[j], score) for i, j, score in near(q.astype(float), x.astype(float), k)]
            out = answers(found, b.column("q"), a.column("keys"), k)
            give_back()
            return pa.table(out, ["q", "key", "score"])

        return left.groupBy("bin").cogroup(right.groupBy("bin")).applyInArrow(work, f"q {kind}, key {kind}, score double")

    def _ranked(self, found: DataFrame, k: int) -> DataFrame:
        best = found.groupBy("q", "key").agg(F.min("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "key"))
        return best.withColumn("rank", rank).where(F.col("rank") <= k)

    def _exact(self, asked: pa.Table, k: int) -> DataFrame:
        """The nearest of a few queries by all vectors."""
        wanted = {d: (at, x.astype(float)) for d, at, x in _rows(asked.column("v"))} if asked.num_rows else {}
        kind, names = self.kind["k"], asked.column("k")

        def work(batches):
            for batch in batches:
                for d, at, x in _rows(batch.column("v")):
                    if d in wanted:
                        own, q = wanted[d]
                        found = [(own[i], at[j], score) for i, j, score in near(q, x.astype(float), k)]
                        yield pa.RecordBatch.from_arrays(answers(found, names, batch.column("keys"), k), ["q", "key", "score"])

        return self._ranked(self.classes.mapInArrow(freed(work), f"q {kind}, key {kind}, score double"), k)

    def search(self, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int | None = None, recall: float = RECALL, audited: int = AUDITED) -> DataFrame:
        """(query_id, rank, vec_id, score): the k nearest found of each query by Euclidean distance, nearest first, ties to the smaller key; all candidates where they are fewer.

        A query's own key is no candidate. Queries that are no usable vectors have no rows; neither have vectors of another length any in common. Rows that
        repeat a key are one query and one candidate, at the least distance of any of them. audited queries are compared with all vectors; while the
        share of their neighbours found is below recall, the search is widened, at last to all lists, which is exact. self.recall holds the last share. Empty tables: no rows.
        """
        k = k or self.k
        if k > self.k:
            raise ValueError("the index keeps the keys of equal vectors for fewer neighbours than that")
        asked = self.scratch.write(usable(queries, key, vector).select(F.col("k").cast(self.kind["k"]).alias("k"), F.col("v").cast(self.kind["v"]).alias("v")))
        sample = asked.orderBy(F.xxhash64("k", F.lit(self.seed)), "k").limit(audited)
        exact = self.scratch.write(self._exact(sample.toArrow(), k))
        wanted = exact.groupBy("q").agg(F.max("score").alias("far"), F.count("*").alias("n"))
        beam, margin = WIDE, RATIO - 1
        for step in range(SEARCHES + 1):
            probes = self.scratch.write(self._probes(asked, k, beam, 1 + margin, step == SEARCHES))
            found = self.scratch.write(self._ranked(self._meet(probes, k), k))
            seen = found.join(F.broadcast(wanted), "q").where("score <= far").groupBy("q", "n").agg(F.least(F.count("*"), F.max("n")).alias("got"))
            total = wanted.agg(F.sum("n")).first()[0] or 0
            self.recall = 1.0 if not total else (seen.agg(F.sum("got")).first()[0] or 0) / total
            self.scratch.drop(probes)
            if self.recall >= recall or step == SEARCHES:
                break
            self.scratch.drop(found)
            beam, margin = 2 * beam, 2 * margin
        return found.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("key").alias("vec_id"), "score")


def near(q: np.ndarray, x: np.ndarray, k: int):
    """(row of q, row of x, distance) arrays with the k + 1 nearest of x, one of which may be the query itself, and all that tie with them. Products choose, differences measure."""
    for a in range(0, len(q), 256):
        d = _squares(q[a : a + 256], x)
        slack = 1e-9 * ((q[a : a + 256] ** 2).sum(1) + (x * x).sum(1).max())
        bar = np.partition(d, k, 1)[:, k] + slack if d.shape[1] > k + 1 else np.full(len(d), np.inf)
        i, j = np.nonzero(d <= bar[:, None])
        i = i + a
        for c in range(0, len(i), 1 << 15):
            p, r = i[c : c + (1 << 15)], j[c : c + (1 << 15)]
            yield p, r, np.sqrt(((x[r] - q[p]) ** 2).sum(1))


def answers(found: list[tuple], names, keys, k: int) -> list[pa.Array]:
    """Columns (query, key, distance): of each query the k nearest other keys, each once. keys are lists."""
    names, keys = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (names, keys))
    i, j, score = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    own = keys.take(pa.array(j))
    sizes = own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    i, score, flat = np.repeat(i, sizes), np.repeat(score, sizes), own.flatten()
    key, name = flat.to_numpy(zero_copy_only=False), names.take(pa.array(i)).to_numpy(zero_copy_only=False)
    # each key once, at its least distance, and not the query's own
    order = np.lexsort((score, key, name))
    order = order[(np.r_[True, (name[order][1:] != name[order][:-1]) | (key[order][1:] != key[order][:-1])][: len(order)]) & (key[order] != name[order])]
    order = order[np.lexsort((key[order], score[order], name[order]))]
    first = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]][: len(order)])
    order = order[np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)])) < k]
    i, score, flat = i[order], score[order], flat.take(pa.array(order))
    return [names.take(pa.array(i)), flat, pa.array(score)]


def nearest(rows: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, **more) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which queries is true, among all rows: see PostingIndex."""
    return PostingIndex(rows, key, vector, k, **more).search(rows.where(queries), key, vector, k)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)

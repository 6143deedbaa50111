"""Pair search in two steps, shared by the similarity joins: rows that share a signature key form clusters, and clusters
are compared in tiles of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KeyFilter, Scratch, connected_components, freed, give_back

#: Cost of a tile, and of clusters that are packed into one bin; a row costs 1 and one more for every WEIGHT of its size, so that tiles of large rows have fewer.
TILE, SMALL, WEIGHT = 2048, 256, 1024
#: Bits of a key that the first count looks at: shorter rows, and a few chance hits that the exact count then drops.
SHORT = 40


def bins_for(cost: int, of: int = TILE) -> int:
    """Number of bins for so much cost: a bin's share stays that of a tile or two, whatever the input."""
    return max(64, -(-int(cost or 0) // of))


def clusters_by_keys(keyed: DataFrame, scratch: Scratch, meet=None) -> DataFrame:
    """(id, cluster) of rows (id, keys array<long>) that share a key with another, directly or over others.

    A first count, of shortened keys and combined before the shuffle, finds those that occur twice; only these are then dealt by key, with
    the ids: passed over by a bitmap where the keys are read, or beyond the bitmap's bound picked by a join. Each member of a key is
    tied to the key's least id only: a key of n rows gives n rows, not n^2.

    With meet, keyed has a column mark (binary) as well, and members of a key are tied only as meet(keys, ids, marks) says: it
    gets arrays sorted by key, without repeats, and yields pairs of ids that span what may be linked. Keys of more than TILE rows are tied
    as before, so no task gathers more of one key.
    """
    low = F.lit((1 << SHORT) - 1)
    short = keyed.select(F.explode("keys").alias("key")).select(F.col("key").bitwiseAND(low).alias("key"))
    repeated = scratch.write(short.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    wanted = KeyFilter(repeated)
    more = ["mark"] if meet and wanted.fits else []
    if wanted.fits:
        may = wanted.has()

        def work(batches):
            for batch in batches:
                column = batch.column("keys")
                flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
                at = np.repeat(np.arange(len(sizes)), sizes)
                hit = may(flat & ((1 << SHORT) - 1))
                at = pa.array(at[hit])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), pa.array(flat[hit]), *[batch.column(c).take(at) for c in more]], ["id", "key", *more])

        flat = keyed.select("id", "keys", *more).mapInArrow(freed(work), "id long, key long" + ", mark binary" * bool(more))
    else:
        flat = wanted.joined(keyed.select("id", F.explode("keys").alias("key")).withColumn("__short", F.col("key").bitwiseAND(low)), "__short").select("id", "key")
    flat = scratch.write(flat)
    shared = flat.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("n")).where("a <> z")
    if meet:

        def cells(t: pa.Table) -> pa.Table:
            key, ids = t.column("key").to_numpy(), t.column("id").to_numpy()
            order = np.lexsort((ids, key))
            order = order[np.r_[True, (key[order][1:] != key[order][:-1]) | (ids[order][1:] != ids[order][:-1])]]
            a, b = meet(key[order], ids[order], t.column("mark").combine_chunks().take(pa.array(order)))
            give_back()
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        # few keys can have so many rows: a table of known size, broadcast below the session's threshold
        hot = scratch.write(shared.where(F.col("n") > TILE).select("key", "a"))
        tagged = flat.join(hot, "key", "left")
        some = tagged.where("a is null").drop("a")
        if not more:
            # marks were not carried along: keys of one row go first, then each id's mark is fetched
            some = scratch.write(some.join(shared.where(F.col("n") <= TILE).select("key"), "key"))
            some = some.join(keyed.select("id", "mark").dropDuplicates(["id"]), "id")
        n = bins_for(flat.count(), 4 * TILE)
        alike = some.select(F.pmod(F.xxhash64("key"), F.lit(n)).alias("bin"), "key", "id", "mark").groupBy("bin").applyInArrow(cells, "a long, b long")
        edges = tagged.where("a <> id").select("a", F.col("id").alias("b")).union(alike).distinct()
    else:
        edges = flat.join(shared.select("key", "a"), "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    edges = scratch.write(edges)
    scratch.drop(flat, repeated)
    return connected_components(edges, scratch).toDF("id", "cluster")


def deal_tiles(members: DataFrame, scratch: Scratch, ratio: float = 0.0, slack: int = 0, tile: int | None = None, small: int | None = None) -> DataFrame:
    """(bin, cluster, pair, side, id): which task compares which rows, for members (cluster, id, size).

    A cluster is cut into tiles along size; two tiles meet where their sizes allow a link, that is where the smaller is at least
    ratio times the larger and at most slack below it (0: no such bound). side 0 rows are compared with side 1
    rows, side 2 rows (a tile with itself) with each other. Small clusters share a bin; there are as many bins as their cost asks for.
    """
    tile, small = tile or TILE, small or SMALL
    cost = (1 + F.floor(F.col("size") / WEIGHT)) * F.col("n")
    sizes = members.groupBy("cluster", "size").agg(F.count("*").alias("n")).withColumn("cost", cost)
    upto = Window.partitionBy("cluster").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("cluster")
    sizes = sizes.withColumns({"before": F.coalesce(F.sum("cost").over(upto), F.lit(0)), "all": F.sum("cost").over(whole), "parts": F.ceil(F.col("cost") / tile)})
    sizes = scratch.write(sizes.withColumn("t", F.when(F.col("all") <= tile, 0).otherwise(F.floor(F.col("before") / tile)).cast("long")))
    bins = bins_for(sizes.agg(F.sum("cost")).first()[0])
    placed = members.join(sizes, ["cluster", "size"]).withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id"), "parts")).otherwise(0))
    # sizes that fill tiles of their own must not share a number with the next ones
    placed = scratch.write(placed.select("cluster", "id", "size", "all", F.concat_ws(":", "t", F.when(F.col("parts") > 1, F.col("size")), F.when(F.col("parts") > 1, F.col("part"))).alias("tile")))
    tiles = placed.groupBy("cluster", "tile").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.max("all").alias("all"))
    a, b = tiles.select("cluster", "all", F.col("tile").alias("ta"), F.col("lo").alias("la"), F.col("hi").alias("ha")), tiles.select("cluster", F.col("tile").alias("tb"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    meet = (F.col("ta") <= F.col("tb")) & (F.col("ha") >= ratio * F.col("lb")) & (F.col("hb") >= ratio * F.col("la"))
    if slack:
        meet = meet & (F.col("ha") + slack >= F.col("lb")) & (F.col("hb") + slack >= F.col("la"))
    pairs = a.join(b, "cluster").where(meet)
    into = F.when(F.col("all") <= small, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.xxhash64("cluster", "ta", "tb"))
    pairs = pairs.select("cluster", "ta", "tb", into.alias("bin"), F.xxhash64("ta", "tb").alias("pair"))
    ends = F.when(F.col("ta") == F.col("tb"), F.array(F.struct(F.col("ta").alias("tile"), F.lit(2).alias("side")))).otherwise(F.array(F.struct(F.col("ta").alias("tile"), F.lit(0).alias("side")), F.struct(F.col("tb").alias("tile"), F.lit(1).alias("side"))))
    dealt = pairs.select("cluster", "bin", "pair", F.explode(ends).alias("e")).select("cluster", "bin", "pair", F.col("e.tile").alias("tile"), F.col("e.side").alias("side"))
    return dealt.join(placed, ["cluster", "tile"]).select("bin", "cluster", "pair", "side", "id")


def compare(dealt: DataFrame, link, schema: str) -> DataFrame:
    """Runs link(ids, side, payload) on every (cluster, pair) and gathers what it yields: tuples of the schema.

    dealt has bin, cluster, pair, side, id, payload. Rows that repeat an id in a pair are compared once.
    """

    names = [x.split()[0] for x in schema.split(", ")]

    def work(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        key = np.stack([t.column(c).to_numpy() for c in ("cluster", "pair")], 1)
        ids, side = t.column("id").to_numpy(), t.column("side").to_numpy()
        order = np.lexsort((ids, side, key[:, 1], key[:, 0]))
        key, ids, side = key[order], ids[order], side[order]
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
        payload, out = t.column("payload"), []
        for a, b in zip(cut, [*cut[1:], len(ids)]):
            own = np.arange(a, b)
            own = own[np.r_[True, (ids[own][1:] != ids[own][:-1]) | (side[own][1:] != side[own][:-1])]]
            if len(own) > 1:
                out += link(ids[own], side[own], payload.take(pa.array(order[own])))
        give_back()
        kinds = {"long": pa.int64(), "double": pa.float64()}
        return pa.table({n: pa.array([x[i] for x in out], kinds[s.split()[1]]) for i, (n, s) in enumerate(zip(names, schema.split(", ")))})

    return dealt.groupBy("bin").applyInArrow(work, schema)


class Sets:
    """Union-find over positions: pairs whose ends are joined already need no check."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def roots(self) -> np.ndarray:
        while (self.up != (nxt := self.up[self.up])).any():
            self.up = nxt
        return self.up

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)

"""Operator 8, embedding near-dedup by NN-descent.

A neighbour graph starts in the leaves of random hyperplane trees; then each round compares neighbours of neighbours,
where one of the two is new or its list has grown, keeps every vertex's nearest, and enlarges the lists of vertices all of whose neighbours are within the threshold. A
sample of vectors, half of them such as have links, is compared with all to audit recall; rounds go on, with fresh trees, while it is short,
and where it stays short all pairs are compared. Edges within the threshold are
kept; inside the components that they form, all pairs are computed exactly in tiles, for the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .clusters import Sets, bins_for, compare, deal_tiles
from .common import Scratch, connected_components, distinct_ids, freed, give_back, mix, table

#: Neighbours kept; trees at the start, and fresh ones after a short audit; aimed-at leaf size and largest block compared at once; rounds before all pairs are compared; recall aimed at.
NEIGHBOURS, TREES, FRESH, LEAF, BLOCK, ROUNDS, RECALL = 8, 8, 4, 48, 128, 6, 0.99
#: Vectors audited at most, and their components together (16 MB).
AUDITED, AUDIT_FLOATS = 4096, 1 << 22
#: Further planes for leaves above BLOCK, and how often these are split by planes through their own mean.
PLANES, SPLITS = 12, 3
#: Searching is done on half-precision vectors: what their rounding may take from a cosine.
MARGIN = 2e-3
#: Rows that a task of blocks gets, about.
ROWS = 16384


def prepare(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(k, unit array<double>): unit is null where a vector links with nothing."""
    rows = rows.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    kind = dict(rows.dtypes)["k"]

    def work(batches):
        for batch in batches:
            column = batch.column("v")
            lengths = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)  # nulls are NaN
            of = np.repeat(np.arange(len(lengths)), lengths)
            some = lengths > 0
            starts, top = (np.cumsum(lengths) - lengths)[some], np.zeros(len(lengths))
            if len(starts):
                top[some] = np.maximum.reduceat(np.abs(flat), starts)
            good = np.isfinite(top) & (top > 0)
            # scaled by the largest component first, so that squares neither overflow nor vanish
            with np.errstate(all="ignore"):
                x = flat / top[of]
                norm = np.sqrt(np.bincount(of, x * x, len(lengths)))
                x = x / norm[of] + 0.0  # no minus zeros
            ends = np.cumsum(np.r_[0, np.where(good, lengths, 0)]).astype(np.int32)
            unit = pa.ListArray.from_arrays(pa.array(ends), pa.array(x[good[of]]), mask=pa.array(~good))
            yield pa.RecordBatch.from_arrays([batch.column("k"), unit], ["k", "unit"])

    return rows.mapInArrow(freed(work), f"k {kind}, unit array<double>")


def _half(classes: DataFrame) -> DataFrame:
    """(id, dim, v): units as the bytes of half-precision numbers."""

    def work(batches):
        for batch in batches:
            column = batch.column("unit")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float16).tobytes(), np.cumsum(np.r_[0, column.value_lengths().to_numpy(zero_copy_only=False)]) * 2
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("dim"), pa.array([flat[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())], ["id", "dim", "v"])

    return classes.select("id", "dim", "unit").mapInArrow(freed(work), "id long, dim int, v binary")


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, dim).astype(np.float32)


def _by_dim(batch: pa.RecordBatch):
    """(length, rows of it, their vectors)."""
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield int(d), at, _matrix(batch.column("v").take(pa.array(at)), d)


def _centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of each length."""

    def work(batches):
        for batch in batches:
            for d, at, x in _by_dim(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int64)), pa.array(np.arange(d, dtype=np.int64)), pa.array(x.sum(0, dtype=np.float64)), pa.array(np.full(d, len(at), np.int64))], ["dim", "i", "s", "m"])

    # one row per component of the vectors
    sums = vectors.mapInArrow(work, "dim long, i long, s double, m long").groupBy("dim", "i").agg((F.sum("s") / F.sum("m")).alias("mean")).orderBy("dim", "i").collect()
    out: dict[int, list] = {}
    for r in sums:
        out.setdefault(r["dim"], []).append(r["mean"])
    return {d: np.array(v, np.float32) for d, v in out.items()}


def _tree_leaves(vectors: DataFrame, centres: dict[int, np.ndarray], n: int, leaf: int, trees: int, seed: int, scratch: Scratch) -> DataFrame:
    """(g, id): a group per leaf of each tree; the signs along fixed random directions from the mean say which.

    Leaves above BLOCK are split again by as many planes through their own mean as their size asks for; those of the first tree
    stay, to be dealt into blocks at random, so that tight groups side by side meet too.
    """
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))

    def work(batches):
        for batch in batches:
            for d, at, x in _by_dim(batch):
                ids, x = batch.column("id").take(pa.array(at)), x - centres[d]
                for t in range(trees):
                    along = x @ np.random.default_rng(seed * 1000 + t).standard_normal((d, bits + PLANES)).astype(np.float32)
                    code = ((along[:, :bits] > 0) * (1 << np.arange(bits))).sum(1) if bits else np.zeros(len(at), np.int64)
                    # the leaf's signs, the tree and the whole length, mixed into one number
                    g = mix(mix(np.array([d], np.uint64)) + (code * trees + t).astype(np.uint64)).view(np.int64)
                    p = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * PLANES, pa.int32()), pa.array(along[:, bits:].ravel(), pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), ids, p, pa.array(np.full(len(at), t == 0))], ["g", "id", "p", "first"])

    rows = scratch.write(vectors.mapInArrow(freed(work), "g long, id long, p array<float>, first boolean"))
    todo, done = rows.where("not first").select("g", "id", "p"), [rows.where("first").select("g", "id")]
    for _ in range(SPLITS):
        large = scratch.write(todo.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK))
        if large.isEmpty():
            break
        # leaves that are small enough take no further part
        tagged = todo.join(large, "g", "left")
        done.append(tagged.where("m is null").select("g", "id"))
        big = scratch.write(tagged.where("m is not null"))
        means = big.groupBy("g").agg(F.array(*[F.avg(F.get("p", F.lit(j))) for j in range(PLANES)]).alias("mean"))
        need = F.ceil(F.log2(F.col("m") / leaf))
        side = F.transform("p", lambda x, j: (j < need) & (x > F.get("mean", j)))
        todo = scratch.write(big.join(means, "g").select(F.xxhash64("g", side).alias("g"), "id", "p"))
    for part in [*done, todo.select("g", "id")][1:]:
        done[0] = done[0].union(part)
    return done[0]


def _joined(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that span what is linked inside a block, directly or over others of it."""
    root = np.arange(len(close))
    while ((low := np.minimum(root, np.where(close, root, len(close)).min(1))) != root).any():
        root = low
    by = np.argsort(root, kind="stable")
    same = root[by][1:] == root[by][:-1]
    return by[:-1][same], by[1:][same]


def _meet(groups: DataFrame, vectors: DataFrame, threshold: float, keep: int, step: int, scratch: Scratch) -> DataFrame:
    """(id, other, sim, tie) of rows (g, id, worst, new): of the pairs in a group of which one is new, the best keep of each row that beat its worst.

    Pairs with tie join what is linked inside a block, directly or over others of it; no block gives all its pairs.
    Groups larger than BLOCK are dealt into blocks by a hash of row and step, in which all are new. Vectors are joined to ids that have their block already.
    """
    groups = scratch.write(groups)
    counted = groups.groupBy("g").agg(F.count("*").alias("m"), F.max("new").alias("any")).where("any and m > 1")
    large = F.col("m") > BLOCK
    block = F.when(large, F.xxhash64("g", F.pmod(F.xxhash64("id", "g", F.lit(step)), F.ceil(F.col("m") / BLOCK)))).otherwise(F.col("g"))
    rows = scratch.write(groups.join(counted, "g").select(block.alias("g"), "id", "worst", (F.col("new") | large).alias("new")))
    scratch.drop(groups)
    n = bins_for(rows.count(), ROWS)

    def work(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        g, ids, worst, new, dim = (t.column(c).to_numpy() for c in ("g", "id", "worst", "new", "dim"))
        order = np.lexsort((~new, ids, g))
        order = order[np.r_[True, (g[order][1:] != g[order][:-1]) | (ids[order][1:] != ids[order][:-1])]]
        g, ids, worst, new, dim, out = g[order], ids[order], worst[order], new[order], dim[order], []
        cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True]) if len(g) else np.array([0])
        column = t.column("v").combine_chunks().take(pa.array(order))
        for a, b in zip(cut[:-1], cut[1:]):
            if b - a < 2 or (dim[a:b] != dim[a]).any():
                continue
            x, fresh = _matrix(column.slice(a, b - a), dim[a]), new[a:b]
            s = x @ x.T
            s[~(fresh[:, None] | fresh)] = -2
            np.fill_diagonal(s, -2)
            k = min(keep, b - a - 1)
            bar = np.partition(s, -k, 1)[:, -k]
            close = s >= threshold - MARGIN
            i, j = np.nonzero((s >= bar[:, None]) & (s > worst[a:b, None]) & (s > -2))
            p, q = _joined(close) if close.any() else (i[:0], j[:0])
            i, j, tie = np.r_[i, p], np.r_[j, q], np.r_[np.zeros(len(i), bool), np.ones(len(p), bool)]
            out.append((ids[a + i], ids[a + j], s[i, j], tie))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, bool)]
        give_back()
        return pa.table({"id": pa.array(cols[0], pa.int64()), "other": pa.array(cols[1], pa.int64()), "sim": pa.array(cols[2].astype(np.float32), pa.float32()), "tie": pa.array(cols[3])})

    rows = rows.join(vectors, "id").select(F.pmod(F.xxhash64("g"), F.lit(n)).alias("bin"), "g", "id", "worst", "new", "dim", "v")
    return rows.groupBy("bin").applyInArrow(work, "id long, other long, sim float, tie boolean")


def _best(found: DataFrame, size: DataFrame | None, keep: int) -> DataFrame:
    """The nearest of each id, as many as its list may hold (r <= k), and whatever ties; born is the step that first brought a pair."""
    found = found.groupBy("id", "other").agg(F.max("sim").alias("sim"), F.max("tie").alias("tie"), F.min("born").alias("born"))
    if size is not None:
        found = found.join(size, "id", "left").withColumn("k", F.coalesce("k", F.lit(keep)))
    else:
        found = found.withColumn("k", F.lit(keep))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "other"))
    return found.withColumn("r", rank).where("r <= k or tie").select("id", "other", "sim", "k", "r", "tie", "born")


def _sample(own: DataFrame, audited: int, seed: int) -> DataFrame:
    """Half of the vectors to audit from all, half from those that have found links."""
    by = F.xxhash64("id", F.lit(seed))
    return own.orderBy(by).limit(audited // 2).union(own.where("linked").orderBy(by).limit(audited - audited // 2)).dropDuplicates(["id"])


def _units(batch: pa.RecordBatch):
    """(length, rows of it, their unit vectors in double precision)."""
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield int(d), at, batch.column("unit").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _audit(classes: DataFrame, component: DataFrame, threshold: float, audited: int, seed: int, scratch: Scratch) -> tuple[float | None, int, DataFrame]:
    """Of sampled vectors that have links, compared with all others: the mean share of links whose ends the edges join (None if none has any); how many have links; and what the edges do not join.

    Single precision finds what may be a link, and double precision says whether it is one: links at the very threshold count as well.
    """
    own = classes.join(component.toDF("id", "c"), "id", "left").select("id", F.col("c").isNotNull().alias("linked"), F.coalesce("c", "id").alias("c"), "dim", "unit")
    asked = _sample(own, audited, seed).toArrow().combine_chunks()
    asked = asked.to_batches()[0] if asked.num_rows else None
    blocks = {d: (asked.column("id").to_numpy()[at], asked.column("c").to_numpy()[at], x) for d, at, x in _units(asked)} if asked else {}

    def work(batches):
        for batch in batches:
            ids, c = batch.column("id").to_numpy(), batch.column("c").to_numpy()
            for d, at, y in _units(batch):
                if d not in blocks:
                    continue
                own, own_c, x = blocks[d]
                for p in range(0, len(x), 1024):
                    i, j = np.nonzero(x[p : p + 1024].astype(np.float32) @ y.T.astype(np.float32) >= threshold - 1e-5)
                    linked = np.concatenate([(x[i[q : q + 16384] + p] * y[j[q : q + 16384]]).sum(1) >= threshold for q in range(0, len(i), 16384)]) if len(i) else np.zeros(0, bool)
                    i, j = i[linked] + p, at[j[linked]]
                    other = own[i] != ids[j]
                    i, j = i[other], j[other]
                    joined = own_c[i] == c[j]
                    n, ok = np.bincount(i, minlength=len(x)), np.bincount(i[joined], minlength=len(x))
                    some, missed = np.flatnonzero(n), np.unique(np.stack([own_c[i], c[j]], 1)[~joined], axis=0)
                    zero = np.zeros(len(missed), np.int64)
                    cols = (own[some], missed[:, 0]), (own[some], missed[:, 1]), (n[some], zero), (ok[some], zero)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x_).astype(np.int64)) for x_ in cols], ["a", "b", "n", "ok"])

    found = scratch.write(own.mapInArrow(freed(work), "a long, b long, n long, ok long"))
    each = found.where("n > 0").groupBy("a").agg((F.sum("ok") / F.sum("n")).alias("share"))
    seen = each.agg(F.count("*").alias("n"), F.avg("share").alias("share")).first()
    return seen["share"], seen["n"], found.where("n = 0").select("a", "b")


def count_links(threshold: float):
    """Links and their number inside a tile pair, exactly: payload is (weight, unit vector...)."""

    def link(ids, side, payload):
        lengths = payload.combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if isinstance(payload, pa.ChunkedArray) else payload.value_lengths().to_numpy(zero_copy_only=False)
        flat = (payload.combine_chunks() if isinstance(payload, pa.ChunkedArray) else payload).flatten().to_numpy(zero_copy_only=False)
        ends, out = np.cumsum(np.r_[0, lengths]), []
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            x = np.stack([flat[ends[i] : ends[i + 1]] for i in at])
            w, x, own, s = x[:, 0], x[:, 1:], ids[at], side[at]
            a, b = (np.arange(len(at)),) * 2 if s[0] == 2 else (np.flatnonzero(s == 0), np.flatnonzero(s == 1))
            if not len(a) or not len(b):
                continue
            links = x[a] @ x[b].T >= threshold
            if s[0] == 2:
                np.fill_diagonal(links, False)
            here, first = links @ w[b], np.where(links.any(1), links.argmax(1), -1)
            counts = dict(zip(own[a].tolist(), here.tolist()))
            if s[0] != 2:
                counts.update(zip(own[b].tolist(), (w[a] @ links).tolist()))
            # edges that span what is linked here: each row to its first partner, then partners of rows that a partner shares
            joined, span = Sets(len(at)), []
            for i in range(len(a)):
                for j in np.flatnonzero(links[i]) if first[i] >= 0 else ():
                    p, q = joined.find(int(a[i])), joined.find(int(b[j]))
                    if p != q:
                        joined.join(p, q)
                        span.append((int(own[a[i]]), int(own[b[j]]), 0))
                        if len(span) == len(at) - 1:
                            break
                if len(span) == len(at) - 1:
                    break
            out += [(i, i, int(n)) for i, n in counts.items() if n] + span
        return out

    return link


def _number(unit: Column, seed: int) -> Column:
    return F.xxhash64(unit, F.lit(seed))


def _classes(units: DataFrame, seed: int) -> DataFrame:
    """(id, w, least, unit, dim): a row per direction. Only the key and the number w are gathered; the vector is that of any row, as they are equal."""
    return units.where("unit is not null").groupBy(_number(F.col("unit"), seed).alias("id"), "unit").agg(F.count("*").alias("w"), F.min("k").alias("least")).select("id", "w", "least", "unit", F.size("unit").alias("dim"))


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS, recall: float = RECALL, seed: int = 8, audited: int = AUDITED) -> DataFrame:
    """(key, n_links, component_id, kept, recall, audited): one row per row of rows. recall is the last audit's, of so many audited vectors that have links; null if none has.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors
    of different lengths. Equal directions are compared once, with their number as weight; each of n equal rows has the n - 1
    others as links. Null keys are rows; a component's id is its least key. Rows that repeat a key are vectors of their own. Empty table: no rows. Other columns are not read.
    """
    scratch = Scratch(rows.sparkSession, "vectors")
    units = scratch.write(prepare(rows, key, vector))
    # 64 bits stand for a direction in what follows: with a number that keeps all apart
    for mark in range(8):
        classes = scratch.write(_classes(units, mark))
        if distinct_ids(classes, "id"):
            break
    vectors = scratch.write(_half(classes))
    n, centres = vectors.count(), _centres(vectors)
    # an audit's vectors are held by the driver and each worker
    audited = min(audited, max(64, AUDIT_FLOATS // max(centres, default=1)))
    low = F.lit(-2.0).cast("float")

    def leaves(trees: int, step: int, own: Scratch) -> DataFrame:
        return _tree_leaves(vectors, centres, n, LEAF, trees, seed + step, own).select("g", "id", low.alias("worst"), F.lit(True).alias("new"))

    def close_ends(g: DataFrame) -> DataFrame:
        # whatever is within the threshold and has met in a block is joined by that block's ties
        return g.where("tie").select(F.col("id").alias("a"), F.col("other").alias("b"))

    # many trees: half of a list from each is enough to start with. What a round makes on its way goes with it
    own = Scratch(rows.sparkSession, "round")
    pairs = scratch.write(_best(_meet(leaves(TREES, 0, own), vectors, threshold, max(1, neighbours // 2), 0, own).withColumn("born", F.lit(0)), None, neighbours))
    own.remove()
    # lists steer the search; what was linked in any round stays linked
    edges, before, short, share, seen = close_ends(pairs), -1, False, None, 0
    for step in range(1, rounds + 2):
        graph = pairs.where("r <= k")
        links = graph.where(F.col("sim") >= threshold - MARGIN).count()
        # the forest's graph is refined once at least, so nothing is to be audited before that
        if step > 1 and (links <= 1.01 * before or step > rounds or short):
            component = scratch.write(connected_components(edges, scratch))
            share, seen, missed = _audit(classes, component, threshold, audited, step, scratch)
            # where neither the found links nor the sample hold a link, there is nothing to look for
            short = share is not None and share < recall
            edges = component.toDF("a", "b").union(missed)
            if not short:
                component = scratch.write(connected_components(edges, scratch)) if not missed.isEmpty() else component
                break
            if step > rounds:
                # recall stays short: all pairs are compared
                component, share = vectors.select("id", F.lit(0).cast("long")), 1.0
                break
        before, own = links, Scratch(rows.sparkSession, "round")
        worst = graph.groupBy("id").agg(F.count("*").alias("m"), F.max("k").alias("k"), F.min("sim").alias("worst"))
        # a list is saturated when it is full and all in it are within the threshold: it may then hold twice as many
        saturated = (F.col("m") >= F.col("k")) & (F.col("worst") >= threshold)
        worst = own.write(worst.select("id", F.when(saturated, 2 * F.col("k")).otherwise(F.col("k")).alias("k"), F.when(saturated | (F.col("m") < F.col("k")), low).otherwise(F.col("worst")).cast("float").alias("worst"), saturated.alias("grown")))
        # a vertex's group: itself, its neighbours, and those whose neighbour it is; a pair of which neither is new has met before
        new = F.col("born") == step - 1
        ends = F.array(F.struct(F.col("id").alias("g"), F.col("other").alias("id"), new.alias("new")), F.struct(F.col("other").alias("g"), F.col("id").alias("id"), new.alias("new")), F.struct(F.col("id").alias("g"), F.col("id").alias("id"), F.lit(False).alias("new")))
        ties = graph.select(F.explode(ends).alias("e")).groupBy("e.g", "e.id").agg(F.max("e.new").alias("new"))
        groups = ties.join(worst.select("id", "worst", "grown"), "id", "left").select("g", "id", F.coalesce("worst", low).alias("worst"), (F.col("new") | F.coalesce("grown", F.lit(False))).alias("new"))
        if short:
            groups = groups.union(leaves(FRESH, step, own).drop("worst").join(worst.select("id", "worst"), "id", "left").select("g", "id", F.coalesce("worst", low), "new"))
        found = _meet(groups, vectors, threshold, neighbours, step, own).withColumn("born", F.lit(step)).union(graph.select("id", "other", "sim", F.lit(False), "born"))
        after = scratch.write(_best(found, worst.select("id", "k"), neighbours))
        more = scratch.write(edges.union(close_ends(after)).distinct())
        scratch.drop(pairs, edges)
        own.remove()
        pairs, edges = after, more
    members = component.toDF("id", "cluster").join(classes.select("id", "unit", "w", "dim"), "id")
    dealt = scratch.write(deal_tiles(members.select("cluster", "id", F.col("dim").cast("long").alias("size")), scratch))
    payload = members.select("id", F.concat(F.array(F.col("w").cast("double")), "unit").alias("payload"))
    found = scratch.write(compare(dealt.join(payload, "id"), count_links(threshold), "a long, b long, n long"))
    counts = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    final = scratch.write(connected_components(found.where("a <> b").select("a", "b"), scratch)).toDF("id", "root")
    known = classes.select("id", "w", "least").join(counts, "id", "left").join(final, "id", "left").withColumn("root", F.coalesce("root", "id"))
    known = scratch.write(known.select("id", "root", "least", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links")))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    out = units.select("k", F.when(F.col("unit").isNotNull(), _number(F.col("unit"), mark)).alias("id")).join(known.join(least, "root").select("id", "n_links", "component_id"), "id", "left")
    component_id = F.when(F.col("id").isNull(), F.col("k")).otherwise(F.col("component_id"))
    return out.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("k") == component_id, F.lit(True)).alias("kept"), F.lit(share).cast("double").alias("recall"), F.lit(int(seen)).cast("long").alias("audited"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).drop("recall", "audited")

"""Operator 4, n-gram Jaccard join.

Shingles hash into groups. A document's group counts are a point; an R-tree over points bounds the overlap of a query
with whatever lies in a node's box by the sum of coordinate minima, and pairs that survive are verified on the shingle
sets. One tree over the corpus would prune next to nothing (the upper corners of boxes over texts of like length hold almost any point:
README), so trees stand in cells: two sets within the threshold differ in at most d
shingles, so of any d + 1 non-empty hash groups of one, one at least has the same content in the other, and
documents that share a group's content are in one cell. Cells' surviving pairs form clusters, verified in tiles by trees again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .clusters import Sets, clusters_by_keys, compare, deal_tiles
from .common import KeyFilter, Scratch, among, connected_components, freed, mix, table, text_of

#: Coordinates of a point, and entries of a tree's node. A mark is the set's size and its point, in 16 bits a coordinate: FULL, and so any count, where one does not fit.
GROUPS, FAN, FULL = 32, 16, 65535
U = np.uint64


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: A-Z lower-cased, words between ASCII white space; fewer words than size are one shingle."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.empty(0, U)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, U(n))
    for i in range(n):
        h = mix(h * U(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def digest(h: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    if not len(h):
        return 0, 0
    return int(mix(h).sum(dtype=U).view(np.int64)), int(mix(h ^ U(0xD6E8FEB86659FD93)).sum(dtype=U).view(np.int64))


def most_apart(n: int, percent: int) -> int:
    """Most shingles that a set of n and another can differ in when 100 * intersection >= percent * union."""
    return (100 - percent) * n // percent


def groups(n: int, percent: int) -> list[int]:
    """Numbers of hash groups for a set of n: from a row of numbers that grow by 1.3, the first that leaves few enough shingles in a group,
    and those on to the one of the largest set that a link allows. So the number of the larger of two linked sets is among the smaller one's."""
    most, m = (4.3 if percent >= 85 else 2.4), 4.0
    while int(m) * most < n:
        m *= 1.3
    out = [int(m)]
    while out[-1] * most < n * 100 // percent:
        m *= 1.3
        out.append(int(m))
    return out


def least_in_group(m: int, percent: int) -> int:
    """Shingles that a group's content needs to count, by number of groups. Contents of one shingle meet by chance; where groups
    are many enough, d + 1 of two or three shingles are sure to be there but for rare sets, which fall back on single shingles."""
    if m < 64:
        return 1
    return 3 if m >= 400 and percent >= 85 else 2


def group_keys(h: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the contents of hash groups: the first d + 1 that hold enough shingles, in the order of groups.

    Of two linked sets, the one whose list ends first has d + 1 such groups in there, at most d of them touched; one that is not
    touched has the same content, so the same size, in the other. Should groups not suffice, single
    shingles follow in order as groups of their own; a shingle then touches two, so 2 d + 1 are taken.
    A set takes part in every number of groups that a partner, at most 100 / percent times as large, may have. A
    set that has no room for a difference is linked only to its equals, and needs no keys.
    """
    n, out = len(h), []
    d = most_apart(n, percent)
    if d == 0:
        return np.empty(0, np.int64)
    for m in groups(n, percent):
        # the upper half of a hash says which group, so sorted hashes are sorted by group
        group = (h >> U(32)) * U(m) >> U(32)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        content = np.add.reduceat(mix(h ^ U(m)), starts)
        enough = np.diff(np.r_[starts, n]) >= least_in_group(m, percent)
        keys = mix(content + (group[starts] << U(20)) + U(m))[enough][: d + 1]
        out.append(keys)
        if len(keys) <= d:
            out.append(mix(np.sort(mix(h + U(m)))[: 2 * d + 1 - len(keys)]))
    return np.concatenate(out).view(np.int64)


class CountTree:
    """An R-tree over count vectors, packed by set size and then by the coordinates that vary most."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((points[:, points.var(0).argmax()], sizes)) if len(points) > FAN else np.arange(len(points))
        self.levels, self.order = [(points[order], sizes[order], sizes[order])], order
        while len(self.levels[-1][0]) > FAN:
            high, small, large = self.levels[-1]
            cut = np.arange(0, len(high), FAN)
            self.levels.append((np.maximum.reduceat(high, cut), np.minimum.reduceat(small, cut), np.maximum.reduceat(large, cut)))

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Positions of points whose bound allows a link: overlap <= sum of minima of coordinates (for a box, with its upper corner)."""
        at = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            high, small, large = self.levels[k]
            bound = np.minimum(high[at], point).sum(1)
            # 100 I >= percent (a + b - I)
            at = at[((100 + percent) * bound >= percent * (size + small[at])) & (100 * large[at] >= percent * size) & (100 * size >= percent * small[at])]
            if k:
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                at = at[at < len(self.levels[k - 1][0])]
        return self.order[at]


def count_vector(h: np.ndarray) -> np.ndarray:
    return np.bincount(((h >> U(8)) & U(GROUPS - 1)).astype(np.int64), minlength=GROUPS)


def mark_of(h: np.ndarray) -> bytes:
    """Size and point of a set. A point that does not fit is FULL throughout, which is read as more than any count: its minima are the other's counts, so it bounds nothing it should not."""
    point = count_vector(h)
    return len(h).to_bytes(8, "little") + (point if point.max() < FULL else np.full(GROUPS, FULL)).astype(np.uint16).tobytes()


def read_marks(marks) -> tuple[np.ndarray, np.ndarray]:
    """Points and sizes."""
    raw = np.frombuffer(b"".join(marks.to_pylist()), np.uint8).reshape(-1, 8 + 2 * GROUPS)
    points = np.ascontiguousarray(raw[:, 8:]).view(np.uint16).astype(np.int64)
    return np.where(points == FULL, 1 << 40, points), np.ascontiguousarray(raw[:, :8]).view(np.int64)[:, 0]


def spanning(m: int, joined: Sets):
    """Positions to search from, of 0 to m - 1, so that whatever is linked gets joined.

    A link is found from either end, so what has joined the component of one fixed position needs no search of its own: a link out of
    it is found from outside. The fixed one is the member of the largest component among three that are searched first.
    """
    seeds = sorted({0, m // 2, m - 1})
    yield from seeds
    roots = np.array([joined.find(i) for i in range(m)])
    fixed = max(seeds, key=lambda i: (roots == roots[i]).sum())
    for i in range(m):
        if i not in seeds and joined.find(i) != joined.find(fixed):
            yield i


def meet_points(percent: int):
    """Ties members of a key whose count vectors allow a link, in a tree per key; of pairs joined over others already, none."""

    def meet(keys, ids, marks):
        points, sizes = read_marks(marks)
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        n = np.diff(np.r_[cut, len(keys)])
        two = cut[n == 2]  # by far the most: a tree of one leaf each, searched all at once
        bound = np.minimum(points[two], points[two + 1]).sum(1)
        two = two[(100 + percent) * bound >= percent * (sizes[two] + sizes[two + 1])]
        a, b = [ids[two]], [ids[two + 1]]
        for start, m in zip(cut[n > 2], n[n > 2]):
            own = slice(start, start + m)
            tree, joined, x, y = CountTree(points[own], sizes[own]), Sets(m), [], []
            for i in spanning(m, joined):
                for j in tree.search(points[start + i], sizes[start + i], percent):
                    if joined.find(i) != joined.find(int(j)):
                        joined.join(i, int(j))
                        x.append(ids[start + i]), y.append(ids[start + j])
            a.append(np.array(x, np.int64)), b.append(np.array(y, np.int64))
        return np.concatenate(a), np.concatenate(b)

    return meet


def link_sets(percent: int):
    def link(ids, side, payload):
        sets = [np.asarray(x.values.to_numpy(zero_copy_only=False)).view(U) for x in payload]
        sizes = np.array([len(x) for x in sets])
        points = np.stack([count_vector(x) for x in sets])
        ask, among = (np.arange(len(ids)),) * 2 if side[0] == 2 else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        tree, joined, out = CountTree(points[among], sizes[among]), Sets(len(ids)), []
        for i in spanning(len(ids), joined) if side[0] == 2 else ask:
            near = among[tree.search(points[i], sizes[i], percent)]
            root = joined.find(i)
            for j in near[joined.roots()[near] != root]:
                if joined.find(j) != joined.find(i):
                    same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * same >= percent * (sizes[i] + sizes[j] - same):
                        joined.join(i, j)
                        out.append((int(ids[i]), int(ids[j])))
        return out

    return link


def _shingled(rows: DataFrame, size: int, percent: int, wanted: KeyFilter | None = None) -> DataFrame:
    """rows (k, h, t) to (k, h, n, d1, d2, keys, mark); with wanted, those alone whose h may be wanted, to (k, h, n, d1, d2, sets)."""
    kind, sets_only = dict(rows.dtypes)["k"], wanted is not None
    may = wanted.has() if sets_only and wanted.fits else None
    if sets_only and not wanted.fits:
        rows = wanted.joined(rows, "h")

    def work(batches):
        for batch in batches:
            if may:
                batch = batch.filter(pa.array(may(batch.column("h").to_numpy())))
            column = batch.column("t")
            for a, b in slices(pc.utf8_length(column).to_pylist()):
                sets = [shingle_set(t, size) for t in column.slice(a, b - a).to_pylist()]
                marks = [digest(h) for h in sets]
                lists = [h.view(np.int64) if sets_only else group_keys(h, percent) for h in sets]
                ends = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
                vectors = [] if sets_only else [pa.array(list(map(mark_of, sets)), pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k").slice(a, b - a), batch.column("h").slice(a, b - a), pa.array([len(h) for h in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists), pa.int64())), *vectors],
                    ["k", "h", "n", "d1", "d2", *(["sets"] if sets_only else ["keys", "mark"])],
                )

    return rows.select("k", "h", "t").mapInArrow(freed(work), f"k {kind}, h long, n long, d1 long, d2 long, {'sets array<long>' if sets_only else 'keys array<long>, mark binary'}")


def link_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """(key, n_shingles, class_id, component_id): one row per row of docs, linked where 100 * intersection >= percent * union.

    Sets are compared once, whatever the number of documents that have them; class_id is the least key of those, and
    component_id the least key reachable by links. Documents without words, and null texts, are linked with
    nothing: their ids are their own keys. Null keys are rows like others; a component of them alone has a null id. Rows that
    repeat a key are judged each by its own text. Other columns are not read. Empty table: no rows. percent is 50 to 100.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(key)).alias("h"), text_of(text).alias("t"))
    keyed = scratch.write(_shingled(rows, size, percent))
    same = ["n", "d1", "d2"]
    marked = scratch.write(keyed.select("k", *same))
    # 64 bits stand for the 128 of a class in what follows: with a seed that keeps all classes apart
    for seed in range(8):
        number, whole = F.xxhash64(*same, F.lit(seed)).alias("id"), F.struct(*same)
        classes = marked.where("n > 0").groupBy(number).agg(F.min("k").alias("least"), F.min(whole).alias("s"), (F.min(whole) != F.max(whole)).alias("two"))
        classes = scratch.write(classes.select("id", "least", "s.*", "two"))
        if classes.where("two").isEmpty():
            break
        scratch.drop(classes)
    classes = classes.drop("two")
    # keys are long and stay where they are: a bitmap lets those of each class's least document through, and by chance a copy's
    first = KeyFilter(classes.select(F.xxhash64("least").alias("h")))
    firsts = among(keyed.where("n > 0").select("h", number, "keys", "mark"), "h", first).drop("h")
    near = scratch.write(clusters_by_keys(firsts, scratch, meet_points(percent)))
    scratch.drop(keyed)
    members = near.join(classes.select("id", *same, "least"), "id")
    dealt = scratch.write(deal_tiles(members.select("cluster", "id", F.col("n").alias("size")), scratch, percent / 100))
    # each class's places in the tiles go with its set, so that sets are dealt twice at most
    places = dealt.groupBy("id").agg(F.collect_list(F.struct("bin", "cluster", "pair", "side")).alias("places"))
    # the sets of clustered classes alone are made again, each from the document with the least key; texts are passed over where they are read
    wanted = members.join(places, "id").select(F.col("least").alias("k2"), F.xxhash64("least").alias("h2"), "id", "places", *[F.col(c).alias(f"{c}2") for c in same])
    wanted = scratch.write(wanted)
    again = _shingled(rows, size, percent, KeyFilter(wanted.select("h2")))
    sets = again.join(wanted, F.col("k").eqNullSafe(F.col("k2")) & (F.col("n") == F.col("n2")) & (F.col("d1") == F.col("d12")) & (F.col("d2") == F.col("d22")))
    sets = sets.select("id", F.col("sets").alias("payload"), F.explode("places").alias("p"))
    edges = scratch.write(compare(sets.select("p.*", "id", "payload"), link_sets(percent), "a long, b long"))
    scratch.drop(dealt, wanted)
    component = connected_components(edges, scratch)
    rooted = classes.join(component.select(F.col("node").alias("id"), "component"), "id", "left").select(*same, "least", F.coalesce("component", "id").alias("root"))
    rooted = scratch.write(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "root").select(*same, F.col("least").alias("class_id"), "component_id")
    out = marked.select("k", *same).join(known, same, "left")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("k")).alias("class_id"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("k")).alias("component_id"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")

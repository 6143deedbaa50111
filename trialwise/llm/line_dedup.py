"""Operator 10, line dedup: of lines within a few edits of each other, the corpus keeps the first.

Segment-partition edit join: a line is split into edits + 1 segments; a line within that many edits has one of them unchanged,
at a place that the lengths bound. Each line probes the segment index of every length down to edits below its own with
the few substrings that can matter; lines that meet form clusters, and inside tiles of clusters the same
index gives candidates, verified with a banded bit-parallel edit distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .clusters import Sets, clusters_by_keys, compare, deal_tiles
from .common import KeyFilter, Scratch, connected_components, freed, mix, table, text_of

#: Edits between copies; characters, or words and bytes, a line must have for copies with edits: shorter ones are near each other by chance, and only equal ones count.
EDITS, LEAST_WORDS, LEAST_CHARS = 2, 5, 20


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 nearly even segments of a line of this length; the last ones are longer."""
    base, more = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        n = base + (i >= edits + 1 - more)
        out.append((at, n))
        at += n
    return out


def probes(line, edits: int):
    """(length, segment number, substring) for the segment index of each length from len(line) - edits to len(line).

    A substring can stand for segment i only if at most i edits lie before it and at most edits - i after; with the
    line's own length and no shift it is the line's own segment.
    """
    n = len(line)
    for length in range(max(n - edits, edits + 1), n + 1):
        delta = n - length
        for i, (start, m) in enumerate(segments(length, edits)):
            low = max(start - i, start + delta - (edits - i), 0)
            high = min(start + i, start + delta + (edits - i), n - m)
            for p in range(low, high + 1):
                yield length, i, line[p : p + m]


#: An odd multiplier and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def lines_keys(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every line's probes, one line after another and each once in a line, and how many each line has.

    Substrings' hashes are differences of running sums of characters times powers of an odd number, brought back to the substring's start
    by powers of its inverse; so all lines' are made at once. Chance hits cost a comparison and no more.
    """
    U = np.uint64
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U) + U(1)
    up, down = np.full(len(chars) + 1, BASE, U), np.full(len(chars) + 1, INVERSE, U)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    upto, start = np.r_[U(0), np.cumsum(chars * up[:-1])], np.cumsum(n) - n
    columns, there = [], []
    for delta in range(edits + 1):
        length = n - delta
        base, more = np.divmod(length, edits + 1)
        for i in range(edits + 1):
            m, at = base + (i >= edits + 1 - more), i * base + np.maximum(0, i - (edits + 1 - more))
            for shift in range(max(-i, delta - (edits - i)), min(i, delta + (edits - i)) + 1):
                p = at + shift
                fits = (length > edits) & (p >= 0) & (p + m <= n)
                a = np.where(fits, start + p, 0)
                z = np.where(fits, a + m, 0)
                h = (upto[z] - upto[a]) * down[a] + ((length * 64 + i).astype(U) + U(1)) * U(0xD6E8FEB86659FD93)
                columns.append(mix(h))
                there.append(fits)
    keys, there = np.stack(columns, 1), np.stack(there, 1)
    keys[~there] = U(2**64 - 1)
    keys = np.sort(keys, 1)
    keep = keys != U(2**64 - 1)
    keep[:, 1:] &= keys[:, 1:] != keys[:, :-1]
    return keys[keep].view(np.int64), keep.sum(1)


def within(a, b, edits: int) -> bool:
    """Whether two lines are at most so many edits apart. Common ends are cut off; then edits + 1 bit vectors hold, for the band of
    2 * edits + 1 diagonals, which prefixes of a are within 0, 1, ... edits of the prefix of b read so far."""
    if abs(len(a) - len(b)) > edits:
        return False
    n, least = 0, min(len(a), len(b))
    while n < least and a[n] == b[n]:
        n += 1
    m = 0
    while m < least - n and a[-1 - m] == b[-1 - m]:
        m += 1
    a, b = a[n : len(a) - m], b[n : len(b) - m]
    if not len(a) or not len(b):
        return max(len(a), len(b)) <= edits
    places: dict = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << (i + edits)  # shifted, so that the band never starts below 0
    band, rows = (1 << (2 * edits + 1)) - 1, [((1 << (e + 1)) - 1) << edits for e in range(edits + 1)]
    for j, c in enumerate(b):
        match, before = places.get(c, 0) >> j & band, 0
        old = 0
        for e in range(edits + 1):
            new = rows[e] & match
            if e:
                new |= old | old >> 1 | before << 1
            old, rows[e] = rows[e], new & band
            before = rows[e]
        if not before:
            return False
    return bool(rows[edits] >> (len(a) - len(b) + edits) & 1)


def link_lines(edits: int):
    def link(ids, side, payload):
        lines = [x if x.isascii() else x.decode("utf-8", "surrogateescape") for x in payload.to_pylist()]
        joined, out, index = Sets(len(ids)), [], {}
        for i in sorted(range(len(ids)), key=lambda i: len(lines[i])):
            n, line, near, own = len(lines[i]), lines[i], set(), {}
            for at in probes(line, edits):
                s = at[2] if isinstance(at[2], bytes) else at[2].encode("utf-8", "surrogateescape")
                near.update(index.get((at[0], at[1], s), ()))
            for k, (start, m) in enumerate(segments(n, edits)):
                s = line[start : start + m]
                own[n, k, s if isinstance(s, bytes) else s.encode("utf-8", "surrogateescape")] = i
            for j in sorted(near):
                if (side[i] != side[j] or side[i] == 2) and joined.find(i) != joined.find(j):
                    a, b = lines[i], lines[j]
                    if isinstance(a, bytes) != isinstance(b, bytes):
                        a, b = (x.decode() if isinstance(x, bytes) else x for x in (a, b))
                    if within(a, b, edits):
                        joined.join(i, j)
                        out.append((int(ids[i]), int(ids[j])))
            for k in own:
                index.setdefault(k, []).append(i)
        return out

    return link


def judged(line: str, edits: int, least_words: int, least_chars: int) -> bool:
    """Whether copies with edits of a line count."""
    least = max(least_chars, edits + 1)
    if len(line) >= least:
        return True  # many scripts have no spaces, so words are not asked of a line that is long enough
    raw = line.encode("utf-8", "surrogateescape")
    return len(line) > edits and len(raw) >= least and len(raw.split(None, least_words)) >= least_words


def _lines(rows: DataFrame, edits: int, least_words: int, least_chars: int, seed: int = 0) -> DataFrame:
    """(k, c, i, h1, h2, n, keys) of every line that is not blank; those whose equal copies alone count have no keys."""
    kind = dict(rows.dtypes)["k"]

    def work(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            column, marks = batch.column("t"), batch.column("c")
            for a, b in slices(pc.utf8_length(column).to_pylist()):
                of, number, lines = [], [], []
                for d, text in enumerate(column.slice(a, b - a).to_pylist(), a):
                    for i, line in enumerate(text.split("\n")):
                        if line and not line.isspace():
                            of.append(d), number.append(i), lines.append(line)
                hashes = np.frombuffer(b"".join([digest(x.encode("utf-8", "surrogateescape"), seed) for x in lines]), ">i8").reshape(-1, 2).astype(np.int64)
                near = np.fromiter((judged(x, edits, least_words, least_chars) for x in lines), bool, len(lines))
                keys, counts = lines_keys([x for x, ok in zip(lines, near) if ok], edits) if near.any() else (np.empty(0, np.int64), np.empty(0, np.int64))
                sizes = np.zeros(len(lines), np.int64)
                sizes[near] = counts
                at = pa.array(of, pa.int32())
                ends = pa.array(np.cumsum(np.r_[0, sizes]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k").take(at), marks.take(at), pa.array(number, pa.int32()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(list(map(len, lines)), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(keys, pa.int64()))],
                    ["k", "c", "i", "h1", "h2", "n", "keys"],
                )

    return rows.select("k", "c", "t").mapInArrow(freed(work), f"k {kind}, c long, i int, h1 long, h2 long, n long, keys array<long>")


def _wanted_lines(rows: DataFrame, holders: KeyFilter, lines: KeyFilter, seed: int = 0) -> DataFrame:
    """(id, payload) of rows (h, t): lines whose first hash may be wanted, of documents that may hold the first copy of one."""
    may, line_may = holders.has() if holders.fits else None, lines.has() if lines.fits else None
    if not holders.fits:
        rows = holders.joined(rows, "h")

    def work(batches):
        import xxhash

        for batch in batches:
            if may:
                batch = batch.filter(pa.array(may(batch.column("h").to_numpy())))
            column = batch.column("t")
            for a, b in slices(pc.utf8_length(column).to_pylist()):
                found = list({x for t in column.slice(a, b - a).to_pylist() for x in t.encode("utf-8", "surrogateescape").split(b"\n")})
                ids = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x, seed) for x in found]), ">i8")[::2].astype(np.int64)
                hit = line_may(ids) if line_may else np.ones(len(ids), bool)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array([x for x, y in zip(found, hit) if y], pa.binary())], ["id", "payload"])

    found = rows.select("h", "t").mapInArrow(freed(work), "id long, payload binary")
    return found if lines.fits else lines.joined(found, "id")


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, least_words: int = LEAST_WORDS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(key, c, dropped, kept_in): the numbers (from 0) of the lines that a document loses, and the documents that keep what they repeat.

    One row per document that loses any; c is the hash of its text. A line goes if an earlier one is linked to it, directly or over
    others, by at most so many edits; earlier is by key (null first), then hash of the text, then number. Rows equal in key
    and text are one document. Of lines too short for edits equal ones are linked; blank lines are
    never dropped.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select(F.col(key).alias("k"), text_of(text).alias("t")).withColumn("c", F.xxhash64("t"))
    first, rest = F.min(F.struct("k", "c", "i")).alias("first"), F.struct("h2", "n")
    # 64 of 128 bits stand for a line's class in what follows: with a seed that keeps all classes apart
    for seed in range(8):
        lines = scratch.write(_lines(rows, edits, least_words, least_chars, seed))
        classes = scratch.write(lines.groupBy("h1").agg(first, F.count("*").alias("copies"), F.max("n").alias("n"), (F.min(rest) != F.max(rest)).alias("two")))
        if classes.where("two").isEmpty():
            break
        scratch.drop(lines, classes)
    near = scratch.write(clusters_by_keys(lines.select(F.col("h1").alias("id"), "keys"), scratch))
    members = near.join(classes.select(F.col("h1").alias("id"), "n", "first"), "id")
    members = scratch.write(members)
    dealt = scratch.write(deal_tiles(members.select("cluster", "id", F.col("n").alias("size")), scratch, slack=edits))
    # lines are fetched from the documents that hold their first copies; other texts are passed over where they are read
    holders = KeyFilter(members.select(F.xxhash64("first.k", "first.c").alias("h")))
    texts = _wanted_lines(rows.withColumn("h", F.xxhash64("k", "c")), holders, KeyFilter(members.select("id")), seed)
    # a common line is found in many texts: one of each goes on, dealt by id as the join asks, so there is no shuffle more
    edges = scratch.write(compare(dealt.join(texts.dropDuplicates(["id"]), "id"), link_lines(edits), "a long, b long"))
    component = scratch.write(connected_components(edges, scratch))
    rooted = classes.join(component.select(F.col("node").alias("h1"), "component"), "h1", "left").where("copies > 1 or component is not null")
    rooted = scratch.write(rooted.select("h1", "first", F.coalesce("component", "h1").alias("root")))
    kept = rooted.groupBy("root").agg(F.min("first").alias("keep"))
    judged_lines = lines.select("k", "c", "i", "h1").join(rooted.join(kept, "root").select("h1", "keep"), "h1")
    gone = judged_lines.where(~F.struct("k", "c", "i").eqNullSafe(F.col("keep")))
    # a document's dropped lines are bounded by its lines
    out = gone.groupBy("k", "c").agg(F.array_sort(F.collect_set("i")).alias("dropped"), F.array_sort(F.collect_set("keep.k")).alias("kept_in")).withColumnRenamed("k", key)
    out = scratch.write(out)
    scratch.drop(lines, classes, members, dealt, edges, rooted)
    return out


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", names: tuple[str, str, str] = ("__lines", "__dropped", "__kept_in"), **options) -> DataFrame:
    """The rows and columns of docs, text without the lines that repeat an earlier one, plus three columns: how many lines the text had,
    the numbers of those that it lost, and the keys of the documents that keep them (null where it lost none).

    names says what those three are called: docs must not have columns of these names. Other columns may have any name.
    Texts that lose nothing are unchanged, null stays null; a text that loses all its lines is empty. Empty table: no rows.
    """
    if clash := {x.lower() for x in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has columns {sorted(clash)}: give other names")
    gone = repeated_lines(docs, key, text, **options).select(F.col(key).alias("k"), "c", F.struct("dropped", "kept_in").alias("gone"))
    # all of docs in one column, so that no name can clash
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(text_of(text)).alias("h"), F.col(key).alias("key"))
    out = out.join(gone, F.col("key").eqNullSafe(F.col("k")) & (F.col("h") == F.col("c")), "left")
    own = F.col("row").getField(text)
    split = F.split(own, "\n")
    # by set difference, whose work is the sum of lines and dropped ones
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone.dropped"))
    rest = F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n")
    return out.select(
        *[F.when(F.col("gone").isNull(), own).otherwise(rest).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns],
        (F.regexp_count(F.coalesce(own, F.lit("")), F.lit("\n")) + 1).cast("long").alias(names[0]), F.col("gone.dropped").alias(names[1]), F.col("gone.kept_in").alias(names[2]),
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    none = F.array().cast("array<int>")
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.coalesce(F.size(F.coalesce("__dropped", none)), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("__dropped", none).alias("dropped"), F.coalesce("__kept_in", F.array().cast("array<long>")).alias("kept_in"), F.sha2(F.encode(text_of("text"), "UTF-8"), 256).alias("text_sha256"))

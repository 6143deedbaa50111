"""Operator 11, periodic run detection after Kolpakov and Kucherov.

A text's words are numbers. A suffix automaton gives the Lempel-Ziv factors and an earlier place of each; Main's algorithm finds the runs that
touch the border of two factors, from longest common extensions to both sides of it; every other run lies strictly inside a factor, and
is a copy of a run at the factor's earlier place. Work is in proportion to the text's words, whatever its runs.

Before that, all texts of a slice are cut at words that occur once: a word of a run occurs again one period away, so no run holds one. This is
repeated inside the pieces, and pieces shorter than a run may be are left; nothing is lost by it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .buffers import gather, slices, strings, utf8
from .common import WORD, freed, table, text_of

#: Words of the shortest run.
LEAST = 12
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[9, 10, 11, 12, 13, 32]] = True


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, earlier start) of the Lempel-Ziv factors: each is the longest stretch that starts earlier as well, which may overlap it, or one new word (earlier start -1).

    The suffix automaton holds a state's first transition in two lists and further ones in a dictionary: in texts most states have one.
    """
    length, link, first, word, goal = [0], [-1], [-1], [-1], [-1]
    more: dict[int, dict[int, int]] = {}
    last = 0
    for i, c in enumerate(s):
        now = len(length)
        length.append(i + 1)
        link.append(0)
        first.append(i)
        word.append(-1)
        goal.append(-1)
        p = last
        q = -1
        while p >= 0:
            if word[p] == c:
                q = goal[p]
                break
            if word[p] < 0:
                word[p], goal[p] = c, now
            elif p in more:
                if (q := more[p].get(c, -1)) >= 0:
                    break
                more[p][c] = now
            else:
                more[p] = {c: now}
            p = link[p]
        if q >= 0:
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                first.append(first[q])
                word.append(word[q])
                goal.append(goal[q])
                if q in more:
                    more[twin] = dict(more[q])
                while p >= 0:
                    if word[p] == c:
                        if goal[p] != q:
                            break
                        goal[p] = twin
                    else:
                        own = more.get(p)
                        if own is None or own.get(c) != q:
                            break
                        own[c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    out, i, n = [], 0, len(s)
    while i < n:
        state, size, earlier = 0, 0, -1
        while i + size < n:
            c = s[i + size]
            to = goal[state] if word[state] == c else more[state].get(c, -1) if state in more else -1
            # the first place where what is read so far ends
            if to < 0 or first[to] - size >= i:
                break
            earlier, state, size = first[to] - size, to, size + 1
        out.append((i, max(size, 1), earlier))
        i += max(size, 1)
    return out


def extensions(x: list[int]) -> list[int]:
    """How far x agrees with itself from each place on."""
    n, z, left, right = len(x), [0] * len(x), 0, 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def runs(s: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run of at least so many words and two periods, by start and period."""
    parts, n, found = factors(s), len(s), {}
    borders = [(start, size, parts[k - 1][1] if k else 0) for k, (start, size, _) in enumerate(parts)] + [(n, 0, parts[-1][1] if parts else 0)]
    for b, m, before in borders:
        # a run that touches b and ends in this factor starts at most so far left of it, or has touched an earlier border too
        a = min(b, 2 * before + m)
        if a + m < least:
            continue
        t, v = s[b - a : b], s[b : b + m]
        ahead, back = extensions([*v, -1, *t, *v]), extensions([*t[::-1], -1, *v[::-1], *t[::-1]])
        # to the right of b: the period's second copy starts at b + q; to the left: its first at b - q
        spans = [(b - back[a + 1 + m - q], b + q + (ahead[q] if q < m else 0), q) for q in range(1, m + 1) if back[a + 1 + m - q] + (ahead[q] if q < m else 0) >= q]
        spans += [(b - q - (back[q] if q < a else 0), b + ahead[m + 1 + a - q], q) for q in range(1, a + 1) if ahead[m + 1 + a - q] + (back[q] if q < a else 0) >= q]
        for i, j, q in spans:
            # what goes on beyond the window is found at another border
            if j - i >= least and not (j < n and s[j] == s[j - q]) and not (i > 0 and s[i - 1] == s[i - 1 + q]) and q < found.get((i, j), n):
                found[i, j] = q
    ends: dict[int, set[tuple[int, int]]] = {}
    for (i, j), q in found.items():
        ends.setdefault(i, set()).add((j, q))
    starts = sorted(ends)
    for b, m, earlier in parts:
        if earlier < 0 or m < least + 2:
            continue
        at = bisect_right(starts, earlier)
        while at < len(starts) and (i := starts[at]) < earlier + m:
            for j, q in list(ends[i]):
                if j < earlier + m:
                    to = i + b - earlier
                    if to not in ends:
                        ends[to] = set()
                        insort(starts, to)
                    ends[to].add((j + b - earlier, q))
            at = bisect_left(starts, i, at) + 1
    return sorted(((i, j, q) for i, own in ends.items() for j, q in own), key=lambda r: (r[0], r[2]))


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where words start, their lengths, a number for each (equal words have one), and the words before each document and after the last."""
    inside = ~SEPARATORS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    start = inside & (edge[:-1] | ~np.r_[False, inside[:-1]])
    stop = inside & (edge[1:] | ~np.r_[inside[1:], False])
    at = np.flatnonzero(start)
    size = np.flatnonzero(stop) + 1 - at
    bounds = np.r_[0, np.cumsum(size)]
    column = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    return at, size, column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(at, ends)


def pieces(number: np.ndarray, bounds: np.ndarray, least: int) -> list[np.ndarray]:
    """Places of words that may be in runs, in stretches of neighbours: stretches are cut at words that occur in them once, until none does."""
    place, group = np.arange(len(number)), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    while len(place):
        _, back, count = np.unique(group * (number.max() + 1) + number[place], return_inverse=True, return_counts=True)
        alive = count[back] > 1
        new = np.r_[True, (np.diff(place) > 1) | (group[1:] != group[:-1]) | ~alive[:-1]]
        cut = np.cumsum(new)
        sizes = np.bincount(cut[alive], minlength=cut[-1] + 1)
        stays = alive & (sizes[cut] >= least)
        if stays.all():
            break
        place, group = place[stays], cut[stays]
    if not len(place):
        return []
    return np.split(place, np.flatnonzero(np.diff(group) != 0) + 1)


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, n_words, runs array<struct<start, length, period>>, collapsed): one row per row of docs, of whole texts.

    Words are what white space (spaces, tabs, line ends, form feeds) separates. A run is a stretch of words with smallest period q, of at least `least` words and two
    periods, that no neighbour extends; runs are sorted by start and period. collapsed is the text's words joined by single spaces, less
    those that some run holds after its first period. Null and empty texts have no words: no runs, and an empty text. Rows that repeat
    a key are texts of their own. Empty table: no rows. Other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(key).alias("k"), text_of(text).alias("t"))
    kind = dict(rows.dtypes)["k"]

    def slice_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, ends = utf8(batch.column("t"))
        at, size, number, bounds = words_of(data, ends)
        found = []
        for place in pieces(number, bounds, least):
            _, own = np.unique(number[place], return_inverse=True)
            found += [(int(place[0]) + i, j - i, q) for i, j, q in runs(own.tolist(), least)]
        found = np.array(found, np.int64).reshape(-1, 3)
        # a period that a run's later words repeat is dropped
        drop = np.zeros(len(at) + 1, np.int64)
        np.add.at(drop, found[:, 0] + found[:, 2], 1)
        np.add.at(drop, found[:, 0] + found[:, 1], -1)
        kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
        doc, of = np.searchsorted(bounds, found[:, 0], "right") - 1, np.searchsorted(bounds, kept, "right") - 1
        n_runs = np.bincount(doc, minlength=len(ends) - 1)
        spots, lengths = np.empty(2 * len(kept), np.int64), np.empty(2 * len(kept), np.int64)
        spots[0::2], spots[1::2] = len(data), at[kept]
        lengths[0::2], lengths[1::2] = np.r_[False, of[1:] == of[:-1]][: len(kept)], size[kept]
        total = np.bincount(of, lengths[0::2] + lengths[1::2], minlength=len(ends) - 1).astype(np.int64)
        out = strings(gather(np.r_[data, np.uint8(32)], spots, lengths), np.r_[0, np.cumsum(total)])
        struct = pa.StructArray.from_arrays([pa.array(found[:, 0] - bounds[doc]), pa.array(found[:, 1]), pa.array(found[:, 2])], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_runs)].astype(np.int32)), struct)
        return pa.RecordBatch.from_arrays([batch.column("k"), pa.array(np.diff(bounds).astype(np.int64)), lists, out], ["k", "n_words", "runs", "collapsed"])

    def work(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                yield slice_of(part)

    return rows.mapInArrow(freed(work), f"k {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("k", key)


def planted(key: str = "doc_id", text: str = "text") -> Column:
    """The text, or of one in ten keys its words with a periodic end: from word a = g % n on the p words there repeat, p = 1 + floor((n - a) / (3 + g % 8)), g = floor(crc32(key) / 10).
    Null keys are read as nothing."""
    h = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")))
    g = F.floor(h / 10).cast("long")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        rest = n - a
        p = 1 + F.floor(rest / (3 + F.pmod(g, F.lit(8)))).cast("long")
        times = F.ceil(rest / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), times)), F.lit(1), rest.cast("int"))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")

    # bound once: an expression that is used often would be evaluated as often
    words = F.array(F.regexp_extract_all(text_of(text), F.lit(WORD), F.lit(0)))
    made = F.element_at(F.transform(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit(""))), 1)
    return F.when(F.pmod(h, F.lit(10)) == 0, made).otherwise(text_of(text))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted().alias("text"))
    r = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    out = find_runs(docs).withColumn("r", r)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("r.s")).alias("start"), F.col("r.length").alias("length"), (-F.col("r.p")).alias("period"), F.floor(1000 * F.col("r.length") / -F.col("r.p")).cast("long").alias("exponent_milli"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))

"""Operator 12, fill-in-middle transformation.

All texts of a slice are cut together, on their bytes: a table gives each byte its class, another says of two adjacent bytes whether a unit
starts between them, sums of these marks that start anew with each document number the units, and a binary search in them finds the bytes
where units start. Prefix, middle and suffix of all texts are then copied to their places at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .buffers import gather, slices, strings, utf8
from .common import freed, table, text_of

#: Classes of bytes: line feed, other white space, continuation of a character, any other.
LINE, SPACE, TAIL, OTHER = range(4)
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[0x80:0xC0] = TAIL
CLASSES[[9, 11, 12, 13, 32]] = SPACE
CLASSES[10] = LINE
#: Whether a unit starts between a byte of one class (row) and a byte of another (column).
STARTS = {
    "line": np.repeat([True, False, False, False], 4),
    "word": np.array([[before in (LINE, SPACE) and after not in (LINE, SPACE) for after in range(4)] for before in range(4)]).ravel(),
    "char": np.array([[after != TAIL for after in range(4)] for _ in range(4)]).ravel(),
}
MARKS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")


def checked_marks(marks: tuple[str, str, str]) -> list[np.ndarray]:
    """The marks' bytes. A mark's first byte occurs in marks at their start alone and none starts another, so that in a text without marks they are found where they were put."""
    raw = [m.encode() for m in marks]
    if len(set(raw)) != 3 or any(not a or (a != b and b.startswith(a)) or any(c in a[1:] for c in {x[0] for x in raw}) for a in raw for b in raw):
        raise ValueError("marks must differ, none may start another, and their first bytes may occur at their start alone")
    return [np.frombuffer(m, np.uint8) for m in raw]


def units(data: np.ndarray, ends: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of units so far at each byte, units before each document, and units of each document."""
    classes = CLASSES[data]
    start = np.empty(len(data), bool)
    start[1:] = STARTS[unit][classes[:-1] * 4 + classes[1:]]
    start[ends[:-1][ends[:-1] < ends[1:]]] = True
    upto = np.cumsum(start, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    at = np.concatenate([np.zeros(1, upto.dtype), upto])[ends]
    return upto, at[:-1], np.diff(at)


def cut(data: np.ndarray, ends: np.ndarray, draws: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each document, and the bytes where its middle starts and ends: after as many units as the smaller and the larger draw modulo units + 1."""
    upto, before, n = units(data, ends, unit)
    drawn = np.sort(draws % (n[:, None] + 1), 1)
    places = np.searchsorted(upto, (before[:, None] + drawn + 1).astype(upto.dtype), "left")
    places = np.minimum(places, ends[1:, None])
    return n, places[:, 0], places[:, 1]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output): one row per row of docs, of whole texts cut into n units (lines with their line feed, words with the white space after them, or characters).

    Cuts and form are drawn by SHA-256 of seed, colon and key (null: nothing), so rows that repeat a key have the same draws. rate percent
    are transformed, spm percent of these with the suffix first. Null texts are empty; texts that are empty or contain a mark are plain: output is
    the text, and both counts are null. Empty table: no rows. Other columns are not read, whatever their names.
    """
    if unit not in STARTS:
        raise ValueError(f"no unit {unit}")
    raw = checked_marks(marks)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draws = F.transform(F.array(*[F.substring(digest, 8 * i + 1, 8) for i in range(4)]), lambda h: F.conv(h, 16, 10).cast("long"))
    rows = docs.select(F.col(key).alias("k"), draws.alias("h"), text_of(text).alias("t"))
    kind = dict(rows.dtypes)["k"]
    sizes = np.array([len(m) for m in raw])

    def slice_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("t")
        data, ends = utf8(column)
        h = batch.column("h").flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        marked = np.zeros(len(column), bool)
        for m in marks:
            marked |= pc.match_substring(column, m).to_numpy(zero_copy_only=False)
        n, low, high = cut(data, ends, h[:, :2], unit)
        form = np.where(marked | (ends[1:] == ends[:-1]) | (h[:, 2] % 100 >= rate), 0, np.where(h[:, 3] % 100 < spm, 2, 1))
        chars = np.r_[0, np.cumsum(CLASSES[data] != TAIL, dtype=np.int64)]
        prefix, middle = chars[low] - chars[ends[:-1]], chars[high] - chars[low]
        # six stretches of each output, of the texts or of the marks behind them: P prefix S suffix M middle, or S suffix P prefix M middle
        at, size = np.zeros((len(n), 6), np.int64), np.zeros((len(n), 6), np.int64)
        places = len(data) + np.cumsum(sizes) - sizes
        parts = ((ends[:-1], low), (high, ends[1:]), (low, high))
        for f, order in ((1, (0, 1, 2)), (2, (1, 0, 2))):
            own = form == f
            for i, p in enumerate(order):
                at[own, 2 * i], size[own, 2 * i] = places[p], sizes[p]
                at[own, 2 * i + 1], size[own, 2 * i + 1] = parts[p][0][own], (parts[p][1] - parts[p][0])[own]
        plain = form == 0
        at[plain, 0], size[plain, 0] = ends[:-1][plain], np.diff(ends)[plain]
        out = strings(gather(np.concatenate([data, *raw]), at.ravel(), size.ravel()), np.r_[0, np.cumsum(size.sum(1))])
        columns = [batch.column("k"), pa.array(n.astype(np.int64)), pa.array(np.array(FORMS)[form]), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), out]
        return pa.RecordBatch.from_arrays(columns, ["k", "n", "form", "prefix_chars", "middle_chars", "output"])

    def work(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                yield slice_of(part)

    return rows.mapInArrow(freed(work), f"k {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("k", key)


def restore(rows: DataFrame, output: str = "output", form: str = "form", into: str = "restored", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """rows with a column into: the text that an output of transform() was made from, by its marks and form alone. Null outputs are null. An output without the marks of its form is an error.
    into replaces a column of that name. Empty table: no rows."""
    raw = checked_marks(marks)
    own = rows.drop(into) if into in rows.columns else rows
    packed = own.select(F.struct(*[own[c] for c in own.columns]).alias("r"), F.coalesce(own[output], F.lit("")).alias("t"), F.when(own[output].isNull(), "plain").otherwise(own[form]).alias("f"))

    def slice_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, ends = utf8(batch.column("t"))
        form = pc.index_in(batch.column("f"), pa.array(FORMS)).fill_null(-1).to_numpy(zero_copy_only=False)
        if (form < 0).any():
            raise ValueError("a form is neither plain, psm nor spm")
        at, size = np.zeros((len(form), 3), np.int64), np.zeros((len(form), 3), np.int64)
        found = []
        for m in raw:
            hit = np.ones(max(0, len(data) - len(m) + 1), bool)
            for i, c in enumerate(m):
                hit &= data[i : i + len(hit)] == c
            places = np.r_[np.flatnonzero(hit), len(data) + 1]
            found.append(places[np.searchsorted(places, ends[:-1])])
        for f, order in ((1, (0, 1, 2)), (2, (1, 0, 2))):
            mine = form == f
            if not mine.any():
                continue
            first, second, third = (found[p][mine] for p in order)
            if (first != ends[:-1][mine]).any() or (second < first).any() or (third < second).any() or (third + len(raw[2]) > ends[1:][mine]).any():
                raise ValueError("an output lacks the marks of its form")
            for p, (a, b) in zip(order, ((first, second), (second, third), (third, ends[1:][mine]))):
                # text order: prefix, middle, suffix
                place = (0, 2, 1)[p]
                at[mine, place], size[mine, place] = a + len(raw[p]), b - a - len(raw[p])
        plain = form == 0
        at[plain, 0], size[plain, 0] = ends[:-1][plain], np.diff(ends)[plain]
        return pa.RecordBatch.from_arrays([batch.column("r"), strings(gather(data, at.ravel(), size.ravel()), np.r_[0, np.cumsum(size.sum(1))])], ["r", "s"])

    def work(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                yield slice_of(part)

    done = packed.mapInArrow(freed(work), f"r {dict(packed.dtypes)['r']}, s string")
    return done.select("r.*", F.when(F.col(f"r.`{output}`").isNotNull(), F.col("s")).alias(into))


def _hash(text: str) -> Column:
    return F.sha2(F.encode(F.col(text), "UTF-8"), 256)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = restore(transform(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _hash("output").alias("output_sha256"), _hash("restored").alias("restored_sha256"))

"""Operator 2, byte-level BPE encoding and decoding.

Texts are split by the vocabulary's pattern; what is new among a batch's pieces becomes rows of padded matrices, bucketed
by length. In each round every row merges its leftmost pair of least rank, found in a hash table of pairs; rows are
compacted in place and leave the matrix when no pair is left. A very long piece is a matrix of its own, whose rows are its stretches: each
round merges the leftmost least pair of all rows and compacts one row, so that rounds cost a row's width, not the piece's.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freed, table, text_of

NONE = np.int32(2**31 - 1)
#: Pieces longer than this (in bytes) are matrices of their own, with rows of this width. Pieces in each of two generations kept; characters worked on at once.
LONGEST, KEPT, CHUNK = 512, 150_000, 1_000_000


class Vocabulary:
    """Ranks of byte strings, from a file of lines `base64 rank`."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        lengths = np.array([len(t) for t in self.bytes_of], np.int64)
        self.joined, self.lengths, self.starts = np.frombuffer(b"".join(self.bytes_of), np.uint8), lengths, np.cumsum(lengths) - lengths
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a << 32 | b, rank) for t, rank in self.ranks.items() for i in range(1, len(t)) if (a := self.ranks.get(t[:i])) is not None and (b := self.ranks.get(t[i:])) is not None]
        self._fill(np.array(pairs, np.int64))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, pairs: np.ndarray) -> None:
        """Open addressing: each round every unplaced pair claims its slot, and those that lose go one on."""
        self.bits = max(8, int(len(pairs) * 2.5).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        keys, values, slot = pairs[:, 0], pairs[:, 1], self._slot(pairs[:, 0])
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where they don't merge or an id is negative."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys = np.where((left < 0) | (right < 0), np.int64(-2), keys).ravel()
        slot = self._slot(keys)
        out, at = np.full(keys.shape, NONE, np.int32), np.arange(len(keys))
        while len(at):
            there = self.keys[slot]
            same = there == keys[at]
            out[at[same]] = self.values[slot[same]]
            on = ~same & (there >= 0)
            at, slot = at[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as the bytes of 32-bit integers."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for n, p in enumerate(pieces):
            if (rank := self.ranks.get(p)) is not None:
                out[n] = rank.to_bytes(4, "little")
            elif len(p) > LONGEST:
                out[n] = self._merge_long(p)
            else:
                buckets.setdefault(max(2, (len(p) - 1).bit_length()), []).append(n)
        for bits, rows in buckets.items():
            for i in range(0, len(rows), step := max(1, (1 << 20) >> bits)):
                self._merge(pieces, rows[i : i + step], 1 << bits, out)
        return out

    def _merge(self, pieces: list[bytes], rows: list[int], width: int, out: list) -> None:
        length = np.array([len(pieces[n]) for n in rows])
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < length[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces[n] for n in rows), np.uint8)]
        ranks, rows = self.pair_ranks(ids[:, :-1], ids[:, 1:]), np.array(rows)
        while len(rows):
            at = ranks.argmin(1)  # the first of equals: leftmost
            every = np.arange(len(rows))
            best = ranks[every, at]
            if (done := best == NONE).any():
                ends, raw = (ids[done] >= 0).sum(1).tolist(), ids[done].tobytes()
                for i, (n, end) in enumerate(zip(rows[done].tolist(), ends)):
                    out[n] = raw[4 * width * i : 4 * (width * i + end)]
                ids, ranks, rows, at, best = ids[~done], ranks[~done], rows[~done], at[~done], best[~done]
                every = np.arange(len(rows))
                if not len(rows):
                    return
            cols = np.arange(ids.shape[1])
            source = np.minimum(cols + (cols > at[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, source, 1)
            ids[:, -1] = -1
            ids[every, at] = best
            ranks = np.take_along_axis(ranks, source[:, :-1].clip(max=ranks.shape[1] - 1), 1)
            ranks[:, -1] = NONE
            ranks[every, at.clip(max=ranks.shape[1] - 1)] = self.pair_ranks(ids[every, at], np.where(at + 1 < ids.shape[1], ids[every, (at + 1) % ids.shape[1]], -1))
            left = at > 0
            ranks[every[left], at[left] - 1] = self.pair_ranks(ids[every[left], at[left] - 1], ids[every[left], at[left]])

    def _merge_long(self, piece: bytes) -> bytes:
        flat = self.of_byte[np.frombuffer(piece, np.uint8)]
        n, width = len(flat), LONGEST
        ids, ranks = np.full(-(-n // width) * width, -1, np.int32), np.full(-(-n // width) * width, NONE, np.int32)
        ids[:n], ranks[: n - 1] = flat, self.pair_ranks(flat[:-1], flat[1:])
        # ranks[r, j] is that of the pair that starts there; a row's last pair ends in the next row that is not empty
        ids, ranks = ids.reshape(-1, width), ranks.reshape(-1, width)
        size = [min(width, n - r * width) for r in range(len(ids))]
        before, after, best, known = [*range(-1, len(ids) - 1)], [*range(1, len(ids)), -1], ranks.min(1), {}

        def rank(a: int, b: int) -> int:
            if (a, b) not in known:
                known[a, b] = int(self.pair_ranks(np.array([a], np.int32), np.array([b], np.int32))[0])
            return known[a, b]

        while (least := best[r := int(best.argmin())]) != NONE:  # the first of equals: leftmost
            j = int(ranks[r].argmin())
            row, at = (r, j + 1) if j + 1 < size[r] else (after[r], 0)
            ids[r, j] = least
            ids[row, at : size[row] - 1], ranks[row, at : size[row] - 1] = ids[row, at + 1 : size[row]], ranks[row, at + 1 : size[row]]
            size[row] -= 1
            ids[row, size[row]], ranks[row, size[row]] = -1, NONE
            if not size[row]:
                after[before[row]], best[row] = after[row], NONE
                if after[row] >= 0:
                    before[after[row]] = before[row]
            follow = (r, j + 1) if j + 1 < size[r] else (after[r], 0)
            ranks[r, j] = rank(int(least), int(ids[follow])) if follow[0] >= 0 else NONE
            lead = (r, j - 1) if j else (before[r], size[before[r]] - 1)
            if lead[0] >= 0:
                ranks[lead] = rank(int(ids[lead]), int(least))
            for x in {r, row, lead[0]} - {-1}:
                best[x] = ranks[x].min()
        return ids[ids >= 0].tobytes()


class Encoder:
    """Encodes texts with one vocabulary. Pieces seen lately are remembered in two generations: when the young one is full
    it becomes the old one, whose pieces come back when met again."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary, self.split = Vocabulary(path), regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Makes sure that the pieces are known. Call before each use: what was known may go."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > KEPT:
            self.old, self.known, new = self.known, {}, list(pieces)
        again = self.old
        missing = []
        for p in new:
            if (ids := again.get(p)) is not None:
                self.known[p] = ids
            else:
                missing.append(p)
        self.known.update(zip(missing, self.vocabulary.encode_pieces([p.encode() for p in missing])))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        parts = [self.split(t) for t in texts]
        self.learn(set().union(*parts))
        get = self.known.__getitem__
        ids = [b"".join(map(get, p)) for p in parts]
        return np.frombuffer(b"".join(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids)) // 4

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, one after another, and how many each id has."""
        v = self.vocabulary
        lengths = v.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(v.starts[ids] - (ends - lengths), lengths)
        return v.joined[at + np.arange(len(at))], lengths


@functools.lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per worker and vocabulary."""
    return Encoder(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def slices(sizes: list[int], most: int = CHUNK):
    """Ranges of rows with about so many characters: bounds what is in memory, not what is done."""
    start, n = 0, 0
    for i, size in enumerate(sizes):
        n += size
        if n >= most:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: tuple[str, str] | None = None, decoded: bool = False) -> DataFrame:
    """(key, ids array<int>): the ids of each whole text, one row per row of docs, without special tokens. Rows that repeat a key are encoded each.
    Other columns are not read, whatever their names.

    vocabulary: path of the rank file, which every worker can read, and split pattern. decoded adds the bytes that the ids decode to,
    without a second pass. Null text is empty and has no ids. Empty table: no rows.
    """
    path, pattern = vocabulary or default_vocabulary()
    rows = docs.select(F.col(key).alias("k"), text_of(text).alias("t"))
    kind = dict(rows.dtypes)["k"]

    def work(batches):
        coder = encoder(path, pattern)
        for batch in batches:
            column = batch.column("t")
            for a, b in slices(pc.utf8_length(column).to_pylist()):
                ids, counts = coder.encode(column.slice(a, b - a).to_pylist())
                ends = np.concatenate([[0], np.cumsum(counts)])
                out = [batch.column("k").slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))]
                yield pa.RecordBatch.from_arrays([*out, _decoded(coder, ids, ends)][: 3 if decoded else 2], ["k", "ids", "decoded"][: 3 if decoded else 2])

    return rows.mapInArrow(freed(work), f"k {kind}, ids array<int>" + ", decoded binary" * decoded).withColumnRenamed("k", key)


def _decoded(coder: Encoder, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    raw, lengths = coder.decode(ids)
    at = np.concatenate([[0], np.cumsum(lengths)])[ends].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)])


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(key, ids, decoded binary): the bytes that ids stand for. Null ids: empty. An id outside the vocabulary is an error."""
    path, pattern = vocabulary or default_vocabulary()
    rows = encoded.select(F.col(key).alias("k"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    kind = dict(rows.dtypes)["k"]

    def work(batches):
        coder = encoder(path, pattern)
        for batch in batches:
            column = batch.column("ids")
            sizes = column.value_lengths()
            for a, b in slices(sizes.to_pylist()):
                own = column.slice(a, b - a)
                ends = np.concatenate([[0], np.cumsum(sizes.slice(a, b - a).to_numpy(zero_copy_only=False))])
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(a, b - a), own, _decoded(coder, own.flatten().to_numpy(zero_copy_only=False), ends)], ["k", "ids", "decoded"])

    return rows.mapInArrow(freed(work), f"k {kind}, ids array<int>, decoded binary").withColumnsRenamed({"k": key, "ids": ids})


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary=None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of what they decode to."""
    out = encode(docs, key, text, vocabulary, decoded=True)
    return out.select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), " "), "UTF-8"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))

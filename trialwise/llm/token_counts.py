"""Operator 1, token counts. Edit-aware: each document keeps a segment tree over runs of pre-tokens, with sums of
characters and tokens; an edit re-encodes the runs that it touches, the two characters before them that a split may look
at, and what follows until splits fall on an old boundary again; sums change along the paths to the root. Trees are rows of a
table: their leaves are kept, and sums above the leaves follow from them without encoding.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder, default_vocabulary, encoder, slices
from .common import Scratch, freed, table, text_of

#: Pre-tokens in a new leaf; a leaf of GROWN times as many makes the tree be laid out anew.
LEAF, GROWN = 32, 4
#: Characters past its end that decide where a split ends.
AHEAD = 2


class TokenTree:
    """A document's runs of pre-tokens under a binary tree of (characters, tokens). Runs that edits touched are encoded when
    a count is asked for, or many trees' at once by settle()."""

    def __init__(self, coder: Encoder, runs: list[str], tokens: list[int], leaf: int = LEAF):
        """From what leaves() gave: nothing is encoded."""
        self.coder, self.leaf, self.encoded = coder, leaf, 0
        #: Runs not yet encoded, with their pieces.
        self.touched: dict[int, list[str]] = {}
        self.runs = runs or [""]
        self._sum(tokens or [0])

    @classmethod
    def of_text(cls, coder: Encoder, text: str, leaf: int = LEAF) -> TokenTree:
        pieces = coder.split(text)
        coder.learn(set(pieces))
        return cls(coder, *laid_out(coder, pieces, leaf), leaf)

    def leaves(self) -> tuple[list[str], list[int]]:
        """The runs' texts and numbers of tokens."""
        settle([self])
        return self.runs, self.tokens[self.width : self.width + len(self.runs)]

    def _sum(self, tokens: list[int]) -> None:
        """The tree above the leaves."""
        self.width = 1 << (len(tokens) - 1).bit_length()
        rest = [0] * (self.width - len(tokens))
        self.chars, self.tokens = [0] * self.width + list(map(len, self.runs)) + rest, [0] * self.width + tokens + rest
        for i in range(self.width - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _encode(self) -> None:
        """Counts the touched runs, whose pieces the coder knows, and sums along the paths to the root."""
        for i, pieces in self.touched.items():
            self.encoded += len(self.runs[i])
            node = self.width + i
            self.tokens[node] = count(self.coder, pieces)
            while node := node // 2:
                self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
        self.touched = {}

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        settle([self])
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.runs)

    def _find(self, at: int) -> tuple[int, int]:
        """The run that holds character at (the last one for the end), and where it starts."""
        node, start = 1, 0
        at = min(at, max(self.n_chars - 1, 0))
        while node < self.width:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return min(node - self.width, len(self.runs) - 1), start

    def _put(self, i: int, pieces: list[str]) -> None:
        self.runs[i], self.touched[i] = "".join(pieces), pieces
        node = self.width + i
        self.chars[node] = len(self.runs[i])
        while node := node // 2:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]

    def edit(self, at: int, remove: int, insert: str) -> None:
        """Replaces remove characters from at by insert. Both are cut to the text's bounds."""
        at = max(0, min(at, self.n_chars))
        remove = max(0, min(remove, self.n_chars - at))
        low, start = self._find(max(0, at - AHEAD))
        high, high_start = self._find(at + remove)
        region = "".join(self.runs[low : high + 1])
        region = region[: at - start] + insert + region[at + remove - start :]
        while True:
            ahead, n = "", high + 1
            while n < len(self.runs) and len(ahead) < AHEAD:
                ahead, n = ahead + self.runs[n], n + 1
            pieces, end = [], 0
            for p in self.coder.split(region + ahead):
                if end >= len(region):
                    break
                pieces.append(p)
                end += len(p)
            if end == len(region):
                break
            # the last piece runs over the boundary: the next run is touched as well
            high += 1
            region += self.runs[high]
        share = -(-len(pieces) // (high - low + 1))
        if share <= GROWN * self.leaf:
            for i in range(low, high + 1):
                self._put(i, pieces[(i - low) * share : (i - low + 1) * share])
            return
        # runs that have grown too long become more runs; sums above are made anew, the other leaves stay as they are
        parts = [pieces[i : i + self.leaf] for i in range(0, len(pieces), self.leaf)]
        tokens, more = self.tokens[self.width : self.width + len(self.runs)], len(parts) - (high - low + 1)
        self.touched = {i + more * (i > high): p for i, p in self.touched.items() if not low <= i <= high} | {low + i: p for i, p in enumerate(parts)}
        self.runs[low : high + 1] = ["".join(p) for p in parts]
        self._sum([*tokens[:low], *[0] * len(parts), *tokens[high + 1 :]])


def count(coder: Encoder, pieces: list[str]) -> int:
    return sum(map(len, map(coder.known.__getitem__, pieces))) // 4


def laid_out(coder: Encoder, pieces: list[str], leaf: int = LEAF) -> tuple[list[str], list[int]]:
    """Leaves of a new tree over pieces that the coder knows."""
    parts = [pieces[i : i + leaf] for i in range(0, len(pieces), leaf)]
    return ["".join(p) for p in parts], [count(coder, p) for p in parts]


def settle(trees: list[TokenTree]) -> None:
    """Encodes what edits have touched in any of the trees, new pieces all at once."""
    if touched := [t for t in trees if t.touched]:
        touched[0].coder.learn({p for t in touched for pieces in t.touched.values() for p in pieces})
        for t in touched:
            t._encode()


def _lists(values: list[list], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(list(itertools.chain.from_iterable(values)), kind))


def build_trees(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(key, runs array<string>, tokens array<int>): the leaves of each whole text's tree, to be kept in a table; one row per row of docs.

    Null and empty texts have no leaves. Rows that repeat a key have trees of their own. Other columns are not read. Empty table: no rows.
    """
    path, pattern = vocabulary or default_vocabulary()
    rows = docs.select(F.col(key).alias("k"), text_of(text).alias("t"))
    kind = dict(rows.dtypes)["k"]

    def work(batches):
        coder = encoder(path, pattern)
        for batch in batches:
            column = batch.column("t")
            for a, b in slices(pc.utf8_length(column).to_pylist()):
                parts = [coder.split(t) for t in column.slice(a, b - a).to_pylist()]
                coder.learn(set().union(*parts))
                runs, tokens = zip(*[laid_out(coder, p) for p in parts])
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(a, b - a), _lists(runs, pa.string()), _lists(tokens, pa.int32())], ["k", "runs", "tokens"])

    return rows.mapInArrow(freed(work), f"k {kind}, runs array<string>, tokens array<int>").withColumnRenamed("k", key)


NUMBERS = ("n_tokens_before", "n_tokens", "n_edits", "n_encoded_chars", "n_chars")


def edit_trees(trees: DataFrame, key: str = "doc_id", edits: str = "edits", vocabulary: tuple[str, str] | None = None, keep: bool = True) -> DataFrame:
    """(key, n_tokens_before, n_tokens, n_edits, n_encoded_chars, n_chars, runs, tokens): one row per row of trees (key, runs, tokens, edits).

    edits is an array of (at, remove, insert), applied one after another, each to the text that the one before
    left; at and remove count code points and are cut to the text's bounds. Null edits are none, null fields are 0 or
    empty; null runs are an empty text. Only what edits touch is encoded: n_encoded_chars. runs and tokens are the trees
    after the edits, for the next ones; keep=False leaves them out. Rows that repeat a key are edited each by themselves. Empty table: no rows.
    """
    path, pattern = vocabulary or default_vocabulary()
    steps = F.transform(F.coalesce(F.col(edits), F.array().cast("array<struct<at:bigint,remove:bigint,insert:string>>")), lambda e: F.struct(F.coalesce(e["at"], F.lit(0)).cast("long").alias("at"), F.coalesce(e["remove"], F.lit(0)).cast("long").alias("remove"), F.coalesce(e["insert"], F.lit("")).alias("insert")))
    rows = trees.select(F.col(key).alias("k"), F.coalesce("runs", F.array().cast("array<string>")).alias("runs"), F.coalesce("tokens", F.array().cast("array<int>")).alias("tokens"), steps.alias("e"))
    kind = dict(rows.dtypes)["k"]

    def work(batches):
        coder = encoder(path, pattern)
        for batch in batches:
            for a, b in slices(_chars(batch.column("runs"))):
                part = batch.slice(a, b - a)
                own = [TokenTree(coder, r, n) for r, n in zip(part.column("runs").to_pylist(), part.column("tokens").to_pylist())]
                todo, before = part.column("e").to_pylist(), [t.tokens[1] for t in own]
                for tree, each in zip(own, todo):
                    for e in each:
                        tree.edit(e["at"], e["remove"], e["insert"])
                settle(own)
                numbers = before, [t.tokens[1] for t in own], list(map(len, todo)), [t.encoded for t in own], [t.n_chars for t in own]
                out = [part.column("k"), *[pa.array(c, pa.int64()) for c in numbers]]
                if keep:
                    runs, tokens = zip(*[t.leaves() for t in own])
                    out += [_lists(runs, pa.string()), _lists(tokens, pa.int32())]
                yield pa.RecordBatch.from_arrays(out, ["k", *NUMBERS, *(["runs", "tokens"] if keep else [])])

    schema = f"k {kind}, " + ", ".join(f"{n} long" for n in NUMBERS) + ", runs array<string>, tokens array<int>" * keep
    return rows.mapInArrow(freed(work), schema).withColumnRenamed("k", key)


def _chars(runs: pa.ListArray) -> list[int]:
    """Characters of each row's runs."""
    upto = np.r_[0, np.cumsum(pc.utf8_length(runs.flatten()).to_numpy(zero_copy_only=False).astype(np.int64))]
    ends = np.r_[0, np.cumsum(runs.value_lengths().to_numpy(zero_copy_only=False))]
    return np.diff(upto[ends]).tolist()


def count_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: str = "edits", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(key, n_tokens_before, n_tokens, n_edits, n_encoded_chars, n_chars): one row per row of docs. Trees are built and kept in a table of the shared
    folder; edits are counted from there. Null text is empty; other odd cases are those of build_trees() and edit_trees()."""
    own = docs.select(F.col(key).alias("k"), F.struct(F.col(key).alias("k"), F.col(edits).alias("e")).alias("id"), F.col(text).alias("text"))
    trees = Scratch(docs.sparkSession, "trees").write(build_trees(own, "id", "text", vocabulary))
    return edit_trees(trees.select(F.col("id.k").alias(key), F.col("id.e").alias("edits"), "runs", "tokens"), key, "edits", vocabulary, keep=False)


def standard_edits(text: str = "text", lang: str = "lang", source: str = "source") -> Column:
    """The edits of the query: a language mark in front, twenty characters in the middle masked, the source at the end."""
    t = text_of(text)
    mark = F.concat(F.lit("<"), F.coalesce(F.col(lang), F.lit("")), F.lit("> "))

    def edit(at, remove, insert):
        return F.struct(at.cast("long").alias("at"), F.lit(remove).cast("long").alias("remove"), insert.alias("insert"))

    return F.array(
        edit(F.lit(0), 0, mark),
        edit(F.length(mark) + F.floor(F.length(t) / 2), 20, F.lit("[REDACTED]")),
        edit(F.lit(1 << 40), 0, F.concat(F.lit("\n"), F.coalesce(F.col(source), F.lit("")))),
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_edited(docs.select("doc_id", "text", standard_edits().alias("edits")))

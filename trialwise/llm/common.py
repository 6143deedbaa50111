"""What the training-data operators share: word patterns, shared-folder tables, components, cluster tiles."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are neither space nor one of tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where unset, a local session, which has one machine, gets a
    folder of its own; on a cluster that is an error, since executors would write to their own disks."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="trialwise-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Spark's own switch: an execution's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Executions inside leave no shuffle files behind: what they made is in a table or with the driver."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Scratch:
    """Tables in the shared folder. They cut lineage, so that a lost executor costs one step and not the whole job."""

    #: Folders made in this process and not yet deleted.
    made: ClassVar[dict[str, SparkSession]] = {}

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        Scratch.made[self.root] = spark

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        with tidy(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._keep = [*getattr(self, "_keep", []), out]  # so that ids stay unique
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for df in tables:
            if path := self.paths.get(id(df)):
                _delete(self.spark, path)

    def remove(self) -> None:
        """Deletes all its tables: no later step reads any."""
        _delete(self.spark, self.root)
        Scratch.made.pop(self.root, None)

    @classmethod
    def clear(cls, keep: tuple[str, ...] = ()) -> None:
        """Deletes all tables of all operators so far, but those below the folders to keep. For callers that have written what they need:
        results that were not written yet read from them."""
        for root, spark in list(cls.made.items()):
            if root not in keep:
                _delete(spark, root)
                del cls.made[root]


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def give_back() -> None:
    """Returns a worker's unused memory to the system: workers live on for later steps, beside others in one executor's limit."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def freed(work):
    """work for mapInArrow, that gives back memory when a partition has ended."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


class KeyFilter:
    """A bitmap of 64-bit hashes for workers to pass over rows that cannot match. It lets through some rows too many, never too few.

    It has BITS_A_KEY bits for each counted key, so that about one in so many other rows gets through, and is broadcast: 2^MOST_BITS bits,
    128 MB, are the bound, for 134 million keys. With more keys there is none (fits is False), and callers join by key instead.
    """

    BITS_A_KEY, LEAST_BITS, MOST_BITS, CHUNK = 8, 20, 30, 1 << 16

    def __init__(self, keys: DataFrame):
        """keys: one long column, of a written table, as it is read twice."""
        n, self.keys = keys.count(), keys
        bits = max(self.LEAST_BITS, (n * self.BITS_A_KEY - 1).bit_length() if n else 0)
        self.fits = bits <= self.MOST_BITS
        if not self.fits:
            return
        self.bits = 1 << bits
        at = F.col(keys.columns[0]).bitwiseAND(F.lit(self.bits - 1))
        placed = keys.select(F.floor(at / self.CHUNK).alias("chunk"), at.bitwiseAND(F.lit(self.CHUNK - 1)).alias("at"))
        chunk = self.CHUNK

        def pack(t: pa.Table) -> pa.Table:
            bits = np.zeros(chunk, np.uint8)
            bits[t.column("at").to_numpy()] = 1
            return pa.table({"chunk": t.column("chunk").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

        bitmap = np.zeros(self.bits // 8, np.uint8)
        with tidy(keys.sparkSession):
            packed = placed.groupBy("chunk").applyInArrow(pack, "chunk long, bits binary").collect()
        # at most bits / CHUNK rows of CHUNK bits: 128 MB
        for r in packed:
            bitmap[r["chunk"] * self.CHUNK // 8 :][: self.CHUNK // 8] = np.frombuffer(r["bits"], np.uint8)
        self.shared = keys.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def has(self):
        """What tells, on a worker, which of an array of hashes may be among the keys."""
        shared, last = self.shared, np.int64(self.bits - 1)

        def test(h: np.ndarray) -> np.ndarray:
            at = h.view(np.int64) & last
            return (np.frombuffer(shared.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

        return test

    def joined(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows whose column is among the keys, by a join: the way where no bitmap fits. Skewed keys are split by adaptive execution."""
        return rows.join(self.keys.toDF("__key").distinct(), F.col(name) == F.col("__key"), "left_semi")


def among(rows: DataFrame, name: str, keys: KeyFilter) -> DataFrame:
    """Rows whose long column may be among the keys, passed over where they are read if a bitmap fits."""
    if not keys.fits:
        return keys.joined(rows, name)
    may, names = keys.has(), rows.columns

    def work(batches):
        for batch in batches:
            yield batch.filter(pa.array(may(batch.column(name).to_numpy()))).select(names)

    return rows.mapInArrow(freed(work), rows.schema)


def distinct_ids(classes: DataFrame, name: str) -> bool:
    """Whether a hash that stands for a class stands for one alone. Classes are as many as rows at most, and one number of each is dealt."""
    return classes.groupBy(name).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, of unsigned 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Components of the graph with edges (a, b): one row (node, component) for each node of an edge; component is the smallest node.

    Alternating large-star and small-star rounds (O(log^2) of them). Each is a partial-aggregated minimum and an
    equi-join, which adaptive execution may split where one node holds many edges; nothing is gathered on the
    driver but two numbers a round. Nulls, loops and repeated edges are ignored. No edges: no rows.
    """

    def normal(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def each(e: DataFrame, *ends: tuple[str, str]) -> DataFrame:
        """Edges of each row's named ends, in one pass: a union would run what is below it once for every branch."""
        return e.select(F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in ends])).alias("e")).select("e.a", "e.b")

    def star(e: DataFrame) -> DataFrame:
        """Joins every neighbour to the least one of a."""
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        return e.join(least, "a")

    now, seen = scratch.write(normal(edges)), None
    for _ in range(max_rounds):
        both = each(now, ("a", "b"), ("b", "a"))
        large = star(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        # a node that is the least of its neighbourhood keeps itself as the minimum
        large = normal(large)
        small = star(large)
        after = scratch.write(normal(each(small, ("b", "m"), ("a", "m"))))
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("a").agg(F.min("b").alias("c")).select(F.col("a").alias("node"), F.col("c").alias("component")).union(
        now.select("b", "b").distinct().toDF("node", "component")
    )

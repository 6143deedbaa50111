"""Operator 7, sharding. DataFrame functions only.

Records hash into a fixed number of virtual slots; bytes are summed per slot, and a stored, versioned table maps slots to
shards. Rebalancing adds a version to that table: rows move only with their slots. Law of the result: `bytes`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, text_of

#: Virtual slots; the share of the mean load up to which a shard keeps its own slots, so that small ones are left to level the shards with.
SLOTS, FILLED = 4096, 0.97


def virtual_slot(record: list[Column], slots: int = SLOTS) -> Column:
    """The virtual slot of a record: fixed for ever, whatever the shards. Nulls are values."""
    return F.pmod(F.xxhash64(*record, F.lit(7)), F.lit(slots)).cast("int")


def slot_loads(records: DataFrame) -> DataFrame:
    """(vslot, bytes, n) of (vslot, size) records; partial sums, so a hot slot costs one row a task."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of a map (version, vslot, shard, bytes): before anything is known of loads, even runs of slots."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), F.floor(F.col("id") * shards / slots).cast("int").alias("shard"), F.lit(0).cast("long").alias("bytes"))


def store_map(slot_map: DataFrame, path: str) -> int:
    """Writes a version of the map beside the earlier ones, which stay as they are, and returns its number. A version that is there already is an error."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.drop("version").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")
    return version


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A version of a stored map, the latest by default; None if there is no map."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    known = spark.read.parquet(path)
    version = known.agg(F.max("version")).first()[0] if version is None else version
    return known.where(F.col("version") == version).select(F.col("version").cast("int").alias("version"), "vslot", "shard", "bytes")


def rebalance(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of a map: new loads, and slots moved off overfull shards only.

    Largest first, a shard keeps its slots while their sum stays within FILLED of the mean load; what is left of overfull shards, and slots of shards
    that no longer exist, goes largest first to the least loaded. Shards below that share keep all they have. Slots are a
    fixed number, so the one array that holds them is bounded whatever the input.
    """
    both = slot_map.join(loads.select("vslot", F.col("bytes").alias("now")), "vslot", "left").withColumn("now", F.coalesce("now", F.lit(0)))
    slots = F.sort_array(F.collect_list(F.struct((-F.col("now")).alias("b"), F.col("vslot").alias("v"), F.when(F.col("shard").between(0, shards - 1), F.col("shard")).otherwise(-1).alias("old"))))
    row = both.agg(slots.alias("s"), F.sum("now").alias("all"), F.max("version").alias("version"))
    none = F.array_repeat(F.lit(0).cast("long"), shards)

    def add(load, to, b):
        return F.transform(load, lambda x, i: F.when(i == to, x - b).otherwise(x))

    def keep(state, slot):
        fits = (slot["old"] >= 0) & ((F.get(state["load"], slot["old"]) - slot["b"] <= FILLED * F.col("all") / shards) | (slot["b"] == 0))
        to = F.when(fits, slot["old"]).otherwise(-1)
        return F.struct(add(state["load"], to, slot["b"]).alias("load"), F.concat(state["to"], F.array(to)).alias("to"))

    def deal(state, slot):
        least = F.array_position(state["load"], F.array_min(state["load"])).cast("int") - 1
        to = F.when(slot["to"] >= 0, slot["to"]).otherwise(least)
        return F.struct(F.when(slot["to"] >= 0, state["load"]).otherwise(add(state["load"], to, slot["b"])).alias("load"), F.concat(state["to"], F.array(to)).alias("to"))

    empty = F.array().cast("array<int>")
    row = row.withColumn("kept", F.aggregate("s", F.struct(none.alias("load"), empty.alias("to")), keep))
    both = F.zip_with("s", "kept.to", lambda s, to: F.struct(s["b"].alias("b"), s["v"].alias("v"), to.alias("to")))
    row = row.withColumn("s", both).withColumn("to", F.aggregate("s", F.struct(F.col("kept.load").alias("load"), empty.alias("to")), deal)["to"])
    return row.select("version", F.explode(F.arrays_zip("s", "to")).alias("x")).select((F.col("version") + 1).alias("version"), F.col("x.s.v").alias("vslot"), F.col("x.to").alias("shard"), (-F.col("x.s.b")).alias("bytes"))


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, key: str = "doc_id", text: str = "text", map_path: str | None = None) -> DataFrame:
    """(key, size, text_crc32, vslot, shard, slot, version): one row per row of docs.

    size is the text's UTF-8 bytes plus 1, null text counting none. A record is its key, size and checksum, so rows that repeat a key, or have none,
    spread over slots by their texts. slot numbers a shard's rows from 0 without gaps: slots of the shard follow one
    another, and rows in them by key, size and checksum. Rows equal in all three share a virtual slot and get numbers in any order. An
    empty table gives no rows. Other columns are not read.

    The map is kept at map_path: the next call with that path starts from the latest version, and adds one, with
    the slots that its loads make move. Without a path each call starts from even runs of slots, and the map lies in the shared folder.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    map_path = map_path or f"{scratch.root}/map"
    raw = F.encode(text_of(text), "UTF-8")
    records = docs.select(F.col(key).alias("k"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("crc"))
    # the checksum needs the text: one pass over the input, then only four numbers a row
    records = scratch.write(records.withColumn("vslot", virtual_slot([F.col("k"), F.col("size"), F.col("crc")], slots)))
    loads = scratch.write(slot_loads(records))
    if load_map(spark, map_path) is None:
        store_map(first_map(spark, shards, slots), map_path)
    store_map(rebalance(load_map(spark, map_path), loads, shards), map_path)
    placed = load_map(spark, map_path).select("version", "vslot", "shard").join(loads.select("vslot", "n"), "vslot")
    above = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    # one row per slot at most: a bounded table, broadcast below the session's threshold
    placed = scratch.write(placed.select("version", "vslot", "shard", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("first")))
    inside = F.row_number().over(Window.partitionBy("vslot").orderBy("k", "size", "crc")) - 1
    return records.withColumn("i", inside).join(placed, "vslot").select(
        F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "vslot", "shard", (F.col("first") + F.col("i")).cast("long").alias("slot"), "version"
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "version")

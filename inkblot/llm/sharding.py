"""Sharding by fixed virtual slots, with DataFrame functions only.

Records hash into ``slots`` virtual slots, thousands of them and always as many. Bytes are summed for
each slot, and a slot-to-shard map of a row for each slot says where its records go. The map is
versioned: rebalancing reads the last version, keeps every slot that may stay, deals the others to the
lightest shards, and stores the next version. Records never change their slot.

The map of version 1 gives each shard nearly equal bytes (law ``bytes``): slots, largest first, to the
lightest shard. A record's size is the UTF-8 bytes of its text plus 1 (null text: 1). It hashes by
doc_id and the crc32 of its text, so that rows without an id spread too; repeated rows share a slot.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkblot.llm.common import tasks_for, written

SLOTS, SHARDS = 4096, 16


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def slot_of(doc_id: Column, crc: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id, crc), F.lit(slots)).cast("int")


def slot_sums(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``virtual_slot``, ``bytes``, ``rows`` of each slot, empty ones included; summed before the shuffle."""
    sums = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


def _dealt(free: DataFrame, loads: Column) -> DataFrame:
    """Slots of ``free`` (virtual_slot, bytes), largest first, each to the shard that is lightest then."""
    entry = F.struct(F.col("bytes"), (-F.col("virtual_slot")).alias("order"))
    in_turn = F.reverse(F.array_sort(F.collect_list(entry)))
    none = F.array().cast("array<struct<virtual_slot:int,shard:int>>")

    def put(state, slot):
        to = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        more = F.transform(state["loads"], lambda load, i: F.when(i == to, load + slot["bytes"]).otherwise(load))
        row = F.struct((-slot["order"]).cast("int").alias("virtual_slot"), to.alias("shard"))
        return F.struct(more.alias("loads"), F.concat(state["placed"], F.array(row)).alias("placed"))

    start = F.struct(loads.alias("loads"), none.alias("placed"))
    return free.agg(F.aggregate(in_turn, start, put, lambda s: s["placed"]).alias("placed")).select(F.inline("placed"))


def new_map(sums: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1: ``version``, ``virtual_slot``, ``shard``."""
    zero = F.array_repeat(F.lit(0).cast("long"), shards)
    return _dealt(sums.select("virtual_slot", "bytes"), zero).select(F.lit(1).alias("version"), "virtual_slot", "shard")


def rebalanced(last: DataFrame, sums: DataFrame, shards: int = SHARDS, slack: float = 0.02) -> DataFrame:
    """The next version of a map, edited for new sums or another number of shards.

    A shard keeps its slots, in their order, until it has ``1 + slack`` times its fair share of bytes;
    what is beyond, and what shards that are gone had, is dealt to the lightest. Slots move for no other
    reason.
    """
    held = last.select("version", "virtual_slot", "shard").join(sums.select("virtual_slot", "bytes"), "virtual_slot")
    so_far = F.sum("bytes").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, 0))
    fair = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)
    held = held.withColumn("_stays", (F.col("shard") < shards) & (so_far <= fair * (1 + slack)))
    # a row for each slot: its own size bounds it, and both sides below read the same small table
    held = written(held, "slot-map")
    version = held.select((F.max("version") + 1).alias("version"))
    kept = held.where("_stays").groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    loads = held.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(kept, "shard", "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("shard", F.coalesce("bytes", F.lit(0)).alias("bytes")))), lambda x: x["bytes"])
    one = loads.agg(ordered.alias("loads")).first()["loads"]  # one number for each shard
    free = held.where("not _stays").select("virtual_slot", "bytes")
    moved = _dealt(free, F.array(*(F.lit(int(x)).cast("long") for x in one)))
    whole = held.where("_stays").select("virtual_slot", "shard").union(moved)
    return whole.join(F.broadcast(version)).select("version", "virtual_slot", "shard")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored maps; earlier versions stay."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the last by default."""
    maps = spark.read.parquet(path)
    wanted = version if version is not None else maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == wanted).select("version", "virtual_slot", "shard")


def records_of(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    crc = text_crc(docs["text"])
    return docs.select("doc_id", record_size(docs["text"]).alias("size"), crc.alias("text_crc32"), slot_of(docs["doc_id"], crc, slots).alias("virtual_slot"))


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every record with its shard, and its place there: ``slot``, from 0 without gaps in each shard.

    Places are given slot by slot: a slot begins where the one before it in the shard ends, and records
    are numbered within their slot only, so that no task holds a whole shard. ``map_path`` stores the map.
    """
    records = records_of(docs, slots)
    sums = written(slot_sums(records, slots).repartition(1), "slot-sums")  # a row for each slot
    slot_map = written(new_map(sums, shards), "slot-map")
    if map_path:
        store_map(slot_map, map_path)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    begins = slot_map.join(sums, "virtual_slot").select(
        "virtual_slot", "version", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("begins"),
    )
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")).cast("long") - 1
    return records.withColumn("_within", within).join(F.broadcast(begins), "virtual_slot").coalesce(tasks_for(docs)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begins") + F.col("_within")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )

"""Sharding by fixed virtual slots and a versioned map from slots to shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbflow.llm.common import stage, whole_text, with_copy_number
from kerbflow.session import shared_folder

SLOTS = 4096
MAP = "virtual_slot int, shard int, version int"


def slot_records(docs: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """(row_key, doc_id, size, text_crc32, virtual_slot) of each record, stored once.

    The slot is a hash of doc_id, text and the number of the copy among rows equal in
    both, so neither a frequent doc_id nor a frequent row fills one slot, and the slots
    don't depend on how the table is stored.
    """
    text = whole_text()
    body = F.encode(text, "UTF-8")
    identity = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    records = stage(
        docs.select(
            F.monotonically_increasing_id().alias("row_key"),
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.xxhash64(identity, text).alias("key_hash"),
        ),
        "shard-rows",
    )
    slot = F.pmod(F.xxhash64("key_hash", "copy"), F.lit(n_slots)).cast("int")
    return stage(
        with_copy_number(records, ["key_hash"]).select(
            "row_key", "doc_id", "size", "text_crc32", slot.alias("virtual_slot")),
        "shard-records",
    )


def slot_bytes(records: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, rows) of every slot, empty ones included."""
    sums = records.groupBy("virtual_slot").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows")
    )
    every = records.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").fillna(0, ["bytes", "rows"])


def first_map(spark: SparkSession, n_shards: int, n_slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt out in turn."""
    return spark.range(n_slots).select(
        F.col("id").cast("int").alias("virtual_slot"),
        (F.col("id") % n_shards).cast("int").alias("shard"),
        F.lit(1).alias("version"),
    )


def rebalanced(slot_map: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """The next version of the map: sizes near equal, few slots moved.

    Each shard keeps its largest slots as long as their sum stays within an equal
    share and gives up the rest (a shard beyond ``n_shards`` gives up all). Released
    slots, largest first, go to the shard with the least so far: a fold over one row
    of at most ``n_slots`` numbers.
    """
    share = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    total = sizes.agg(F.sum("bytes").alias("total")).scalar()
    placed = slot_map.join(sizes, "virtual_slot")
    kept = F.sum("bytes").over(share.rowsBetween(Window.unboundedPreceding, 0))
    marked = placed.withColumn("kept", kept).withColumn(
        "keeps", (F.col("kept") * n_shards <= total) & (F.col("shard") < n_shards)
    )
    base = F.coalesce(F.sum(F.when(F.col("keeps"), F.col("bytes"))), F.lit(0)).alias("base")
    by_shard = F.array_sort(F.collect_list(F.struct("shard", "base")))
    loads = (
        slot_map.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"))
        .join(marked.groupBy("shard").agg(base), "shard", "left").fillna(0, ["base"])
        .agg(F.transform(by_shard, lambda x: x["base"]).alias("loads"))
    )
    order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("b"), "virtual_slot")))
    released = marked.filter(~F.col("keeps")).agg(order.alias("slots"))
    state = F.struct(F.col("loads"), F.array().cast("array<int>").alias("to"))

    def place(acc, item):
        least = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        grown = F.transform(
            acc["loads"], lambda x, i: F.when(i == least, x - item["b"]).otherwise(x)
        )
        return F.struct(grown.alias("loads"), F.array_append(acc["to"], least).alias("to"))

    dealt = released.withColumn("loads", loads.scalar()).select(
        F.explode(
            F.arrays_zip(
                F.col("slots"), F.aggregate("slots", state, place)["to"].alias("to")
            )
        ).alias("x")
    ).select(F.col("x.slots.virtual_slot").alias("virtual_slot"), F.col("x.to").alias("to"))
    return marked.join(dealt, "virtual_slot", "left").select(
        "virtual_slot",
        F.coalesce("to", "shard").alias("shard"),
        (F.col("version") + 1).alias("version"),
    )


def write_map(slot_map: DataFrame, path: str) -> None:
    """Add a version; older ones stay readable."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, by default the latest."""
    stored = spark.read.schema(MAP).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == version).select("virtual_slot", "shard", "version")


def numbered(records: DataFrame, slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """Records with their shard and a gapless position within it.

    Positions count within a virtual slot and go on from the slots of the same shard
    before it, so no task sees more than the records of some slots.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = slot_map.join(sizes, "virtual_slot").select(
        "virtual_slot", "shard", "version",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"),
    )
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "row_key")
    rows = records.withColumn("at", F.row_number().over(inside) - 1)
    return rows.join(starts, "virtual_slot").withColumn("slot", F.col("before") + F.col("at"))


def shard(docs: DataFrame, n_shards: int, n_slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Every record with shard, position and the map version it was placed by.

    Law ``bytes``: sizes of the shards are near equal. Version 1 of the map deals the
    slots out in turn, version 2 rebalances it by the bytes counted in each slot; both
    are stored below ``path`` (default: a fresh shared folder).

    A null text has size 1 and the checksum of no bytes; null and repeated doc_ids and
    repeated rows are records like others, each with a slot of its own hash; other columns
    are not read; no rows give no rows.
    """
    spark = docs.sparkSession
    path = path or shared_folder(spark, "slot-map")
    records = slot_records(docs, n_slots)
    sizes = stage(slot_bytes(records, n_slots), "slot-bytes")
    write_map(first_map(spark, n_shards, n_slots), path)
    write_map(rebalanced(read_map(spark, path, 1), sizes, n_shards), path)
    return numbered(records, read_map(spark, path, 2), sizes).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
        F.col("version").alias("map_version"),
    )

"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots. Bytes are summed per slot, and a small versioned table says
which shard holds each slot. Rebalancing and growing write a new version of that table; the hash never
changes, so only the slots that the edit names move. Everything is DataFrame and SQL work; the map has one
row per slot, whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skytally.llm.common import scratch_path, stored, texts_of

SLOTS = 8192


def hashed(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Narrow rows: ``doc_id``, ``size`` (UTF-8 bytes and one), ``text_crc32``, ``virtual_slot``.

    The text's checksum is part of the hash, so rows without ``doc_id`` spread. A null text has size 1 and the
    checksum of no bytes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = texts_of(docs).select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sized.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def repeats_spread(records: DataFrame, sizes: DataFrame, shards: int, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """Records and slot sizes after equal rows (same ``doc_id`` and checksum) that together pass a hundredth of a shard's bytes
    are dealt to all slots by their place in the stored table; all others keep their slot.

    Only slots as large as that are looked into, and there are at most ``100 * shards`` such slots and groups of rows.
    """
    limit = sizes.agg((F.sum("bytes") / (100 * shards)).alias("limit"))
    heavy = sizes.crossJoin(limit).where("bytes > limit and rows > 1").select("virtual_slot", "limit")  # one row of limit
    inside = records.join(F.broadcast(heavy), "virtual_slot")
    groups = inside.groupBy("doc_id", "text_crc32").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.first("limit").alias("limit"))
    hot = stored(groups.where("bytes > limit and n > 1").select(F.col("doc_id").alias("hot_id"), F.col("text_crc32").alias("hot_crc")), "repeats")
    if hot.isEmpty():
        return records, sizes
    numbered = records.withColumn("place", F.monotonically_increasing_id())
    matched = numbered.join(F.broadcast(hot), F.col("doc_id").eqNullSafe(F.col("hot_id")) & (F.col("text_crc32") == F.col("hot_crc")), "left")
    dealt = F.pmod(F.xxhash64("doc_id", "text_crc32", "place"), F.lit(slots)).cast("int")
    spread = matched.withColumn("virtual_slot", F.when(F.col("hot_crc").isNull(), F.col("virtual_slot")).otherwise(dealt)).select(*records.columns)
    records = stored(spread, "spread")
    return records, stored(slot_sizes(records, slots), "slot-sizes")


def slot_sizes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, empty ones included."""
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    found = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return every.join(found, "virtual_slot", "left").fillna(0, ["bytes", "rows"])


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: equal runs of slots per shard."""
    return spark.range(slots).selectExpr("cast(id as int) as virtual_slot", f"cast(id * {shards} div {slots} as int) as shard")


def _kept_and_moved(sizes: DataFrame, current: DataFrame, shards: int) -> DataFrame:
    """Slots with ``stays``: each shard keeps its largest slots as far as its share of all bytes goes."""
    rows = current.join(sizes, "virtual_slot").crossJoin(sizes.agg((F.sum("bytes") / shards).alias("share")))  # one row
    running = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("stays", running <= F.col("share"))


def rebalanced(sizes: DataFrame, current: DataFrame, shards: int) -> DataFrame:
    """The map with overfull shards' smallest slots moved, largest first, each to the shard least loaded by then."""
    rows = _kept_and_moved(sizes, current, shards)
    state = rows.agg(
        F.expr("sort_array(collect_list(struct(bytes, virtual_slot)) FILTER (WHERE NOT stays), false)").alias("moves"),
        *[F.expr(f"coalesce(sum(bytes) FILTER (WHERE stays AND shard = {k}), 0L)").alias(f"load{k}") for k in range(shards)])
    target = "cast(array_position(a.loads, array_min(a.loads)) - 1 as int)"
    chosen = state.selectExpr("moves", f"""aggregate(moves,
        named_struct('loads', array({", ".join(f"load{k}" for k in range(shards))}), 'chosen', cast(array() as array<int>)),
        (a, m) -> named_struct('loads', transform(a.loads, (x, i) -> x + if(i = {target}, m.bytes, 0L)), 'chosen', concat(a.chosen, array({target}))),
        a -> a.chosen) as chosen""")
    moved = chosen.selectExpr("inline(arrays_zip(moves.virtual_slot, chosen))").toDF("virtual_slot", "shard")
    return rows.where("stays").select("virtual_slot", "shard").unionByName(moved)


def grown(sizes: DataFrame, current: DataFrame, shards: int) -> DataFrame:
    """The map with one more shard, numbered ``shards``, that takes slots; no other shard takes any."""
    rows = _kept_and_moved(sizes, current, shards + 1)
    return rows.select("virtual_slot", F.when(F.col("stays"), F.col("shard")).otherwise(F.lit(shards)).cast("int").alias("shard"))


def save_map(slot_map: DataFrame, path: str, version: int) -> DataFrame:
    """Write one version of the map and read it back; older versions stay."""
    slot_map.coalesce(1).write.parquet(f"{path}/version={version}")
    return read_map(slot_map.sparkSession, path, version)


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")


def place(records: DataFrame, sizes: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard of every record and its place there, without gaps: the slot's place in its shard and the record's in its slot.

    Order in a slot is by ``doc_id`` and checksum; rows equal in both are interchangeable.
    """
    ahead = F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    located = slot_map.join(sizes, "virtual_slot").select("virtual_slot", "shard", F.coalesce(ahead, F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32"))
    numbered = records.withColumn("nth", nth)
    return numbered.join(F.broadcast(located), "virtual_slot").withColumn("slot", F.col("base") + F.col("nth") - 1).drop("base", "nth")  # one row per slot


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """All documents in shards of nearly equal bytes; the slot map is kept at ``path``, versions 1 and 2.

    Null texts, null ids and repeated rows are placed like any other, very many equal rows in all slots; other columns are left
    behind; an empty table gives no rows and the first map. A single record of more than a shard's share makes its shard larger.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "slot-map")
    records = stored(hashed(docs, slots), "hashed")
    records, sizes = repeats_spread(records, stored(slot_sizes(records, slots), "slot-sizes"), shards, slots)
    current = save_map(first_map(spark, shards, slots), path, 1)
    current = save_map(rebalanced(sizes, current, shards), path, 2)
    return place(records, sizes, current).withColumn("map_version", F.lit(2))

"""Sharding by fixed virtual slots.

A record's id hashes to one of thousands of slots, for good.  A stored table
(version, slot, shard, bytes, rows), a folder a version, says where each slot lives;
records are placed by its latest version.  The first version is made from the bytes
of each slot, largest first to the emptiest shard.  It is never made anew: new data
go where their slots live, and an edit (``grow`` for more shards, ``rebalance`` for
even ones) writes a version that moves as few slots as it can.

Slots are a fixed number (``SLOTS``), so a map is a bounded table.  The folds
over it run in Spark on one row of at most ``SLOTS`` entries.

Defined cases: a null text has no bytes and the checksum 0; rows that are equal
stay separate rows with numbers of their own; rows without doc_id are dealt by a hash
of their text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import let, shared_dir, spread, text_bytes

SLOTS = 4096


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(spread(key), F.lit(slots)).cast("int")


def slot_sizes(records: DataFrame, slot: str = "vslot", size: str = "size") -> DataFrame:
    return records.groupBy(slot).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _argmin(loads: Column) -> Column:
    return F.array_position(loads, F.array_min(loads)).cast("int")


def _put(items: DataFrame, n_shards: int, loads: Column | None = None) -> DataFrame:
    """(slot, shard, bytes, rows): the items (slot, bytes, rows), largest first, each to the shard with fewest bytes;
    ``loads``: a column of ``items`` with what the shards hold before, the same in every row."""
    start = F.array_repeat(F.lit(0).cast("long"), n_shards)
    before = F.lit(None).cast("array<bigint>") if loads is None else F.max(loads)
    one = items.agg(F.sort_array(F.collect_list(F.struct("bytes", "slot", "rows")), asc=False).alias("s"), before.alias("l"))
    first = F.struct(F.coalesce("l", start).alias("loads"), F.array().cast("array<int>").alias("to"))

    def put(acc: Column, x: Column) -> Column:
        return let(
            _argmin(acc["loads"]),
            lambda k: F.struct(
                F.transform(acc["loads"], lambda v, i: F.when(i + 1 == k, v + x["bytes"]).otherwise(v)).alias("loads"),
                F.concat(acc["to"], F.array(k - 1)).alias("to"),
            ),
        )

    placed = one.select("s", F.aggregate("s", first, put)["to"].alias("to"))
    return placed.select(F.explode(F.arrays_zip("s", "to")).alias("x")).select(F.col("x.s.slot").alias("slot"), F.col("x.to").alias("shard"), F.col("x.s.bytes").alias("bytes"), F.col("x.s.rows").alias("rows"))


def first_map(sizes: DataFrame, n_shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: (version, slot, shard, bytes, rows) of every slot, also of empty ones; the largest slot first, each to
    the shard with fewest bytes."""
    none = F.lit(0).cast("long")
    every = sizes.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot")).join(sizes.withColumnRenamed("vslot", "slot"), "slot", "left")
    return _put(every.select("slot", F.coalesce("bytes", none).alias("bytes"), F.coalesce("rows", none).alias("rows")), n_shards).select(F.lit(0).alias("version"), "*")


def measured(slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """A map with the bytes and rows that its slots have now."""
    none = F.lit(0).cast("long")
    x = slot_map.select("version", "slot", "shard").join(sizes.withColumnRenamed("vslot", "slot"), "slot", "left")
    return x.select("version", "slot", "shard", F.coalesce("bytes", none).alias("bytes"), F.coalesce("rows", none).alias("rows"))


def rebalance(slot_map: DataFrame, n_shards: int, slack: float = 0.05) -> DataFrame:
    """The next version, for as many shards, once the slots' bytes have changed (``measured``): a shard keeps its slots
    from the smallest on up to its share and ``slack``; the rest go to the emptiest shards."""
    by = Window.partitionBy("shard").orderBy("bytes", "slot").rowsBetween(Window.unboundedPreceding, 0)
    x = slot_map.withColumn("_share", F.sum("bytes").over(Window.partitionBy(F.lit(0))) / F.lit(n_shards))
    x = x.withColumn("_moves", F.sum("bytes").over(by) > F.col("_share") * (1 + slack))
    kept = x.where("NOT _moves").select("version", "slot", "shard", "bytes", "rows")
    # what each shard keeps: one row of n_shards numbers
    loads = kept.groupBy("shard").agg(F.sum("bytes").alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("m"))
    loads = loads.select(F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("l"))
    moving = x.where("_moves").select("version", "slot", "bytes", "rows").join(F.broadcast(loads))
    to = _put(moving.select("slot", "bytes", "rows", "l"), n_shards, F.col("l")).join(moving.select("slot", "version"), "slot")
    both = kept.unionByName(to.select("version", "slot", "shard", "bytes", "rows"))
    return both.withColumn("version", F.col("version") + 1)


def grow(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The next version with shards up to ``n_shards - 1``: slots move only from old
    shards into new ones, until each shard has about its share of the bytes.

    Every old shard keeps slots from the smallest on up to its new share and gives the rest,
    which are few as they are the largest; they go round the new shards by size."""
    old = slot_map.select("version", "slot", "shard", "bytes", "rows")
    all_slots = Window.partitionBy(F.lit(0))
    by = Window.partitionBy("shard").orderBy("bytes", "slot").rowsBetween(Window.unboundedPreceding, 0)
    x = old.withColumn("_top", F.max("shard").over(all_slots)).withColumn("_share", F.sum("bytes").over(all_slots) / F.lit(n_shards))
    x = x.withColumn("_moves", (F.sum("bytes").over(by) > F.col("_share")) & (F.col("_top") + 1 < n_shards))
    turn = Window.partitionBy("_moves").orderBy(F.desc("bytes"), "slot")
    x = x.withColumn("_turn", F.row_number().over(turn) - 1).withColumn("_new", F.lit(n_shards) - 1 - F.col("_top"))
    to = F.col("_top") + 1 + F.pmod(F.col("_turn"), F.greatest(F.col("_new"), F.lit(1)))
    return x.select((F.col("version") + 1).alias("version"), "slot", F.when(F.col("_moves"), to).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes", "rows")


def store(slot_map: DataFrame, path: str) -> None:
    """Write a version of a map, in a folder of its own; one that is there already is an error."""
    version = slot_map.select("version").first()[0]
    slot_map.coalesce(1).write.parquet(f"{path}/version={version}")


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest stored version of a map; None where there is none."""
    try:
        versions = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return versions.where(F.col("version") == versions.agg(F.max("version")).first()[0]).select("version", "slot", "shard", "bytes", "rows")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of every row."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return docs.select(
        "doc_id", (text_bytes(F.col("text")) + 16).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        virtual_slot(key, slots).alias("vslot"),
    )


def open_map(rows: DataFrame, n_shards: int, path: str, slots: int = SLOTS) -> DataFrame:
    """The latest map stored at ``path``: made from these records where there is none, grown where it has too few shards."""
    spark, found = rows.sparkSession, latest(rows.sparkSession, path)
    if found is None:
        store(first_map(slot_sizes(rows), n_shards, slots), path)
    elif found.agg(F.max("shard")).first()[0] + 1 < n_shards:
        store(grow(measured(found, slot_sizes(rows)), n_shards), path)
    return latest(spark, path)


def shard(docs: DataFrame, n_shards: int = 40, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot); ``slot`` numbers
    the rows of a shard without gaps from 0.  ``path``: where the map is stored, a new folder of the shared one if not given.

    The number is the rows of the shard's earlier virtual slots and the place inside
    the own one, so no task orders a whole shard."""
    rows = records(docs, slots)
    slot_map = open_map(rows, n_shards, path or f"{shared_dir(docs.sparkSession)}/slots-{uuid.uuid4().hex}", slots)
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    now = slot_map if path is None else measured(slot_map, slot_sizes(rows))
    now = now.select(F.col("slot").alias("vslot"), "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return rows.join(now, "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("_before") + F.row_number().over(own) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )

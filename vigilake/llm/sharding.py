"""Sharding over fixed virtual slots.

Records are hashed to slots, never to shards. A small versioned map says which shard holds a slot; to rebalance, the map is
edited and a new version stored, and only the records of the slots that changed hands have to move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilake.functions.arrays import let_sql
from vigilake.session import cut_lineage

SLOTS = 4096
#: A slot or key heavier than a shard's even share divided by this is dealt to several cells.
SPLIT = 2
#: Stretches in which the rows of a shard are numbered.
STRETCHES = 1024


def slot_of(key: Column, n_slots: int = SLOTS) -> Column:
    """The virtual slot of a record, fixed by its key for good."""
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def _cells(records: DataFrame, n_shards: int) -> DataFrame:
    """Records with their cell (slot, part). Slots that hold more than a small share of all bytes have several parts.

    In such a slot the records of one key stay in one part, chosen by the key, unless the key alone is over that share, as a
    text in a third of all rows is: then its records have parts of their own, and are dealt to them by doc_id.
    """
    everything = Window.partitionBy()  # over at most as many rows as there are slots, or heavy keys
    loads = records.groupBy("_slot").agg(F.sum("_size").alias("_bytes"))
    loads = loads.withColumn("_limit", F.greatest(F.sum("_bytes").over(everything) / (n_shards * SPLIT), F.lit(1)))
    heavy = loads.where(F.col("_bytes") > F.col("_limit")).select("_slot", "_limit", F.ceil(F.col("_bytes") / F.col("_limit")).alias("_parts"))
    heavy = cut_lineage(heavy)  # fewer rows than shards times SPLIT, as are the heavy keys
    keys = records.join(F.broadcast(heavy), "_slot").groupBy("_slot", "_key", "_limit", "_parts").agg(F.sum("_size").alias("_bytes"))
    keys = keys.where(F.col("_bytes") > F.col("_limit")).withColumn("_own", F.ceil(F.col("_bytes") / F.col("_limit")))
    before = Window.partitionBy("_slot").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    keys = cut_lineage(keys.select("_slot", "_key", "_own", (F.col("_parts") + F.coalesce(F.sum("_own").over(before), F.lit(0))).alias("_first")))
    dealt = F.pmod(F.xxhash64(F.col("_id"), F.when(F.col("_id").isNull(), F.col("_row")), F.lit("part")), F.col("_own")) + F.col("_first")
    by_key = F.pmod(F.xxhash64(F.col("_key"), F.lit("part")), F.col("_parts"))
    met = records.join(F.broadcast(heavy.drop("_limit")), "_slot", "left").join(F.broadcast(keys), ["_slot", "_key"], "left")
    return met.withColumn("_part", F.coalesce(dealt, by_key, F.lit(0)).cast("int")).drop("_parts", "_own", "_first")


def first_map(loads: DataFrame, n_shards: int) -> DataFrame:
    """Version 0 of the map: cells in turn. Rows: version, slot, part, shard, bytes."""
    return loads.select(
        F.lit(0).alias("version"), F.col("_slot").alias("slot"), F.col("_part").alias("part"),
        F.pmod(F.col("_slot") + F.col("_part"), F.lit(n_shards)).cast("int").alias("shard"), F.col("_bytes").alias("bytes"),
    )


def edited_map(current: DataFrame, n_shards: int) -> DataFrame:
    """The next version: shards over the mean give up their lightest cells, which go to the lightest shards in turn.

    Works on the map alone, which has a row per cell: at most the number of slots plus ``SPLIT`` per shard and slots of
    single records. ``n_shards`` may differ from the current number; cells of shards that are gone move.
    """
    mean = F.sum("bytes").over(Window.partitionBy()) / n_shards
    heaviest_first = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot", "part")
    so_far = F.sum("bytes").over(heaviest_first.rowsBetween(Window.unboundedPreceding, 0))
    judged = current.withColumn("_mean", mean).withColumn("stays", (so_far <= F.col("_mean")) & (F.col("shard") < n_shards))
    judged = cut_lineage(judged.drop("_mean"))
    # one row that holds the map: a cell each, bounded by the number of slots
    whole = judged.agg(F.sort_array(F.collect_list(F.struct("bytes", "slot", "part", "shard", "stays")), asc=False).alias("cells"))
    held = f"""transform(sequence(0, {n_shards - 1}), i -> aggregate(
        filter(cells, c -> c.stays and c.shard = i), 0L, (a, c) -> a + c.bytes))"""
    lightest = "cast(array_position(acc.loads, array_min(acc.loads)) - 1 as int)"
    step = let_sql("to", lightest, """named_struct(
        'loads', transform(acc.loads, (l, i) -> if(i = to, l + x.bytes, l)), 'owners', concat(acc.owners, array(to)))""")
    start = f"named_struct('loads', {held}, 'owners', cast(array() as array<int>))"
    owners = f"aggregate(moving, {start}, (acc, x) -> {step}).owners"
    zipped = let_sql("moving", "filter(cells, c -> not c.stays)", f"zip_with(moving, {owners}, (c, o) -> named_struct('c', c, 'o', o))")
    placed = whole.select(F.explode(F.expr(zipped)).alias("z"))
    moved = placed.select(F.col("z.c.slot").alias("slot"), F.col("z.c.part").alias("part"), F.col("z.o").alias("shard"), F.col("z.c.bytes").alias("bytes"))
    both = judged.where("stays").select("slot", "part", "shard", "bytes").unionByName(moved)
    version = judged.agg(F.max("version") + 1).first()[0]
    return both.select(F.lit(version).cast("int").alias("version"), "slot", "part", "shard", "bytes")


def shard_records(docs: DataFrame, key: Column, size: Column, n_shards: int = 16, n_slots: int = SLOTS, *carry: Column) -> tuple[DataFrame, DataFrame]:
    """Deal records to shards of nearly equal bytes. Returns the records and the map with all its versions.

    Records: doc_id, size, the ``carry`` columns, virtual_slot, shard, position (gapless from 0 in each shard). Records
    with equal ``key`` share a slot, and a shard unless they outweigh half of one. A null size counts as 0; null keys and
    null doc_ids are ordinary values. Rows that repeat a doc_id each get a position. An empty table gives no rows.
    Only these narrow columns are shuffled, never a text.
    """
    narrow = docs.select(
        F.col("doc_id").alias("_id"), F.coalesce(size, F.lit(0)).cast("long").alias("_size"), slot_of(key, n_slots).alias("_slot"),
        F.xxhash64(F.lit("key"), key).alias("_key"), F.monotonically_increasing_id().alias("_row"), *[c.alias(f"_c{i}") for i, c in enumerate(carry)],
    )
    cells = cut_lineage(_cells(cut_lineage(narrow), n_shards))
    loads = cells.groupBy("_slot", "_part").agg(F.sum("_size").alias("_bytes"))
    first = cut_lineage(first_map(loads, n_shards))
    versions = first
    if not first.isEmpty():
        versions = cut_lineage(first.unionByName(edited_map(first, n_shards)))
    newest = versions.where(F.col("version") == (0 if versions is first else 1))
    shards = newest.select(F.col("slot").alias("_slot"), F.col("part").alias("_part"), "shard")
    dealt = cells.join(F.broadcast(shards), ["_slot", "_part"])
    # numbers: rows are dealt to stretches by doc_id, numbered inside, and shifted by the stretches before
    stretch = F.pmod(F.xxhash64(F.col("_id"), F.when(F.col("_id").isNull(), F.col("_row")), F.lit("stretch")), F.lit(STRETCHES)).cast("int")
    dealt = dealt.withColumn("_stretch", stretch)
    counts = dealt.groupBy("shard", "_stretch").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("shard", "_stretch", F.coalesce(before, F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("shard", "_stretch").orderBy("_id", "_slot", "_size", "_row")
    numbered = dealt.withColumn("_n", F.row_number().over(inside) - 1).join(F.broadcast(shifts), ["shard", "_stretch"])
    return numbered.select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), *[F.col(f"_c{i}") for i in range(len(carry))],
        F.col("_slot").alias("virtual_slot"), "shard", (F.col("_n") + F.col("_shift")).cast("long").alias("position"),
    ), versions

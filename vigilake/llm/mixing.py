"""Mixing sources to target weights by nested hash thresholds.

A document is taken if its hash lies below its source's threshold. Sums of sizes by source and hash bucket show in which
bucket a budget ends; only that bucket is looked at again with finer buckets, and no document is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilake.operators.ordering import number_rows
from vigilake.session import cut_lineage

#: Hash bits, taken from MD5 of the doc_id, and bits that each of the first rounds looks at.
BITS, STEP, ROUNDS = 60, 10, 2


def doc_hash(doc_id: Column) -> Column:
    """60 bits of the document number's MD5."""
    return F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: list[float], total: float, most: float) -> DataFrame:
    """Target of each source. ``sources``: one row per source with ``source`` and ``source_size``.

    Sources in code point order, null last, take the weights in turn and share ``total`` times all sizes. A target stops
    at ``most`` times its source's size and what is over is shared again by weight until none is above. In a round all
    sources whose share is over their limit are set to it; shares of the others only grow, so the rounds end.
    """
    keyed = sources.withColumn("all_", F.lit(0))
    ranked = number_rows(keyed, ["all_"], [F.col("source").asc_nulls_last()], "place").drop("all_")
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = cut_lineage(ranked.select(
        "source", "source_size", (F.col("source_size") * F.lit(float(most))).alias("limit_"),
        F.element_at(table, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")).alias("weight"),
    ))
    budget = (ranked.agg(F.sum("source_size")).first()[0] or 0) * total
    level, open_before = 0.0, None
    while True:
        over = (F.col("limit_") <= F.col("weight") * F.lit(level)) if level else F.lit(False)
        full, open_, n_open = ranked.agg(
            F.coalesce(F.sum(F.when(over, F.col("limit_"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, 1)), F.lit(0)),
        ).first()
        if not open_ or n_open == open_before:
            break
        level, open_before = (budget - full) / open_, n_open
    return ranked.select("source", "source_size", F.least("limit_", F.col("weight") * F.lit(level)).alias("target"))


def _budget_bucket(sums: DataFrame) -> DataFrame:
    """The bucket in which each source's budget ends, and what stands before it. At most 2^STEP rows per source."""
    order = Window.partitionBy("sid").orderBy("bucket")
    upto = sums.withColumn("upto", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = upto.where(F.col("upto") > F.col("budget")).groupBy("sid").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("bytes")).alias("before"))).alias("m"))
    return ends.select("sid", F.col("m.bucket").alias("bucket"), F.col("m.before").alias("before"))


def mix(docs: DataFrame, size: Column, weights: list[float], total: float = 1.5, most: float = 2.0) -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, taken, copies.

    Every document is taken whole ``floor(target / source_size)`` times, and once more if its hash is below its source's
    threshold: the threshold is where the running sum, in hash order, comes nearest to the rest of the target. Rows that
    share a doc_id share a hash and are taken together. A null source is a source; a null size counts as 0; a source
    without words has target 0. An empty table gives no rows. The choice depends on doc_ids, sizes and sources alone, so
    reruns agree.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    rows = cut_lineage(rows.withColumn("h", F.coalesce(doc_hash(F.col("doc_id")), F.lit(0))).withColumn("sid", F.xxhash64(F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull())))
    sources = rows.groupBy("source", "sid").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources.select("source", "source_size"), weights, total, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = cut_lineage(
        targets.withColumn("sid", F.xxhash64(F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()))
        .withColumn("passes", passes.cast("long")).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    )
    # nested thresholds: [low, low + 2^left) is the bucket in which the budget of a source ends
    live = goals.select("sid", "budget", F.lit(0).cast("long").alias("low"))
    left = BITS
    for _ in range(ROUNDS):
        left -= STEP
        inside = rows.join(live, "sid").where((F.col("h") >= F.col("low")) & (F.shiftright("h", left + STEP) == F.shiftright("low", left + STEP)))
        sums = inside.groupBy("sid", "budget", "low", F.shiftright("h", left).alias("bucket")).agg(F.sum("size").alias("bytes"))
        ends = _budget_bucket(sums)
        live = cut_lineage(live.join(ends, "sid").select(
            "sid", (F.col("budget") - F.col("before")).alias("budget"), F.shiftleft("bucket", left).alias("low"),
        ))
    # the last bucket holds about a millionth of a source: one row per hash, cut where the sum is nearest
    inside = rows.join(live, "sid").where((F.col("h") >= F.col("low")) & (F.shiftright("h", left) == F.shiftright("low", left)))
    sums = inside.groupBy("sid", "budget", F.col("h").alias("bucket")).agg(F.sum("size").alias("bytes"))
    ends = sums.join(_budget_bucket(sums).withColumnsRenamed({"bucket": "end_", "before": "before_"}), "sid").where("bucket = end_")
    nearer = F.col("before_") + F.col("bytes") - F.col("budget") < F.col("budget") - F.col("before_")
    cuts = cut_lineage(ends.select("sid", F.when(nearer, F.col("bucket") + 1).otherwise(F.col("bucket")).alias("threshold")))
    # without a bucket in which the sum is over the budget there is nothing left to take beyond it: take all
    plan = cut_lineage(goals.join(cuts, "sid", "left").select(
        F.col("sid").alias("_sid"), "source_size", "target", "passes",
        F.when(F.col("budget") <= 0, F.lit(0)).otherwise(F.coalesce("threshold", F.lit(1 << BITS))).alias("threshold"),
    ))
    copies = (F.col("passes") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)).cast("long")
    return rows.join(plan, F.col("sid") == F.col("_sid")).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"),
    )


def mix_documents(docs: DataFrame, size: Column, weights: list[float], total: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixed documents themselves, each as often as it is taken, all columns as they were.

    Rows that share a doc_id share their number of copies.
    """
    taken = mix(docs, size, weights, total, most).groupBy("doc_id", "source").agg(F.max("copies").alias("_llm_n")).where("_llm_n > 0")
    taken = taken.select(F.col("doc_id").alias("_llm_id"), F.col("source").alias("_llm_source"), "_llm_n")
    same = F.col("doc_id").eqNullSafe(F.col("_llm_id")) & F.col("source").eqNullSafe(F.col("_llm_source"))
    return docs.join(taken, same).withColumn("_llm_copy", F.explode(F.sequence(F.lit(1), F.col("_llm_n").cast("int")))).select(*[docs[c] for c in docs.columns])

"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash.  A document finishes at the
source's tokens up to and with it, divided by the source's target; sorting all
documents by that virtual time interleaves the sources at their target rates.
The queue is cut where the total budget is used up.  A source whose target is
above its size goes round again: its n-th round starts one source size later.

Both running sums are taken in two steps, over buckets first (of the shuffle
hash, of the virtual time) and then inside a bucket, so no source and no queue
sits in one task; the buckets of one source are a bounded number of rows.

Sizes are counted once, into a table with a number for each row.

Defined cases: every row has its row in the mix, also equal ones, those without
doc_id and those of one doc_id; a null text has size 0, and documents of size 0 are
never taken; sources sort by code point with null last; equal rows share one shuffle
place and stand there in any order, which changes no total; an empty table gives an
empty mix; extra columns stay; the sources are one small table, a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import WORD, hidden, settle, shown, spread

#: The weights of the sources in their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source gives more than so many times its size.
ROUNDS = 3
#: Buckets of the shuffle hash and of virtual time, for the two-step sums.
BUCKETS = 4096


def size_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    """(source, source_size, budget, target), a source a row, with its target: all sizes shared by weight, none
    above ``rounds`` times its source's size, the excess shared again by weight.

    That is the level L with sum(min(rounds * size, L * weight)) = total.  Sources
    fill up in the order of size / weight, so running sums in that order give L."""
    spec = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("_k") - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("_cap") / F.col("_w"), F.col("_k"))
    return (
        sizes.withColumn("_k", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("_w", spec).withColumn("_cap", F.col("source_size").cast("double") * rounds)
        .withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_open"))
        # the first source that doesn't fill up gives the level; from it on, these only fall
        .withColumn("_level", F.max(F.when(F.col("_cap") >= F.col("_level") * F.col("_w"), F.col("_level"))).over(everything))
        .select("source", "source_size", F.col("_total").cast("long").alias("budget"), F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))
    )


def _running(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` up to and with each row, by group, in two steps."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(sums, [*group, bucket]).withColumn(out, F.col("_offset") + F.sum(value).over(within)).drop("_offset")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, rounds: int = ROUNDS, seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, place, print) of every row; ``print``, a hash
    of the text, tells equal doc_ids apart."""
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), spread(F.col("doc_id"), seed).alias("place"), F.xxhash64("text").alias("print"))
    rows = settle(rows.withColumn("_n", F.monotonically_increasing_id()), "sizes")
    per_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, rounds).withColumn("_s", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()))
    rows = rows.join(per_source.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_bucket", F.floor(F.col("place") / 2.0**60 * buckets))
    # group by a hash of the source: window keys must not be null-sensitive, and a hash is shorter
    rows = _running(rows, ["_s"], "_bucket", ["place", "doc_id", "size", "print", "_n"], "size", "_cum")
    copies = F.when((F.col("size") > 0) & (F.col("target") > 0), F.ceil(F.col("target") / F.col("source_size")).cast("int")).otherwise(0)
    queue = rows.select(
        "*", F.explode_outer(F.when(copies > 0, F.sequence(F.lit(1), F.least(copies, F.lit(rounds))))).alias("_round")
    ).withColumn("_finish", (F.col("_cum") + (F.col("_round") - 1) * F.col("source_size")) / F.col("target"))
    # what isn't taken stands before the queue, spread over as many slices
    queue = queue.withColumn("_slice", F.coalesce(F.floor(F.col("_finish") * buckets / rounds), -1 - F.col("_bucket")))
    queue = queue.withColumn("_use", F.when(F.col("_round").isNotNull(), F.col("size")).otherwise(0).cast("long"))
    queue = _running(queue, [], "_slice", ["_finish", "place", "doc_id", "print", "_n"], "_use", "_used")
    taken = F.sum(F.when(F.col("_used") <= F.col("budget"), F.col("_use")).otherwise(0))
    one = lambda c: F.first(c).alias(c)
    return queue.groupBy("_n").agg(*map(one, ("doc_id", "source", "place", "print", "size", "source_size", "target")), taken.alias("taken")).drop("_n")


def apply(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each as often as its words are taken whole."""
    plan = mix(docs, weights, rounds, seed).where("taken > 0").groupBy(F.col("doc_id").alias("_d"), F.col("print").alias("_p"), F.col("source").alias("_s")).agg(F.sum("taken").alias("_t"), F.max("size").alias("_n"))
    x, own = hidden(docs)
    doc_id, source = own["doc_id"], own["source"]
    x = x.withColumn("_print", F.xxhash64(F.col(own["text"])))
    x = x.join(plan, F.col(doc_id).eqNullSafe(F.col("_d")) & (F.col("_print") == F.col("_p")) & F.col(source).eqNullSafe(F.col("_s")))
    # equal rows share their plan evenly: each gets the mean, the first ones the rest
    equal = Window.partitionBy("_print", doc_id, source)
    x = x.withColumn("_k", F.row_number().over(equal.orderBy("_t")) - 1).withColumn("_m", F.count(F.lit(1)).over(equal))
    whole = F.floor(F.col("_t") / F.col("_n"))
    copies = (F.floor(whole / F.col("_m")) + (F.col("_k") < F.pmod(whole, F.col("_m"))).cast("int")).cast("int")
    x = x.withColumn("_copies", copies).where("_copies > 0")
    return x.withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*shown(own))

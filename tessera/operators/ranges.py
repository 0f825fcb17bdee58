"""The queue of id ranges still to be collected (a small table; seq is the place in the queue)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SOURCES, STATUSES = ("probe", "latest"), ("pending", "active")
FIELDS = ("seq", "upper_id", "lower_id", "cursor_id", "source", "status")


def _within(cursor: Column) -> Column:
    low, high = F.col("lower_id") + 1, F.col("upper_id") + 1
    return F.least(F.greatest(F.coalesce(cursor, high), low), high)


def compact(ranges: DataFrame, head: int | None = None) -> DataFrame:
    """Invalid ranges go, cursors are clamped, of equal (upper, lower) the first stays.  With ``head``,
    upper ends are clamped to it first."""
    if head is not None:
        ranges = ranges.withColumn("upper_id", F.least("upper_id", F.lit(head)))
    valid = ranges.where((F.col("upper_id") > 0) & (F.col("lower_id") > 0) & (F.col("upper_id") >= F.col("lower_id")))
    first = valid.withColumn("_n", F.row_number().over(W.partitionBy("upper_id", "lower_id").orderBy("seq"))).where("_n = 1")
    return first.select("seq", "upper_id", "lower_id", _within(F.col("cursor_id")).alias("cursor_id"), F.when(F.col("source").isin(*SOURCES), F.col("source")).otherwise("probe").alias("source"), F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("pending").alias("status"))


def latest_gap(stats: DataFrame, head: int, threshold: int) -> DataFrame:
    """The range from above the greatest id (max_id, -1 if none) to ``head``, if it is wide enough."""
    top = F.greatest(F.col("max_id"), F.lit(0))
    return stats.where(F.lit(head) - top >= threshold).select(F.lit(-1).cast("bigint").alias("seq"), F.lit(head).cast("bigint").alias("upper_id"), F.greatest(F.lit(1), top + 1).cast("bigint").alias("lower_id"), F.lit(head + 1).cast("bigint").alias("cursor_id"), F.lit("latest").alias("source"), F.lit("active").alias("status"))


def prioritise(queue: DataFrame, latest: DataFrame) -> DataFrame:
    """The latest range first and active, with the cursor of the same range in the queue if it is there;
    all others follow as pending.  Without a latest range the queue stays as it is."""
    keys = ["upper_id", "lower_id"]
    known = latest.select(*keys, F.col("cursor_id").alias("fresh"), F.lit(True).alias("is_latest"))
    joined = queue.join(F.broadcast(known), keys, "full").crossJoin(F.broadcast(latest.agg((F.count(F.lit(1)) > 0).alias("any"))))
    first = F.coalesce("is_latest", F.lit(False))
    cursor = F.coalesce(F.when(first, _within(F.col("cursor_id"))), F.col("cursor_id"), F.col("fresh"))
    row = joined.select(F.when(first, F.lit(-1)).otherwise(F.col("seq")).alias("seq"), *keys, F.when(F.col("seq").isNull(), F.col("fresh")).otherwise(cursor).alias("cursor_id"), F.when(first, F.lit("latest")).otherwise(F.col("source")).alias("source"), F.when(first, F.lit("active")).when(F.col("any"), F.lit("pending")).otherwise(F.col("status")).alias("status"))
    return renumbered(row)


def renumbered(queue: DataFrame) -> DataFrame:
    return queue.withColumn("seq", (F.row_number().over(W.orderBy("seq")) - 1).cast("bigint")).select(*FIELDS)


def enqueue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """New (upper, lower) ranges go to the end."""
    after = queue.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_end"))
    fresh = new.join(queue, ["upper_id", "lower_id"], "left_anti").crossJoin(F.broadcast(after)).withColumn("seq", F.col("seq") + F.col("_end") + 1)
    return renumbered(queue.select(*FIELDS).unionByName(fresh.select(*FIELDS)))


def plan(queue: DataFrame, latest: DataFrame, probed: DataFrame, probe_limit: int = 1) -> DataFrame:
    """The latest gap leads; probed ranges are added only to an empty queue, ``probe_limit`` of them."""
    ordered = prioritise(queue, latest)
    empty = ordered.limit(1).agg((F.count(F.lit(1)) == 0).alias("_empty"))
    added = probed.where(F.col("nth") < probe_limit).crossJoin(F.broadcast(empty)).where("_empty").select(F.col("nth").alias("seq"), "upper_id", "lower_id", (F.col("upper_id") + 1).alias("cursor_id"), F.lit("probe").alias("source"), F.lit("pending").alias("status"))
    return enqueue(ordered, added)


def activate(queue: DataFrame) -> DataFrame:
    first = queue.agg(F.min("seq").alias("_first"))
    return queue.crossJoin(F.broadcast(first)).withColumn("status", F.when(F.col("seq") == F.col("_first"), "active").otherwise(F.col("status"))).select(*FIELDS)


def complete(queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue without its head, one row probe_resume_id)."""
    first = queue.agg(F.min_by("lower_id", "seq").alias("low"), F.min("seq").alias("_first"))
    rest = queue.crossJoin(F.broadcast(first.select("_first"))).where("seq <> _first").select(*FIELDS)
    return rest, first.select(F.greatest(F.lit(0), F.col("low") - 1).cast("bigint").alias("probe_resume_id"))


def compact_failures(failures: DataFrame, keep: int = 5000) -> DataFrame:
    """Distinct ids, the greatest ``keep`` of them."""
    return failures.select("id").distinct().orderBy(F.col("id").desc()).limit(keep)

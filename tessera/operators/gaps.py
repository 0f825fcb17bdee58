"""Missing id ranges: exact, and as a sparse probe with a phase would find them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _neighbours(ids: DataFrame, width: int) -> DataFrame:
    """a, b: each id and the next one (null for the last).  Windows run within ranges of ``width`` ids;
    only the first id of each range is ordered globally."""
    sharded = ids.select(F.col("id").alias("a")).distinct().withColumn("shard", F.floor(F.col("a") / width))
    inside = sharded.withColumn("near", F.lead("a").over(W.partitionBy("shard").orderBy("a")))
    first = sharded.groupBy("shard").agg(F.min("a").alias("first"))
    after = first.select("shard", F.lead("first").over(W.orderBy("shard")).alias("after"))
    return inside.join(after, "shard").select("a", F.coalesce("near", "after").alias("b"))


def exact_gaps(ids: DataFrame, threshold: int, width: int = 1 << 16) -> DataFrame:
    """upper_id, lower_id of every gap of ``threshold`` ids or more between existing ids."""
    return _neighbours(ids, width).where(F.col("b") - F.col("a") - 1 >= threshold).select((F.col("b") - 1).alias("upper_id"), (F.col("a") + 1).alias("lower_id"))


def probed_gaps(ids: DataFrame, head: int, threshold: int, probe_step: int, floor: int = 1, width: int = 1 << 16) -> DataFrame:
    """upper_id, lower_id, lower_existing_id, upper_existing_id in the order of discovery (nth).

    A probe walks down from ``head`` in steps; only pairs of neighbours that are far enough apart can
    stop it, so these few candidates are folded in descending order with the probe's phase as state.
    """
    step = max(1, min(probe_step, max(1, threshold - 1)))
    floor = max(1, floor)
    pairs = _neighbours(ids, width).where((F.col("b") - F.col("a") - 1 >= threshold) | F.col("b").isNull())
    low = ids.agg(F.min("id").alias("m"))
    gathered = pairs.agg(F.sort_array(F.collect_list(F.struct("a", "b")), False).alias("found")).crossJoin(low)
    start = F.struct(F.lit(max(1, head)).cast("bigint").alias("p"), F.lit(head < floor or head < 1).alias("over"), F.array().cast("array<struct<upper_id:bigint,lower_id:bigint,lower_existing_id:bigint,upper_existing_id:bigint>>").alias("out"))

    def landed(p, top):
        """Where the probe stands once it is at ``top`` or below."""
        return F.when(p <= top, p).otherwise(p - F.ceil((p - top) / step) * step).cast("bigint")

    def fold(acc, x):
        top = F.coalesce(x["b"] - 1, F.lit(head).cast("bigint"))
        p = landed(acc["p"], top)
        past = acc["over"] | (p < floor)
        hit = ~past & (acc["p"] > x["a"]) & (p > x["a"]) & (p - x["a"] >= threshold)
        item = F.struct(top.alias("upper_id"), (x["a"] + 1).alias("lower_id"), x["a"].alias("lower_existing_id"), x["b"].alias("upper_existing_id"))
        return F.struct(F.when(hit, x["a"] - 1).otherwise(acc["p"]).alias("p"), (acc["over"] | (past & (acc["p"] > x["a"]))).alias("over"), F.when(hit, F.concat(acc["out"], F.array(item))).otherwise(acc["out"]).alias("out"))

    folded = gathered.select("m", F.aggregate("found", start, fold).alias("s"))
    p = landed(F.col("s.p"), F.coalesce(F.col("m") - 1, F.lit(head).cast("bigint")))
    tail = F.when((F.lit(head) >= 1) & (p >= floor) & (p - floor + 1 >= threshold), F.array(F.struct(p.alias("upper_id"), F.lit(floor).cast("bigint").alias("lower_id"), F.lit(None).cast("bigint").alias("lower_existing_id"), F.lit(None).cast("bigint").alias("upper_existing_id"))))
    every = F.concat(F.col("s.out"), F.coalesce(tail, F.array().cast("array<struct<upper_id:bigint,lower_id:bigint,lower_existing_id:bigint,upper_existing_id:bigint>>")))
    return folded.select(F.posexplode(every).alias("nth", "r")).select(F.col("nth").cast("bigint").alias("nth"), "r.*")

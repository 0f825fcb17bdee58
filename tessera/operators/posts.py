"""The catalogue table: pages, lookups, statistics, nearest keys, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..functions.codec import media_url, post_url

COMPONENTS = ("c1", "c2", "c3", "c4", "c5")


def as_hits(posts: DataFrame, score: Column | None = None, config: Config | None = None) -> DataFrame:
    """Result rows: id as text, both URLs, rating, score (0.0 for unranked rows)."""
    return posts.select(F.col("id").cast("string").alias("id"), post_url(F.col("id"), config).alias("url"), media_url(*[F.col(c) for c in COMPONENTS], config).alias("media_url"), "rating", (F.lit(0.0) if score is None else score).alias("score"))


def recent(posts: DataFrame, limit: int, offset: int = 0, threshold: int = 3) -> DataFrame:
    """Newest rows; the rating filter follows the limit, so a page may be short."""
    return posts.orderBy(F.col("id").desc()).offset(offset).limit(limit).where(F.col("rating") <= threshold)


def by_id(posts: DataFrame, post_id: int) -> DataFrame:
    return posts.where(F.col("id") == post_id).limit(1)


def media_url_of(posts: DataFrame, post_id: int, config: Config | None = None) -> DataFrame:
    return by_id(posts, post_id).select(media_url(*[F.col(c) for c in COMPONENTS], config).alias("media_url"))


def ranked_lookup(hits: DataFrame, posts: DataFrame, key: str) -> DataFrame:
    """hits (hit, score, rank; a page at most) with their rows; unknown hits are dropped, and of rows
    with one key the greatest id counts."""
    rows = posts.join(F.broadcast(hits), posts[key] == hits["hit"])
    if key == "id":
        return rows
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("rank").orderBy(F.col("id").desc()))).where("_n = 1").drop("_n")


def stats(posts: DataFrame) -> DataFrame:
    edge = lambda f, c: F.coalesce(f(c), F.lit(-1)).cast("bigint")
    return posts.agg(F.count(F.lit(1)).alias("count"), edge(F.min, "id").alias("min_id"), edge(F.max, "id").alias("max_id"), edge(F.min, "vec_idx").alias("min_vec_idx"), edge(F.max, "vec_idx").alias("max_vec_idx"))


def coverage(posts: DataFrame) -> DataFrame:
    return posts.agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count(F.lit(1)).alias("rows")).withColumn("missing_in_span", F.greatest(F.lit(0), F.coalesce(F.col("max_id") - F.col("min_id") + 1 - F.col("rows"), F.lit(0))).cast("bigint"))


def nearest(probes: DataFrame, keys: DataFrame, forward: bool, shard_width: int = 1 << 16) -> DataFrame:
    """probe, found: the greatest key at or below each probe, or the least at or above (null if none).

    Keys are cut into ranges of ``shard_width`` ids; each range carries its own best key, so windows
    run within ranges and only one row a range is ordered globally.
    """
    best = F.min if forward else F.max
    both = probes.select(F.col("probe").alias("k"), F.lit(True).alias("asks")).unionByName(keys.select(F.col("key").alias("k"), F.lit(False).alias("asks")))
    both = both.withColumn("shard", F.floor(F.col("k") / shard_width))
    order = [F.col("k").desc(), F.col("asks")] if forward else [F.col("k"), F.col("asks")]
    inside = W.partitionBy("shard").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = both.withColumn("near", best(F.when(~F.col("asks"), F.col("k"))).over(inside)).where("asks")
    edges = both.where("not asks").groupBy("shard").agg(best("k").alias("edge"))
    asked = both.where("asks").select("shard").distinct()
    marks = asked.join(edges, "shard", "full")
    outside = W.orderBy(F.col("shard").desc() if forward else F.col("shard")).rowsBetween(W.unboundedPreceding, -1)
    carried = marks.select("shard", F.last("edge", ignorenulls=True).over(outside).alias("carried"))
    return local.join(carried, "shard").select(F.col("k").alias("probe"), F.coalesce("near", "carried").alias("found"))


def upsert(posts: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows of the batch replace those of the same id; of several the last in ``seq`` counts."""
    names = [c for c in batch.columns if c != seq]
    latest = batch.groupBy("id").agg(F.max_by(F.struct(*names), seq).alias("r")).select("r.*")
    return posts.join(latest.select("id"), "id", "left_anti").select(*names).unionByName(latest)

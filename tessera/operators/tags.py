"""Tag dictionary, tag features and tag probabilities."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vec import dot, doubles, norm


def dictionary(rows: DataFrame, order: str) -> DataFrame:
    """name, category, count in model order to the tag table; blank names are dropped before numbering.
    The dictionary is a dimension table of bounded size."""
    kept = rows.withColumn("name", F.trim("name")).where("name <> ''")
    number = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")).cast("bigint"), F.lit(0)).alias(c)
    return kept.select((F.row_number().over(W.orderBy(order)) - 1).cast("bigint").alias("tag_idx"), "name", number("category"), number("count"))


def with_prefix(tags: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    """Commonest names with the prefix (case counts); the prefix itself if there are none; nothing for
    an empty prefix."""
    prefix = prefix.strip()
    shown = tags.where(F.col("name").startswith(prefix) & F.lit(bool(prefix))).orderBy(F.col("count").desc(), "tag_idx").limit(limit).select("name", "category", "count")
    if not prefix:
        return shown
    gate = shown.limit(1).agg(F.count(F.lit(1)).alias("n"))
    return shown.unionByName(gate.where("n = 0").select(F.lit(prefix).alias("name"), F.lit(0).cast("bigint").alias("category"), F.lit(0).cast("bigint").alias("count")))


def features(head: DataFrame) -> DataFrame:
    """tag_idx, vector: the weight's direction, longer with the bias."""
    n, factor = norm(F.col("weight")), F.lit(1.0) + (F.atan(F.col("bias").cast("double")) + pi / 2) / pi
    return head.select("tag_idx", F.transform(doubles(F.col("weight")), lambda x: x / F.greatest(n, F.lit(1e-8)) * factor).alias("vector"))


def probabilities(vectors: DataFrame, head: DataFrame) -> DataFrame:
    """vec_idx, tag_idx, prob of the raw vectors (the head is a table of bounded size)."""
    logit = dot(F.col("emb"), F.col("weight")) + F.col("bias").cast("double")
    return vectors.crossJoin(F.broadcast(head)).select("vec_idx", "tag_idx", (1 / (1 + F.exp(-logit))).alias("prob"))


def likely(probs: DataFrame, tags: DataFrame, threshold: float = 0.1) -> DataFrame:
    """tag_name, probability above the threshold, the likeliest first."""
    return probs.where(F.col("prob") > threshold).join(tags.select("tag_idx", "name"), "tag_idx").orderBy(F.col("prob").desc(), "tag_idx").select(F.col("name").alias("tag_name"), F.col("prob").alias("probability"))

"""Merging of incoming record files into a versioned snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vec import u64_to_i64
from .posts import upsert

ORDER = ("path", "row_index")


def scan(spark: SparkSession, glob: str) -> DataFrame:
    """Incoming rows with their file and place in it: the order of files by name is the order of rows."""
    return spark.read.parquet(glob).select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row_index"))


def placed(rows: DataFrame) -> DataFrame:
    """Rows of a scan with row_index counted on over all files in the order of their names.

    Only the files' counts are ordered globally.
    """
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("path", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(starts), "path").withColumn("row_index", F.col("row_index") + F.col("_before")).drop("_before")


def accepted(incoming: DataFrame, threshold: int) -> DataFrame:
    return incoming.where(F.col("rating") <= threshold)


def new_rows(incoming: DataFrame, posts: DataFrame) -> DataFrame:
    return incoming.join(posts.select("id"), "id", "left_anti")


def known_rows(incoming: DataFrame, posts: DataFrame) -> DataFrame:
    return incoming.join(posts.select("id"), "id", "left_semi")


def numbered(rows: DataFrame, first: DataFrame, order: tuple[str, str] = ORDER, width: int = 1 << 16) -> DataFrame:
    """``rows`` with vec_idx: dense numbers after ``first`` (one row, max_vec_idx) in file and row order.

    Rows are ranked within stretches of a file; only the stretches' counts are ordered globally.
    """
    path, row = order
    cut = rows.withColumn("_stretch", F.floor(F.col(row) / width))
    counts = cut.groupBy(path, "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy(path, "_stretch").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(path, "_stretch", F.coalesce(before, F.lit(0)).alias("_before"))
    local = cut.withColumn("_rank", F.row_number().over(W.partitionBy(path, "_stretch").orderBy(row)))
    placed = local.join(starts, [path, "_stretch"]).crossJoin(F.broadcast(first))
    return placed.withColumn("vec_idx", (F.col("max_vec_idx") + F.col("_before") + F.col("_rank")).cast("bigint")).drop("_stretch", "_n", "_before", "_rank", "max_vec_idx")


def last_of_each_id(rows: DataFrame, order: tuple[str, str] = ORDER) -> DataFrame:
    """One row an id, the last in file and row order, so that no number is given to a replaced row."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(*[F.col(c).desc() for c in order]))).where("_n = 1").drop("_n")


def merge(posts: DataFrame, vectors: DataFrame, incoming: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(posts, vectors) with the new rows of ``incoming`` (see scan)."""
    fresh = last_of_each_id(new_rows(accepted(incoming, threshold), posts))
    top = posts.agg(F.coalesce(F.max("vec_idx"), F.lit(-1)).alias("max_vec_idx"))
    rows = numbered(fresh, top)
    table = rows.select("id", "rating", F.col("url_c1").alias("c1"), F.col("url_c2").alias("c2"), u64_to_i64(F.col("url_c3")).alias("c3"), u64_to_i64(F.col("url_c4")).alias("c4"), F.col("url_c5").alias("c5"), "vec_idx", F.col("vec_idx").alias("seq"))
    return upsert(posts, table), vectors.unionByName(rows.select("vec_idx", "emb"))


def rolling_files(rows: DataFrame, key: str, max_rows: int, prefix: str, stamp: str) -> DataFrame:
    """file_no, n, min_id, max_id, file_name of files of ``max_rows`` rows in key order (keys are dense)."""
    low = rows.agg(F.min(key).alias("_low"))
    numbered_files = rows.crossJoin(F.broadcast(low)).withColumn("file_no", F.floor((F.col(key) - F.col("_low")) / max_rows).cast("bigint"))
    stats = numbered_files.groupBy("file_no").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("min_id"), F.max(key).alias("max_id"))
    return stats.withColumn("file_name", F.format_string(f"{prefix}_{stamp}_%04d_%d-%d.parquet", "file_no", "max_id", "min_id"))


def write_rolling(rows: DataFrame, path: str, max_rows: int = 50_000, mode: str = "append") -> None:
    """Files of at most ``max_rows`` rows; a file is published by the commit protocol."""
    rows.write.mode(mode).option("maxRecordsPerFile", max_rows).parquet(path)

"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType(), False) for n in names]


POSTS = T.StructType(_longs("id", "rating", "c1", "c2", "c3", "c4", "c5", "vec_idx"))
INCOMING = T.StructType([*_longs("id", "rating", "url_c1", "url_c2"), *[T.StructField(n, T.DecimalType(20, 0), False) for n in ("url_c3", "url_c4")], *_longs("url_c5"), T.StructField("emb", T.ArrayType(T.FloatType()), False)])
VECTORS = T.StructType([*_longs("vec_idx"), T.StructField("emb", T.ArrayType(T.FloatType()), False)])
TAGS = T.StructType([*_longs("tag_idx"), T.StructField("name", T.StringType(), False), *_longs("category", "count")])
TAG_HEAD = T.StructType([*_longs("tag_idx"), T.StructField("weight", T.ArrayType(T.FloatType()), False), T.StructField("bias", T.FloatType(), False)])
RANGES = T.StructType([*_longs("seq", "upper_id", "lower_id", "cursor_id"), T.StructField("source", T.StringType(), False), T.StructField("status", T.StringType(), False)])
HITS = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("url", T.StringType(), False), T.StructField("media_url", T.StringType(), False), *_longs("rating"), T.StructField("score", T.DoubleType(), False)])
VARIANT = T.StructType([T.StructField("url", T.StringType()), T.StructField("type", T.StringType()), T.StructField("file_ext", T.StringType()), T.StructField("width", T.LongType()), T.StructField("height", T.LongType())])
SOURCE_POST = T.StructType([T.StructField("id", T.LongType()), T.StructField("is_deleted", T.BooleanType()), T.StructField("rating", T.StringType()), T.StructField("media_asset", T.StructType([T.StructField("variants", T.ArrayType(VARIANT))])), *[T.StructField(n, T.StringType()) for n in ("preview_file_url", "large_file_url", "file_url")]])

"""One-off migration of an older cache: metadata joined with an id map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_field(df: DataFrame, names: tuple[str, ...], default: int | None = None):
    """The first of the candidate columns that is there, else the default."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    if default is None:
        raise ValueError(f"none of {names} in {df.columns}")
    return F.lit(default)


def migrate(metadata: DataFrame, id_map: DataFrame) -> DataFrame:
    """Posts of the metadata rows that the map knows; of several entries the least index counts."""
    fields = {"id": first_field(metadata, ("id",)), "rating": first_field(metadata, ("rating",), 0)}
    fields |= {c: first_field(metadata, (c, f"url_{c}"), 0) for c in ("c1", "c2", "c3", "c4", "c5")}
    rows = metadata.select(*[v.cast("bigint").alias(k) for k, v in fields.items()])
    index = id_map.select(first_field(id_map, ("id", "_1")).cast("bigint").alias("id"), first_field(id_map, ("idx", "index", "_2")).cast("bigint").alias("i")).groupBy("id").agg(F.min("i").alias("i"))
    return rows.join(index, "id", "left").withColumn("vec_idx", F.coalesce("i", F.lit(-1))).where("vec_idx >= 0").drop("i")

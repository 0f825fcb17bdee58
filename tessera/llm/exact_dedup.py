"""Exact dedup by content sort (DataFrame functions only).

Sampled splitters range-partition the normalised text; every bucket is sorted by Spark's external
sort, which puts equal texts next to each other; each row is compared in full with its
predecessor.  A splitter also carries the identifier, so a text that a third of all rows share is
spread over as many buckets as its bytes need, and the runs that meet at bucket seams (two per
bucket at most) are joined afterwards.
"""

from __future__ import annotations

from itertools import batched
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch, documents, shuffle_parts, text_or_empty

#: Characters of the text at the head of a sort key; the digest of the whole follows it.
HEAD = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE_CLASS}+", " ")


def _sort_key(norm: Column, row_id: Column) -> Column:
    return F.struct(F.substring(norm, 1, HEAD).alias("a"), F.sha2(norm, 256).alias("b"), F.coalesce(row_id.cast("string"), F.lit("~")).alias("c"))


def sampled_splitters(docs: DataFrame, id_col: str, text_col: str, buckets: int, per_bucket: int, seed: int = 17) -> list[tuple]:
    """Splitters with about equal bytes between them, from ``per_bucket * buckets`` sampled rows.

    The sample only sets bucket sizes; no result depends on it.  A splitter is a few hundred bytes
    however long the texts are.
    """
    rows = docs.count()
    if rows == 0 or buckets < 2:
        return []
    norm = normalised(text_or_empty(text_col))
    share = min(1.0, per_bucket * buckets / rows)
    drawn = docs.sample(fraction=share, seed=seed) if share < 1 else docs
    found = drawn.select(_sort_key(norm, F.col(id_col)).alias("k"), (F.octet_length(norm) + HEAD).alias("w")).collect()
    keyed = sorted(((*r["k"], r["w"]) for r in found), key=lambda x: x[:3])
    step, seen, out = sum(x[3] for x in keyed) / buckets, 0, []
    for *key, weight in keyed:
        seen += weight
        if seen >= step * (len(out) + 1) and len(out) < buckets - 1 and (not out or tuple(key) > out[-1]):
            out.append(tuple(key))
    return out


def _literal(keys: list[tuple]) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in keys])


def bucket_of(key: Column, splitters: list[tuple]) -> Column:
    """How many splitters are at or below the key: two levels, so about 2 * sqrt(n) comparisons."""
    if not splitters:
        return F.lit(0)
    fan = isqrt(len(splitters)) + 1
    groups = [list(g) for g in batched(splitters, fan)]
    below = lambda keys: F.size(F.filter(keys, lambda s: s <= key))
    coarse = F.greatest(below(_literal([g[0] for g in groups])) - 1, F.lit(0))
    fine = F.element_at(F.array(*[_literal(g) for g in groups]), coarse + 1)
    return (coarse * fan + below(fine)).cast("int")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, buckets: int | None = None, per_bucket: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and ``row`` (the whole input row) if ``carry``.

    Null text counts as empty, so null and empty texts (not texts of white space only, which
    become one space) are equal.  Of rows with one text and one identifier a single row is kept.
    A null identifier ranks after all others; keep_id is null only where a group has no other.
    Columns besides the two named ones are never read unless carried.  An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    n = buckets or shuffle_parts(spark)
    splitters = sampled_splitters(docs, id_col, text_col, n, per_bucket)
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    keyed = source.withColumn("key", _sort_key(normalised(F.col("body")), F.col("id")))
    dealt = keyed.select("*", bucket_of(F.col("key"), splitters).alias("bucket")).repartition(n, "bucket")
    if carry:  # the text travels once, inside the row
        dealt = dealt.drop("body").withColumn("body", F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")))
    norm = dealt.select("bucket", "id", "key.a", "key.b", normalised(F.col("body")).alias("norm"), *(["row"] if carry else []))
    # equal rows are alike in all that is returned; other columns break the remaining ties
    tie = [F.xxhash64("row")] if carry else []
    order = W.partitionBy("bucket").orderBy("a", "b", "norm", F.col("id").asc_nulls_last(), *tie)
    before = F.lag("norm").over(order)
    marked = norm.select("bucket", "id", "b", *(["row"] if carry else []), (before.isNull() | (before != F.col("norm"))).alias("first"), F.row_number().over(order).alias("pos"))
    runs = marked.withColumn("run", F.sum(F.col("first").cast("long")).over(W.partitionBy("bucket").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    of_run, of_bucket = W.partitionBy("bucket", "run"), W.partitionBy("bucket")
    runs = runs.withColumns({"n": F.count(F.lit(1)).over(of_run), "low": F.min("id").over(of_run)}).withColumn("last", F.max("run").over(of_bucket))
    kept = Scratch(spark).keep(runs.drop("pos"), "runs")
    seam = kept.where(F.col("first") & ((F.col("run") == 1) | (F.col("run") == F.col("last")))).select("bucket", "run", "b", "n", "low")
    merged = seam.groupBy("b").agg(F.sum("n").alias("all_n"), F.min("low").alias("all_low"), F.min(F.struct(F.col("low").isNull(), "low", "bucket"))["bucket"].alias("home"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    # two rows a bucket at most
    fixed = F.broadcast(seam.join(merged, "b").select("bucket", "run", "all_n", "all_low", (F.col("bucket") == F.col("home")).alias("is_home")))
    return kept.join(fixed, ["bucket", "run"], "left").select(
        F.col("id").alias("doc_id"),
        F.coalesce("all_low", "low").alias("keep_id"),
        F.coalesce("all_n", "n").alias("group_size"),
        (F.col("first") & F.coalesce("is_home", F.lit(True))).alias("kept"),
        F.col("b").alias("text_sha256"),
        *(["row"] if carry else []),
    )


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

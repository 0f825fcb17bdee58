"""Composition of query vectors and ranked search with explicit fallbacks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..functions.vec import dot, doubles, unit
from .posts import as_hits, ranked_lookup, recent


def compose(parts: DataFrame) -> DataFrame:
    """parts (vector, weight) to (pos, val) of the weighted sum."""
    return parts.select("weight", F.posexplode(doubles(F.col("vector"))).alias("pos", "x")).groupBy("pos").agg(F.sum(F.col("x") * F.col("weight")).alias("val"))


def as_vector(composed: DataFrame) -> DataFrame:
    """(pos, val) of one vector, of fixed width, to one row (vector)."""
    return composed.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "val"))), lambda x: x["val"]).alias("vector"))


def image_weights(count: int, weights: list[float] | None) -> list[float]:
    given = list(weights or [])[:count]
    return given + [1.0] * (count - len(given))


def score(query: Column, vector: Column) -> Column:
    """Rounded, so that ranks do not hang on the order of a sum."""
    return F.round(dot(query, vector), 6)


def top_k(query: DataFrame, vectors: DataFrame, k: int, key: str = "vec_idx", emb: str = "emb") -> DataFrame:
    """hit, score, rank of the k best inner products with the normalised query (one row, vector)."""
    one = F.broadcast(query.select(unit(F.col("vector")).alias("q")))
    best = vectors.crossJoin(one).select(F.col(key).alias("hit"), score(F.col("q"), F.col(emb)).alias("score")).orderBy(F.col("score").desc(), "hit").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "hit")))


#: Bytes of query vectors that one block broadcasts.
BLOCK_BYTES = 64 << 20


def blocks_of(queries: DataFrame, bytes_each: Column | None = None) -> list[DataFrame]:
    """``queries`` (query_id, vector) cut by a hash of query_id into blocks of about BLOCK_BYTES."""
    each = F.size("vector") * 8 if bytes_each is None else bytes_each
    total = queries.agg(F.coalesce(F.sum(each.cast("bigint")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // BLOCK_BYTES))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else queries for i in range(blocks)]


def best_each(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query; partitions pass on their own k best only."""
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "hit")))
    return ranked.where(F.col("rank") <= k)


def top_k_each(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, hit, score, rank of the k best for each query vector (query_id, vector), block by block."""

    def block(part: DataFrame) -> DataFrame:
        asked = F.broadcast(part.select("query_id", unit(F.col("vector")).alias("q")))
        return best_each(vectors.crossJoin(asked).select("query_id", F.col("vec_idx").alias("hit"), score(F.col("q"), F.col("emb")).alias("score")), k)

    return reduce(DataFrame.unionByName, map(block, blocks_of(queries)))


def page_of(hits: DataFrame, limit: int, offset: int) -> DataFrame:
    """The slice is taken before rows are looked up; padding (ids below 0) is dropped."""
    return hits.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit) & (F.col("hit") >= 0))


def ranked_hits(hits: DataFrame, posts: DataFrame, key: str, threshold: int, config: Config | None = None) -> DataFrame:
    rows = ranked_lookup(hits, posts, key).where(F.col("rating") <= threshold)
    return as_hits(rows, F.col("score"), config)


def first_of(found: DataFrame, fallback: DataFrame) -> DataFrame:
    """``found`` if it has rows, else ``fallback``, in one lazy plan."""
    gate = found.limit(1).agg(F.count(F.lit(1)).alias("_n"))
    return found.unionByName(fallback.crossJoin(F.broadcast(gate)).where("_n = 0").drop("_n"))


@dataclass
class Request:
    text: str = ""
    has_known_tags: bool = False
    has_id: bool = False
    n_images: int = 0
    limit: int = 100
    offset: int = 0


def search_with_mode(request: Request, query: DataFrame | None, vectors: DataFrame | None, posts: DataFrame, id_mode: str = "vec_idx", threshold: int = 3, config: Config | None = None, hits: DataFrame | None = None) -> DataFrame:
    """Result rows with ``mode`` and ``reason``; ``query`` is None where nothing gave a vector and
    ``vectors`` is None while the index isn't there."""
    config = config or Config()
    told = lambda rows, mode, reason: rows.withColumns({"mode": F.lit(mode), "reason": F.lit(reason)})
    fallback = lambda reason, offset: told(as_hits(recent(posts, request.limit, offset, threshold), None, config), "recent", reason)
    if request.text and not request.has_known_tags and not request.has_id and not request.n_images:
        return fallback("unknown_tags_only", request.offset)
    if query is None and hits is None:
        return fallback("empty_query", request.offset)
    if vectors is None and hits is None:
        return fallback("index_not_ready", 0)
    key, reason = ("id", "faiss_match_idmap") if id_mode == "post_id" else ("vec_idx", "faiss_match_vecidx")
    k = max(request.offset + request.limit, config.recent_default_limit)
    all_hits = hits if hits is not None else top_k(query, vectors, k)
    page = page_of(all_hits, request.limit, request.offset)
    found = told(ranked_hits(page, posts, key, threshold, config), "vector", reason)
    some = all_hits.where("hit >= 0").limit(1).agg(F.when(F.count(F.lit(1)) > 0, F.lit("db_map_empty")).otherwise(F.lit("faiss_empty")).alias("_why"))
    rest = fallback("", 0).drop("reason").crossJoin(F.broadcast(some)).withColumnRenamed("_why", "reason")
    return first_of(found, rest.select(*found.columns))


def final_fallback(rows: DataFrame, posts: DataFrame, limit: int, threshold: int, config: Config | None = None) -> DataFrame:
    rest = as_hits(recent(posts, limit, 0, threshold), None, config).withColumns({"mode": F.lit("recent"), "reason": F.lit("final_empty_fallback")})
    return first_of(rows, rest)


def detect_id_mode(posts: DataFrame, vectors: DataFrame, index_key: str = "vec_idx") -> DataFrame:
    """One row (mode): post_id if the nearest entry to the newest post's own vector bears its id."""
    newest = posts.where("vec_idx >= 0").orderBy(F.col("id").desc()).limit(1).select(F.col("id").alias("post_id"), F.col("vec_idx").alias("own"))
    own = newest.join(vectors.select(F.col("vec_idx").alias("own"), F.col("emb").alias("vector")), "own")
    near = top_k(own.select("vector"), vectors, 1, index_key)
    return newest.join(near, newest["post_id"] == near["hit"], "left").agg(F.when(F.max("hit").isNotNull(), F.lit("post_id")).otherwise(F.lit("vec_idx")).alias("mode"))


def vector_of(posts: DataFrame, vectors: DataFrame, post_id: int) -> DataFrame:
    """vec_idx, emb of one post; no row if the id or its vector is unknown."""
    return posts.where(F.col("id") == post_id).select("vec_idx").limit(1).join(vectors, "vec_idx")

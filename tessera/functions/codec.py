"""Parsing and building of ratings, URLs and query texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from .vec import hex_to_u64, u64_to_i64

# Fixed values of the formats.
RATINGS = {"g": 0, "s": 1, "q": 2, "e": 3}
EXTENSIONS = {"jpg": 0, "png": 1, "jpeg": 2, "bmp": 3, "webp": 4}
SIZES = ("180x180", "360x360", "720x720", "sample", "original")
SUPPORTED = ("jpg", "jpeg", "png", "webp", "bmp")
ID_QUERY = r"(?i)(?:^|\s)id\s*:\s*(\d+)(?:$|\s)"
WEIGHTED_TAG = r"^\((.*):([^:]*)\)$"


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def rating_code(letter: Column) -> Column:
    return F.coalesce(_lookup(RATINGS, F.lower(F.trim(letter))), F.lit(0)).cast("bigint")


def extension_code(ext: Column) -> Column:
    return F.coalesce(_lookup(EXTENSIONS, F.lower(ext)), F.lit(0)).cast("bigint")


def extension_name(code: Column) -> Column:
    return F.coalesce(_lookup({v: k for k, v in EXTENSIONS.items()}, code.cast("int")), F.lit("jpg"))


def post_url(post_id: Column, config: Config | None = None) -> Column:
    return F.concat(F.lit(f"{(config or Config()).post_base}/posts/"), post_id.cast("string"))


def media_url(c1: Column, c2: Column, c3: Column, c4: Column, c5: Column, config: Config | None = None) -> Column:
    """%x of a negative long prints its unsigned bits."""
    return F.concat(F.lit(f"{(config or Config()).media_base}/720x720/"), F.format_string("%02x/%02x/%016x%016x.", c1, c2, c3, c4), extension_name(c5))


def parse_media_url(url: Column, config: Config | None = None) -> Column:
    """Struct c1..c5, or null where the URL has another form."""
    host = (config or Config()).media_base.partition("://")[2].replace(".", r"\.")
    pattern = rf"^https?://{host}/(?:{'|'.join(SIZES)})/([0-9a-f]{{2}})/([0-9a-f]{{2}})/([0-9a-f]{{32}})\.([A-Za-z0-9]+)$"
    group = lambda i: F.regexp_extract(url, pattern, i)
    byte = lambda i: F.conv(group(i), 16, 10).cast("bigint")
    half = lambda first: u64_to_i64(hex_to_u64(F.substring(group(3), first, 16)))
    parts = F.struct(byte(1).alias("c1"), byte(2).alias("c2"), half(1).alias("c3"), half(17).alias("c4"), extension_code(group(4)).alias("c5"))
    return F.when(url.rlike(pattern), parts)


def url_extension(url: Column) -> Column:
    """Lower-cased text after the last dot, without query and closing slashes; empty if there is none."""
    bare = F.regexp_replace(F.substring_index(url, "?", 1), "/+$", "")
    return F.when(bare.contains("."), F.lower(F.substring_index(bare, ".", -1))).otherwise(F.lit(""))


def absolute_url(url: Column, config: Config | None = None) -> Column:
    base = (config or Config()).post_base
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(url)


def query_id(text: Column) -> Column:
    """An all-digit text, or the first ``id: 42`` in it; null otherwise."""
    bare = F.trim(text)
    return F.when(bare.rlike(r"^\d+$"), bare.try_cast("bigint")).otherwise(F.nullif(F.regexp_extract(text, ID_QUERY, 1), F.lit("")).try_cast("bigint"))


def query_tokens(queries: DataFrame, text: str = "text") -> DataFrame:
    """Each row once per token: pos, token, weight.  ``(name:weight)`` has its last colon split; a bad
    weight leaves the whole token with weight 1."""
    split = queries.select("*", F.posexplode(F.split(F.regexp_replace(F.col(text), r"(?U)^\s+|\s+$", ""), r"(?U)\s+")).alias("pos", "raw")).where("raw <> ''")
    weight = F.regexp_extract("raw", WEIGHTED_TAG, 2).try_cast("double")
    weighted = F.col("raw").rlike(WEIGHTED_TAG) & weight.isNotNull()
    return split.withColumn("token", F.when(weighted, F.regexp_extract("raw", WEIGHTED_TAG, 1)).otherwise(F.col("raw"))).withColumn("weight", F.when(weighted, weight).otherwise(F.lit(1.0))).drop("raw")


def known_tags(queries: DataFrame, tags: DataFrame, text: str = "text") -> DataFrame:
    """query tokens that the dictionary has, with tag_idx; of equal names the last index counts."""
    names = tags.groupBy("name").agg(F.max("tag_idx").alias("tag_idx"))
    return query_tokens(queries, text).join(names, F.col("token") == F.col("name")).drop("name")

"""The engine's tables as views of the test tables (integer and md5 arithmetic only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vec import hex_to_u64, u64_to_i64

REASONS = {"click": "ok", "view": "deleted", "purchase": "no_supported_url", "signup": "embed_failed", "error": "http_429"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _post_id(v):
    return v + 1 + 40 * F.floor(v / 50)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    keyed = e.select(_post_id(F.col("vec_id")).cast("bigint").alias("id"), "label", "vec_id").withColumn("h", F.md5(F.col("id").cast("string").cast("binary")))
    byte = lambda at: F.conv(F.substring("h", at, 2), 16, 10).cast("bigint")
    half = lambda at: u64_to_i64(hex_to_u64(F.substring("h", at, 16)))
    return keyed.select("id", (F.col("label") % 4).cast("bigint").alias("rating"), byte(1).alias("c1"), byte(3).alias("c2"), half(1).alias("c3"), half(17).alias("c4"), (F.col("label") % 6).cast("bigint").alias("c5"), F.col("vec_id").alias("vec_idx"))


def vectors(spark: SparkSession, sf_dir: str, stretched: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    emb = F.transform("embedding", lambda x: (x.cast("double") * (1 + F.col("label") / 10.0))) if stretched else F.col("embedding")
    return e.select(F.col("vec_id").alias("vec_idx"), emb.alias("emb"))


def tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("name", F.regexp_replace("p_name", " ", "_"))
    return p.groupBy("name").agg((F.min("p_size") % 5).cast("bigint").alias("category"), F.count(F.lit(1)).alias("count"))


def tag_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("weight"))
    return e.select(F.col("label").cast("bigint").alias("tag_idx"), "weight", ((F.col("label") - 5) / 10.0).alias("bias"), F.concat(F.lit("tag_"), F.col("label").cast("string")).alias("name"))


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later, overlapping stretch of the catalogue with every tenth row twice."""
    e = table(spark, sf_dir, "embeddings")
    n = e.count() // 2
    rows = e.withColumn("v", F.col("vec_id") + n)
    twice = rows.where("vec_id % 10 = 0").withColumn("row_index", F.col("vec_id") + 1_000_000)
    both = rows.withColumn("row_index", F.col("vec_id")).unionByName(twice)
    return both.select(_post_id(F.col("v")).cast("bigint").alias("id"), (F.col("label") % 4).cast("bigint").alias("rating"), F.lit("a.parquet").alias("path"), "row_index")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    reasons = F.create_map(*[F.lit(x) for p in REASONS.items() for x in p])
    return e.select(F.col("event_id").alias("seq"), reasons[F.col("event_type")].alias("reason"), F.col("value").alias("download_sec"), ((F.col("event_id") % 7) / 10.0).alias("embed_sec"), F.col("user_id").alias("bytes"))


def source_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested source posts made from page numbers."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))
    i = F.col("id")
    hexes = F.md5(i.cast("string").cast("binary"))
    url = lambda size, ext: F.concat(F.lit(f"https://media.example.org/{size}/"), F.substring(hexes, 1, 2), F.lit("/"), F.substring(hexes, 3, 2), F.lit("/"), hexes, F.lit("."), ext)
    ext = F.element_at(F.array(*[F.lit(x) for x in ("jpg", "png", "webp", "mp4")]), (i % 4 + 1).cast("int"))
    one = lambda kind, w, here: F.when(here, F.struct(url(kind, ext).alias("url"), F.lit(kind).alias("type"), ext.alias("file_ext"), w.cast("bigint").alias("width"), (w + i % 300).cast("bigint").alias("height")))
    variants = F.filter(F.array(one("180x180", F.lit(180), i % 2 == 0), one("360x360", F.lit(360), i % 3 > 0), one("720x720", F.lit(720), i % 5 > 0), one("sample", 400 + i % 100, i % 7 > 2), one("original", 300 + i % 900, i % 11 > 1)), lambda v: v.isNotNull())
    letters = F.element_at(F.array(*[F.lit(x) for x in ("g", "s", " Q ", "E", "x")]), (i % 5 + 1).cast("int"))
    small = F.when(i % 13 == 0, F.concat(F.lit("//media.example.org/small/"), i.cast("string"), F.lit(".jpg?x=1")))
    return p.select("id", (i % 17 == 3).alias("is_deleted"), letters.alias("rating"), F.struct(variants.alias("variants")).alias("media_asset"), small.alias("preview_file_url"), F.lit(None).cast("string").alias("large_file_url"), F.when(i % 19 == 0, F.lit("/data/x.png")).alias("file_url"))


#: The same views in DuckDB SQL.
SIGNED = "CASE WHEN {0} >= 9223372036854775808 THEN ({0}::HUGEINT - 18446744073709551616)::BIGINT ELSE {0}::BIGINT END"
POSTS = f"""
_p AS (SELECT (vec_id + 1 + 40 * (vec_id // 50))::BIGINT AS id, label, vec_id FROM embeddings),
_h AS (SELECT *, md5(id::VARCHAR) AS h FROM _p),
_u AS (SELECT *, ('0x' || substr(h, 1, 16))::UBIGINT AS u3, ('0x' || substr(h, 17, 16))::UBIGINT AS u4 FROM _h),
posts AS (SELECT id, (label % 4)::BIGINT AS rating, ('0x' || substr(h, 1, 2))::BIGINT AS c1, ('0x' || substr(h, 3, 2))::BIGINT AS c2, {SIGNED.format('u3')} AS c3, {SIGNED.format('u4')} AS c4, (label % 6)::BIGINT AS c5, vec_id AS vec_idx, h FROM _u),
hits AS (SELECT *, id::VARCHAR AS sid, 'https://posts.example.org/posts/' || id AS url,
  'https://media.example.org/720x720/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h || '.' || CASE c5 WHEN 1 THEN 'png' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'bmp' WHEN 4 THEN 'webp' ELSE 'jpg' END AS media_url FROM posts)"""
VECTORS = "vectors AS (SELECT vec_id AS vec_idx, embedding::DOUBLE[] AS emb FROM embeddings)"
STRETCHED = "vectors AS (SELECT vec_id AS vec_idx, list_transform(embedding::DOUBLE[], lambda x: x * (1 + label / 10.0::DOUBLE)) AS emb FROM embeddings)"
TAGS = "_t AS (SELECT replace(p_name, ' ', '_') AS name, (min(p_size) % 5)::BIGINT AS category, count(*)::BIGINT AS count FROM part GROUP BY 1),\ntags AS (SELECT (row_number() OVER (ORDER BY name) - 1)::BIGINT AS tag_idx, * FROM _t)"
HEAD = "head AS (SELECT label::BIGINT AS tag_idx, arg_min(embedding, vec_id)::DOUBLE[] AS weight, (label - 5) / 10.0::DOUBLE AS bias, 'tag_' || label AS name FROM embeddings GROUP BY label)"
INCOMING = """_n AS (SELECT count(*) // 2 AS n FROM embeddings),
_r AS (SELECT vec_id, vec_id + n AS v, label FROM embeddings, _n),
incoming AS (SELECT (v + 1 + 40 * (v // 50))::BIGINT AS id, (label % 4)::BIGINT AS rating, 'a.parquet' AS path, row_index FROM (SELECT *, vec_id AS row_index FROM _r UNION ALL SELECT *, vec_id + 1000000 FROM _r WHERE vec_id % 10 = 0))"""
EVENTS = "records AS (SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'ok' WHEN 'view' THEN 'deleted' WHEN 'purchase' THEN 'no_supported_url' WHEN 'signup' THEN 'embed_failed' ELSE 'http_429' END AS reason, value AS download_sec, (event_id % 7) / 10.0::DOUBLE AS embed_sec, user_id AS bytes FROM events)"
SOURCE_POSTS = """_x AS (SELECT page_id AS id, md5(page_id::VARCHAR) AS h, ['jpg', 'png', 'webp', 'mp4'][page_id % 4 + 1] AS ext FROM pages),
_k AS (SELECT * FROM (VALUES (0, '180x180', 4), (1, '360x360', 3), (2, '720x720', 1), (3, 'sample', 0), (4, 'original', 2)) k(nth, type, rank)),
variants AS (SELECT id, nth, type, rank, ext, 'https://media.example.org/' || type || '/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h || '.' || ext AS url,
  CASE nth WHEN 0 THEN 180 WHEN 1 THEN 360 WHEN 2 THEN 720 WHEN 3 THEN 400 + id % 100 ELSE 300 + id % 900 END AS width
  FROM _x, _k WHERE CASE nth WHEN 0 THEN id % 2 = 0 WHEN 1 THEN id % 3 > 0 WHEN 2 THEN id % 5 > 0 WHEN 3 THEN id % 7 > 2 ELSE id % 11 > 1 END),
best AS (SELECT id, url AS best_url FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (width > 0 AND width < 448)::INT, rank, nth) AS n FROM variants WHERE ext IN ('jpg', 'jpeg', 'png', 'webp', 'bmp')) WHERE n = 1),
source AS (SELECT _x.id, id % 17 = 3 AS is_deleted, ['g', 's', ' Q ', 'E', 'x'][id % 5 + 1] AS rating,
  coalesce(best_url, CASE WHEN id % 13 = 0 THEN 'https://media.example.org/small/' || id || '.jpg?x=1' END, CASE WHEN id % 19 = 0 THEN 'https://posts.example.org/data/x.png' END) AS image_url,
  (SELECT min(url) FROM variants v WHERE v.id = _x.id AND type = '720x720') AS record_url FROM _x LEFT JOIN best USING (id))"""

"""All queries of the engine and their SQL.  Each query is a thin binding of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import codec, vec
from ..llm.common import Scratch
from ..operators import gaps, incremental, ingest, ivf, legacy, posts, ranges, search, tags
from ..sources import bindings as b
from ..sources import paged

FLAGSHIP = "search_by_id"
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _with(*views: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(views)


def _values(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


HIT_COLUMNS = "sid AS id, url, media_url, rating"
RANKED = """q AS (SELECT list_transform(emb, lambda x: x / sqrt(list_inner_product(emb, emb))) AS q FROM vectors JOIN posts USING (vec_idx) WHERE id = {0}),
ranked AS (SELECT vec_idx AS hit, round(list_inner_product(q, emb), 6) AS score, row_number() OVER (ORDER BY round(list_inner_product(q, emb), 6) DESC, vec_idx) AS rank FROM vectors, q)"""


def _query_vector(spark: SparkSession, d: str, post_id: int, vectors: DataFrame) -> DataFrame:
    return search.vector_of(b.posts(spark, d), vectors, post_id).select(F.col("emb").alias("vector"))


@query(_with(b.POSTS, b.VECTORS, RANKED.format(7)) + f" SELECT {HIT_COLUMNS}, score FROM ranked JOIN hits ON vec_idx = hit WHERE rank > 10 AND rank <= 30 AND rating <= 1")
def search_by_id(spark, d):
    text = _values(spark, [("id:7",)], "text string").select(codec.query_id(F.col("text")).alias("post_id"))
    vectors, table = b.vectors(spark, d), b.posts(spark, d)
    own = table.join(F.broadcast(text), table["id"] == text["post_id"]).join(vectors, "vec_idx").select(F.col("emb").alias("vector"))
    return search.ranked_hits(search.page_of(search.top_k(own, vectors, 120), 20, 10), table, "vec_idx", 1)


@query(_with(b.POSTS, b.STRETCHED, RANKED.format(12)) + f" SELECT {HIT_COLUMNS}, score FROM ranked JOIN hits ON vec_idx = hit WHERE rank <= 25 AND rating <= 2")
def search_by_vecidx(spark, d):
    vectors = b.vectors(spark, d, True)
    return search.ranked_hits(search.page_of(search.top_k(_query_vector(spark, d, 12, vectors), vectors, 120), 25, 0), b.posts(spark, d), "vec_idx", 2)


@query(_with(b.POSTS, b.VECTORS, RANKED.format(9)) + f" SELECT {HIT_COLUMNS}, score FROM ranked JOIN hits ON vec_idx = hit WHERE rank > 5 AND rank <= 45 AND rating <= 3")
def search_page(spark, d):
    vectors = b.vectors(spark, d)
    return search.ranked_hits(search.page_of(search.top_k(_query_vector(spark, d, 9, vectors), vectors, 120), 40, 5), b.posts(spark, d), "vec_idx", 3)


@query(_with(b.POSTS) + f" SELECT {HIT_COLUMNS}, 0.0::DOUBLE AS score, 'recent' AS mode, 'db_map_empty' AS reason FROM (SELECT * FROM hits ORDER BY id DESC LIMIT 15) WHERE rating <= 2")
def search_fallback(spark, d):
    vectors = b.vectors(spark, d)
    past_all = max(100_000, vectors.count())  # the SQL is that of a page beyond the last hit
    request = search.Request(text="id:7", has_id=True, limit=15, offset=past_all)
    return search.search_with_mode(request, _query_vector(spark, d, 7, vectors), vectors, b.posts(spark, d), threshold=2)


@query(_with(b.POSTS, b.VECTORS, RANKED.format(7)) + f" SELECT {HIT_COLUMNS}, score, 'vector' AS mode, 'faiss_match_vecidx' AS reason FROM ranked JOIN hits ON vec_idx = hit WHERE rank <= 15 AND rating <= 2")
def search_mode_vector(spark, d):
    vectors = b.vectors(spark, d)
    return search.search_with_mode(search.Request(text="id:7", has_id=True, limit=15), _query_vector(spark, d, 7, vectors), vectors, b.posts(spark, d), threshold=2)


FEATURE = "feature AS (SELECT tag_idx, list_transform(weight, lambda x: x / greatest(sqrt(list_inner_product(weight, weight)), 1e-8) * (1.0::DOUBLE + (atan(bias) + pi() / 2) / pi())) AS f FROM head)"


@query(
    _with(b.VECTORS, b.POSTS, b.HEAD, FEATURE)
    + """, parts AS (
  SELECT list_transform(emb, lambda x: x / sqrt(list_inner_product(emb, emb))) AS v, 0.5::DOUBLE AS w FROM vectors WHERE vec_idx = 3
  UNION ALL SELECT list_transform(emb, lambda x: x / sqrt(list_inner_product(emb, emb))), 1.0::DOUBLE FROM vectors WHERE vec_idx = 8
  UNION ALL SELECT emb, 1.0::DOUBLE FROM vectors JOIN posts USING (vec_idx) WHERE id = 7
  UNION ALL SELECT f, -0.5::DOUBLE FROM feature WHERE tag_idx = 3)
SELECT (pos - 1)::BIGINT AS pos, round(sum(x * w), 6) AS val FROM (SELECT w, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM parts) GROUP BY pos"""
)
def compose_query(spark, d):
    vectors, head = b.vectors(spark, d), b.tag_head(spark, d)
    images = vectors.where("vec_idx in (3, 8)").select(vec.guarded_unit(F.col("emb")).alias("vector"), F.when(F.col("vec_idx") == 3, 0.5).otherwise(1.0).alias("weight"))
    own = _query_vector(spark, d, 7, vectors).select(vec.doubles(F.col("vector")).alias("vector"), F.lit(1.0).alias("weight"))
    asked = codec.known_tags(_values(spark, [("(tag_3:-0.5) nothing",)], "text string"), head)
    tagged = tags.features(head).join(F.broadcast(asked), "tag_idx").select("vector", "weight")
    return search.compose(images.unionByName(own).unionByName(tagged)).select(F.col("pos").cast("bigint").alias("pos"), F.round("val", 6).alias("val"))


def _hundredth(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_idx % 100 = 0").select(F.col("vec_idx").alias("query_id"), F.col("emb").alias("vector"))


@query(
    _with(b.VECTORS)
    + """, q AS (SELECT vec_idx AS query_id, list_transform(emb, lambda x: x / sqrt(list_inner_product(emb, emb))) AS q FROM vectors WHERE vec_idx % 100 = 0),
s AS (SELECT query_id, vec_idx AS hit, round(list_inner_product(q, emb), 6) AS score FROM vectors, q)
SELECT query_id, hit, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit) AS rank FROM s) WHERE rank <= 5"""
)
def vector_topk(spark, d):
    vectors = b.vectors(spark, d)
    return search.top_k_each(_hundredth(vectors), vectors, 5).withColumn("rank", F.col("rank").cast("bigint"))


@query()
def ivf_topk(spark, d):
    vectors = b.vectors(spark, d)
    config = Config()
    lists = vectors.agg(ivf.list_count(F.count(F.lit(1))).alias("n")).first()["n"]
    centroids = ivf.train_centroids(ivf.training_sample(vectors, ["vec_idx"], config.train_rows), lists)
    indexed = ivf.by_list(ivf.assign_lists(vectors, centroids), Scratch(spark))
    trial = vectors.where("vec_idx % 100 <> 0").orderBy(F.xxhash64("vec_idx"), "vec_idx").limit(config.probe_queries)  # none of the queries
    trial = trial.select(F.col("vec_idx").alias("query_id"), F.col("emb").alias("vector"))
    probes = ivf.probes_for(trial, vectors, indexed, centroids, 5, config.probe_recall, min(lists, config.nprobe))
    return ivf.search_lists(_hundredth(vectors), indexed, centroids, probes, 5)


@query("SELECT count(*)::BIGINT AS n, CASE WHEN count(*) >= 4096 THEN 4096 ELSE greatest(128, count(*) // 64) END::BIGINT AS nlist, CASE WHEN max(len(embedding)) % 64 = 0 THEN 64 ELSE 32 END::BIGINT AS m FROM embeddings")
def ivf_params(spark, d):
    return b.vectors(spark, d).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("emb")).alias("dim")).select("n", ivf.list_count(F.col("n")).alias("nlist"), ivf.code_parts(F.col("dim")).alias("m"))


@query(_with(b.POSTS, b.VECTORS) + ", new AS (SELECT id, emb FROM posts JOIN vectors USING (vec_idx) ORDER BY id DESC LIMIT 1) SELECT CASE WHEN (SELECT arg_max(v.vec_idx, list_inner_product(v.emb, new.emb)) FROM vectors v, new) = (SELECT id FROM new) THEN 'post_id' ELSE 'vec_idx' END AS mode")
def id_mode_detect(spark, d):
    return search.detect_id_mode(b.posts(spark, d), b.vectors(spark, d))


@query(_with(b.POSTS, b.VECTORS) + " SELECT (generate_subscripts(emb, 1) - 1)::BIGINT AS pos, round(unnest(emb), 6) AS val FROM posts JOIN vectors USING (vec_idx) WHERE id = 7")
def vector_by_id(spark, d):
    return search.vector_of(b.posts(spark, d), b.vectors(spark, d), 7).select(F.posexplode(vec.doubles(F.col("emb"))).alias("pos", "val")).select(F.col("pos").cast("bigint").alias("pos"), F.round("val", 6).alias("val"))


@query(_with(b.STRETCHED) + " SELECT vec_idx, round(sqrt(list_inner_product(emb, emb)), 6) AS norm, round(emb[1] / sqrt(list_inner_product(emb, emb)), 6) AS first, round(emb[-1] / sqrt(list_inner_product(emb, emb)), 6) AS last FROM vectors")
def l2_normalize(spark, d):
    u = vec.guarded_unit(F.col("emb"))
    return b.vectors(spark, d, True).select("vec_idx", F.round(vec.norm(F.col("emb")), 6).alias("norm"), F.round(F.element_at(u, 1), 6).alias("first"), F.round(F.element_at(u, -1), 6).alias("last"))


@query(_with(b.POSTS) + f" SELECT {HIT_COLUMNS}, 0.0::DOUBLE AS score FROM (SELECT * FROM hits ORDER BY id DESC LIMIT 40 OFFSET 13) WHERE rating <= 1")
def recent_page(spark, d):
    return posts.as_hits(posts.recent(b.posts(spark, d), 40, 13, 1))


@query(_with(b.POSTS) + " SELECT id, rating, c1, c2, c3, c4, c5, vec_idx FROM posts WHERE id = 7")
def post_by_id(spark, d):
    return posts.by_id(b.posts(spark, d), 7)


@query(_with(b.POSTS) + " SELECT count(*)::BIGINT AS count, coalesce(min(id), -1)::BIGINT AS min_id, coalesce(max(id), -1)::BIGINT AS max_id, coalesce(min(vec_idx), -1)::BIGINT AS min_vec_idx, coalesce(max(vec_idx), -1)::BIGINT AS max_vec_idx FROM posts")
def table_stats(spark, d):
    return posts.stats(b.posts(spark, d))


@query(_with(b.POSTS) + " SELECT min(id) AS min_id, max(id) AS max_id, count(*)::BIGINT AS rows, greatest(0, max(id) - min(id) + 1 - count(*))::BIGINT AS missing_in_span FROM posts")
def coverage_report(spark, d):
    return posts.coverage(b.posts(spark, d))


def _probes(spark, d):
    return b.table(spark, d, "labels").select(F.explode(F.array(F.col("doc_id") * 2, F.col("doc_id") + 3)).alias("probe")).distinct(), b.table(spark, d, "labels").select(F.col("doc_id").alias("key"))


PROBES = "WITH probes AS (SELECT DISTINCT unnest([doc_id * 2, doc_id + 3]) AS probe FROM labels)"


@query(PROBES + " SELECT probe, (SELECT max(doc_id) FROM labels WHERE doc_id <= probe) AS found FROM probes")
def asof_prev(spark, d):
    return posts.nearest(*_probes(spark, d), forward=False, shard_width=64)


@query(PROBES + " SELECT probe, (SELECT min(doc_id) FROM labels WHERE doc_id >= probe) AS found FROM probes")
def asof_next(spark, d):
    return posts.nearest(*_probes(spark, d), forward=True, shard_width=64)


@query(
    _with(b.POSTS)
    + """, batch AS (SELECT id, 3::BIGINT AS rating, vec_idx + 5000 AS vec_idx, id * 2 AS seq FROM posts WHERE id % 4 = 0 UNION ALL SELECT id + 100000, 1::BIGINT, vec_idx, id * 2 + 1 FROM posts WHERE id % 8 = 0 UNION ALL SELECT id, 0::BIGINT, vec_idx + 9000, id * 2 + 1 FROM posts WHERE id % 12 = 0),
latest AS (SELECT id, rating, vec_idx FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM batch) WHERE n = 1)
SELECT id, rating, vec_idx FROM latest UNION ALL SELECT id, rating, vec_idx FROM posts WHERE id NOT IN (SELECT id FROM latest)"""
)
def upsert_posts(spark, d):
    own = b.posts(spark, d).select("id", "rating", "vec_idx")
    long = lambda x: F.lit(x).cast("bigint")
    batch = own.where("id % 4 = 0").select("id", long(3).alias("rating"), (F.col("vec_idx") + 5000).alias("vec_idx"), (F.col("id") * 2).alias("seq"))
    batch = batch.unionByName(own.where("id % 8 = 0").select((F.col("id") + 100000).alias("id"), long(1).alias("rating"), "vec_idx", (F.col("id") * 2 + 1).alias("seq")))
    batch = batch.unionByName(own.where("id % 12 = 0").select("id", long(0).alias("rating"), (F.col("vec_idx") + 9000).alias("vec_idx"), (F.col("id") * 2 + 1).alias("seq")))
    return posts.upsert(own, batch)


def _tags(spark, d):
    return tags.dictionary(b.tag_rows(spark, d), "name")


@query(_with(b.TAGS) + " SELECT tag_idx, name, category, count FROM tags")
def tag_dictionary(spark, d):
    return _tags(spark, d)


@query(_with(b.TAGS) + " SELECT name, category, count FROM tags WHERE starts_with(name, (SELECT substr(min(name), 1, 2) FROM tags)) ORDER BY count DESC, tag_idx LIMIT 20")
def tag_prefix(spark, d):
    first = b.table(spark, d, "part").agg(F.substring(F.min(F.regexp_replace("p_name", " ", "_")), 1, 2)).first()[0]
    return tags.with_prefix(_tags(spark, d), first)


@query("SELECT 'zz_none' AS name, 0::BIGINT AS category, 0::BIGINT AS count")
def tag_prefix_fallback(spark, d):
    return tags.with_prefix(_tags(spark, d), "zz_none")


@query(_with(b.HEAD, FEATURE) + " SELECT tag_idx, (pos - 1)::BIGINT AS pos, round(x, 6) AS val FROM (SELECT tag_idx, unnest(f) AS x, generate_subscripts(f, 1) AS pos FROM feature)")
def tag_feature(spark, d):
    return tags.features(b.tag_head(spark, d)).select("tag_idx", F.posexplode("vector").alias("pos", "x")).select("tag_idx", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("val"))


PROBS = "probs AS (SELECT vec_idx, tag_idx, name, 1 / (1 + exp(-(list_inner_product(emb, weight) + bias))) AS prob FROM vectors, head)"


@query(_with(b.VECTORS, b.HEAD, PROBS) + " SELECT vec_idx, tag_idx, round(prob, 6) AS prob FROM probs")
def tag_scores(spark, d):
    return tags.probabilities(b.vectors(spark, d), b.tag_head(spark, d)).withColumn("prob", F.round("prob", 6))


@query(_with(b.POSTS, b.VECTORS, b.HEAD, PROBS) + " SELECT name AS tag_name, round(prob, 6) AS probability FROM probs JOIN posts USING (vec_idx) WHERE id = 7 AND prob > 0.5")
def tags_from_id(spark, d):
    own, head = search.vector_of(b.posts(spark, d), b.vectors(spark, d), 7), b.tag_head(spark, d)
    return tags.likely(tags.probabilities(own, head), head, 0.5).withColumn("probability", F.round("probability", 6))


TEXTS = ["42", "  ID : 42 cat", "myid:42", "(cat:-0.5) cat", "(cat:abc)", "dog_(x) (dog_(x):2)", "a id:7 id:8", "   ", "99999999999999999999"]
TEXT_VALUES = ", ".join(f"({i}::BIGINT, '{t}')" for i, t in enumerate(TEXTS))
TAG_VALUES = "(0::BIGINT, 'cat'), (1::BIGINT, 'dog_(x)'), (2::BIGINT, '42')"


@query(f"SELECT n, CASE WHEN regexp_matches(trim(t), '^[0-9]+$') THEN try_cast(trim(t) AS BIGINT) ELSE try_cast(nullif(regexp_extract(t, '(?i)(?:^|\\s)id\\s*:\\s*(\\d+)(?:$|\\s)', 1), '') AS BIGINT) END AS post_id FROM (VALUES {TEXT_VALUES}) v(n, t)")
def parse_query_id(spark, d):
    return _values(spark, list(enumerate(TEXTS)), "n long, t string").select("n", codec.query_id(F.col("t")).alias("post_id"))


@query(
    f"""WITH tok AS (SELECT n, unnest(string_split_regex(trim(t), '\\s+')) AS raw, generate_subscripts(string_split_regex(trim(t), '\\s+'), 1) AS pos FROM (VALUES {TEXT_VALUES}) v(n, t)),
w AS (SELECT n, pos, raw, regexp_extract(raw, '^\\((.*):([^:]*)\\)$', 1) AS name, try_cast(nullif(regexp_extract(raw, '^\\((.*):([^:]*)\\)$', 2), '') AS DOUBLE) AS weight FROM tok)
SELECT n, (pos - 1)::BIGINT AS pos, i AS tag_idx, coalesce(weight, 1.0)::DOUBLE AS weight FROM w JOIN (VALUES {TAG_VALUES}) g(i, tag) ON tag = CASE WHEN weight IS NULL THEN raw ELSE name END"""
)
def parse_query_tags(spark, d):
    known = _values(spark, [(0, "cat"), (1, "dog_(x)"), (2, "42")], "tag_idx long, name string")
    found = codec.known_tags(_values(spark, list(enumerate(TEXTS)), "n long, text string"), known)
    return found.select("n", F.col("pos").cast("bigint").alias("pos"), "tag_idx", "weight")


@query(_with(b.POSTS) + " SELECT id, url, media_url FROM hits")
def build_urls(spark, d):
    return b.posts(spark, d).select("id", codec.post_url(F.col("id")).alias("url"), codec.media_url(*[F.col(c) for c in posts.COMPONENTS]).alias("media_url"))


@query(_with(b.POSTS) + " SELECT id, form, c1, c2, c3, c4, CASE WHEN c5 > 4 THEN 0 ELSE c5 END::BIGINT AS c5 FROM posts, (VALUES ('plain'), ('http')) t(form) UNION ALL SELECT id, form, NULL, NULL, NULL, NULL, NULL FROM posts, (VALUES ('tail'), ('prefix'), ('upper')) t(form)")
def parse_urls(spark, d):
    url, name = F.col("url"), F.substring_index("url", "/", -1)
    folder = F.substring(url, F.lit(1), F.length(url) - F.length(name))
    forms = {"plain": url, "http": F.regexp_replace(url, "^https:", "http:"), "tail": F.concat(url, F.lit("/x")), "prefix": F.concat(folder, F.lit("sample_"), name), "upper": F.concat(folder, F.upper(name))}
    own = b.posts(spark, d).select("id", codec.media_url(*[F.col(c) for c in posts.COMPONENTS]).alias("url"))
    every = own.select("id", F.inline(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("url")) for k, v in forms.items()])))
    return every.select("id", "form", codec.parse_media_url(F.col("url")).alias("p")).select("id", "form", "p.*")


@query(_with(b.POSTS) + " SELECT id, u3::VARCHAR AS unsigned, c3 AS signed FROM _u JOIN posts USING (id)")
def u64_roundtrip(spark, d):
    u = vec.i64_to_u64(F.col("c3"))
    return b.posts(spark, d).select("id", u.cast("string").alias("unsigned"), vec.u64_to_i64(u).alias("signed"))


@query(r"""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '//h/a.JPG?x=1' WHEN 2 THEN '/b/c.tar.gz/' ELSE 'none' END AS url FROM pages),
c AS (SELECT *, regexp_replace(string_split(url, '?')[1], '/+$', '') AS bare FROM u)
SELECT page_id, CASE WHEN contains(bare, '.') THEN lower(string_split(bare, '.')[-1]) ELSE '' END AS ext,
  CASE WHEN starts_with(url, '//') THEN 'https:' || url WHEN starts_with(url, '/') THEN 'https://posts.example.org' || url ELSE url END AS absolute FROM c""")
def url_ext(spark, d):
    u = F.when(F.col("page_id") % 4 == 0, F.col("url")).when(F.col("page_id") % 4 == 1, "//h/a.JPG?x=1").when(F.col("page_id") % 4 == 2, "/b/c.tar.gz/").otherwise("none")
    return b.table(spark, d, "pages").select("page_id", u.alias("url")).select("page_id", codec.url_extension(F.col("url")).alias("ext"), codec.absolute_url(F.col("url")).alias("absolute"))


@query(_with(b.SOURCE_POSTS) + " SELECT id, image_url FROM source")
def variant_pick(spark, d):
    own = b.source_posts(spark, d)
    return own.select("id", ingest.image_url(F.struct(*own.columns)).alias("image_url"))


@query(_with(b.SOURCE_POSTS) + " SELECT id, record_url FROM source")
def record_url(spark, d):
    return b.source_posts(spark, d).select("id", ingest.record_url(F.col("media_asset.variants")).alias("record_url"))


@query(
    _with(b.SOURCE_POSTS)
    + """ SELECT id, CASE rating WHEN 'g' THEN 0 WHEN 's' THEN 1 WHEN ' Q ' THEN 2 WHEN 'E' THEN 3 ELSE 0 END::BIGINT AS rating_code,
CASE WHEN id <= 0 THEN 'invalid_id' WHEN is_deleted THEN 'deleted' WHEN image_url IS NULL THEN 'no_supported_url' WHEN record_url IS NULL THEN 'no_record_url' ELSE 'ok' END AS reason FROM source"""
)
def ingest_classify(spark, d):
    return ingest.classify(b.source_posts(spark, d)).select("id", "rating_code", "reason")


@query(_with(b.EVENTS) + " SELECT reason, CASE WHEN reason = 'ok' THEN 'ok' WHEN reason IN ('deleted', 'no_supported_url') THEN 'skipped' ELSE 'failed' END AS outcome, count(*)::BIGINT AS n, min(seq) AS first_seq FROM records GROUP BY reason ORDER BY n DESC, first_seq LIMIT 4")
def ingest_outcomes(spark, d):
    return ingest.top_reasons(b.events(spark, d), 4).select("reason", ingest.outcome(F.col("reason")).alias("outcome"), "n", "first_seq")


SUMS = "count(*) AS n, count(*) FILTER (reason = 'ok') AS n_ok, count(*) FILTER (reason IN ('deleted', 'no_supported_url')) AS n_skipped, sum(download_sec) AS download_sec, sum(embed_sec) AS embed_sec, sum(bytes) AS bytes, sum(download_sec + embed_sec) AS busy_sec"
AVERAGE = "round(round(download_sec / greatest(n, 1), 6), 4) AS avg_download, "
RATIOS = "n::BIGINT AS n, n_ok::BIGINT AS n_ok, n_skipped::BIGINT AS n_skipped, round(download_sec, 4) AS download_sec, round(embed_sec, 4) AS embed_sec, bytes::BIGINT AS bytes, round(round(download_sec / greatest(n, 1), 6), 4) AS avg_download, round(round(n_ok / greatest(busy_sec, 1e-9), 6), 4) AS images_per_sec"


def _figures(df: DataFrame, *keys: str) -> DataFrame:
    long, four = (lambda c: F.col(c).cast("bigint").alias(c)), (lambda c: F.round(c, 4).alias(c))
    return df.select(*keys, long("n"), long("n_ok"), long("n_skipped"), four("download_sec"), four("embed_sec"), long("bytes"), four("avg_download"), four("images_per_sec"))


@query(_with(b.EVENTS) + f", s AS (SELECT {SUMS} FROM records) SELECT {RATIOS} FROM s")
def ingest_throughput(spark, d):
    return _figures(ingest.throughput(b.events(spark, d)))


@query(_with(b.EVENTS) + f", g AS (SELECT seq // 25 AS block, {SUMS} FROM records GROUP BY 1), s AS (SELECT block, n AS own, " + ", ".join(f"sum({c}) OVER (ORDER BY block) AS {c}" for c in ("n", "n_ok", "n_skipped", "download_sec", "embed_sec", "bytes", "busy_sec")) + f" FROM g) SELECT block, {RATIOS.replace(AVERAGE, '')} FROM s WHERE own = 25")
def ingest_running(spark, d):
    # the running mean often ends in a five, which the two engines round apart
    return _figures(ingest.running(b.events(spark, d)), "block").drop("avg_download")


WINDOWS = """own AS (SELECT seq // 128 AS win, count(*) AS n, count(*) FILTER (reason IN ('http_403', 'http_429'))::BIGINT AS blocked, round(avg(download_sec), 6) AS avg_download, round(avg(embed_sec), 6) AS avg_embed,
  round(count(*) FILTER (reason <> 'ok') / count(*), 6) AS failure_rate, round(count(*) / greatest(sum(download_sec), 1e-9), 6) AS rate FROM records GROUP BY 1 HAVING count(*) = 128),
windows AS (SELECT *, lag(avg_download) OVER (ORDER BY win) AS prev_download, lag(rate) OVER (ORDER BY win) AS prev_rate FROM own)"""


@query(_with(b.EVENTS, WINDOWS) + " SELECT win, blocked, avg_download, avg_embed, failure_rate, rate, prev_download, prev_rate FROM windows")
def autotune_windows(spark, d):
    return ingest.count_windows(b.events(spark, d), 128).drop("n")


@query(
    _with(b.EVENTS, WINDOWS.replace("IN ('http_403', 'http_429')", "IN ('http_403')"))
    + """, fold AS (SELECT -1::BIGINT AS win, 32::BIGINT AS workers UNION ALL
SELECT w.win, CASE WHEN w.blocked > 0 THEN greatest(8, least(48, f.workers - greatest(1, w.blocked)))
  WHEN w.failure_rate > 0.25 OR (w.avg_download > 1.08 * w.prev_download AND w.rate < 0.92 * w.prev_rate) THEN greatest(8, least(48, f.workers - 1))
  WHEN w.avg_download > greatest(1.25 * w.avg_embed, 0.05) AND (w.prev_download IS NULL OR (w.avg_download < 0.98 * w.prev_download AND w.rate > 1.03 * w.prev_rate)) THEN greatest(8, least(48, f.workers + 1))
  ELSE greatest(8, least(48, f.workers)) END FROM fold f JOIN windows w ON w.win = f.win + 1)
SELECT win, workers FROM fold WHERE win >= 0"""
)
def autotune_fold(spark, d):
    own = b.events(spark, d).withColumn("reason", F.when(F.col("reason") == "http_429", "deleted").otherwise(F.col("reason")))
    return ingest.autotune(ingest.count_windows(own, 128), 32, 8, 48).select("win", F.col("workers").cast("bigint").alias("workers"))


@query("WITH RECURSIVE r AS (SELECT 0::BIGINT AS n, 0.5::DOUBLE AS wait UNION ALL SELECT n + 1, least(30.0, wait * 2.0) FROM r WHERE n < 9) SELECT n, round(wait, 6) AS wait FROM r")
def retry_schedule(spark, d):
    return ingest.network_schedule(spark.range(10).withColumnRenamed("id", "n"), 0.5, 2.0)


def _sparse(spark, d):
    return b.table(spark, d, "labels").select(F.col("doc_id").alias("id"))


@query("WITH p AS (SELECT doc_id AS a, lead(doc_id) OVER (ORDER BY doc_id) AS b FROM labels) SELECT b - 1 AS upper_id, a + 1 AS lower_id FROM p WHERE b - a - 1 >= 8")
def gaps_exact(spark, d):
    return gaps.exact_gaps(_sparse(spark, d), 8, 64)


def _stepping(head: int | str, threshold: int, step: int, floor: int) -> str:
    return f"""WITH RECURSIVE s AS (SELECT {head}::BIGINT AS p, (SELECT max(doc_id) FROM labels WHERE doc_id <= {head}) AS a UNION ALL
SELECT q, (SELECT max(doc_id) FROM labels WHERE doc_id <= q) FROM (SELECT CASE WHEN a IS NULL THEN -1 WHEN p - a >= {threshold} THEN a - 1 ELSE p - {step} END AS q FROM s WHERE p >= {floor}) WHERE q >= {floor})
SELECT coalesce((SELECT min(doc_id) FROM labels WHERE doc_id >= p + 1) - 1, {head})::BIGINT AS upper_id, a + 1 AS lower_id FROM s WHERE p - a >= {threshold}
UNION ALL SELECT p, {floor}::BIGINT FROM s WHERE a IS NULL AND p - {floor} + 1 >= {threshold}"""


@query(_stepping("(SELECT max(doc_id) FROM labels)", 8, 3, 1))
def gaps_probe(spark, d):
    ids = _sparse(spark, d)
    head = paged.latest_head(ids).first()["head"]
    return gaps.probed_gaps(ids, head, 8, 3, width=64).select("upper_id", "lower_id")


@query("SELECT max(doc_id) + 500 AS upper_id, max(doc_id) + 1 AS lower_id, max(doc_id) + 501 AS cursor_id, 'latest' AS source, 'active' AS status FROM labels")
def latest_gap(spark, d):
    return _latest(spark, d).drop("seq")


def _latest(spark, d) -> DataFrame:
    """The gap to a head 500 ids above the greatest one."""
    stats = _sparse(spark, d).agg(F.max("id").alias("max_id"))
    return ranges.latest_gap(stats, (stats.first()["max_id"] or 0) + 500, 400)


def _queue(spark, d) -> DataFrame:
    found = gaps.exact_gaps(_sparse(spark, d), 8, 64).select(F.col("upper_id").alias("seq"), "upper_id", "lower_id", (F.col("upper_id") + 50).alias("cursor_id"), F.lit("probe").alias("source"), F.lit("active").alias("status"))
    again = found.select((F.col("seq") + 1_000_000).alias("seq"), "upper_id", "lower_id", F.lit(1).cast("bigint").alias("cursor_id"), F.lit("odd").alias("source"), F.lit("odd").alias("status"))
    bad = _values(spark, [(0, 0, 0, 0, "probe", "pending"), (2_000_000, 70_000, 60_000, 5, "x", "y")], "seq long, upper_id long, lower_id long, cursor_id long, source string, status string")
    return found.unionByName(again).unionByName(bad)


COMPACTED = """p AS (SELECT doc_id AS a, lead(doc_id) OVER (ORDER BY doc_id) AS b FROM labels),
q AS (SELECT b - 1 AS seq, b - 1 AS upper_id, a + 1 AS lower_id, b AS cursor_id, 'probe' AS source, 'active' AS status FROM p WHERE b - a - 1 >= 8
  UNION ALL SELECT 2000000, 70000, 60000, 60001, 'probe', 'pending')"""


@query(f"WITH {COMPACTED} SELECT seq, upper_id, lower_id, cursor_id, source, status FROM q")
def ranges_compact(spark, d):
    return ranges.compact(_queue(spark, d))


@query(
    f"""WITH {COMPACTED}, m AS (SELECT max(doc_id) AS top FROM labels),
r AS (SELECT -1 AS seq, top + 500 AS upper_id, top + 1 AS lower_id, top + 501 AS cursor_id, 'latest' AS source, 'active' AS status FROM m UNION ALL SELECT seq, upper_id, lower_id, cursor_id, source, 'pending' FROM q)
SELECT (row_number() OVER (ORDER BY seq) - 1)::BIGINT AS seq, upper_id::BIGINT AS upper_id, lower_id::BIGINT AS lower_id, cursor_id::BIGINT AS cursor_id, source, status FROM r"""
)
def range_queue(spark, d):
    return ranges.prioritise(ranges.compact(_queue(spark, d)), _latest(spark, d))


@query("SELECT DISTINCT event_id % 700 AS id FROM events WHERE event_type IN ('signup', 'error') ORDER BY id DESC LIMIT 200")
def failures_compact(spark, d):
    failed = b.events(spark, d).where(ingest.outcome(F.col("reason")) == "failed").select((F.col("seq") % 700).alias("id"))
    return ranges.compact_failures(failed, 200)


def _doc_ids(spark, d):
    return b.table(spark, d, "documents").select(F.col("doc_id").alias("id"))


@query("SELECT coalesce(max(doc_id), 0)::BIGINT AS head FROM documents")
def latest_head(spark, d):
    return paged.latest_head(_doc_ids(spark, d))


@query("SELECT doc_id AS id FROM (SELECT doc_id FROM documents WHERE doc_id < 150 ORDER BY doc_id DESC LIMIT 60) WHERE doc_id BETWEEN 100 AND 140")
def cursor_page(spark, d):
    return paged.within(paged.page(_doc_ids(spark, d), 60, 150), 100, 140)


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS n FROM documents) SELECT (n // 200)::BIGINT AS page_no, count(*)::BIGINT AS n, min(doc_id) AS min_id, max(doc_id) AS max_id FROM r GROUP BY 1")
def cursor_pages_all(spark, d):
    ids = _doc_ids(spark, d)
    ends = ids.agg(F.coalesce(F.max("id"), F.lit(0)).alias("upper"), F.coalesce(F.min("id"), F.lit(0)).alias("lower")).first()
    return paged.all_pages(ids, ends["upper"], ends["lower"], 200)


# rows of the files, in the order of their names, are in vec_id order
@query("SELECT vec_id, label::BIGINT AS label, vec_id - (SELECT min(vec_id) FROM embeddings) AS row_index FROM embeddings")
def incoming_scan(spark, d):
    return incremental.placed(incremental.scan(spark, f"{d}/embeddings.parquet")).select("vec_id", F.col("label").cast("bigint").alias("label"), "row_index")


@query(_with(b.INCOMING) + " SELECT id, rating, row_index FROM incoming WHERE rating <= 1")
def rating_filter(spark, d):
    return incremental.accepted(b.incoming(spark, d), 1).select("id", "rating", "row_index")


@query(_with(b.POSTS, b.INCOMING) + " SELECT id, rating, row_index FROM incoming WHERE id NOT IN (SELECT id FROM posts)")
def incremental_new(spark, d):
    return incremental.new_rows(b.incoming(spark, d), b.posts(spark, d)).select("id", "rating", "row_index")


@query(_with(b.POSTS, b.INCOMING) + " SELECT id, rating, row_index FROM incoming WHERE id IN (SELECT id FROM posts)")
def incremental_skipped(spark, d):
    return incremental.known_rows(b.incoming(spark, d), b.posts(spark, d)).select("id", "rating", "row_index")


@query(
    _with(b.POSTS, b.INCOMING)
    + """, n AS (SELECT id, path, max(row_index) AS row_index FROM incoming WHERE rating <= 2 AND id NOT IN (SELECT id FROM posts) GROUP BY id, path)
SELECT id, row_index, ((SELECT max(vec_idx) FROM posts) + row_number() OVER (ORDER BY path, row_index))::BIGINT AS vec_idx FROM n"""
)
def assign_vec_idx(spark, d):
    own = b.posts(spark, d)
    fresh = incremental.last_of_each_id(incremental.new_rows(incremental.accepted(b.incoming(spark, d), 2), own))
    top = own.agg(F.coalesce(F.max("vec_idx"), F.lit(-1)).alias("max_vec_idx"))
    return incremental.numbered(fresh, top, width=64).select("id", "row_index", "vec_idx")


@query("WITH f AS (SELECT doc_id, (doc_id - min(doc_id) OVER ()) // 300 AS file_no FROM documents) SELECT file_no::BIGINT AS file_no, count(*)::BIGINT AS n, min(doc_id) AS min_id, max(doc_id) AS max_id, 'posts_20240101T000000Z_' || printf('%04d', file_no::BIGINT) || '_' || max(doc_id) || '-' || min(doc_id) || '.parquet' AS file_name FROM f GROUP BY file_no")
def rolling_files(spark, d):
    return incremental.rolling_files(_doc_ids(spark, d), "id", 300, "posts", "20240101T000000Z")


@query(
    """WITH i AS (SELECT l_orderkey AS id, min(l_partkey) AS idx FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, (o_orderkey % 4)::BIGINT AS rating, (o_custkey % 256)::BIGINT AS c1, 0::BIGINT AS c2, o_custkey AS c3, 0::BIGINT AS c4, 0::BIGINT AS c5, idx AS vec_idx FROM orders JOIN i ON id = o_orderkey"""
)
def legacy_migrate(spark, d):
    metadata = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).alias("rating"), (F.col("o_custkey") % 256).alias("url_c1"), F.col("o_custkey").alias("c3"))
    return legacy.migrate(metadata, b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("index")))


@query(
    """WITH s AS (SELECT p_partkey, p_size * 37 AS w, p_partkey % 977 + 1 AS h FROM part),
f AS (SELECT p_partkey, CASE WHEN w > h THEN 448 ELSE floor(448 * (w / h)) END::BIGINT AS fit_w, CASE WHEN w > h THEN floor(448 / (w / h)) ELSE 448 END::BIGINT AS fit_h FROM s)
SELECT p_partkey, fit_w, fit_h, ((448 - fit_w) // 2)::BIGINT AS pad_left, ((448 - fit_h) // 2)::BIGINT AS pad_top FROM f"""
)
def fit_geometry(spark, d):
    size = ingest.fit_size(F.col("p_size") * 37, F.col("p_partkey") % 977 + 1)
    return b.table(spark, d, "part").select("p_partkey", size.alias("f")).select("p_partkey", F.col("f.w").alias("fit_w"), F.col("f.h").alias("fit_h"), F.col("f.left").alias("pad_left"), F.col("f.top").alias("pad_top"))

"""Golden cases of the engine, and every query against its SQL."""

from __future__ import annotations

import random
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.config import Config, clamp_page, load_config
from tessera.functions import codec
from tessera.operators import gaps, ingest, ivf, posts, ranges, search
from tessera.plans import catalog
from tessera.sources import files

SF = "/root/testdata/sf0.001"
SF10 = "/root/testdata/sf0.1"


def stepping(existing, head, threshold, step, floor=1):
    ids, out = sorted(set(existing)), []
    step, floor, p = max(1, min(step, max(1, threshold - 1))), max(1, floor), max(1, head)
    while head >= 1 and p >= floor:
        a = max((x for x in ids if x <= p), default=None)
        if a is None:
            return out + [(p, floor)] * (p - floor + 1 >= threshold)
        if p - a >= threshold:
            b = min((x for x in ids if x >= p + 1), default=None)
            out.append((head if b is None else b - 1, a + 1))
            p = a - 1
        else:
            p -= step
    return out


CASES = [
    ([900, 899, 898, 500], 1000, 50, 32, 1, [(1000, 901), (897, 501), (499, 1)]),
    ([1000, 999, 998, 700, 699, 698, 300, 299], 1000, 80, 32, 1, [(997, 701), (697, 301), (267, 1)]),
    ([1000, 980, 960, 940, 920], 1000, 30, 16, 920, []),
    ([1000, 999, 998, 997, 550, 549, 548], 1000, 200, 64, 1, [(996, 551), (485, 1)]),
    ([], 600, 100, 64, 1, [(600, 1)]),
]


@pytest.mark.parametrize("existing,head,threshold,step,floor,expected", CASES)
def test_probed_gaps(spark, existing, head, threshold, step, floor, expected):
    ids = spark.createDataFrame([(x,) for x in existing], "id long")
    got = [(r.upper_id, r.lower_id) for r in gaps.probed_gaps(ids, head, threshold, step, floor).orderBy("nth").collect()]
    assert got == expected == stepping(existing, head, threshold, step, floor)


def test_probed_gaps_random(spark):
    rng = random.Random(4)
    for _ in range(6):
        ids = rng.sample(range(1, 400), rng.randint(1, 60))
        head, threshold, step, floor = rng.randint(1, 450), rng.randint(1, 30), rng.randint(1, 20), rng.choice([1, 1, 50])
        df = spark.createDataFrame([(x,) for x in ids], "id long")
        got = [(r.upper_id, r.lower_id) for r in gaps.probed_gaps(df, head, threshold, step, floor, width=32).orderBy("nth").collect()]
        assert got == stepping(ids, head, threshold, step, floor)


POST_ROWS = [(10916846, 1, 0x12, 0x34, 0x1234567890ABCDEF, 0x0FEDCBA098765432, 0, 5244708), (10916568, 2, 1, 2, 3, 4, 1, 5244709), (10916567, 0, 1, 2, -3, 4, 9, 5244710)]


def table(spark):
    return spark.createDataFrame(POST_ROWS, "id long, rating long, c1 long, c2 long, c3 long, c4 long, c5 long, vec_idx long")


def hits(spark, rows):
    return spark.createDataFrame([(i, float(s), n + 1) for n, (i, s) in enumerate(rows)], "hit long, score double, rank int")


def test_urls(spark):
    row = posts.as_hits(table(spark)).orderBy("id").collect()[-1]
    assert row.media_url == "https://media.example.org/720x720/12/34/1234567890abcdef0fedcba098765432.jpg"
    parsed = table(spark).select("c3", codec.parse_media_url(codec.media_url(*[F.col(c) for c in posts.COMPONENTS])).alias("p")).collect()
    assert all(r.p.c3 == r.c3 for r in parsed)


def run(spark, request, rows, mode="vec_idx", threshold=3):
    out = search.search_with_mode(request, None, None, table(spark), mode, threshold, Config(), hits=None if rows is None else hits(spark, rows)).collect()
    return [int(r.id) for r in out], {(r["mode"], r["reason"]) for r in out}, [r.score for r in out]


def test_search_modes(spark):
    ask = search.Request(text="id:1", has_id=True, limit=3)
    assert run(spark, ask, [(5244708, 0.9), (5244709, 0.8)], threshold=1)[:2] == ([10916846], {("vector", "faiss_match_vecidx")})
    assert run(spark, ask, [(10916846, 0.95), (10916568, 0.75), (10916567, 0.7)], "post_id", 1)[2] == [0.95, 0.7]
    assert run(spark, ask, [(1, 0.9)])[1] == {("recent", "db_map_empty")}
    assert run(spark, ask, [(-1, 0.9)])[1] == {("recent", "faiss_empty")}
    assert run(spark, search.Request(text="  ", limit=3), None)[1] == {("recent", "unknown_tags_only")}
    assert run(spark, search.Request(limit=3), None)[1] == {("recent", "empty_query")}
    assert run(spark, search.Request(limit=3), None, threshold=1)[0] == [10916846, 10916567]


def test_state(tmp_path):
    path = str(tmp_path / "state.json")
    state = files.State([8, 3, 8, 5, 3], [files.Range(1000, 900, 1500), files.Range(1000, 900, 950), files.Range(0, 0, 0)], -10)
    files.save_state(path, state)
    assert files.load_state(path) == files.State([3, 5, 8], [files.Range(1000, 900, 1001)], 0)
    Path(path).write_text('{"active_gap_upper_id": 1200, "active_gap_lower_id": 1100, "active_gap_cursor_id": 1180, "sync_cursor_id": 1099}')
    assert files.load_state(path) == files.State([], [files.Range(1200, 1100, 1180, "probe", "active")], 1099)
    assert files.load_state(str(tmp_path / "none")) == files.State()


RANGE_SCHEMA = "seq long, upper_id long, lower_id long, cursor_id long, source string, status string"


def test_queue(spark):
    stats = spark.createDataFrame([(10916872,)], "max_id long")
    queue = spark.createDataFrame([(0, 5784529, 1, 3696360, "probe", "active")], RANGE_SCHEMA)
    got = [tuple(r)[1:] for r in ranges.prioritise(queue, ranges.latest_gap(stats, 11223105, 400)).orderBy("seq").collect()]
    assert got == [(11223105, 10916873, 11223106, "latest", "active"), (5784529, 1, 3696360, "probe", "pending")]
    queue = spark.createDataFrame([(0, 5000, 1, 3000, "probe", "active"), (1, 12000, 11001, 11800, "probe", "pending")], RANGE_SCHEMA)
    stats = spark.createDataFrame([(11000,)], "max_id long")
    got = [tuple(r)[1:] for r in ranges.prioritise(queue, ranges.latest_gap(stats, 12000, 400)).orderBy("seq").collect()]
    assert got == [(12000, 11001, 11800, "latest", "active"), (5000, 1, 3000, "probe", "pending")]


def test_limits_and_config(tmp_path):
    assert clamp_page(1234, 5) == (1234, 5) and clamp_page(100001, -1) == (100000, 0)
    (tmp_path / "c.json").write_text('{"rating_threshold": 5, "state_path": "s.json"}')
    found = load_config(str(tmp_path / "c.json"), environ={})
    assert found.rating_threshold == 5 and found.state_path == str(tmp_path / "s.json")


def test_retries():
    assert ingest.retry_waits(0.5, 2, [("network", None), ("429", 1.0), ("503", 9.0)]) == [0.5, 2.0, 9.0]


def test_all_lists_probed_is_exact(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("vec_idx"), F.col("embedding").alias("emb"))
    centroids = ivf.train_centroids(vectors, 8)
    queries = vectors.where("vec_idx < 4").select(F.col("vec_idx").alias("query_id"), F.col("emb").alias("vector"))
    some = {tuple(r) for r in ivf.search_lists(queries, ivf.assign_lists(vectors, centroids), centroids, 8, 5).select("query_id", "hit").collect()}
    assert some == {tuple(r) for r in search.top_k_each(queries, vectors, 5).select("query_id", "hit").collect()}


def views():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_against_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    result = views().sql(catalog.ORACLE_SQL[name])
    at = [result.columns.index(c) for c in df.columns]
    key = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    assert sorted(map(repr, (key(r) for r in df.collect()))) == sorted(repr(key([r[i] for i in at])) for r in result.fetchall())


def test_ivf_topk_recall_over_all_queries(spark):
    found = {(r.query_id, r.hit) for r in catalog.QUERIES["ivf_topk"](spark, SF10).collect()}
    exact = {(r.query_id, r.hit) for r in catalog.QUERIES["vector_topk"](spark, SF10).collect()}
    rows = spark.read.parquet(f"{SF10}/embeddings.parquet").where("vec_id % 100 = 0").count()
    recall = len(found & exact) / len(exact)
    print("recall", recall, "queries", rows)
    assert len({q for q, _ in exact}) == rows > 10
    assert recall >= 0.9


def test_searches_by_blocks_are_the_same(spark, monkeypatch):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("vec_idx"), F.col("embedding").alias("emb"))
    queries = vectors.where("vec_idx < 20").select(F.col("vec_idx").alias("query_id"), F.col("emb").alias("vector"))
    centroids = ivf.train_centroids(vectors, 4)
    indexed = ivf.assign_lists(vectors, centroids)
    found = lambda: [{tuple(r) for r in df.collect()} for df in (search.top_k_each(queries, vectors, 5), ivf.search_lists(queries, indexed, centroids, 2, 5))]
    whole = found()
    monkeypatch.setattr(search, "BLOCK_BYTES", 3000)
    assert len(search.blocks_of(queries)) > 2 and found() == whole and len(whole[0]) == 100
    assert search.top_k_each(queries.limit(0), vectors, 5).collect() == []


def test_gaps_probe_reads_every_id(spark, tmp_path):
    spark.createDataFrame([(x,) for x in [*range(1, 1500), *range(1520, 5001)]], "doc_id long").write.parquet(str(tmp_path / "labels.parquet"))
    assert [tuple(r) for r in catalog.QUERIES["gaps_probe"](spark, str(tmp_path)).collect()] == [(1519, 1500)]


def test_cursor_pages_all_has_all_ids(spark, tmp_path):
    spark.range(0, 100_301).withColumnRenamed("id", "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["cursor_pages_all"](spark, str(tmp_path)).agg(F.sum("n"), F.min("min_id"), F.max("max_id"), F.count("*")).first()
    assert tuple(got) == (100_301, 0, 100_300, 502)


def test_media_url_forms(spark):
    good = "https://media.example.org/720x720/12/34/1234567890abcdef0fedcba098765432.jpg"
    forms = [good, good.replace("https", "http"), good.replace("34/1", "34/sample_1"), good.replace("abcdef", "ABCDEF"), good + "/x", None]
    rows = spark.createDataFrame(list(enumerate(forms)), "n int, url string").select("n", codec.parse_media_url(F.col("url")).alias("p")).collect()
    assert {r.n for r in rows if r.p is not None} == {0, 1}


def test_windows_count_skipped_records_as_failures(spark):
    reasons = ["ok", "deleted", "http_429", "no_supported_url"] * 2 + ["ok"] * 4 + ["ok"]
    rows = [(i, r, 0.5, 0.1) for i, r in enumerate(reasons)]
    out = ingest.count_windows(spark.createDataFrame(rows, "seq long, reason string, download_sec double, embed_sec double"), 4).orderBy("win").collect()
    assert [(r.win, r.failure_rate, r.blocked) for r in out] == [(0, 0.75, 1), (1, 0.75, 1), (2, 0.0, 0)]


def test_probe_below_all_ids_names_no_neighbours(spark):
    ids = spark.createDataFrame([(i,) for i in (1000, 999, 500)], "id long")
    out = gaps.probed_gaps(ids, 1000, 100, 10).orderBy("nth").collect()
    assert [(r.upper_id, r.lower_id, r.lower_existing_id, r.upper_existing_id) for r in out][0] == (998, 501, 500, 999)
    assert (out[-1].lower_id, out[-1].lower_existing_id, out[-1].upper_existing_id) == (1, None, None)


def test_incoming_scan_counts_rows_over_all_files(spark, tmp_path):
    (tmp_path / "embeddings.parquet").mkdir()
    for n, (first, last) in enumerate(((0, 7), (7, 8), (8, 20))):
        rows = pa.table({"vec_id": pa.array(range(first, last), pa.int64()), "label": pa.array([i % 3 for i in range(first, last)], pa.int32())})
        pq.write_table(rows, tmp_path / "embeddings.parquet" / f"part-{n:04}.parquet")
    got = catalog.QUERIES["incoming_scan"](spark, str(tmp_path)).orderBy("vec_id").collect()
    assert [tuple(r) for r in got] == [(i, i % 3, i) for i in range(20)]


def test_search_fallback_is_past_all_hits_of_large_tables(spark, tmp_path):
    rows = spark.range(0, 100_030, numPartitions=4).selectExpr("id as vec_id", "array(cast(1 + id % 7 as float), cast(id % 5 as float)) as embedding", "cast(id % 10 as int) as label")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    found = catalog.QUERIES["search_fallback"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = c.sql(catalog.ORACLE_SQL["search_fallback"]).select(", ".join(found.columns)).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 5


def test_lists_are_assigned_by_blocks_and_copies_keep_the_least_keys(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(300)] + [(300 + i, [9.0, 9.0, 9.0]) for i in range(40)] + [(340, None)]
    vectors = spark.createDataFrame(rows, "vec_idx long, emb array<float>")
    centroids = ivf.train_centroids(vectors, 6)
    indexed = ivf.assign_lists(vectors, centroids)
    assert "Join" not in indexed._jdf.queryExecution().executedPlan().toString()
    centres = {r.list_no: r.centroid for r in centroids.collect()}
    nearest = lambda v: max((sum(a * b for a, b in zip(v, c, strict=True)), n) for n, c in centres.items())[1]
    got = {r.vec_idx: r.list_no for r in indexed.collect()}
    assert got == {i: nearest(v) for i, v in rows if v}
    queries = vectors.where("vec_idx in (0, 33, 320, 340)").select(F.col("vec_idx").alias("query_id"), F.col("emb").alias("vector"))
    found = {tuple(r) for r in ivf.search_lists(queries, indexed, centroids, 6, 5).collect()}
    asked, kept = (df.where("emb is not null") for df in (queries.withColumnRenamed("vector", "emb"), vectors))
    assert found == {tuple(r) for r in search.top_k_each(asked.withColumnRenamed("emb", "vector"), kept, 5).collect()} and len(found) == 15
    assert {h for q, h, _, _ in found if q == 320} == set(range(300, 305))
    none = ivf.train_centroids(vectors.limit(0), 4)
    assert ivf.search_lists(queries.limit(0), ivf.assign_lists(vectors.limit(0), none), none, 4, 5).collect() == []

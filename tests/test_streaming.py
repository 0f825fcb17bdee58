"""Sources, the streaming collector and queue steps, on hand-made inputs."""

from __future__ import annotations

import json
import random
from decimal import Decimal
from pathlib import Path
from urllib.error import HTTPError

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vec
from tessera.operators import ingest, ranges, search
from tessera.schemas import INCOMING, POSTS, RANGES, SOURCE_POST
from tessera.sources import files, paged
from tessera.streaming import collector

def incoming(ids, rating=0, at=0):
    return [(i, rating, 1, 2, Decimal(2**64 - 1 - i), Decimal(i), 0, [float(i), float(at)]) for i in ids]


def write(spark, folder, name, rows):
    path = f"{folder}/raw-{name}"
    spark.createDataFrame(rows, INCOMING).coalesce(1).write.parquet(path)
    part = next(Path(path).glob("*.parquet"))
    part.rename(f"{folder}/in/{name}.parquet")


def collect(spark, folder, snapshots, **settings):
    stream = collector.collect_files(spark, f"{folder}/in", snapshots, f"{folder}/checkpoint", INCOMING, 3, **settings)
    assert stream.awaitTermination(120)
    posts, vectors = snapshots.read()
    return {r.id: r.vec_idx for r in posts.collect()}, {r.vec_idx: list(r.emb) for r in vectors.collect()}


def test_collector_merges_new_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    snapshots = collector.Snapshots(spark, str(tmp_path / "snapshot"))
    assert [df.collect() for df in snapshots.read()] == [[], []]
    write(spark, tmp_path, "a", incoming([5, 7]) + incoming([9], rating=4))
    first, emb = collect(spark, tmp_path, snapshots)
    assert first == {5: 0, 7: 1} and emb == {0: [5.0, 0.0], 1: [7.0, 0.0]}
    write(spark, tmp_path, "b", incoming([7, 8, 5, 8], at=1))  # 5 and 7 are known, 8 repeats
    second, emb = collect(spark, tmp_path, snapshots)
    assert second == {5: 0, 7: 1, 8: 2} and emb == {0: [5.0, 0.0], 1: [7.0, 0.0], 2: [8.0, 1.0]}
    version = snapshots.current()
    assert collect(spark, tmp_path, snapshots)[0] == second and snapshots.current() == version  # nothing new


def test_batch_that_was_committed_is_passed_over(spark, tmp_path):
    snapshots = collector.Snapshots(spark, str(tmp_path))
    batch = spark.createDataFrame(incoming([3]), INCOMING).withColumns({"path": F.lit("p"), "row_index": F.lit(0)})
    run = collector.merge_batches(snapshots, 3)
    run(batch, 0)
    run(batch.withColumn("id", F.lit(4)), 0)
    assert snapshots.current() == {"version": 0, "batch": 0}
    run(batch.withColumn("id", F.lit(4)), 1)
    assert sorted((r.id, r.vec_idx) for r in snapshots.read()[0].collect()) == [(3, 0), (4, 1)]


def test_interrupted_commit_leaves_the_last_version(spark, tmp_path):
    snapshots = collector.Snapshots(spark, str(tmp_path))
    batch = spark.createDataFrame(incoming([3]), INCOMING).withColumns({"path": F.lit("p"), "row_index": F.lit(0)})
    run = collector.merge_batches(snapshots, 3)
    run(batch, 0)
    (tmp_path / "v1").mkdir()  # of a run that ended before it named its version
    (tmp_path / "v1" / "posts").mkdir()
    assert [r.id for r in snapshots.read()[0].collect()] == [3]
    run(batch.withColumn("id", F.lit(6)), 1)
    assert sorted(r.id for r in snapshots.read()[0].collect()) == [3, 6]


IDS = [i for i in range(1, 60) if i % 7]


def some_posts(cursor, limit):
    """What PagedSource fetches in the tests."""
    return [{"id": i, "rating": "g"} for i in sorted(IDS, reverse=True) if i < cursor][:limit]


@pytest.mark.parametrize("limit", [5, 100])
def test_paged_reader_walks_down_and_reads_again(limit):
    reader = paged.PagedReader({"upper": "50", "lower": "10", "limit": str(limit), "fetcher": f"{__name__}:some_posts"})
    at, seen = reader.initialOffset(), []
    while True:
        rows, end = reader.read(at)
        rows = list(rows)
        if end == at:
            break
        assert list(reader.readBetweenOffsets(at, end)) == rows  # as after a restart
        seen, at = seen + [r[0] for r in rows], end
    assert seen == [i for i in sorted(IDS, reverse=True) if 10 <= i <= 50]
    assert json.loads(rows[0][1])["rating"] == "g" if rows else True


def test_embed_records_gives_a_reason_to_each_failure(spark):
    def load(url):
        if url == "gone":
            raise HTTPError(url, 404, "gone", None, None)
        if url == "lost":
            raise OSError("network")
        return url.encode()

    def prepare(body):
        return {b"bad": lambda: 1 // 0}.get(body, lambda: body)()

    def embed(images):
        return [None if x == b"none" else [0.0] * (3 if x == b"long" else 2) for x in images]

    urls = ["fine", "gone", "lost", "bad", "none", "long", "fine"]
    records = spark.createDataFrame(list(enumerate(urls)), "id long, image_url string")
    got = {r.id: (r.reason, r.emb) for r in collector.embed_records(records, load, prepare, embed, 2, batch_size=3).collect()}
    assert [got[i][0] for i in range(7)] == ["ok", "http_404", "download_or_decode_failed", "preprocess_failed", "embed_failed", "embed_dim_mismatch", "ok"]
    assert [got[i][1] is None for i in range(7)] == [False, True, True, True, True, True, False]
    short = collector.embed_records(records.where("id in (0, 6)"), load, prepare, lambda images: [], 2).collect()
    assert {r.reason for r in short} == {"embed_failed"}


def test_half_vectors(spark, tmp_path):
    values = np.random.default_rng(3).normal(size=(2500, 8)).astype(np.float16)
    (tmp_path / "m.f16").write_bytes(values.tobytes())
    np.save(tmp_path / "m.npy", values)
    for name in ("m.f16", "m.npy"):
        rows = files.read_half_vectors(spark, str(tmp_path / name), 8, rows_at_once=700).orderBy("vec_idx").collect()
        assert [r.vec_idx for r in rows] == list(range(2500)) and np.array_equal(np.array([r.emb for r in rows], np.float16), values)
    with pytest.raises(ValueError):
        files.read_half_vectors(spark, str(tmp_path / "m.f16"), 7)
    rounded = spark.createDataFrame([([0.1, 1e-9, 70000.0],), (None,)], "v array<float>").select(vec.through_half("v").alias("v")).collect()
    assert rounded[0].v[0] == float(np.float16(0.1)) and rounded[0].v[1:] == [0.0, float("inf")] and rounded[1].v is None


def test_tags_from_a_file_or_what_is_fetched(spark, tmp_path):
    text = "name,category,count\nred,1,5\n ,0,1\nblue,,7\n"
    (tmp_path / "t.csv").write_text(text)
    want = [(0, "red", 1, 5), (1, "blue", 0, 7)]
    for df in (files.read_tags(spark, [str(tmp_path / "no"), str(tmp_path / "t.csv")]), files.read_tags(spark, [str(tmp_path / "no")], lambda: text)):
        assert [tuple(r) for r in df.orderBy("tag_idx").collect()] == want
    assert files.read_tags(spark, [], lambda: None).collect() == []


def test_media_candidates_and_retry_after(spark):
    post = (1, False, "g", None, "https://h/p.jpg", "", "/f.png")
    found = spark.createDataFrame([post], SOURCE_POST).select(ingest.media_candidates(F.struct(*[f.name for f in SOURCE_POST])).alias("c")).first().c
    assert [u.rpartition("/")[2] for u in found] == ["f.png", "p.jpg"] and all(u.startswith("https://") for u in found)
    values = [("7", 7.0), (" 0 ", 0.0), ("-3", None), ("Wed, 21 Oct 2015 07:28:30 GMT", 30.0), ("Wed, 21 Oct 2015 07:27:00 GMT", None), ("soon", None), (None, None)]
    now = F.lit("2015-10-21 07:28:00").cast("timestamp")
    rows = spark.createDataFrame(list(enumerate(v for v, _ in values)), "n int, h string").select("n", ingest.retry_after(F.col("h"), now).alias("s")).orderBy("n").collect()
    assert [r.s for r in rows] == [s for _, s in values]


def queue(spark, rows):
    return spark.createDataFrame([(n, u, low, u + 1, "probe", "pending") for n, (u, low) in enumerate(rows)], RANGES)


def pairs(df):
    return [(r.upper_id, r.lower_id, r.status) for r in df.orderBy("seq").collect()]


def test_queue_steps(spark):
    held = queue(spark, [(90, 80), (50, 40)])
    assert pairs(ranges.activate(held)) == [(90, 80, "active"), (50, 40, "pending")]
    rest, resume = ranges.complete(held)
    assert pairs(rest) == [(50, 40, "pending")] and resume.first().probe_resume_id == 79
    no_gap = ranges.latest_gap(spark.createDataFrame([(100,)], "max_id long"), 101, 400)
    probed = spark.createDataFrame([(0, 30, 20), (1, 10, 5)], "nth long, upper_id long, lower_id long")
    assert [p[:2] for p in pairs(ranges.plan(held, no_gap, probed))] == [(90, 80), (50, 40)]
    assert [p[:2] for p in pairs(ranges.plan(held.limit(0), no_gap, probed))] == [(30, 20)]
    assert [p[:2] for p in pairs(ranges.enqueue(held, queue(spark, [(50, 40), (7, 3)])))] == [(90, 80), (50, 40), (7, 3)]


def test_hits_without_a_post_are_left_out(spark):
    rng = random.Random(1)
    posts = spark.createDataFrame([(i, i % 4, 1, 2, rng.getrandbits(60), 4, 0, i) for i in range(12) if i % 3], POSTS)
    hits = spark.createDataFrame([(i, 1.0 - i / 20, i + 1) for i in range(12)] + [(-1, 0.1, 13)], "hit long, score double, rank int")
    got = search.ranked_hits(search.page_of(hits, 8, 2), posts, "id", 2).collect()
    assert sorted(int(r.id) for r in got) == [i for i in range(2, 10) if i % 3 and i % 4 <= 2]

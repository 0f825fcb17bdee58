"""Centroid-pruned search: lists by nearest centroid, a few lists probed."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vec import unit
from ..llm.common import Scratch, shuffle_parts, tidied
from .search import best_each, blocks_of

#: Rows and queries (or centroids) that are multiplied at a time.
ROWS, COLUMNS = 1024, 2048
#: Rounded scores and sums in another order differ by less.
SLACK = 4e-6
#: Tasks that train centroids; each returns the sums of all lists.
TRAIN_PARTS, TRAIN_ROUNDS = 8, 10


def list_count(rows: Column) -> Column:
    return F.when(rows >= 4096, F.lit(4096)).otherwise(F.greatest(F.lit(128), F.floor(rows / 64))).cast("bigint")


def code_parts(dim: Column) -> Column:
    return F.when(dim % 64 == 0, F.lit(64)).otherwise(F.lit(32)).cast("bigint")


def training_sample(vectors: DataFrame, order: list[str], rows: int = 200_000) -> DataFrame:
    """The first rows in path and row order: what the index is trained on."""
    return vectors.orderBy(*order).limit(rows)


def _matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """A list column without nulls, its lists of one length, as rows."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = np.concatenate([np.empty(0, kind), *[p.flatten().to_numpy(zero_copy_only=False).astype(kind) for p in parts]])
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _best(rows: np.ndarray, centroids: np.ndarray, less: np.ndarray | float = 0.0) -> np.ndarray:
    """The place of the greatest inner product less ``less``, of equal ones the last."""
    out = np.empty(len(rows), np.int64)
    for i in range(0, len(rows), ROWS):
        near = rows[i : i + ROWS] @ centroids.T - less
        out[i : i + ROWS] = near.shape[1] - 1 - near[:, ::-1].argmax(axis=1)
    return out


def _centres(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and centroids in order of number."""
    table = centroids.select("list_no", F.col("centroid").cast("array<double>").alias("centroid")).toArrow().sort_by("list_no")
    return table["list_no"].to_numpy(), _matrix(table["centroid"])


def train_centroids(sample: DataFrame, lists: int, seed: int = 7) -> DataFrame:
    """list_no, centroid (a table of fixed size): k-means from distinct rows in the order of a hash, so
    fewer lists than asked for if there are fewer distinct rows."""
    spark: SparkSession = sample.sparkSession
    scratch = Scratch(spark)
    rows = scratch.keep(sample.select(F.col("emb").cast("array<float>").alias("emb")).where("emb is not null").repartition(TRAIN_PARTS), "sample")
    start = rows.distinct().orderBy(F.xxhash64("emb", F.lit(seed)), "emb").limit(lists)
    centres = _matrix(start.toArrow()["emb"], np.float32)

    def sums(now: np.ndarray) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            half, total, count = (now * now).sum(axis=1) / 2, np.zeros(now.shape), np.zeros(len(now), np.int64)
            for batch in batches:
                x = _matrix(batch.column(0), np.float32)
                if len(x):
                    at = _best(x, now, half)
                    order = at.argsort(kind="stable")
                    some, first = np.unique(at[order], return_index=True)
                    total[some] += np.add.reduceat(x[order].astype(np.float64), first, axis=0)
                    count += np.bincount(at, minlength=len(now))
            some = np.flatnonzero(count)
            for i in range(0, len(some), ROWS):
                part = some[i : i + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(count[part]), pa.array(list(total[part]), pa.list_(pa.float64()))], names=["at", "n", "total"])

        return rows.mapInArrow(tidied(run), "at long, n long, total array<double>")

    for _ in range(TRAIN_ROUNDS if len(centres) else 0):
        got = sums(centres).toArrow()
        total, count = np.zeros(centres.shape), np.zeros(len(centres), np.int64)
        np.add.at(total, got["at"].to_numpy(), _matrix(got["total"]))
        np.add.at(count, got["at"].to_numpy(), got["n"].to_numpy())
        new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres).astype(np.float32)
        if (new == centres).all():
            break
        centres = new
    scratch.drop(rows)
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list_no int, centroid array<double>")


def assign_lists(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """Each vector with its nearest list by inner product; null vectors are in no list."""
    numbers, centres = _centres(centroids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = numbers[_best(_matrix(batch.column("emb")), centres)] if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=[*batch.schema.names, "list_no"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.where("emb is not null").mapInArrow(tidied(run), f"{kinds}, list_no int")


def by_list(indexed: DataFrame, scratch: Scratch) -> DataFrame:
    """A written index with the rows of a list together; large lists may span tasks."""
    kept = scratch.keep(indexed, "assigned")
    out = scratch.keep(kept.repartitionByRange(shuffle_parts(indexed.sparkSession), "list_no", "vec_idx").sortWithinPartitions("list_no", "vec_idx"), "lists")
    scratch.drop(kept)
    return out


def _ranks(asked: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each query the place of each list, from 0, the nearest first."""
    order = (-(asked @ centres.T)).argsort(axis=1, kind="stable")
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.arange(order.shape[1])[None], axis=1)
    return out


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", unit(F.col("vector")).alias("q")).where("q is not null")


def _kind(queries: DataFrame) -> str:
    return queries.schema["query_id"].dataType.simpleString()


def _probing(queries: DataFrame, centres: np.ndarray, nprobe: int) -> DataFrame:
    """query_id, q, lists: each normalised query with a bit for each list, set if it is probed."""
    asked = _asked(queries)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                bits = np.packbits(_ranks(_matrix(part.column("q")), centres) < nprobe, axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([b.tobytes() for b in bits], pa.binary())], names=["query_id", "q", "lists"])

    return asked.mapInArrow(tidied(run), f"query_id {_kind(queries)}, q array<double>, lists binary")


def _least_copies(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """Without copies of a vector beyond its k least keys, which are never among the k best."""
    x = _matrix(batch.column(1))
    same = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.lexsort((batch.column(0).to_numpy(), same))
    first = np.flatnonzero(np.concatenate(([True], same[order][1:] != same[order][:-1])))
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return batch if (nth < k).all() else batch.take(pa.array(np.sort(order[nth < k])))


def _scan(asked: pa.Table, kind: str, numbers: np.ndarray, rows: DataFrame, k: int) -> DataFrame:
    """query_id, hit, score, rank: the k best of ``rows`` for each query in ``asked`` (query_id of type ``kind``,
    q, lists if only these lists are probed).

    Products of whole blocks leave out what is surely not among a task's k best; the rest is summed in order.
    """
    queries, ids = _matrix(asked["q"]), asked["query_id"].combine_chunks()
    probed = "lists" in asked.schema.names
    bits = np.frombuffer(b"".join(asked["lists"].to_pylist()), np.uint8).reshape(len(ids), -1) if probed and len(ids) else None
    data = rows.select("vec_idx", "emb", *(["list_no"] if probed else [])).where("emb is not null")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.full(len(queries), -np.inf)
        for batch in batches:
            if batch.num_rows and len(queries):
                batch = _least_copies(batch, k)
            for i in range(0, batch.num_rows if len(queries) else 0, ROWS):
                part = batch.slice(i, ROWS)
                x, wanted, place = _matrix(part.column(1)), np.arange(len(queries)), None
                if bits is not None:
                    own, which = np.unique(part.column(2).to_numpy(), return_inverse=True)
                    at = np.searchsorted(numbers, own)
                    probes = (bits[:, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                    wanted = np.flatnonzero(probes.any(axis=1))
                    place = probes[:, which]
                for j in range(0, len(wanted), COLUMNS):
                    some = wanted[j : j + COLUMNS]
                    near = queries[some] @ x.T
                    if place is not None:
                        near[~place[some]] = -np.inf
                    if near.shape[1] >= k:
                        floor[some] = np.maximum(floor[some], np.partition(near, -k, axis=1)[:, -k])
                    q, r = np.nonzero((near >= floor[some, None] - SLACK) & (near > -np.inf))
                    for h in range(0, len(q), 8192):
                        qs, rs = some[q[h : h + 8192]], r[h : h + 8192]
                        total = np.cumsum(queries[qs] * x[rs], axis=1)[:, -1]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(qs)), part.column(0).take(pa.array(rs)), pa.array(total)], names=["query_id", "hit", "score"])

    hit = rows.schema["vec_idx"].dataType.simpleString()
    found = data.mapInArrow(tidied(run), f"query_id {kind}, hit {hit}, score double")
    return best_each(found.withColumn("score", F.round("score", 6)), k)


def probes_for(sample: DataFrame, vectors: DataFrame, indexed: DataFrame, centroids: DataFrame, k: int, recall: float, least: int) -> int:
    """The fewest lists to probe, ``least`` at least, that hold the share ``recall`` of the true hits.

    ``sample`` (query_id, vector) is a bounded set; its hits are found exactly among all ``vectors``.
    """
    numbers, centres = _centres(centroids)
    asked = _asked(sample).toArrow()
    hits = _scan(asked, _kind(sample), numbers, vectors, k).select("query_id", F.col("hit").alias("vec_idx"))
    place = F.broadcast(hits).join(indexed.select("vec_idx", "list_no"), "vec_idx").select("query_id", "list_no").collect()
    if not place:
        return least
    ranks = dict(zip(asked["query_id"].to_pylist(), _ranks(_matrix(asked["q"]), centres), strict=True))
    needed = sorted(int(ranks[r.query_id][np.searchsorted(numbers, r.list_no)]) + 1 for r in place)
    return max(least, needed[max(1, math.ceil(recall * len(needed) - 1e-9)) - 1])


def search_lists(queries: DataFrame, indexed: DataFrame, centroids: DataFrame, nprobe: int, k: int) -> DataFrame:
    """query_id, hit, score, rank over the ``nprobe`` nearest lists of each query, block by block."""
    numbers, centres = _centres(centroids)
    blocks = blocks_of(queries, F.size("vector") * 8 + -(-len(numbers) // 8))
    found = lambda part: _scan(_probing(part, centres, nprobe).toArrow(), _kind(queries), numbers, indexed, k)
    if len(blocks) == 1:
        return found(queries)
    scratch = Scratch(queries.sparkSession)  # written, so that the driver holds one block
    return reduce(DataFrame.unionByName, [scratch.keep(found(part), "block") for part in blocks])

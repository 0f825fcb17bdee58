"""Streaming merge of incoming record files into snapshots."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import merge
from ..schemas import POSTS, VECTORS


class Embedder(Protocol):
    def __call__(self, images: list[bytes]) -> list[list[float] | None]: ...


class Snapshots:
    """Versions of both tables in one folder; a small manifest names the current one, so readers see
    either all of a batch or nothing of it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.manifest = spark, Path(root), Path(root) / "CURRENT"
        self.root.mkdir(parents=True, exist_ok=True)

    def current(self) -> dict:
        return json.loads(self.manifest.read_text()) if self.manifest.exists() else {"version": -1, "batch": -1}

    def read(self) -> tuple[DataFrame, DataFrame]:
        version = self.current()["version"]
        if version < 0:
            return self.spark.createDataFrame([], POSTS), self.spark.createDataFrame([], VECTORS)
        return tuple(self.spark.read.parquet(f"{self.root}/v{version}/{t}") for t in ("posts", "vectors"))  # type: ignore[return-value]

    def commit(self, posts: DataFrame, vectors: DataFrame, batch: int) -> None:
        version = self.current()["version"] + 1
        posts.write.mode("overwrite").parquet(f"{self.root}/v{version}/posts")
        vectors.write.mode("overwrite").parquet(f"{self.root}/v{version}/vectors")
        temporary = self.root / "CURRENT.tmp"
        temporary.write_text(json.dumps({"version": version, "batch": batch}))
        temporary.replace(self.manifest)


def merge_batches(snapshots: Snapshots, threshold: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch that was committed before a restart is passed over."""

    def run(batch: DataFrame, number: int) -> None:
        if number <= snapshots.current()["batch"]:
            return
        posts, vectors = snapshots.read()
        snapshots.commit(*merge(posts, vectors, batch, threshold), number)

    return run


def collect_files(spark: SparkSession, folder: str, snapshots: Snapshots, checkpoint: str, schema, threshold: int = 3, delete: bool = False):
    """All files that are there, in one run; files are merged in name order."""
    reader = spark.readStream.schema(schema).option("cleanSource", "delete" if delete else "off")
    stream = reader.parquet(folder).select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row_index"))
    return stream.writeStream.foreachBatch(merge_batches(snapshots, threshold)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embed_records(records: DataFrame, load: Callable[[str], bytes], prepare: Callable[[bytes], bytes], embed: Embedder, dim: int, batch_size: int = 32) -> DataFrame:
    """records (id, image_url) to (id, emb, reason): load, prepare and embed in batches of Arrow rows.

    A failure of one record is its reason, http_<status> where the error of ``load`` has a status as ``code``;
    a batch of the wrong size fails as a whole.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, batch_size):
                batch = whole.slice(first, batch_size)
                ready, reasons, out = [], ["ok"] * batch.num_rows, [None] * batch.num_rows
                for i, url in enumerate(batch.column(1).to_pylist()):
                    step = "download_or_decode_failed"
                    try:
                        body = load(url)
                        step = "preprocess_failed"
                        ready.append((i, prepare(body)))
                    except Exception as e:  # noqa: BLE001
                        status = getattr(e, "code", None)
                        reasons[i] = f"http_{status}" if isinstance(status, int) and step.startswith("download") else step
                try:
                    found = embed([x for _, x in ready])
                except Exception:  # noqa: BLE001
                    found = []
                if len(found) != len(ready):
                    found = [None] * len(ready)
                for (i, _), emb in zip(ready, found, strict=True):
                    if emb is None:
                        reasons[i] = "embed_failed"
                    elif len(emb) != dim:
                        reasons[i] = "embed_dim_mismatch"
                    else:
                        out[i] = emb
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float32())), pa.array(reasons)], names=["id", "emb", "reason"])

    return records.select("id", "image_url").mapInArrow(run, "id long, emb array<float>, reason string")

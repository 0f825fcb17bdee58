"""Readers of other files: tag CSV, float16 vectors, older arrays, collector state."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tags import dictionary
from ..schemas import TAGS


def read_tags(spark: SparkSession, paths: list[str], fetch: Callable[[], str | None] | None = None) -> DataFrame:
    """The first path that is there, else what ``fetch`` gives, else no tags.  File order is model order."""
    for path in paths:
        if Path(path).exists():
            rows = spark.read.csv(path, header=True)
            break
    else:
        text = fetch() if fetch else None
        if not text:
            return spark.createDataFrame([], TAGS)
        rows = spark.read.csv(spark.sparkContext.parallelize(text.splitlines(), 1), header=True)
    return dictionary(rows.withColumn("_row", F.monotonically_increasing_id()), "_row")


def read_half_vectors(spark: SparkSession, path: str, dim: int, rows_at_once: int = 50_000) -> DataFrame:
    """vec_idx, emb of a headerless float16 matrix or of a two-dimensional .npy array.

    Row ranges are read in parallel by seeking, so the path must be one that all executors have.
    """
    size, skip, kind = os.path.getsize(path), 0, "<f2"
    if path.endswith(".npy"):
        array = np.load(path, mmap_mode="r")
        if array.ndim != 2 or array.shape[1] != dim:
            raise ValueError(f"{path} has shape {array.shape}, not (rows, {dim})")
        skip, kind = array.offset, array.dtype.str
    width = dim * np.dtype(kind).itemsize
    if (size - skip) % width:
        raise ValueError(f"{path} is not a whole number of rows of {dim}")
    total = (size - skip) // width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                n = min(rows_at_once, total - first)
                with open(path, "rb") as f:
                    f.seek(skip + first * width)
                    block = np.frombuffer(f.read(n * width), kind).astype(np.float32)
                emb = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(block))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), emb], names=["vec_idx", "emb"])

    starts = spark.range(0, max(total, 0), rows_at_once)
    return starts.repartition(max(1, min(64, -(-total // rows_at_once)))).mapInArrow(run, "vec_idx long, emb array<float>")


def read_struct_array(spark: SparkSession, path: str) -> DataFrame:
    """A structured or two-dimensional .npy array as columns (_1, _2, ... where fields have no names)."""
    array = np.load(path, mmap_mode="r")
    names = list(array.dtype.names or [f"_{i + 1}" for i in range(array.shape[1])])
    columns = [np.asarray(array[n] if array.dtype.names else array[:, i]) for i, n in enumerate(names)]
    columns = [c.view(np.int64) if c.dtype == np.uint64 else c for c in columns]
    return spark.createDataFrame(pa.table(dict(zip(names, columns, strict=True))))


def find_cache(path: str | None, candidates: list[str], needed: tuple[str, ...]) -> str | None:
    """The given folder, or the first candidate that has all files."""
    return next((d for d in ([path] if path else candidates) if all((Path(d) / n).exists() for n in needed)), None)


@dataclass
class Range:
    upper_id: int
    lower_id: int
    cursor_id: int
    source: str = "probe"
    status: str = "pending"


@dataclass
class State:
    sync_failures: list[int] = field(default_factory=list)
    pending_ranges: list[Range] = field(default_factory=list)
    probe_resume_id: int = 0

    def compacted(self, keep: int = 5000) -> State:
        seen: dict[tuple[int, int], Range] = {}
        for r in self.pending_ranges:
            if r.upper_id > 0 and r.lower_id > 0 and r.upper_id >= r.lower_id:
                cursor = min(max(r.cursor_id or r.upper_id + 1, r.lower_id + 1), r.upper_id + 1)
                source = r.source if r.source in ("probe", "latest") else "probe"
                status = r.status if r.status in ("pending", "active") else "pending"
                seen.setdefault((r.upper_id, r.lower_id), Range(r.upper_id, r.lower_id, cursor, source, status))
        return State(sorted(set(self.sync_failures))[-keep:], list(seen.values()), max(0, self.probe_resume_id))


def _whole(x: object) -> int:
    try:
        return int(x)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return 0


def load_state(path: str) -> State:
    """An empty state where the file is missing or broken; older names are understood."""
    try:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        raw = raw if isinstance(raw, dict) else {}
    except (OSError, ValueError):
        raw = {}
    failures = raw.get("sync_failures", raw.get("latest_failures")) or []
    ranges = [Range(_whole(r.get("upper_id")), _whole(r.get("lower_id")), _whole(r.get("cursor_id")), str(r.get("source", "probe")), str(r.get("status", "pending"))) for r in raw.get("pending_ranges") or [] if isinstance(r, dict)]
    if not ranges and _whole(raw.get("active_gap_upper_id")) > 0:
        ranges = [Range(*[_whole(raw.get(f"active_gap_{k}_id")) for k in ("upper", "lower", "cursor")], "probe", "active")]
    resume = next((_whole(raw[k]) for k in ("probe_resume_id", "sync_cursor_id", "latest_cursor_id") if k in raw), 0)
    return State([_whole(x) for x in failures], ranges, resume).compacted()


def save_state(path: str, state: State) -> None:
    temporary = Path(f"{path}.tmp")
    temporary.write_text(json.dumps(asdict(state.compacted())), encoding="utf-8")
    temporary.replace(path)

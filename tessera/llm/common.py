"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and normalisation rules (fixed values).
SPACE_CLASS = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Taken from ``spark.checkpoint.dir``; only where that is unset (tests, local runs) a local
    temporary folder is chosen, once per session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Written tables of one operator call: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, tag: str, records: int | None = None, **settings: str) -> DataFrame:
        """``records``: rows of an Arrow batch while this table is written, for plans with wide rows;
        ``settings``: others of ``spark.sql.optimizer.runtime.bloomFilter``."""
        path = f"{self.root}/{tag}-{uuid.uuid4().hex[:8]}"
        wanted = {f"spark.sql.optimizer.runtime.bloomFilter.{k}": v for k, v in settings.items()}
        if records:
            wanted["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(records)
        before = {k: self.spark.conf.get(k) for k in wanted}
        try:
            for k, v in wanted.items():
                self.spark.conf.set(k, v)
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def keep_by(self, df: DataFrame, key: str, tag: str) -> tuple[DataFrame, DataFrame]:
        """A written table in buckets of ``key``, which joins on it do not deal out again, and the same
        table without them, whose joins the engine can split where keys are frequent."""
        n, name = shuffle_parts(self.spark), f"tessera_{tag}_{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        out._scratch_path, out._scratch_table = path, name
        return out, self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Removes tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            if hasattr(df, "_scratch_table"):
                self.spark.sql(f"DROP TABLE IF EXISTS {df._scratch_table}")
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)
        jvm.System.gc()  # the driver removes shuffle files once nothing refers to their step


#: What workers hold from task to task (vocabularies, word tables), for the function that last ran.
HELD: list[dict] = []
_last = [""]


def _forget(name: str) -> None:
    if _last[0] != name:
        for held in HELD:
            held.clear()
        _last[0] = name


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``run`` for mapInArrow: a worker that goes on to another function forgets what it held for the
    last one, and gives back freed memory at a task's end."""
    name = f"{run.__module__}.{run.__qualname__}"

    def tidy(batches: Iterable) -> Iterator:
        _forget(name)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidy


def slabs(values: Iterable, size_of, limit: int) -> Iterator[list]:
    """Consecutive values in lists of about ``limit`` bytes, one value at least."""
    held, total = [], 0
    for value in values:
        n = size_of(value)
        if held and total + n > limit:
            yield held
            held, total = [], 0
        held.append(value)
        total += n
    if held:
        yield held


def text_or_empty(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))

"""A source of pages in descending id order, as a table operation and as a stream."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def page(rows: DataFrame, limit: int, cursor: int | None = None, key: str = "id") -> DataFrame:
    """The ``limit`` greatest ids below ``cursor`` (the newest where there is none)."""
    below = rows if cursor is None else rows.where(F.col(key) < cursor)
    return below.orderBy(F.col(key).desc()).limit(limit)


def latest_head(rows: DataFrame, key: str = "id") -> DataFrame:
    return page(rows, 5, None, key).agg(F.coalesce(F.max(key), F.lit(0)).alias("head"))


def within(rows: DataFrame, lower: int, upper: int, key: str = "id") -> DataFrame:
    return rows.where(F.col(key).between(lower, upper))


def all_pages(rows: DataFrame, upper: int, lower: int, limit: int, key: str = "id") -> DataFrame:
    """page_no, n, min_id, max_id of every page a cursor takes from ``upper`` to ``lower``.

    Ids are distinct.  Stretches of ids are counted first, so only their counts are ordered globally.
    """
    own = within(rows, lower, upper, key).withColumn("_s", F.floor(F.col(key) / 65536))
    counts = own.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_s", F.coalesce(F.sum("_n").over(W.orderBy(F.col("_s").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = own.withColumn("_r", F.row_number().over(W.partitionBy("_s").orderBy(F.col(key).desc()))).join(before, "_s")
    number = F.floor((F.col("_before") + F.col("_r") - 1) / limit).cast("bigint")
    return ranked.groupBy(number.alias("page_no")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("min_id"), F.max(key).alias("max_id"))


class PagedSource(DataSource):
    """Stream of source posts as JSON: each batch is a page below the cursor, until ``lower``.

    Options: upper, lower, limit, and ``fetcher`` ("module:function"), a function
    (cursor, limit) -> list of dicts with an ``id`` in descending order.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_posts"

    def schema(self) -> str:
        return "id long, post string"

    def simpleStreamReader(self, schema) -> PagedReader:  # noqa: N802
        return PagedReader(self.options)


class PagedReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.upper, self.lower, self.limit = int(options["upper"]), int(options["lower"]), int(options.get("limit", "200"))
        module, _, function = options["fetcher"].partition(":")
        self.where = (module, function)

    def _fetch(self) -> Callable[[int, int], list]:
        import importlib

        return getattr(importlib.import_module(self.where[0]), self.where[1])

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cursor": self.upper + 1}

    def _page(self, cursor: int) -> list[tuple]:
        got = self._fetch()(cursor, self.limit) if cursor > self.lower else []
        got = got if isinstance(got, list) else []
        return [(int(p["id"]), json.dumps(p)) for p in got if isinstance(p, dict) and "id" in p]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._page(start["cursor"])
        end = min((r[0] for r in rows), default=start["cursor"])
        return iter([r for r in rows if self.lower <= r[0] <= self.upper]), {"cursor": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([r for r in self._page(start["cursor"]) if max(self.lower, end["cursor"]) <= r[0] <= self.upper])

    def commit(self, end: dict) -> None:
        pass

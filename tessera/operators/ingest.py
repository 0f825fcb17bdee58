"""Source records: choice of variants, classification, outcome and throughput figures, autotuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..functions.codec import SUPPORTED, absolute_url, parse_media_url, rating_code, url_extension

#: Ranks of variant types for the image to embed; others rank last (fixed values).
TYPE_RANKS = {"sample": 0, "720x720": 1, "original": 2, "360x360": 3, "180x180": 4}
OTHER_RANK, LEAST_SIDE, RECORD_TYPE = 10, 448, "720x720"
SKIPPED = ("deleted", "no_supported_url")
BLOCKING = (403, 429)


def _usable(ext: Column) -> Column:
    return (ext == "") | ext.isin(*SUPPORTED)


def pick_variant(variants: Column, config: Config | None = None) -> Column:
    """URL of the best variant by (too small, type rank, place); null if none is usable."""

    def keyed(v: Column, i: Column) -> Column:
        side = F.least(F.coalesce(v["width"], F.lit(0)), F.coalesce(v["height"], F.lit(0)))
        rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in TYPE_RANKS.items() for x in p]), F.coalesce(v["type"], F.lit(""))), F.lit(OTHER_RANK))
        ext = F.lower(F.coalesce(v["file_ext"], F.lit("")))
        ext = F.when(ext == "", url_extension(F.coalesce(v["url"], F.lit("")))).otherwise(ext)
        return F.struct(F.when((side > 0) & (side < LEAST_SIDE), 1).otherwise(0).alias("small"), rank.alias("rank"), i.alias("place"), v["url"].alias("url"), ext.alias("ext"))

    good = F.filter(F.transform(variants, keyed), lambda k: F.coalesce(k["url"] != "", F.lit(False)) & _usable(k["ext"]))
    return absolute_url(F.array_min(good)["url"], config)


def image_url(post: Column, config: Config | None = None) -> Column:
    """The best variant, else the first usable of preview, large and file URL."""
    others = F.filter(F.array(post["preview_file_url"], post["large_file_url"], post["file_url"]), lambda u: F.coalesce(u != "", F.lit(False)) & _usable(url_extension(u)))
    return F.coalesce(pick_variant(post["media_asset"]["variants"], config), absolute_url(F.get(others, 0), config))


def record_url(variants: Column, config: Config | None = None) -> Column:
    """The first variant of the record's own type, whatever its extension; no fallback."""
    return absolute_url(F.get(F.filter(variants, lambda v: (v["type"] == RECORD_TYPE) & F.coalesce(v["url"] != "", F.lit(False))), 0)["url"], config)


def media_candidates(post: Column, config: Config | None = None) -> Column:
    return F.transform(F.filter(F.array(post["large_file_url"], post["file_url"], post["preview_file_url"]), lambda u: F.coalesce(u != "", F.lit(False))), lambda u: absolute_url(u, config))


def classify(posts: DataFrame, config: Config | None = None) -> DataFrame:
    """Source posts with rating, image_url, record_url, components and the first reason that applies."""
    post = F.struct(*posts.columns)
    own = posts.withColumns({"rating_code": rating_code(F.col("rating")), "image_url": image_url(post, config), "record_url": record_url(F.col("media_asset.variants"), config)})
    own = own.withColumn("components", parse_media_url(F.col("record_url"), config))
    reason = F.when(F.coalesce("id", F.lit(0)) <= 0, "invalid_id").when(F.coalesce("is_deleted", F.lit(False)), "deleted").when(F.col("image_url").isNull(), "no_supported_url").when(F.col("record_url").isNull(), "no_record_url").when(F.col("components").isNull(), "component_parse_failed").otherwise("ok")
    return own.withColumn("reason", reason)


def outcome(reason: Column) -> Column:
    return F.when(reason == "ok", "ok").when(reason.isin(*SKIPPED), "skipped").otherwise("failed")


def top_reasons(records: DataFrame, limit: int = 8) -> DataFrame:
    """Commonest reasons, of equal counts the first seen."""
    return records.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")).orderBy(F.col("n").desc(), "first_seq").limit(limit)


def _ratios(df: DataFrame) -> DataFrame:
    per = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 6)
    rate = lambda a, s: F.round(F.col(a) / F.greatest(F.col(s), F.lit(1e-9)), 6)
    return df.withColumns({"avg_download": per("download_sec", "n"), "avg_embed": per("embed_sec", "n_ok"), "images_per_sec": rate("n_ok", "busy_sec"), "mib_per_sec": F.round(F.col("bytes") / 1048576 / F.greatest(F.col("busy_sec"), F.lit(1e-9)), 6)})


def _sums(over: Column | None = None) -> dict:
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    found = {"n": F.count(F.lit(1)), "n_ok": count(F.col("reason") == "ok"), "n_skipped": count(F.col("reason").isin(*SKIPPED)), "download_sec": F.sum("download_sec"), "embed_sec": F.sum("embed_sec"), "bytes": F.sum("bytes"), "busy_sec": F.sum(F.col("download_sec") + F.col("embed_sec"))}
    return found if over is None else {k: v.over(over) for k, v in found.items()}


def throughput(records: DataFrame) -> DataFrame:
    return _ratios(records.agg(*[v.alias(k) for k, v in _sums().items()]))


def running(records: DataFrame, every: int = 25) -> DataFrame:
    """Figures so far, after each ``every`` records.  Blocks are summed first, so only one row a block
    is ordered globally; seq runs from 0 without gaps."""
    blocks = records.groupBy(F.floor(F.col("seq") / every).alias("block")).agg(*[v.alias(k) for k, v in _sums().items()])
    far = W.orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    names = list(_sums())
    full = blocks.withColumn("whole", F.col("n") == every)
    return _ratios(full.select("block", "whole", *[F.sum(c).over(far).alias(c) for c in names]).where("whole").drop("whole"))


def count_windows(records: DataFrame, size: int) -> DataFrame:
    """Whole tumbling windows of ``size`` records with the figures of the window before."""
    blocked = F.sum(F.when(F.col("reason").isin(*[f"http_{c}" for c in BLOCKING]), 1).otherwise(0))
    failed = F.sum(F.when(F.col("reason") == "ok", 0).otherwise(1))  # skipped records too
    own = records.groupBy(F.floor(F.col("seq") / size).alias("win")).agg(F.count(F.lit(1)).alias("n"), blocked.cast("bigint").alias("blocked"), F.round(F.avg("download_sec"), 6).alias("avg_download"), F.round(F.avg("embed_sec"), 6).alias("avg_embed"), F.round(failed / F.count(F.lit(1)), 6).alias("failure_rate"), F.round(F.count(F.lit(1)) / F.greatest(F.sum("download_sec"), F.lit(1e-9)), 6).alias("rate")).where(F.col("n") == size)
    before = W.orderBy("win")
    return own.withColumns({"prev_download": F.lag("avg_download").over(before), "prev_rate": F.lag("rate").over(before)})


def autotune(windows: DataFrame, initial: int, least: int, most: int) -> DataFrame:
    """win, workers after each window: a fold in order, over one row a window (factors are fixed values)."""
    clamp = lambda x: F.least(F.greatest(x, F.lit(least)), F.lit(most))
    fields = ["win", "blocked", "failure_rate", "avg_download", "avg_embed", "prev_download", "prev_rate", "rate"]
    start = F.struct(F.lit(max(least, min(most, initial))).alias("cur"), F.array().cast("array<struct<win:bigint,workers:int>>").alias("out"))

    def fold(acc, w):
        cur, first = acc["cur"], w["prev_download"].isNull()
        worse = F.coalesce((w["avg_download"] > 1.08 * w["prev_download"]) & (w["rate"] < 0.92 * w["prev_rate"]), F.lit(False))
        better = first | ((w["avg_download"] < 0.98 * w["prev_download"]) & (w["rate"] > 1.03 * w["prev_rate"]))
        starved = w["avg_download"] > F.greatest(1.25 * w["avg_embed"], F.lit(0.05))
        now = F.when(w["blocked"] > 0, clamp(cur - F.greatest(F.lit(1), w["blocked"]))).when((w["failure_rate"] > 0.25) | worse, clamp(cur - 1)).when(starved & better, clamp(cur + 1)).otherwise(clamp(cur)).cast("int")
        return F.struct(now.alias("cur"), F.concat(acc["out"], F.array(F.struct(w["win"].alias("win"), now.alias("workers")))).alias("out"))

    all_rows = windows.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("w"))
    return all_rows.select(F.inline(F.aggregate("w", start, fold)["out"]))


def retry_waits(base: float, factor: float, events: list[tuple[str, float | None]]) -> list[float]:
    """Seconds waited after each failed try: ("network", None) or (status, Retry-After seconds)."""
    delay, out = max(0.05, base), []
    for kind, after in events:
        if kind == "network":
            out.append(delay)
            delay = min(30.0, delay * factor)
            continue
        wait = max(delay, after or 0.0)
        if int(kind) in BLOCKING:
            wait = max(wait, 2.0)
        out.append(wait)
        delay = min(60.0, wait * factor)
    return out


def network_schedule(tries: DataFrame, base: float, factor: float) -> DataFrame:
    """tries (n) with the wait after the n-th network error."""
    wait = F.aggregate(F.sequence(F.lit(0), F.col("n")), F.lit(max(0.05, base)), lambda a, i: F.when(i == 0, a).otherwise(F.least(F.lit(30.0), a * factor)))
    return tries.select("n", F.round(wait, 6).alias("wait"))


def retry_after(header: Column, now: Column) -> Column:
    """Whole seconds, or seconds until an HTTP date; null if neither or not ahead."""
    seconds = F.trim(header).try_cast("bigint")
    left = (F.try_to_timestamp(F.regexp_replace(F.trim(header), r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss")).cast("double") - now.cast("double"))
    return F.when(seconds >= 0, seconds.cast("double")).when(seconds.isNull() & (left > 0), left)


def fit_size(width: Column, height: Column, side: int = LEAST_SIDE) -> Column:
    """Struct w, h, left, top of an image fitted into a square, its longer side filling it."""
    aspect = width / height
    w = F.when(width > height, F.lit(side)).otherwise(F.floor(side * aspect)).cast("bigint")
    h = F.when(width > height, F.floor(side / aspect)).otherwise(F.lit(side)).cast("bigint")
    return F.struct(w.alias("w"), h.alias("h"), F.floor((side - w) / 2).cast("bigint").alias("left"), F.floor((side - h) / 2).cast("bigint").alias("top"))

"""Quality classifier by co-training on two views of a document.

One view is the text's words, the other the page's metadata (source, language, length).  Each view's
classifier labels the unlabelled documents that it is surest of for the other view's next round; the
two are then calibrated on a fold that trained neither and their log-odds are added.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, slabs, tidied
from .wordarrays import words_of

BITS = 16
#: Bounds of the sample: labelled and unlabelled documents, drawn by a hash of the identifier.
LABELLED, UNLABELLED = 3000, 2000
ROUNDS, SURE = 3, 0.05
FOLDS, CALIBRATION = 5, 0
SLAB = 1 << 20


def text_view(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed words of each text with their share of the text's length, square-rooted."""
    w, out = words_of(texts), []
    code = (w.hash >> np.uint64(64 - BITS)).astype(np.int64)
    for first, last in zip(w.first[:-1], w.first[1:], strict=True):
        feature, times = np.unique(code[first:last], return_counts=True)
        value = np.sqrt(times)
        out.append((feature, value / max(1e-9, np.linalg.norm(value)) * 4))
    return out


def page_view(source: str | None, lang: str | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    parts = (f"s={source}", f"l={lang}", f"n={size.bit_length()}", f"h={size.bit_length()}{lang}")
    return np.array(sorted({zlib.crc32(p.encode()) & ((1 << BITS) - 1) for p in parts})), np.ones(1)


@dataclass
class Linear:
    weights: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def margin(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.array([float((self.weights[f] * v).sum()) for f, v in rows]) + self.bias if rows else np.empty(0)

    def log_odds(self, rows: list) -> np.ndarray:
        return np.clip(self.scale * self.margin(rows) + self.shift, -30, 30)


def _p(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(rows: list, y: np.ndarray, epochs: int = 8, rate: float = 0.5, decay: float = 1e-4) -> Linear:
    """Logistic regression by adaptive gradient steps; both classes weigh the same."""
    out, past, past_bias = Linear(np.zeros(1 << BITS)), np.full(1 << BITS, 1e-2), 1e-2
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    order, rng = np.arange(len(rows)), np.random.default_rng(11)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            feature, value = rows[i]
            pull = (_p(np.array([(out.weights[feature] * value).sum() + out.bias]))[0] - y[i]) * share[i]
            grad = pull * value + decay * out.weights[feature]
            past[feature] += grad * grad
            out.weights[feature] -= rate * grad / np.sqrt(past[feature])
            past_bias += pull * pull
            out.bias -= rate * pull / np.sqrt(past_bias)
    return out


def calibrate(model: Linear, rows: list, y: np.ndarray) -> None:
    """Scale and shift of the margin that make it log-odds of the fold (Newton steps, smoothed targets)."""
    m = model.margin(rows)
    if len(set(y.tolist())) < 2:
        return
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([m, np.ones_like(m)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = _p(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3
        w = w - np.linalg.solve(h, x.T @ (p - target) + np.array([1e-3 * (w[0] - 1), 0]))
    if w[0] > 0:
        model.scale, model.shift = float(w[0]), float(w[1])


def co_train(views: tuple[list, list], y: np.ndarray, fold: np.ndarray, free: tuple[list, list], rounds: int = ROUNDS, sure: float = SURE) -> tuple[Linear, Linear]:
    """views: rows of each view of the labelled documents; free: of the unlabelled ones."""
    train = fold != CALIBRATION
    if len(set(y[train].tolist())) < 2:
        train = np.ones(len(y), bool)
    known = [[v[i] for i in np.flatnonzero(train)] for v in views]
    labels = [list(y[train]), list(y[train])]
    left = np.ones(len(free[0]), bool)
    models = [fit_linear(known[k], np.array(labels[k])) for k in (0, 1)]
    for _ in range(rounds):
        take = max(1, int(sure * len(left)))
        if left.sum() < 4 * take:
            break
        for k in (0, 1):
            margin = np.where(left, models[k].margin(free[k]), np.nan)
            order = np.argsort(margin)[: int(left.sum())]
            for label, chosen in ((0, order[:take]), (1, order[-take:])):
                chosen = [i for i in chosen if (margin[i] > 0) == bool(label)]
                known[1 - k] += [free[1 - k][i] for i in chosen]
                labels[1 - k] += [label] * len(chosen)
                left[chosen] = False
        models = [fit_linear(known[k], np.array(labels[k])) for k in (0, 1)]
    check = ~train if (~train).any() else train
    for k in (0, 1):
        calibrate(models[k], [views[k][i] for i in np.flatnonzero(check)], y[check])
    return models[0], models[1]


def _sampled(rows: DataFrame, bound: int) -> list:
    """At most ``bound`` rows, those of least hash; about twice as many are looked at."""
    total = rows.count()
    every = max(1, total // (2 * bound))
    found = rows.where(F.pmod(F.col("h"), F.lit(every)) == 0).orderBy("h").limit(bound).collect()
    return found


def fit(docs: DataFrame, labels: DataFrame, good: Column, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> tuple[Linear, Linear] | None:
    """None where no label can be joined to a text."""
    named = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h"))
    marks = labels.where(good.isNotNull()).select(F.col(id_col).alias("id"), good.cast("int").alias("good")).groupBy("id").agg(F.min("good").alias("good"))
    have = {r["id"]: r["good"] for r in _sampled(named.join(marks, "id"), labelled)}
    lack = {r["id"] for r in _sampled(named.join(marks, "id", "left_anti"), unlabelled)}
    if not have:
        return None
    rows = docs.where(F.col(id_col).isin(sorted(set(have) | lack))).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang")).collect()
    rows = sorted({r["id"]: r for r in sorted(rows, key=lambda r: r["text"] or "")}.values(), key=lambda r: r["id"])

    def views(part: list) -> tuple[list, list]:
        return text_view([(r["text"] or "").encode() for r in part]), [page_view(r["source"], r["lang"], len(r["text"] or "")) for r in part]

    own, free = [r for r in rows if r["id"] in have], [r for r in rows if r["id"] not in have]
    fold = np.array([zlib.crc32(str(r["id"]).encode()) % FOLDS for r in own])
    return co_train(views(own), np.array([have[r["id"]] for r in own]), fold, views(free) if free else ([], []))


def score_quality(docs: DataFrame, models: tuple[Linear, Linear] | None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, text_score, page_score, score (all 0 to 1), keep (score of one half or more).

    Without models every score is one half and every row is kept.  A null text has no words; null
    source and language are values like others.  Rows are independent: repeated rows score alike,
    other columns are ignored, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)  # two tables of fixed size
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides: list[list] = [[], []]
            rows = zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)
            for part in slabs(rows, lambda r: len(r[0] or ""), SLAB):
                if shared.value is None:
                    odds = [np.zeros(len(part))] * 2
                else:
                    odds = [shared.value[0].log_odds(text_view([(r[0] or "").encode() for r in part])), shared.value[1].log_odds([page_view(r[1], r[2], len(r[0] or "")) for r in part])]
                for side, more in zip(sides, odds, strict=True):
                    side.append(more)
            odds = [np.concatenate(x) if x else np.empty(0) for x in sides]
            both = _p(odds[0] + odds[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in (_p(odds[0]), _p(odds[1]), both, both >= 0.5)]], names=["doc_id", "text_score", "page_score", "score", "keep"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string"), F.col(lang_col).cast("string"))
    return own.mapInArrow(tidied(run), f"doc_id {kind}, text_score double, page_score double, score double, keep boolean")


def op7_quality(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, fit(docs, labels, (F.col("quality") == 1) & (F.col("toxic") == 0)))

"""Language identification of words in code-switched text by a linear-chain conditional random field.

Each word's emission is the sum of learned weights of its byte trigrams (word borders included), its
first and last letters and itself (a hashed lexicon).  Learned transitions tie neighbours together;
forward-backward over stretches of a text gives each word's distribution, and a text's languages are
those of its words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, slabs, tidied
from .wordarrays import Words, words_of

#: Bits of the hashed feature tables: trigrams, affixes, lexicon.
BITS = {"gram": 17, "head": 15, "tail": 15, "word": 17}
#: Words of one chain; a longer text is several chains.
CHAIN = 64
#: The bound of the training sample: so many whole documents of each language.
DOCS_PER_LANGUAGE = 300
EPOCHS = 3
FOLDS, HELD = 4, 2
SLAB = 1 << 18
LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    weights: dict[str, np.ndarray]
    moves: np.ndarray
    opening: np.ndarray


def features(w: Words) -> dict[str, np.ndarray]:
    """Feature numbers: of each word, and for trigrams of each byte from the first word's border on."""
    data = np.where(w.data < 0x21, 0x20, w.data).astype(np.uint32)
    data = np.concatenate(([np.uint32(0x20)], data, np.full(3, 0x20, np.uint32)))  # byte i of the text is at i + 1
    hashed = lambda x, bits: (x * np.uint32(2654435761) >> np.uint32(32 - bits)).astype(np.int32)
    three = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    head, last = three[w.start + 1] ^ np.uint32(0x5BD1E995), three[np.maximum(w.stop - 2, 0)] ^ np.uint32(0x1B873593)
    return {"gram": hashed(three, BITS["gram"]), "head": hashed(head, BITS["head"]), "tail": hashed(last, BITS["tail"]), "word": (w.hash >> np.uint64(64 - BITS["word"])).astype(np.int32)}


def emissions(w: Words, f: dict[str, np.ndarray], model: Model) -> np.ndarray:
    # trigrams from the border before a word up to the border before the next one
    out = np.add.reduceat(model.weights["gram"][f["gram"]], w.start, axis=0) if len(w.start) else np.zeros((0, len(model.languages)), np.float32)
    for kind in ("head", "tail", "word"):
        out = out + model.weights[kind][f[kind]]
    return out


def chains(w: Words) -> tuple[np.ndarray, np.ndarray, int]:
    """Chain number and place in it of each word, and the number of chains."""
    at = np.arange(len(w.start)) - w.first[w.text]
    fresh = at % CHAIN == 0
    return np.cumsum(fresh) - 1, at % CHAIN, int(fresh.sum())


def forward_backward(scores: np.ndarray, chain: np.ndarray, place: np.ndarray, count: int, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's distribution, the expected moves and the expected openings."""
    k = scores.shape[1]
    seen = np.ones((CHAIN, count, k), np.float32)
    seen[place, chain] = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else 0
    used = np.zeros((CHAIN, count, 1), bool)
    used[place, chain] = True
    move = np.exp(model.moves).astype(np.float32)
    ahead, behind = np.empty_like(seen), np.empty_like(seen)
    now = np.exp(model.opening).astype(np.float32) * seen[0]
    for t in range(CHAIN):
        if t:
            now = np.where(used[t], now @ move * seen[t], now)
        now = now / now.sum(axis=1, keepdims=True)
        ahead[t] = now
    now, moved = np.ones((count, k), np.float32), np.zeros((k, k))
    for t in range(CHAIN - 1, -1, -1):
        behind[t] = now
        if t:
            onward = seen[t] * now
            both = used[t]
            pair = ahead[t - 1][:, :, None] * move[None] * onward[:, None, :]
            moved += np.where(both[:, :, None], pair / pair.sum(axis=(1, 2), keepdims=True), 0).sum(axis=0)
            now = np.where(both, onward @ move.T, now)
            now = now / now.sum(axis=1, keepdims=True)
    own = ahead[place, chain] * behind[place, chain]
    own = own / own.sum(axis=1, keepdims=True)
    return own, moved, own[place == 0].sum(axis=0)


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, rate: float = 0.3, batch_bytes: int = 1 << 17) -> Model:
    """Maximum likelihood by adaptive gradient steps; every word of a text has the text's label."""
    languages = sorted(set(labels))
    k = len(languages)
    model = Model(languages, {n: np.zeros((1 << b, k), np.float32) for n, b in BITS.items()}, np.eye(k) * 2, np.zeros(k))
    if k < 2:
        return model
    past = {n: np.full((1 << b, k), 1e-3, np.float32) for n, b in BITS.items()}
    past_moves, rng = np.full((k, k), 1e-3), np.random.default_rng(5)
    pairs = [(x.encode(), languages.index(y)) for x, y in zip(texts, labels, strict=True) if x]
    for _ in range(epochs):
        rng.shuffle(pairs)
        for part in slabs(pairs, lambda p: len(p[0]), batch_bytes):
            w = words_of([p[0] for p in part])
            if not len(w.start):
                continue
            f, gold = features(w), np.array([p[1] for p in part])[w.text]
            chain, place, count = chains(w)
            own, moved, _ = forward_backward(emissions(w, f, model), chain, place, count, model)
            push = -own
            push[np.arange(len(gold)), gold] += 1
            # a byte's trigram counts for the word whose border it follows
            of_byte = np.clip(np.searchsorted(w.start, np.arange(len(f["gram"])), side="right") - 1, 0, None)
            for kind in BITS:
                own_push = push[of_byte] if kind == "gram" else push
                grad = np.stack([np.bincount(f[kind], own_push[:, i], 1 << BITS[kind]) for i in range(k)], axis=1).astype(np.float32)
                past[kind] += grad * grad
                model.weights[kind] += np.float32(rate) * grad / np.sqrt(past[kind])
            steps = np.zeros((k, k))
            np.add.at(steps, (gold[1:][place[1:] > 0], gold[1:][place[1:] > 0]), 1)
            past_moves += (steps - moved) ** 2
            model.moves += rate * (steps - moved) / np.sqrt(past_moves)
    return model


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float]]:
    out, score = ["und"] * len(texts), [0.0] * len(texts)
    worth = [i for i, x in enumerate(texts) if x is not None and LETTER.search(x)] if model and model.languages else []
    if worth:
        w = words_of([texts[i].encode() for i in worth])
        chain, place, count = chains(w)
        own = forward_backward(emissions(w, features(w), model), chain, place, count, model)[0]
        share = np.stack([np.bincount(w.text, own[:, j], len(worth)) for j in range(len(model.languages))], axis=1)
        share /= share.sum(axis=1, keepdims=True)
        for i, best, x in zip(worth, share.argmax(axis=1), share.max(axis=1), strict=True):
            out[i], score[i] = model.languages[best], float(min(x, 1.0))
    return out, score


def fold(row_id: Column) -> Column:
    """crc32 of the identifier's digits, modulo the folds; null for a null identifier."""
    return F.crc32(row_id.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = DOCS_PER_LANGUAGE) -> Model | None:
    """A model of at most ``per_language`` documents of each language outside the held-out fold, drawn
    by a hash of the identifier; None where no document has both a text and a language."""
    known = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    usable = docs.where((fold(F.col(id_col)) != HELD) & known).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    # one in so many of a language's documents: about twice the sample, of which the lowest hashes stay
    every = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, max(1, n // (2 * per_language)))])
    code = F.xxhash64("id")
    drawn: dict[str, list] = {}
    for r in usable.where(F.pmod(code, every[F.col("lang")]) == 0).select("lang", "id", code.alias("h")).distinct().collect():
        drawn.setdefault(r["lang"], []).append((r["h"], r["id"]))
    wanted = {(lang, i) for lang, x in drawn.items() for _, i in sorted(x)[:per_language]}
    rows = docs.where(F.col(id_col).isin(sorted({i for _, i in wanted})) & known).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).collect()
    rows = sorted({(r["text"], r["lang"]) for r in rows if (r["lang"], r["id"]) in wanted})
    return train([r[0] for r in rows], [r[1] for r in rows])


def identify_languages(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (the share of the text's words that the language has).

    ``und`` with score 0 for null texts, texts without a letter, and without a model.  A null
    identifier is not held out.  Rows are independent; repeated rows and other columns need no care;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # a few MB, fixed by the tables' sizes
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for part in slabs(batch.column(2).to_pylist(), lambda x: len(x or ""), SLAB):
                for out, more in zip((langs, scores), predict(part, shared.value), strict=True):
                    out.extend(more)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    held = F.coalesce(fold(F.col(id_col)) == HELD, F.lit(False))
    return docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run), schema)


def accepted_languages(docs: DataFrame, model: Model | None, least_share: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with ``least_share`` of its words or
    more.  Null texts and texts without a letter go; without a model nothing stays."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good: list[bool] = []
            for part in slabs(batch.column(at).to_pylist(), lambda x: len(x or ""), SLAB):
                good += [lang != "und" and score >= least_share for lang, score in zip(*predict(part, shared.value), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)


def op10_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return identify_languages(docs, fit(docs))

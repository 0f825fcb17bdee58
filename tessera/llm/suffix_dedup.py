"""Removal of long repeated substrings by blockwise suffix sorting with a difference cover.

1. Of the suffixes that start a window of ``span`` bytes only those are sorted that can have an equal
   one: each window has a minimiser (the window's gram of least hash, the last of equal ones), equal
   windows have equal minimisers at equal places, and minimisers that occur once are dropped.  No
   repeat is lost by this.
2. A minimiser with the windows that chose it is a context.  Contexts that are equal as a whole need
   no sorting.  The others form suffix buckets by minimiser, and one bucket is sorted at a time.
3. In a bucket, suffixes are sorted by their first bytes; longer ties are resolved by the ranks of the
   cover sample, computed first by doubling over the positions of a difference cover.  Neighbours
   that agree in ``span`` bytes repeat each other.  Buckets of a few contexts skip the ranks and
   compare from the minimiser outwards; huge ones are cut by offset, and beyond a bound of memory
   their windows become rows that are counted by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, documents, shuffle_parts, slabs, tidied
from .components import sized
from .wordarrays import BACK, BYTE_VALUES, STEP, mixed, powers

SPAN = 400
GRAM = 128
SLAB = 1 << 20
#: A perfect difference set: every difference modulo COVER_STEP is one of two members (fixed values).
COVER_STEP, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Contexts of a bucket up to which it is compared directly, from which it is cut by offset, and
#: from which its windows become rows.
FEW, MANY, HUGE = 6, 512, 16384
CUTS = 8
_TIE_BITS = np.uint64(24)


def _gap() -> np.ndarray:
    """By residue: the distance to the next cover position."""
    return np.array([next(d for d in range(COVER_STEP) if (r + d) % COVER_STEP in COVER) for r in range(COVER_STEP)])


class Hashed:
    """Prefix sums of a byte string, for hashes of any substring."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers(STEP, len(data)), out=self.sums[1:])
        self.back = powers(BACK, len(data) + 1)

    def of(self, start: np.ndarray, stop: np.ndarray, seed: int = 0) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64) * np.uint64(2 * seed + 1))


def _least_of_each(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width`` values, by minima from block borders to both sides."""
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that lie one after another (``ends``: where each stops): place of each chosen
    minimiser, its first and last window, its text, and the hashes of gram and context."""
    none = tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),) * 2
    if len(data) < SPAN:
        return none
    hashed = Hashed(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = hashed.of(at, at + GRAM)
    top = (np.uint64(1) << _TIE_BITS) - np.uint64(1)
    least = _least_of_each((grams & ~top) | (top - at.astype(np.uint64)), SPAN - GRAM + 1)
    chosen = (top - (least & top)).astype(np.int64)
    start = np.arange(len(chosen))
    text = np.searchsorted(ends, start, side="right")
    fits = start + SPAN <= ends[np.minimum(text, len(ends) - 1)]
    start, chosen, text = start[fits], chosen[fits], text[fits]
    if not len(start):
        return none
    fresh = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:], [len(start)])) - 1
    place, low, high = chosen[first], start[first], start[last]
    whole = mixed(hashed.of(low, high + SPAN, 1) ^ (place - low).astype(np.uint64))
    return place, low, high, text[first], grams[place], whole


def stretches(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Texts in slabs: numbers of the texts, offsets within them, bytes and ends.  A text longer than
    a slab comes in overlapping parts that share no window."""
    parts = ((i, at) for i, text in enumerate(texts) for at in range(0, max(1, len(text) - SPAN + 1), SLAB))
    piece = lambda p: texts[p[0]][p[1] : p[1] + SLAB + SPAN - 1]
    for part in slabs(parts, lambda p: len(piece(p)), SLAB):
        own = [piece(p) for p in part]
        yield [p[0] for p in part], [p[1] for p in part], np.frombuffer(b"".join(own), np.uint8), np.cumsum([len(x) for x in own])


def _met_twice(text: np.ndarray, gram: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of occurrences of each context of each text."""
    order = np.lexsort((whole, gram, text))
    fresh = np.ones(len(order), bool)
    for k in (text, gram, whole):
        fresh[1:] &= k[order][1:] == k[order][:-1]
    fresh[1:] = ~fresh[1:]
    first = np.flatnonzero(fresh)
    return order[first], np.diff(np.concatenate((first, [len(order)])))


def facts_and_grams(docs: DataFrame) -> DataFrame:
    """Three kinds of rows: (id, size, node, digest) of documents; (gram, whole, node, place, low, high,
    times) of the distinct contexts of each text that the task hasn't met before; and (node, low, high)
    of stretches of contexts that come again in the same text, which a text of few phrases has many of."""
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, size long, node long, digest string, gram long, whole long, place long, low long, high long, times long"
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(n: int, kinds: dict, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(given[x], kinds[x]) if x in given else pa.nulls(n, kinds[x]) for x in names], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            kinds = {x: pa.int64() for x in names} | {"id": batch.column(0).type, "digest": pa.string()}
            texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
            digests = [hashlib.sha256(x).hexdigest() for x in texts]
            nodes = [int.from_bytes(bytes.fromhex(x[:16]), "little", signed=True) for x in digests]
            yield rows(batch.num_rows, kinds, id=batch.column(0), size=[len(x) for x in texts], node=nodes, digest=digests)
            fresh = []
            for text, node in zip(texts, nodes, strict=True):
                if len(text) >= SPAN and node not in met:
                    met.add(node)
                    fresh.append((text, node))
            for which, shift, data, ends in stretches([x[0] for x in fresh]):
                place, low, high, text, gram, whole = contexts(data, ends)
                if not len(place):
                    continue
                move = np.array(shift)[text] - np.concatenate(([0], ends[:-1]))[text]
                place, low, high = place + move, low + move, high + move
                owner = np.array([fresh[i][1] for i in which], np.int64)[text]
                first, times = _met_twice(text, gram, whole)
                yield rows(len(first), kinds, node=owner[first], gram=gram[first].view(np.int64), whole=whole[first].view(np.int64), place=place[first], low=low[first], high=high[first], times=times)
                if (times > 1).any():
                    twice = np.zeros(len(place), bool)
                    order = np.lexsort((whole, gram, text))
                    twice[order] = np.repeat(times > 1, times)
                    at = np.flatnonzero(twice)
                    begin = np.ones(len(at), bool)
                    begin[1:] = (text[at][1:] != text[at][:-1]) | (low[at][1:] != high[at][:-1] + 1)
                    head = at[begin]
                    last = at[np.concatenate((np.flatnonzero(begin)[1:], [len(at)])) - 1]
                    yield rows(len(head), kinds, node=owner[head], low=low[head], high=high[last])

    return docs.select("id", "text").mapInArrow(tidied(run), schema)


def _cut_contexts(docs: DataFrame, wanted: DataFrame, many: int, huge: int) -> DataFrame:
    """``wanted`` (id, node, items) to rows gram, part, node, low, place, sure, huge and the bytes; large
    buckets in parts by offset from the minimiser."""
    width = -(-(SPAN - GRAM + 1) // CUTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "part", "node", "low", "place", "sure", "huge", "body"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
        for batch in batches:
            for row in range(batch.num_rows):
                text, node = (batch.column(0)[row].as_py() or "").encode(), batch.column(1)[row].as_py()
                if int.from_bytes(hashlib.sha256(text).digest()[:8], "little", signed=True) != node:
                    continue  # a repeated identifier with another text
                out: list[tuple] = []
                for x in batch.column(2)[row].as_py():
                    cuts = [(0, x["low"], x["high"])]
                    if x["m"] > many:
                        edges = [x["place"] - (SPAN - GRAM) + width * k for k in range(CUTS + 1)]
                        cuts = [(k + 1, max(a, x["low"]), min(b - 1, x["high"])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
                    out += [(x["gram"], k, node, low, x["place"], x["sure"], x["m"] > huge, text[low : high + SPAN]) for k, low, high in cuts if low <= high]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return docs.join(wanted, "id").select("text", "node", "items").mapInArrow(tidied(run), "gram long, part int, node long, low long, place long, sure boolean, huge boolean, body binary")


def _direct(items: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """Repeats in a small bucket: (item, first window, last window), windows counted from the item's start."""
    data = [np.frombuffer(x["body"], np.uint8) for x in items]
    lead = [x["place"] - x["low"] for x in items]
    for i in range(len(items)):
        for j in range(i):
            left, right = min(lead[i], lead[j]), min(len(data[i]) - lead[i], len(data[j]) - lead[j])
            if left + right < SPAN:
                continue
            apart = np.flatnonzero(data[i][lead[i] - left : lead[i] + right] != data[j][lead[j] - left : lead[j] + right]) - left
            cut = np.searchsorted(apart, 0)
            low = apart[cut - 1] + 1 if cut else -left
            high = (apart[cut] if cut < len(apart) else right) - SPAN
            if low <= high:
                yield i, low + lead[i], high + lead[i]
                yield j, low + lead[j], high + lead[j]


def _ranked(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows, the first key first."""
    order = np.lexsort(keys[::-1])
    step = np.zeros(len(order), bool)
    for k in keys:
        own = k[order]
        step[1:] |= own[1:] != own[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(step)
    return rank


def _sorted(items: list[dict]) -> Iterator[tuple[int, int, int]]:
    """As _direct, by sorting the bucket's suffixes.  Minimisers are laid out on one residue, so the
    suffixes that can be equal have one distance to the cover."""
    v, base, size = COVER_STEP, [], 0
    for x in items:
        lead = x["place"] - x["low"]
        base.append(size + (-(size + lead)) % v)
        size = base[-1] + len(x["body"])
    text = np.zeros(size + 3 * SPAN, np.uint8)
    for x, b in zip(items, base, strict=True):
        text[b : b + len(x["body"])] = np.frombuffer(x["body"], np.uint8)
    word = np.ndarray((len(text) - 7,), ">u8", text.data, strides=(1,))
    head = lambda at: [word[at + k].astype(np.uint64) for k in (0, 8, 16, v - 8)]
    # ranks of the cover sample, doubled until they tell more than SPAN bytes apart
    residue = np.arange(len(text)) % v
    sample = np.flatnonzero(np.isin(residue, COVER)[: size + SPAN])
    rank = np.zeros(len(text), np.int64)
    rank[sample] = _ranked(head(sample)) + 1
    depth = v
    while depth < SPAN:
        rank[sample] = _ranked([rank[sample], rank[np.minimum(sample + depth, len(text) - 1)]]) + 1
        depth *= 2
    windows = [len(x["body"]) - SPAN + 1 for x in items]
    owner = np.repeat(np.arange(len(items)), windows)
    within = np.concatenate([np.arange(n) for n in windows])
    at = np.array(base)[owner] + within
    offset = within - np.array([x["place"] - x["low"] for x in items])[owner]
    keys = [offset, *head(at), rank[at + _gap()[at % v]]]
    order = np.lexsort(keys[::-1])
    near = offset[order][1:] == offset[order][:-1]
    pair = np.flatnonzero(near)
    for k in range(0, SPAN, 8):
        a, b = at[order[pair]] + k, at[order[pair + 1]] + k
        pair = pair[word[a] == word[b]]
    hit = np.zeros(len(at), bool)
    hit[order[pair]] = hit[order[pair + 1]] = True
    found = np.flatnonzero(hit)
    if len(found):
        fresh = np.concatenate(([True], (np.diff(found) > 1) | (owner[found][1:] != owner[found][:-1])))
        first = found[fresh]
        last = found[np.concatenate((np.flatnonzero(fresh)[1:], [len(found)])) - 1]
        for a, b in zip(first, last, strict=True):
            yield owner[a], within[a], within[b]


def repeats_in_buckets(cut: DataFrame, few: int) -> DataFrame:
    """(node, start, stop) of removed bytes, from contexts whose bucket is in one task."""

    def solved(items: list[dict]) -> list[tuple]:
        pairs = (_direct if len(items) <= few else _sorted)(items) if len(items) > 1 else ()
        return [(items[i]["node"], items[i]["low"] + int(a), items[i]["low"] + int(b) + SPAN) for i, a, b in pairs if not items[i]["sure"]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["node", "start", "stop"])

        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                for x in batch.slice(first, 2048).to_pylist():
                    if (x["gram"], x["part"]) != key:
                        out += solved(held)
                        key, held = (x["gram"], x["part"]), []
                    held.append(x)
                yield table()
                out = []
        out += solved(held)
        yield table()

    spark = cut.sparkSession
    dealt = cut.select("gram", "part", "node", "low", "place", "sure", "body").repartition(shuffle_parts(spark), "gram", "part").sortWithinPartitions("gram", "part")
    return dealt.mapInArrow(tidied(run), "node long, start long, stop long")


def repeats_by_digest(cut: DataFrame, scratch: Scratch) -> DataFrame:
    """As repeats_in_buckets, for buckets beyond a task's memory: a row for each window."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                data = np.frombuffer(x["body"], np.uint8)
                at, hashed = np.arange(len(data) - SPAN + 1), Hashed(data)
                two = [pa.array(hashed.of(at, at + SPAN, seed).view(np.int64)) for seed in (3, 4)]
                yield pa.RecordBatch.from_arrays([*two, pa.array(np.full(len(at), x["node"])), pa.array(at + x["low"]), pa.array(np.full(len(at), x["sure"]))], names=["h1", "h2", "node", "start", "sure"])

    rows = scratch.keep(cut.select("node", "low", "sure", "body").mapInArrow(tidied(run), "h1 long, h2 long, node long, start long, sure boolean"), "windows")
    often = scratch.keep(rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"), "often")
    return rows.where("not sure").join(sized(often), ["h1", "h2"]).select("node", "start", (F.col("start") + SPAN).alias("stop"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", few: int = FEW, many: int = MANY, huge: int = HUGE, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``text``, what is left, where half a character becomes U+FFFD, if ``with_text``).

    Null text counts as empty.  Texts shorter than the span stay as they are.  A text of the span's
    length or more that two rows have is removed whole from both, repeated rows included.  Texts are
    known by 64 bits of their SHA-256, contexts by 128 bits.  Null identifiers are kept in the result,
    but only texts with an identifier take part in matching by parts.  Other columns are ignored; an
    empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = scratch.keep(facts_and_grams(own), "facts")
    facts = rows.where(F.col("size").isNotNull()).select("id", "size", "node", "digest")
    seen = rows.where(F.col("gram").isNotNull()).select("gram", "whole", "node", "place", "low", "high", "times")
    again = scratch.keep(seen.groupBy("gram").agg(F.sum("times").alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b")).where("n > 1").select("gram", (F.col("a") != F.col("b")).alias("mixed")), "again")
    open_ = scratch.keep(seen.join(again, "gram"), "open")
    scratch.drop(again)
    wholes = open_.groupBy("gram", "whole").agg(F.sum("times").alias("n"), F.min(F.struct("node", "place", "low", "high")).alias("one"), F.first("mixed").alias("mixed"))
    wholes = scratch.keep(wholes.where("mixed or n > 1"), "wholes")
    equal = open_.join(wholes.where("n > 1").select("gram", "whole"), ["gram", "whole"]).select("node", F.col("low").alias("start"), (F.col("high") + SPAN).alias("stop"))
    within = rows.where(F.col("gram").isNull() & F.col("size").isNull()).select("node", F.col("low").alias("start"), (F.col("high") + SPAN).alias("stop"))
    buckets = scratch.keep(wholes.where("mixed").groupBy("gram").agg(F.count(F.lit(1)).alias("m")), "buckets")
    texts = scratch.keep(facts.where(f"size >= {SPAN}").groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("digest").alias("digest")), "texts")
    items = wholes.where("mixed").join(buckets, "gram").select("one.node", F.struct("gram", F.col("one.place").alias("place"), F.col("one.low").alias("low"), F.col("one.high").alias("high"), (F.col("n") > 1).alias("sure"), "m").alias("item"))
    # as many items as the text has contexts
    wanted = scratch.keep(items.groupBy("node").agg(F.collect_list("item").alias("items")).join(texts, "node").select("id", "node", "items"), "wanted")
    cut = scratch.keep(_cut_contexts(own, sized(wanted), many, huge), "cut")
    scratch.drop(wanted)
    found = repeats_in_buckets(cut.where("not huge"), few).unionByName(equal).unionByName(within)
    if not cut.where("huge").isEmpty():
        found = found.unionByName(repeats_by_digest(cut.where("huge"), scratch))
    covers = found.groupBy("node").agg(F.collect_list(F.struct("start", "stop")).alias("covers")).join(texts.where("copies = 1"), "node").select("digest", "covers")
    zero = F.lit(0).cast("long").alias("start")
    covers = scratch.keep(covers.unionByName(texts.where("copies > 1").select("digest", F.array(F.struct(zero, F.col("size").alias("stop"))).alias("covers"))), "covers")
    scratch.drop(cut, open_, wholes, buckets, rows)
    kind = own.schema["id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["text"] * with_text]

    def cut_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [batches_kind, pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * with_text]
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch, out = whole.slice(first, 512), []
                for i, text, digest, spans in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                    data = (text or "").encode()
                    kept, at, runs, stop = [], 0, 0, -1
                    for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
                        if a > stop:
                            runs += 1
                            kept.append(data[at:a])
                        stop = at = max(stop, b)
                    left = b"".join([*kept, data[at:]])
                    row = (i, len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest() if runs else digest)
                    out.append((*row, left.decode(errors="replace")) if with_text else row)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    batches_kind = to_arrow_type(own.schema["id"].dataType)
    # joined by the digest of the whole text, so copies, repeated and null identifiers need no care
    digested = own.select("id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).join(sized(covers), "digest", "left")
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{', text string' if with_text else ''}"
    return digested.select("id", "text", "digest", "covers").mapInArrow(tidied(cut_out), schema)


def op1_suffix_dedup(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir), with_text=True)

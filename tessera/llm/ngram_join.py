"""N-gram Jaccard join: rare-first prefix filtering, each candidate pair verified once.

Equal n-gram sets are one node from the start, so copies cost nothing.  N-grams are ordered rare
first; two sets that are similar enough share one of their first few n-grams.  Within the nodes of one
such n-gram, one node (the centre) is paired with all others, under length and positional filters;
pairs are verified after a suffix filter.  Nodes that are known to be connected need no further
pairs, so a list of m similar texts costs m pairs, not m * m.  Where a list then has several components,
the same prefix filter runs once more on what nodes have that the centre hasn't, or lack: related
texts that are not similar share nearly all their n-grams, but few of their differences.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, documents, shuffle_parts, slabs, tidied
from .components import connected_components, sized
from .wordarrays import mixed, ngram_hashes, words_of

SLAB = 1 << 18
#: An n-gram with at least one in this many of all n-gram counts is common; so there are at most as many.
COMMON = 1 << 19
#: N-grams of a task's documents that are counted at once.
STRETCH = 1 << 19
#: Rows of one n-gram that a task holds; rarer ones are ordered by their exact count, all others last.
MOST_TIMES = 1 << 18
#: Rows of an Arrow batch that hold whole sets.
WIDE_ROWS = 250
#: Slices of hash space that the suffix filter compares.
SLICES = 16


def ngram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams; of all its words where there are fewer."""
    w = words_of(texts)
    grams, out = ngram_hashes(w.hash, n), []
    for first, last in zip(w.first[:-1], w.first[1:], strict=True):
        if last - first >= n:
            out.append(np.unique(grams[first : last - n + 1]))
        elif last > first:
            out.append(mixed(ngram_hashes(w.hash[first:last], int(last - first)) ^ np.uint64(last - first)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(grams: np.ndarray) -> int:
    return int(mixed(np.array([mixed(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum() + np.uint64(len(grams))], np.uint64)).view(np.int64)[0])


def least_overlap(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def rare_first(grams: np.ndarray, common: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """Uncommon n-grams by hash, then common ones from the less common to the most common; and how
    many are uncommon."""
    if not len(common):
        return grams, len(grams)
    at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
    hit = common[at] == grams
    if not hit.any():
        return grams, len(grams)
    return np.concatenate((grams[~hit], grams[hit][np.argsort(rank[at[hit]], kind="stable")])), int((~hit).sum())


def _sized_texts(batch: pa.RecordBatch, column: int) -> Iterator[list[tuple[int, bytes]]]:
    values = enumerate((x or "").encode() for x in batch.column(column).to_pylist())
    yield from slabs(values, lambda x: len(x[1]), SLAB)


def described(docs: DataFrame, n: int) -> DataFrame:
    """Two kinds of rows: (id, size, node) of each document, and (gram, times) of n-grams that come
    more than once in a stretch of a task's documents; what comes once there isn't common."""
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), *[T.StructField(c, T.LongType()) for c in ("size", "node", "gram", "times")]])
    id_kind = None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def counted() -> pa.RecordBatch:
            gram, times = np.unique(np.concatenate(held), return_counts=True)
            gram, times = gram[times > 1], times[times > 1]
            none = pa.nulls(len(gram), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(gram), id_kind), none, none, pa.array(gram.view(np.int64)), pa.array(times.astype(np.int64))], names=schema.names)

        for batch in batches:
            id_kind = batch.column(0).type
            size, node = [], []
            for part in _sized_texts(batch, 1):
                for grams in ngram_sets([x[1] for x in part], n):
                    size.append(len(grams))
                    node.append(signature(grams))
                    held.append(grams)
                    total += len(grams)
                if total > STRETCH:
                    yield counted()
                    held, total = [], 0
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(node, pa.int64()), none, none], names=schema.names)
        if held:
            yield counted()

    return docs.select("id", "text").mapInArrow(tidied(run), schema)


def looked_at(percent: int) -> int:
    """Hashes below this bound are counted exactly: enough of them that a text of mostly unshared
    n-grams has its whole prefix among those that nobody shares."""
    return int(min(1.0, 1.3 * (1 - percent / 100) + 0.02) * ((1 << 64) - 1))


def offered(docs: DataFrame, n: int, percent: int, common) -> DataFrame:
    """(gram, node, size, low, nth) for each distinct set: its uncommon n-grams with a hash below the
    bound (``low`` of them, ``nth`` null), and where those are fewer than the prefix needs, the next
    ones in order with their place ``nth``.  Sets that a task has already met are left out; the same
    node of another task gives equal rows."""
    bound = looked_at(percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = common.value
        met: set[int] = set()
        for batch in batches:
            for part in _sized_texts(batch, 0):
                out: list[tuple] = []
                for grams in ngram_sets([x[1] for x in part], n):
                    node = signature(grams)
                    if not len(grams) or node in met:
                        continue
                    met.add(node)
                    own, uncommon = rare_first(grams, known, rank)
                    low = int(np.searchsorted(own[:uncommon], np.uint64(bound), side="right"))
                    need = max(low, len(grams) - least_overlap(len(grams), percent) + 1)
                    place = np.arange(need)
                    out.append((own[:need].view(np.int64), np.full(need, node), np.full(need, len(grams), np.int32), np.full(need, low, np.int32), np.where(place < low, -1, place).astype(np.int32)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["gram", "node", "size", "low", "nth"])

    return docs.select("text").mapInArrow(tidied(run), "gram long, node long, size int, low int, nth int")


def shared_grams(rows: DataFrame) -> DataFrame:
    """The rows of n-grams that two nodes or more offer, each once, with the number of nodes (times).

    Rows are dealt and sorted by n-gram and node.  A task holds MOST_TIMES rows of one n-gram at most: with
    as many the count stops and its rows go straight through, as it only orders n-grams."""
    most = MOST_TIMES

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows without repeats, of which those of the last n-gram may go on
        rows = 0
        last: tuple[int, int] | None = None
        through: int | None = None  # an n-gram of which MOST_TIMES rows have gone

        def counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
            _, group, times = np.unique(table.column(0).to_numpy(), return_inverse=True, return_counts=True)
            many = times[group] > 1
            out = table.filter(pa.array(many)).append_column("times", pa.array(np.minimum(times[group][many], most)))
            yield from out.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            gram, node = (batch.column(c).to_numpy() for c in (0, 1))
            fresh = np.ones(len(gram), bool)
            fresh[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
            fresh[0] = last != (gram[0], node[0])
            last = gram[-1], node[-1]
            batch = batch.filter(pa.array(fresh))
            gram = gram[fresh]
            if through is not None:
                at = int(np.searchsorted(gram, through, side="right"))
                if at:
                    yield from pa.Table.from_batches([batch.slice(0, at)]).append_column("times", pa.array(np.full(at, most))).to_batches()
                if at == len(gram):
                    continue
                through, batch, gram = None, batch.slice(at), gram[at:]
            elif not len(gram):
                continue
            at = int(np.searchsorted(gram, gram[-1]))
            if at or (held and held[-1].column(0)[0].as_py() != gram[-1]):
                yield from counted(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held, rows = [], 0
            held.append(batch.slice(at))
            rows += batch.num_rows - at
            if rows >= most:
                yield from counted(pa.Table.from_batches(held))
                held, rows, through = [], 0, int(gram[-1])
        if held:
            yield from counted(pa.Table.from_batches(held))

    dealt = rows.repartition(shuffle_parts(rows.sparkSession), "gram").sortWithinPartitions("gram", "node")
    return dealt.mapInArrow(tidied(run), "gram long, node long, size int, low int, nth int, times long")


def prefixes(docs: DataFrame, n: int, percent: int, common) -> DataFrame:
    """(gram, node, place, size): the shared part of each set's rare-first prefix.

    In the order of all n-grams those that nobody shares come first and fill a prefix without giving
    a partner; then shared ones, the rarest first; then those beyond the bound and the common ones."""
    shared = shared_grams(offered(docs, n, percent, common))
    of_node = W.partitionBy("node")
    counted = F.col("nth") < 0
    alone = F.col("low") - F.sum(counted.cast("int")).over(of_node)
    ranked = shared.select("*", alone.alias("alone"), F.row_number().over(of_node.orderBy("nth", "times", "gram")).alias("rank"))
    place = F.when(counted, F.col("alone") + F.col("rank") - 1).otherwise(F.col("nth")).cast("int")
    length = F.col("size") - F.ceil(F.lit(percent) * F.col("size") / 100) + 1
    return ranked.select("gram", "node", place.alias("place"), "size").where(F.col("place") < length)


def _may_link(percent: int, x: str, y: str) -> Column:
    """Length filter, and the positional filter of a shared n-gram: at most min(places) are shared
    before it and min(rests) after it."""
    size = [F.col(f"{c}_size") for c in (x, y)]
    place = [F.col(f"{c}_place") for c in (x, y)]
    most = F.least(*place) + 1 + F.least(*[s - p - 1 for s, p in zip(size, place, strict=True)])
    return (100 * F.least(*size) >= percent * F.greatest(*size)) & ((100 + percent) * most >= percent * (size[0] + size[1]))


def _pairs(lists: DataFrame, percent: int) -> DataFrame:
    """lists: gram, node, place, size, and the list's centre (c_node, c_place, c_size); to (a, b), of which a is a centre."""
    own = lists.select("c_node", "c_place", "c_size", *[F.col(c).alias(f"x_{c}") for c in ("node", "place", "size")])
    return own.where((F.col("x_node") != F.col("c_node")) & _may_link(percent, "c", "x")).groupBy(F.least("c_node", "x_node").alias("l"), F.greatest("c_node", "x_node").alias("g")).agg(F.min("c_node").alias("a")).select("a", F.when(F.col("a") == F.col("l"), F.col("g")).otherwise(F.col("l")).alias("b"))


Sets = tuple[DataFrame, DataFrame]


def with_sets(pairs: DataFrame, sets: Sets, many: str, each: str, scratch: Scratch) -> DataFrame:
    """``pairs`` (a written table) with the sets of both nodes (``<name>_grams``).  A node of ``many`` may be in a
    large part of the pairs, so that is a join the engine can split; the other one reads sets where they lie."""
    own, plain = sets
    named = lambda rows, c: rows.select(F.col("node").alias(c), F.col("grams").alias(f"{c}_grams"))
    some = scratch.keep(pairs.select(F.col(many).alias("node")).distinct(), "some")
    return pairs.join(named(own, each), each).join(named(plain.join(sized(some), "node", "left_semi"), many), many)


def differences(members: DataFrame, sets: Sets, scratch: Scratch) -> DataFrame:
    """members (c_node, node, component, minor) to one row per n-gram that only one of the node and
    its centre has: ``key`` is the hash of centre and n-gram, ``apart`` the number of them."""
    names = ["c_node", "node", "component", "minor"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(5)]
            seed = mixed(batch.column(0).to_numpy().view(np.uint64) ^ np.uint64(0x5A5A5A5A5A5A5A5A))
            found = [np.setxor1d(np.frombuffer(c.as_buffer(), np.uint64), x, assume_unique=True) for c, x in zip(batch.column(4), own, strict=True)]
            times = np.fromiter(map(len, found), np.int32, len(found))
            at = np.repeat(np.arange(batch.num_rows), times)
            key = mixed(np.concatenate(found) ^ seed[at]).view(np.int64) if found else np.empty(0, np.int64)
            size = np.array([len(x) for x in own], np.int32)
            facts = batch.select([0, 1, 2, 3]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(key), *facts.columns, pa.array(size[at]), pa.array(times[at])], names=["key", *names, "size", "apart"])

    whole = with_sets(members, sets, "c_node", "node", scratch).select(*names, "c_node_grams", "node_grams")
    return whole.mapInArrow(tidied(run), "key long, c_node long, node long, component long, minor boolean, size int, apart int")


def difference_pairs(members: DataFrame, sets: Sets, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of one centre's nodes in different components that may still be similar.

    Of sets x and y with differences X and Y from the centre, |x n y| grows with |X n Y|:
    2 (100 + percent) |X n Y| >= far(x) + far(y), where far(x) = (100 + percent) |X| - (100 - percent) |x|.
    Of such a pair one node at least (``minor``) is outside the centre's component, so not similar to it,
    which makes the right side positive.  Hence differences take the place of n-grams: those of one node
    alone give no partner, the others are ordered rare first, and pairs join on prefixes under
    length and positional filters.  Copies that were edited apart from each other share few."""
    q, r = 100 + percent, 100 - percent
    rows = scratch.keep(differences(members, sets, scratch), "apart", WIDE_ROWS)
    far = (F.col("apart").cast("long") * q - F.col("size").cast("long") * r).alias("far")
    least = rows.select("c_node", "minor", far).groupBy("c_node").agg(F.min(F.when(F.col("minor"), F.col("far"))).alias("out"), F.min(F.when(~F.col("minor"), F.col("far"))).alias("main"))
    bound = F.ceil((F.col("far") + F.when(F.col("minor"), F.least("out", "main")).otherwise(F.col("out"))) / (2 * q))
    least = sized(scratch.keep(least.where("out is not null"), "least"))
    times = rows.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = rows.select("*", far).join(times, "key").join(least, "c_node").select("*", bound.alias("bound")).drop("out", "main", "apart")
    of_node = W.partitionBy("c_node", "node")
    ranked = shared.select("*", F.count(F.lit(1)).over(of_node).alias("held"), F.row_number().over(of_node.orderBy("times", "key")).alias("rank"))
    posted = scratch.keep(ranked.where("rank <= held - greatest(bound, 1) + 1").drop("times", "bound", "c_node"), "posted")
    x, y = (posted.select("key", *[F.col(c).alias(f"{p}_{c}") for c in posted.columns if c != "key"]) for p in ("x", "y"))
    most = F.least("x_rank", "y_rank") + F.least(F.col("x_held") - F.col("x_rank"), F.col("y_held") - F.col("y_rank"))
    once = (F.col("x_node") < F.col("y_node")) & (F.col("x_component") != F.col("y_component")) & (F.col("x_minor") | F.col("y_minor"))
    near = (2 * q * most >= F.col("x_far") + F.col("y_far")) & (100 * F.least("x_size", "y_size") >= percent * F.greatest("x_size", "y_size"))
    return scratch.keep(x.join(y, "key").where(once & near).select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct(), "pairs")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Suffix filter, then the whole overlap.  Both are sorted."""
    need = -(-percent * (len(x) + len(y)) // (100 + percent))
    cuts = np.arange(1, SLICES, dtype=np.uint64) << np.uint64(60)
    slices = [np.diff(np.concatenate(([0], np.searchsorted(s, cuts), [len(s)]))) for s in (x, y)]
    if np.minimum(*slices).sum() < need:  # no slice can share more than the smaller part
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


def verified(pairs: DataFrame, sets: Sets, percent: int, scratch: Scratch) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.filter(pa.array(kept, pa.bool_())).select([0, 1])

    return with_sets(pairs, sets, "a", "b", scratch).select("a", "b", "a_grams", "b_grams").mapInArrow(tidied(run), "a long, b long")


def _sets_of(docs: DataFrame, nodes: DataFrame, n: int, scratch: Scratch) -> Sets:
    """(node, grams) of the nodes in ``nodes`` (node, id), by one document of each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _sized_texts(batch, 1):
                sets = ngram_sets([x[1] for x in part], n)
                at = pa.array([x[0] for x in part], pa.int64())
                # of repeated identifiers with other texts, only the text of this node counts
                good = pa.array([signature(s) == v for s, v in zip(sets, batch.column(0).take(at).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "grams"]).filter(good)

    held = docs.join(sized(nodes), "id").select("node", "text").mapInArrow(tidied(run), "node long, grams binary")
    return scratch.keep_by(held, "node", "sets")


def similarity_links(docs: DataFrame, n: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """docs (id, text) to (facts: id, size, node; labels: node, component of every linked node)."""
    spark = docs.sparkSession
    rows = scratch.keep(described(docs, n), "described", 2000)
    facts = rows.where(F.col("size").isNotNull()).select("id", "size", "node")
    total = rows.agg(F.sum("size")).first()[0] or 0
    grams = rows.where(F.col("gram").isNotNull()).groupBy("gram").agg(F.sum("times").alias("times")).where(F.col("times") >= max(8, total // COMMON))
    heavy = sorted((r["gram"] & ((1 << 64) - 1), r["times"]) for r in grams.collect())  # COMMON rows at most
    common = spark.sparkContext.broadcast((np.array([h[0] for h in heavy], np.uint64), np.array([h[1] for h in heavy], np.int64)))
    posted = scratch.keep(prefixes(docs, n, percent, common), "prefixes")
    # the node with the fewest unshared n-grams before this one: of edited copies, the original
    entry = F.struct("place", "node", "size")
    lists = posted.groupBy("gram").agg(F.min(entry).alias("c"), F.min("node").alias("low"), F.max("node").alias("top")).where("low <> top")
    lists = scratch.keep(lists.select("gram", *[F.col(f"c.{c}").alias(f"c_{c}") for c in ("node", "place", "size")]), "lists")
    open_lists = scratch.keep(posted.join(lists, "gram").select("gram", "node", "place", "size", "c_node", "c_place", "c_size").distinct(), "open")
    scratch.drop(posted, lists)
    nodes = facts.groupBy("node").agg(F.min("id").alias("id"))
    wanted = scratch.keep(nodes.join(open_lists.select("node").distinct(), "node", "left_semi"), "wanted")
    sets = _sets_of(docs, wanted, n, scratch)
    scratch.drop(wanted)
    links = scratch.keep(verified(scratch.keep(_pairs(open_lists, percent), "pairs"), sets, percent, scratch), "links", WIDE_ROWS)
    labels = connected_components(links, scratch)
    # centres are done with; what is left are pairs in lists that still have several components
    tagged = open_lists.join(sized(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))
    tagged = scratch.keep(tagged, "tagged")
    apart = tagged.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("top")).where("low <> top").select("gram")
    members = tagged.join(sized(scratch.keep(apart, "apart")), "gram").where("node <> c_node").select("c_node", "node", "component").distinct()
    own = labels.select(F.col("node").alias("c_node"), F.col("component").alias("c_of"))
    members = members.join(sized(scratch.keep(own, "labels")), "c_node", "left").withColumn("minor", F.col("component") != F.coalesce("c_of", "c_node")).drop("c_of")
    pairs = difference_pairs(scratch.keep(members, "members"), sets, percent, scratch)
    scratch.drop(tagged, open_lists)
    fresh = scratch.keep(verified(pairs, sets, percent, scratch), "links", WIDE_ROWS)
    scratch.drop(sets[0])
    label = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_of"))
    between = fresh.join(sized(scratch.keep(label("a"), "labels")), "a", "left").join(sized(scratch.keep(label("b"), "labels")), "b", "left")
    joined = connected_components(between.select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")), scratch)
    # a component is named by its least node, so the name moves with it
    new = joined.select(F.col("node").alias("component"), F.col("component").alias("now"))
    moved = labels.join(sized(scratch.keep(new, "moved")), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    labels = scratch.keep(moved.unionByName(joined.select("node", "component")).distinct(), "labels")
    return facts, labels


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are runs of characters other than white space, A-Z in lower case; a text of fewer than
    ``n`` words is one n-gram; null texts and texts without words have none and are linked with
    nothing.  Sets are compared by 64-bit hashes of n-grams.  component_id is the least identifier
    reachable, null only for rows with a null identifier that are linked with no other.  Repeated
    rows are linked with each other; other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    facts, labels = similarity_links(own, n, percent, scratch)
    some = facts.where("size > 0")
    nodes = some.groupBy("node").agg(F.min("id").alias("low")).join(sized(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = scratch.keep(nodes, "nodes")
    least = scratch.keep(nodes.groupBy("component").agg(F.min("low").alias("component_id")), "least")
    final = scratch.keep(nodes.join(sized(least), "component").select("node", "component_id"), "final")
    linked = some.join(sized(final), "node").select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id")
    empty = facts.where("size = 0").select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("id").alias("component_id"))
    return linked.unionByName(empty)


def op2_ngram_join(spark, sf_dir):
    return ngram_components(documents(spark, sf_dir), n=4, percent=85)

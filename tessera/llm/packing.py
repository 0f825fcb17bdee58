"""Best-fit packing of token pieces by linear grouping.

Only the histogram of piece lengths (one row per length, so at most ``capacity`` rows) reaches the
driver.  There the large lengths are rounded up within groups of equal cardinality, the few rounded
lengths are packed by configurations (a linear programme solved by column generation), actual
lengths take the places of the rounded ones, and what is left is placed best-fit, longest first.
The plan speaks of runs of equal pieces ("pieces 40 to 90 of length 812 go to sequences 7 to 57 at
offset 1024"), so it is as short for a hundred billion pieces as for a thousand.  Executors then
number the pieces of each length and look their places up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, documents, shuffle_parts, tidied
from .word_pieces import word_ids

CAPACITY = 2048
#: Settings that are tried, of which the plan with the fewest sequences counts: the share of the
#: capacity from which a length is large, and the groups of large lengths.
SETTINGS = ((1 / 3, 256), (1 / 4, 256), (1 / 2, 32), (1 / 8, 64))


def grouped(histogram: dict[int, int], groups: int, floor: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of about equal cardinality: (rounded length, [(length, count), longest first])."""
    large = sorted(((s, n) for s, n in histogram.items() if s >= floor), reverse=True)
    share = max(1, -(-sum(n for _, n in large) // groups))
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for s, n in large:
        while n:
            if not room:
                out.append((s, []))
                room = share
            take = min(n, room)
            out[-1][1].append((s, take))
            n, room = n - take, room - take
    merged: list[tuple[int, list[tuple[int, int]]]] = []
    for top, members in out:  # groups with one rounded length are one
        if merged and merged[-1][0] == top:
            merged[-1][1].extend(members)
        else:
            merged.append((top, members))
    return merged


def _best_column(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of lengths that fits (unbounded knapsack)."""
    own = np.array(sizes)
    # shifted by the longest length, so that lengths that do not fit are worth nothing
    shift = int(own.max())
    best, pick = np.full(capacity + 1 + shift, -np.inf), np.full(capacity + 1, -1)
    best[shift] = 0
    for c in range(1, capacity + 1):
        found = best[c + shift - own] + worth
        k = int(found.argmax())
        if found[k] > best[c + shift - 1] + 1e-12:
            best[c + shift], pick[c] = found[k], k
        else:
            best[c + shift] = best[c + shift - 1]
    column, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            column[pick[c]] += 1
            c -= sizes[pick[c]]
    return best[-1], column


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 200) -> list[tuple[np.ndarray, int]]:
    """Configurations with whole multiplicities (rounded down) that use the fewest sequences."""
    if not sizes:
        return []
    # sums and products of whole arrays only: BLAS threads may block beside a JVM
    need, start = np.array(counts, float), [capacity // s for s in sizes]
    basis, inverse = np.diag(np.array(start, float)), np.diag(1 / np.array(start, float))
    level = inverse.diagonal() * need
    for _ in range(rounds):
        value, column = _best_column(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-9:
            break
        move = (inverse * column).sum(axis=1)
        ratio = np.where(move > 1e-9, level / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        # one column of the basis changes, so one row operation brings its inverse up to date
        basis[:, out] = column
        pivot = inverse[out] / move[out]
        inverse -= move[:, None] * pivot
        inverse[out] = pivot
        level = np.maximum((inverse * need).sum(axis=1), 0)
    return [(basis[:, k], int(level[k] + 1e-9)) for k in range(len(sizes)) if level[k] + 1e-9 >= 1]


class _Shelf:
    """Sequences by free room, in runs of consecutive numbers."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []

    def put(self, room: int, first: int, count: int) -> None:
        if not self.runs[room]:
            insort(self.rooms, room)
        self.runs[room].append((first, count))

    def take(self, size: int, most: int) -> tuple[int, int, int] | None:
        """Up to ``most`` sequences of the least room that holds ``size``: (room, first, count)."""
        at = bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, count = self.runs[room].pop()
        if count > most:
            self.runs[room].append((first + most, count - most))
        elif not self.runs[room]:
            self.rooms.pop(at)
        return room, first, min(count, most)


Plan = list[tuple[int, int, int, int, int]]


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, settings: tuple = SETTINGS) -> Plan:
    """(length, first rank, count, first sequence, offset): ranks run from 0 within a length."""
    total, least = sum(s * n for s, n in histogram.items()), None
    for large, groups in settings:
        plan = _plan(histogram, capacity, large, groups)
        used = max((first + n for _, _, n, first, _ in plan), default=0)
        if least is None or used < least[0]:
            least = used, plan
        if used <= -(-total // capacity):
            break
    return least[1]


def _plan(histogram: dict[int, int], capacity: int, large: float, groups: int) -> Plan:
    plan: Plan = []
    used: dict[int, int] = defaultdict(int)
    shelf, sequences = _Shelf(), 0

    def place(size: int, count: int, first: int, offset: int) -> None:
        plan.append((size, used[size], count, first, offset))
        used[size] += count

    families = grouped(histogram, groups, max(1, int(capacity * large)))
    waiting = [[list(m) for m in members] for _, members in families]
    for column, times in configurations([top for top, _ in families], [sum(n for _, n in m) for _, m in families], capacity):
        runs = [(sequences, times, 0)]  # of sequences that hold the same lengths so far: first, count, filled
        sequences += times
        for family, copies in enumerate(column.round().astype(int)):
            for _ in range(copies):
                after = []
                for first, count, filled in runs:
                    while count and waiting[family]:
                        member = waiting[family][0]
                        n = min(count, member[1])
                        place(member[0], n, first, filled)
                        after.append((first, n, filled + member[0]))
                        first, count, member[1] = first + n, count - n, member[1] - n
                        if not member[1]:
                            waiting[family].pop(0)
                    if count:
                        after.append((first, count, filled))
                runs = after
        for first, count, filled in runs:
            shelf.put(capacity - filled, first, count)
    left = {s: n - used[s] for s, n in histogram.items() if n > used[s]}
    for size in sorted(left, reverse=True):
        count = left[size]
        while count:
            got = shelf.take(size, count)
            if got is None:
                # as many new sequences as whole fillings need, the last one perhaps partly filled
                each = capacity // size
                got = (capacity, sequences, -(-count // each))
                sequences += got[2]
            room, first, n = got
            place(size, n, first, capacity - room)
            shelf.put(room - size, first, n)
            count -= n
    return plan


def cut(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    for start in range(0, length, capacity):
        yield start, min(capacity, length - start)


def token_pieces(docs: DataFrame, encode: Callable[[list[str]], list[bytes]], id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids``) of each piece of each document."""
    plain = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *[T.StructField(*x) for x in plain], *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                row, piece, starts, lengths, sums, held = [], [], [], [], [], []
                for at, ids in enumerate(encode([x or "" for x in batch.column(1).to_pylist()])):
                    ids += end
                    for number, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        for column, x in ((row, at), (piece, number), (starts, start), (lengths, length), (sums, zlib.crc32(own))):
                            column.append(x)
                        if with_ids:
                            held.append(memoryview(own).cast("I").tolist())
                arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (starts, lengths, sums)]]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(held, pa.list_(pa.int32()))] * with_ids, names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(tidied(run), schema)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, shards: int | None = None) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset.

    ``pieces`` must be a written table, as it is read twice.  Pieces of a length are numbered in
    ``shards`` hash shards, whose counts are then summed, so no length is dealt to one task.  Equal
    rows (repeated documents) may swap places; nothing else depends on order.
    """
    spark = pieces.sparkSession
    n = shards or 4 * shuffle_parts(spark)
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)).cast("int"))
    sizes = sharded.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    plan = plan_packing(histogram, capacity)
    #: bounded: lengths x shards, and the plan's runs
    offsets = sizes.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))).select("length", "shard", F.coalesce("before", F.lit(0)).alias("before"))
    runs = spark.createDataFrame(plan or [(0, 0, 0, 0, 0)], "length long, first_rank long, run_count long, first_sequence long, run_offset long")
    by_length = runs.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first_rank", "run_count", "first_sequence", "run_offset"))).alias("runs"))
    order = W.partitionBy("shard", "length").orderBy(F.col("doc_id").asc_nulls_last(), "piece", "ids_crc32")
    ranked = sharded.withColumn("rank", F.row_number().over(order) - 1).join(offsets, ["length", "shard"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(by_length), "length").withColumn("run", F.filter("runs", lambda r: (r["first_rank"] <= F.col("rank")) & (F.col("rank") < r["first_rank"] + r["run_count"]))[0])
    return placed.select(
        *[c for c in pieces.columns],
        (F.col("run.first_sequence") + F.col("rank") - F.col("run.first_rank")).alias("sequence_id"),
        F.col("run.run_offset").alias("offset"),
    )


def pack_documents(docs: DataFrame, encode: Callable[[list[str]], list[bytes]], id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids``).

    A null or empty text is the end id alone.  Rows count one by one, also repeated ones and those
    with null identifiers; other columns are ignored; an empty table gives an empty result.
    """
    pieces = Scratch(docs.sparkSession).keep(token_pieces(docs, encode, id_col, text_col, capacity, end_id, with_ids), "pieces")
    return pack_pieces(pieces, capacity)


def op6_packing(spark, sf_dir):
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), word_ids(public_tokenizers.path("word_bpe_49k.json")))

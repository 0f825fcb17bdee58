"""Byte-level BPE by dynamic programming over prefixes.

For a rank table every byte prefix of a piece has exactly one valid last token: the token ``t`` for
which the prefix before it ends in a token that ``t`` may follow.  The table of these last tokens is
the whole state.  Appending computes entries for the new bytes only; an edit keeps the entries
before it and, as an entry depends on no more than the longest token's length of text and entries
before it, takes the old ones up again as soon as that many agree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from math import inf

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HELD, documents, slabs, tidied

#: Entries of the memo tables of one worker; they are emptied when full, so memory is bounded.
MEMO = 400_000
#: Bytes of a piece whose last tokens are taken from another piece that begins alike.
HEAD = 6
SLAB = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Known(dict):
    """Ids of words by their text."""

    def __init__(self, coder: BytePairCoder):
        self.coder, self.before = coder, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = b"".join([self.coder.packed[i] for i in self.coder.piece_ids(word.encode())])
        if len(word) <= 40:
            if len(self) >= MEMO // 2:  # words that are met again go on, others go with the next half
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


class BytePairCoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.token: list[bytes] = [b""] * size
        for text, rank in ranks.items():
            self.token[rank] = text
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.longest = max(map(len, ranks))
        #: By the last four bytes of a text: the lengths of the tokens that end in them, longer ones first.
        ends: dict[bytes, set[int]] = {}
        for text in ranks:
            if len(text) > 3:
                ends.setdefault(text[-4:], {n for n in (1, 2, 3) if text[-n:] in ranks}).add(len(text))
        self.sizes = {end: tuple(sorted(found, reverse=True)) for end, found in ends.items()}
        self.follows: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = {}, {}
        self.heads: dict[bytes, tuple[int, ...]] = {}
        self.known = _Known(self)

    def merged(self, piece: bytes, down_to: int = 1) -> list[int]:
        """The definition: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > down_to:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def edge(self, token: int, right: bool) -> list[tuple[bytes, float]]:
        """What lies at one edge of a token while it is built: each part, from the single byte up,
        with the rank of the merge that takes it up (infinite for the token itself)."""
        found = self.edges[right].get(token)
        if found is None:
            text = self.token[token]
            found = [(text, inf)]
            if len(text) > 1:
                halves = self.merged(text, down_to=2)
                *inner, (top, _) = self.edge(halves[right], right)
                found = [*inner, (top, token), *found]
            self.edges[right][token] = found
        return found

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens' texts together encode to just these two: no two parts that meet
        at the border at some time may merge before one of them is taken up by its own side."""
        key = left << 20 | right
        found = self.follows.get(key)
        if found is None:
            if len(self.follows) >= MEMO:
                self.follows.clear()
            found = self.follows[key] = self.stands_alone(right) and self._meets(self.edge(left, True), self.edge(right, False))
        return found

    def _meets(self, ends: list, starts: list) -> bool:
        i = j = 0
        while True:
            (a, a_gone), (b, b_gone) = ends[i], starts[j]
            rank = self.ranks.get(a + b)
            # of equal ranks the leftmost pair merges first
            if rank is not None and rank < a_gone and rank <= b_gone:
                return False
            if a_gone == b_gone == inf:
                return True
            if a_gone <= b_gone:
                i += 1
            else:
                j += 1

    def stands_alone(self, token: int) -> bool:
        found = self.whole.get(token)
        if found is None:
            found = self.whole[token] = self.merged(self.token[token]) == [token]
        return found

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Appends the last tokens of the prefixes of ``piece`` that ``last`` does not cover yet."""
        rank, sizes, follows, short = self.ranks.get, self.sizes.get, self.follows.get, (3, 2, 1)
        for end in range(len(last) + 1, len(piece) + 1):
            for size in sizes(piece[end - 4 : end], short) if end > 3 else range(end, 0, -1):
                start = end - size
                if start < 0:
                    continue
                token = rank(piece[start:end])
                if token is None:
                    continue
                if start:
                    good = follows(last[start - 1] << 20 | token)
                    if good is None:
                        good = self.may_follow(last[start - 1], token)
                else:
                    good = self.stands_alone(token)
                if good:
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {end}")
        return last

    def unwind(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.token[out[-1]])
        return out[::-1]

    def piece_ids(self, piece: bytes) -> list[int]:
        """A piece that is itself in the table is that one token, as in the common library."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        head = piece[:HEAD]
        last = self.heads.get(head)
        if last is None:
            if len(self.heads) >= MEMO // 4:
                self.heads.clear()
            last = self.heads[head] = tuple(self.extend(head, []))
        return self.unwind(self.extend(piece, list(last)))

    def edit(self, piece: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replaces piece[start:stop]; returns the new piece and its prefix table."""
        out = piece[:start] + new + piece[stop:]
        table, shift, agreed = last[:start], len(new) - (stop - start), 0
        while len(table) < len(out):
            self.extend(out[: len(table) + 1], table)
            at = len(table)
            agreed = agreed + 1 if at > start + len(new) and last[at - 1 - shift] == table[-1] else 0
            if agreed >= self.longest:
                table += last[at - shift :]
        return out, table

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I")))


_coders: dict[tuple[str, str], BytePairCoder] = {}
HELD.append(_coders)


def coder(path: str, pattern: str) -> BytePairCoder:
    """One coder for each table and worker process."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = BytePairCoder(load_ranks(path), pattern)
    return _coders[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and ``ids`` (array<int>) if ``with_ids``.

    Null text counts as empty: no tokens, the digests of nothing.  Rows are independent, so repeated
    rows and identifiers, null identifiers and other columns need no care; an empty table gives an
    empty result.  A very long text is encoded piece by piece.
    """
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), *[T.StructField(c, t) for c, t in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()))]]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks_path, pattern)
        for batch in batches:
            columns: list[list] = [[] for _ in range(4)]
            for part in slabs(batch.column(1), lambda v: len(v.as_buffer() or b"") if v.is_valid else 0, SLAB):
                for value in part:
                    ids = own.encode(value.as_py() or "")
                    row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest(), memoryview(ids).cast("I").tolist() if with_ids else None)
                    for column, x in zip(columns, row, strict=True):
                        column.append(x)
            arrays = [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
            arrays += [pa.array(columns[3], pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(tidied(run), schema)


def op4_byte_pairs(spark, sf_dir):
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can end its BPE encoding. `PrefixTable` stores that last
token for each prefix: the last token of prefix i is the token t for which the last token of prefix i - len(t) and t stay
apart when BPE encodes the two together. The encoding is read backwards from the end. So an append only adds entries, and
an edit recomputes entries until they agree with the old ones again.

A text is split by the pattern first, and each match is encoded separately, as common BPE libraries do; a match that is
itself a token is that token.

Defined results: null text is the empty text, which has no tokens; repeated rows are encoded each; other columns stay, but
for one that has the name of the output column, which is replaced.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import pieces

#: Entries of a worker's caches; a full cache is emptied, so memory stays bounded.
CACHE = 700_000


class Vocabulary:
    """Ranks of a tiktoken file; tokens by id; whether two tokens may stand side by side."""

    def __init__(self, path: str, pattern: str):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        #: Every suffix of a token with its rank, -1 if it is no token itself: the search for a last token stops at other bytes.
        self.tails = dict.fromkeys((token[i:] for token in self.ranks for i in range(1, len(token))), -1) | self.ranks
        self.longest = max(map(len, self.ranks))
        self.pattern = regex.compile(pattern)
        self._apart: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self.pieces = Pieces(self)

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE of a few bytes: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        rank, never = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], never) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) < never:
            at = pairs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], never)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], never)
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that BPE joins last to make this one; (-1, -1) for a byte; None if BPE never makes it."""
        known = self._halves.get(token, 0)
        if known == 0:
            data = self.tokens[token]
            known = (-1, -1) if len(data) == 1 else None
            for cut in range(1, len(data)):
                a, b = self.ranks.get(data[:cut]), self.ranks.get(data[cut:])
                if a is not None and b is not None and self.halves(a) and self.halves(b) and self._stay(a, b, token):
                    known = (a, b)
                    break
            self._halves[token] = known
        return known

    def _stay(self, x: int, y: int, limit: int = 1 << 60) -> bool:
        """True if no merge across the boundary of x and y comes before the merge of rank limit.

        Goes back in time: while x and y meet at the boundary, a merge of the two must not come before the merge that ended
        that time; then the later made of the two is undone. Of equal ranks the left merge comes first."""
        while True:
            if self.ranks.get(self.tokens[x] + self.tokens[y], limit) < limit:
                return False
            (a, b), (c, d) = self._halves[x], self._halves[y]
            if a < 0 and c < 0:
                return True
            if c < 0 or (a >= 0 and x > y):
                x, limit = b, x
            else:
                y, limit = c, y + 1

    def apart(self, left: int, right: int) -> bool:
        """True if BPE leaves the two tokens as they are when they are neighbours. left -1: right alone."""
        if len(self._apart) >= CACHE:
            self._apart.clear()
        known = self._apart[left << 32 | right] = bool(self.halves(right)) and (left < 0 or self._stay(left, right))
        return known

    def extend(self, data: bytes, last: list[int], stop: int) -> None:
        """Append the last tokens of the prefixes up to stop to those in last, where there is one for each shorter prefix."""
        tails, apart = self.tails.get, self._apart.get
        for end in range(len(last), stop + 1):
            for start in range(end - 1, -1, -1):
                token = tails(data[start:end])
                if token is None:
                    raise ValueError("the vocabulary lacks a single-byte token")
                if token >= 0:
                    left = last[start]
                    known = apart(left << 32 | token)
                    if known or known is None and self.apart(left, token):
                        last.append(token)
                        break
            else:
                raise ValueError("no token ends this prefix")

    def read_back(self, last: list[int]) -> tuple[int, ...]:
        out, end = [], len(last) - 1
        while end:
            out.append(last[end])
            end -= len(self.tokens[last[end]])
        return tuple(out[::-1])

    def prefix_ids(self, data: bytes) -> tuple[int, ...]:
        last = [-1]
        self.extend(data, last, len(data))
        return self.read_back(last)

    def packed(self, text: str) -> bytes:
        """The tokens of a text as 32-bit numbers."""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Pieces(dict):
    """Tokens of a match of the pattern as 32-bit numbers, computed once while the cache holds them."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.vocabulary.ranks.get(data)
        ids = array("i", (whole,) if whole is not None else self.vocabulary.prefix_ids(data)).tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


class PrefixTable:
    """last[i]: the last token of the encoding of data[:i]. Exact under append and edit."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last = [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.vocabulary.extend(self.data, self.last, len(self.data))

    def edit(self, start: int, stop: int, data: bytes) -> int:
        """Replace data[start:stop]; returns how many entries were computed anew.

        Behind the edit an entry depends on as many entries before it as the longest token has bytes, so after that many
        entries in a row that equal the old ones the rest is unchanged."""
        old = self.last[stop + 1 :]
        self.data = self.data[:start] + data + self.data[stop:]
        del self.last[start + 1 :]
        self.vocabulary.extend(self.data, self.last, start + len(data))
        same = 0
        for k, was in enumerate(old):
            if same > self.vocabulary.longest:
                self.last += old[k:]
                return len(data) + k
            self.vocabulary.extend(self.data, self.last, len(self.last))
            same = same + 1 if self.last[-1] == was else 0
        return len(data) + len(old)

    def ids(self) -> list[int]:
        return list(self.vocabulary.read_back(self.last))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One for each worker process."""
    return Vocabulary(path, pattern)


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema if f.name.lower() != name.lower()] + [T.StructField(name, kind)])


def _put(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [i for i, x in enumerate(batch.schema.names) if x.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), column], names=[*(batch.schema.names[i] for i in keep), name])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """docs with the tokens of every whole text as array<int>. A narrow step: no shuffle, a batch of rows in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in pieces(batches):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            rows = [v.packed(t) if t else b"" for t in texts]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
            flat = np.frombuffer(b"".join(rows), np.int32)
            yield _put(batch, out, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))

    return docs.mapInArrow(run, _with(docs.schema, out, T.ArrayType(T.IntegerType())))


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """rows with the bytes that the tokens stand for, as binary; null tokens give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in pieces(batches):
            column = batch.column(batch.schema.get_field_index(ids))
            flat = column.flatten().to_numpy(zero_copy_only=False).tolist()
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy()).tolist()
            yield _put(batch, out, pa.array([v.decode(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)], pa.binary()))

    return rows.mapInArrow(run, _with(rows.schema, out, T.BinaryType()))

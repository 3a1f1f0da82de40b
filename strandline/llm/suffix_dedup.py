"""Exact substring deduplication over a collection's Burrows-Wheeler transform, built column by column.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id. Whether it does is read
from the suffix order of all strings with equal minimisers: `ColumnwiseBWT` takes many short strings and inserts one symbol of
each in a round, from the last to the first, rewriting the transform and the common prefix lengths front to back in two
external files. Runs of suffixes whose common prefix has `length` bytes are the repeated strings.

How the strings get there, at any size:

1. Documents are packed into stored chunks of a few MB of text. A window of `length` bytes is keyed by its minimiser, the
   least hash of the 16-byte strings in it; windows in a row with one key are one segment. Equal windows have equal keys.
2. Each chunk sends its distinct keys, once each, as flat rows dealt by key; a task settles which of them one document alone
   has. As a chunk sends a key once among its tens of thousands, no key, however common, makes a task's share uneven.
3. For the other keys the chunk has its distinct segments with their smallest document. A task combines those of many chunks
   and sends them to buckets by key. A key with very many segments (a line that a third of all documents have, each in
   another context) is split: its windows go by their own hash instead.
4. A bucket merges equal segments, keeping the smallest document, and builds the transform of what still can repeat: stretches
   whose longer strings another segment has, too. It answers one bit for each window: a smaller document has it.
5. The chunk marks what the bits say and cuts it.

Only keys, segments and bits are shuffled; no step holds more than a chunk, a bucket or the strings that a task combines.
A bucket is bounded, so a round reads its two files front to back in one piece.

Defined results: null texts are empty; texts shorter than `length` stay whole; repeated ids are one document, whose rows do
not remove from each other; rows with a null id stay whole and count as no document; tables may be empty.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, shared_dir, stored

#: Bytes of text in a chunk; bytes of a minimiser; windows of a segment at most.
CHUNK, MINIMISER, SEGMENT = 2 << 20, 16, 64
#: Bytes of a repeated string at most.
LONGEST = 60_000
#: Windows that are hashed at a time, so that the arrays fit a cache.
PASS = 1 << 15
#: Segments of a key from which on its windows are dealt one by one.
HOT_KEY = 20_000
#: Bytes of text for each range of keys and for each bucket of segments.
RANGE, BUCKET = 8 << 20, 4 << 20
#: Bytes of strings that a task combines before it sends them.
SEND = 32 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _words(data: bytes, n: int) -> np.ndarray:
    """The eight bytes from each of the first n positions, as one number."""
    padded, out = data + bytes(64), np.empty(n, np.uint64)
    for r in range(min(8, n)):
        count = (n - r + 7) // 8
        out[r::8] = np.frombuffer(padded, "<u8", count, r)
    return out


def _least(data: bytes, length: int, gram: int) -> np.ndarray:
    """The least hash of the strings of `gram` bytes in each window."""
    n, grams = len(data) - length + 1, len(data) - gram + 1
    words = _words(data, grams + gram - 8)
    least = words[gram - 8 :]
    for at in range(gram - 16, -8, -8):
        least = words[at : at + grams] + _mix(least)
    least = _mix(least)
    width, span = 1, length - gram + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[:n], least[span - width : span - width + n])


def segments(data: bytes, ends: np.ndarray, length: int, gram: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first window and number of windows of each segment of the concatenated documents that end at `ends`.

    The key of a window is the least hash of its strings of `gram` bytes, a multiple of 8."""
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(np.uint64), none, none
    least = np.concatenate([_least(data[i : i + PASS + length - 1], length, gram) for i in range(0, n, PASS)])
    starts = np.r_[0, ends[:-1]]
    whole = np.zeros(len(data) + 1, np.int32)  # windows that lie in one document
    long = ends - starts >= length
    np.add.at(whole, starts[long], 1)
    np.add.at(whole, ends[long] - length + 1, -1)
    inside = np.cumsum(whole[:n]) > 0
    new = np.r_[True, (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])]
    new[starts[long]] = True
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, n])
    first, count = first[inside[first]], count[inside[first]]
    pieces = (count + SEGMENT - 1) // SEGMENT
    if len(pieces) and pieces.max() > 1:
        at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, count = np.repeat(first, pieces) + at * SEGMENT, np.minimum(np.repeat(count, pieces) - at * SEGMENT, SEGMENT)
    return least[first], first, count


class ColumnwiseBWT:
    """Transform and common prefix lengths of a collection, after one round for each column from the right.

    In round j the suffixes of length j join those that are shorter. The new suffix c + X of a string stands behind all that
    start with less than c and behind as many that start with c as there are c's before X in the transform; so the old
    transform gives all places at once. Its common prefix with the neighbour before is one more than the least common prefix
    between X and the row of the c before; likewise behind. Both files are read and written once in a round.

    Symbols are bytes plus 1 (UTF-8 has no byte 255), 0 ends a string; equal suffixes stand in the order of the strings."""

    def __init__(self, strings: np.ndarray, starts: np.ndarray, lengths: np.ndarray, folder: str):
        self.n, self.lengths = len(starts), lengths
        self.files = [open(Path(folder, name), "w+b", buffering=0) for name in ("bwt", "lcp")]  # noqa: SIM115
        symbols = strings.astype(np.uint8) + np.uint8(1)
        ends = starts + lengths
        self.kind = np.uint8 if lengths.max(initial=0) < 255 else np.uint16  # of common prefixes
        self._write(symbols[ends - 1], np.zeros(self.n, self.kind))
        active, place = np.arange(self.n), np.arange(self.n)
        for j in range(1, int(lengths.max(initial=0)) + 1):
            bwt, lcp = self._read()
            order = np.argsort(bwt, kind="stable")
            zeros = int(np.count_nonzero(bwt == 0))
            sort = np.argsort(place)
            active, place = active[sort], place[sort]
            at = np.empty(len(bwt), np.int32)
            at[order] = np.arange(len(bwt), dtype=np.int32)
            at = at[place]
            symbol, padded = bwt[place], np.r_[lcp, 0].astype(self.kind)
            rows = self.n - zeros + at
            before = order[np.maximum(at - 1, 0)]
            after = order[np.minimum(at + 1, len(order) - 1)]
            same_before = (at > 0) & (bwt[before] == symbol)
            same_after = (at + 1 < len(order)) & (bwt[after] == symbol)
            with_before = self._least(padded, before, place, same_before)
            with_after = self._least(padded, place, after, same_after)
            # the next symbol of each string, or its end
            more = lengths[active] > j
            following = np.where(more, symbols[np.maximum(ends[active] - j - 1, 0)], 0).astype(np.uint8)
            old = np.ones(len(bwt) + len(active), bool)
            old[rows] = False
            new_bwt, new_lcp = np.empty(len(old), np.uint8), np.empty(len(old) + 1, self.kind)
            new_bwt[old], new_bwt[rows] = bwt, following
            new_lcp[:-1][old], new_lcp[rows] = lcp, with_before
            new_lcp[rows[same_after] + 1] = with_after[same_after]
            self._write(new_bwt, new_lcp[:-1])
            active, place = active[more], rows[more]

    @staticmethod
    def _least(lcp: np.ndarray, low: np.ndarray, high: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """1 + min(lcp[low + 1 .. high]) where valid, else 0."""
        out = np.zeros(len(low), lcp.dtype)
        if valid.any():
            bounds = np.stack([low[valid] + 1, high[valid] + 1], axis=1).ravel()
            out[valid] = np.minimum.reduceat(lcp, bounds)[::2] + 1
        return out

    def _write(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        self.rows = len(bwt)
        for file, column in zip(self.files, (bwt, lcp), strict=True):
            file.seek(0)
            column.tofile(file)

    def _read(self) -> tuple[np.ndarray, np.ndarray]:
        for file in self.files:
            file.seek(0)
        return tuple(np.fromfile(file, kind, self.rows) for file, kind in zip(self.files, (np.uint8, self.kind), strict=True))

    def close(self) -> None:
        for file in self.files:
            file.close()

    def repeats(self, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(string, offset, class) of the suffixes of at least `length` bytes, by columns; a class shares its first bytes."""
        bwt, lcp = self._read()
        order = np.argsort(bwt, kind="stable")
        step = np.empty(len(bwt), np.int64)
        step[order] = np.arange(len(bwt)) + self.n - int(np.count_nonzero(bwt == 0))
        group = np.cumsum(lcp < length)
        string, row = np.arange(self.n), np.arange(self.n)
        for j in range(1, int(self.lengths.max(initial=0)) + 1):
            on = self.lengths[string] >= j
            string, row = string[on], step[row[on]]
            if j >= length:
                yield string, self.lengths[string] - j, group[row]


def _shared(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (string, first window, windows) of windows with a key of long grams that another string has, too.

    Equal windows have equal keys, so no other window can stand in another string."""
    lengths = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(lengths)
    data = b"".join(strings)
    keys, first, count = segments(data, ends, length, (length - 10) // 8 * 8 if length >= 34 else MINIMISER)
    of = np.searchsorted(ends, first, side="right")
    order = np.lexsort((of, keys))
    keys, by = keys[order], of[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    several = by[np.r_[new[1:], len(keys)] - 1] != by[new] if len(keys) else np.zeros(0, bool)
    on = np.zeros(len(keys), bool)
    on[order] = np.repeat(several, np.diff(np.r_[new, len(keys)]))
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, first[on], 1)
    np.add.at(edge, first[on] + count[on], -1)
    runs = np.flatnonzero(np.diff(np.r_[0, np.cumsum(edge)[:-1] > 0, 0])).reshape(-1, 2)
    of = np.searchsorted(ends, runs[:, 0], side="right")
    return of, runs[:, 0] - (ends - lengths)[of], runs[:, 1] - runs[:, 0]


def repeated_windows(strings: list[bytes], owner: np.ndarray, length: int) -> list[np.ndarray]:
    """For each of the distinct strings: which of its windows also start in a string of a smaller owner.

    Only what can repeat is indexed: runs of windows with shared keys, each distinct run once, with its smallest owner."""
    found = [np.zeros(len(s) - length + 1, bool) for s in strings]
    least: dict[bytes, int] = {}
    runs = []
    for k, f, n in zip(*(x.tolist() for x in _shared(strings, length)), strict=True):
        run = strings[k][f : f + n + length - 1]
        if least.get(run, owner[k]) >= owner[k]:
            least[run] = int(owner[k])
        runs.append((k, f, n, run))
    distinct = list(least)
    several = sorted(set(_shared(distinct, length)[0].tolist()))
    smallest: dict[bytes, np.ndarray] = {}
    if several:
        indexed = [distinct[k] for k in several]
        lengths = np.array([len(s) for s in indexed], np.int64)
        starts, owners = np.cumsum(lengths) - lengths, np.array([least[s] for s in indexed], np.int64)
        with tempfile.TemporaryDirectory() as folder:
            index = ColumnwiseBWT(np.frombuffer(b"".join(indexed), np.uint8), starts, lengths, folder)
            columns = list(index.repeats(length))
            index.close()
        of_class = np.full(1 + max(int(g.max(initial=0)) for _, _, g in columns), np.iinfo(np.int64).max)
        for string, _, group in columns:
            np.minimum.at(of_class, group, owners[string])
        answer = np.zeros(int(lengths.sum()), np.int64)
        for string, offset, group in columns:
            answer[starts[string] + offset] = of_class[group]
        smallest = {s: answer[a : a + len(s) - length + 1] for s, a in zip(indexed, starts.tolist(), strict=True)}
    for k, f, n, run in runs:
        if run in smallest:
            found[k][f : f + n] = smallest[run] < owner[k]
        elif least[run] < owner[k]:
            found[k][f : f + n] = True
    return found


class Chunk:
    """The documents of a stored row: concatenated bytes and ends; ids; segments of the documents with an id."""

    def __init__(self, ids: list, ends: np.ndarray, data: bytes, length: int):
        self.ids, self.ends, self.data, self.length = ids, ends, data, length
        self.keys, self.first, self.count = segments(data, ends, length)
        self.doc = np.searchsorted(ends, self.first, side="right")
        known = np.array([i is not None for i in ids], bool)
        number = np.array([0 if i is None else i for i in ids], np.int64)
        keep = known[self.doc] if len(self.doc) else np.zeros(0, bool)
        self.keys, self.first, self.count, self.doc = (x[keep] for x in (self.keys, self.first, self.count, self.doc))
        self.owner = number[self.doc]

    def distinct_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys, segments of each, and whether more than one document has it."""
        order = np.argsort(self.keys, kind="stable")
        keys, owner = self.keys[order], self.owner[order]
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        if not len(new):
            return keys, new, new.astype(bool)
        return keys[new], np.diff(np.r_[new, len(keys)]), np.minimum.reduceat(owner, new) != np.maximum.reduceat(owner, new)

    def parts(self, shared: np.ndarray, hot: np.ndarray) -> Parts:
        """The parts of the chunk: segments with a shared key, and the windows one by one of those with a hot key."""
        at = np.searchsorted(shared, self.keys)
        on = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == self.keys) if len(shared) else np.zeros(0, np.int64)
        on = on[np.argsort(self.owner[on], kind="stable")]  # the first of equal strings has the smallest owner
        burst = np.isin(self.keys[on], hot)
        pieces = np.where(burst, self.count[on], 1)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(self.first[on], pieces) + step
        count = np.where(np.repeat(burst, pieces), 1, np.repeat(self.count[on], pieces))
        index: dict[bytes, int] = {}
        data, ends = self.data, (first + count + self.length - 1).tolist()
        number = np.fromiter((index.setdefault(data[f:e], len(index)) for f, e in zip(first.tolist(), ends, strict=True)), np.int64, len(first))
        lead = np.zeros(len(index), np.int64)
        lead[number[::-1]] = np.arange(len(number))[::-1]
        owner, strings = np.repeat(self.owner[on], pieces), list(index)
        keys = np.repeat(self.keys[on], pieces)[lead]
        single = np.flatnonzero(np.repeat(burst, pieces)[lead])
        keys[single] = [zlib.crc32(strings[k]) for k in single.tolist()]
        return Parts(strings, keys, owner[lead], number, owner, first, count)


@dataclass(frozen=True)
class Parts:
    """Distinct strings with key and smallest owner, and each part: number of its string, owner, first window, windows."""

    strings: list[bytes]
    keys: np.ndarray
    least: np.ndarray
    number: np.ndarray
    owner: np.ndarray
    first: np.ndarray
    count: np.ndarray


def _pack(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Chunks of documents, stored: (chunk, ids, ends, data). Later steps find the same chunks under the same numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def closed() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([zlib.compress(b"".join(texts), 1)], pa.binary())], names=["ids", "ends", "data"])

        for batch in pieces(batches):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append((t or "").encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= CHUNK:
                    yield closed()
                    ids, texts, size = [], [], 0
        if ids:
            yield closed()

    path = shared_dir(docs.sparkSession, "chunks")
    packed = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "ids array<long>, ends array<long>, data binary")
    packed.select(F.monotonically_increasing_id().alias("chunk"), "*").write.option("compression", "uncompressed").parquet(path)
    return docs.sparkSession.read.schema("chunk long, ids array<long>, ends array<long>, data binary").parquet(path)


def _chunks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[int, Chunk, pa.RecordBatch]]:
    """Number and content of each stored chunk, with its row."""
    for row in pieces(batches, 1):
        ids, ends, data = (row.column(k)[0].as_py() for k in (1, 2, 3))
        yield row.column(0)[0].as_py(), Chunk(ids, np.array(ends, np.int64), zlib.decompress(data), length), row


def _numbers(row: pa.RecordBatch, column: int) -> np.ndarray:
    """The numbers of a row's list; none for a null."""
    return row.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


class Outbox:
    """Strings of many chunks of a task, by bucket: combined before the shuffle, so that a bucket gets few messages of a task."""

    SCHEMA = pa.schema([("bucket", pa.int64()), ("strings", pa.binary()), ("lengths", pa.binary()), ("owners", pa.binary()), ("chunks", pa.binary()), ("numbers", pa.binary())])

    def __init__(self, buckets: int, kind: type = np.uint8):
        self.buckets, self.size, self.held, self.kind = buckets, 0, [], kind

    def add(self, chunk: int, parts: Parts) -> None:
        bucket = (_mix(parts.keys) % np.uint64(self.buckets)).astype(np.int64)
        self.held.append((parts.strings, bucket, parts.least, np.full(len(bucket), chunk, np.int64), np.arange(len(bucket), dtype=np.int32)))
        self.size += sum(map(len, parts.strings))

    def flush(self) -> pa.RecordBatch:
        strings = [s for h in self.held for s in h[0]]
        bucket, owners, chunks, numbers = (np.concatenate([np.zeros(0, t), *(h[k] for h in self.held)]) for k, t in ((1, np.int64), (2, np.int64), (3, np.int64), (4, np.int32)))
        order = np.argsort(bucket, kind="stable")
        lengths = np.fromiter(map(len, strings), self.kind, len(strings))
        cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True]) if len(order) else np.zeros(0, np.int64)
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = order[a:b]
            out.append((int(bucket[own[0]]), zlib.compress(b"".join([strings[k] for k in own.tolist()]), 1), *(c[own].tobytes() for c in (lengths, owners, chunks, numbers))))
        self.size, self.held = 0, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * 6, self.SCHEMA, strict=True)], schema=self.SCHEMA)


def mark(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, hot_key: int = HOT_KEY) -> DataFrame:
    """(id, n_bytes, spans, kept) of every row: removed byte runs (end exclusive) and the bytes that are left.

    length: MINIMISER bytes at least, LONGEST at most; another one is refused."""
    if not MINIMISER <= length <= LONGEST:
        raise ValueError(f"length is {MINIMISER} to {LONGEST}")
    kind = np.uint8 if length + SEGMENT <= 255 else np.uint16  # of the lengths of strings
    spark = docs.sparkSession
    chunks = _pack(docs, key, text)
    total = chunks.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    ranges, buckets = max(12, -(-total // RANGE)), max(12, -(-total // BUCKET))

    def send_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, _ in _chunks(batches, length):
            keys, count, several = chunk.distinct_keys()
            count = np.where(several, -count, count).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), number)), pa.array(count)], names=["key", "chunk", "segments"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        key, chunk, segments = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
        order = np.argsort(key, kind="stable")
        key, chunk, segments = key[order], chunk[order], segments[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[new, len(key)])
        shared = (n > 1) | (np.minimum.reduceat(segments, new) < 0)
        hot = np.add.reduceat(np.abs(segments).astype(np.int64), new) > hot_key
        on = np.repeat(shared, n)
        yield pa.RecordBatch.from_arrays([pa.array(chunk[on]), pa.array(key[on]), pa.array(np.repeat(hot, n)[on])], names=["chunk", "key", "hot"])

    # a chunk sends a key once, so that even a key of all documents is one of the tens of thousands of rows of each chunk
    asked = chunks.mapInArrow(send_keys, "key long, chunk long, segments int").repartition(ranges, "key")
    answers = asked.mapInArrow(settle, "chunk long, key long, hot boolean").groupBy("chunk")
    known = stored(answers.agg(F.collect_list("key").alias("keys"), F.collect_list(F.when(F.col("hot"), F.col("key"))).alias("hot")), "keys")
    known = chunks.join(known.withColumnRenamed("chunk", "of"), F.col("chunk") == F.col("of"), "left").drop("of")

    def parts_of(chunk: Chunk, row: pa.RecordBatch) -> Parts:
        shared, hot = (_numbers(row, k).view(np.uint64) for k in (4, 5))
        return chunk.parts(np.sort(shared), hot)

    def send_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outbox = Outbox(buckets, kind)
        for number, chunk, row in _chunks(batches, length):
            outbox.add(number, parts_of(chunk, row))
            if outbox.size >= SEND:
                yield outbox.flush()
        yield outbox.flush()

    bits_schema = pa.schema([("chunk", pa.int64()), ("numbers", pa.binary()), ("bits", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[bytes, int] = {}
        messages, owners = [], []
        for row in pa.Table.from_batches(list(batches), Outbox.SCHEMA).to_pylist():
            data, at, own = zlib.decompress(row["strings"]), 0, []
            for n in np.frombuffer(row["lengths"], kind).tolist():
                own.append(index.setdefault(data[at : at + n], len(index)))
                at += n
            messages.append([np.array(own, np.int64), *(np.frombuffer(row[c], t) for c, t in (("owners", np.int64), ("chunks", np.int64), ("numbers", np.int32)))])
        string, owner, chunk, number = (np.concatenate(c) for c in zip(*messages, strict=True))
        least = np.full(len(index), np.iinfo(np.int64).max)
        np.minimum.at(least, string, owner)
        windows = repeated_windows(list(index), least, length)
        every = [np.ones_like(w) for w in windows]
        hit = (owner > least[string]) | np.array([w.any() for w in windows], bool)[string]
        order = np.flatnonzero(hit)[np.argsort(chunk[hit], kind="stable")]
        cuts = np.flatnonzero(np.r_[True, np.diff(chunk[order]) != 0, True]) if len(order) else order
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = order[a:b]
            bits = [every[s] if more else windows[s] for s, more in zip(string[own].tolist(), (owner[own] > least[string[own]]).tolist(), strict=True)]
            out.append((int(chunk[own[0]]), number[own].tobytes(), np.packbits(np.concatenate(bits)).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), bits_schema, strict=True)], schema=bits_schema)

    decided = known.mapInArrow(send_parts, "bucket long, strings binary, lengths binary, owners binary, chunks binary, numbers binary").groupBy("bucket").applyInArrow(build, "chunk long, numbers binary, bits binary")
    decisions = stored(decided.groupBy("chunk").agg(F.collect_list("numbers").alias("numbers"), F.collect_list("bits").alias("bits")), "bits")
    whole = known.join(decisions.withColumnRenamed("chunk", "of"), F.col("chunk") == F.col("of"), "left").drop("of")
    out = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def removed(chunk: Chunk, row: pa.RecordBatch) -> np.ndarray:
        """Whether each byte of the chunk goes."""
        gone = np.zeros(len(chunk.data) + length + 1, np.int32)
        answers = [c[0].as_py() or [] for c in (row.column(6), row.column(7))]
        if answers[0] or len(row.column(4).flatten()):
            parts = parts_of(chunk, row)
            begin, end = [parts.first[parts.owner > parts.least[parts.number]]], [(parts.first + parts.count + length - 1)[parts.owner > parts.least[parts.number]]]
            size = np.fromiter(map(len, parts.strings), np.int64, len(parts.strings)) - length + 1
            full, some = np.zeros(len(size), bool), {}
            for numbers, bits in zip(*answers, strict=True):
                own, bits = np.frombuffer(numbers, np.int32), np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
                start = np.cumsum(size[own]) - size[own]
                full[own] = np.logical_and.reduceat(bits[: size[own].sum()], start)
                some |= {k: bits[a : a + n] for k, a, n, f in zip(own.tolist(), start.tolist(), size[own].tolist(), full[own].tolist(), strict=True) if not f}
            rest = parts.owner == parts.least[parts.number]
            begin.append(parts.first[rest & full[parts.number]])
            end.append((parts.first + parts.count + length - 1)[rest & full[parts.number]])
            partly = np.zeros(len(size), bool)
            partly[list(some)] = True
            for k in np.flatnonzero(rest & partly[parts.number]).tolist():
                at = parts.first[k] + np.flatnonzero(some[parts.number[k]])
                begin.append(at)
                end.append(at + length)
            np.add.at(gone, np.concatenate(begin), 1)
            np.add.at(gone, np.concatenate(end), -1)
        return np.cumsum(gone)[: len(chunk.data)] > 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk, row in _chunks(batches, length):
            gone = removed(chunk, row)
            before = np.r_[0, np.cumsum(gone)]
            touched = before[chunk.ends] != before[np.r_[0, chunk.ends[:-1]]]
            rows, start = [], 0
            for i, end, some in zip(chunk.ids, chunk.ends.tolist(), touched.tolist(), strict=True):
                spans, kept = [], chunk.data[start:end]
                if some:
                    own = gone[start:end]
                    spans = [{"start": a, "end": b} for a, b in np.flatnonzero(np.diff(np.r_[0, own.astype(np.int8), 0])).reshape(-1, 2).tolist()]
                    kept = np.frombuffer(kept, np.uint8)[~own].tobytes()
                rows.append({"id": i, "n_bytes": end - start, "spans": spans, "kept": kept})
                start = end
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    return whole.mapInArrow(cut, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")

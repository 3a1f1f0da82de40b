"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a bounded run of documents inside a task. All its words become symbols, a separator stands between documents, and
the index is built over the whole shard, whatever is searched in it. On its Burrows-Wheeler transform the test phrases of a
block are searched backwards, all at once, through the ranks of a wavelet matrix; occurrences are located from sampled suffix
positions, and overlapping ones merge into spans.

A phrase is a window of `size` consecutive words of a test item, or a whole item of fewer words. Words are runs of ASCII
letters and digits and of non-ASCII characters, A-Z lower-cased.

The documents are never shuffled. The test items are stored in the shared folder as blocks of at most `block_bytes` of text;
a task holds one block at a time, and searches each shard for all of them. Nothing passes the driver but the files' names.

Defined results: null and empty texts have no words; a null item has no phrase; repeated rows of documents, and rows with a null
id, are each reported, with any number of blocks; repeated items count once by id; tables may be empty; other columns stay, but
for those with the names of the output columns.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, pieces, shared_dir, together

#: Bytes of text after which a shard is closed.
SHARD_BYTES = 4 << 20
#: Every how many text positions the suffix array is sampled.
SAMPLE = 8

_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Words in order; bytes of UTF-8, for only ASCII bytes decide."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Phrases:
    """The distinct windows of some items, by length, as numbers of `words`; `owners` has the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            row = [number.setdefault(w, len(number)) for w in words_of(text)]
            for i in range(max(1, len(row) - size + 1) if row else 0):
                owners[tuple(row[i : i + size])].add(item)
        self.words = list(number)
        rows = sorted(owners, key=lambda k: (len(k), k))
        self.owners = [sorted(owners[r]) for r in rows]
        self.lengths = []  # first phrase and matrix of each length
        for length in sorted({len(r) for r in rows}):
            same = [i for i, r in enumerate(rows) if len(r) == length]
            self.lengths.append((same[0], np.array([rows[i] for i in same], np.int64)))


class Wavelet:
    """Wavelet matrix of symbols: rank and access in one step for each bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((level, ones, len(symbols) - int(ones[-1])))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        low = np.zeros_like(at)
        for level, ones, zeros in self.levels:
            bit = (symbol >> level) & 1
            low, at = (np.where(bit == 1, zeros + ones[x], x - ones[x]) for x in (low, at))
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for level, ones, zeros in self.levels:
            bit = ones[at + 1] - ones[at]
            out |= bit.astype(out.dtype) << level
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling from three symbols on; only suffixes that still tie are sorted again.

    text ends with a symbol that is smaller than all others and stands nowhere else."""
    n, radix = len(text), int(text.max()) + 1
    padded = np.r_[text, 0, 0].astype(np.int64)
    key = (padded[:n] * radix + padded[1 : n + 1]) * radix + padded[2:] if radix < 1 << 20 else padded[:n]
    step = 3 if radix < 1 << 20 else 1
    order = np.argsort(key)
    rank, left, key = np.empty(n, np.int64), np.arange(n), key[order]
    while True:
        new = np.r_[True, key[1:] != key[:-1]]
        rank[order[left]] = left[np.maximum.accumulate(np.where(new, np.arange(len(left)), 0))]
        left = left[~(new & np.r_[new[1:], True])]
        if not len(left):
            return order
        at = order[left]
        key = rank[at] * (n + 1) + rank[at + step]  # two that tie so far both go on: the last symbol is in neither
        sort = np.argsort(key)
        order[left], key = at[sort], key[sort]
        step *= 2


class FMIndex:
    """Count and locate of phrases over one shard of symbols from 1 on."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        text = np.r_[text, 0]
        suffixes = suffix_array(text)
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=n_symbols + 1))]
        self.bwt = Wavelet(text[suffixes - 1].astype(np.int32), max(1, int(n_symbols).bit_length()))
        marked = suffixes % SAMPLE == 0
        self.marks = np.r_[0, np.cumsum(marked, dtype=np.int32)]
        self.samples = suffixes[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of phrases of one length those that occur, with their suffix ranges, by backward search."""
        alive = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.first[-1], np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            low = self.first[symbol] + self.bwt.rank(symbol, low)
            high = self.first[symbol] + self.bwt.rank(symbol, high)
            on = high > low
            alive, low, high = alive[on], low[on], high[on]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: walk back to the next sampled position."""
        out, steps, left, rows = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.astype(np.int64)
        while len(left):
            done = self.marks[rows + 1] > self.marks[rows]
            out[left[done]] = self.samples[self.marks[rows[done]]] + steps
            left, rows, steps = left[~done], rows[~done], steps + 1
            symbol = self.bwt.access(rows)
            rows = self.first[symbol] + self.bwt.rank(symbol, rows)
        return out


class _Symbols(dict):
    """Symbols of words in the order in which they come; 1 separates documents."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 2
        return number


class Shard:
    """Some texts with the index of all their words."""

    def __init__(self, texts: list[str | None]):
        self.symbols, gap = _Symbols(), np.ones(1, np.int64)
        rows, counts = [], []
        for text in texts:
            words = words_of(text)
            counts.append(len(words))
            rows += [np.fromiter(map(self.symbols.__getitem__, words), np.int64, len(words)), gap]
        self.counts = counts
        self.starts = np.cumsum(np.r_[0, np.array(counts, np.int64) + 1])[:-1]
        self.index = FMIndex(np.concatenate(rows), len(self.symbols) + 1) if self.symbols else None

    def search(self, blocks: Iterator[Phrases]) -> list[tuple[list[tuple[int, int]], list[str]]]:
        """For each text: merged spans of hit words (end exclusive), and ids of the items found."""
        spans: list[list[tuple[int, int]]] = [[] for _ in self.counts]
        items: list[set[str]] = [set() for _ in self.counts]
        for block in blocks if self.index else ():
            known = np.array([self.symbols.get(w, 0) for w in block.words], np.int64)
            for first, matrix in block.lengths:
                phrases = known[matrix]
                possible = np.flatnonzero((phrases > 0).all(axis=1))
                alive, low, high = self.index.search(phrases[possible])
                n = high - low
                phrase = np.repeat(possible[alive], n)
                at = self.index.locate(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n))
                doc = np.searchsorted(self.starts, at, side="right") - 1
                begin = at - self.starts[doc]
                for d, b, p in zip(doc.tolist(), begin.tolist(), phrase.tolist(), strict=True):
                    spans[d].append((b, b + matrix.shape[1]))
                    items[d].update(block.owners[first + p])
        return [(merge(s), sorted(i)) for s, i in zip(spans, items, strict=True)]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans, and what stands between them."""
    at, kept, last = [m.span() for m in _WORD.finditer(text)], [], 0
    for start, end in spans:
        kept.append(text[last : at[start][0]])
        last = at[end - 1][1]
    return "".join(kept) + text[last:]


class Blocks:
    """The stored blocks of test items, read one after the other; the last one read stays in memory."""

    def __init__(self, files: list[str], size: int):
        self.files, self.size, self.held = files, size, {}

    def __iter__(self) -> Iterator[Phrases]:
        for path in self.files:
            store, name = fs.FileSystem.from_uri(path if ":" in path.partition("/")[0] else f"file://{path}")
            with store.open_input_file(name) as source:
                file = pq.ParquetFile(source)
                for k, batch in enumerate(file.iter_batches(batch_size=1)):
                    if (path, k) not in self.held:
                        self.held = {(path, k): Phrases(list(zip(batch.column(0)[0].as_py(), batch.column(1)[0].as_py(), strict=True)), self.size)}
                    yield self.held[path, k]


def store_items(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list[str]:
    """Write the test items in blocks of bounded size, each a row; returns the files."""
    spark = benchmark.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and size + len(t) > block_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([ids]), pa.array([texts])], names=["ids", "texts"])
                    ids, texts, size = [], [], 0
                ids.append(i or "None")
                texts.append(t)
                size += len(t)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([ids]), pa.array([texts])], names=["ids", "texts"])

    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null").distinct()
    path = shared_dir(spark, "items")
    rows.mapInArrow(run, "ids array<string>, texts array<string>").write.parquet(path)
    return sorted(spark.read.schema("ids array<string>, texts array<string>").parquet(path).inputFiles())


HITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
NEW = ("n_words", "hit_words", "hit_items")


def _cleaned(texts: list[str | None], found: list, blocks: Blocks) -> list[str | None]:
    """The texts without what was found, and without phrases that only arise where the rest meets."""
    texts, at = list(texts), [k for k, (spans, _) in enumerate(found) if spans]
    while at:
        for k in at:
            texts[k] = cut(texts[k], found[k][0])
        again = dict(zip(at, Shard([texts[k] for k in at]).search(blocks), strict=True))
        found = again
        at = [k for k in at if again[k][0]]
    return texts


def _found(docs: DataFrame, files: list[str], size: int, text: str, clean: bool) -> DataFrame:
    keep = [f for f in docs.schema if f.name.lower() not in NEW or f.name == text]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(files, size)

        def closed(shard: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = [t for b in shard for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            index = Shard(texts)
            found = index.search(blocks)
            if clean:
                texts = _cleaned(texts, found, blocks)
            done = 0
            for b in shard:
                own = slice(done, done + b.num_rows)
                columns = [b.column(b.schema.get_field_index(n)) for n in names]
                columns[names.index(text)] = pa.array(texts[own], columns[names.index(text)].type)
                hits = [[{"start": x, "end": y} for x, y in s] for s, _ in found[own]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(index.counts[own], pa.int64()), pa.array(hits, _HITS), pa.array([i for _, i in found[own]], pa.list_(pa.string()))], names=[*names, *NEW])
                done += b.num_rows

        shard, size_now = [], 0
        for batch in pieces(batches, 128):
            shard.append(batch)
            size_now += pa.compute.sum(pa.compute.binary_length(batch.column(batch.schema.get_field_index(text)))).as_py() or 0
            if size_now >= SHARD_BYTES:
                yield from closed(shard)
                shard, size_now = [], 0
        if shard:
            yield from closed(shard)

    return docs.mapInArrow(run, T.StructType([*keep, T.StructField("n_words", T.LongType()), T.StructField("hit_words", HITS), T.StructField("hit_items", T.ArrayType(T.StringType()))]))


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """docs with n_words, hit_words (merged spans of word numbers) and hit_items (ids as strings, sorted)."""
    return _found(docs, store_items(benchmark, item, item_text, block_bytes), size, text, False)


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """docs with the hit words cut from every text, until no phrase of any block is left; all rows and columns stay."""
    found = _found(apart(docs, text), store_items(benchmark, item, item_text, block_bytes), size, "text", True)
    return together(found, docs.columns, text)

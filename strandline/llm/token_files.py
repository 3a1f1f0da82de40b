"""Token ids in binary files: bit or byte planes of fixed-size blocks, each compressed, behind one index for each file.

A file holds the ids of documents one behind another. They are cut into blocks of `BLOCK` ids; a block is transposed into
planes, its first bits (or bytes) together, then its second ones, and so on, and each plane is compressed with zstandard. Ids
use few of their 32 bits, so the upper planes vanish: a plane of zeros is stored as nothing. The index behind the blocks has
for each block its place, number of ids, checksum and the sizes of its planes, and for each document its id and its first id's
place. So `Reader.ids(a, b)` reads and expands only the blocks that hold the ids a to b.

Layout, little-endian: MAGIC; the planes of all blocks; the index, compressed; its length (u64), the number of planes (u32),
MAGIC. The index: blocks (u64), documents (u64), then columns: place (u64), ids (u32), crc32 of the ids (u32) of each block,
sizes (u32) of each block's planes, id (i64), null (u8), start (u64) of each document.

Writing ranges documents by id, then by a hash of their texts, in one shuffle of the texts; each task encodes its range and
streams it to one file in the shared folder, a block at a time. Only files whose task succeeded are listed, so retries and lost
executors leave no doubles. The driver holds one row for each file, never one for each document.

Defined results: null texts are empty ones and have the end id alone; documents without id come last; rows that repeat an id
stand in the order of their texts' hashes; an empty table gives no file and no row; other columns are not read.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, shared_dir, stored

MAGIC = b"TIDPLN01"
BLOCK = 1 << 16
#: Planes by kind: one for each bit, or one for each byte of an id.
PLANES = {"bit": 32, "byte": 4}
LEVEL = 3
#: Parts that a worker remembers; beyond, all are forgotten.
CACHE = 1_000_000
#: Characters that end a part without changing what stands before them.
STOPS = ".,;:!?"
#: Rows that are encoded together.
ROWS = 1024
#: Ids that the reader hands on in one batch, unless one document has more.
HANDED = 1 << 20


_NONE = np.zeros(0, "<u4")


class Encoder:
    """Ids of texts as bytes, by the tokenizers library.

    A text is cut before each space that something other than white space follows, and a part before the stops that end it
    behind a letter. There the pre-tokenizer of byte-level BPE always begins a new piece, and nothing before it matters behind
    it. So parts are encoded once and remembered by what follows their space; new ones go to the library together."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Bytes of each token: a byte-level token has a character for each.
        self.sizes = np.array([len(self.tokenizer.id_to_token(k) or "") for k in range(self.tokenizer.get_vocab_size())], np.int64)
        #: Ids by what follows the space that a part begins with.
        self.known: dict[str, bytes] = {}
        self.wide, self.cut = re.compile(r" (?:\s|$)").search, re.compile(r" (?=\S)").split

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, with its space, from one call of the library for all of them behind one another."""
        if not parts:
            return []
        parts = [" " + p for p in parts]
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(self.sizes[ids])
        wanted = np.cumsum([len(p.encode("utf-8", "surrogatepass")) for p in parts])
        cuts = np.searchsorted(ends, wanted)
        if len(ids) == 0 or not np.array_equal(ends[np.minimum(cuts, len(ends) - 1)], wanted):
            return self.library(parts)  # the tokenizer is not byte-level: one call for each
        data, stops = ids.tobytes(), (4 * (cuts + 1)).tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def lookup(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts, each with its space. A word with stops is put together from both and not remembered; where
        there are too many known ones all go, for they can be learned again."""
        if len(self.known) + len(parts) > CACHE:
            self.known.clear()
        known, out = self.known, list(map(self.known.get, parts))
        new, words, stops = [], {}, {}
        for k in [k for k, ids in enumerate(out) if ids is None]:
            part = parts[k]
            word = part.rstrip(STOPS)
            if word != part and word[-1:].isalpha():
                words[k] = word
                stops[part[len(word) :]] = b""
                if word not in known:
                    known[word] = b""
                    new.append(word)
            elif part not in known:
                known[part] = b""
                new.append(part)
        stops = dict(zip(stops, self.library(list(stops)), strict=True))
        known.update(zip(new, self.apart(new), strict=True))
        for k, ids in enumerate(out):
            if not ids:
                out[k] = known[words[k]] + stops[parts[k][len(words[k]) :]] if k in words else known[parts[k]]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. The parts of all of them are split and told apart by Arrow, so that Python handles each distinct
        one once; their ids are then copied to where the parts stand."""
        if not texts:
            return []
        wide = [k for k, t in enumerate(texts) if self.wide(t)]
        if wide:
            found: list[np.ndarray] = [_NONE] * len(texts)
            rest = sorted(set(range(len(texts))) - set(wide))
            for k, ids in zip(rest, self.encode([texts[k] for k in rest]), strict=True):
                found[k] = ids
            rows = [self.cut(texts[k]) for k in wide]
            return self._placed([r[0] for r in rows], pa.array([p for r in rows for p in r], pa.string()), np.cumsum([0, *map(len, rows)]), found, wide)
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        return self._placed([t.partition(" ")[0] for t in texts], split.values, split.offsets.to_numpy().astype(np.int64), [_NONE] * len(texts), range(len(texts)))

    def _placed(self, firsts: list[str], parts: pa.Array, offsets: np.ndarray, out: list[np.ndarray], where: Iterable[int]) -> list[np.ndarray]:
        """out with the ids of the texts `where`, whose parts stand behind one another; a text's first part has no space."""
        coded = parts.dictionary_encode()
        number = coded.indices.to_numpy().copy()
        number[offsets[:-1]] = len(coded.dictionary) + np.arange(len(firsts), dtype=number.dtype)
        ids = self.lookup(coded.dictionary.to_pylist()) + self.library(firsts)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, begins = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        counts = sizes[number]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
        place = np.repeat((begins[number] - (ends - counts)).astype(kind), counts)
        place += np.arange(total, dtype=kind)
        whole = flat[place]
        bounds = np.concatenate([[0], ends])[offsets].tolist()
        for k, a, b in zip(where, bounds, bounds[1:], strict=False):
            out[k] = whole[a:b]
        return out


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def split_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of ids, lowest first."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        rows = np.unpackbits(rows, axis=1, bitorder="little")
        return [np.packbits(np.ascontiguousarray(rows[:, k]), bitorder="little").tobytes() for k in range(32)]
    return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(4)]


def join_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block from its planes; an empty plane is all zeros."""
    rows = np.zeros((n, len(planes)), np.uint8)
    for k, plane in enumerate(planes):
        if plane:
            data = np.frombuffer(plane, np.uint8)
            rows[:, k] = np.unpackbits(data, count=n, bitorder="little") if len(planes) == 32 else data
    if len(planes) == 32:
        rows = np.packbits(rows, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").reshape(-1)


class Writer:
    """Documents' ids to one file. Holds a block, and the index."""

    def __init__(self, sink: BinaryIO, kind: str = "byte", block: int = BLOCK):
        self.sink, self.kind, self.block = sink, kind, block
        self.squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        self.held, self.n_held, self.n_ids, self.place = [], 0, 0, len(MAGIC)
        self.blocks, self.sizes, self.docs = [], [], []
        sink.write(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append((0 if doc is None else doc, doc is None, self.n_ids))
        self.n_ids += len(ids)
        while len(ids):
            part, ids = ids[: self.block - self.n_held], ids[self.block - self.n_held :]
            self.held.append(part)
            self.n_held += len(part)
            if self.n_held == self.block:
                self._flush()

    def _flush(self) -> None:
        ids = np.concatenate(self.held)
        planes = [self.squeeze(p) if any(p) else b"" for p in split_planes(ids, self.kind)]
        data = b"".join(planes)
        self.sink.write(data)
        self.blocks.append((self.place, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        self.sizes.append([len(p) for p in planes])
        self.place += len(data)
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.n_held:
            self._flush()
        column = lambda rows, k, kind: np.array([r[k] for r in rows], kind).tobytes()
        index = struct.pack("<QQ", len(self.blocks), len(self.docs)) + column(self.blocks, 0, "<u8") + column(self.blocks, 1, "<u4") + column(self.blocks, 2, "<u4")
        index += np.array(self.sizes, "<u4").tobytes() + column(self.docs, 0, "<i8") + column(self.docs, 1, "u1") + column(self.docs, 2, "<u8")
        data = self.squeeze(index)
        self.sink.write(data + struct.pack("<QI", len(data), PLANES[self.kind]) + MAGIC)
        self.sink.close()


class Reader:
    """A file's documents, and the ids of any range. Reads the index first, then the blocks that are asked for, one at a time."""

    def __init__(self, source: BinaryIO):
        self.source, self.expand = source, zstandard.ZstdDecompressor()
        tail = 12 + len(MAGIC)
        source.seek(0, 2)
        end = source.tell()
        source.seek(max(0, end - tail))
        data = source.read(tail)
        if len(data) < tail or data[12:] != MAGIC:
            raise ValueError("not a whole file of token planes")
        length, self.planes = struct.unpack("<QI", data[:12])
        source.seek(end - tail - length)
        index = self.expand.decompress(source.read(length))
        self.n_blocks, self.n_docs = struct.unpack("<QQ", index[:16])
        at = 16

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(index, kind, n, at)
            at += out.nbytes
            return out

        self.place, self.count, self.crc = column("<u8", self.n_blocks), column("<u4", self.n_blocks), column("<u4", self.n_blocks)
        self.sizes = column("<u4", self.n_blocks * self.planes).reshape(-1, self.planes)
        self.doc, self.null, self.start = column("<i8", self.n_docs), column("u1", self.n_docs), column("<u8", self.n_docs)
        self.ends = np.cumsum(self.count.astype(np.int64))
        self.n_ids = int(self.ends[-1]) if self.n_blocks else 0
        self.at, self.held = -1, np.zeros(0, "<u4")

    def block(self, k: int) -> np.ndarray:
        if k != self.at:
            sizes = self.sizes[k].tolist()
            self.source.seek(int(self.place[k]))
            data, planes, at = self.source.read(sum(sizes)), [], 0
            for size in sizes:
                planes.append(self.expand.decompress(data[at : at + size]) if size else b"")
                at += size
            ids = join_planes(planes, int(self.count[k]))
            if zlib.crc32(ids.tobytes()) != int(self.crc[k]):
                raise ValueError(f"block {k} does not have its checksum")
            self.at, self.held = k, ids
        return self.held

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids of those places, from the blocks that hold them."""
        out = []
        k = int(np.searchsorted(self.ends, start, "right"))
        while start < min(stop, self.n_ids):
            first = int(self.ends[k]) - int(self.count[k])
            out.append(self.block(k)[start - first : stop - first])
            start = int(self.ends[k])
            k += 1
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, start, ids) of each document, in order."""
        stops = [*self.start[1:].tolist(), self.n_ids]
        for doc, null, start, stop in zip(self.doc.tolist(), self.null.tolist(), self.start.tolist(), stops, strict=True):
            yield None if null else doc, start, self.ids(start, stop)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path.partition("/")[0] else f"file://{path}")


def write(docs: DataFrame, path: str, end: int | None, key: str = "doc_id", text: str = "text", kind: str = "byte") -> DataFrame:
    """Encode the texts by the tokenizer file at path, each with the id `end` behind it (none if null), to files in the shared
    folder, by ascending id. Returns (file, path, first, ids, documents): first counts the ids of all files before."""
    if kind not in PLANES:
        raise ValueError(f"kind is one of {sorted(PLANES)}")
    spark = docs.sparkSession
    folder = shared_dir(spark, "tokens")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    order = [F.asc_nulls_last("id"), F.xxhash64("text").asc()]
    behind = np.array([] if end is None else [end], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, name = encoder(path).encode, None, ""
        for batch in pieces(batches, ROWS):
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                if writer is None:
                    store, top = _store(folder)
                    store.create_dir(top, recursive=True)
                    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
                    writer = Writer(store.open_output_stream(f"{top}/{name}", compression=None), kind)
                writer.add(doc, np.concatenate([ids, behind]))
        if writer is not None:
            writer.close()
            values = [[TaskContext.get().partitionId()], [f"{folder}/{name}"], [writer.n_ids], [len(writer.docs)]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "path", "ids", "documents"])

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    files = stored(ranged.mapInArrow(run, "file long, path string, ids long, documents long"), "token-files").orderBy("file").collect()
    first, out = 0, []
    for f in files:
        out.append((f["file"], f["path"], first, f["ids"], f["documents"]))
        first += f["ids"]
    return spark.createDataFrame(out, "file long, path string, first long, ids long, documents long")


def read(files: DataFrame) -> DataFrame:
    """(id, start, ids) of each document of the files: start counts all ids before it, ids are little-endian 32-bit numbers."""
    n = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = _store(path)
                with store.open_input_file(name) as source:
                    rows, size = [], 0
                    for doc, start, ids in Reader(source).documents():
                        rows.append((doc, first + start, ids.tobytes()))
                        size += len(ids)
                        if size >= HANDED or len(rows) >= 4096:
                            yield _rows(rows)
                            rows, size = [], 0
                    yield _rows(rows)

    return files.select("path", "first").repartition(n, "path").mapInArrow(run, "id long, start long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["id", "start", "ids"])

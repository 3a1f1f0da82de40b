"""Chunks of files by tokens: greedy windows of whole lines with an overlap, and semantic chunks by units.

Tokens are those of `files.count_tokens` of the chunk's own text. A line's characters, words and special characters are
counted once and summed up; words never go beyond a line, so the tokens of any stretch of lines come from differences of those
sums, and since they grow with the stretch a window's end is found by bisection. So a file takes time by its length, and
nothing leaves its row: narrow steps without a shuffle, a few megabytes of texts in memory.

As in the published rule, empty lines at the beginning of a window are no part of its text, and a window steps back over whole
lines until the overlap is reached. A line always gets ahead: where the overlap leaves no room for the next line, the next
window begins with that line.

Null and blank files have no semantic chunk; sliding windows of an empty text are one window without tokens, a null text has
none. Repeated rows are cut each.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import units as _units
from strandline.operators.batches import by_bytes
from strandline.operators.files import SPECIALS, WORDS, chunker_language

_WORDS, _SPECIALS = regex.compile(WORDS), regex.compile(SPECIALS)


def tokens(chars: int, words: int, specials: int) -> int:
    """The weighted estimate of `files.count_tokens`."""
    if not chars:
        return 0
    return max(1, -(-(-(-chars // 4) * 6 + -(-words * 13 // 10) * 3 + specials // 2) // 10))


@functools.cache
def _kinds() -> np.ndarray:
    """Of each code point whether it is a character of words (1) or special (2), by the patterns themselves."""
    kinds, every = np.zeros(0x110000, np.uint8), "".join(map(chr, range(0x110000)))
    for pattern, kind in ((_WORDS, 1), (_SPECIALS, 2)):
        for m in pattern.finditer(every):
            kinds[m.start() : m.end()] = kind
    return kinds


class Counts:
    """Running sums over the lines of a text. Words and special characters are counted for all its characters at once."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        codes = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _kinds()[codes]
        self._word = kinds == 1
        begins = self._word.copy()
        begins[1:] &= ~self._word[:-1]
        # of the characters before each one, and of all
        self._words, self._specials = (np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in (begins, kinds == 2))
        ends = np.append(np.flatnonzero(codes == 10), len(codes))
        chars = np.diff(ends, prepend=-1) - 1
        words, specials = self._words[ends], self._specials[ends]
        c, w, s = chars, np.diff(words, prepend=0), np.diff(specials, prepend=0)
        each = np.where(c > 0, np.maximum(1, -(-(-(-c // 4) * 6 + -(-w * 13 // 10) * 3 + s // 2) // 10)), 0)  # tokens of each line
        run = lambda n: [0, *np.cumsum(n).tolist()]
        self.chars, self.words, self.specials, self.each = run(chars), [0, *words.tolist()], [0, *specials.tolist()], run(each)
        self.filled = np.flatnonzero(chars).tolist()

    def part(self, start: int, stop: int) -> int:
        """Tokens of the characters from start to before stop; a word that is cut there counts."""
        stop = min(stop, len(self._word))
        if start >= stop:
            return 0
        cut = start > 0 and self._word[start] and self._word[start - 1]
        return tokens(stop - start, int(self._words[stop] - self._words[start]) + int(cut), int(self._specials[stop] - self._specials[start]))

    def whole(self, first: int, last: int) -> int:
        """Tokens of the lines first to last, joined."""
        return tokens(self.chars[last + 1] - self.chars[first] + last - first, self.words[last + 1] - self.words[first], self.specials[last + 1] - self.specials[first])

    def begin(self, first: int) -> int:
        """The first line from there on that is not empty; behind the last line if there is none."""
        k = bisect.bisect_left(self.filled, first)
        return self.filled[k] if k < len(self.filled) else len(self.lines)

    def window(self, first: int, last: int) -> int:
        """Tokens of a window: its lines without the empty ones it begins with."""
        begin = self.begin(first)
        return self.whole(begin, last) if begin <= last else 0

    def windows(self, most: int, overlap: int, least: int) -> list[tuple[int, int, int]]:
        """(first, last, tokens) of each window of at least that many tokens; all lines if there is none."""
        n, out, first = len(self.lines), [], 0
        while first < n:
            low = min(max(first, self.begin(first)), n - 1)
            last = low + bisect.bisect_right(range(low + 1, n), most, key=lambda j, first=first: self.window(first, j))
            size = self.window(first, last)
            if size >= least:
                out.append((first, last, size))
            if last + 1 == n:
                break
            back = bisect.bisect_right(self.each, self.each[last + 1] - overlap, 0, last + 2) - 1 if overlap > 0 else last + 1
            nxt = max(back, first + 1)
            first = nxt if self.window(nxt, last + 1) <= most else last + 1
        return out or [(0, n - 1, self.whole(0, n - 1))]

    def text(self, first: int, last: int, window: bool) -> str:
        return "\n".join(self.lines[self.begin(first) if window and self.begin(first) <= last else first : last + 1])


SLIDING = "chunk_index int, start_line int, end_line int, tokens int, chunk string"
SLIDING_KIND = pa.struct([("chunk_index", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("tokens", pa.int32()), ("chunk", pa.string())])


def sliding(text: str, most: int, overlap: int, least: int) -> list[tuple[int, int, int, int, str]]:
    """(index, first line, last line, tokens, chunk) of the windows of a text, lines from 1."""
    counts = Counts(text)
    found = counts.windows(most, overlap, least)
    whole = len(found) == 1 and found[0][:2] == (0, len(counts.lines) - 1) and found[0][2] < least
    return [(k, a + 1, b + 1, n, counts.text(a, b, not whole)) for k, (a, b, n) in enumerate(found)]


def chunk_sliding(files: DataFrame, most: int = 1600, overlap: int = 200, least: int = 50) -> DataFrame:
    """(doc_id, chunk_index, start_line, end_line, tokens, chunk) of the windows of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "content"):
            ids, rows = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is not None:
                    new = sliding(text, most, overlap, least)
                    ids += [doc] * len(new)
                    rows += new
            yield as_batch([pa.array(ids, batch.column(0).type)], ["doc_id"], rows, SLIDING_KIND)

    rows = files.select("doc_id", "content")
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, {SLIDING}")


def as_batch(arrays: list[pa.Array], names: list[str], rows: list[tuple], kind: pa.StructType) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kind)]
    return pa.RecordBatch.from_arrays([*arrays, *columns], names=[*names, *(f.name for f in kind)])


SEMANTIC = "chunk_index int, total_chunks int, name string, type string, namespace string, start_line int, end_line int, tokens int, chunk string"
SEMANTIC_KIND = pa.struct([("chunk_index", pa.int32()), ("total_chunks", pa.int32()), ("name", pa.string()), ("type", pa.string()), ("namespace", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("tokens", pa.int32()), ("chunk", pa.string())])


def semantic(text: str | None, path: str | None, ext: str | None, most: int, overlap: int, least: int) -> list[tuple]:
    """Rows of SEMANTIC: the chunks of a file. A unit up to `most` tokens is a chunk, a larger one is cut into windows, one below
    `least` goes. A file of which nothing is left is cut as a whole."""
    if not text or text.isspace():
        return []
    file = ((path or "").replace("\\", "/").rpartition("/")[2], "file", None)
    counts = Counts(text)
    out: list[tuple] = []

    def cut(part: str, first: int, label: tuple) -> None:
        out.extend((*label, first + a - 1, first + b - 1, n, chunk) for _, a, b, n, chunk in sliding(part, most, overlap, least))

    last = len(counts.lines)
    found = _units.units_of(text, ext or "", lambda a, b: counts.whole(a - 1, b - 1) > most)
    if not found and ext not in _units.CSHARP:
        found = [_units.Unit(file[0], "file", 1, last, None, 0, len(text))]
    for u in found:
        part, label = text[u.start : u.stop], (u.name, u.type, u.namespace)
        size = counts.part(u.start, u.stop)
        if size > most:
            cut(part, u.start_line, label)
        elif size >= least:
            out.append((*label, u.start_line, u.end_line, size, part))
    if not out:
        cut(text, 1, file)
    return [(k, len(out), *row) for k, row in enumerate(out)]


def chunk_corpus(files: DataFrame, most: int = 1600, overlap: int = 200, least: int = 50) -> DataFrame:
    """(doc_id, project_id, file_path, language, and SEMANTIC) of the semantic chunks of files (doc_id, project_id, file_path,
    ext, content). Index and total count within the file."""
    rows = files.select("doc_id", "project_id", "file_path", chunker_language(F.col("ext")).alias("language"), "ext", "content")
    kept = ("doc_id", "project_id", "file_path", "language")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "content"):
            at, out = [], []
            for k, (path, ext, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 4, 5)), strict=True)):
                new = semantic(text, path, ext, most, overlap, least)
                at += [k] * len(new)
                out += new
            yield as_batch([batch.column(k).take(pa.array(at, pa.int64())) for k in range(4)], list(kept), out, SEMANTIC_KIND)

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:4]) + f", {SEMANTIC}")



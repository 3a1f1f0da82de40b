"""Periodic runs: stretches of words that repeat with a period, found by block convolution.

The texts of a batch stand behind one another, words as numbers, with a number of its own between two texts. At each scale B
(a power of two) the sequence is cut into blocks of B words. A run of period q in [2B - 1, 4B - 2] holds a whole block among
its first q words, and that block again q words on. So for each block the sums of squared differences to all places of the
window that follows, 2B - 1 to 4B - 2 words on, are computed at once by a number-theoretic transform over the integers modulo
a prime; where a sum is zero the block occurs. That distance seeds an extension, which compares the words themselves to both
sides. So sums that are zero modulo the prime alone do no harm, and none that is zero is missed.

Two kinds of blocks have no transform, for they cannot add a run: those with a piece of `GRAM` words that does not come again
within the window, and those that lie with their window inside a run already found whose period is at most B (a block that
long recurs there at multiples of the period only, which are the same run).

A run is a maximal stretch with smallest period q and at least max(`LEAST`, 2q) words. Of periods with one stretch the
smallest is kept; scales ascend, so it comes first.

A narrow step: no shuffle, a batch of texts in memory. Defined results: null and empty texts have no words and no run; the
collapsed text joins the kept words by one space; repeated rows have equal results; other columns stay, but for those named as
the new ones, which are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import pieces

#: Words that a run has at least.
LEAST = 12
#: A prime with roots of unity of order 2^27, and a generator of its units.
PRIME, GENERATOR = 2013265921, 31
_P = np.uint64(PRIME)
#: Numbers that one batch of transforms holds.
HELD = 1 << 18
#: Words of a piece that has to come again within a block's window.
GRAM = 4
#: Rows of a batch whose texts stand in one sequence.
ROWS = 256
_FAR = np.int64(1 << 60)


@functools.lru_cache(maxsize=64)
def _roots(half: int, inverse: bool) -> np.ndarray:
    """Powers 0 to half - 1 of a root of unity of order 2 * half, as a column."""
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    out = np.ones(half, np.uint64)
    step, size = pow(root, PRIME - 2, PRIME) if inverse else root, 1
    while size < half:
        out[size : 2 * size] = out[:size] * np.uint64(step) % _P
        step, size = step * step % PRIME, 2 * size
    return out[:, None]


def _less(x: np.ndarray) -> np.ndarray:
    """x below 2 * PRIME, modulo PRIME: below PRIME the difference wraps round and is the larger."""
    return np.minimum(x, x - _P)


def transform(a: np.ndarray) -> np.ndarray:
    """Transforms of the columns of a, in bit-reversed order. Columns lie side by side, so each step runs over all of them."""
    n, m = a.shape
    half = n // 2
    while half:
        v = a.reshape(-1, 2, half, m)
        x, y = v[:, 0], v[:, 1]
        v[:, 0], v[:, 1] = _less(x + y), (x + (_P - y)) * _roots(half, False) % _P
        half //= 2
    return a


def back(a: np.ndarray) -> np.ndarray:
    """Columns from their transforms in bit-reversed order."""
    n, m = a.shape
    half = 1
    while half < n:
        v = a.reshape(-1, 2, half, m)
        x, y = v[:, 0], v[:, 1] * _roots(half, True) % _P
        v[:, 0], v[:, 1] = _less(x + y), _less(x + (_P - y))
        half *= 2
    return a * np.uint64(pow(n, PRIME - 2, PRIME)) % _P


def occurrences(words: np.ndarray, starts: np.ndarray, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of all zero sums of squared differences between a block of that size and the words low to high
    after its start. Words beyond the end count as PRIME - 1."""
    n, span = 4 * size, high - low + 1
    found_at, found_by = [], []
    step = max(1, HELD // n)
    for k in range(0, len(starts), step):
        at = starts[k : k + step]
        places = at + low + np.arange(span + size - 1)[:, None]
        inside = places < len(words)
        y = np.where(inside, words[np.where(inside, places, 0)], PRIME - 1).astype(np.uint64)
        x = words[at + np.arange(size)[:, None]].astype(np.uint64)
        a, b = np.zeros((n, len(at)), np.uint64), np.zeros((n, len(at)), np.uint64)
        a[-np.arange(size)] = x
        b[: len(y)] = y
        products = back(transform(a) * transform(b) % _P)[:span]
        squares = np.zeros((len(y) + 1, len(at)), np.uint64)
        np.cumsum(y * y % _P, axis=0, out=squares[1:])
        sums = (squares[size : size + span] - squares[:span]) % _P + (x * x % _P).sum(axis=0) % _P
        by, block = np.nonzero(sums % _P == 2 * products % _P)
        found_at.append(at[block])
        found_by.append(by + low)
    return (np.concatenate(found_at), np.concatenate(found_by)) if found_at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _reach(keys: np.ndarray) -> np.ndarray:
    """How far each key is from its next occurrence."""
    order = np.argsort(keys, kind="stable")
    out = np.full(len(keys), _FAR)
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _grams(words: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """A hash of the words from each place and of the text they are in. Equal hashes of unlike pieces only shorten a reach."""
    h = text.astype(np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([words[k:], np.full(k, PRIME - 1)]).astype(np.uint64)
        h ^= h >> np.uint64(29)
    return h


def _stretch(words: np.ndarray, at: int, by: int) -> tuple[int, int]:
    """The stretch [a, b) of places around `at` whose words are those `by` words on; empty if that does not hold at `at`."""
    ends = []
    for forward in (True, False):
        place, step = at, 64
        while True:
            stop = min(place + step, len(words) - by) if forward else max(place - step, 0)
            low, high = (place, stop) if forward else (stop, place)
            same = words[low:high] == words[low + by : high + by]
            if not forward:
                same = same[::-1]
            good = int(np.argmin(same)) if len(same) and not same.all() else max(len(same), 0)
            place += good if forward else -good
            if good < step:
                break
            step *= 4
        ends.append(place)
    return ends[1], ends[0]


def runs(words: np.ndarray, text: np.ndarray, longest: int, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start, then period. text: the number of the text that a word is in."""
    found: dict[tuple[int, int], int] = {}
    far = {size: _reach(_grams(words, text, size)) for size in (2, GRAM)} if longest >= least else {}
    size = 2
    while longest >= least and 2 * (2 * size - 1 if size > 2 else 1) <= longest:
        low, high = (2 * size - 1 if size > 2 else 1), 4 * size - 2
        gram = min(size, GRAM)
        whole = len(words) // size * size
        reach = far[gram][:whole].reshape(-1, size)[:, : size - gram + 1].max(axis=1)
        starts = np.flatnonzero(reach <= high) * size
        known = sorted((a, b) for (a, b), q in found.items() if q <= size)
        if known and len(starts):
            begins, ends = np.array(known).T
            before = np.searchsorted(begins, starts, "right") - 1
            covered = np.where(before >= 0, np.maximum.accumulate(ends)[before], 0)
            starts = starts[covered < starts + size + high]
        at, by = occurrences(words, starts, size, low, high)
        order = np.lexsort((at, by))
        last, stop = 0, 0
        for i, d in zip(at[order].tolist(), by[order].tolist(), strict=True):
            if d == last and i < stop:
                continue
            a, b = _stretch(words, i, d)
            last, stop = d, b
            if b - a + d >= max(least, 2 * d):
                found.setdefault((a, b + d), d)
        size *= 2
    return np.array(sorted((a, b, q) for (a, b), q in found.items()), np.int64).reshape(-1, 3)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


def of_texts(texts: list[str | None], least: int = LEAST) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(words, runs as rows (start, length, period)) of each text. Words are what ASCII white space leaves, as UTF-8."""
    split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    number = _Numbers()
    sizes = np.array([len(w) for w in split], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    sequence, text = np.zeros(int(sizes.sum()) + len(split), np.int64), np.zeros(int(sizes.sum()) + len(split), np.int64)
    for k, words in enumerate(split):
        a, b = int(begins[k]), int(begins[k] + sizes[k])
        sequence[a:b] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        text[a : b + 1] = k
    ends = begins + sizes
    sequence[ends] = len(number) + np.arange(len(split))
    every = runs(sequence, text, int(sizes.max(initial=0)), least)
    owner = np.searchsorted(begins, every[:, 0], "right") - 1
    cuts = np.searchsorted(owner, np.arange(len(split) + 1))
    for k, words in enumerate(split):
        mine = every[cuts[k] : cuts[k + 1]]
        yield words, np.stack([mine[:, 0] - begins[k], mine[:, 1] - mine[:, 0], mine[:, 2]], axis=1)


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if len(found):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, found[:, 0] + found[:, 2], 1)
        np.add.at(edge, found[:, 0] + found[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    return b" ".join(words)


def find(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with `runs`, an array of (start, length, period) by start, then period, and `collapsed`, the text without repeats."""
    names = ["runs", "collapsed"]
    kept = [f for f in docs.schema if f.name.lower() not in names]
    run = T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")])
    schema = T.StructType([*kept, T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, ROWS):
            ends, parts, texts = [0], [], []
            for words, found in of_texts(batch.column(batch.schema.get_field_index(text)).to_pylist(), least):
                ends.append(ends[-1] + len(found))
                parts.append(found)
                texts.append(collapsed(words, found))
            flat = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
            rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(texts, pa.binary()).cast(pa.string())], names=[*(f.name for f in kept), *names])

    return docs.mapInArrow(work, schema)

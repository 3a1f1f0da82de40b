"""Near duplicates: MinHash bands propose pairs, odd sketches verify them, full shingle sets confirm them.

Each document has its set of distinct word shingles, MinHash samples of it and an odd sketch: a parity bitmap into which the
samples are folded, so that the bits of two sketches' XOR estimate how many samples differ, sharply for high similarities.

1. Documents with equal sets are one class; only its smallest id goes on.
2. Classes that share a band of samples share a bucket. Each is compared with the smallest leader (smallest id) of its
   buckets: a star, never all pairs. Pairs whose sizes or sketches rule the threshold out go; the others are confirmed on the
   full sets of their texts.
3. What those links join are components. In buckets that hold several of them, members outside the largest one are compared
   with the members of other components, in blocks of bounded size that any number of tasks share: first each with its
   likeliest partner alone, then, in what is still apart, with all. So no bucket pair between components stays uncompared.
   Large buckets confirm their pairs inside the blocks, so rows grow with their members, not with pairs. Buckets crowded with
   unlike members are cut by a second band, so that texts and pairs of chance meetings do not move; those pairs of the whole
   bucket that share no second band meet by their sketches alone, so the same pairs are compared in buckets of every size.
4. Components again, over all confirmed links.

With 32 bands of 4 samples a pair of similarity 0.8 shares no band with a probability of 5e-8.

Defined results: null texts and texts without words have an empty set and stay by themselves; a text of fewer words than a
shingle is one shingle; repeated rows are equal copies; rows with a null id are returned, linked with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored
from .graph import components

BANDS, ROWS = 32, 4
SKETCH_BITS = 1024
#: Members, by weight, of one side of a block in which components are compared.
BLOCK = 1024
#: Shingles that weigh as much in a block as one member more.
WEIGHT = 1000
#: Members outside the largest component from which on a bucket is cut by a second band.
CROWD = 4096
#: Rounds in which a member is compared with its likeliest partner only, which join most of what the stars left apart.
BEST_ROUNDS = 1
#: Members of a bucket from which on pairs are confirmed inside its blocks.
LARGE = 256
#: Ids that are broadcast at most, 8 bytes each; beyond, a shuffled join does the same.
BROADCAST_IDS = 1_000_000
CACHE = 200_000

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_SALT = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Words(dict):
    """64-bit hash of each word; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, size: int, words: Words) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles. bytes.lower and bytes.split know ASCII letters and white space only."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    width = min(size, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def minhash(values: np.ndarray) -> np.ndarray:
    x, least = (values >> np.uint64(32)).astype(np.uint32), np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, (x[i : i + 1024, None] * _A + _B).min(axis=0), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * np.uint64(0xD6E8FEB86659FD93) + rows[:, k])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Bit p is the parity of the samples that fall on it."""
    at = (_mix(samples.astype(np.uint64) + _SALT) >> np.uint64(40)).astype(np.int64) % SKETCH_BITS
    parity = (np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def most_bits(threshold: float) -> int:
    """XOR bits that two sketches have at most if the sets are at least that similar: the mean and six deviations, of the
    samples that differ and of the bits that these toggle."""
    k, n = BANDS * ROWS, SKETCH_BITS
    toggles = 2 * k * (1 - threshold)
    mean = n / 2 * (1 - (1 - 2 / n) ** toggles)
    folded = n / 4 + n * (n - 1) / 4 * (1 - 4 / n) ** toggles - n * n / 4 * (1 - 2 / n) ** (2 * toggles)
    drawn = k * threshold * (1 - threshold) * (2 * (1 - 2 / n) ** toggles) ** 2
    return math.ceil(mean + 6 * math.sqrt(max(folded, 0) + drawn))


def signatures(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, n_shingles, set_id, bands, sketch) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in pieces(batches):
            n, sets, bands, sketches = [], [], [], []
            for t in batch.column(1).to_pylist():
                values = shingles(t, size, words)
                samples = minhash(values)
                n.append(len(values))
                sets.append(xxhash.xxh3_128_digest(values.tobytes()))
                bands.append(band_keys(samples) if len(values) else np.zeros(0, np.int64))
                sketches.append(odd_sketch(samples).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=["id", "n_shingles", "set_id", "bands", "sketch"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, set_id binary, bands array<long>, sketch array<long>")


def _possible(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, na, nb, sa, sb) that sizes and sketches do not rule out."""
    bits = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    percent = round(threshold * 100)
    return pairs.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (bits <= most_bits(threshold))).select("a", "b")


def only(docs: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """docs whose key is (or, with left_anti, is not) among ids(id): by a broadcast of checked size, else by a shuffled join."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    right = ids.select(F.col("id").alias("_wanted_id"))
    return docs.join(F.broadcast(right) if few else right, docs[key] == F.col("_wanted_id"), how)


def confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on the full sets of their texts."""
    pairs = stored(pairs, "pairs")
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    texts = only(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), ids, "k")
    both = pairs.join(texts.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in pieces(batches, 128):
            holds, seen = [], {}
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                for t in (ta, tb):
                    if t not in seen:
                        seen[t] = shingles(t, size, words)
                x, y = seen[ta], seen[tb]
                common = len(np.intersect1d(x, y, assume_unique=True))
                holds.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(holds, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def _places(members: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with component and weight, mixed buckets): the buckets that hold several components.

    A member weighs as much as its set is large, so blocks are bounded by bytes, too."""
    known = members.join(comps, members["rep"] == comps["node"], "left").select("bucket", "also", "rep", F.coalesce("component", "rep").alias("comp"), (1 + F.col("n_shingles") / WEIGHT).alias("weight"))
    parts = known.groupBy("bucket", "also", "comp").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    most = F.struct("n", "comp")
    mixed = parts.groupBy("bucket", "also").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("comp", most).alias("big"), F.sum("w").alias("w"), F.max_by("w", most).alias("w_big")).where("comps > 1")
    return known, mixed.select(F.col("bucket").alias("bk"), F.col("also").alias("al"), "n", "most", "big", F.ceil((F.col("w") - F.col("w_big")) / BLOCK).cast("int").alias("lefts"), F.ceil(F.col("w") / BLOCK).cast("int").alias("rights"))


def _stored_places(members: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    known, mixed = _places(members, comps)
    return known, stored(mixed, "mixed")


def _crowded() -> Column:
    return F.col("n") - F.col("most") > CROWD


def _cells(members: DataFrame, comps: DataFrame, classes: DataFrame, places: tuple[DataFrame, DataFrame] | None = None, rest: bool = False) -> DataFrame:
    """The blocks (bucket, also, i, j) in which members of different components meet, with n, the size of the bucket.

    side 0: members outside the largest component, each in one row i of blocks; 1 and 2: these again and those of the largest
    component, each in one column j. A crowded bucket, with very many members outside its largest component, is cut by a second
    band: its members meet only where they share another band (`also`) too, as linked ones do but for a share of 1e-7. rest: the
    crowded buckets alone, uncut, for the pairs of that share. places: what `_places` gives, its buckets stored."""
    at = lambda known, mixed: known.join(mixed, (F.col("bucket") == F.col("bk")) & (F.col("also") == F.col("al")))
    known, mixed = places or _stored_places(members, comps)
    rows = at(known, mixed.where(_crowded() if rest else ~_crowded()))
    if not rest and not mixed.where(_crowded()).isEmpty():
        dense = at(known, mixed.where(_crowded())).select("bucket", "rep").join(classes.select(F.col("rep").alias("r"), "bands", "n_shingles"), F.col("rep") == F.col("r"))
        cut = dense.select("bucket", F.explode("bands").alias("also"), "rep", "n_shingles").where("also <> bucket")
        rows = rows.unionByName(at(*_places(cut, comps)))
    rows = rows.join(classes.select(F.col("rep").alias("r"), "n_shingles", "sketch", "bands"), F.col("rep") == F.col("r"))
    left = F.pmod(F.xxhash64("rep"), F.col("lefts")).cast("int")
    right = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("rights")).cast("int")
    cells = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    small = F.col("comp") != F.col("big")
    as_left = rows.where(small).withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda j: cells(left, j)))).withColumn("side", F.lit(0))
    as_right = rows.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: cells(i, right)))).withColumn("side", F.when(small, 1).otherwise(2))
    return as_left.unionByName(as_right).select("bucket", "also", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "side", "rep", "comp", "n_shingles", "sketch", "bands", "n")


def _meetings(b: pa.Table, threshold: float, best: bool, alone: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """For each left member of a block, the places of the right members that may be linked with it.

    best: the likeliest one alone. Else a pair counts in the first bucket that both have, and there in one of its blocks. alone:
    pairs that have this bucket only in common."""
    bits, percent = most_bits(threshold), round(threshold * 100)
    side, rep, comp, n = (b.column(k).to_numpy() for k in (4, 5, 6, 7))
    sketch = b.column(8).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(rep), -1)  # unsigned, so that the count is of all bits
    bands = b.column(9).combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
    bucket, also = b.column(0)[0].as_py(), b.column(1)[0].as_py()
    lefts, rights = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
    for x in lefts.tolist():
        y = rights[(comp[rights] != comp[x]) & ((side[rights] == 2) | (rep[rights] > rep[x]) | best) & (np.minimum(n[x], n[rights]) * 100 >= np.maximum(n[x], n[rights]) * percent)]
        apart = np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1)
        if best:
            y = y[[np.argmin(apart)]] if len(y) and apart.min() <= bits else y[:0]
        else:
            y = y[apart <= bits]
            if len(y):
                same = bands[y] == bands[x]
                if alone:
                    same[same.sum(axis=1) > 1] = False
                    y, same = y[same.any(axis=1)], same[same.any(axis=1)]
                first = bands[x][np.argmax(same, axis=1)] == bucket
                if also != bucket:  # and in the first other band that both have
                    first &= bands[x][np.argmax(same & (bands[x] != bucket), axis=1)] == also
                y = y[first]
        yield x, y


def _between(cells: DataFrame, threshold: float, best: bool, alone: bool = False) -> DataFrame:
    """Candidate pairs (a, b) of the blocks."""
    blocks = cells.drop("n").repartition("bucket", "also", "i", "j").sortWithinPartitions("bucket", "also", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for cell in by_group(batches, 4):
            rep = cell.column(5).to_numpy()
            for x, y in _meetings(cell, threshold, best, alone):
                held.append((np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])))
                size += len(y)
            if size >= 65_536:
                yield _pairs(held)
                held, size = [], 0
        yield _pairs(held)

    return blocks.mapInArrow(run, "a long, b long").distinct()


def _inside(cells: DataFrame, docs: DataFrame, key: str, text: str, size: int, threshold: float) -> DataFrame:
    """Links (a, b) of the blocks of large buckets: the members' texts go to the blocks, so pairs never leave them."""
    cells = stored(cells.drop("n"), "large")
    texts = only(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where(F.col(key).isNotNull()), stored(cells.select(F.col("rep").alias("id")).distinct(), "ids"), "k")
    every = texts.distinct()  # an id may have several texts, and each may be the linked one
    blocks = cells.join(every, F.col("rep") == F.col("k")).drop("k").repartition("bucket", "also", "i", "j").sortWithinPartitions("bucket", "also", "i", "j")
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for cell in by_group(batches, 4):
            rep, found = cell.column(5).to_numpy(), []
            sets: dict[int, np.ndarray] = {}

            def of(k: int, cell: pa.Table = cell, sets: dict[int, np.ndarray] = sets) -> np.ndarray:
                if k not in sets:
                    sets[k] = shingles(cell.column(10)[k].as_py(), size, words)
                return sets[k]

            for x, ys in _meetings(cell, threshold, False):
                for y in ys.tolist():
                    common = len(np.intersect1d(of(x), of(y), assume_unique=True))
                    if 100 * common >= percent * (len(of(x)) + len(of(y)) - common):
                        found.append((np.array([min(rep[x], rep[y])]), np.array([max(rep[x], rep[y])])))
            yield _pairs(found)

    return blocks.mapInArrow(run, "a long, b long").distinct()


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Each pair of the list once."""
    both = np.unique(np.stack([np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])


def by_group(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Rows of equal leading columns (whole numbers), from sorted batches; one group in memory at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(n_keys)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[:, start].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def classes_of(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, n_shingles, component_id) of every row; component_id: smallest id that links of at least the threshold reach."""
    signed = stored(signatures(docs, key, text, size), "signatures")
    full = signed.where("n_shingles > 0 and id is not null")
    classes = stored(full.groupBy("set_id").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    banded = classes.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    stars = banded.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1").select(F.col("bucket").alias("b"), "leader")
    members = stored(banded.join(stars, F.col("bucket") == F.col("b")).select("bucket", F.col("bucket").alias("also"), "rep", "n_shingles", "leader"), "members")
    side = lambda s: classes.select(F.col("rep").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    pairs = members.groupBy("rep").agg(F.min("leader").alias("a")).where("a <> rep").select("a", F.col("rep").alias("b"))
    exact = lambda pairs: stored(confirmed(pairs, docs, key, text, size, threshold), "confirmed")
    links = exact(_possible(pairs.join(side("a"), "a").join(side("b"), "b"), threshold))
    comps = components(links)
    for _ in range(BEST_ROUNDS):
        more = exact(_between(_cells(members, comps, classes), threshold, True))
        if more.isEmpty():
            break
        links = links.union(more)
        comps = components(links)
    places = _stored_places(members, comps)
    cells = _cells(members, comps, classes, places)
    more = exact(_between(cells.where(F.col("n") < LARGE), threshold, False)).union(stored(_inside(cells.where(F.col("n") >= LARGE), docs, key, text, size, threshold), "inside"))
    if not places[1].where(_crowded()).isEmpty():
        more = more.union(exact(_between(_cells(members, comps, classes, places, rest=True), threshold, False, alone=True)))
    if not more.isEmpty():
        comps = components(links.union(more))
    reps = classes.select(F.col("set_id").alias("s"), "rep").join(comps, F.col("rep") == F.col("node"), "left").select("s", F.coalesce("component", "rep").alias("component"))
    return signed.select("id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("set_id")).alias("set_id")).join(reps, F.col("set_id") == F.col("s"), "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))

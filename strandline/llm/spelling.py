"""Spelling variants: words of a corpus that are one edit apart, grouped by asymmetric q-chunks.

Of two words one contributes two disjoint chunks, its halves, and the other its positional grams. One edit leaves one of the
halves whole, and that half stands in the other word as a gram, at most one place from where it was. So a join on chunk, the
shorter word's length and place finds every pair, and Spark's levenshtein verifies it. The shorter word of a pair (either, if
they are equally long) gives the chunks, so the edit is a replacement or an insertion and each word needs the grams that stand
where a chunk of an equally long or one shorter word can: grams further off than one place meet no chunk and are not built.

A chunk that many words share (a common beginning or ending) would make a bucket of many pairs. Where both sides of a bucket
have more than `CROWD` rows it is cut: the edit lies in the half that was not compared, so that half is cut in two in the same
way, and one of the two is whole again. Rows then meet where three quarters agree, then seven eighths, and so on; with all
places but one the same a bucket is bounded by the alphabet. So pairs grow with the rows, and no pair is left out.

Defined results: null texts have no words; words of a row without id are taken as they stand; null words or counts of the word
table do not count; repeated words of it are one, with the sum of their counts; empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored

#: Letters of a word.
LETTERS = "A-Za-zÀ-ÿ"
#: Rows on both sides of a bucket above which it is cut.
CROWD = 32
#: Buckets to cut that are broadcast at most, 8 bytes each; beyond, a shuffled join does the same.
BROADCAST_KEYS = 500_000
#: Words that a task counts before it hands the counts on.
HELD = 200_000
#: Change of one word of a document: the word afterwards, given the document's id and the word.
Change = Callable[[int, str], str]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 5, least: int = 3, change: Change | None = None) -> DataFrame:
    """(word, n) of the words, with A-Z in lower case, that have at least that many code points and occurrences in all texts.
    change is asked once for each distinct word of a text. Counts are combined in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts = re.compile(f"[{LETTERS}]{{{shortest},}}").findall, Counter()
        for batch in pieces(batches):
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                mine = Counter(find(t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                if change and doc is not None:
                    for word in list(mine):
                        other = change(doc, word)
                        if other != word:
                            counts[other] += mine.pop(word)
                counts.update(mine)
                if len(counts) >= HELD:
                    yield _counted(counts, shortest)
                    counts = Counter()
        yield _counted(counts, shortest)

    found = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _counted(counts: Counter, shortest: int) -> pa.RecordBatch:
    kept = {w: n for w, n in counts.items() if len(w) >= shortest}
    return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(kept.values(), pa.int64())], names=["word", "n"])


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (side, word, n, size, f, r) with key, of the part outside the r places from f on, where the edit is.

    size is the length of the word that gives the chunks. A gram's word is `more` (0 or 1) places longer, and so is its part
    with the edit; behind that part its letters stand one place further on."""
    more = F.length("word") - F.col("size")
    parts = F.substr("word", F.lit(1), F.col("f")), F.substr("word", F.col("f") + F.col("r") + more + 1, F.length("word"))
    return rows.withColumn("key", F.xxhash64(*parts, "size", "f", "r"))


def _halves(f: Column, r: Column) -> Column:
    """The part of r places from f on, cut in two: the edit is in one half, and the other is whole."""
    left = F.floor(r / 2).cast("int")
    return F.array(F.struct(f.alias("f"), left.alias("r")), F.struct((f + left).alias("f"), (r - left).alias("r")))


def _cut(rows: DataFrame) -> DataFrame:
    return _keyed(rows.withColumn("part", F.explode(_halves(F.col("f"), F.col("r")))).where("part.r > 0").select("side", "word", "n", "size", F.col("part.f").alias("f"), F.col("part.r").alias("r")))


def pairs(words: DataFrame) -> DataFrame:
    """(a, b, na, nb) of all words that are one edit apart, each pair once; a is the shorter word."""
    length = F.length("word")
    whole = lambda side, size: words.select(F.lit(side).alias("side"), "word", "n", size.alias("size"), F.lit(0).alias("f"), size.alias("r"))
    rows = stored(_cut(whole(0, length).unionByName(whole(1, length)).unionByName(whole(1, length - 1))), "chunks")
    found = None
    while True:
        is_gram = F.col("side") == 1
        crowds = rows.groupBy("key").agg(F.count_if(~is_gram).alias("chunks"), F.count_if(is_gram).alias("grams"), F.max("r").alias("r"))
        crowds = stored(crowds.where(f"least(chunks, grams) > {CROWD} and r > 1").select(F.col("key").alias("crowded")), "crowds")
        n = crowds.limit(BROADCAST_KEYS + 1).count()
        held = F.broadcast(crowds) if n <= BROADCAST_KEYS else crowds
        now = rows.join(held, F.col("key") == F.col("crowded"), "left_anti") if n else rows
        side = lambda s, w, c: now.where(F.col("side") == s).select("key", F.col("word").alias(w), F.col("n").alias(c))
        met = side(0, "a", "na").join(side(1, "b", "nb"), "key").where((F.length("a") < F.length("b")) | (F.col("a") < F.col("b")))
        met = stored(met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b", "na", "nb"), "near")
        found = met if found is None else found.unionByName(met)
        if not n:
            return found.distinct()
        rows = stored(_cut(rows.join(held, F.col("key") == F.col("crowded"), "left_semi").drop("key")), "chunks")


def group(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of words (word, n).

    form: the near word with the largest n (of equal ones the smallest), if that is at least `times` the word's own n; root:
    the word at the end of the forms, itself if it has none. n at least doubles from form to form, so they end, and each step
    doubles how far a word has followed them."""
    words = stored(words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    near = pairs(words)
    both = near.select(F.col("a").alias("w"), "b", "nb").unionAll(near.select(F.col("b").alias("w"), F.col("a").alias("b"), F.col("na").alias("nb")))
    best = both.groupBy("w").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("minus"), F.col("b").alias("form"))).alias("best"))
    large = -F.col("best.minus") >= F.col("n") * max(times, 2)
    found = words.join(best, F.col("word") == F.col("w"), "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(large, F.col("best.form")).alias("form"), F.when(large, -F.col("best.minus")).alias("form_n"))
    found = stored(found, "forms")
    links = found.where("form is not null").select(F.col("word").alias("at"), F.col("form").alias("root"))
    while True:
        ahead = links.select(F.col("at").alias("from"), F.col("root").alias("next"))
        links = stored(links.join(ahead, F.col("root") == F.col("from"), "left").select("at", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            break
        links = links.select("at", "root")
    return found.join(links.select("at", "root"), F.col("word") == F.col("at"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

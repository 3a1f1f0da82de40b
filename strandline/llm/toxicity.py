"""Toxicity by multiple-instance learning: a document is toxic if at least one of its sentences is.

A sentence's score is a logistic function of its words, each known by itself and by its beginnings and ends (so inflected and
compound forms share what is learned). The weights are trained from document labels alone, by gradient ascent on the likelihood
of a noisy-or of the sentence scores, 1 - prod(1 - p); afterwards the same sentence scores locate the offending sentences.

A document's score is that of its most toxic sentence. The noisy-or is for training only: beyond the lengths of the sample it
would rise with the number of sentences alone, whatever they say. Pieces without a word are no sentences in either.

The classifier is fitted on a bounded sample: at most `sample` labelled documents, first by a hash of the id, each of at most
`sample_words` words (longer ones are not drawn). Everything else covers all rows. Scoring is a narrow step.

Defined results: null and empty texts have no sentence and score 0; without any label every score is 0; of several labels for
a document the largest counts; null labels do not count; repeated rows are scored each.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
#: A sentence of a higher score is reported as offending.
OFFENDING = 0.5


#: Letters of the beginnings and ends of a word that are features, and documents that a feature must be in.
AFFIX, SEEN = (3, 4, 5, 6), 3
#: Words whose weights a worker remembers; a full memory is emptied.
CACHE = 200_000


def features(word: str) -> list[str]:
    """The word itself, its beginnings and its ends."""
    return [word, *(f"{word[:k]}*" for k in AFFIX if len(word) > k), *(f"*{word[-k:]}" for k in AFFIX if len(word) > k)]


@dataclass(frozen=True)
class Model:
    """Weight of each feature that has one, and the score of a sentence with none of them, as a logit."""

    weights: dict[str, float]
    bias: float
    _words: dict[str, float] = field(default_factory=dict, compare=False)

    def weight(self, word: str) -> float:
        known = self._words.get(word)
        if known is None:
            if len(self._words) >= CACHE:
                self._words.clear()
            known = self._words[word] = sum(self.weights.get(f, 0.0) for f in features(word[:80]))
        return known

    def sentences(self, text: str) -> Iterator[tuple[int, int, float]]:
        """Start, end and logit of each sentence that has a word with a weight; all others have the logit `bias`."""
        for m in SENTENCE.finditer(text):
            hits = sorted(filter(None, map(self.weight, set(WORD.findall(m[0].lower())))))
            if hits:
                yield m.start(), m.end(), self.bias + sum(hits)

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and the offending sentences."""
        if not text or not WORD.search(text):
            return 0.0, []
        most, spans = float(1 / (1 + np.exp(-self.bias))), []
        for start, end, logit in self.sentences(text):
            p = float(1 / (1 + np.exp(-logit)))
            most = max(most, p)
            if p > OFFENDING:
                spans.append((start, end, p))
        return most, spans


def _sampled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int, sample_words: int) -> list:
    """Rows (label, text) of the training sample: at most `sample` rows, however often an id repeats. Each partition keeps the
    first ones by hash, and these are merged; no sort of all texts."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_label"))
    chosen = marks.orderBy(F.xxhash64(key), key).limit(sample)
    rows = docs.select(key, F.col(text).alias("_text")).where(F.col(text).isNotNull()).join(chosen, key)
    size = F.length("_text") - F.length(F.translate("_text", " \n\t", "")) + 1
    return rows.where(size <= sample_words).select("_label", "_text").orderBy(F.xxhash64("_text"), "_label").limit(sample).collect()


def _gather(values: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each of the rows, one after another, and how many each has; row i's values begin at first[i]."""
    n = first[rows + 1] - first[rows]
    starts = np.cumsum(n, dtype=np.int64) - n
    return values[np.repeat(first[rows] - starts, n) + np.arange(int(n.sum()))], n


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 4000, sample_words: int = 4000, rounds: int = 200) -> Model:
    """Fit the sentence model on a bounded sample of the labelled documents."""
    rows = _sampled(docs, labels, key, text, label, sample, sample_words)
    y = np.array([float(row["_label"] > 0) for row in rows])
    if not y.any():
        return Model({}, -40.0)
    # a text becomes numbers at once: the words of its sentences, sorted; the driver holds each distinct word and feature once
    words: dict[str, int] = {}
    word_of, length, doc_of = array("i"), array("i"), array("i")
    for d in range(len(rows)):
        for sentence in SENTENCE.findall(rows[d]["_text"].lower()):
            own = sorted(set(WORD.findall(sentence)))
            if own:
                word_of.extend([words.setdefault(w, len(words)) for w in own])
                length.append(len(own))
                doc_of.append(d)
        rows[d] = None
    del rows
    features_of = array("i")
    known: dict[str, int] = {}
    first = array("i", [0])
    for w in words:
        features_of.extend([known.setdefault(f, len(known)) for f in features(w[:80])])
        first.append(len(features_of))
    del words
    word_of, length, doc_of, features_of, first = (np.asarray(x) for x in (word_of, length, doc_of, features_of, first))
    sentence_of = np.repeat(np.arange(len(length), dtype=np.int32), length)
    ends = np.searchsorted(doc_of[sentence_of], np.arange(len(y) + 1))
    seen, toxic = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
    for d in range(len(y)):
        own = np.unique(_gather(features_of, first, np.unique(word_of[ends[d] : ends[d + 1]]))[0])
        seen[own] += 1
        if y[d]:
            toxic[own] += 1
    # a feature of few toxic documents says nothing of others; one that toxic documents have no more often cannot help
    base = y.sum() / len(y)
    kept = (toxic >= SEEN) & (toxic > min(3 * base, (1 + base) / 2) * seen)
    names = sorted((f, i) for f, i in known.items() if kept[i])
    del known, seen, toxic
    ids = np.full(len(kept), -1, np.int32)
    ids[[i for _, i in names]] = np.arange(len(names), dtype=np.int32)
    names = [f for f, _ in names]
    # of each word the features that are left
    left = ids[features_of] >= 0
    first = np.concatenate([[0], np.cumsum(left)])[first].astype(np.int32)
    flat, taken = _gather(ids[features_of[left]], first, word_of)
    inner, n_sentences = np.repeat(sentence_of, taken), len(length)
    del word_of, features_of, first, left, taken, sentence_of
    w, b = np.zeros(len(names)), -4.0
    g2, gb2 = np.full(len(names), 1e-3), 1e-3
    for _ in range(rounds):
        z = b + np.bincount(inner, weights=w[flat], minlength=n_sentences)
        p = np.clip(1 / (1 + np.exp(-np.clip(z, -50, 50))), 1e-12, 1 - 1e-12)
        clean = np.bincount(doc_of, weights=np.log1p(-p), minlength=len(y))
        found = np.clip(-np.expm1(clean), 1e-9, 1.0)
        # d log-likelihood / dz: -p for a clean document, p (1 - P) / P for a toxic one
        pull = np.where(y > 0, np.exp(clean) / found, -1.0)
        dz = p * pull[doc_of]
        gw = np.bincount(flat, weights=dz[inner], minlength=len(names)) - 0.02 * w
        gb = dz.sum()
        g2 += gw * gw
        gb2 += gb * gb
        w += 0.5 * gw / np.sqrt(g2)
        b += 0.5 * gb / np.sqrt(gb2)
        w = np.sign(w) * np.maximum(np.abs(w) - 0.05 / np.sqrt(g2), 0)  # most features mean nothing: proximal step of an L1 term
    return Model({names[i]: float(w[i]) for i in np.flatnonzero(w)}, float(b))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with toxicity (0 to 1) and toxic_spans, the offending sentences (code points, end exclusive)."""
    keep = [f for f in docs.schema if f.name.lower() not in ("toxicity", "toxic_spans")]
    names = [f.name for f in keep]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [model.score(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in s] for _, s in found]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([p for p, _ in found], pa.float64()), pa.array(spans, kind)], names=[*names, "toxicity", "toxic_spans"])

    return docs.mapInArrow(run, T.StructType([*keep, T.StructField("toxicity", T.DoubleType()), T.StructField("toxic_spans", SPANS)]))


def held_out(key: Column) -> Column:
    """The fold that is never learned from; a row without a key is not in it, and has no label either."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))

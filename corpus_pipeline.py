"""A training corpus from documents: toxic ones go, one of each group of near copies stays, benchmark passages are cut out,
personal data is masked, and the texts are encoded. Each stage takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, decontaminate, near_dup, pii, toxicity
from strandline.llm.common import apart, stored, table, together
from strandline.llm.queries import VOCABULARY

#: Documents of a higher score are rejected.
TOXIC = 0.5
#: The row number by which near-dedup decides.
ROW = "_strandline_row"


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at most TOXIC. Learned from the labels of the training folds, as the query does."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(apart(docs), toxicity.train(docs, labels))
    return together(scored.where(F.col("toxicity") <= TOXIC), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles and a similarity of 0.8 join, the one with the smallest id.

    Decided by row, for ids may repeat or be null: rows are numbered in the order of their ids, null ids last, and the numbers
    stored, so the smallest number of a group is a row of its smallest id. Rows of one id are dealt by their texts and places."""
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text"), F.col(ROW)]
    numbered = docs.withColumn(ROW, F.monotonically_increasing_id()).orderBy(order).withColumn(ROW, F.monotonically_increasing_id())
    rows = stored(numbered, "rows")
    found = near_dup.classes_of(rows, key=ROW, size=5, threshold=0.8)
    gone = stored(found.where("id <> component_id").select("id"), "copies")
    return near_dup.only(rows, gone, ROW, "left_anti").select(docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that they share with the benchmark."""
    return _sized(decontaminate.remove(docs, table(spark, sf_dir, "benchmark", "item_id", "text")))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return _sized(together(pii.mask(pii.find(apart(docs))), docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their tokens, token_ids."""
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", cut_benchmark), ("pii", mask_personal), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again, so a lost executor costs one stage at most."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained scores, estimated similarities and merges are no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None

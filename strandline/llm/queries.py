"""The registered queries of this subpackage and their SQL: each runs its operator over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontaminate, html_extract, near_dup, periodic, pii, spelling, suffix_dedup, token_files, toxicity, warc
from .common import table
from .oracle import ORACLE_SQL  # noqa: F401

#: The vocabulary file; its path is a parameter of the operator.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The tokenizer file of the token files, a parameter as well.
TOKENIZER = "byte_bpe_50k.json"


def sha256(text) -> F.Column:
    return F.sha2(text, 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    ids = bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"), path, pattern).drop("text")
    decoded = bpe.decode(ids, path, pattern)
    return decoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), sha256(F.array_join(F.col("token_ids").cast("array<string>"), ",")).alias("ids_sha256"), sha256("decoded").alias("decoded_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "pii")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["kind"].isin([k.name for k in pii.BASE]))
    scores = F.transform("pii", lambda s: F.round(s["score"], 2)).alias("scores")
    return found.select("doc_id", *(count(k.name) for k in pii.BASE), sha256(pii.as_text(base)).alias("base_sha256"), pii.as_text(F.col("pii")).alias("spans"), scores)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"), "toxic_spans")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), sha256(F.array_join("hit_items", ",")).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = suffix_dedup.mark(table(spark, sf_dir, "documents", "doc_id", "text"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return marked.select(F.col("id").alias("doc_id"), "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), sha256("kept").alias("kept_sha256"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.classes_of(table(spark, sf_dir, "documents", "doc_id", "text"), size=2, threshold=0.8)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write(table(spark, sf_dir, "pages", "page_id", "url", "html"), least=0)
    ends = warc.read(files, data=False).where("is_last")
    whole = lambda read, declared: F.when(F.col("record_type") == "response", F.col(read)).otherwise(F.col(declared))
    return ends.select("page_id", whole("bytes_so_far", "declared_bytes").alias("payload_bytes"), whole("digest_so_far", "declared_digest").alias("payload_digest"), "record_type", "refers_to")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages", "page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    vocabulary = (public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return chat.read_back(chat.windows(turns.unionByName(more), vocabulary))


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) where one text in ten ends in a periodic tail: words from place a on repeat those from a on, p apart."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.withColumn("h", h).withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    tails = words.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int"))
    tails = tails.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    once = F.slice("words", F.col("a") + 1, F.col("p"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(once, times)), F.lit(1), F.col("n") - F.col("a"))
    return tails.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(planted(table(spark, sf_dir, "documents", "doc_id", "text"))).drop("text")
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), sha256(lines).alias("runs_sha256"), sha256("collapsed").alias("collapsed_sha256"))
    length = -F.col("longest.minus")
    return found.select("doc_id", "n_runs", F.col("longest.start").alias("start"), length.alias("length"), F.col("longest.period").alias("period"), F.floor(1000 * length / F.col("longest.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def misspelt(doc: int, word: str) -> str:
    """The word as the query counts it: one in 97 words of a document lacks a letter."""
    h = zlib.crc32(f"{doc}:{word}".encode())
    at = h % len(word)
    return word if h % 97 else word[:at] + word[at + 1 :]


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents", "doc_id", "text"), shortest=5, least=3, change=misspelt)
    return spelling.group(words, times=2).select("word", "form", "root", "n", "n_near", "form_n")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(TOKENIZER), end=2)
    return token_files.read(files).select(F.col("id").alias("doc_id"), "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_pii, op3_toxicity, op4_decontaminate, op5_suffix_dedup, op6_near_dup, op7_ann, op8_warc, op9_html, op10_chat, op11_periodic, op12_spelling, op13_token_files)
}

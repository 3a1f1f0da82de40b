"""Checks before work begins: uploads, quotas and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.rules import SOURCE_EXTENSIONS


def preflight(requests: DataFrame, quotas: DataFrame, most_bytes: int = 1 << 30, most_files: int = 50_000) -> DataFrame:
    """requests (request_id, org_id, compressed_bytes) with estimates and a decision; the first rule that applies decides."""
    rows = requests.join(quotas, "org_id", "left").withColumn("bytes", F.col("compressed_bytes") * 4).withColumn("files", F.floor(F.col("bytes") / 5000))
    cost = (F.col("bytes") / 4 * F.lit("0.00003").cast("decimal(12,8)")).cast("decimal(18,5)")
    decision = F.when(F.col("compressed_bytes").isNull(), "source_missing").when(F.col("bytes") > most_bytes, "repository_too_large").when(F.col("files") > most_files, "too_many_files")
    decision = decision.when(F.coalesce("suspended", F.lit(False)), "suspended").when(F.coalesce("credits", F.lit(0)) < cost, "insufficient_credits").otherwise("accepted")
    return rows.select("request_id", "bytes", "files", cost.alias("cost"), decision.alias("decision"))


def archive_sizes(entries: DataFrame, key: str = "path") -> DataFrame:
    """Per archive: files, bytes, the largest file, and bytes of code. entries: key, ext, size_bytes."""
    code = F.when(F.col("ext").isin(*SOURCE_EXTENSIONS), F.col("size_bytes")).otherwise(0)
    return entries.groupBy(key).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.max("size_bytes").alias("largest"), F.sum(code).alias("code_bytes"))


def preflight_archives(entries: DataFrame, quotas: DataFrame, most_files: int = 50_000, most_file: int = 100 << 20, most_bytes: int = 1 << 30) -> DataFrame:
    """Archives by their listed entries (path, org_id, ext, size_bytes; a path without readable entries has one with a null size),
    with sizes, tokens, cost and a decision: the first rule that applies decides.

    Tokens are a quarter of the bytes of code, or of all bytes if none is code; the cost is that of embedding them, a tenth of it
    for reasoning, and a thousandth of a dollar for each file."""
    bad = entries.groupBy(F.col("path").alias("p")).agg(F.bool_or(F.col("size_bytes").isNull()).alias("bad"), F.first("org_id").alias("org_id"))
    rows = archive_sizes(entries.where("size_bytes is not null")).join(bad, F.col("path") == F.col("p"), "right").join(quotas, "org_id", "left")
    basis = F.when(F.col("code_bytes") > 0, F.col("code_bytes")).otherwise(F.coalesce("bytes", F.lit(0)))
    tokens = F.floor(basis * 0.25)
    embedding = tokens.cast("decimal(20,0)") * F.lit("0.00003").cast("decimal(8,5)")
    cost = (embedding * F.lit("1.1").cast("decimal(3,1)") + F.coalesce("files", F.lit(0)).cast("decimal(20,0)") * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(18,5)")
    decision = F.when(F.col("bad"), "invalid_source").when(F.col("files") > most_files, "too_many_files").when(F.col("largest") > most_file, "file_too_large").when(F.col("bytes") > most_bytes, "repository_too_large")
    decision = decision.when(F.coalesce("suspended", F.lit(False)), "suspended").when(F.coalesce("credits", F.lit(0)) < cost, "insufficient_credits").otherwise("accepted")
    return rows.select(F.col("p").alias("path"), "org_id", "files", "bytes", "largest", "code_bytes", tokens.alias("tokens"), cost.alias("cost"), decision.alias("decision"))


def validate_uploads(uploads: DataFrame, most_bytes: int = 100 << 20) -> DataFrame:
    """uploads (file_name, content_type, size) with an error code, null where the upload is good."""
    name = F.col("file_name")
    error = F.when(F.coalesce(F.trim(name), F.lit("")) == "", "name_missing").when(name.contains("..") | name.rlike(r"[/\\:]"), "traversal").when(F.col("size") <= 0, "empty").when(F.col("size") > most_bytes, "too_large")
    error = error.when(~F.lower(name).endswith(".zip"), "extension").when(~F.col("content_type").isin("application/zip", "application/x-zip-compressed", "application/octet-stream"), "content_type")
    return uploads.withColumn("error", error)


def match_keys(given: DataFrame, keys: DataFrame, as_of) -> DataFrame:
    """Given keys (request_id, secret) with the id of the active key that they are: prefix first, then the whole digest."""
    asked = given.select("request_id", F.left(F.col("secret"), F.lit(8)).alias("prefix"), F.sha2("secret", 256).alias("digest"))
    live = keys.where(F.col("active") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of))))
    return asked.join(live, ["prefix", "digest"]).select("request_id", "key_id")


def finding_sources(findings: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(finding, chunk) of each source that a finding names, and the sources that no chunk has."""
    named = findings.select("finding_id", F.explode("sources").alias("chunk_id"))
    return named.join(chunks, "chunk_id"), named.join(chunks, "chunk_id", "left_anti")

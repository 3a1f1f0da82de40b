"""What the operators of this subpackage share: reading tables, the shared folder and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. A batch of texts, not a partition, is what a Python worker holds.
BATCH_ROWS = 512


#: Bytes of an Arrow batch on its way to Python, and Spark's own default.
BATCH_BYTES, DEFAULT = "8388608b", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, for a batch of texts is held by the executor and by Python at once, and several tasks do so.
    A session that says otherwise than Spark's default keeps what it says. The one value serves all operators."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, DEFAULT) == DEFAULT:
        spark.conf.set(name, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A table of the data folder; with cols only those columns, so that other columns never clash with ours."""
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Where it is unset, one of this machine is set,
    if the whole job runs on this machine; a cluster without a shared folder is refused."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to so many rows. Spark bounds a batch by bytes (maxBytesPerBatch); this bounds what Python makes of it."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def apart(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, text): the other columns in a struct, so that whatever names they have cannot clash with those that a step adds."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(None).cast("int").alias("none")]
    return docs.select(F.struct(*others).alias("row"), F.col(text).alias("text"))


def together(df: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The columns again, with the text as it is now."""
    return df.select(*(F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in columns))

"""Files and archives as tables: listings, zip entries and their checks."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.rules import BINARY_EXTENSIONS
from strandline.operators.files import extension, is_excluded
from strandline.sources import zips


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(path, file_path, ext, size_bytes) of all files below root; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size_bytes"))
    below = F.regexp_replace("path", r"^[a-z]+:/+(?=/)", "")
    return rows.select("path", F.regexp_replace(below, "^" + root.rstrip("/") + "/", "").alias("file_path"), "size_bytes").withColumn("ext", extension(F.col("file_path")))


def read_texts(spark: SparkSession, root: str, most: int = 200_000) -> DataFrame:
    """(path, content) of the files below root that have at most so many characters."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return rows.select("path", F.decode("content", "UTF-8").alias("content")).where(F.length("content") <= most)


ENTRIES = "path string, idx int, entry string, size long, compressed long, error string"
_ENTRIES = pa.schema([("path", pa.string()), ("idx", pa.int32()), ("entry", pa.string()), ("size", pa.int64()), ("compressed", pa.int64()), ("error", pa.string())])
#: Entries that a task hands on at once.
BATCH = 4096


def archive_entries(spark: SparkSession, root: str) -> DataFrame:
    """One row for each entry of each zip file below root, see `zips`; one without an entry, with the reason, for a file that
    is no archive or cannot be read to its end.

    Spark lists the files and deals their names out; a task opens each and reads its directory by ranges. Stores that only
    Spark's own readers open are not reached this way."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(root)
    return entries_of(files.select("path"))


def entries_of(paths: DataFrame) -> DataFrame:
    """The entries of the archives (path); null paths give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from listed(path)

    return paths.where("path is not null").select("path").mapInArrow(run, ENTRIES)


def listed(path: str) -> Iterator[pa.RecordBatch]:
    """Rows of ENTRIES of one archive, BATCH at a time."""
    store, name = fs.FileSystem.from_uri(path if ":" in path.partition("/")[0] else f"file://{path}")
    with store.open_input_file(name) as source:
        rows = zips.listing(source)
        while part := list(itertools.islice(rows, BATCH)):
            yield pa.RecordBatch.from_pylist([{"path": path, **e._asdict()} for e in part], schema=_ENTRIES)


def usable_entries(entries: DataFrame, largest: int = 10 << 20, most: int = 10_000) -> DataFrame:
    """Entries that are neither binary, vendored nor too large, the first `most` of each archive."""
    ext = extension(F.col("entry"))
    kept = entries.where(F.col("entry").isNotNull() & ~ext.isin(*BINARY_EXTENSIONS) & ~is_excluded(F.col("entry")) & (F.col("size") <= largest))
    return kept.withColumn("ext", ext).withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("idx"))).where(F.col("place") <= most).drop("place")


def archive_stats(entries: DataFrame) -> DataFrame:
    """Per archive: files, bytes, largest file and its name, files by extension, whether a path climbs."""
    named = entries.where("entry is not null").withColumn("ext", extension(F.col("entry")))
    by_ext = named.groupBy("path", "ext").agg(F.count("*").alias("n")).groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("types"))
    whole = named.groupBy("path").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.max_by("entry", F.struct("size", "entry")).alias("largest_name"), F.bool_or(F.col("entry").contains("..")).alias("climbs"))
    return whole.join(by_ext, "path")


def has_traversal(path: Column) -> Column:
    return path.contains("..") | path.contains("::") | path.rlike(r"^[/\\]") | path.rlike(r"^.(?:[^:]*:.|:)?[^:]*:") & ~path.rlike(r"^[A-Za-z]:[^:]*$")


def entry_verdicts(entries: DataFrame, ratio: int = 100, total: int = 1 << 30, most: int = 10_000, refused: tuple[str, ...] = (".exe", ".dll", ".bat", ".cmd", ".ps1", ".sh")) -> DataFrame:
    """(path, verdict, entry): the first entry of an archive that breaks a rule; verdict ok where none does."""
    w = Window.partitionBy("path").orderBy("idx")
    rows = entries.where("entry is not null").withColumn("running", F.sum("size").over(w)).withColumn("place", F.row_number().over(w))
    name = F.col("entry")
    broken = (
        F.when(name.rlike(r"^([/\\]|[A-Za-z]:)"), "absolute path").when(F.array_contains(F.split(name, r"[/\\]"), ".."), "traversal").when(F.length(name) > 260, "path too long")
        .when(extension(name).isin(*refused), "extension").when(F.col("size") > F.col("compressed") * ratio, "ratio").when(F.col("running") > total, "total size").when(F.col("place") > most, "entry count")
    )
    first = F.min_by(F.struct(broken.alias("verdict"), name.alias("entry")), F.when(broken.isNotNull(), F.col("idx")))
    return rows.groupBy("path").agg(first.alias("f")).select("path", F.coalesce("f.verdict", F.lit("ok")).alias("verdict"), "f.entry")

"""The SQL surface: table functions and views by name, so that the library is used from SQL text.

`register(spark)` adds the functions; `create_views(spark, sf_dir)` the tables as temporary views. Table functions take a table
argument, whose rows come as Arrow batches, and constants:

    select * from zip_entries(table(select path from archives))
    select * from code_units(table(select doc_id, ext, content from code_files), 1600)
    select * from sliding_chunks(table(select doc_id, content from code_files), 1600, 200, 50)
    select * from semantic_chunks(table(select doc_id, project_id, file_path, ext, content from code_files), 1600, 200, 50)

`semantic_chunks` may be given `partition by (project_id)` behind the table: its rows are then dealt by project. Constants may be left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from strandline.operators import chunking, units
from strandline.operators.batches import by_bytes
from strandline.sources import archives, views


def _constants(arrays: tuple, defaults: tuple[int, ...]) -> list[int]:
    given = [a[0].as_py() if isinstance(a, (pa.Array, pa.ChunkedArray)) else a for a in arrays]
    return [given[k] if k < len(given) and given[k] is not None else d for k, d in enumerate(defaults)]


def _column(batch: pa.RecordBatch, name: str) -> list:
    names = [n.lower() for n in batch.schema.names]
    if name not in names:
        raise ValueError(f"the table lacks the column {name}")
    return batch.column(names.index(name)).to_pylist()


class ZipEntries:
    """Entries of zip archives (path)."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        for path in _column(batch, "path"):
            if path is not None:
                for rows in archives.listed(path):
                    yield pa.Table.from_batches([rows])


class CodeUnits:
    """Units of files (doc_id, ext, content); a C# type of more tokens than the constant gives its members."""

    def eval(self, batch: pa.RecordBatch, *sizes: pa.Array) -> Iterator[pa.Table]:
        (most,) = _constants(sizes, (1600,))
        for part in by_bytes([batch], next(n for n in batch.schema.names if n.lower() == "content")):
            rows = [(doc, u) for doc, ext, text in zip(_column(part, "doc_id"), _column(part, "ext"), _column(part, "content"), strict=True) for u in units.units_within(text or "", ext or "", most)]
            columns = [pa.array([d for d, _ in rows], pa.int64()), *(pa.array([getattr(u, f.name) for _, u in rows], f.type) for f in units.KIND)]
            yield pa.Table.from_arrays(columns, names=["doc_id", *units.FIELDS])


class SlidingChunks:
    """Windows of files (doc_id, content): most tokens, overlap, least."""

    def eval(self, batch: pa.RecordBatch, *sizes: pa.Array) -> Iterator[pa.Table]:
        given = _constants(sizes, (1600, 200, 50))
        for doc, text in zip(_column(batch, "doc_id"), _column(batch, "content"), strict=True):
            if text is not None:
                rows = chunking.sliding(text, *given)
                yield pa.Table.from_batches([chunking.as_batch([pa.array([doc] * len(rows), pa.int64())], ["doc_id"], rows, chunking.SLIDING_KIND)])


class SemanticChunks:
    """Semantic chunks of files (doc_id, project_id, file_path, ext, content): most tokens, overlap, least."""

    def eval(self, batch: pa.RecordBatch, *sizes: pa.Array) -> Iterator[pa.Table]:
        given = _constants(sizes, (1600, 200, 50))
        for doc, project, path, ext, text in zip(*(_column(batch, c) for c in ("doc_id", "project_id", "file_path", "ext", "content")), strict=True):
            rows = chunking.semantic(text, path, ext, *given)
            if rows:
                n = len(rows)
                yield pa.Table.from_batches([chunking.as_batch([pa.array([doc] * n, pa.int64()), pa.array([project] * n, pa.string()), pa.array([path] * n, pa.string())], ["doc_id", "project_id", "file_path"], rows, chunking.SEMANTIC_KIND)])


#: Handler and columns of each function. Functions that take Arrow batches have fixed columns.
FUNCTIONS = {
    "zip_entries": (ZipEntries, archives.ENTRIES),
    "code_units": (CodeUnits, "doc_id long, name string, type string, start_line int, end_line int, namespace string"),
    "sliding_chunks": (SlidingChunks, f"doc_id long, {chunking.SLIDING}"),
    "semantic_chunks": (SemanticChunks, f"doc_id long, project_id string, file_path string, {chunking.SEMANTIC}"),
}
VIEWS = ("source_files", "code_files", "projects", "findings", "vectors", "job_events", "token_events", "api_log")


def register(spark: SparkSession) -> None:
    """Register the table functions under their names."""
    for name, (handler, columns) in FUNCTIONS.items():
        spark.udtf.register(name, arrow_udtf(handler, returnType=columns))


def create_views(spark: SparkSession, sf_dir: str) -> None:
    """The tables of the review as temporary views; nothing is read yet."""
    for name in VIEWS:
        getattr(views, name)(spark, sf_dir).createOrReplaceTempView(name)

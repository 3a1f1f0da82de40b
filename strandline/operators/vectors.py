"""Operators over embeddings: exact nearest neighbours, risk scores, repairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Query rows that are broadcast at most; more are worked off in blocks of this size.
QUERY_ROWS = 10_000
#: Scores of an Arrow batch that a task holds at once, unless one query has more: 8 bytes each, and some copies of them.
SCORES = 1 << 20


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, 0 if the lengths differ."""
    parts = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def normalized(v: Column) -> Column:
    """Unit length in double precision; a zero vector stays."""
    scaled = lambda u, n: F.transform(u, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return _let(v, lambda u: _let(norm(u), lambda n: scaled(u, n)))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def fit(v: Column, dim: int) -> Column:
    """Cut or zero-padded to the dimension, then of unit length; a null is the zero vector."""
    padded = F.slice(F.concat(F.transform(v, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), dim)), 1, dim)
    return normalized(F.coalesce(padded, F.array_repeat(F.lit(0.0), dim)))


def knn(queries: DataFrame, vectors: DataFrame, k: int, *per: str) -> DataFrame:
    """Exact cosine top-k of a stated query set (qid, q) against all vectors (chunk_id, embedding, ...); with `per`, the k best of
    each query in each group of those columns.

    The queries go to every task in blocks of at most about QUERY_ROWS; where there are more, they are counted first. A task multiplies its
    vectors with a block as matrices, SCORES at a time, and of each Arrow batch hands on what can be among the k best; Spark cuts
    the rest of the rank below the exchange. Scores count to 12 decimals, so that equal vectors have equal ones. Null vectors have the score 0,
    as have zero ones, those with a component that is null or not finite, and those of another dimension than the query."""
    queries = queries.select("qid", F.transform("q", lambda x: x.cast("double")).alias("q"))
    head = queries.limit(QUERY_ROWS + 1).toArrow()
    blocks = 1 if head.num_rows <= QUERY_ROWS else -(-queries.count() // QUERY_ROWS)
    kind = dict(queries.dtypes)["qid"]
    columns = ["chunk_id", "file_path", "project_id", "token_count"]
    rows = vectors.select(*columns, "embedding")
    schema = f"qid {kind}, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:4]) + ", score double"
    found = None
    for b in range(blocks):
        block = head if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toArrow()
        scored = rows.mapInArrow(_scorer(block, k, [columns.index(p) for p in per]), schema)
        found = scored if found is None else found.unionByName(scored)
    top = Window.partitionBy("qid", *per).orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("place", F.row_number().over(top)).where(F.col("place") <= k)


def _matrix(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of unit length, lengths of the lists): cut or padded to the dimension; rows that are null, of no length, or hold a
    null or what is no finite number are zero."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    if len(sizes) and (sizes == sizes[0]).all() and sizes[0] > 0:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)[:, :dim]
        out[:, : flat.shape[1]] = flat
    else:
        for k, v in enumerate(column.to_pylist()):
            row = np.array([np.nan if x is None else x for x in v[:dim]] if v else [], np.float64)
            out[k, : len(row)] = row
    out[~np.isfinite(out).all(axis=1)] = 0
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0), sizes


def _scorer(block: pa.Table, k: int, per: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    qids, asked = (pa.concat_arrays(block.column(c).chunks) if block.num_rows else pa.array([], block.schema.field(c).type) for c in ("qid", "q"))
    unit, lengths = _matrix(asked, max(pc.list_value_length(asked).to_pylist(), default=0, key=lambda n: n or 0) or 0)
    dim = unit.shape[1]

    def best(scores: np.ndarray) -> np.ndarray:
        """Places of the k best and those that tie with the last of them."""
        if len(scores) <= k:
            return np.arange(len(scores))
        return np.flatnonzero(scores >= np.partition(scores, -k)[-k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(qids):
                continue
            own_unit, sizes = _matrix(batch.column(4), dim)
            groups: dict[tuple, list[int]] = {}
            for place, key in enumerate(zip(*(batch.column(c).to_pylist() for c in per), strict=True) if per else [()] * batch.num_rows):
                groups.setdefault(key, []).append(place)
            of_group = [np.array(g) for g in groups.values()]
            step = max(1, SCORES // batch.num_rows)
            for at in range(0, len(qids), step):
                scores = np.where(lengths[at : at + step, None] == sizes, np.round(unit[at : at + step] @ own_unit.T, 12), 0.0)
                kept = [np.concatenate([own[best(row[own])] for own in of_group]) for row in scores]
                rows, q = np.concatenate(kept), np.repeat(np.arange(len(kept)), [len(x) for x in kept])
                names = ["qid", *batch.schema.names[:4], "score"]
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(at + q)), *(batch.column(c).take(pa.array(rows)) for c in range(4)), pa.array(scores[q, rows])], names=names)

    return run


def file_risk(hits: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, file_path, risk): a file's best score over all risk queries, divided by the best of its project if that is
    above 0; else the score. Files without a hit have 0."""
    best = hits.groupBy("project_id", "file_path").agg(F.max("score").alias("s"))
    top = best.groupBy(F.col("project_id").alias("p")).agg(F.max("s").alias("top"))
    scaled = best.join(top, F.col("project_id") == F.col("p")).select("project_id", "file_path", F.when(F.col("top") > 0, F.col("s") / F.col("top")).otherwise(F.col("s")).alias("risk"))
    return files.join(scaled, ["project_id", "file_path"], "left").select("project_id", "file_path", F.coalesce("risk", F.lit(0.0)).alias("risk"))


def process_order(risks: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Files of each project with a high-risk flag and their place: high-risk ones by score, then the rest by path."""
    high = F.col("risk") > threshold
    order = Window.partitionBy("project_id").orderBy(F.desc("high_risk"), F.desc_nulls_last(F.when(high, F.col("risk"))), "file_path")
    return risks.withColumn("high_risk", high).withColumn("place", F.row_number().over(order))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by chunk_id, the highest version of each; of one version the new table's row."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    newest = Window.partitionBy("chunk_id").orderBy(F.desc("version"), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r", "_new")


#: Rows of a stated list that are broadcast at most; a longer one is joined by a shuffle.
LISTED = 1_000_000


def _listed(rows: DataFrame) -> DataFrame:
    """The list, broadcast where its checked size allows."""
    return F.broadcast(rows) if rows.limit(LISTED + 1).count() <= LISTED else rows


def delete(vectors: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Vectors without those whose project or chunk is among `gone`, a stated list."""
    return vectors.join(_listed(gone.select(key)), key, "left_anti")


def missing(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with an embedding that the vector table lacks."""
    return chunks.where("embedding is not null").join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def repair(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The vector table with what it lacks, with default names where a chunk has none, of version 0."""
    lost = missing(chunks, vectors).withColumns({"semantic_type": F.coalesce("semantic_type", F.lit("unknown")), "semantic_name": F.coalesce("semantic_name", F.lit(""))})
    return upsert(vectors, lost.withColumn("version", F.lit(0)).select(vectors.columns))


def verify_index(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(project_id, chunks, vectors, missing, out_of_range) of each project: whether each chunk has a vector and a valid number."""
    known = vectors.select("chunk_id", F.lit(True).alias("has")).distinct()
    rows = chunks.join(known, "chunk_id", "left")
    bad = (F.col("chunk_index") < 0) | (F.col("chunk_index") >= F.col("total_chunks"))
    return rows.groupBy("project_id").agg(F.count("*").alias("chunks"), F.count("has").alias("vectors"), F.count_if(F.col("has").isNull()).alias("missing"), F.count_if(bad).alias("out_of_range"))


def validity(vector: Column, dim: int) -> Column:
    """Why a vector is refused; null for a good one."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNull(), "missing").when(F.size(vector) != dim, "dimension").when(odd, "not a number").when(F.forall(vector, lambda x: x == 0), "zero")


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the rows of the projects that are gone, a stated list, and (table, removed, kept) of each."""
    ids = _listed(gone.select("project_id").distinct())
    left = {name: df.join(ids, "project_id", "left_anti") for name, df in tables.items()}
    counts = None
    for name, df in tables.items():
        n = df.join(ids.withColumn("_gone", F.lit(True)), "project_id", "left").agg(F.count("_gone").alias("removed"), F.count_if(F.col("_gone").isNull()).alias("kept")).select(F.lit(name).alias("table"), "removed", "kept")
        counts = n if counts is None else counts.unionByName(n)
    return left, counts

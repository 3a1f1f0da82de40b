"""Chunks to vectors to context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandline.functions.rules import SOURCE_EXTENSIONS
from strandline.operators.batches import by_bytes
from strandline.operators.chunking import chunk_corpus
from strandline.operators.files import is_excluded
from strandline.operators.vectors import normalized, process_order
from strandline.sources.tables import write_projects

#: Pieces of rows that wait at most for a batch of texts to fill.
HELD = 8
#: Words that add to a component of their own, in order of the components.
KEYWORDS = (
    "class", "public", "private", "void", "async", "await", "return", "if", "else", "for", "while", "try", "catch", "throw", "new",
    "null", "interface", "abstract", "static", "readonly", "const", "using", "namespace", "var", "string", "int", "bool", "list", "dictionary", "task",
)


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic unit vector of a text: noise from its digest; half a unit for each keyword that stands between spaces; then a
    component for its length, in thousands of characters, and one for its words, in hundreds, each at most 1.

    A blank text is the zero vector."""
    noise = lambda d: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substr(F.md5(F.concat(d, F.lit(":"), i.cast("string"))), F.lit(1), F.lit(8)), 16, 10).cast("bigint") % 2001 / 1000.0 - 1.0)
    words = F.array_remove(F.split(F.lower(text), " "), "")  # the text is lower-cased and cut once, for all keywords
    held = F.array_intersect(F.array(*map(F.lit, KEYWORDS)), words)
    bumps = F.transform(F.array(held), lambda h: F.array(*(F.when(F.array_contains(h, k), 0.5).otherwise(0.0) for k in KEYWORDS), *(F.lit(0.0),) * max(0, dim - len(KEYWORDS))))[0]
    sizes = F.array(*(F.least(n / limit, F.lit(1.0)) for n, limit in ((F.length(text), 1000), (F.size(words), 100))))
    raw = F.zip_with(F.transform(F.array(F.sha2(text, 256)), noise)[0], F.slice(bumps, 1, dim), lambda a, b: a + b)
    n = len(KEYWORDS)
    vector = normalized(F.slice(F.concat(F.slice(raw, 1, n), sizes, F.slice(raw, n + 3, max(0, dim - n - 2))), 1, dim))
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.array_repeat(F.lit(0.0), dim)).otherwise(vector)


def chunked(files: DataFrame, largest: int = 200_000, **sizes) -> DataFrame:
    """Chunks of all projects with their hashes: source files outside excluded folders, of at most so many characters."""
    usable = files.where(F.col("ext").isin(*SOURCE_EXTENSIONS) & ~is_excluded(F.col("file_path")) & (F.length("content") <= largest))
    digest = F.substr(F.sha2("chunk", 256), F.lit(1), F.lit(16))
    place = F.concat_ws(":", "project_id", "file_path", F.col("start_line").cast("string"), F.col("end_line").cast("string"), digest)
    return chunk_corpus(usable, **sizes).withColumn("text_hash", digest).withColumn("chunk_hash", F.substr(F.sha2(place, 256), F.lit(1), F.lit(16)))


def embedded(chunks: DataFrame, embed: Callable[[Column], Column] = hash_embedding, dim: int = 64) -> DataFrame:
    """chunks with `embedding`; where the embedding fails (null), the zero vector."""
    return chunks.withColumn("embedding", F.coalesce(embed(F.col("chunk")), F.array_repeat(F.lit(0.0), dim)))


#: A provider takes texts and gives a vector for each; it may raise.
Provider = Callable[[list[str]], list[list[float] | None]]


def embed_with(chunks: DataFrame, provider: Callable[[], Provider], dim: int, batch: int = 16, text: str = "chunk") -> DataFrame:
    """chunks with `embedding` and `embedded`, by a provider that takes several texts at once.

    Texts are handed on in batches of that many, across rows and Arrow batches of a task. If a batch fails, each of its texts is
    tried on its own; one that fails, too, and one whose vector is null or of another dimension, has the zero vector and is not
    embedded. Blank and null texts are not sent. provider is called once for each task, so a model is loaded there. Columns named
    as the new ones are replaced."""
    new = ("embedding", "embedded")
    kept = [f for f in chunks.schema if f.name.lower() not in new]
    schema = T.StructType([*kept, T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("embedded", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = provider()

        def vectors(texts: list[str]) -> list[list[float] | None]:
            try:
                found = embed(texts)
                if len(found) == len(texts):
                    return found
            except Exception:  # noqa: BLE001 - whatever a provider raises, its other texts are still wanted
                pass
            if len(texts) == 1:
                return [None]
            return [v for t in texts for v in vectors([t])]

        def done(held: list[pa.RecordBatch], found: dict[tuple[int, int], list[float] | None]) -> Iterator[pa.RecordBatch]:
            for k, rows in enumerate(held):
                own = [found.get((k, i)) for i in range(rows.num_rows)]
                good = [v is not None and len(v) == dim for v in own]
                values = pa.array([v if g else [0.0] * dim for v, g in zip(own, good, strict=True)], pa.list_(pa.float64()))
                columns = [rows.column(rows.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, values, pa.array(good)], names=[*(f.name for f in kept), *new])

        held: list[pa.RecordBatch] = []
        waiting: list[tuple[tuple[int, int], str]] = []
        found: dict[tuple[int, int], list[float] | None] = {}

        def ask(n: int) -> None:
            part = waiting[:n]
            del waiting[:n]
            found.update(zip([p for p, _ in part], vectors([t for _, t in part]), strict=True))

        for rows in by_bytes(batches, text):
            texts = rows.column(rows.schema.get_field_index(text)).to_pylist()
            waiting += [((len(held), i), t) for i, t in enumerate(texts) if t and not t.isspace()]
            held.append(rows)
            while len(waiting) >= batch:
                ask(batch)
            if not waiting or len(held) >= HELD:  # rows go on when none of their texts waits
                if waiting:
                    ask(len(waiting))
                yield from done(held, found)
                held, found = [], {}
        if waiting:
            ask(len(waiting))
        yield from done(held, found)

    return chunks.mapInArrow(run, schema)


def index_project(files: DataFrame, path: str, embed: Callable[[Column], Column] = hash_embedding, **sizes) -> DataFrame:
    """Chunk and embed all projects, replace their folders below path, read them back and verify: the result row of each project.

    One narrow job writes the chunks; the result is counted from what was written."""
    chunks = chunked(files, **sizes)
    write_projects(embedded(chunks, embed), path)
    stored = files.sparkSession.read.parquet(path)
    zero = lambda v: ~F.exists(v, lambda x: x != 0)
    done = stored.groupBy(F.col("project_id").cast("string").alias("p")).agg(F.count("*").alias("chunks"), F.count_distinct("file_path").alias("files"), F.sum("tokens").alias("tokens"), F.count_if(zero(F.col("embedding"))).alias("failed"), F.count_if((F.col("chunk_index") < 0) | (F.col("chunk_index") >= F.col("total_chunks"))).alias("out_of_range"))
    seen = files.groupBy("project_id").agg(F.count_distinct("file_path").alias("seen"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    rows = seen.join(done, F.col("project_id") == F.col("p"), "left")
    return rows.select("project_id", n("files").alias("files"), (F.col("seen") - n("files")).alias("skipped_files"), n("chunks").alias("chunks"), n("tokens").alias("tokens"), (n("chunks") - n("failed")).alias("embedded"), n("out_of_range").alias("out_of_range"))


def incremental_index(files: DataFrame, stored: DataFrame, embed: Callable[[Column], Column] = hash_embedding, **sizes) -> tuple[DataFrame, DataFrame]:
    """(new chunks with vectors, counts of new and skipped chunks by project); stored has project_id and chunk_hash. Only chunks
    that are new are embedded."""
    chunks = chunked(files, **sizes)
    known = stored.select(F.col("project_id").alias("p"), F.col("chunk_hash").alias("h"), F.lit(True).alias("known")).distinct()
    marked = chunks.dropDuplicates(["project_id", "chunk_hash"]).join(known, (F.col("project_id") == F.col("p")) & (F.col("chunk_hash") == F.col("h")), "left").drop("p", "h")
    counts = marked.groupBy("project_id").agg(F.count_if(F.col("known").isNull()).alias("new"), F.count("known").alias("skipped"))
    return embedded(marked.where("known is null").drop("known"), embed), counts


def within_budget(hits: DataFrame, most: int) -> DataFrame:
    """Hits (qid, place, token_count, ...) of each query, best first, while their tokens fit; with running and total tokens."""
    w = Window.partitionBy("qid")
    rows = hits.withColumn("running", F.sum("token_count").over(w.orderBy("place"))).withColumn("total", F.sum("token_count").over(w))
    return rows.where(F.col("running") <= most)


def context(hits: DataFrame) -> DataFrame:
    """(qid, context): the chunks of each query as markdown, best first."""
    block = F.concat(F.lit("## "), "file_path", F.lit(" (lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")\n"), "chunk")
    return hits.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


def _with_texts(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """hits with start_line, end_line and chunk of texts, by chunk_id: hits are few for each query, texts move only if they are hit."""
    return hits.join(texts.select(F.col("chunk_id").alias("_c"), "start_line", "end_line", "chunk"), F.col("chunk_id") == F.col("_c")).drop("_c")


def retrieve(hits: DataFrame, texts: DataFrame, most: int, summarise: int = 6000, least: float | None = None) -> DataFrame:
    """(qid, chunks, tokens, summarise, sources, context) of hits (qid, place, score, chunk_id, project_id, file_path, token_count).

    Hits below the least similarity go (none, if null). The others' tokens decide whether a summary is wanted; the context has the
    chunks, best first, while their tokens fit. Queries without a hit have no row."""
    kept = hits if least is None else hits.where(F.col("score") >= least)
    rows = _with_texts(within_budget(kept, most), texts)
    source = F.struct("place", F.concat("project_id", F.lit("/"), "file_path").alias("source"))
    sources = F.transform(F.array_sort(F.collect_list(source)), lambda x: x["source"])
    found = rows.groupBy("qid").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.bool_or(F.col("total") > summarise).alias("summarise"), sources.alias("sources"))
    return found.join(context(rows).withColumnRenamed("qid", "_q"), F.col("qid").eqNullSafe(F.col("_q"))).drop("_q")


def summary_documents(hits: DataFrame, texts: DataFrame, size: int = 10, budget: int = 6000) -> DataFrame:
    """(qid, bucket, tokens, document, again): the texts of each `size` hits, best first; again: all of a query's hits have more
    tokens than the budget, so that their summaries are summarised once more."""
    rows = _with_texts(hits, texts).withColumn("bucket", F.floor((F.col("place") - 1) / size).cast("int"))
    block = F.concat(F.lit("## "), "file_path", F.lit(" (lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")\n"), "chunk")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", block.alias("b")))), lambda x: x["b"]), "\n\n")
    own = rows.groupBy("qid", "bucket").agg(F.sum("token_count").alias("tokens"), text.alias("document"))
    return own.withColumn("again", F.sum("tokens").over(Window.partitionBy("qid")) > budget)


def plan_with_risk(plan: DataFrame, risks: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The analysis plan with risk (0 for files without one), high_risk and place, the order within the project: high-risk files
    by risk, then the others by path. risks: project_id, file_path, risk."""
    scored = plan.join(risks.select(F.col("project_id").alias("_p"), F.col("file_path").alias("_f"), "risk"), F.col("project_id").eqNullSafe(F.col("_p")) & (F.col("file_path") == F.col("_f")), "left").drop("_p", "_f")
    return process_order(scored.withColumn("risk", F.coalesce("risk", F.lit(0.0))), threshold)

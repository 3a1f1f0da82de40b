"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators import retrieval
from strandline.operators import vectors as ops
from strandline.plans import corpus
from strandline.plans.registry import query
from strandline.sources import views

_COS = "list_inner_product(v.embedding::double[], q.embedding::double[]) / (sqrt(list_inner_product(v.embedding::double[], v.embedding::double[])) * sqrt(list_inner_product(q.embedding::double[], q.embedding::double[])))"
#: Searches ask every hundredth vector against all; the risk scores ask eight, one for each kind of risk, in each project.
_HITS = f"q as (select vec_id as qid, embedding from vectors where vec_id % 100 = 0), s as (select q.qid, v.chunk_id, v.file_path, v.project_id, v.token_count, {_COS} as score from vectors v, q), h as (select *, row_number() over (partition by qid order by score desc, chunk_id) as place from s)"
_RISKS = f"q as (select vec_id as qid, embedding from vectors where vec_id < 8), s as (select q.qid, v.chunk_id, v.file_path, v.project_id, {_COS} as score from vectors v, q), h as (select *, row_number() over (partition by qid, project_id order by score desc, chunk_id) as place from s), b as (select project_id, file_path, max(score) as s from h where place <= 50 group by 1, 2), t as (select project_id, max(s) as top from b group by 1), r as (select f.project_id, f.file_path, coalesce(case when top > 0 then s / top else s end, 0) as risk from (select distinct project_id, file_path from vectors) f left join b on b.project_id = f.project_id and b.file_path = f.file_path left join t on t.project_id = f.project_id)"


def _vectors(spark, sf_dir):
    return views.vectors(spark, sf_dir)


def _ask(v, condition):
    return v.where(condition).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def _hits(spark, sf_dir, k):
    v = _vectors(spark, sf_dir)
    return ops.knn(_ask(v, "vec_id % 100 = 0"), v, k)


def _shown(vector):
    """All components in hundred-thousandths, as a text."""
    return F.array_join(F.transform(vector, lambda x: F.round(x.cast("double") * 100_000).cast("bigint").cast("string")), ",")


_SHOWN = "array_to_string(list_transform({}, lambda x: round(x::double * 100000)::bigint), ',')"


@query("s8_upsert_vectors", "with n as (select chunk_id, 1 as version, token_count from vectors union all select chunk_id, 2, token_count + 1 from vectors where vec_id % 3 = 0) select chunk_id, max(version) as version, arg_max(token_count, version) as token_count from n group by 1", "vectors")
def upsert_vectors(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return ops.upsert(v.select("chunk_id", F.lit(1).alias("version"), "token_count"), v.where("vec_id % 3 = 0").select("chunk_id", F.lit(2).alias("version"), (F.col("token_count") + 1).alias("token_count")))


@query("s9_delete_vectors", "select chunk_id from vectors where project_id not in ('p1', 'p2') and chunk_id not in ('3', '14', '15')", "vectors")
def delete_vectors(spark, sf_dir):
    projects, chunks = spark.createDataFrame([("p1",), ("p2",)], "project_id string"), spark.createDataFrame([("3",), ("14",), ("15",)], "chunk_id string")
    return ops.delete(ops.delete(_vectors(spark, sf_dir), projects, "project_id"), chunks, "chunk_id").select("chunk_id")


@query("s10_vector_count", "select project_id, count(*) as vectors from vectors group by 1", "vectors")
def vector_count(spark, sf_dir):
    return _vectors(spark, sf_dir).groupBy("project_id").agg(F.count("*").alias("vectors"))


@query("s12_verify_index", "select project_id, count(*) as chunks, count(*) filter (where vec_id % 9 <> 0) as vectors, count(*) filter (where vec_id % 9 = 0) as missing, count(*) filter (where vec_id % 7 >= 6 or vec_id % 50 = 0) as out_of_range from vectors group by 1", "vectors")
def verify_index(spark, sf_dir):
    """Chunks of which every ninth has no vector, and some a number outside their file's."""
    v = _vectors(spark, sf_dir)
    chunks = v.select("project_id", "chunk_id", F.when(F.col("vec_id") % 50 == 0, -1).otherwise(F.col("vec_id") % 7).alias("chunk_index"), F.lit(6).alias("total_chunks"))
    return ops.verify_index(chunks, v.where("vec_id % 9 <> 0"))


@query("s13_repair_vectors", "select chunk_id, case when vec_id % 5 = 0 then 0 else 1 end as version, case when vec_id % 5 <> 0 then 'class' when vec_id % 10 = 0 then 'unknown' else 'method' end as semantic_type from vectors", "vectors")
def repair_vectors(spark, sf_dir):
    """A vector table without every fifth chunk is repaired from the chunks."""
    named = _vectors(spark, sf_dir).select("chunk_id", "embedding", "vec_id")
    stored = named.where("vec_id % 5 <> 0").select("chunk_id", "embedding", F.lit("class").alias("semantic_type"), F.lit("C").alias("semantic_name"), F.lit(1).alias("version"))
    chunks = named.select("chunk_id", "embedding", F.when(F.col("vec_id") % 10 != 0, "method").alias("semantic_type"), F.lit(None).cast("string").alias("semantic_name"))
    return ops.repair(chunks, stored).select("chunk_id", "version", "semantic_type")


@query("s14_embedding_json_codec", f"select chunk_id, {_SHOWN.format('embedding')} as vector from vectors", "vectors")
def embedding_json_codec(spark, sf_dir):
    back = F.from_json(F.to_json("embedding"), "array<float>")
    return _vectors(spark, sf_dir).select("chunk_id", _shown(back).alias("vector"))


@query("s16_cascade_delete_project", "select t as \"table\", count(*) filter (where gone) as removed, count(*) filter (where not gone) as kept from (select 'vectors' as t, project_id in ('p3', 'src3', '3') as gone from vectors union all select 'files', project_id in ('p3', 'src3', '3') from source_files union all select 'findings', project_id in ('p3', 'src3', '3') from findings union all select 'checkpoints', project_id::varchar in ('p3', 'src3', '3') from job_events union all select 'chunks', project_id in ('p3', 'src3', '3') from source_files where length(content) > 0 union all select 'projects', project_id::varchar in ('p3', 'src3', '3') from projects) group by 1", "vectors", "source_files", "findings", "job_events", "projects")
def cascade_delete_project(spark, sf_dir):
    files, by_name = views.source_files(spark, sf_dir), lambda df: df.withColumn("project_id", F.col("project_id").cast("string"))
    tables = {"vectors": _vectors(spark, sf_dir), "files": files, "findings": views.findings(spark, sf_dir), "checkpoints": by_name(views.job_events(spark, sf_dir)), "chunks": files.where("length(content) > 0"), "projects": by_name(views.projects(spark, sf_dir))}
    return ops.cascade_delete(tables, spark.createDataFrame([("p3",), ("src3",), ("3",)], "project_id string"))[1]


@query("x20_vector_normalize", f"select chunk_id, {_SHOWN.format('list_transform(embedding, lambda x: x::double / sqrt(list_inner_product(embedding::double[], embedding::double[])))')} as vector from vectors", "vectors")
def vector_normalize(spark, sf_dir):
    return _vectors(spark, sf_dir).select("chunk_id", _shown(ops.normalized(F.col("embedding"))).alias("vector"))


@query("x22_vector_valid", "select chunk_id, case vec_id % 10 when 0 then 'missing' when 1 then 'dimension' when 2 then 'not a number' when 3 then 'zero' end as reason from vectors", "vectors")
def vector_valid(spark, sf_dir):
    """Vectors of which some are spoiled, with the reason why they are refused."""
    e, kind = F.col("embedding"), F.col("vec_id") % 10
    spoiled = F.when(kind == 1, F.slice(e, 1, 63)).when(kind == 2, F.transform(e, lambda x: x * float("nan"))).when(kind == 3, F.transform(e, lambda x: x * F.lit(0).cast("float"))).when(kind > 3, e)
    return _vectors(spark, sf_dir).select("chunk_id", ops.validity(spoiled, 64).alias("reason"))


@query("x23_fit_dimension", f"select chunk_id, {_SHOWN.format('list_transform(c, lambda x: x / n)')} as cut, {_SHOWN.format('list_concat(list_transform(embedding, lambda x: x::double / w), list_transform(range(6), lambda i: 0.0::double))')} as padded from (select chunk_id, embedding, list_slice(embedding, 1, 32)::double[] as c, sqrt(list_inner_product(list_slice(embedding, 1, 32)::double[], list_slice(embedding, 1, 32)::double[])) as n, sqrt(list_inner_product(embedding::double[], embedding::double[])) as w from vectors)", "vectors")
def fit_dimension(spark, sf_dir):
    return _vectors(spark, sf_dir).select("chunk_id", _shown(ops.fit(F.col("embedding"), 32)).alias("cut"), _shown(ops.fit(F.col("embedding"), 70)).alias("padded"))


@query("x21_j4_w3_knn_join", f"with {_HITS} select qid, chunk_id, place, round(score, 5) as score from h where place <= 20", "vectors")
def knn_join(spark, sf_dir):
    return _hits(spark, sf_dir, 20).select("qid", "chunk_id", "place", F.round("score", 5).alias("score"))


def _risk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return ops.file_risk(ops.knn(_ask(v, "vec_id < 8"), v, 50, "project_id"), v.select("project_id", "file_path").distinct())


@query("a16_j3_file_risk_from_queries", f"with {_RISKS} select project_id, file_path, round(risk, 5) as risk from r", "vectors")
def file_risk(spark, sf_dir):
    return _risk(spark, sf_dir).withColumn("risk", F.round("risk", 5))


@query("a17_top_risk_files", f"with {_RISKS.replace('place <= 50', 'place <= 20')} select project_id, file_path, round(s, 5) as score, place from (select *, row_number() over (partition by project_id order by s desc, file_path) as place from b) where place <= 10", "vectors")
def top_risk_files(spark, sf_dir):
    """The ten files of each project that come nearest to a risk query; a query has the twice ten best of its project."""
    v = _vectors(spark, sf_dir)
    best = ops.knn(_ask(v, "vec_id < 8"), v, 20, "project_id").groupBy("project_id", "file_path").agg(F.max("score").alias("s"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("s"), "file_path"))
    return best.withColumn("place", place).where("place <= 10").select("project_id", "file_path", F.round("s", 5).alias("score"), "place")


@query("f18_k5_process_order", f"with {_RISKS} select project_id, file_path, risk > 0.7 as high_risk, row_number() over (partition by project_id order by risk > 0.7 desc, case when risk > 0.7 then risk end desc nulls last, file_path) as place from r", "vectors")
def process_order(spark, sf_dir):
    """High-risk files of each project by score, then its other files."""
    return ops.process_order(_risk(spark, sf_dir)).drop("risk")


@query("w5_summary_buckets", f"with {_HITS} select qid, chunk_id, ((place - 1) // 10)::int as bucket from h where place <= 40", "vectors")
def summary_buckets(spark, sf_dir):
    return _hits(spark, sf_dir, 40).select("qid", "chunk_id", F.floor((F.col("place") - 1) / 10).cast("int").alias("bucket"))


@query("r7_retrieve", f"with {_HITS}, t as (select qid, chunk_id, project_id || '/' || file_path as source, place, token_count, sum(token_count) over (partition by qid order by place)::bigint as running, sum(token_count) over (partition by qid)::bigint as total from h where place <= 20) select qid, chunk_id, source, running, total > 6000 as summarise from t where running <= 4000", "vectors")
def retrieve(spark, sf_dir):
    """The best chunks of each query while their tokens fit, with their sources, and whether all of them would need a summary."""
    t = retrieval.within_budget(_hits(spark, sf_dir, 20), 4000)
    return t.select("qid", "chunk_id", F.concat("project_id", F.lit("/"), "file_path").alias("source"), "running", (F.col("total") > 6000).alias("summarise"))


@query("r8_summary_plan", f"with {_HITS}, b as (select qid, ((place - 1) // 10)::int as bucket, place, chunk_id, token_count from h where place <= 40) select qid, bucket, sum(token_count)::bigint as tokens, string_agg(chunk_id, ' ' order by place) as document from b group by 1, 2", "vectors")
def summary_plan(spark, sf_dir):
    b = _hits(spark, sf_dir, 40).withColumn("bucket", F.floor((F.col("place") - 1) / 10).cast("int"))
    return b.groupBy("qid", "bucket").agg(F.sum("token_count").alias("tokens"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"]), " ").alias("document"))


_FILED = "filed as (select s.project_id, s.file_path, s.content, e.vec_id, cast(e.vec_id as varchar) as chunk_id, e.embedding, cast(50 + e.vec_id % 700 as int) as token_count from embeddings e join source_files s on s.doc_id = e.vec_id)"


def _filed(spark, sf_dir):
    """Vectors as the chunks of the files of the same number."""
    v = _vectors(spark, sf_dir).drop("project_id", "file_path")
    return v.join(views.source_files(spark, sf_dir).select("doc_id", "project_id", "file_path", "content"), F.col("vec_id") == F.col("doc_id")).drop("doc_id")


@query("r11_plan_with_risk", f"with {corpus._PLAN}, {_FILED}, {_RISKS.replace('vectors', 'filed')}, j as (select p.*, coalesce(r.risk, 0) as risk from p left join r on r.project_id = p.project_id and r.file_path = p.file_path) select doc_id, decision, reason, tokens, language, round(risk, 5) as risk, risk > 0.7 as high_risk, row_number() over (partition by project_id order by risk > 0.7 desc, case when risk > 0.7 then risk end desc nulls last, file_path) as place from j", "source_files")
def plan_with_risk(spark, sf_dir):
    """The analysis plan with each file's risk, and the order in which its project's files are worked on."""
    v = _filed(spark, sf_dir)
    hits = ops.knn(_ask(v, "vec_id < 8"), v, 50, "project_id")
    risks = ops.file_risk(hits, v.select("project_id", "file_path").distinct())
    rows = retrieval.plan_with_risk(corpus.plan(spark, sf_dir), risks)
    return rows.select("doc_id", "decision", "reason", "tokens", "language", F.round("risk", 5).alias("risk"), "high_risk", "place")


@query("r7_retrieve_context", f"with {_FILED}, {_HITS.replace('vectors', 'filed')}, k as (select h.*, content, sum(h.token_count) over (partition by qid order by place)::bigint as running, sum(h.token_count) over (partition by qid)::bigint as total from h join filed using (chunk_id) where place <= 20 and score >= 0.2) select qid, count(*) as chunks, sum(token_count)::bigint as tokens, bool_or(total > 2500) as summarise, string_agg(k.project_id || '/' || k.file_path, ' ' order by place) as sources, sha256(string_agg('## ' || k.file_path || ' (lines 1-' || len(string_split(content, chr(10))) || ')' || chr(10) || content, chr(10) || chr(10) order by place)) as context from k where running <= 2000 group by 1", "source_files")
def retrieve_context(spark, sf_dir):
    """For each query the texts of its best chunks, at least 0.2 alike, while their tokens fit, with their sources."""
    v = _filed(spark, sf_dir)
    hits = ops.knn(_ask(v, "vec_id % 100 = 0"), v, 20)
    texts = v.select("chunk_id", F.lit(1).alias("start_line"), F.size(F.split("content", "\n")).alias("end_line"), F.col("content").alias("chunk"))
    rows = retrieval.retrieve(hits, texts, most=2000, summarise=2500, least=0.2)
    return rows.select("qid", "chunks", "tokens", "summarise", F.array_join("sources", " ").alias("sources"), F.sha2("context", 256).alias("context"))


@query("r8_summary_texts", f"with {_FILED}, {_HITS.replace('vectors', 'filed')}, k as (select h.*, content, ((place - 1) // 10)::int as bucket from h join filed using (chunk_id) where place <= 40) select qid, bucket, sum(token_count)::bigint as tokens, sha256(string_agg('## ' || k.file_path || ' (lines 1-' || len(string_split(content, chr(10))) || ')' || chr(10) || content, chr(10) || chr(10) order by place)) as document, sum(sum(token_count)) over (partition by qid) > 14000 as again from k group by 1, 2", "source_files")
def summary_texts(spark, sf_dir):
    """The document of each bucket of ten hits that is to be summarised, and whether the summaries need one more."""
    v = _filed(spark, sf_dir)
    texts = v.select("chunk_id", F.lit(1).alias("start_line"), F.size(F.split("content", "\n")).alias("end_line"), F.col("content").alias("chunk"))
    rows = retrieval.summary_documents(ops.knn(_ask(v, "vec_id % 100 = 0"), v, 40), texts, 10, 14_000)
    return rows.withColumn("document", F.sha2("document", 256))

"""Queries over source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.rules import BINARY_EXTENSIONS, CHUNKER_LANGUAGES, DECISION_POINTS, EXCLUDED_DIRS, ROUTER_LANGUAGES, SOURCE_EXTENSIONS, sql_case, sql_list
from strandline.operators import files as ops
from strandline.operators import chunking, clusters, retrieval, scans, units
from strandline.plans.registry import query
from strandline.sources import tables, views
from strandline.streaming import jobs

#: Documents are short, so the registered queries route at smaller sizes than the defaults.
DIRECT, RAG = 2048, 16384

_EXCLUDED = f"len(list_intersect(string_split(file_path, '/')[:-2], [{', '.join(repr(d) for d in EXCLUDED_DIRS)}])) > 0"
_SKIP = f"case when {_EXCLUDED} then 'skipped_excluded_path' when ext in {sql_list(BINARY_EXTENSIONS)} then 'skipped_binary' when ext not in {sql_list(SOURCE_EXTENSIONS)} then 'skipped_excluded_path' when size_bytes > {RAG} then 'skipped_too_large' end"
_ROUTE = f"case when size_bytes < {DIRECT} then 'DirectSend' when size_bytes <= {RAG} then 'RagChunks' else 'Skipped' end"
def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.source_files(spark, sf_dir)


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis plan: every file with its decision, or why it is skipped."""
    ext, size = F.col("ext"), F.col("size_bytes")
    reason = ops.skip_reason(F.col("file_path"), ext, size, RAG)
    return _files(spark, sf_dir).select("doc_id", "project_id", "file_path", "ext", "size_bytes", reason.alias("reason"), F.when(reason.isNull(), ops.route(size, DIRECT, RAG)).otherwise("Skipped").alias("decision"), (size / 4).cast("bigint").alias("tokens"), ops.router_language(ext).alias("language"))


_PLAN = f"p as (select doc_id, project_id, file_path, ext, size_bytes, {_SKIP} as reason, case when {_SKIP} is null then {_ROUTE} else 'Skipped' end as decision, size_bytes // 4 as tokens, {sql_case('ext', ROUTER_LANGUAGES)} as language from source_files)"


@query("s2_scan_source_files", f"select doc_id, file_path, size_bytes from source_files where ext in {sql_list(SOURCE_EXTENSIONS)} and not ({_EXCLUDED})", "source_files")
def scan_source_files(spark, sf_dir):
    return _files(spark, sf_dir).where(F.col("ext").isin(*SOURCE_EXTENSIONS) & ~ops.is_excluded(F.col("file_path"))).select("doc_id", "file_path", "size_bytes")


@query("s3_read_text_bounded", "select doc_id, n_chars from source_files where length(content) <= 8000", "source_files")
def read_text_bounded(spark, sf_dir):
    return _files(spark, sf_dir).where(F.length("content") <= 8000).select("doc_id", "n_chars")


@query("s18_storage_usage", "select project_id, sum(size_bytes)::bigint as stored_bytes, count(*) as files from source_files group by 1", "source_files")
def storage_usage(spark, sf_dir):
    return _files(spark, sf_dir).groupBy("project_id").agg(F.sum("size_bytes").alias("stored_bytes"), F.count("*").alias("files"))


@query("s19_storage_policy", "select doc_id, case when project_id in ('src1', 'src2') then content end as content from source_files where project_id <> 'src5' and project_id <> 'src6'", "source_files")
def storage_policy(spark, sf_dir):
    """Two projects keep their texts; of two finished a while ago the failed one, and the one older still, are gone."""
    files = _files(spark, sf_dir)
    ended = F.when(F.col("project_id") == "src4", 40).when(F.col("project_id") == "src5", 40).when(F.col("project_id") == "src6", 100)
    as_of = F.expr("timestamp '2024-06-01 00:00:00'")
    projects = files.select("project_id").distinct().select("project_id", (F.col("project_id") == "src5").alias("failed"), (as_of - F.make_interval(days=ended)).alias("finished_at"))
    return ops.storage_policy(projects, files, as_of, F.col("project_id").isin("src1", "src2")).select("doc_id", "content")


@query("f1_extension", "select doc_id, lower(regexp_extract(file_path, '(\\.[^./\\\\]*)$', 1)) as extension from source_files", "source_files")
def extension(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", ops.extension(F.col("file_path")).alias("extension"))


@query("f2_detect_language", f"select doc_id, {sql_case('ext', ROUTER_LANGUAGES)} as router, {sql_case('ext', CHUNKER_LANGUAGES, repr('text'))} as chunker from source_files", "source_files")
def detect_language(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", ops.router_language(F.col("ext")).alias("router"), ops.chunker_language(F.col("ext")).alias("chunker"))


@query("f3_is_excluded_path", f"select doc_id, {_EXCLUDED} as excluded from source_files", "source_files")
def is_excluded_path(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", ops.is_excluded(F.col("file_path")).alias("excluded"))


@query("f4_f5_file_kinds", f"select doc_id, ext in {sql_list(BINARY_EXTENSIONS)} as is_binary, ext in {sql_list(SOURCE_EXTENSIONS)} as is_source, ext = '.cs' as is_csharp, ext in ('.csproj', '.fsproj', '.vbproj') as is_project, ext = '.sln' as is_solution, ext in ('.json', '.xml', '.yaml', '.yml', '.config') as is_config from source_files", "source_files")
def file_kinds(spark, sf_dir):
    ext = F.col("ext")
    return _files(spark, sf_dir).select("doc_id", ext.isin(*BINARY_EXTENSIONS).alias("is_binary"), ext.isin(*SOURCE_EXTENSIONS).alias("is_source"), (ext == ".cs").alias("is_csharp"), ext.isin(".csproj", ".fsproj", ".vbproj").alias("is_project"), (ext == ".sln").alias("is_solution"), ext.isin(".json", ".xml", ".yaml", ".yml", ".config").alias("is_config"))


@query("f6_route_file", f"select doc_id, {_ROUTE} as decision, case when size_bytes < {DIRECT} then 'File size ' || size_bytes || ' bytes < DirectSendThreshold {DIRECT}' when size_bytes <= {RAG} then 'File size ' || size_bytes || ' bytes within RAG range' else 'File size ' || size_bytes || ' bytes exceeds RagChunkThreshold {RAG}' end as reason from source_files", "source_files")
def route_file(spark, sf_dir):
    size = F.col("size_bytes")
    return _files(spark, sf_dir).select("doc_id", ops.route(size, DIRECT, RAG).alias("decision"), ops.route_reason(size, DIRECT, RAG).alias("reason"))


@query("f7_skip_reason", f"select doc_id, {_SKIP} as reason from source_files", "source_files")
def skip_reason(spark, sf_dir):
    return plan(spark, sf_dir).select("doc_id", "reason")


@query("f8_estimate_tokens", "select doc_id, size_bytes // 4 as tokens, floor(size_bytes * 0.25)::bigint as preflight_tokens from source_files", "source_files")
def estimate_tokens(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", (F.col("size_bytes") / 4).cast("bigint").alias("tokens"), F.floor(F.col("size_bytes") * 0.25).alias("preflight_tokens"))


@query("j5_incremental_new_chunks", "with c as (select distinct project_id, substr(sha256(content), 1, 16) as chunk_hash from source_files), o as (select distinct project_id, substr(sha256(content), 1, 16) as chunk_hash, true as known from source_files where doc_id % 3 = 0) select c.project_id, count(*) filter (where known is null) as new, count(known) as skipped, string_agg(c.chunk_hash, ',' order by c.chunk_hash) filter (where known is null) as hashes from c left join o on o.project_id = c.project_id and o.chunk_hash = c.chunk_hash group by 1", "source_files")
def incremental_new_chunks(spark, sf_dir):
    chunks = _files(spark, sf_dir).select("doc_id", "project_id", F.substr(F.sha2("content", 256), F.lit(1), F.lit(16)).alias("chunk_hash"))
    new = ops.new_chunks(chunks, chunks.where("doc_id % 3 = 0")).groupBy(F.col("project_id").alias("p")).agg(F.count("*").alias("new"), F.array_join(F.array_sort(F.collect_list("chunk_hash")), ",").alias("hashes"))
    every = chunks.groupBy("project_id").agg(F.count_distinct("chunk_hash").alias("n"))
    rows = every.join(new, F.col("project_id") == F.col("p"), "left").withColumn("new", F.coalesce("new", F.lit(0).cast("bigint")))
    return rows.select("project_id", "new", (F.col("n") - F.col("new")).alias("skipped"), "hashes")


_SCRIPT = "(?m)^import\\s+.*from\\s+[''\"]([^''\"]+)[''\"];?"
_IMPORTS = f"list_distinct(case when ext = '.cs' then list_transform(regexp_extract_all(content, '(?m)^\\s*using\\s+([^;]+);', 1), lambda x: trim(x)) when ext in ('.ts', '.tsx', '.js', '.jsx') then regexp_extract_all(content, '{_SCRIPT}', 1) when ext = '.py' then regexp_extract_all(content, '(?m)^(?:import|from)\\s+([^\\s]+)', 1) else [] end)"
_COMPLEXITY = "case when ext = '.cs' then (" + " + ".join(["1", *(f"(length(content) - length(replace(content, '{k}', ''))) // {len(k)}" for k in DECISION_POINTS)]) + ") else 0 end::bigint"
_LIKE = f"f as (select project_id, {sql_case('ext', CHUNKER_LANGUAGES, repr('text'))} as language, string_split(file_path, '/')[1:-2] as d, array_to_string(string_split(file_path, '/')[1:-2], '/') as folder, list_sort({_IMPORTS}) as deps, {_COMPLEXITY} as complexity, file_path from code_files)"
_SCORE = "0.3 * (a.language is not distinct from b.language)::int + 0.3 * (case when a.folder = b.folder then 1.0 when starts_with(a.folder, b.folder) or starts_with(b.folder, a.folder) then 0.7 else len(list_intersect(a.d, b.d))::double / greatest(len(a.d), len(b.d), 1) end) + 0.2 * coalesce(len(list_intersect(a.deps, b.deps))::double / nullif(len(list_distinct(list_concat(a.deps, b.deps))), 0), 0) + 0.2 * greatest(0, 1 - abs(a.complexity - b.complexity) / 50.0::double)"


def _like(spark, sf_dir):
    """Files with what their similarity needs."""
    files = views.code_files(spark, sf_dir)
    parts = F.split("file_path", "/")
    complexity = F.when(F.col("ext") == ".cs", ops.cyclomatic(F.col("content"))).otherwise(0).cast("bigint")
    return files.select("project_id", "file_path", ops.chunker_language(F.col("ext")).alias("language"), F.slice(parts, F.lit(1), F.size(parts) - 1).alias("dir"), F.array_sort(scans.dependencies(F.col("content"), F.col("ext"))).alias("dependencies"), complexity.alias("complexity"))


@query("j7_file_similarity_pairs", f"with {_LIKE}, c as (select project_id, language, d, folder, deps, complexity, count(*) as files, min(file_path) as file_path from f group by all) select a.project_id, a.file_path as a, b.file_path as b, a.files * b.files as pairs, round({_SCORE}, 6)::double as score from c a join c b on a.project_id = b.project_id and a.d[1] = b.d[1] and a.file_path < b.file_path", "code_files")
def file_similarity_pairs(spark, sf_dir):
    """Similarity between the files of a project that share their top folder.

    Files that score alike are one class: pairs are of classes, each named by its first file, with the number of file pairs that
    they stand for, so copies are not expanded into pairs."""
    m = _like(spark, sf_dir).groupBy("project_id", *ops.PARTS).agg(F.count("*").alias("files"), F.min("file_path").alias("file_path"))
    m = m.withColumn("top", F.get("dir", F.lit(0)))
    a, b = m.alias("a"), m.alias("b")
    both = a.join(b, (F.col("a.project_id") == F.col("b.project_id")) & (F.col("a.top") == F.col("b.top")) & (F.col("a.file_path") < F.col("b.file_path")))
    score = ops.similarity({c: F.col(f"a.{c}") for c in ops.PARTS}, {c: F.col(f"b.{c}") for c in ops.PARTS})
    return both.select("a.project_id", F.col("a.file_path").alias("a"), F.col("b.file_path").alias("b"), (F.col("a.files") * F.col("b.files")).alias("pairs"), F.round(score, 6).alias("score"))


@query("a15_normalize_clusters", f"with {_LIKE}, c as (select project_id, folder as cluster, count(*) as files, arg_min(struct_pack(language := language, d := d, folder := folder, deps := deps, complexity := complexity), (file_path, complexity, language)) as x from f group by 1, 2), r as (select project_id, cluster, files, x.language as language, x.d as d, x.folder as folder, x.deps as deps, x.complexity as complexity, row_number() over (partition by project_id order by files desc, cluster) as place from c), m as (select a.project_id, a.cluster, arg_min(b.cluster, (-({_SCORE}), b.cluster)) as into_ from r a join r b on a.project_id = b.project_id where a.place > 4 and b.place <= 4 group by 1, 2) select project_id, cluster, cluster as \"into\" from r where place <= 4 union all select * from m", "code_files")
def normalize_clusters(spark, sf_dir):
    """Folders as clusters, of which each project keeps four; the others join the kept one that is most like them."""
    first = F.min_by(F.struct(*ops.PARTS), F.struct("file_path", "complexity", "language")).alias("x")
    c = _like(spark, sf_dir).groupBy("project_id", F.array_join("dir", "/").alias("cluster")).agg(F.count("*").alias("files"), first)
    return ops.merge_clusters(c.select("project_id", "cluster", "files", "x.*"), 4)


@query("j7_similar_files", f"with {_LIKE}, c as (select project_id, language, d, folder, deps, complexity, count(*) as files, min(file_path) as file_path from f group by all) select a.project_id, a.file_path as a, b.file_path as b, a.files * b.files as pairs, round({_SCORE}, 6)::double as score from c a join c b on a.project_id = b.project_id and a.file_path < b.file_path where round({_SCORE}, 6) >= 0.85", "code_files")
def similar_files(spark, sf_dir):
    """Pairs of classes of files of a project, in any folders, that score 0.85 at least."""
    return clusters.similar_pairs(_like(spark, sf_dir), 0.85)


def _rounds_sql(most: int, rounds: int) -> str:
    """The loop over clusters unrolled: in each round the smallest of a project that has too many joins the one most like it."""
    steps, s, m = [], "s0", "m0"
    cols = "project_id, cluster, language, d, folder, deps, complexity"
    for k in range(rounds):
        steps.append(f"t{k} as (select * from (select *, count(*) over (partition by project_id) as c, row_number() over (partition by project_id order by n, cluster) as r from {s}) where c > {most} and r = 1), b{k} as (select a.project_id, a.cluster as gone, a.n as gone_n, arg_min(b.cluster, (-({_SCORE}), b.cluster)) as into_ from t{k} a join {s} b on a.project_id = b.project_id and a.cluster <> b.cluster group by 1, 2, 3), s{k + 1} as (select {s}.project_id, {s}.cluster, n + case when {s}.cluster = b{k}.into_ then gone_n else 0 end as n, language, d, folder, deps, complexity from {s} left join b{k} on b{k}.project_id = {s}.project_id where gone is null or {s}.cluster <> gone), m{k + 1} as (select {m}.project_id, {m}.cluster, coalesce(b{k}.into_, {m}.into_) as into_ from {m} left join b{k} on b{k}.project_id = {m}.project_id and b{k}.gone = {m}.into_)")
        s, m = f"s{k + 1}", f"m{k + 1}"
    return f"with {_LIKE}, s0 as (select project_id, cluster, n, x.language as language, x.d as d, x.folder as folder, x.deps as deps, x.complexity as complexity from (select project_id, folder as cluster, count(*) as n, arg_min(struct_pack(language := language, d := d, folder := folder, deps := deps, complexity := complexity), (file_path, complexity)) as x from f group by 1, 2)), m0 as (select project_id, cluster, cluster as into_ from s0), {', '.join(steps)} select project_id, f.file_path, into_ as cluster from f join {m} using (project_id) where {m}.cluster = f.folder"


@query("a15_clusters_to_count", _rounds_sql(6, 16), "code_files")
def clusters_to_count(spark, sf_dir):
    """The files of each project in at most six clusters: folders, merged one at a time until that holds."""
    files = _like(spark, sf_dir).withColumn("cluster", F.array_join("dir", "/"))
    return clusters.normalize(files, lambda df, kind: jobs.kept(df, kind), fewest=1, most=6)


@query("a2_file_type_breakdown", "select project_id, ext, count(*) as files from source_files where ext <> '' group by 1, 2", "source_files")
def file_type_breakdown(spark, sf_dir):
    return _files(spark, sf_dir).where("ext <> ''").groupBy("project_id", "ext").agg(F.count("*").alias("files"))


@query("a3_plan_counts", f"with {_PLAN} select project_id, count(*) filter (where decision = 'DirectSend') as direct, count(*) filter (where decision = 'RagChunks') as rag, count(*) filter (where decision = 'Skipped') as skipped, sum(case when decision <> 'Skipped' then tokens else 0 end)::bigint as tokens, sum(size_bytes)::bigint as bytes, sum(case when decision = 'RagChunks' then ceil(tokens / 1600.0) when decision = 'DirectSend' then 1 else 0 end)::bigint as chunks from p group by 1", "source_files")
def plan_counts(spark, sf_dir):
    d = F.col("decision")
    return plan(spark, sf_dir).groupBy("project_id").agg(F.count_if(d == "DirectSend").alias("direct"), F.count_if(d == "RagChunks").alias("rag"), F.count_if(d == "Skipped").alias("skipped"), F.sum(F.when(d != "Skipped", F.col("tokens")).otherwise(0)).alias("tokens"), F.sum("size_bytes").alias("bytes"), F.sum(F.when(d == "RagChunks", F.ceil(F.col("tokens") / 1600)).when(d == "DirectSend", 1).otherwise(0)).alias("chunks"))


@query("a4_estimate_analysis", f"with {_PLAN}, g as (select project_id, sum(case when decision <> 'Skipped' then tokens else 0 end)::bigint as tokens, count(*) filter (where decision <> 'Skipped') as kept, count(*) filter (where decision = 'Skipped') as n, list_slice(list(file_path order by file_path) filter (where decision = 'Skipped'), 1, 50) as skipped from p group by 1) select project_id, tokens, (tokens * 0.00003)::double as cost, tokens // 1000 + kept as seconds, tokens > 1000 as needs_approval, array_to_string(list_filter([case when tokens > 500 then 'large job' end, case when tokens * 0.00003 > 0.02 then 'high cost' end, case when n > 0 then n || ' files will be skipped' end], lambda x: x is not null), ',') as warnings, coalesce(array_to_string(skipped, ','), '') as skipped from g", "source_files")
def estimate_analysis(spark, sf_dir):
    rows = ops.estimate(plan(spark, sf_dir), (500, 0.02), (1000, 1000.0))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("warnings", "skipped")})


@query("a13_split_clusters_by_language", f"with c as (select project_id, split_part(file_path, '/', 1) as cluster, {sql_case('ext', CHUNKER_LANGUAGES, repr('text'))} as language, count(*) as files from source_files group by 1, 2, 3) select project_id, cluster, language, files, case when count(*) over (partition by project_id, cluster) > 1 then cluster || ' (' || language || ')' else cluster end as name from c", "source_files")
def split_clusters_by_language(spark, sf_dir):
    c = _files(spark, sf_dir).groupBy("project_id", F.split("file_path", "/")[0].alias("cluster"), ops.chunker_language(F.col("ext")).alias("language")).agg(F.count("*").alias("files"))
    n = F.count("*").over(Window.partitionBy("project_id", "cluster"))
    return c.withColumn("name", F.when(n > 1, F.concat("cluster", F.lit(" ("), "language", F.lit(")"))).otherwise(F.col("cluster")))


@query("a33_skipped_summary", f"with {_PLAN}, s as (select project_id, file_path, row_number() over (partition by project_id order by file_path) as r, count(*) over (partition by project_id) as n from p where reason = 'skipped_too_large') select project_id, max(n) as skipped, string_agg(file_path, ', ' order by file_path) || case when max(n) > 10 then ' and ' || (max(n) - 10) || ' more' else '' end as summary from s where r <= 10 group by 1", "source_files")
def skipped_summary(spark, sf_dir):
    """Files that are too large, by project: how many, and the first ten."""
    large = plan(spark, sf_dir).where("reason = 'skipped_too_large'").select("project_id", "file_path")
    top = large.withColumn("r", F.row_number().over(Window.partitionBy("project_id").orderBy("file_path"))).where("r <= 10")
    names = top.groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_list("file_path")), ", ").alias("names"))
    rows = names.join(large.groupBy("project_id").agg(F.count("*").alias("skipped")), "project_id")
    return rows.select("project_id", "skipped", F.concat("names", F.when(F.col("skipped") > 10, F.concat(F.lit(" and "), (F.col("skipped") - 10).cast("string"), F.lit(" more"))).otherwise("")).alias("summary"))


@query("k3_files_ordered", "select project_id, file_path from source_files", "source_files")
def files_ordered(spark, sf_dir):
    """Files in the order of a project's list. A range sort, so a large project is many tasks."""
    return _files(spark, sf_dir).select("project_id", "file_path").orderBy("project_id", "file_path")


@query("k3_chunks_of_file", "with l as (select doc_id, file_path, len(string_split(content, chr(10))) as n from source_files), c as (select doc_id, file_path, n, unnest(range(0, greatest(n - 4 - 1, 0) + 1, 16)) as pos from l) select file_path, ((pos // 16))::int as chunk_index, (pos + 1)::int as start_line, least(pos + 20, n)::int as end_line from c", "source_files")
def chunks_of_file(spark, sf_dir):
    """The chunks of all files, by file and number. A range sort, so that a large file's project is many tasks."""
    chunks = ops.chunk_lines(_files(spark, sf_dir), 20, 4, "file_path")
    return chunks.select("file_path", "chunk_index", "start_line", "end_line").orderBy("file_path", "chunk_index")


@query("x1_count_tokens", """select doc_id, case when length(content) = 0 then 0 else greatest(1, ceil((ceil(length(content) / 4.0) * 6 + ceil(len(regexp_extract_all(content, '[\\p{L}\\p{M}\\p{N}\\p{Pc}]+')) * 13 / 10.0) * 3 + len(regexp_extract_all(content, '[{}()\\[\\];,.<>:=+\\-*/&|!?@#$%^~`\\\\''"]')) // 2) / 10)) end::bigint as tokens from source_files""", "source_files")
def count_tokens(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", ops.count_tokens(F.col("content")).alias("tokens"))


@query("x3_hashes", "select doc_id, substr(sha256(content), 1, 16) as text_hash, substr(sha256(project_id || ':' || file_path || ':1:9:' || substr(sha256(content), 1, 16)), 1, 16) as chunk_hash from source_files", "source_files")
def hashes(spark, sf_dir):
    text = F.substr(F.sha2("content", 256), F.lit(1), F.lit(16))
    return _files(spark, sf_dir).select("doc_id", text.alias("text_hash"), F.substr(F.sha2(F.concat_ws(":", "project_id", "file_path", F.lit("1"), F.lit("9"), text), 256), F.lit(1), F.lit(16)).alias("chunk_hash"))


@query("x4_content_fingerprint", "select sha256(content) as fingerprint, count(*) as copies, min(doc_id) as first_doc from source_files group by 1 having count(*) > 1", "source_files")
def content_fingerprint(spark, sf_dir):
    return _files(spark, sf_dir).groupBy(F.sha2("content", 256).alias("fingerprint")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("x12_match_line_numbers", "with l as (select doc_id, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) as line from source_files) select doc_id, line::int as line, left(trim(text), 200) as text from l where regexp_matches(text, '[0-9]{3}-[0-9]{4}|worthless')", "source_files")
def match_line_numbers(spark, sf_dir):
    lines = _files(spark, sf_dir).select("doc_id", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    return lines.where(F.col("text").rlike("[0-9]{3}-[0-9]{4}|worthless")).select("doc_id", (F.col("at") + 1).alias("line"), F.left(F.trim("text"), F.lit(200)).alias("text"))


_ODD = "case doc_id % 7 when 0 then concat('../', file_path) when 1 then concat(file_path, '::$DATA') when 2 then concat('/', file_path) when 3 then concat('C:/', file_path) when 4 then concat('ab:', file_path) when 5 then concat('C:x:', file_path) else file_path end"


@query("x19_has_path_traversal", f"select doc_id, contains(p, '..') or contains(p, '::') or starts_with(p, '/') or (contains(p, ':') and (instr(p, ':') <> 2 or contains(substr(p, 3), ':'))) as traversal from (select doc_id, {_ODD} as p from source_files)", "source_files")
def has_path_traversal(spark, sf_dir):
    """Paths of which most are spoiled, each in its own way."""
    return _files(spark, sf_dir).select("doc_id", ops.has_path_traversal(F.expr(_ODD)).alias("traversal"))


@query("x25_pack_prompt", "select doc_id, '### ' || file_path || chr(10) || left(content, 500) || case when length(content) > 500 then chr(10) || '... (truncated)' else '' end as prompt, '### ' || file_path || chr(10) || array_to_string(list_slice(string_split(content, chr(10)), 1, 5), chr(10)) || case when len(string_split(content, chr(10))) > 5 then chr(10) || '... (truncated)' else '' end as by_lines from source_files", "source_files")
def pack_prompt(spark, sf_dir):
    path, content = F.col("file_path"), F.col("content")
    return _files(spark, sf_dir).select("doc_id", ops.pack_prompt(path, content, 500).alias("prompt"), ops.pack_prompt(path, content, lines=5).alias("by_lines"))


_TREE = """f as (select project_id, array_to_string(p[1:-2], '/') as dir, p[-1] as name, len(p) - 1 as depth from (select project_id, string_split(file_path, '/') as p from code_files)), k as (select *, row_number() over (partition by project_id, dir order by name) as k, count(*) over (partition by project_id, dir) as n from f where depth <= 5), d as (select distinct project_id, array_to_string(list_slice(p, 1, i), '/') as dir, i as depth from (select project_id, string_split(file_path, '/') as p, unnest(range(1, len(string_split(file_path, '/')))) as i from code_files) where i <= 5), l as (select project_id, dir, 1 as kind, k, repeat('  ', depth) || name as text from k where k <= 20 union all select project_id, dir, 2, k, repeat('  ', depth) || (n - 20) || ' more files' from k where k = 20 and n > 20 union all select project_id, dir, 0, 0, repeat('  ', depth - 1) || string_split(dir, '/')[-1] || '/' from d)"""


@query("x33_directory_tree", f"with {_TREE} select project_id, string_agg(text, chr(10) order by dir, kind, k, text) as tree from l group by 1", "code_files")
def directory_tree(spark, sf_dir):
    return ops.tree(views.code_files(spark, sf_dir))


@query("x2_token_spans", """select doc_id, len(p)::int as pieces, list_sum(list_transform(p, lambda x: case when length(x) > 8 then 2 else 1 end))::bigint as tokens from (select doc_id, regexp_extract_all(content, '[{}()\\[\\];,.<>:=+\\-*/&|!?@#$%^~][^\\s{}()\\[\\];,.<>:=+\\-*/&|!?@#$%^~]*|[^\\s{}()\\[\\];,.<>:=+\\-*/&|!?@#$%^~]+') as p from code_files)""", "code_files")
def token_spans(spark, sf_dir):
    s = views.code_files(spark, sf_dir).select("doc_id", ops.token_spans(F.col("content")).alias("s"))
    return s.select("doc_id", F.size("s").alias("pieces"), F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]).alias("tokens"))


@query("u2_distinct_words", "select doc_id, len(list_distinct(string_split(content, ' ')))::int as words from source_files", "source_files")
def distinct_words(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", F.size(F.array_distinct(F.split("content", " "))).alias("words"))


@query("w4_chunk_numbering", "with l as (select doc_id, len(string_split(content, chr(10))) as n from source_files), c as (select doc_id, n, unnest(range(0, greatest(n - 4 - 1, 0) + 1, 16)) as pos from l) select doc_id, (row_number() over (partition by doc_id order by pos) - 1)::int as chunk_index, count(*) over (partition by doc_id) as total, (pos + 1)::int as start_line, least(pos + 20, n)::int as end_line from c", "source_files")
def chunk_numbering(spark, sf_dir):
    return ops.chunk_lines(_files(spark, sf_dir)).select("doc_id", "chunk_index", F.count("*").over(Window.partitionBy("doc_id")).alias("total"), "start_line", "end_line")


def _tokens_sql(chars: str, words: str, specials: str) -> str:
    return f"case when {chars} <= 0 then 0 else greatest(1, ((({chars}) + 3) // 4 * 6 + (({words}) * 13 + 9) // 10 * 3 + ({specials}) // 2 + 9) // 10) end"


def _window_sql(first: str, last: str) -> str:
    """Tokens of the lines first to last, counted from 0, without the empty ones at the beginning: b[first + 1] is the first line
    that is not empty, c, w and s are running sums."""
    begin = f"b[({first}) + 1]"
    return f"case when {begin} > {last} then 0 else " + _tokens_sql(f"(c[({last}) + 2] - c[{begin} + 1] + ({last}) - {begin})", f"(w[({last}) + 2] - w[{begin} + 1])", f"(s[({last}) + 2] - s[{begin} + 1])") + " end"


def _sliding_sql(most: int, overlap: int, least: int) -> str:
    """Common table expressions up to `cut` (doc_id, n, first, last, tokens): a step of the recursion for each window."""
    last = f"list_max(list_filter(range(least(greatest(p, b[p + 1]), n - 1)::bigint, n), lambda j: j = least(greatest(p, b[p + 1]), n - 1) or {_window_sql('p', 'j')} <= {most}))"
    back = f"greatest(p + 1, coalesce(list_max(list_filter(range(0, last + 2), lambda i: t[i + 1] <= t[last + 2] - {overlap})), 0))"
    return f"""li as (select doc_id, unnest(string_split(content, chr(10))) as x, generate_subscripts(string_split(content, chr(10)), 1) - 1 as k from source_files where content is not null),
lc as (select doc_id, k, length(x) as c, len(regexp_extract_all(x, '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+')) as w, len(regexp_extract_all(x, '[{{}}()\\[\\];,.<>:=+\\-*/&|!?@#$%^~`\\\\''"]')) as s from li),
lt as (select *, {_tokens_sql('c', 'w', 's')} as t, min(case when c > 0 then k end) over (partition by doc_id order by k rows between current row and unbounded following) as b from lc),
ru as (select doc_id, k, sum(c) over o as c, sum(w) over o as w, sum(s) over o as s, sum(t) over o as t, b from lt window o as (partition by doc_id order by k)),
sums as (select doc_id, count(*) as n, list_prepend(0::hugeint, list(c order by k)) as c, list_prepend(0::hugeint, list(w order by k)) as w, list_prepend(0::hugeint, list(s order by k)) as s, list_prepend(0::hugeint, list(t order by k)) as t, list(coalesce(b, 1099511627776) order by k) || [1099511627776] as b from ru group by 1),
win as (select doc_id, 0::bigint as p, 0::bigint as last, 0 as step from sums union all
select doc_id, case when step % 2 = 0 then p else {{back}} end, case when step % 2 = 0 then {last} else last end, step + 1 from win join sums using (doc_id) where step % 2 = 0 or last + 1 < n),""".replace("{back}", f"(case when {_window_sql(back, 'last + 1')} <= {most} then {back} else last + 1 end)") + f"""
cut as (select doc_id, p, last, {_window_sql('p', 'last')} as tokens from win join sums using (doc_id) where step % 2 = 1),
kept as (select * from cut where tokens >= {least}),
every as (select doc_id, p, last, tokens from kept union all select doc_id, 0, n - 1, {_tokens_sql('(c[n + 1] + n - 1)', 'w[n + 1]', 's[n + 1]')} from sums where doc_id not in (select doc_id from kept))"""


@query("r1_chunk_sliding", f"with recursive {_sliding_sql(300, 60, 20)} select doc_id, (row_number() over (partition by doc_id order by p) - 1)::int as chunk_index, (p + 1)::int as start_line, (last + 1)::int as end_line, tokens::int as tokens from every", "source_files")
def chunk_sliding(spark, sf_dir):
    return chunking.chunk_sliding(_files(spark, sf_dir), 300, 60, 20).drop("chunk")


@query("a21_indexing_result", "with l as (select project_id, file_path, content, len(string_split(content, chr(10))) as n from source_files), c as (select project_id, sum(len(range(0, greatest(n - 4 - 1, 0) + 1, 16)))::bigint as chunks from l where length(trim(content)) > 0 group by 1) select f.project_id, count(*) as files, count(*) filter (where length(trim(content)) = 0) as skipped, sum(size_bytes // 4)::bigint as tokens, max(chunks) as chunks, max(chunks) as embeddings from source_files f left join c on c.project_id = f.project_id group by 1", "source_files")
def indexing_result(spark, sf_dir):
    """What indexing by lines gives: files, those skipped, tokens, chunks and embeddings of each project."""
    files = _files(spark, sf_dir)
    blank = F.length(F.trim("content")) == 0
    starts = F.size(F.sequence(F.lit(0), F.greatest(F.size(F.split("content", "\n")) - 5, F.lit(0)), F.lit(16)))
    n = F.sum(F.when(~blank, starts)).alias("chunks")
    rows = files.groupBy("project_id").agg(F.count("*").alias("files"), F.count_if(blank).alias("skipped"), F.sum(F.floor(F.col("size_bytes") / 4)).alias("tokens"), n)
    return rows.withColumn("embeddings", F.col("chunks"))


@query("a21_chunk_table", f"with recursive {_sliding_sql(300, 60, 20)}, ct as (select e.*, f.project_id, f.file_path from every e join source_files f using (doc_id)) select f.project_id, f.files, f.files - coalesce(done, 0) as skipped, coalesce(chunks, 0) as chunks, coalesce(tokens, 0)::bigint as tokens, coalesce(errors, 0) as errors from (select project_id, count(distinct file_path) as files, count(*) filter (where size_bytes > 20000) as errors from source_files group by 1) f left join (select project_id, count(distinct file_path) as done, count(*) as chunks, sum(tokens) as tokens from ct group by 1) c using (project_id)", "source_files")
def chunk_table(spark, sf_dir):
    """What indexing gives, counted from the chunk table; files beyond a size are errors."""
    files = _files(spark, sf_dir)
    chunks = chunking.chunk_sliding(files, 300, 60, 20).join(files.select("doc_id", "project_id", "file_path"), "doc_id")
    return ops.indexing_result(files, chunks, files.where("size_bytes > 20000").select("project_id", F.lit("too large").alias("error")))


@query("r11_analysis_plan", f"with {_PLAN} select doc_id, decision, reason, tokens, language from p", "source_files")
def analysis_plan(spark, sf_dir):
    return plan(spark, sf_dir).select("doc_id", "decision", "reason", "tokens", "language")


@query("j6_scan_words", "with l as (select doc_id, file_path, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) as line from source_files where not regexp_matches(lower(file_path), 'test|example|sample')) select doc_id, line::int as line, 'mail' as rule, 'Low' as severity, unnest(regexp_extract_all(text, '(?i)[a-z0-9.]+@[a-z0-9]+')) as match from l union all select doc_id, line::int, 'insult', 'High', unnest(regexp_extract_all(text, '(?i)moron|idiot')) from l", "source_files")
def scan_words(spark, sf_dir):
    """The matches of rules that prose triggers."""
    files = _files(spark, sf_dir).where(~scans.is_test_path(F.col("file_path")))
    found = scans.matches(files, (("mail", "[a-z0-9.]+@[a-z0-9]+"), ("insult", "moron|idiot")))
    return found.select("doc_id", "line", "rule", scans.lookup(F.col("rule"), {"mail": "Low", "insult": "High"}).alias("severity"), "match")


_CLIMBING = "case doc_id % 5 when 0 then 'a/../' || file_path when 1 then './' || file_path || '/.' when 2 then '../../' || file_path when 3 then file_path || '/../z' || doc_id else '/' || replace(file_path, '/', '\\\\') end"


@query("x18_normalize_path", "select doc_id, case when doc_id % 5 = 3 then regexp_replace(file_path, '/[^/]+$', '') || '/z' || doc_id else file_path end as normalized, case doc_id % 5 when 0 then 'a/' || file_path when 3 then file_path || '/z' || doc_id else file_path end as sanitized from source_files", "source_files")
def normalize_path(spark, sf_dir):
    """Paths that climb, stay, or are written otherwise: popped at each climb, or with the climbs left out."""
    odd = _files(spark, sf_dir).select("doc_id", F.expr(_CLIMBING).alias("p"))
    return odd.select("doc_id", scans.normalized_path(F.col("p")).alias("normalized"), scans.sanitized_path(F.col("p")).alias("sanitized"))


_BUMPS = "[" + ", ".join(f"case when contains(' ' || lower(content) || ' ', ' {k} ') then 0.5 else 0 end" for k in retrieval.KEYWORDS) + "]"


@query("r6_hash_embedding", f"with d as (select doc_id, content, sha256(content) as d from source_files), v as (select doc_id, content, list_transform(range(0, 64), lambda i: (('0x' || substr(md5(d || ':' || i), 1, 8))::bigint % 2001) / 1000::double - 1) as noise, {_BUMPS} as bumps from d), w as (select doc_id, content, list_concat(list_transform(range(1, 31), lambda i: noise[i] + bumps[i]::double), [least(length(content) / 1000::double, 1), least(len(list_filter(string_split(content, ' '), lambda x: x <> '')) / 100::double, 1)], noise[33:64]) as e from v) select doc_id, case when trim(content) = '' then array_to_string(list_transform(range(0, 64), lambda i: 0), ',') else array_to_string(list_transform(e, lambda x: round(x / sqrt(list_inner_product(e, e)) * 100000)::bigint), ',') end as vector from w", "source_files")
def hash_embedding(spark, sf_dir):
    """The vectors, in hundred-thousandths."""
    e = _files(spark, sf_dir).select("doc_id", retrieval.hash_embedding(F.col("content")).alias("e"))
    return e.select("doc_id", F.array_join(F.transform("e", lambda x: F.round(x * 100_000).cast("bigint").cast("string")), ",").alias("vector"))


SIZES = {"most": 60, "overlap": 15, "least": 5}


@query("r4_chunk_corpus")
def chunk_corpus(spark, sf_dir):
    return chunking.chunk_corpus(views.code_files(spark, sf_dir), **SIZES).drop("chunk")


@query("r9_index_project")
def index_project(spark, sf_dir):
    """Chunk, embed, write, read back and verify: a result row for each project."""
    return retrieval.index_project(views.code_files(spark, sf_dir), jobs.shared_path(spark, "index"), **SIZES)


@query("r10_incremental_index")
def incremental_index(spark, sf_dir):
    """Indexing again with the chunks of a third of the files already stored: new chunks and those skipped."""
    files = views.code_files(spark, sf_dir)
    done = retrieval.chunked(files.where("doc_id % 3 = 0"), **SIZES).select("project_id", "chunk_hash")
    return retrieval.incremental_index(files, done, **SIZES)[1]


@query("x24_format_context", "with r as (select project_id as qid, file_path, content, row_number() over (partition by project_id order by file_path) as place from source_files) select qid, string_agg('## ' || file_path || ' (lines 1-' || len(string_split(content, chr(10))) || ')' || chr(10) || content, chr(10) || chr(10) order by place) as context from r where place <= 3 group by 1", "source_files")
def format_context(spark, sf_dir):
    w = Window.partitionBy("project_id").orderBy("file_path")
    hits = _files(spark, sf_dir).withColumn("place", F.row_number().over(w)).where("place <= 3")
    return retrieval.context(hits.select(F.col("project_id").alias("qid"), "place", "file_path", F.lit(1).alias("start_line"), F.size(F.split("content", "\n")).alias("end_line"), F.col("content").alias("chunk")))


@query("s6_s7_s11_replace_project", "select doc_id, project_id, case when project_id = 'src3' then n_chars + 1 else n_chars end as n_chars from source_files where project_id <> 'src4' union all select doc_id, project_id, n_chars from source_files where project_id = 'src4' and doc_id % 2 = 0", "source_files")
def replace_project(spark, sf_dir):
    """A table by project, in which two projects' rows are replaced, read back."""
    rows = _files(spark, sf_dir).select("doc_id", "project_id", "n_chars")
    path = jobs.shared_path(spark, "projects")
    tables.write_projects(rows, path)
    new = rows.where("project_id = 'src3'").withColumn("n_chars", F.col("n_chars") + 1).unionByName(rows.where("project_id = 'src4' and doc_id % 2 = 0"))
    tables.replace_projects(new, path)
    return spark.read.schema("doc_id long, n_chars long, project_id string").parquet(path).select("doc_id", "project_id", "n_chars")


_PY = "p as (select doc_id, text, line, len(string_split(content, chr(10))) as n from (select doc_id, content, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1)::int as line from code_files where ext = '.py')), h as (select doc_id, regexp_extract(text, '(?:def|class)[ \\t]+(\\w+)', 1) as name, line as start_line, coalesce(lead(line) over (partition by doc_id order by line) - 1, n)::int as end_line from p where regexp_matches(text, '^(?:async[ \\t]+)?(?:def|class)[ \\t]+\\w+'))"


@query("r3_python_units", f"with {_PY} select doc_id, name, start_line, end_line from h", "code_files")
def python_units(spark, sf_dir):
    return scans.python_units(views.code_files(spark, sf_dir))


@query("r2_r3_extract_units")
def extract_units(spark, sf_dir):
    return units.extract_units(views.code_files(spark, sf_dir), SIZES["most"])


_JAVA = r"\b[A-Za-z_][A-Za-z0-9_]*\s*\([^)]*\)\s*\{"
_SCRIPT_UNIT = r"function\s+[A-Za-z_][A-Za-z0-9_]*\s*\(|\b[A-Za-z_][A-Za-z0-9_]*\s*=\s*\([^)]*\)\s*=>"
_LINE = "length({0}) - length(replace({0}, chr(10), '')) + 1"
_UNITS_SQL = f"""with c as (select doc_id, ext, content, case when ext = '.java' then string_split_regex(content, '{_JAVA}') else string_split_regex(content, '{_SCRIPT_UNIT}') end as gaps, case when ext = '.java' then regexp_extract_all(content, '{_JAVA}') else regexp_extract_all(content, '{_SCRIPT_UNIT}') end as heads from code_files where ext in ('.java', '.ts', '.js')),
u as (select doc_id, content, head, k, 1 + list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(heads[1:k - 1], lambda x: length(x))), 0) as start from (select *, unnest(heads) as head, generate_subscripts(heads, 1) as k from c)),
b as (select doc_id, pos, content[pos] as brace, sum(case when content[pos] = '{{' then 1 else -1 end) over (partition by doc_id order by pos) as depth from (select doc_id, content, unnest(list_filter(range(1, length(content) + 1), lambda i: content[i] in ('{{', '}}'))) as pos from c)),
o as (select u.doc_id, u.k, any_value(u.content) as content, any_value(u.head) as head, any_value(u.start) as start, min(b.pos) as open from u left join b on b.doc_id = u.doc_id and b.brace = '{{' and b.pos >= u.start group by 1, 2),
e as (select o.doc_id, o.k, any_value(o.content) as content, any_value(o.head) as head, any_value(o.start) as start, any_value(o.open) as open, min(z.pos) as close from o left join b a on a.doc_id = o.doc_id and a.pos = o.open left join b z on z.doc_id = o.doc_id and z.pos > o.open and z.brace = '}}' and z.depth = a.depth - 1 group by 1, 2),
m as (select doc_id, coalesce(nullif(regexp_extract(head, 'function\\s+([A-Za-z_][A-Za-z0-9_]*)', 1), ''), regexp_extract(head, '^([A-Za-z_][A-Za-z0-9_]*)', 1)) as name, 'method' as type, {_LINE.format('content[:start::bigint - 1]')} as start_line, case when open is null then {_LINE.format('content[:least(length(content), start + 199)::bigint]')} when close is null then {_LINE.format('content')} else {_LINE.format('content[:close]')} end as end_line from e),
p as (select doc_id, text, line, n from (select doc_id, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) as line, len(string_split(content, chr(10))) as n from code_files where ext = '.py')),
d as (select doc_id, regexp_extract(text, '^\\s*def\\s+([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1) as name, 'method' as type, line as start_line, greatest(line, coalesce(min(case when regexp_matches(text, '^\\s*(?:def |class )') or regexp_matches(text, '^\\s*def\\s+[A-Za-z_][A-Za-z0-9_]*\\s*\\(') then line end) over (partition by doc_id order by line rows between 1 following and unbounded following) - 1, n)) as end_line, regexp_matches(text, '^\\s*def\\s+[A-Za-z_][A-Za-z0-9_]*\\s*\\(') as is_def from p),
own as (select doc_id, name, type, start_line, end_line from m union all select doc_id, name, type, start_line, end_line from d where is_def),
k as (select doc_id, regexp_extract(content, case when ext = '.java' then '\\bclass\\s+([A-Za-z_][A-Za-z0-9_]*)' else '(?m)^\\s*class\\s+([A-Za-z_][A-Za-z0-9_]*)' end, 1) as name, 'class' as type, 1 as start_line, {_LINE.format('content')} as end_line from code_files where ext in ('.java', '.py') and doc_id not in (select doc_id from own))
select doc_id, name, type, start_line::int as start_line, end_line::int as end_line from own union all select doc_id, name, type, start_line::int, end_line::int from k where name <> ''"""


@query("r2_units", _UNITS_SQL, "code_files")
def language_units(spark, sf_dir):
    """Functions of Java, script and Python files, or their class."""
    files = views.code_files(spark, sf_dir).where(F.col("ext").isin(".java", ".ts", ".js", ".py"))
    return units.extract_units(files).drop("namespace")

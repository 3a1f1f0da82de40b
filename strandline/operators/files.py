"""Operators over source files: scanning, routing, metrics, rules. Every one is a DataFrame of many projects at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.rules import BINARY_EXTENSIONS, CHUNKER_LANGUAGES, DECISION_POINTS, DIRECT, EXCLUDED_DIRS, METHODS, NAMESPACES, RAG, ROUTER_LANGUAGES, SOURCE_EXTENSIONS, THEMES, TYPES

WORDS = r"[\p{L}\p{M}\p{N}\p{Pc}]+"
SPECIALS = "[{}()\\[\\];,.<>:=+\\-*/&|!?@#$%^~`\\\\'\"]"


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def is_excluded(path: Column) -> Column:
    """True if a folder on the way to the file is on the excluded list; the file's own name does not count."""
    parts = F.split(path, r"[/\\]")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, EXCLUDED_DIRS)))


def router_language(ext: Column) -> Column:
    return _lookup(ext, ROUTER_LANGUAGES, F.lit(None))


def chunker_language(ext: Column) -> Column:
    return _lookup(ext, CHUNKER_LANGUAGES, F.lit("text"))


def _lookup(key: Column, mapping: dict[str, str], default: Column) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def route(size: Column, direct: int = DIRECT, rag: int = RAG, allow_large: bool = False) -> Column:
    """Below `direct` the file is sent whole, up to `rag` in chunks; larger ones are skipped unless allowed."""
    return F.when(size < direct, "DirectSend").when(size <= rag, "RagChunks").otherwise("RagChunks" if allow_large else "Skipped")


def route_reason(size: Column, direct: int = DIRECT, rag: int = RAG, allow_large: bool = False) -> Column:
    """Why `route` decides as it does."""
    n = size.cast("string")
    large = F.concat(F.lit("Large file ("), n, F.lit(" bytes) allowed via AllowLargeFiles override")) if allow_large else F.concat(F.lit("File size "), n, F.lit(f" bytes exceeds RagChunkThreshold {rag}"))
    return F.when(size < direct, F.concat(F.lit("File size "), n, F.lit(f" bytes < DirectSendThreshold {direct}"))).when(size <= rag, F.concat(F.lit("File size "), n, F.lit(" bytes within RAG range"))).otherwise(large)


def estimate(plan: DataFrame, warn: tuple[int, float] = (500_000, 10.0), approve: tuple[int, float] = (2_000_000, 50.0), most: int = 50) -> DataFrame:
    """A row for each project of a plan (project_id, file_path, decision, tokens): tokens, cost, seconds, whether it needs approval,
    warnings, and the first `most` skipped files. Thresholds are of tokens and of dollars. Skipped files are cut before they meet."""
    live = F.col("decision") != "Skipped"
    n = F.sum(F.when(live, F.col("tokens")).otherwise(0))
    g = plan.groupBy("project_id").agg(n.alias("tokens"), F.count_if(live).alias("kept"), F.count_if(~live).alias("n_skipped"))
    g = g.withColumn("cost", (F.col("tokens").cast("decimal(20,0)") * F.lit("0.00003").cast("decimal(8,5)")).cast("decimal(18,5)"))
    warnings = F.array_compact(F.array(F.when(F.col("tokens") > warn[0], "large job"), F.when(F.col("cost") > warn[1], "high cost"), F.when(F.col("n_skipped") > 0, F.concat(F.col("n_skipped").cast("string"), F.lit(" files will be skipped")))))
    w = Window.partitionBy("project_id").orderBy("file_path")
    first = plan.where(~live).select(F.col("project_id"), "file_path").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    names = first.groupBy(F.col("project_id").alias("p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "file_path"))), lambda x: x["file_path"]).alias("skipped"))
    rows = g.join(names, F.col("project_id") == F.col("p"), "left")
    return rows.select("project_id", "tokens", F.col("cost").cast("double").alias("cost"), (F.floor(F.col("tokens") / 1000) + F.col("kept")).alias("seconds"), ((F.col("tokens") > approve[0]) | (F.col("cost") > approve[1])).alias("needs_approval"), warnings.alias("warnings"), F.coalesce("skipped", F.array().cast("array<string>")).alias("skipped"))


def has_path_traversal(path: Column) -> Column:
    """Climbing, a stream mark, an absolute path, or a colon other than that of a drive."""
    return path.contains("..") | path.contains("::") | path.rlike(r"^[/\\]") | path.rlike(r"^(?:|..+):") | path.rlike(r"^.:.*:")


def pack_prompt(path: Column, content: Column, most: int = 10_000, lines: int | None = None) -> Column:
    """A file under its path, cut to so many characters, or to so many lines, with a note where it is cut."""
    if lines is None:
        cut, over = F.left(content, F.lit(most)), F.length(content) > most
    else:
        parts = F.split(content, "\n")
        cut, over = F.array_join(F.slice(parts, 1, lines), "\n"), F.size(parts) > lines
    return F.concat(F.lit("### "), path, F.lit("\n"), cut, F.when(over, "\n... (truncated)").otherwise(""))


def storage_policy(projects: DataFrame, files: DataFrame, as_of: Column, keep_text: Column, days: int = 90, failed_days: int = 30) -> DataFrame:
    """Files of projects within their retention; the text only where it is to be kept. projects: project_id, failed, finished_at."""
    until = F.col("finished_at") + F.make_interval(days=F.when(F.col("failed"), failed_days).otherwise(days))
    live = projects.where(F.col("finished_at").isNull() | (until > as_of)).select(F.col("project_id").alias("p"))
    return files.join(live, F.col("project_id") == F.col("p"), "left_semi").withColumn("content", F.when(keep_text, F.col("content")))


def skip_reason(path: Column, ext: Column, size: Column, rag: int = RAG) -> Column:
    """Null if the file is analysed. A file that is no source file has the code of an excluded path."""
    return F.when(is_excluded(path), "skipped_excluded_path").when(ext.isin(*BINARY_EXTENSIONS), "skipped_binary").when(~ext.isin(*SOURCE_EXTENSIONS), "skipped_excluded_path").when(size > rag, "skipped_too_large")


def count_tokens(text: Column) -> Column:
    """A weighted estimate from characters, words and special characters; at least 1 for a text that is not empty."""
    chars = F.ceil(F.length(text) / 4) * 6
    words = F.ceil(F.regexp_count(text, F.lit(WORDS)) * 13 / 10) * 3
    specials = F.floor(F.regexp_count(text, F.lit(SPECIALS)) / 2)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((chars + words + specials) / 10))).cast("bigint")


def occurrences(text: Column, part: str) -> Column:
    """How often a literal stands in a text, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("bigint")


def cyclomatic(text: Column) -> Column:
    return sum((occurrences(text, k) for k in DECISION_POINTS), F.lit(1).cast("bigint"))


def code_lines(content: Column) -> Column:
    """Lines that are neither blank, nor line comments, nor inside a block comment: a fold over the file's own lines.

    A line that begins with /* opens a comment, one that ends with */ closes it; neither counts."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    start = F.struct(F.lit(False).alias("open"), F.lit(0).cast("bigint").alias("n"))

    def step(s: Column, t: Column) -> Column:
        inside = s["open"] | t.startswith("/*")
        counts = ~inside & (t != "") & ~t.startswith("//")
        return F.struct((inside & ~t.endswith("*/")).alias("open"), (s["n"] + counts.cast("bigint")).alias("n"))

    return F.aggregate(lines, start, step, lambda s: s["n"])


def metrics(files: DataFrame, *more: str) -> DataFrame:
    """(doc_id, project_id, file_path, ext, total_lines, loc, types, methods, namespaces, complexity).

    C# files by patterns; of others only the lines and the lines that are not blank, the rest is 0."""
    text, csharp = F.col("content"), F.col("ext") == ".cs"
    lines = F.split(text, "\n")
    count = lambda pattern: F.when(csharp, F.regexp_count(text, F.lit(pattern))).otherwise(0).cast("bigint")
    measures = F.struct(
        F.size(lines).cast("bigint").alias("total_lines"),
        F.when(csharp, code_lines(text)).otherwise(F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(" \t\r")) != "")).cast("bigint")).alias("loc"),
        count(TYPES).alias("types"), count(METHODS).alias("methods"), count(NAMESPACES).alias("namespaces"),
        F.when(csharp, cyclomatic(text)).otherwise(0).cast("bigint").alias("complexity"),
    )
    # generated, so that a filter on a measure is not pushed below, where it would compute them all over again
    return files.select("doc_id", "project_id", "file_path", "ext", *more, F.inline(F.array(measures)))


def risk_level(complexity: Column, loc: Column, methods: Column) -> Column:
    points = (
        F.when(complexity > 30, 3).when(complexity > 20, 2).when(complexity > 10, 1).otherwise(0)
        + F.when(loc > 1000, 3).when(loc > 500, 2).when(loc > 250, 1).otherwise(0)
        + F.when(methods > 30, 2).when(methods > 20, 1).otherwise(0)
    )
    return F.when(points >= 7, "Critical").when(points >= 5, "High").when(points >= 3, "Medium").otherwise("Low")


def aggregate_metrics(measured: DataFrame, *by: str) -> DataFrame:
    """Sums of the metrics; without files all are zero."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c)
    return measured.groupBy(*by).agg(F.count("*").alias("files"), total("loc"), total("total_lines"), total("types"), total("methods"), F.coalesce(F.round(F.avg("complexity"), 6), F.lit(0.0)).alias("avg_complexity"), F.coalesce(F.max("complexity"), F.lit(0).cast("bigint")).alias("max_complexity"))


def summaries(files: DataFrame, imports: Column) -> DataFrame:
    """The static summary of each file: language, lines, methods, complexity (the mean in whole numbers), risk, digest, imports."""
    measured = metrics(files.withColumns({"_imports": imports, "_digest": F.sha2("content", 256)}), "_imports", "_digest")
    mean = F.when(F.col("complexity") > 0, F.floor(F.col("complexity") / F.greatest(F.lit(1), F.col("methods")))).otherwise(0).cast("bigint")
    return measured.select("doc_id", chunker_language(F.col("ext")).alias("language"), "loc", "methods", mean.alias("avg_complexity"), F.col("complexity").alias("max_complexity"), risk_level(F.col("complexity"), F.col("loc"), F.col("methods")).alias("risk"), F.col("_digest").alias("content_hash"), F.col("_imports").alias("imports"))


def theme(directory: Column) -> Column:
    """Theme of a folder by words in its name."""
    name, out = F.lower(directory), None
    for words, value in THEMES:
        has = name.rlike("|".join(words))
        out = F.when(has, value) if out is None else out.when(has, value)
    return out.otherwise("Mixed")


def cluster_name(directory: Column) -> Column:
    """The theme, or the folder's words each with a capital first letter, run together."""
    words = F.filter(F.split(directory, "[_ -]"), lambda x: x != "")
    pascal = F.array_join(F.transform(words, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 1 << 30)))), "")
    return F.when(theme(directory) != "Mixed", theme(directory)).otherwise(pascal)


def format_bytes(size: Column) -> Column:
    """Whole bytes; kilobytes and megabytes with one decimal, gigabytes with two."""
    shown = lambda power, digits, unit: F.concat(F.format_string(f"%.{digits}f", size / float(1024**power)), F.lit(f" {unit}"))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024**2, shown(1, 1, "KB")).when(size < 1024**3, shown(2, 1, "MB")).otherwise(shown(3, 2, "GB"))


def high_priority(measured: DataFrame, complexity: float = 25, loc: int = 1000) -> DataFrame:
    """Measured files beyond a threshold, or of risk High or Critical; most complex first."""
    risk = risk_level(F.col("complexity"), F.col("loc"), F.col("methods"))
    return measured.withColumn("risk", risk).where((F.col("complexity") > complexity) | (F.col("loc") > loc) | F.col("risk").isin("High", "Critical")).orderBy(F.desc("complexity"), "file_path")


#: Words in the paths of files that a security review reads first.
CRITICAL_PATHS = ("auth", "security", "login", "password", "crypto", "controller")


def deep_dive(measured: DataFrame, most: int = 5, by: str = "complexity") -> DataFrame:
    """(project_id, file_path, place): the files of each project that are looked into: by complexity, then lines of code; by loc,
    the longest ones; by path, the first ones by name whose path has a word of security."""
    order = {"complexity": [F.desc("complexity"), F.desc("loc")], "loc": [F.desc("loc")], "path": []}[by]
    rows = measured.where(F.lower("file_path").rlike("|".join(CRITICAL_PATHS))) if by == "path" else measured
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(*order, "file_path", "doc_id"))
    return rows.select("project_id", "file_path", place.alias("place")).where(F.col("place") <= most)


def indexing_result(files: DataFrame, chunks: DataFrame, errors: DataFrame) -> DataFrame:
    """(project_id, files, skipped, chunks, tokens, errors) of each project with files (project_id, file_path): from the chunk
    table (project_id, file_path, tokens) and the errors (project_id, error); a file without a chunk is skipped."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    own = lambda df, name, *aggs: df.groupBy(F.col("project_id").alias(name)).agg(*aggs)
    seen = files.groupBy("project_id").agg(F.count_distinct("file_path").alias("files"))
    done = own(chunks, "c", F.count_distinct("file_path").alias("done"), F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))
    failed = own(errors, "e", F.count("*").alias("errors"))
    rows = seen.join(done, F.col("project_id").eqNullSafe(F.col("c")), "left").join(failed, F.col("project_id").eqNullSafe(F.col("e")), "left")
    return rows.select("project_id", "files", (F.col("files") - F.coalesce("done", F.lit(0))).alias("skipped"), n("chunks"), n("tokens"), n("errors"))


def directories(files: DataFrame) -> DataFrame:
    """(project_id, file_path, dir, depth) of each folder above each file."""
    parts = F.split("file_path", "/")
    depths = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    rows = files.where(F.contains(F.col("file_path"), F.lit("/"))).select("project_id", "file_path", parts.alias("p"), F.explode(depths).alias("depth"))
    return rows.select("project_id", "file_path", F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("dir"), "depth")


def new_chunks(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose hash is neither stored nor repeated in the batch."""
    return chunks.dropDuplicates(["project_id", "chunk_hash"]).join(stored.select("project_id", "chunk_hash"), ["project_id", "chunk_hash"], "left_anti")


def chunk_lines(files: DataFrame, lines: int = 20, overlap: int = 4, *more: str) -> DataFrame:
    """Fixed windows of lines with an overlap: (doc_id, chunk_index, start_line, end_line, chunk), lines counted from 1; `more` are
    columns of the file that its chunks carry."""
    split = files.select("doc_id", *more, F.split("content", "\n").alias("l"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("l") - overlap - 1, F.lit(0)), F.lit(lines - overlap))
    cut = split.select("doc_id", *more, "l", F.posexplode(starts).alias("chunk_index", "at"))
    end = F.least(F.col("at") + lines, F.size("l"))
    return cut.select("doc_id", *more, "chunk_index", (F.col("at") + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice("l", F.col("at") + 1, end - F.col("at")), "\n").alias("chunk"))


def token_spans(text: Column) -> Column:
    """Pieces of a text (piece, tokens): cut at white space and before special characters; a piece of more than eight
    characters is two tokens."""
    parts = F.regexp_extract_all(text, F.lit(r"[{}()\[\];,.<>:=+\-*/&|!?@#$%^~][^\s{}()\[\];,.<>:=+\-*/&|!?@#$%^~]*|[^\s{}()\[\];,.<>:=+\-*/&|!?@#$%^~]+"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(p.alias("piece"), F.when(F.length(p) > 8, 2).otherwise(1).alias("tokens")))


def similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """How alike two files are, 0 to 1: language 0.3, folder 0.3, shared dependencies 0.2, complexity 0.2. a, b: language, dir
    (its parts), dependencies, complexity."""
    same = (a["language"].eqNullSafe(b["language"])).cast("int")
    one, two = (F.array_join(x["dir"], "/") for x in (a, b))
    parts = F.size(F.array_intersect(a["dir"], b["dir"])) / F.greatest(F.size(a["dir"]), F.size(b["dir"]), F.lit(1))
    folder = F.when(one == two, 1.0).when(one.startswith(two) | two.startswith(one), 0.7).otherwise(parts)
    shared = F.coalesce(F.try_divide(F.size(F.array_intersect(a["dependencies"], b["dependencies"])), F.size(F.array_union(a["dependencies"], b["dependencies"]))), F.lit(0.0))
    near = F.greatest(F.lit(0.0), 1 - F.abs(a["complexity"] - b["complexity"]) / 50.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.3 * same + 0.3 * folder + 0.2 * shared + 0.2 * near))


PARTS = ("language", "dir", "dependencies", "complexity")


def merge_clusters(clusters: DataFrame, most: int = 25) -> DataFrame:
    """(project_id, cluster, into) of clusters (project_id, cluster, files, and the parts of `similarity` of one of its files): a
    project keeps its `most` largest; each other one goes into the kept one that is most like it."""
    size = Window.partitionBy("project_id").orderBy(F.desc("files"), "cluster")
    ranked = clusters.withColumn("place", F.row_number().over(size))
    kept, rest = ranked.where(F.col("place") <= most), ranked.where(F.col("place") > most)
    other = kept.select(F.col("project_id").alias("p"), F.col("cluster").alias("into"), *(F.col(c).alias(f"k_{c}") for c in PARTS))
    pairs = rest.join(other, F.col("project_id") == F.col("p")).withColumn("score", similarity({c: F.col(c) for c in PARTS}, {c: F.col(f"k_{c}") for c in PARTS}))
    best = pairs.groupBy("project_id", "cluster").agg(F.min_by("into", F.struct(-F.col("score"), "into")).alias("into"))
    return kept.select("project_id", "cluster", F.col("cluster").alias("into")).unionByName(best)


def split_cluster(files: DataFrame, threshold: float = 0.65, rounds: int = 8) -> DataFrame:
    """(project_id, file_path, part) of the files of a project's largest cluster (project_id, file_path, parts of `similarity`).

    Each round the first file that is left leads a part and takes all that are more alike than the threshold; a join with one
    row of each project. What is left after the rounds is the last part."""
    found, left = None, files
    for number in range(1, rounds + 1):
        lead = left.groupBy(F.col("project_id").alias("p")).agg(F.min_by(F.struct(*PARTS, "file_path"), "file_path").alias("lead"))
        scored = left.join(F.broadcast(lead), F.col("project_id") == F.col("p")).withColumn("near", (F.col("file_path") == F.col("lead.file_path")) | (similarity({c: F.col(c) for c in PARTS}, {c: F.col(f"lead.{c}") for c in PARTS}) > threshold))
        took = scored.where("near").select("project_id", "file_path", F.lit(number).alias("part"))
        found = took if found is None else found.unionByName(took)
        left = scored.where("not near").select(files.columns)
    return found.unionByName(left.select("project_id", "file_path", F.lit(rounds + 1).alias("part")))


def tree(files: DataFrame, depth: int = 5, most: int = 20) -> DataFrame:
    """(project_id, tree): the folders and files of a project, indented, down to a depth; the first `most` files of each folder, and
    how many more there are."""
    path = F.split("file_path", "/")
    n = F.size(path)
    own = files.select("project_id", F.array_join(F.slice(path, F.lit(1), n - 1), "/").alias("dir"), F.element_at(path, -1).alias("name"), (n - 1).alias("depth")).where(F.col("depth") <= depth)
    w = Window.partitionBy("project_id", "dir").orderBy("name")
    counted = own.groupBy(F.col("project_id").alias("p"), F.col("dir").alias("d")).agg(F.count("*").alias("n"))
    shown = own.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).join(counted, (F.col("project_id") == F.col("p")) & (F.col("dir") == F.col("d")))
    # a file sorts behind its folder and before the folders in it; a folder's line sorts first
    indent = lambda n: F.repeat(F.lit("  "), n)
    line = F.struct(F.col("dir").alias("a"), F.lit(1).alias("kind"), F.col("k").alias("k"), F.concat(indent(F.col("depth")), "name").alias("text"))
    more = shown.where((F.col("k") == most) & (F.col("n") > most)).select("project_id", F.struct(F.col("dir").alias("a"), F.lit(2).alias("kind"), F.col("k").alias("k"), F.concat(indent(F.col("depth")), (F.col("n") - most).cast("string"), F.lit(" more files")).alias("text")).alias("line"))
    folders = directories(files).where(F.col("depth") <= depth).select("project_id", "dir", "depth").distinct()
    heads = folders.select("project_id", F.struct(F.col("dir").alias("a"), F.lit(0).alias("kind"), F.lit(0).alias("k"), F.concat(indent(F.col("depth") - 1), F.element_at(F.split("dir", "/"), -1), F.lit("/")).alias("text")).alias("line"))
    every = shown.select("project_id", line.alias("line")).unionByName(more).unionByName(heads)
    return every.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["text"]), "\n").alias("tree"))

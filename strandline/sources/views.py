"""Views of the review library's tables over the data folder, and the same views as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIRS = ("src/Services", "src/Controllers", "lib/data", "tests/unit", "node_modules/x", "docs", "app/models", "bin/Debug")
EXTS = (".cs", ".py", ".ts", ".java", ".md", ".json", ".png", ".lock")
AGENTS = ("Structure", "CodeQuality", "Security", "ArchitectureAdvisor")
SEVERITIES = ("Info", "Low", "Medium", "High", "Critical")
CATEGORIES = ("Performance", "Security", "Architecture", "CodeQuality", "Structure", "Complexity", "Maintainability", "BestPractice", "Other")
MODELS = ("gpt-4o", "gpt-4o-mini", "gpt-4", "text-embedding-3-small")


def _pick(values: tuple[str, ...], index: str) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast({index} as int) + 1)"


def _duck(values: tuple[str, ...], index: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[cast({index} as int) + 1]"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: How a table is read: as it is, or as a stream of its files.
Reader = Callable[[SparkSession, str, str], DataFrame]


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"concat({_pick(DIRS, '(doc_id div 8) % 8')}, '/f', doc_id, {_pick(EXTS, 'doc_id % 8')})"
    return _read(spark, sf_dir, "documents").selectExpr("doc_id", "source as project_id", f"{path} as file_path", f"{_pick(EXTS, 'doc_id % 8')} as ext", "text as content", "cast(octet_length(text) as bigint) as size_bytes", "cast(length(text) as bigint) as n_chars")


#: Lines of code that the rules know; {n} is the number of the file, ~ a line feed.
CODE = (
    'var sql = "SELECT * FROM t WHERE id=" + id{n};', "password = 'hunter{n}'", "var h = md5.Create(); // SHA1, sha1", "var r = new Random();", 'var p = Path.Combine(root, Request.Query["p"]);',
    'Process.Start("sh -c " + cmd);', "el.innerHTML = value{n}; document.write(x);", "var f = new BinaryFormatter();", "console.log(value); debugger;", "requests.get(u, Verify=False)", "[AllowAnonymous]",
    '"apikey": "k-{n}",', '"apikey": "${KEY}",', 'secret: "YOUR_SECRET"', 'connectionString = "Server=db;Password=p{n};"', "// todo: tidy up {n}", "try { Go(); } catch (Exception e)~{ }", "int[] a = { 22, 33, 44, 55, 66, 77, 1{n} };",
    "using System.Text{n};~namespace App.Part{n};", "public class C{n}~{~    public int Size(int a)~    {~        if (a > 20 && a < 90) { return 21; }~        return a;~    }~    private static async Task<int> Load(string s) { return 3; }~}",
    "/* a block~   comment */~int x{n} = 1;", "import os~from pkg{n}.sub import name", "def work{n}(a):~    for i in a:~        yield i~~class K{n}:~    pass", "import React from 'react';~import { x } from \"./local{n}\";",
    "export function run{n}(a) {~  if (a) { return [a]; }~}~class G{n} {}", "Authorization: Bearer abc.def-{n}", "use key_abcdefghijklmnopqrstuv{n}",
)
CODE_EXTS = (".cs", ".py", ".ts", ".js", ".java", ".json", ".yml", ".config")
#: Files with names of their own, by the rest of the number.
NAMED = ("package.json", ".gitignore", "keys/server.pem", ".env", "appsettings.Prod.json", "requirements.txt", "src/App/App.csproj", "Dockerfile", ".github/workflows/ci.yml", "README.md", "src/Domain/a.cs", "src/Application/b.cs", "src/Infrastructure/c.cs", "web/store-front/x.tsx", "a/b/c/d/e/f/g/h/deep.cs")
_CODE_PICK = "(doc_id * 5 + 7 * {k} + {div}) % " + str(len(CODE))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files whose first lines are code; a few have names that the rules look for."""
    lines, names = F.array(*map(F.lit, CODE)), F.array(*map(F.lit, NAMED))
    pick = lambda k: F.element_at(lines, F.expr(_CODE_PICK.format(k=k, div="doc_id div 9")).cast("int") + 1)
    code = F.replace(F.replace(F.concat_ws("\n", *map(pick, range(5))), F.lit("{n}"), F.col("doc_id").cast("string")), F.lit("~"), F.lit("\n"))
    plain = F.expr(f"concat({_pick(DIRS, '(doc_id div 8) % 8')}, '/f', doc_id, {_pick(CODE_EXTS, 'doc_id % 8')})")
    named = F.element_at(names, (F.col("doc_id") % 61).cast("int") + 1)
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("project_id"), F.when(F.col("doc_id") % 61 < len(NAMED), named).otherwise(plain).alias("file_path"), F.concat_ws("\n", code, "text").alias("content"))
    return docs.select("doc_id", "project_id", "file_path", F.lower(F.regexp_extract("file_path", r"(\.[^./\\]*)$", 1)).alias("ext"), "content", F.octet_length("content").cast("bigint").alias("size_bytes"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as project_id", "concat('order-', o_orderkey) as name", "case o_orderstatus when 'F' then 5 when 'O' then 2 else 4 end as status",
        "cast(o_orderdate as timestamp) as created_at", "o_custkey as api_key_id", "case when o_orderstatus = 'F' then cast(o_orderkey % 101 as int) end as health_score",
    )


def findings(spark: SparkSession, sf_dir: str, read: Reader = _read) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id as ordinal", "cast(ts as timestamp) as ts", "concat('src', user_id % 20) as project_id", f"{_pick(AGENTS, 'event_id % 4')} as agent", f"{_pick(SEVERITIES, 'cast(floor(value) as bigint) % 5')} as severity",
        f"{_pick(CATEGORIES, 'event_id % 9')} as category", "case when event_id % 7 <> 0 then concat('src/f', event_id % 50, '.cs') end as file_path", "case when event_id % 3 = 0 then concat('Sym', event_id % 11) end as symbol",
        "((event_id * 37) % 101) / 100.0D as confidence", "case when event_id % 97 = 0 then '' else concat(event_type, ' at ', coalesce(props, '')) end as description",
        "case when event_id % 5 = 0 then '' else concat('value ', cast(floor(value) as bigint)) end as explanation", "cast(event_id % 400 as int) as line_start", "cast(event_id % 400 + event_id % 6 as int) as line_end", "case when event_id % 4 = 0 then concat('fix ', event_id % 6) end as suggestion",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").selectExpr("cast(vec_id as string) as chunk_id", "concat('p', label) as project_id", "concat('f', vec_id % 50) as file_path", "embedding", "cast(50 + vec_id % 700 as int) as token_count", "vec_id")


def job_events(spark: SparkSession, sf_dir: str, read: Reader = _read) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id as project_id", "case event_type when 'signup' then 'started' when 'purchase' then 'completed' when 'error' then 'failed' when 'view' then 'progress' else 'heartbeat' end as kind", "value")


def token_events(spark: SparkSession, sf_dir: str, read: Reader = _read) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("event_id", "cast(ts as timestamp) as ts", "concat('org', user_id % 10) as org_id", f"{_pick(MODELS, 'event_id % 4')} as model", "cast(floor(value * 100) as bigint) as tokens")


def api_log(spark: SparkSession, sf_dir: str, read: Reader = _read) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id as client_id", "case when event_type = 'error' then 500 else 200 end as status", "value as duration_ms")


def _quoted(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _code_sql() -> str:
    picks = " || chr(10) || ".join(f"({_quoted(CODE)})[cast({_CODE_PICK.format(k=k, div='doc_id // 9')} as int) + 1]" for k in range(5))
    path = f"case when doc_id % 61 < {len(NAMED)} then ({_quoted(NAMED)})[cast(doc_id % 61 as int) + 1] else {_duck(DIRS, '(doc_id // 8) % 8')} || '/f' || doc_id || {_duck(CODE_EXTS, 'doc_id % 8')} end"
    rows = f"select doc_id, source as project_id, {path} as file_path, replace(replace({picks}, '{{n}}', doc_id::varchar), '~', chr(10)) || coalesce(chr(10) || text, '') as content from documents"
    return f"select doc_id, project_id, file_path, lower(regexp_extract(file_path, '(\\.[^./\\\\]*)$', 1)) as ext, content, cast(strlen(content) as bigint) as size_bytes from ({rows})"


#: The views in SQL, by name.
SQL = {
    "code_files": _code_sql(),
    "source_files": f"select doc_id, source as project_id, {_duck(DIRS, '(doc_id // 8) % 8')} || '/f' || doc_id || {_duck(EXTS, 'doc_id % 8')} as file_path, {_duck(EXTS, 'doc_id % 8')} as ext, text as content, cast(strlen(text) as bigint) as size_bytes, cast(length(text) as bigint) as n_chars from documents",
    "projects": "select o_orderkey as project_id, 'order-' || o_orderkey as name, case o_orderstatus when 'F' then 5 when 'O' then 2 else 4 end as status, cast(o_orderdate as timestamp) as created_at, o_custkey as api_key_id, case when o_orderstatus = 'F' then cast(o_orderkey % 101 as int) end as health_score from orders",
    "findings": f"select event_id as ordinal, ts, 'src' || (user_id % 20) as project_id, {_duck(AGENTS, 'event_id % 4')} as agent, {_duck(SEVERITIES, 'cast(floor(value) as bigint) % 5')} as severity, {_duck(CATEGORIES, 'event_id % 9')} as category, case when event_id % 7 <> 0 then 'src/f' || (event_id % 50) || '.cs' end as file_path, case when event_id % 3 = 0 then 'Sym' || (event_id % 11) end as symbol, ((event_id * 37) % 101) / 100.0::double as confidence, case when event_id % 97 = 0 then '' else event_type || ' at ' || coalesce(props, '') end as description, case when event_id % 5 = 0 then '' else 'value ' || cast(floor(value) as bigint) end as explanation, cast(event_id % 400 as int) as line_start, cast(event_id % 400 + event_id % 6 as int) as line_end, case when event_id % 4 = 0 then 'fix ' || (event_id % 6) end as suggestion from events",
    "vectors": "select cast(vec_id as varchar) as chunk_id, 'p' || label as project_id, 'f' || (vec_id % 50) as file_path, embedding, cast(50 + vec_id % 700 as int) as token_count, vec_id from embeddings",
    "job_events": "select event_id, ts, user_id as project_id, case event_type when 'signup' then 'started' when 'purchase' then 'completed' when 'error' then 'failed' when 'view' then 'progress' else 'heartbeat' end as kind, value from events",
    "token_events": f"select event_id, ts, 'org' || (user_id % 10) as org_id, {_duck(MODELS, 'event_id % 4')} as model, cast(floor(value * 100) as bigint) as tokens from events",
    "api_log": "select event_id, ts, user_id as client_id, case when event_type = 'error' then 500 else 200 end as status, value as duration_ms from events",
}


def with_views(body: str, *names: str) -> str:
    """body with the named views in front, as one statement; body may begin with more common table expressions."""
    if not names:
        return body
    views = ", ".join(f"{n} as ({SQL[n]})" for n in names)
    if body.lower().startswith("with recursive "):
        return f"with recursive {views}, {body[15:]}"
    return f"with {views}, {body[5:]}" if body.lower().startswith("with ") else f"with {views} {body}"

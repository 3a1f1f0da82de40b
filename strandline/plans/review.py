"""Queries over source files with code in them: rules, metrics, profiles and the review."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import rules as R
from strandline.operators import files as ops
from strandline.operators import intake, redaction, review, scans
from strandline.plans.registry import query
from strandline.sources import tables, views

#: The tables' files are small, so the registered queries look at smaller sizes than the defaults.
COMPLEXITY, LOC, METHODS = (3, 5), (30, 60), 1


def _files(spark, sf_dir):
    return views.code_files(spark, sf_dir)


def q(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def _strings(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


_TRIM = "trim({}, chr(32) || chr(9) || chr(13))"
_EXCLUDED = f"len(list_intersect(string_split(file_path, '/')[:-2], [{', '.join(map(q, R.EXCLUDED_DIRS))}])) > 0"
_NAME = "regexp_extract(file_path, '([^/\\\\]*)$', 1)"
_BREAKS = "(len({x}) - len(replace({x}, chr(10), '')))"
_COMPLEXITY = " + ".join(["1", *(f"(length(content) - length(replace(content, {q(k)}, ''))) // {len(k)}" for k in R.DECISION_POINTS)])
_POINTS = "(case when complexity > 30 then 3 when complexity > 20 then 2 when complexity > 10 then 1 else 0 end + case when loc > 1000 then 3 when loc > 500 then 2 when loc > 250 then 1 else 0 end + case when methods > 30 then 2 when methods > 20 then 1 else 0 end)"
_RISK = f"case when {_POINTS} >= 7 then 'Critical' when {_POINTS} >= 5 then 'High' when {_POINTS} >= 3 then 'Medium' else 'Low' end"
_NONE = "null::varchar"
#: Letters beyond ASCII are letters to a word boundary, other than to DuckDB's.
_ASCII = "regexp_replace(text, '[^\\x00-\\x7F\\P{L}]', 'x', 'g')"


def _count(pattern: str) -> str:
    return f"case when ext = '.cs' then len(regexp_extract_all(content, {q(pattern)})) else 0 end::bigint"


def _found(rule: str, text: str, severity: str | None = None, file_path: str = _NONE) -> str:
    """The columns of a finding of a rule; {} in the text is filled in SQL."""
    agent, usual, category, _, advice = review.TEXTS[rule]
    return f"project_id, {q(agent)} as agent, {q(rule)} as rule, {severity or q(usual)} as severity, {q(category)} as category, {file_path} as file_path, null::int as line, {q(rule)} as description, {text} as explanation, {q(advice)} as suggestion"


def _text(rule: str, *values: str) -> str:
    parts = review.TEXTS[rule][3].split("{}")
    return " || ".join(x for part, value in zip(parts, [*values, None], strict=True) for x in (q(part), value) if x)


def _any(column: str, *words: str) -> str:
    return f"regexp_matches({column}, {q('|'.join(words))})"


#: Common table expressions, by name; each may use those before it.
CTES = {
    "cl": "select doc_id, project_id, file_path, ext, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1)::int as line from code_files",
    "ce": f"select doc_id, line, {_TRIM.format('text')} as t, case when ends_with({_TRIM.format('text')}, '*/') then 0 when starts_with({_TRIM.format('text')}, '/*') then 1 end as ev from cl where ext = '.cs'",
    "co": "select doc_id, t, coalesce(last_value(ev ignore nulls) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0) as open from ce",
    "cn": "select doc_id, count(*) filter (where open = 0 and not starts_with(t, '/*') and t <> '' and not starts_with(t, '//')) as n from co group by 1",
    "m": f"select f.doc_id, project_id, file_path, ext, len(string_split(content, chr(10)))::bigint as total_lines, case when ext = '.cs' then n else len(list_filter(string_split(content, chr(10)), lambda x: {_TRIM.format('x')} <> '')) end::bigint as loc, {_count(R.TYPES)} as types, {_count(R.METHODS)} as methods, {_count(R.NAMESPACES)} as namespaces, case when ext = '.cs' then {_COMPLEXITY} else 0 end::bigint as complexity from code_files f left join cn on cn.doc_id = f.doc_id",
    "scan": " union all ".join(
        f"select doc_id, project_id, file_path, line, {q(name)} as rule, {q(severity)} as severity, {q(text)} as description, {q(R.ADVICE.get(name, R.NO_ADVICE))} as suggestion, {_TRIM.format('text')} as code, unnest(regexp_extract_all({_ASCII if '\\b' in pattern else 'text'}, {q('(?i)' + pattern)})) as match from cl where not regexp_matches(lower(file_path), 'test|example|sample')"
        for name, pattern, text, severity in R.SECURITY_RULES
    ),
    "secret_rows": " union all ".join(f"select doc_id, project_id, file_path, line, {q(name)} as rule, unnest(regexp_extract_all(text, {q('(?i)' + pattern)})) as match from cl where ext in {_strings(R.CONFIG_EXTENSIONS)} and not ({_EXCLUDED})" for name, pattern in R.CONFIG_RULES),
    "secrets": f"select * from (select *, row_number() over (partition by project_id order by file_path, doc_id, line, rule, match) as place from secret_rows where not ({' or '.join(f'contains(match, {q(x)})' for x in R.PLACEHOLDERS)})) where place <= 20",
    "catches": f"select doc_id, project_id, file_path, (1 + list_sum(list_transform(list_slice(p, 1, k), lambda x: {_BREAKS.format(x='x')})) + coalesce(list_sum(list_transform(list_slice(c, 1, k - 1), lambda x: {_BREAKS.format(x='x')})), 0))::int as line from (select *, unnest(range(1, len(c) + 1)) as k from (select doc_id, project_id, file_path, string_split_regex(content, {q(R.EMPTY_CATCH)}) as p, regexp_extract_all(content, {q(R.EMPTY_CATCH)}) as c from code_files))",
    "debt_rows": f"select doc_id, project_id, file_path, line, 'debt marker' as kind, 'Info' as severity, 'Found TODO/FIXME comment: ' || {_TRIM.format('text')} as description, null as suggestion from cl where regexp_matches(text, {q('(?i)' + R.DEBT_MARKER)}) union all select doc_id, project_id, file_path, line, 'empty catch', 'High', 'Empty catch blocks silently swallow exceptions, hiding potential bugs.', 'Log the exception or handle it appropriately. If intentionally ignored, add a comment explaining why.' from catches union all select doc_id, project_id, file_path, 0, 'magic numbers', 'Low', 'Found ' || n || ' potential magic numbers. These make code harder to understand and maintain.', 'Extract magic numbers into named constants with descriptive names.' from (select *, len(regexp_extract_all(content, {q(R.MAGIC_NUMBER)})) as n from code_files) where n > 5",
    "debt": "select * from (select *, row_number() over (partition by project_id order by file_path, doc_id, line, kind) as place from debt_rows) where place <= 50",
    "ignore": "select project_id, arg_min(content, doc_id) as ignored from code_files where file_path = '.gitignore' group by 1",
    "sensitive": f"select s.doc_id, s.project_id, s.file_path, s.pattern, s.text || ' found: ' || s.file_path as description, coalesce(contains(ignored, {_NAME}) or contains(ignored, s.file_path), false) as gitignored, case when gitignored then 'Info' else s.severity end as severity from ("
    + " union all ".join(f"select doc_id, project_id, file_path, {q(name)} as pattern, {q(text)} as text, {q(severity)} as severity from code_files where regexp_matches({_NAME}, {q(f'^(?:{name})$')}) and not ({_EXCLUDED})" for name, text, severity in R.SENSITIVE_FILES)
    + ") s left join ignore i on i.project_id = s.project_id",
    "manifests": " union all ".join(f"select distinct project_id, {q(text)} as notice from code_files where regexp_matches(file_path, {q(f'^(?:{name})$')})" for name, text in R.MANIFESTS),
    "cd": f"select project_id, dir, max(depth)::int as depth, count(*) filter (where own) as files, string_split(dir, '/')[-1] as name from (select project_id, array_to_string(list_slice(p, 1, k), '/') as dir, k as depth, len(p) - 1 = k as own from (select project_id, string_split(file_path, '/') as p, unnest(range(1, len(string_split(file_path, '/')))) as k from code_files where not ({_EXCLUDED}))) group by 1, 2",
    "names": "select project_id, count(*) filter (where regexp_matches(name, '^\\p{Lu}[\\p{L}\\p{N}]*$')) as pascal, count(*) filter (where regexp_matches(name, '^[\\p{Ll}\\p{Nd}-]*-[\\p{Ll}\\p{Nd}-]*$')) as kebab, count(*) filter (where regexp_matches(name, '^[\\p{Ll}\\p{Nd}_]*_[\\p{Ll}\\p{Nd}_]*$')) as snake, count(*) as dirs from cd group by 1",
    "pf": f"select project_id, bool_or(file_path in {_strings(review.DOCKER)}) as has_docker, bool_or(file_path in {_strings(review.CI_FILES)} or starts_with(file_path, '.github/workflows/') or starts_with(file_path, '.azure-pipelines/')) as has_ci, list_filter([case when bool_or(ends_with(file_path, '.csproj')) then '.NET' end, {', '.join(f"case when bool_or(ends_with(file_path, '.csproj') and contains(content, {q(w)})) then {q(v)} end" for w, v in review.DOTNET.items())}, case when bool_or(file_path = 'package.json') then 'Node.js' end, {', '.join(f"case when bool_or(file_path = 'package.json' and contains(content, {q(w)})) then {q(v)} end" for w, v in review.NODE.items())}, case when bool_or(file_path in ('requirements.txt', 'pyproject.toml')) then 'Python' end], lambda x: x is not null) as frameworks from code_files group by 1",
    "pd": f"select project_id, count(*) as dirs, bool_or({_any('lower(dir)', 'test', 'spec')}) as has_tests, list_filter([case when bool_or({_any('lower(dir)', 'domain')}) and bool_or({_any('lower(dir)', 'application')}) and bool_or({_any('lower(dir)', 'infrastructure')}) then 'Clean Architecture' end, case when bool_or({_any('lower(dir)', 'controller', 'view', 'model')}) then 'MVC' end, case when bool_or({_any('lower(dir)', 'services', 'microservice')}) then 'Service-Oriented' end], lambda x: x is not null) as patterns, bool_or(starts_with(lower(dir), 'src')) and bool_or(starts_with(lower(dir), 'lib')) as src_and_lib, count(*) filter (where depth = 1 and not starts_with(dir, '.') and lower(dir) not in ('bin', 'obj', 'packages')) as roots, bool_or(ends_with(lower(dir), 'domain')) and bool_or(ends_with(lower(dir), 'infrastructure')) as layers, bool_or({_any('lower(dir)', 'controller')}) as controllers, bool_or({_any('lower(dir)', 'store', 'redux', 'state')}) as state from cd group by 1",
    "pt": f"select project_id, sum(n)::bigint as files, sum(case when ext in ('.tsx', '.jsx') then n else 0 end)::bigint as components, list_slice(list(ext || ':' || n order by n desc, ext desc), 1, 5) as top_types from (select project_id, ext, count(*) as n from code_files where ext <> '' and not ({_EXCLUDED}) group by 1, 2) group by 1",
    "prof": "select pf.project_id, has_docker, has_ci, coalesce(has_tests, false) as has_tests, frameworks, coalesce(patterns, []) as patterns, coalesce(dirs, 0) as dirs, coalesce(files, 0) as files, coalesce(components, 0) as components, coalesce(roots, 0) as roots, coalesce(src_and_lib, false) as src_and_lib, coalesce(layers, false) as layers, coalesce(controllers, false) as controllers, coalesce(state, false) as state, top_types from pf left join pd on pd.project_id = pf.project_id left join pt on pt.project_id = pf.project_id",
    "arch": " union all ".join(
        f"select {_found(rule, _text(rule, *values))} from prof where {condition}"
        for rule, condition, *values in (
            ("Dependency Organization Review Needed", "not src_and_lib and dirs > 20"), ("Multiple Projects Detected", "list_contains(frameworks, '.NET') and roots > 5", "roots"), ("Clean Architecture Detected", "list_contains(patterns, 'Clean Architecture') and layers"),
            ("Missing Containerization", "files > 200 and not has_docker"), ("Missing CI/CD Pipeline", "not has_ci"), ("Missing Test Project", "not has_tests"), ("Consider API Organization", "list_contains(frameworks, 'ASP.NET Core') and not controllers"),
            ("Consider State Management", "(list_contains(frameworks, 'React') or list_contains(frameworks, 'Vue')) and not state and components > 20"),
        )
    ),
    "struct": f"select {_found('Inconsistent Directory Naming', _text('Inconsistent Directory Naming', 'pascal', 'kebab'))} from names where pascal > 0 and kebab > 0 union all select {_found('Large Directory', _text('Large Directory', 'files'), file_path='dir')} from cd where files > 50 union all select {_found('Excessive Folder Nesting', _text('Excessive Folder Nesting', 'depth'), file_path='dir')} from (select project_id, max(depth) as depth, arg_min(dir, (-depth, dir)) as dir from cd group by 1) where depth > 7 union all select {_found('Missing Test Directory', _text('Missing Test Directory'))} from (select project_id, bool_or(regexp_matches(lower(file_path), '^[^/]*test[^/]*/') and not ({_EXCLUDED})) as t from code_files group by 1) where not t",
    "over": f"select {_found('High Cyclomatic Complexity', _text('High Cyclomatic Complexity', "(complexity || '.0')"), f"case when complexity > {COMPLEXITY[1]} then 'High' else 'Medium' end", 'file_path')} from m where complexity > {COMPLEXITY[0]} and not ({_EXCLUDED})"
    f" union all select {_found('Long File', _text('Long File', 'loc'), f"case when loc > {LOC[1]} then 'Medium' else 'Low' end", 'file_path')} from m where loc > {LOC[0]} and not ({_EXCLUDED})"
    f" union all select {_found('Too Many Methods', _text('Too Many Methods', 'methods'), None, 'file_path')} from m where methods > {METHODS} and not ({_EXCLUDED})",
    "rf": "select project_id, agent, rule, severity, category, file_path, line, description, explanation, suggestion from struct union all select * from over"
    " union all select project_id, 'CodeQuality', k, severity, case when kind = 'empty catch' then 'CodeQuality' else 'Maintainability' end, file_path, line, k, description, suggestion from (select *, case kind when 'debt marker' then 'Technical Debt Marker' when 'empty catch' then 'Empty Catch Block' else 'Magic Numbers Detected' end as k from debt)"
    " union all select project_id, 'Security', 'Security Pattern Match', severity, 'Security', file_path, line, 'Security Pattern Match', description, suggestion from scan"
    " union all select project_id, 'Security', 'Sensitive File Detected', severity, 'Security', file_path, null, 'Sensitive File Detected', description, case when gitignored then 'File appears to be gitignored. Ensure it''s not committed to version control.' else 'Ensure this file is added to .gitignore and not committed to version control.' end from sensitive"
    " union all select project_id, 'Security', 'Potential Secret in Configuration', 'High', 'Security', file_path, line, 'Potential Secret in Configuration', 'Configuration file may contain hardcoded secrets.', 'Use environment variables, Azure Key Vault, or a secrets manager for sensitive values.' from secrets"
    " union all select project_id, 'Security', 'Dependency Audit Recommended', 'Info', 'Security', null, null, 'Dependency Audit Recommended', notice, null from manifests"
    " union all select * from arch",
    "ro": f"select *, 0.0::double as confidence, null::varchar as symbol, row_number() over (order by list_position([{', '.join(map(q, review.AGENTS))}], agent), rule, coalesce(file_path, ''), coalesce(line, 0), explanation, suggestion) as ordinal from rf",
    "r1": "select *, row_number() over (partition by project_id, agent, coalesce(file_path, ''), description order by ordinal) as r from ro",
    "r2": "select *, row_number() over (partition by project_id, agent order by ordinal) as place from r1 where r = 1",
    "s": "select * from r2 where place <= 50 and not (file_path is null and (coalesce(trim(explanation), '') = '' or confidence < 0.3)) and trim(description) <> ''",
}


def sql(body: str, *last: str) -> str:
    """body with the expressions that it names, and those that they use, in front."""
    wanted, todo = set(), list(last)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += [n for n in CTES if n != name and re.search(rf"\b(?:from|join) {n}\b", CTES[name])]
    return "with " + ", ".join(f"{n} as ({text})" for n, text in CTES.items() if n in wanted) + " " + body


@query("j6_scan_rules", sql("select doc_id, file_path, line, rule, severity, description, suggestion, case when length(code) > 200 then left(code, 200) || '...' else code end as snippet from scan", "scan"), "code_files")
def scan_rules(spark, sf_dir):
    return scans.scan(_files(spark, sf_dir)).drop("project_id")


@query("x14_config_secrets", sql("select doc_id, line, rule, place from secrets", "secrets"), "code_files")
def config_secrets(spark, sf_dir):
    return scans.config_secrets(_files(spark, sf_dir)).select("doc_id", "line", "rule", "place")


@query("x15_manifest_notices", sql("select project_id, notice from manifests", "manifests"), "code_files")
def manifest_notices(spark, sf_dir):
    return scans.manifest_notices(_files(spark, sf_dir))


@query("x16_debt_markers", sql("select doc_id, file_path, line, kind, severity, description, suggestion, place from debt", "debt"), "code_files")
def debt_markers(spark, sf_dir):
    return scans.debt_markers(_files(spark, sf_dir)).drop("project_id")


@query("f24_sensitive_files", sql("select doc_id, description, severity, gitignored, pattern from sensitive", "sensitive"), "code_files")
def sensitive_files(spark, sf_dir):
    return scans.sensitive_files(_files(spark, sf_dir)).select("doc_id", "description", "severity", "gitignored", "pattern")


@query("f21_threat_signature_scan", "select doc_id, signature from code_files, (values ('idiot'), ('555-'), ('BinaryFormatter')) t(signature) where contains(content, signature)", "code_files")
def threat_signature_scan(spark, sf_dir):
    return scans.threat_signatures(_files(spark, sf_dir), ("idiot", "555-", "BinaryFormatter"))


_WORDS = "coalesce(" + ", ".join(f"case when contains(low, {q(w)}) then {q(w)} end" for w in R.CREDENTIAL_WORDS) + ")"


@query("x17_simple_heuristics", sql(f"""select project_id, unnest(list_filter([case when not readme then 'no readme' end, case when n > 50 then 'many files' end, case when not layers and n > 10 then 'no layers' end, case when not injection then 'no injection' end], lambda x: x is not null)) as rule, null::varchar as file_path, null::int as line
from (select project_id, count(*) as n, bool_or(contains(lower(file_path), 'readme')) as readme, bool_or(contains(file_path, '/Domain/')) and bool_or(contains(file_path, '/Application/')) and bool_or(contains(file_path, '/Infrastructure/')) as layers, bool_or(contains(file_path, 'DependencyInjection') or contains(file_path, 'ServiceCollection')) as injection from code_files group by 1)
union all select project_id, 'long file', file_path, null from code_files where len(string_split(content, chr(10))) > 100
union all select project_id, 'todo', file_path, min(line) from cl where contains(lower(text), 'todo') group by project_id, doc_id, file_path
union all select project_id, 'hardcoded ' || word, file_path, line from (select *, row_number() over (partition by project_id order by file_path, doc_id, line) as p from (select *, {_WORDS} as word from (select *, lower(text) as low from cl)) where word is not null and (contains(low, '=') or contains(low, ':')) and not {_any('low', *R.NO_CREDENTIAL)}) where p <= 10""", "cl"), "code_files")
def simple_heuristics(spark, sf_dir):
    return scans.simple_heuristics(_files(spark, sf_dir))


@query("x5_code_metrics", sql("select doc_id, total_lines, loc, types, methods, namespaces, complexity from m", "m"), "code_files")
def code_metrics(spark, sf_dir):
    return ops.metrics(_files(spark, sf_dir)).drop("project_id", "file_path", "ext")


@query("w8_loc_with_block_comments", sql("select doc_id, n as loc from cn", "cn"), "code_files")
def loc_with_block_comments(spark, sf_dir):
    return _files(spark, sf_dir).where("ext = '.cs'").select("doc_id", ops.code_lines(F.col("content")).alias("loc"))


def _measured(spark, sf_dir):
    m = ops.metrics(_files(spark, sf_dir))
    return m.withColumn("risk", ops.risk_level(F.col("complexity"), F.col("loc"), F.col("methods")))


@query("x7_file_risk_level", sql(f"select doc_id, {_RISK} as risk from m", "m"), "code_files")
def file_risk_level(spark, sf_dir):
    return _measured(spark, sf_dir).select("doc_id", "risk")


@query("f17_high_priority_files", sql(f"select project_id, file_path, complexity, loc, {_RISK} as risk from m where complexity > 3 or loc > 60 or {_RISK} in ('High', 'Critical')", "m"), "code_files")
def high_priority_files(spark, sf_dir):
    return ops.high_priority(ops.metrics(_files(spark, sf_dir)), 3, 60).select("project_id", "file_path", "complexity", "loc", "risk")


_AGGREGATE = "count(*) as files, coalesce(sum(loc), 0)::bigint as loc, coalesce(sum(total_lines), 0)::bigint as total_lines, coalesce(sum(types), 0)::bigint as types, coalesce(sum(methods), 0)::bigint as methods, coalesce(round(avg(complexity), 6), 0) as avg_complexity, coalesce(max(complexity), 0) as max_complexity from m"


@query("a1_aggregate_metrics", sql(f"select project_id, {_AGGREGATE} group by 1 union all select 'no project', {_AGGREGATE} where project_id = 'none'", "m"), "code_files")
def aggregate_metrics(spark, sf_dir):
    """The sums of each project, and those of no files at all, which are zero."""
    m = ops.metrics(_files(spark, sf_dir))
    none = ops.aggregate_metrics(m.where("project_id = 'none'")).select(F.lit("no project").alias("project_id"), "*")
    return ops.aggregate_metrics(m, "project_id").unionByName(none)


@query("a14_cluster_risk", sql(f"select project_id, split_part(file_path, '/', 1) as cluster, case when bool_or({_RISK} = 'Critical') then 'Critical' when bool_or({_RISK} = 'High') or avg(complexity) > 25 then 'High' when avg(complexity) > 15 then 'Medium' else 'Low' end as risk, count(*) as files, sum(loc)::bigint as loc, round(avg(complexity), 6) as avg_complexity from m group by 1, 2", "m"), "code_files")
def cluster_risk(spark, sf_dir):
    risk = F.col("risk")
    worst = F.when(F.bool_or(risk == "Critical"), "Critical").when(F.bool_or(risk == "High") | (F.avg("complexity") > 25), "High").when(F.avg("complexity") > 15, "Medium").otherwise("Low")
    return _measured(spark, sf_dir).groupBy("project_id", F.split("file_path", "/")[0].alias("cluster")).agg(worst.alias("risk"), F.count("*").alias("files"), F.sum("loc").alias("loc"), F.round(F.avg("complexity"), 6).alias("avg_complexity"))


@query("w6_top_files_per_cluster", sql("select project_id, cluster, file_path, complexity, loc, place, greatest(n - 5, 0) as more from (select project_id, split_part(file_path, '/', 1) as cluster, file_path, complexity, loc, row_number() over (partition by project_id, split_part(file_path, '/', 1) order by complexity desc, loc desc, file_path, doc_id) as place, count(*) over (partition by project_id, split_part(file_path, '/', 1)) as n from m) where place <= 5", "m"), "code_files")
def top_files_per_cluster(spark, sf_dir):
    w = Window.partitionBy("project_id", "cluster")
    m = ops.metrics(_files(spark, sf_dir)).select("doc_id", "project_id", F.split("file_path", "/")[0].alias("cluster"), "file_path", "complexity", "loc")
    top = m.withColumn("place", F.row_number().over(w.orderBy(F.desc("complexity"), F.desc("loc"), "file_path", "doc_id"))).where("place <= 5")
    n = m.groupBy(F.col("project_id").alias("p"), F.col("cluster").alias("c")).agg(F.greatest(F.count("*") - 5, F.lit(0)).alias("more"))
    return top.join(n, (F.col("project_id") == F.col("p")) & (F.col("cluster") == F.col("c"))).drop("p", "c", "doc_id")


@query("k4_deep_dive_files", sql("select * from (select project_id, file_path, row_number() over (partition by project_id order by complexity desc, loc desc, file_path, doc_id) as place from m) where place <= 5", "m"), "code_files")
def deep_dive_files(spark, sf_dir):
    return ops.deep_dive(ops.metrics(_files(spark, sf_dir)))


@query("k4_legacy_files", sql("select * from (select project_id, file_path, row_number() over (partition by project_id order by loc desc, file_path, doc_id) as place from m) where place <= 10", "m"), "code_files")
def legacy_files(spark, sf_dir):
    return ops.deep_dive(ops.metrics(_files(spark, sf_dir)), 10, "loc")


@query("k4_security_files", "select * from (select project_id, file_path, row_number() over (partition by project_id order by file_path, doc_id) as place from code_files where regexp_matches(lower(file_path), 'auth|security|login|password|crypto|controller')) where place <= 5", "code_files")
def security_files(spark, sf_dir):
    return ops.deep_dive(_files(spark, sf_dir), 5, "path")


@query("x6_cyclomatic", f"select doc_id, ({_COMPLEXITY})::bigint as complexity from code_files", "code_files")
def cyclomatic(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", ops.cyclomatic(F.col("content")).alias("complexity"))


_IMPORTS = f"case when ext = '.cs' then list_transform(regexp_extract_all(content, '(?m)^\\s*using\\s+([^;]+);', 1), lambda x: trim(x)) when ext in ('.ts', '.tsx', '.js', '.jsx') then regexp_extract_all(content, {q(chr(40) + '?m)^import\\s+.*from\\s+[' + chr(39) + '"]([^' + chr(39) + '"]+)[' + chr(39) + '"];?')}, 1) when ext = '.py' then regexp_extract_all(content, '(?m)^(?:import|from)\\s+([^\\s]+)', 1) else [] end"
_PACKAGES = f"case when ext in ('.ts', '.tsx', '.js', '.jsx') then regexp_extract_all(content, {q('from\\s+[' + chr(39) + '"](@?[a-zA-Z0-9_\\-]+)[' + chr(39) + '"]')}, 1) when ext = '.py' then regexp_extract_all(content, '(?m)^(?:import|from)\\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1) else [] end"


@query("x8_x9_dependencies", f"select doc_id, array_to_string(list_sort(list_distinct({_IMPORTS})), ' ') as imports, array_to_string(list_sort(list_distinct({_PACKAGES})), ' ') as packages from code_files", "code_files")
def dependencies(spark, sf_dir):
    content, ext = F.col("content"), F.col("ext")
    shown = lambda c: F.array_join(F.array_sort(c), " ")
    return _files(spark, sf_dir).select("doc_id", shown(scans.dependencies(content, ext)).alias("imports"), shown(scans.external_dependencies(content, ext)).alias("packages"))


_LANGUAGE = f"case ext {' '.join(f"when '{k}' then '{v}'" for k, v in R.CHUNKER_LANGUAGES.items())} else 'text' end"


@query("x31_file_summary", sql(f"select m.doc_id, {_LANGUAGE.replace('ext', 'm.ext', 1)} as language, loc, methods, case when complexity > 0 then complexity // greatest(1, methods) else 0 end as avg_complexity, complexity as max_complexity, {_RISK} as risk, sha256(f.content) as content_hash, array_to_string(list_sort(list_distinct({_IMPORTS.replace('ext ', 'f.ext ').replace('(content', '(f.content')})), ' ') as imports from m join code_files f on f.doc_id = m.doc_id", "m"), "code_files")
def file_summary(spark, sf_dir):
    return ops.summaries(_files(spark, sf_dir), scans.dependencies(F.col("content"), F.col("ext"))).withColumn("imports", F.array_join(F.array_sort("imports"), " "))


@query("x10_redact", f"select doc_id, regexp_replace(regexp_replace(regexp_replace(content, '(?i)(key_[a-zA-Z0-9]{{4}})[a-zA-Z0-9]{{16,}}', '\\1{R.REDACTED}', 'g'), {q('(?i)' + R.BEARER)}, 'Bearer {R.REDACTED}', 'g'), {q('(?i)' + R.PAIR)}, '\\1={R.REDACTED}', 'g') as content from code_files", "code_files")
def redact(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", redaction.redact(F.col("content")).alias("content"))


@query("x11_log_preview", f"select doc_id, '[' || length(content) || ' chars, hash:' || substr(sha256(content), 1, 8) || '] ' || regexp_replace(regexp_replace(regexp_replace(left(content, 50) || case when length(content) > 50 then '...' else '' end, '(?i)(key_[a-zA-Z0-9]{{4}})[a-zA-Z0-9]{{16,}}', '\\1{R.REDACTED}', 'g'), {q('(?i)' + R.BEARER)}, 'Bearer {R.REDACTED}', 'g'), {q('(?i)' + R.PAIR)}, '\\1={R.REDACTED}', 'g') as preview from code_files", "code_files")
def log_preview(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", redaction.log_preview(F.col("content")).alias("preview"))


@query("x30_format_bytes", "select doc_id, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KB', round(n / 1024.0, 1)) when n < 1073741824 then printf('%.1f MB', round(n / 1048576.0, 1)) else printf('%.2f GB', round(n / 1073741824.0, 2)) end as shown from (select doc_id, (case doc_id % 4 when 0 then 1 when 1 then 60 when 2 then 3000 else 3000000 end) * size_bytes as n from code_files)", "code_files")
def format_bytes(spark, sf_dir):
    factor = F.expr("case doc_id % 4 when 0 then 1 when 1 then 60 when 2 then 3000 else 3000000 end")
    return _files(spark, sf_dir).select("doc_id", ops.format_bytes(factor * F.col("size_bytes")).alias("shown"))


@query("a12_cluster_by_directory", f"select project_id, cluster, count(*) as files, sum(size_bytes)::bigint as bytes, theme, case when theme <> 'Mixed' then theme else array_to_string(list_transform(list_filter(string_split_regex(cluster, '[_ -]'), lambda x: x <> ''), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), '') end as name from (select *, case {' '.join(f"when {_any('lower(cluster)', *words)} then {q(theme)}" for words, theme in R.THEMES)} else 'Mixed' end as theme from (select project_id, size_bytes, case when contains(file_path, '/') then split_part(file_path, '/', 1) else '' end as cluster from code_files)) group by project_id, cluster, theme", "code_files")
def cluster_by_directory(spark, sf_dir):
    top = F.when(F.col("file_path").contains("/"), F.split("file_path", "/")[0]).otherwise("")
    c = _files(spark, sf_dir).groupBy("project_id", top.alias("cluster")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    return c.withColumn("theme", ops.theme(F.col("cluster"))).withColumn("name", ops.cluster_name(F.col("cluster")))


@query("a26_directory_stats", sql("select project_id, dir, files, depth, files > 50 as crowded, depth = max(depth) over (partition by project_id) as deepest from cd", "cd"), "code_files")
def directory_stats(spark, sf_dir):
    d = review.directories(_files(spark, sf_dir)).drop("name")
    most = d.groupBy(F.col("project_id").alias("p")).agg(F.max("depth").alias("most"))
    return d.join(most, F.col("project_id") == F.col("p")).select("project_id", "dir", "files", "depth", (F.col("files") > 50).alias("crowded"), (F.col("depth") == F.col("most")).alias("deepest"))


@query("a27_naming_styles", sql("select *, pascal > 0 and kebab > 0 as mixed from names", "names"), "code_files")
def naming_styles(spark, sf_dir):
    return review.naming_styles(review.directories(_files(spark, sf_dir)))


@query("a28_project_profile", sql("select * replace (array_to_string(frameworks, ',') as frameworks, array_to_string(patterns, ',') as patterns, array_to_string(top_types, ',') as top_types) from prof", "prof"), "code_files")
def project_profile(spark, sf_dir):
    p = review.profile(_files(spark, sf_dir))
    return p.withColumns({c: F.array_join(c, ",") for c in ("frameworks", "patterns", "top_types")})


@query("a29_architecture_rules", sql("select project_id, rule, severity, explanation from arch", "arch"), "code_files")
def architecture_rules(spark, sf_dir):
    return review.architecture_rules(review.profile(_files(spark, sf_dir))).select("project_id", "rule", "severity", "explanation")


@query("a30_structure_rules", sql("select project_id, rule, severity, file_path, explanation from struct", "struct"), "code_files")
def structure_rules(spark, sf_dir):
    return review.structure_rules(_files(spark, sf_dir)).select("project_id", "rule", "severity", "file_path", "explanation")


@query("a31_metric_findings", sql("select project_id, rule, severity, file_path, explanation from over", "over"), "code_files")
def metric_findings(spark, sf_dir):
    m = ops.metrics(_files(spark, sf_dir).where(~ops.is_excluded(F.col("file_path"))))
    return review.metric_findings(m, COMPLEXITY, LOC, METHODS).select("project_id", "rule", "severity", "file_path", "explanation")


@query("a5_preflight_archive", "select project_id, count(*) as files, sum(size_bytes)::bigint as bytes, max(size_bytes) as largest, sum(case when ext in " + _strings(R.SOURCE_EXTENSIONS) + " then size_bytes else 0 end)::bigint as code_bytes from code_files group by 1", "code_files")
def preflight_archive(spark, sf_dir):
    rows = _files(spark, sf_dir).select(F.col("project_id"), "ext", "size_bytes")
    return intake.archive_sizes(rows, "project_id")


_QUOTAS = [("src1", True, 10.0), ("src2", False, 0.0001), *((f"src{k}", False, 10.0) for k in range(3, 20))]


@query("a5_preflight_decisions", "with q(org_id, suspended, credits) as (values " + ", ".join(f"('{o}', {str(s).lower()}, {c}::double)" for o, s, c in _QUOTAS) + "), e as (select project_id as path, project_id as org_id, ext, case when doc_id % 400 = 399 then null else size_bytes end as size_bytes from code_files), g as (select path, any_value(org_id) as org_id, bool_or(size_bytes is null) as bad, count(size_bytes) as files, sum(size_bytes)::bigint as bytes, max(size_bytes) as largest, sum(case when ext in " + _strings(R.SOURCE_EXTENSIONS) + " then size_bytes when size_bytes is not null then 0 end)::bigint as code_bytes from e group by 1), t as (select *, floor((case when code_bytes > 0 then code_bytes else coalesce(bytes, 0) end) * 0.25)::bigint as tokens from g), c as (select *, round(tokens::decimal(20,0) * 0.00003::decimal(8,5) * 1.1::decimal(3,1) + files::decimal(20,0) * 0.001::decimal(4,3), 5) as cost from t) select path, files, bytes, largest, code_bytes, tokens, cost::double as cost, case when bad then 'invalid_source' when files > 400 then 'too_many_files' when largest > 60000 then 'file_too_large' when bytes > 150000 then 'repository_too_large' when coalesce(suspended, false) then 'suspended' when coalesce(credits, 0) < cost then 'insufficient_credits' else 'accepted' end as decision from c left join q using (org_id)", "code_files")
def preflight_decisions(spark, sf_dir):
    """Archives, here projects, by their listed files: sizes, tokens, cost, and whether they are accepted. Some lists are broken."""
    size = F.when(F.col("doc_id") % 400 != 399, F.col("size_bytes"))
    entries = _files(spark, sf_dir).select(F.col("project_id").alias("path"), F.col("project_id").alias("org_id"), "ext", size.alias("size_bytes"))
    quotas = spark.createDataFrame(_QUOTAS, "org_id string, suspended boolean, credits double")
    rows = intake.preflight_archives(entries, quotas, 400, 60_000, 150_000)
    return rows.select("path", F.coalesce("files", F.lit(0).cast("long")).alias("files"), "bytes", "largest", "code_bytes", "tokens", F.col("cost").cast("double").alias("cost"), "decision")


@query("r12_review", sql("""select c.project_id, critical_count, high_count, medium_count, low_count, info_count, total, health_score, band, 'The overall code health is ' || band || ' with a score of ' || health_score || '/100. Found ' || high_count || ' high, ' || medium_count || ' medium and ' || low_count || ' low severity findings.' as summary, coalesce(advice, '') as recommendations
from (select *, case when health_score >= 90 then 'excellent' when health_score >= 75 then 'good' when health_score >= 50 then 'fair' when health_score >= 25 then 'needs improvement' else 'critical' end as band
from (select *, greatest(0, 100 - least(high_count * 10, 50) - least(medium_count * 3, 30) - least(low_count, 20))::int as health_score
from (select project_id, count(*) filter (where severity = 'Critical') as critical_count, count(*) filter (where severity = 'High') as high_count, count(*) filter (where severity = 'Medium') as medium_count, count(*) filter (where severity = 'Low') as low_count, count(*) filter (where severity = 'Info') as info_count, count(*) filter (where severity in ('High', 'Medium', 'Low')) as total
from (select project_id, case when count(*) filter (where severity = 'High') >= 2 or avg(confidence) > 0.85 or bool_or(severity = 'High') then 'High' when bool_or(severity = 'Medium') then 'Medium' else arg_min(severity, ordinal) end as severity from s group by project_id, coalesce(symbol, ''), coalesce(file_path, ''), category) group by 1))) c
left join (select project_id, string_agg(suggestion, chr(10) order by place) as advice from (select project_id, suggestion, row_number() over (partition by project_id order by o) as place from (select project_id, suggestion, min(ordinal) as o from s where trim(suggestion) <> '' group by 1, 2)) where place <= 10 group by 1) a on a.project_id = c.project_id""", "s"), "code_files")
def review_report(spark, sf_dir):
    """The review of every project from its files: rules of four agents, limits, consolidation, score and recommendations."""
    return review.review(_files(spark, sf_dir), store=tables.stored, complexity=COMPLEXITY, loc=LOC, methods=METHODS)

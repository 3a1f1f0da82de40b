"""Queries over findings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.rules import AGENT_ADVICE, ADVICE_ANY, ADVICE_NONE, SEVERITY_CODES, sql_case
from strandline.operators import findings as ops
from strandline.plans.registry import query
from strandline.sources import views
from strandline.streaming import jobs


def _found(spark, sf_dir):
    return views.findings(spark, sf_dir)


_GATE = "not (file_path is null and (trim(explanation) = '' or confidence < 0.3))"
_GROUPS = """g as (select project_id, case when count(symbol) = count(*) then max(symbol) end as symbol, case when count(file_path) = count(*) then max(file_path) end as file_path, category, case when bool_or(severity = 'High') then 'High' when bool_or(severity = 'Medium') then 'Medium' else arg_min(severity, ordinal) end as severity, max(confidence) as confidence, avg(confidence) as avg_confidence, count(*) filter (where severity = 'High') as highs, count(*) as merged, coalesce(string_agg(description, chr(10) || '---' || chr(10) order by ordinal) filter (where trim(description) <> ''), '') as description, coalesce(string_agg(explanation, chr(10) || chr(10) order by ordinal) filter (where trim(explanation) <> ''), '') as explanation, arg_min(suggestion, ordinal) filter (where trim(suggestion) <> '') as suggestion, min(ordinal) as ordinal from {source} group by project_id, coalesce(symbol, ''), coalesce(file_path, ''), category)"""
_COUNTS = "project_id, count(*) filter (where severity = 'Critical') as critical_count, count(*) filter (where severity = 'High') as high_count, count(*) filter (where severity = 'Medium') as medium_count, count(*) filter (where severity = 'Low') as low_count, count(*) filter (where severity = 'Info') as info_count, count(*) filter (where severity in ('High', 'Medium', 'Low')) as total"
_HEALTH = "greatest(0, 100 - least(high_count * 10, 50) - least(medium_count * 3, 30) - least(low_count, 20))::int"
_BAND = "case when {s} >= 90 then 'excellent' when {s} >= 75 then 'good' when {s} >= 50 then 'fair' when {s} >= 25 then 'needs improvement' else 'critical' end"


@query("f12_parse_enums", f"select ordinal, {sql_case('lower(severity)', SEVERITY_CODES, '2', False)} as severity_code, case lower(category) {' '.join(f"when '{c.lower()}' then '{c}'" for c in ops.CATEGORIES)} else 'CodeQuality' end as category, case lower(severity) {' '.join(f"when '{k}' then {v}" for k, v in SEVERITY_CODES.items())} else 0 end as agent_code from (select ordinal, case when ordinal % 7 = 0 then upper(severity) when ordinal % 11 = 0 then 'grave' else severity end as severity, case when ordinal % 5 = 0 then upper(category) when ordinal % 13 = 0 then 'none' else category end as category from findings)", "findings")
def parse_enums(spark, sf_dir):
    """Names in any case, and unknown ones: Medium and CodeQuality in a report, Info from an agent."""
    n, severity, category = F.col("ordinal"), F.col("severity"), F.col("category")
    odd = _found(spark, sf_dir).select("ordinal", F.when(n % 7 == 0, F.upper(severity)).when(n % 11 == 0, "grave").otherwise(severity).alias("severity"), F.when(n % 5 == 0, F.upper(category)).when(n % 13 == 0, "none").otherwise(category).alias("category"))
    return odd.select("ordinal", ops.severity_code(severity).alias("severity_code"), ops.category(category).alias("category"), ops.severity_code(severity, "info").alias("agent_code"))


@query("f13_parse_line_range", "select ordinal, case when line_start > 0 then line_start end as first_line, case when line_start > 0 then coalesce(line_end, line_start) end as last_line from findings", "findings")
def parse_line_range(spark, sf_dir):
    r = F.when(F.col("line_start") > 0, F.struct(F.col("line_start").alias("start"), F.coalesce("line_end", "line_start").alias("end")))
    return _found(spark, sf_dir).select("ordinal", r.alias("r")).select("ordinal", F.col("r.start").alias("first_line"), F.col("r.end").alias("last_line"))


@query("f14_evidence_gate", f"select ordinal, {_GATE} as kept from findings", "findings")
def evidence_gate(spark, sf_dir):
    found = _found(spark, sf_dir)
    return found.select("ordinal", ops.has_evidence(found).alias("kept"))


@query("f15_require_description", "select ordinal, file_path from findings where trim(description) <> ''", "findings")
def require_description(spark, sf_dir):
    return _found(spark, sf_dir).where(F.trim("description") != "").select("ordinal", "file_path")


@query("f16_guardrail_filter", "select ordinal, f.agent from findings f join (values ('Security', 0.5, ['Security', 'Architecture']), ('CodeQuality', 0.3, ['CodeQuality', 'Complexity'])) l(agent, least, allowed) on f.agent = l.agent where confidence >= least and list_contains(allowed, category)", "findings")
def guardrail_filter(spark, sf_dir):
    limits = spark.createDataFrame([("Security", 0.5, ["Security", "Architecture"]), ("CodeQuality", 0.3, ["CodeQuality", "Complexity"])], "agent string, least double, allowed array<string>")
    return _found(spark, sf_dir).join(F.broadcast(limits), "agent").where("confidence >= least and array_contains(allowed, category)").select("ordinal", "agent")


@query("a6_findings_by_category", "select project_id, category, count(*) as findings from findings group by 1, 2", "findings")
def findings_by_category(spark, sf_dir):
    return _found(spark, sf_dir).groupBy("project_id", "category").agg(F.count("*").alias("findings"))


@query("a7_severity_counts", f"select {_COUNTS} from findings group by 1", "findings")
def severity_counts(spark, sf_dir):
    return ops.counts(_found(spark, sf_dir))


@query("a8_a9_health_score", f"with c as (select file_path, category, {_COUNTS} from findings group by file_path, category, project_id), h as (select project_id, file_path, category, {_HEALTH} as health_score from c) select *, {_BAND.format(s='health_score')} as band from h", "findings")
def health_score(spark, sf_dir):
    """The score of each file of a project in each category."""
    c = ops.counts(_found(spark, sf_dir), "project_id", "file_path", "category")
    return c.select("project_id", "file_path", "category", ops.health(F.col("high_count"), F.col("medium_count"), F.col("low_count")).cast("int").alias("health_score")).withColumn("band", ops.band(F.col("health_score")))


@query("a10_consolidate_findings", f"with {_GROUPS.format(source='findings')} select project_id, symbol, file_path, category, severity, confidence, merged, description, explanation, suggestion from g", "findings")
def consolidate_findings(spark, sf_dir):
    return ops.consolidate(_found(spark, sf_dir)).select("project_id", "symbol", "file_path", "category", "severity", "confidence", "merged", "description", "explanation", "suggestion")


@query("a11_dedupe_and_merge", f"with {_GROUPS.format(source='findings')} select project_id, symbol, file_path, category, case when highs >= 2 or avg_confidence > 0.85 then 'High' else severity end as severity from g", "findings")
def dedupe_and_merge(spark, sf_dir):
    return ops.escalate(ops.merged(_found(spark, sf_dir))).select("project_id", "symbol", "file_path", "category", "severity")


_MERGED = "project_id, symbol, file_path, category, case when highs >= 2 or avg_confidence > 0.85 then 'High' else severity end as severity, confidence, description, explanation, suggestion from g where not (file_path is null and (trim(explanation) = '' or confidence < 0.3))"
_TEXTS = ("project_id", "symbol", "file_path", "category", "severity", "confidence", "description", "explanation", "suggestion")


@query("a11_merge_single_pass", f"with {_GROUPS.format(source='findings')} select {_MERGED}", "findings")
def merge_single_pass(spark, sf_dir):
    return ops.dedupe_and_merge(_found(spark, sf_dir), "single_pass").select(*_TEXTS)


@query("a11_merge_pipeline", f"with {_GROUPS.format(source='findings').replace('g as (', 'first as (', 1)}, {_GROUPS.format(source='first')} select {_MERGED}", "findings")
def merge_pipeline(spark, sf_dir):
    return ops.dedupe_and_merge(_found(spark, sf_dir)).select(*_TEXTS)


def _advice_sql() -> str:
    def number(kind, what) -> str:
        if kind == "category":
            return f"count(*) filter (where category = '{what}')"
        if kind == "word":
            return f"count(*) filter (where regexp_matches(lower(coalesce(description, '')), '{'|'.join(what)}'))"
        return {"all": "count(*)", "high": "count(*) filter (where lower(severity) in ('high', 'critical'))", "medium": "count(*) filter (where lower(severity) = 'medium')"}[kind]

    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rules = [(agent, rule) for agent, own in AGENT_ADVICE.items() for rule in (*own, *ADVICE_ANY)]
    kinds = {k: f"n{i}" for i, k in enumerate(dict.fromkeys((r[0], r[1]) for _, r in rules))}
    cases = [f"case when agent = '{agent}' and {kinds[r[0], r[1]]} > {r[2]} then replace({quoted(r[3])}, '{{n}}', {kinds[r[0], r[1]]}::varchar) end" for agent, r in rules]
    cases.append(f"case when n is null then replace({quoted(ADVICE_NONE)}, '{{agent}}', agent) end")
    numbers = ", ".join(f"{number(*k)} as {name}" for k, name in kinds.items())
    return f"with f as (select * from findings where not (agent = 'Structure' and project_id in ('src1', 'src2'))), c as (select project_id, agent, count(*) as n, {numbers} from f group by 1, 2), a as (select project_id, unnest([{', '.join(quoted(k) for k in AGENT_ADVICE)}]) as agent from (select distinct project_id from f)), t as (select project_id, agent, list_slice(list_filter([{', '.join(cases)}], lambda x: x is not null), 1, 5) as t from a left join c using (project_id, agent)) select project_id, agent, generate_subscripts(t, 1)::int as place, unnest(t) as advice from t"


@query("a32_agent_advice", _advice_sql(), "findings")
def agent_advice(spark, sf_dir):
    """Advice by agent; two projects have no findings of one agent."""
    return ops.agent_advice(_found(spark, sf_dir).where("not (agent = 'Structure' and project_id in ('src1', 'src2'))"))


@query("a32_recommendations", "with f as (select project_id, suggestion, min(ordinal) as ordinal from findings where trim(suggestion) <> '' group by 1, 2) select * from (select project_id, suggestion, row_number() over (partition by project_id order by ordinal) as place from f) where place <= 10", "findings")
def recommendations(spark, sf_dir):
    return ops.recommendations(_found(spark, sf_dir))


_REPORT = f"with s as (select * from findings where {_GATE} and trim(description) <> ''), {_GROUPS.format(source='s')}, e as (select project_id, case when highs >= 2 or avg_confidence > 0.85 then 'High' else severity end as severity from g), c as (select {_COUNTS} from e group by 1), h as (select *, {_HEALTH} as health_score from c), a as (select project_id as p, string_agg(suggestion, chr(10) order by place) as recommendations from (select project_id, suggestion, row_number() over (partition by project_id order by o) as place from (select project_id, suggestion, min(ordinal) as o from s where trim(suggestion) <> '' group by 1, 2)) where place <= 10 group by 1) select h.*, {_BAND.format(s='health_score')} as band, 'The overall code health is ' || {_BAND.format(s='health_score')} || ' with a score of ' || health_score || '/100. Found ' || high_count || ' high, ' || medium_count || ' medium and ' || low_count || ' low severity findings.' as summary, coalesce(recommendations, '') as recommendations from h left join a on a.p = h.project_id"


@query("a34_report_rollup", _REPORT, "findings")
def report_rollup(spark, sf_dir):
    return ops.report(_found(spark, sf_dir))


@query("s15_export_report_json", f"with c as (select {_COUNTS} from findings group by 1), h as (select *, {_HEALTH} as health_score from c) select h.*, n.findings, n.ordinals, n.first_text from h join (select project_id, count(*) as findings, string_agg(ordinal::varchar, ',' order by ordinal) as ordinals, arg_min(description, ordinal) as first_text from findings group by 1) n on n.project_id = h.project_id", "findings")
def export_report_json(spark, sf_dir):
    """A JSON report for each project with counts, score and all its findings, written to the shared folder and read back."""
    path = jobs.shared_path(spark, "reports")
    ops.report_json(_found(spark, sf_dir)).write.text(path)
    back = spark.read.text(path).select(F.from_json("value", ops.REPORT_JSON).alias("r"))
    ids = F.array_join(F.transform("r.findings", lambda x: x["ordinal"].cast("string")), ",")
    return back.select("r.project_id", *(f"r.{c}" for c in ("critical_count", "high_count", "medium_count", "low_count", "info_count", "total", "health_score")), F.size("r.findings").cast("bigint").alias("findings"), ids.alias("ordinals"), F.col("r.findings")[0]["description"].alias("first_text"))


@query("w1_guardrail_dedupe", "with r as (select *, row_number() over (partition by project_id, agent, coalesce(file_path, ''), coalesce(symbol, ''), description order by confidence desc, ordinal) as r from findings), t as (select *, row_number() over (partition by project_id, agent order by confidence desc, ordinal) as place from r where r = 1) select ordinal, place from t where place <= 25", "findings")
def guardrail_dedupe(spark, sf_dir):
    return ops.best_of(_found(spark, sf_dir), 25).select("ordinal", "place")


@query("w7_top_findings_per_severity", "with r as (select project_id, severity, ordinal, row_number() over (partition by project_id, severity order by ordinal) as place, count(*) over (partition by project_id, severity) as n from findings) select project_id, severity, ordinal, place, greatest(n - 20, 0) as remaining from r where place <= 20", "findings")
def top_findings_per_severity(spark, sf_dir):
    w = Window.partitionBy("project_id", "severity")
    found = _found(spark, sf_dir).select("project_id", "severity", "ordinal")
    top = found.withColumn("place", F.row_number().over(w.orderBy("ordinal"))).where("place <= 20")  # cut before the shuffle
    n = found.groupBy("project_id", "severity").agg(F.greatest(F.count("*") - 20, F.lit(0)).alias("remaining"))
    return top.join(n, ["project_id", "severity"])


@query("k2_findings_ordered", f"select project_id, ordinal, {sql_case('lower(severity)', SEVERITY_CODES, '2', False)} as code, file_path from findings", "findings")
def findings_ordered(spark, sf_dir):
    """All findings in the order of a project's list: gravest first, then by file. A range sort, so a large project is many tasks."""
    code = ops.severity_code(F.col("severity"))
    return _found(spark, sf_dir).select("project_id", "ordinal", code.alias("code"), "file_path").orderBy("project_id", F.desc("code"), F.asc_nulls_first("file_path"), "ordinal")


@query("j2_report_findings", f"with c as (select {_COUNTS} from findings group by 1) select c.project_id, c.total, f.ordinal, f.severity from c left join findings f on f.project_id = c.project_id", "findings")
def report_findings(spark, sf_dir):
    found = _found(spark, sf_dir)
    return ops.counts(found).select("project_id", "total").join(found.select("project_id", "ordinal", "severity"), "project_id", "left")


@query("j2_report_nested", f"with c as (select {_COUNTS} from findings group by 1), n as (select project_id, string_agg(severity || ':' || ordinal, ',' order by severity desc, ordinal) as nested, count(*) as n from (select *, row_number() over (partition by project_id order by ordinal) as r from findings) where r <= 100 group by 1) select c.project_id, c.total, n.n, n.nested from c left join n using (project_id)", "findings")
def report_nested(spark, sf_dir):
    """Each report with its first hundred findings as a list inside the row."""
    found = _found(spark, sf_dir)
    rows = ops.nested(ops.counts(found).select("project_id", "total"), found, 100, "severity", "ordinal")
    text = F.transform(F.array_sort("findings", lambda a, b: F.when(a["severity"] > b["severity"], -1).when(a["severity"] < b["severity"], 1).when(a["ordinal"] < b["ordinal"], -1).otherwise(1)), lambda x: F.concat(x["severity"], F.lit(":"), x["ordinal"].cast("string")))
    return rows.select("project_id", "total", F.size("findings").cast("long").alias("n"), F.array_join(text, ",").alias("nested"))


@query("j2_project_files", "select p.project_id, f.doc_id, f.file_path from (select distinct project_id from findings) p left join (select * from source_files where size_bytes < 3000) f on f.project_id = p.project_id", "findings", "source_files")
def project_files(spark, sf_dir):
    """Projects with their files, and once without where none is left."""
    files = views.source_files(spark, sf_dir).where("size_bytes < 3000").select("project_id", "doc_id", "file_path")
    return _found(spark, sf_dir).select("project_id").distinct().join(files, "project_id", "left")


@query("j8_findings_files", "select f.ordinal, d.doc_id from findings f left join (select project_id, 'src/f' || (doc_id % 50) || '.cs' as path, min(doc_id) as doc_id from source_files group by 1, 2) d on d.project_id = f.project_id and d.path = f.file_path", "findings", "source_files")
def findings_files(spark, sf_dir):
    files = views.source_files(spark, sf_dir).groupBy("project_id", F.concat(F.lit("src/f"), (F.col("doc_id") % 50).cast("string"), F.lit(".cs")).alias("file_path")).agg(F.min("doc_id").alias("doc_id"))
    return _found(spark, sf_dir).join(files, ["project_id", "file_path"], "left").select("ordinal", "doc_id")


@query("u1_merge_agent_findings", "select ordinal, agent, severity, description from findings where not (agent = 'Structure' and confidence > 0.95) union all select ordinal, agent, 'Info', 'Agent failed' from findings where agent = 'Structure' and confidence > 0.95", "findings")
def merge_agent_findings(spark, sf_dir):
    """Findings of all agents; those of a failed one are replaced by a note that it failed."""
    found = _found(spark, sf_dir)
    failed = (F.col("agent") == "Structure") & (F.col("confidence") > 0.95)
    notes = found.where(failed).select("ordinal", "agent", F.lit("Info").alias("severity"), F.lit("Agent failed").alias("description"))
    return found.where(~failed).select("ordinal", "agent", "severity", "description").unionByName(notes)


@query("r13_narrative_fallback", "with r as (select project_id, ordinal, '- [' || severity || '] ' || description as line, row_number() over (partition by project_id order by ordinal) as k from findings) select project_id, string_agg(line, chr(10) order by ordinal) as narrative from r where k <= 20 group by 1", "findings")
def narrative_fallback(spark, sf_dir):
    line = F.concat(F.lit("- ["), "severity", F.lit("] "), "description")
    r = _found(spark, sf_dir).select("project_id", "ordinal", line.alias("line"), F.row_number().over(Window.partitionBy("project_id").orderBy("ordinal")).alias("k")).where("k <= 20")
    return r.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), "\n").alias("narrative"))

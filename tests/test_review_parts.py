"""Smaller parts of the review on hand-made rows: empty tables, ties, nulls, and wrong modes."""

import datetime

import pytest
from pyspark.sql import functions as F

from strandline.functions import rules as R
from strandline.operators import files, findings, jobs, replies, retrieval, scans
from strandline.sources import views

FOUND = "project_id string, agent string, severity string, category string, file_path string, symbol string, description string, explanation string, suggestion string, confidence double, ordinal long"
T = datetime.datetime(2024, 1, 1, 12)


def found(spark, *rows):
    full = [{"project_id": "p", "agent": "Security", "severity": "Low", "category": "Other", "file_path": "a.cs", "symbol": None, "description": "d", "explanation": "e", "suggestion": None, "confidence": 0.5, "ordinal": k} | r for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in FOUND.split(", ")) for r in full], FOUND)


def test_merging_in_two_modes(spark):
    df = found(spark, {"severity": "High"}, {"severity": "High", "description": "x"}, {"file_path": None, "explanation": " ", "category": "Security"}, {"file_path": None, "confidence": 0.1, "category": "Structure"}, {"category": "Complexity", "confidence": 0.9})
    one = {r.category: r for r in findings.dedupe_and_merge(df, "single_pass").collect()}
    assert set(one) == {"Other", "Complexity"} and one["Other"].description == "d\n---\nx" and one["Complexity"].severity == "High"
    assert {r.category: r.severity for r in findings.dedupe_and_merge(df).collect()} == {"Other": "High", "Complexity": "High"}
    low = found(spark, {"severity": "Low"}, {"severity": "High", "confidence": 0.2}, {"severity": "HIGH", "confidence": 0.2})
    assert findings.dedupe_and_merge(low, "single_pass").first().severity == "High"
    assert findings.dedupe_and_merge(found(spark)).count() == 0
    with pytest.raises(ValueError, match="mode"):
        findings.dedupe_and_merge(df, "other")


def test_advice_by_agent(spark):
    rows = [{"severity": "Critical", "description": "SQL Injection of a PASSWORD"}] * 6 + [{"agent": "CodeQuality", "category": "Performance", "severity": "medium", "description": None}] * 11 + [{"agent": "Structure", "description": "Naming"}]
    got = {}
    for r in findings.agent_advice(found(spark, *rows)).orderBy("place").collect():
        got.setdefault(r.agent, []).append(r.advice)
    assert [x.split()[0] for x in got["Security"]] == ["Address", "Use", "Review", "Prioritize"] and "6 high-severity" in got["Security"][0]
    assert [x.split()[0] for x in got["CodeQuality"]] == ["Consider", "Profile", "Schedule"]
    assert got["ArchitectureAdvisor"] == ["No issues found by ArchitectureAdvisor agent. Keep up the good work!"] and len(got["Structure"]) == 2
    assert findings.agent_advice(found(spark)).count() == 0


def test_nested_reports(spark):
    df = found(spark, *[{"severity": s} for s in ("Low", "High", "Info")])
    reports = spark.createDataFrame([("p",), ("none",), (None,)], "project_id string")
    got = {r.project_id: [x.ordinal for x in r.findings] for r in findings.nested(reports, df, 2, "ordinal", "severity").collect()}
    assert got == {"p": [0, 1], "none": [], None: []}


def test_cluster_replies_name_the_cluster(spark):
    reply = '[{"severity": "high", "description": "x"}, {"severity": "low", "filePath": "a.cs"}]'
    df = spark.createDataFrame([(1, reply, "Services"), (2, reply, None)], "reply_id long, reply string, cluster string")
    assert sorted((r.reply_id, r.ordinal, r.file_path or "") for r in replies.parse_findings(df).collect()) == [(1, 0, "Services"), (1, 1, "a.cs"), (2, 0, ""), (2, 1, "a.cs")]
    assert {r.file_path for r in replies.parse_findings(df.drop("cluster")).collect()} == {None, "a.cs"}


def test_files_that_are_looked_into(spark):
    df = spark.createDataFrame([("p", f"src/f{k}.cs", k, k % 3, 10 * k) for k in range(12)] + [("p", "src/Auth/x.cs", 90, 0, 0), ("q", "LoginController.cs", 91, 1, 1)], "project_id string, file_path string, doc_id long, complexity long, loc long")
    shown = lambda *a: [(r.project_id, r.file_path) for r in files.deep_dive(df, *a).orderBy("project_id", "place").collect()]
    assert shown(2) == [("p", "src/f11.cs"), ("p", "src/f8.cs"), ("q", "LoginController.cs")]
    assert shown(2, "loc") == [("p", "src/f11.cs"), ("p", "src/f10.cs"), ("q", "LoginController.cs")]
    assert shown(5, "path") == [("p", "src/Auth/x.cs"), ("q", "LoginController.cs")]


def test_resets_clear_their_fields(spark):
    log = [(1, 1, T, "queued", None, None, None), (1, 2, T + datetime.timedelta(1), "created", None, None, "old"), (1, 3, T + datetime.timedelta(2), "analyzing", T, None, None), (1, 4, T + datetime.timedelta(3), "created", None, None, None), (2, 5, T, "failed", T, T, "x"), (2, 6, T + datetime.timedelta(1), "created", T, T, "x")]
    df = spark.createDataFrame(log, "project_id long, event_id long, ts timestamp, status string, started_at timestamp, ended_at timestamp, error string")
    assert [tuple(r) for r in jobs.reset_faults(df).collect()] == [(1, 2, "error")]


def test_telemetry_modes(spark):
    calls = [("p", "model", "gpt-4o", 1000, 0, 0, 5, False), ("p", "model", "gpt-4o-mini", 10, 0, 0, 5, False), ("p", "retrieval", None, 0, 0, 7, 30, True), ("p", "embedding", "m", 500, 0, 0, 1, False)]
    df = spark.createDataFrame(calls, "project_id string, kind string, model string, input_tokens long, output_tokens long, chunks long, ms long, summarized boolean")
    exact, reference = (jobs.retrieval_telemetry(df, mode=m).first() for m in ("exact", "reference"))
    assert exact.cost != reference.cost and exact[:9] == reference[:9] == ("p", 2, 1010, 1, 500, 1, 7, 30, 1)
    with pytest.raises(ValueError, match="mode"):
        jobs.retrieval_telemetry(df, mode="other")
    assert jobs.retrieval_telemetry(df.limit(0)).count() == 0


def test_health_of_nothing_and_of_much(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    gauges = spark.createDataFrame([(T, 1, "queue.dead_letter_length", 3.0), (T, 2, "queue.dead_letter_length", 2.0), (T + datetime.timedelta(hours=1), 3, "queue.dead_letter_length", 0.0)], "ts timestamp, number long, name string, value double")
    tables = [empty("ts timestamp, success boolean, seconds double"), empty("started_at timestamp, ended_at timestamp"), empty("ts timestamp, number long, name string, value double"), empty("ts timestamp, tokens long")]
    row = jobs.health_snapshot(*tables, F.lit(T)).first()
    assert row.healthy and row.alerts == [] and row.disk_free == 100 and row.active == row.failures == row.tokens == 0
    tables[2] = gauges
    tables[0] = spark.createDataFrame([(T, False, 1.0)] * 6, "ts timestamp, success boolean, seconds double")
    row = jobs.health_snapshot(*tables, F.lit(T)).first()
    assert row.alerts == ["Dead letter queue has 2 messages", "6 jobs failed in the last hour"] and not row.healthy


def test_retrieval_with_texts(spark):
    hits = spark.createDataFrame([(1, k, 1 - k / 10, f"c{k}", "p", f"f{k}", 100) for k in range(1, 6)] + [(2, 1, 0.1, "c1", "p", "f1", 100)], "qid long, place int, score double, chunk_id string, project_id string, file_path string, token_count int")
    texts = spark.createDataFrame([(f"c{k}", 1, 2, f"text {k}") for k in range(1, 6)], "chunk_id string, start_line int, end_line int, chunk string")
    (row,) = retrieval.retrieve(hits, texts, 250, 350, 0.6).collect()
    assert (row.qid, row.chunks, row.tokens, row.summarise, row.sources) == (1, 2, 200, True, ["p/f1", "p/f2"]) and row.context.startswith("## f1 (lines 1-2)\ntext 1")
    got = {(r.qid, r.bucket): (r.tokens, r.again) for r in retrieval.summary_documents(hits, texts, 2, 250).collect()}
    assert got == {(1, 0): (200, True), (1, 1): (200, True), (1, 2): (100, True), (2, 0): (100, False)}


def test_plan_with_risk(spark):
    plan = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c"), (None, "d")], "project_id string, file_path string")
    risks = spark.createDataFrame([("p", "c", 0.9), ("p", "b", 0.2)], "project_id string, file_path string, risk double")
    assert [(r.file_path, r.risk, r.high_risk, r.place) for r in retrieval.plan_with_risk(plan, risks).orderBy("project_id", "place").collect()] == [("d", 0.0, False, 1), ("c", 0.9, True, 1), ("a", 0.0, False, 2), ("b", 0.2, False, 3)]


def test_results_from_the_chunk_table(spark):
    seen = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "c")], "project_id string, file_path string")
    chunks = spark.createDataFrame([("p", "a", 5), ("p", "a", 6)], "project_id string, file_path string, tokens long")
    errors = spark.createDataFrame([("q", "x")], "project_id string, error string")
    assert sorted(tuple(r) for r in files.indexing_result(seen, chunks, errors).collect()) == [("p", 2, 1, 2, 11, 0), ("q", 1, 1, 0, 0, 1)]


def test_words_that_a_pattern_needs_leave_out_no_match(spark, monkeypatch):
    rules = [r[:2] for r in R.SECURITY_RULES] + [(f"config {n}", p) for n, p in R.CONFIG_RULES] + [("debt", R.DEBT_MARKER)]
    assert {p for _, p in rules} == set(R.NEEDED)
    odd = ["'Delete' + a", '"UPDATE x" + y', "API_KEY = 'a'", "Pwd:\"b\"", "token='c'", "x SHA1 y", "DES", "New  Random ( )", "path.join(request.form", "process.START (a +", "a.HTML(", "ObjectStateFormatter", "DEBUG.writeline",
           "SSL-verify = False", "checkserveridentity: Null", "[authorize ( )]", "'ConnectionString' = Password =", "APIKEY: 'd'", "Secret = 'e'", "fixme", "hackİ", "K XXX", None, ""]
    names = "doc_id long, project_id string, file_path string, ext string, content string"
    own = spark.createDataFrame([(-k, "p", "a.json", ".json", x if x is None else f"a\n{x}\r\n{x.lower()}") for k, x in enumerate(odd)], names)
    rows = views.code_files(spark, "/root/testdata/sf0.001").select("doc_id", "project_id", "file_path", "ext", "content").unionByName(own)
    found = lambda: sorted(map(tuple, scans.matches(rows, [], own=(F.lit(True), rules)).collect()))
    fast = found()
    assert {r[6] for r in fast} == {n for n, _ in rules}
    monkeypatch.setattr(scans, "NEEDED", {})
    assert found() == fast

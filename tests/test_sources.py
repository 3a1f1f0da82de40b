"""Archives, replies, intake and retrieval on small fixtures."""

import zipfile

import pytest
from pyspark.sql import functions as F

from strandline.operators import files, intake, replies, retrieval, scans
from strandline.sources import archives


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("src/a.cs", "x" * 100)
        z.writestr("src/b.png", "y")
        z.writestr("node_modules/c.js", "z")
        z.writestr("d/../e.py", "w")
    with zipfile.ZipFile(tmp_path / "bomb.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("ok.py", "print()")
        z.writestr("big.py", "0" * 1_000_000)
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    rows = archives.archive_entries(spark, str(tmp_path)).cache()
    assert rows.where("entry is null").count() == 1
    assert sorted(r["entry"] for r in archives.usable_entries(rows).collect()) == ["big.py", "d/../e.py", "ok.py", "src/a.cs"]
    stats = {r["path"].rpartition("/")[2]: r for r in archives.archive_stats(rows).collect()}
    assert stats["a.zip"]["files"] == 4 and stats["a.zip"]["climbs"] and stats["a.zip"]["largest_name"] == "src/a.cs"
    assert stats["bomb.zip"]["types"] == {".py": 2}
    verdicts = {r["path"].rpartition("/")[2]: (r["verdict"], r["entry"]) for r in archives.entry_verdicts(rows).collect()}
    assert verdicts == {"a.zip": ("traversal", "d/../e.py"), "bomb.zip": ("ratio", "big.py")}
    assert {r["ext"] for r in archives.scan_corpus(spark, str(tmp_path)).collect()} == {".zip"}


FILE = "doc_id long, project_id string, file_path string, content string, ext string"

#: A line that each security rule meets, in another case than the rule is written.
MEETS = {
    "sql_injection": 'var q = "select a" + name;', "credential": "PassWord = 'hunter2'", "weak_crypto": "h = md5(x)", "weak_random": "NEW random()", "path_traversal": "path.combine(a, request.query)",
    "command_injection": "process.start(a + b)", "xss": "el.innerhtml = x", "deserialization": "binaryformatter", "debug_code": "CONSOLE.LOG(1)", "tls_off": "Verify=False", "open_endpoint": "[allowanonymous]",
}


def test_each_security_rule_ignores_case(spark):
    rows = [(k, "p", "src/a.cs", f"int x;\n{line}", ".cs") for k, line in enumerate(MEETS.values())] + [(90, "p", "tests/a.cs", "md5", ".cs"), (91, "p", "src/b.cs", None, ".cs")]
    got = {(r["doc_id"], r["line"], r["rule"]) for r in scans.scan(spark.createDataFrame(rows, FILE)).collect()}
    assert got == {(k, 2, rule) for k, rule in enumerate(MEETS)}


def test_a_finding_for_each_match(spark):
    df = spark.createDataFrame([(1, "p", "src/a.cs", "md5 SHA1 des desk\n" + "x" * 300 + " md5", ".cs")], FILE)
    found = scans.scan(df).orderBy("line").collect()
    assert [(r["line"], r["severity"], r["suggestion"]) for r in found] == [(1, "High", "Use SHA-256 or stronger for hashing, and bcrypt/Argon2 for passwords.")] * 3 + [(2, "High", "Use SHA-256 or stronger for hashing, and bcrypt/Argon2 for passwords.")]
    assert found[3]["snippet"] == "x" * 200 + "..."


def test_config_secrets(spark):
    lines = ['"Password": "a"', "connectionString: Server=x;password = y", "ApiKey='b'", 'secret="c"', '"password": "${P}"', '"apikey": "{{key}}"', "secret: 'YOUR_SECRET'", "secret: 'REPLACE_ME'", "password: '<kept>'", "password: '***'"]
    df = spark.createDataFrame([(1, "p", "conf/a.json", "\n".join(lines), ".json"), (2, "p", "conf/a.md", lines[0], ".md"), (3, "p", "bin/a.json", lines[0], ".json"), (4, "p", "tests/a.yml", "\n".join(lines[:1] * 30), ".yml")], FILE)
    got = [(r["doc_id"], r["line"], r["rule"]) for r in scans.config_secrets(df).orderBy("place").collect()]
    assert got[:6] == [(1, 1, "password"), (1, 2, "connection"), (1, 3, "api_key"), (1, 4, "secret"), (1, 9, "password"), (1, 10, "password")] and len(got) == 20 and got[6][0] == 4


def test_debt_markers(spark):
    text = "// todo x\ntry{}\ncatch (E e)\n{ }\ncatch { }\ntry {} Catch (E e) {}\ncatch(Z z){}\n7 8 22 33 44 55 66 120 x77 8.88"
    rows = scans.debt_markers(spark.createDataFrame([(1, "p", "a.cs", text, ".cs")], FILE)).collect()
    assert sorted((r["line"], r["kind"]) for r in rows) == [(1, "debt marker"), (3, "empty catch"), (7, "empty catch")]
    six = scans.debt_markers(spark.createDataFrame([(1, "p", "a.cs", text + " 99", ".cs")], FILE)).where("kind = 'magic numbers'").first()
    assert six["description"].startswith("Found 6 potential")


def test_sensitive_files_and_manifests(spark):
    names = [".env", "a/key.pem", "id_rsa", "bin/x.pem", "appsettings.Dev.json", "package.json", "b/package.json", "x/y.csproj"]
    df = spark.createDataFrame([(k, "p", name, "", "") for k, name in enumerate(names)] + [(50, "p", ".gitignore", "node\nkey.pem\n", ""), (51, "q", "id_rsa", "", "")], FILE)
    got = sorted((r["project_id"], r["file_path"], r["severity"]) for r in scans.sensitive_files(df).collect())
    assert got == [("p", ".env", "High"), ("p", ".env", "High"), ("p", "a/key.pem", "Info"), ("p", "appsettings.Dev.json", "Info"), ("p", "id_rsa", "Critical"), ("q", "id_rsa", "Critical")]
    assert sorted(r["notice"].split()[0] for r in scans.manifest_notices(df).collect()) == [".NET", "package.json"]


def test_dependencies(spark):
    rows = [(".cs", "using A.B;\n  using C;\nusing A.B;"), (".ts", "import {x} from 'lib';\nimport y from \"./own\";"), (".py", "import os\nfrom a.b import c\n"), (".md", "import x")]
    df = spark.createDataFrame(rows, "ext string, content string")
    got = [(list(r[0]), list(r[1])) for r in df.select(scans.dependencies(F.col("content"), F.col("ext")), scans.external_dependencies(F.col("content"), F.col("ext"))).collect()]
    assert got == [(["A.B", "C"], []), (["lib", "./own"], ["lib"]), (["os", "a.b"], ["os", "a"]), ([], [])]


def test_paths(spark):
    df = spark.createDataFrame([("a/./b/../c",), ("../../x",), ("\\a\\b",), ("",)], "p string")
    assert [tuple(r) for r in df.select(scans.normalized_path(F.col("p")), scans.sanitized_path(F.col("p"))).collect()] == [("a/c", "a/b/c"), ("x", "x"), ("a/b", "a/b"), ("", "")]


def test_python_units(spark):
    df = spark.createDataFrame([(1, ".py", "import x\ndef a():\n  pass\n\nclass B:\n  def c(self): pass\n")], "doc_id long, ext string, content string")
    assert [(r["name"], r["start_line"], r["end_line"]) for r in scans.python_units(df).orderBy("start_line").collect()] == [("a", 2, 4), ("B", 5, 7)]


def test_replies(spark):
    rows = [(1, 'Sure:\n```json\n[{"Severity": "High", "category": "Security", "description": "d", "filePath": "a.cs", "confidence": "0.5"}, {"severity": 3}]\n```'), (2, 'x {"findings": [{"severity": "low", "category": "Other", "description": "e"}]} y'), (3, "no json"), (4, None), (5, "[broken")]
    found = replies.parse_findings(spark.createDataFrame(rows, "reply_id long, reply string"))
    got = [(r["reply_id"], r["ordinal"], r["severity"], r["file_path"], r["confidence"]) for r in found.orderBy("reply_id", "ordinal").collect()]
    assert got == [(1, 0, "High", "a.cs", 0.5), (1, 1, "3", None, None), (2, 0, "low", None, None)]
    assert sorted(((r["reply_id"], r["ordinal"]) for r in replies.rejected(spark.createDataFrame([*rows, (6, '[1, {"severity": "low"}]')], "reply_id long, reply string")).collect()), key=str) == [(3, None), (4, None), (5, None), (6, 0)]


def test_the_first_balanced_value(spark):
    df = spark.createDataFrame([("a {b [1] } c {d}",), ("x ] [1, {2}] y",), ("[open {",), ("",), (None,)], "r string")
    assert [r[0] for r in df.select(replies.extract_json(F.col("r"))).collect()] == ["{b [1] }", "[1, {2}]", None, None, None]


def test_validation_of_replies(spark):
    good = '{"description": "d", "severity": "high", "category": "other", "sources": [{"chunkId": "c", "filePath": "f"}]}'
    bad = '{"description": " ", "severity": "Critical", "sources": [{"chunkId": "c"}, {}]}'
    errors = lambda reply, kind: replies.validate(spark.createDataFrame([(1, reply)], "reply_id long, reply string"), kind).first()["errors"]
    assert errors(good, "finding") == [] and errors("{", "finding") == ["Invalid JSON"]
    assert errors(bad, "finding") == ["description is required and must be a non-empty string", "severity must be one of: High, Medium, Low, Info", "category is required and must be a string", "sources[0].filePath is required", "sources[1].chunkId is required", "sources[1].filePath is required"]
    assert errors('{"severity": 3, "description": "d", "category": "other", "sources": 1}', "finding") == ["severity is required and must be a string", "sources must be an array"]
    assert errors("{}", "response") == ["AgentResponse must have a 'findings' array"] and errors('{"findings": 1}', "response") == ["'findings' must be an array"]
    assert errors(f'{{"Findings": [{good}, {bad}]}}', "response")[0] == "findings[1].description is required and must be a non-empty string"
    assert errors(f'{{"projectId": "p", "Summary": "s", "findings": [{good}]}}', "report") == ["Report must have 'healthScore' field"]


def test_summary_replies(spark):
    df = spark.createDataFrame([('{"summaryText": "s", "recommendations": ["a", "b", "a"]}',), ("plain",), ("{}",)], "r string")
    got = [(r[0]["summary"], r[0]["recommendations"]) for r in df.select(replies.parse_summary(F.col("r"))).collect()]
    assert got == [("s", ["a", "b"]), ("plain", []), ("", [])]
    assert spark.createDataFrame([('x [1, 2] // c\n y',)], "r string").select(replies.clean_json(F.col("r"))).first()[0] == "[1, 2]"


def test_intake(spark):
    requests = spark.createDataFrame([(1, "a", 1000), (2, "b", 1000), (3, "c", 1 << 40), (4, "a", None), (5, "d", 1000)], "request_id long, org_id string, compressed_bytes long")
    quotas = spark.createDataFrame([("a", False, 10.0), ("b", True, 10.0), ("c", False, 10.0)], "org_id string, suspended boolean, credits double")
    got = {r["request_id"]: r["decision"] for r in intake.preflight(requests, quotas).collect()}
    assert got == {1: "accepted", 2: "suspended", 3: "repository_too_large", 4: "source_missing", 5: "insufficient_credits"}
    uploads = spark.createDataFrame([("a.zip", "application/zip", 5), ("", "x", 1), ("../a.zip", "x", 1), ("a.zip", "application/zip", 0), ("a.exe", "application/zip", 5), ("a.zip", "text/html", 5)], "file_name string, content_type string, size long")
    assert [r["error"] for r in intake.validate_uploads(uploads).collect()] == [None, "name_missing", "traversal", "empty", "extension", "content_type"]


def test_archive_preflight(spark):
    entries = spark.createDataFrame([("a", "o", ".cs", 400), ("a", "o", ".png", 1000), ("b", "o", ".md", 4000), ("c", "o", None, None), ("d", "s", ".cs", 4), ("e", "o", ".cs", 10_000), ("f", "n", ".cs", 4_000_000)], "path string, org_id string, ext string, size_bytes long")
    quotas = spark.createDataFrame([("o", False, 10.0), ("s", True, 10.0)], "org_id string, suspended boolean, credits double")
    got = {r["path"]: (r["decision"], r["files"], r["tokens"]) for r in intake.preflight_archives(entries, quotas, most_file=9000).collect()}
    assert got == {"a": ("accepted", 2, 100), "b": ("accepted", 1, 1000), "c": ("invalid_source", None, 0), "d": ("suspended", 1, 1), "e": ("file_too_large", 1, 2500), "f": ("file_too_large", 1, 1_000_000)}
    cost = intake.preflight_archives(entries.where("path = 'b'"), quotas).first()["cost"]
    assert float(cost) == pytest.approx(1000 * 0.00003 * 1.1 + 0.001)


def test_indexing_writes_verifies_and_skips(spark, tmp_path):
    text = lambda k: f"public class C{k}\n{{\n    int a = {k};\n    int bbbbbbbb = {k};\n}}\n"
    df = spark.createDataFrame([(k, f"p{k % 2}", f"src/f{k}.cs", text(k), ".cs") for k in range(6)] + [(9, "p0", "bin/x.cs", text(9), ".cs"), (10, "p1", "a.png", "x", ".png"), (11, "p2", "b.cs", " ", ".cs")], FILE)
    got = {r["project_id"]: r for r in retrieval.index_project(df, str(tmp_path / "index"), least=5).collect()}
    assert {p: (r["files"], r["skipped_files"], r["chunks"], r["embedded"], r["out_of_range"]) for p, r in got.items()} == {"p0": (3, 1, 3, 3, 0), "p1": (3, 1, 3, 3, 0), "p2": (0, 1, 0, 0, 0)}
    stored = spark.read.parquet(str(tmp_path / "index"))
    new, counts = retrieval.incremental_index(df.union(spark.createDataFrame([(20, "p0", "src/new.cs", text(20), ".cs")], FILE)), stored.withColumn("project_id", F.col("project_id").cast("string")), least=5)
    assert [r["file_path"] for r in new.collect()] == ["src/new.cs"]
    assert {r["project_id"]: (r["new"], r["skipped"]) for r in counts.collect()} == {"p0": (1, 3), "p1": (0, 3)}


def test_clusters_are_split_by_likeness(spark):
    rows = [("p", f"src/a{k}.cs", "csharp", ["src"], ["A"] if k % 2 else ["B"], 10 if k % 2 else 90) for k in range(6)] + [("p", "src/z.py", "python", ["src"], [], 0)]
    parts = {r["file_path"]: r["part"] for r in files.split_cluster(spark.createDataFrame(rows, "project_id string, file_path string, language string, dir array<string>, dependencies array<string>, complexity long")).collect()}
    assert parts == {"src/a0.cs": 1, "src/a2.cs": 1, "src/a4.cs": 1, "src/a1.cs": 2, "src/a3.cs": 2, "src/a5.cs": 2, "src/z.py": 3}


def test_keys_and_sources(spark):
    given = spark.createDataFrame([(1, "abcdefgh-one"), (2, "abcdefgh-two"), (3, "zzzzzzzz-old")], "request_id long, secret string")
    keys = spark.createDataFrame([(10, "abcdefgh", "abcdefgh-one", True), (11, "zzzzzzzz", "zzzzzzzz-old", False)], "key_id long, prefix string, s string, active boolean").selectExpr("key_id", "prefix", "sha2(s, 256) as digest", "active", "cast(null as timestamp) as expires_at")
    assert [tuple(r) for r in intake.match_keys(given, keys, "2024-01-01 00:00:00").collect()] == [(1, 10)]
    found, lost = intake.finding_sources(spark.createDataFrame([(1, ["a", "b"])], "finding_id long, sources array<string>"), spark.createDataFrame([("a", "t")], "chunk_id string, text string"))
    assert found.count() == 1 and [r["chunk_id"] for r in lost.collect()] == ["b"]


def test_hash_embedding(spark):
    df = spark.createDataFrame([("some class text",), ("some class text",), ("other",), (" ",), (None,)], "t string")
    rows = [list(r[0]) for r in df.select(retrieval.hash_embedding(F.col("t"))).collect()]
    assert rows[0] == rows[1] != rows[2] and len(rows[0]) == 64
    assert sum(x * x for x in rows[0]) == pytest.approx(1.0) and rows[3] == rows[4] == [0.0] * 64

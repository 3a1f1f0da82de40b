"""Small fixtures for operators that the driver tables rarely trigger."""

import datetime
import math

from pyspark.sql import functions as F

from strandline.operators import files, findings, review, vectors
from strandline.operators import jobs as state
from strandline.streaming import jobs


def test_route_boundaries(spark):
    df = spark.createDataFrame([(n,) for n in (0, 10239, 10240, 204800, 204801)], "size long")
    got = [r[0] for r in df.select(files.route(F.col("size"))).collect()]
    assert got == ["DirectSend", "DirectSend", "RagChunks", "RagChunks", "Skipped"]
    assert [r[0] for r in df.select(files.route(F.col("size"), allow_large=True)).collect()][-1] == "RagChunks"


def test_excluded_paths(spark):
    df = spark.createDataFrame([("bin/a.cs",), ("src/bin/a.cs",), ("src/binary/a.cs",), ("bin",), ("a\\obj\\b.cs",)], "p string")
    assert [r[0] for r in df.select(files.is_excluded(F.col("p"))).collect()] == [True, True, False, False, True]


def test_block_comments_do_not_count(spark):
    text = "/* a\n b */\nint x;\n// c\n\n/* d */\ny();\n/* open\nz"
    df = spark.createDataFrame([(1, text)], "doc_id long, content string")
    assert df.select(files.code_lines(F.col("content"))).first()[0] == 2
    both = spark.createDataFrame([(1, "p", "a.cs", ".cs", text), (2, "p", "a.py", ".py", "class A:\n\n  if x: y")], "doc_id long, project_id string, file_path string, ext string, content string")
    assert [(r["loc"], r["total_lines"], r["types"], r["complexity"]) for r in files.metrics(both).orderBy("doc_id").collect()] == [(2, 9, 0, 1), (2, 3, 0, 0)]


def test_methods_count_for_risk(spark):
    code = "namespace A.B;\npublic class C\n{\n" + "\n".join(f"    public static async Task<int> M{k}(int a) {{ return 1; }}" for k in range(25)) + "\n}"
    row = files.metrics(spark.createDataFrame([(1, "p", "a.cs", ".cs", code)], "doc_id long, project_id string, file_path string, ext string, content string")).first()
    assert (row["types"], row["methods"], row["namespaces"]) == (1, 25, 1)
    points = spark.createDataFrame([(31, 1001, 31), (21, 501, 21), (11, 251, 20), (10, 250, 20)], "c int, n int, m int")
    assert [r[0] for r in points.select(files.risk_level(F.col("c"), F.col("n"), F.col("m"))).collect()] == ["Critical", "High", "Low", "Low"]


def test_sizes_are_shown_with_decimals(spark):
    df = spark.createDataFrame([(1023,), (10240,), (1536 * 1024,), (2 << 30,)], "n long")
    assert [r[0] for r in df.select(files.format_bytes(F.col("n"))).collect()] == ["1023 B", "10.0 KB", "1.5 MB", "2.00 GB"]


def test_consolidated_texts(spark):
    rows = [(1, "p", "S", None, "C", "low", 0.2, "a", "x", " ", "A"), (2, "p", "S", "", "C", "MEDIUM", 0.9, "b", "", "fix", "A"), (3, "p", None, "f", "C", "Info", 0.1, " ", None, None, "B")]
    found = spark.createDataFrame(rows, "ordinal long, project_id string, symbol string, file_path string, category string, severity string, confidence double, description string, explanation string, suggestion string, agent string")
    got = sorted((tuple(r[c] for c in ("symbol", "file_path", "severity", "description", "explanation", "suggestion")) for r in findings.consolidate(found).collect()), key=str)
    assert got == [("S", None, "Medium", "a\n---\nb", "x", "fix"), (None, "f", "Info", "", "", None)]
    assert findings.consolidate(found.limit(0)).count() == 0


def test_review_of_a_small_project(spark):
    schema = "doc_id long, project_id string, file_path string, content string, ext string"
    rows = [(1, "p", "src/a.cs", "password = 'x1'\n// TODO", ".cs"), (2, "p", "src/k.pem", "", ".pem"), (3, "q", "tests/a.cs", "int x;", ".cs")]
    df = spark.createDataFrame(rows, schema)
    rules = {(r["project_id"], r["agent"], r["rule"]) for r in review.rule_findings(df).collect()}
    assert rules == {("p", "Security", "Security Pattern Match"), ("p", "CodeQuality", "Technical Debt Marker"), ("p", "Security", "Sensitive File Detected"), ("p", "Structure", "Missing Test Directory"), ("p", "ArchitectureAdvisor", "Missing Test Project"), ("p", "ArchitectureAdvisor", "Missing CI/CD Pipeline"), ("q", "ArchitectureAdvisor", "Missing CI/CD Pipeline")}
    got = {r["project_id"]: r for r in review.review(df, confidence=0.5).collect()}
    assert (got["p"]["critical_count"], got["p"]["high_count"], got["p"]["medium_count"], got["p"]["info_count"]) == (2, 1, 1, 1) and got["q"]["medium_count"] == 1
    assert "Add unit tests" in got["p"]["recommendations"] and got["q"]["band"] == "excellent"
    assert review.review(df).where("project_id = 'q'").count() == 0  # a finding without file and confidence does not pass the gate


def test_host_must_be_the_stated_one_or_below(spark):
    df = spark.createDataFrame([("https://github.com/a",), ("HTTPS://x.GitHub.com/a",), ("https://evilgithub.com",), ("http://github.com",), ("https://github.com.evil.org",), ("git@github.com:a",), (None,)], "u string")
    assert [r[0] for r in df.select(state.repo_url_allowed(F.col("u"))).collect()] == [True, True, False, False, False, False, False]


def test_new_chunks_are_neither_stored_nor_repeated(spark):
    batch = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "b"), ("q", "a")], "project_id string, chunk_hash string")
    stored = spark.createDataFrame([("p", "b")], "project_id string, chunk_hash string")
    assert sorted(map(tuple, files.new_chunks(batch, stored).select("project_id", "chunk_hash").collect())) == [("p", "a"), ("q", "a")]


def test_health_and_bands(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (5, 10, 20), (9, 99, 99), (2, 5, 0)], "h int, m int, l int")
    score = findings.health(F.col("h"), F.col("m"), F.col("l"))
    assert [tuple(r) for r in df.select(score, findings.band(score)).collect()] == [(100, "excellent"), (90, "excellent"), (0, "critical"), (0, "critical"), (65, "fair")]


def test_unit_vectors(spark):
    v = spark.createDataFrame([("x", [1.0, 0.0, 0.0]), ("y", [0.0, 1.0, 0.0]), ("z", [0.0, 0.0, 0.0])], "chunk_id string, embedding array<float>").selectExpr("*", "'f' as file_path", "'p' as project_id", "1 as token_count")
    q = spark.createDataFrame([(1, [0.9, 0.1, 0.0])], "qid long, q array<float>")
    rows = vectors.knn(q, v, 2).orderBy("place").collect()
    assert [r["chunk_id"] for r in rows] == ["x", "y"]
    assert [r[0] for r in v.select(vectors.cosine(F.col("embedding"), F.array(F.lit(1.0)))).collect()] == [0.0, 0.0, 0.0]


def test_silences(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, 1, "heartbeat", t), (2, 1, "progress", t + datetime.timedelta(seconds=100)), (3, 1, "heartbeat", t + datetime.timedelta(seconds=250)), (4, 1, "heartbeat", t + datetime.timedelta(seconds=300))]
    df = spark.createDataFrame(rows, "event_id long, project_id long, kind string, ts timestamp")
    assert [tuple(r) for r in jobs.silences(df, 120).select("event_id", "gap", "strikes").collect()] == [(1, 250, 2)]


def test_knn_in_blocks_with_odd_vectors(spark, monkeypatch):
    import random

    rng = random.Random(4)
    rows = [(f"c{k:03}", "f", f"p{k % 3}", k, [rng.choice([0.0, 1.0, 2.0, -1.0]) for _ in range(4)]) for k in range(120)] + [("null", "f", "p0", 1, None), ("short", "f", "p0", 1, [1.0]), ("hole", "f", "p0", 1, [1.0, None, 0.0, 0.0]), ("nan", "f", "p0", 1, [float("nan")] * 4)]
    v = spark.createDataFrame(rows, "chunk_id string, file_path string, project_id string, token_count int, embedding array<float>")
    asked = {k: [rng.uniform(-1, 1) for _ in range(4)] for k in range(9)} | {9: [1.0, 0.0]}
    q = spark.createDataFrame(list(asked.items()), "qid long, q array<double>")

    def plain(x, y):
        if y is None or len(x) != len(y) or any(c is None or c != c for c in y):
            return 0.0
        n = math.hypot(*x) * math.hypot(*y)
        return round(sum(a * b for a, b in zip(x, y, strict=True)) / n, 9) if n else 0.0

    for per, rows_of in (((), 10_000), ((), 3), (("project_id",), 10_000)):
        monkeypatch.setattr(vectors, "QUERY_ROWS", rows_of)
        got = {(r["qid"], r["project_id"] if per else "", r["place"]): (r["chunk_id"], round(r["score"], 9)) for r in vectors.knn(q, v, 7, *per).collect()}
        want = {}
        for qid, x in asked.items():
            for group in {r[2] for r in rows} if per else {""}:
                best = sorted((-plain(x, r[4]) + 0.0, r[0]) for r in rows if group in ("", r[2]))[:7]
                want |= {(qid, group, k + 1): (c, -s + 0.0) for k, (s, c) in enumerate(best)}
        assert got == want
    assert vectors.knn(q.limit(0), v, 3).count() == 0


def test_embedding_by_a_provider(spark, tmp_path):
    from strandline.operators import retrieval

    folder = str(tmp_path)

    def provider():
        import uuid

        def embed(texts):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(len(texts)))
            if any("bad" in t for t in texts):
                raise RuntimeError("refused")
            return [None if t == "none" else [1.0] if t == "short" else [float(len(t)), 1.0] for t in texts]

        return embed

    texts = [f"text {k}" for k in range(40)] + ["bad", "none", "short", " ", None, ""]
    df = spark.createDataFrame([(k, t, "mine") for k, t in enumerate(texts)], "id long, chunk string, embedding string").coalesce(1)
    got = {r.id: r for r in retrieval.embed_with(df, provider, 2, batch=16).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        good = bool(t) and t.startswith("text")
        assert got[k].embedded == good and got[k].embedding == ([float(len(t)), 1.0] if good else [0.0, 0.0])
    asked = sorted(int(x.read_text()) for x in tmp_path.iterdir())
    assert asked == sorted([16, 16, 11] + [1] * 11)  # the third batch failed and was tried text by text
    assert retrieval.embed_with(df.limit(0), provider, 2).count() == 0


def test_scores_of_many_queries_are_not_held_at_once():
    """2,000 queries of one batch of 5,000 vectors: all their scores would have 80 MB, and some copies of them."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from strandline.operators import vectors

    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(2000, 8)), rng.normal(size=(5000, 8))
    block = pa.table({"qid": pa.array(range(2000)), "q": pa.array(list(q), pa.list_(pa.float64()))})
    names = ["chunk_id", "file_path", "project_id", "token_count", "embedding"]
    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(5000))), pa.array(["f"] * 5000), pa.array(["p"] * 5000), pa.array([1] * 5000, pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=names)
    run = vectors._scorer(block, 10, [])
    tracemalloc.start()
    found = [(b.column(0).to_numpy(), b.column(1).to_pylist()) for b in run(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    asked, got = np.concatenate([a for a, _ in found]), np.array([int(v) for _, own in found for v in own])
    score = lambda k: np.round(x @ q[k] / np.linalg.norm(x, axis=1) / np.linalg.norm(q[k]), 12)
    assert len(got) == 20_000 and all(set(got[asked == k]) == set(np.argsort(-score(k))[:10]) for k in range(0, 2000, 97))


def test_a_text_is_cut_once_for_all_keywords(spark):
    """Keywords between spaces count, at the ends too, not within words or beside line feeds; no pass over the text for each."""
    from strandline.operators import retrieval

    texts = ["class a", "a  CLASS", "subclass classes", "class\nx", "a class public\tint"]
    noise = retrieval.hash_embedding(F.col("t"))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", noise.alias("e"), F.md5(F.concat(F.sha2("t", 256), F.lit(":0"))).alias("m"), F.md5(F.concat(F.sha2("t", 256), F.lit(":1"))).alias("n"))
    of = lambda m: int(m[:8], 16) % 2001 / 1000 - 1
    for row, bump in zip(df.collect(), [0.5, 0.5, 0.0, 0.0, 0.5], strict=True):
        assert abs(row.e[0] * of(row.n) - row.e[1] * (of(row.m) + bump)) < 1e-9
    assert df._jdf.queryExecution().analyzed().toString().count("lower(") <= 3

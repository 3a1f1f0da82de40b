"""The corpus pipeline: each stage on what the one before kept, against brute force."""

import glob
import os

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from strandline.llm import bpe, queries, toxicity
from strandline.llm.common import stored
from strandline.llm.oracle import ORACLE_SQL
from tests.llm.test_corpus_operators import brute_classes
from tests.llm.test_text_operators import base_spans, brute_hits


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("rank", F.lit(1)).unionByName(spark.createDataFrame([(-5, None, "en", "x", 0, 1), (-6, "", "en", "x", 0, 1)], "doc_id long, text string, lang string, source string, n_chars long, rank int"))
    kept = {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stored(stage(spark, docs, sf_dir), name)
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = kept[name]
        assert set(after) <= set(before)
        if name == "toxicity":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
            model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
            assert len(before) - len(after) < 0.3 * len(before) and isinstance(model.bias, float)
            assert all(after[i] == before[i] for i in after)
        elif name == "near_dedup":
            assert set(after) == {i for i, (_, c) in brute_classes(list(before.items()), 5).items() if i == c}
            assert all(after[i] == before[i] for i in after)
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert set(after) == set(before)
            for i, text in list(before.items())[::5]:
                assert not brute_hits(after[i], items)[1]
                if not brute_hits(text, items)[1]:
                    assert after[i] == text
        elif name == "pii":
            assert set(after) == set(before)
            for i, text in before.items():
                assert not base_spans(after[i] or "")
                if not base_spans(text or ""):
                    assert after[i] == text
        if name != "bpe":
            assert docs.columns == columns
    v = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    for r in docs.collect():
        assert r["token_ids"] == library.encode_ordinary(r["text"] or "")


def test_clashing_columns_and_odd_tables(spark, sf_dir):
    """Columns with the names that stages use come back as they were; empty tables, nulls, repeats and a long text pass."""
    names = ["toxicity", "toxic_spans", "n_words", "hit_words", "hit_items", "pii", "row", "bands", "bucket"]
    rows = [(1, "mail a@b.cd now", "x"), (1, "mail a@b.cd now", "x"), (None, None, "y"), (3, "", "z"), (4, "calm word " * 60_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.select("*", *(F.lit("mine").alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        got = out.collect()
        assert len(got) == (4 if name == "near_dedup" else 5), name
        assert all(r[n] == "mine" for r in got for n in names), name
        assert name == "bpe" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_near_dedup_decides_by_row(spark, sf_dir):
    words = lambda name, n=60: " ".join(f"{name}{k}" for k in range(n))
    rows = [(1, words("a"))] * 3 + [(None, words("b"))] * 2 + [(7, words("c")), (7, words("d")), (3, words("c") + " more"), (9, words("e")), (None, words("e")), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert left.columns == docs.columns
    expected = [(1, words("a")), (None, words("b")), (7, words("d")), (3, words("c") + " more"), (9, words("e")), (None, "")]
    assert sorted(map(tuple, left.collect()), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_queries_equal_their_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = queries.QUERIES[name](spark, sf_dir)
    result = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(columns).collect()), key=str) == sorted(result.fetchall(), key=str)


def test_entry_has_all_queries():
    names = __spark_entry__.queries()
    assert "pipeline" in names and [n for n in names if n.startswith("op")] == ["op1_bpe", "op2_pii", "op3_toxicity", "op4_decontaminate", "op5_suffix_dedup", "op6_near_dup", "op7_ann", "op8_warc", "op9_html", "op10_chat", "op11_periodic", "op12_spelling", "op13_token_files"]
    assert set(__spark_entry__.oracle_sql()) <= set(names)

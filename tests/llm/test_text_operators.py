"""Tokens, personal data, toxicity and leakage against brute force."""

import math
import random
import re
import tracemalloc
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import bpe, decontaminate, pii, queries, toxicity

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [None, "", "a", "It's 'they'll' don't  \n\n x", "é漢字🙂 ñandú", "word " * 3000, "x" * 20_000, "\t \n", "DUP", "DUP", "<|endoftext|> 12345 +-*/"]


@pytest.fixture(scope="module")
def library():
    v = bpe.vocabulary(PATH, PATTERN)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=v.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdeTHE  \n\t'érlsng09-%漢🙂.")), max_size=80))
def test_encoding_is_that_of_the_library(text):
    v = bpe.vocabulary(PATH, PATTERN)
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    ids = v.encode(text)
    assert ids == enc.encode_ordinary(text)
    assert v.decode(ids) == text.encode()


def test_prefix_table_appends_and_edits():
    v, rng = bpe.vocabulary(PATH, PATTERN), random.Random(5)
    some = lambda n: bytes(rng.choice(b"abtheingstr \xc3\xa9") for _ in range(n))
    for _ in range(100):
        table, data = bpe.PrefixTable(v, a := some(rng.randint(0, 200))), a
        table.append(b := some(rng.randint(0, 40)))
        data += b
        assert table.ids() == v.merged(data)
        start, stop = sorted((rng.randint(0, len(data)), rng.randint(0, len(data))))
        new = some(rng.randint(0, 10))
        table.edit(start, stop, new)
        data = data[:start] + new + data[stop:]
        assert table.data == data and table.ids() == v.merged(data)
        assert all(bpe.PrefixTable(v, data).last[i] == t for i, t in enumerate(table.last))
    long = bpe.PrefixTable(v, some(20_000))
    assert long.edit(100, 103, b"xy") < 2000


def test_bpe_rows(spark, library):
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(TEXTS)], "doc_id long, text string, token_ids string")
    out = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).orderBy("doc_id").collect()
    assert len(out) == len(TEXTS)
    for row, text in zip(out, TEXTS, strict=True):
        assert row["token_ids"] == library.encode_ordinary(text or "")
        assert bytes(row["decoded"]) == (text or "").encode()
    assert bpe.encode(df.limit(0), PATH, PATTERN).count() == 0


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for k, pattern, holds in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ):
        out += [(m.start(), ("email", "ip", "card", "phone").index(k), m.end(), k) for m in re.finditer(pattern, text) if holds(m[0])]
    return [(k, s, e) for s, _, e, k in sorted(out)]


PERSONAL = [
    None, "", "a@b.cd_e@f.gh a@b", "1.2.3.4.5.6.7.8 0001.2.3.256 999999999999.1.1.1", "card 4111-1111 1111 1111 then 4111111111111112", "+1 23 456 78901 é+49 (30) 1234-5678 +1 2",
    "🙂 me@x.y.z. GB82 WEST 1234 5698 7654 32, GB83 WEST 1234 5698 7654 32", "ssn 123-45-6789 or else, far away from any word that hints at what it is, 123-45-6789", "a." * 4000 + "@", "x" * 30_000 + "@y.z", "1" * 5000, "a@a.bc " * 300, "+1" + " " * 4000,
]


def test_pii_against_brute_force(spark, sf_dir):
    texts = PERSONAL + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("start", F.lit(1))
    rows = {r["doc_id"]: r["pii"] for r in pii.find(df).select("doc_id", "pii").collect()}
    for i, text in enumerate(texts):
        got = [(s["kind"], s["start"], s["end"]) for s in rows[i]]
        assert [g for g in got if g[0] in ("email", "ip", "card", "phone")] == base_spans(text or ""), i
    kinds = [s["kind"] for s in rows[6]]
    assert kinds == ["email", "iban"]
    assert [s["kind"] for s in rows[7]] == ["ssn"]
    scores = {s["start"]: s["score"] for s in rows[4]}
    assert scores[5] > pii.CONFIRMED


def test_pii_mask(spark):
    df = spark.createDataFrame([(1, "🙂 a@b.cd, 4111 1111 1111 1111!"), (2, None), (3, "")], "doc_id long, text string")
    assert [r["text"] for r in pii.mask(pii.find(df)).orderBy("doc_id").collect()] == ["🙂 <email>, <card>!", None, ""]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    recall, false = n[1, 1] / (n[1, 1] + n.get((1, 0), 0)), n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0))
    assert recall > 0.85 and false < 0.01, n


def test_toxicity_locates_sentences_and_keeps_rows(spark):
    rows = [(i, f"good words number {i}. you utter moron {i}! fine again." if i % 3 == 0 else f"good words number {i}. calm and fine.") for i in range(90)] + [(900, None), (901, ""), (902, "...")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxicity", F.lit("mine"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(0, None), (1, 0)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert len(out) == len(rows)
    for i in range(60, 90):
        assert (out[i]["toxicity"] > 0.5) == (i % 3 == 0)
        assert ["moron" in dict(rows)[i][s["start"] : s["end"]] for s in out[i]["toxic_spans"]] == [True] * (i % 3 == 0)
    assert [out[i]["toxicity"] for i in (900, 901, 902)] == [0.0] * 3
    blank = toxicity.train(docs, labels.limit(0))
    assert {r[0] for r in toxicity.score(docs, blank).select(F.round("toxicity", 6)).collect()} == {0.0}


def plain_training(rows, rounds):
    """The noisy-or model by loops over documents, sentences and words."""
    bags = [[set(re.findall(r"\w+", x)) for x in re.findall(r"[^.!?\n]+", t.lower())] for t, _ in rows]
    bags = [[b for b in bag if b] for bag in bags]
    own = [{f for b in bag for w in b for f in toxicity.features(w)} for bag in bags]
    n, base = len(rows), sum(y for _, y in rows) / len(rows)
    every = sorted({f for o in own for f in o})
    count = lambda f, only: sum(f in o for o, (_, y) in zip(own, rows, strict=True) if y or not only)
    kept = [f for f in every if count(f, True) >= toxicity.SEEN and count(f, True) > min(3 * base, (1 + base) / 2) * count(f, False)]
    w, g2, b, gb2 = dict.fromkeys(kept, 0.0), dict.fromkeys(kept, 1e-3), -4.0, 1e-3
    for _ in range(rounds):
        gw, gb = {f: -0.02 * w[f] for f in kept}, 0.0
        for d in range(n):
            hits = [[f for word in sorted(bag) for f in toxicity.features(word) if f in w] for bag in bags[d]]
            p = [1 / (1 + math.exp(-(b + sum(w[f] for f in h)))) for h in hits]
            clean = math.prod(1 - x for x in p)
            found = max(1 - clean, 1e-9)
            for x, h in zip(p, hits, strict=True):
                pull = x * (clean / found if rows[d][1] else -1.0)
                gb += pull
                for f in h:
                    gw[f] += pull
        for f in kept:
            g2[f] += gw[f] ** 2
            step = w[f] + 0.5 * gw[f] / math.sqrt(g2[f])
            w[f] = math.copysign(max(abs(step) - 0.05 / math.sqrt(g2[f]), 0.0), step)
        gb2 += gb * gb
        b += 0.5 * gb / math.sqrt(gb2)
    return {f: x for f, x in w.items() if x}, b


def test_toxicity_against_a_plain_noisy_or(spark):
    rng = random.Random(6)
    words = ["calm", "walk", "river", "stone", "light", "morning"]
    sentence = lambda bad: " ".join([rng.choice(words) for _ in range(4)] + (["wretch"] if bad else []))
    rows = []
    for i in range(60):
        bad = i % 4 == 0
        rows.append((". ".join(sentence(bad and k == 1) for k in range(4)), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(0, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, rounds=40)
    weights, bias = plain_training(rows, 40)
    assert model.weights.keys() == weights.keys() and model.weights == pytest.approx(weights, rel=1e-6) and model.bias == pytest.approx(bias, rel=1e-6)
    long = (rows[1][0] + ". ") * 20_000
    every = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(5, rows[0][0]), (5, rows[0][0]), (None, None), (8, long), (9, long + "you wretch.")], "doc_id long, text string").withColumn("toxicity", F.lit("mine"))
    scored = toxicity.score(every, model).collect()
    assert len(scored) == len(rows) + 5
    for r in scored:
        if r["text"] and len(r["text"]) < 10_000:
            sentences = [set(re.findall(r"\w+", x)) for x in re.findall(r"[^.!?\n]+", r["text"].lower())]
            most = max(1 / (1 + math.exp(-(bias + sum(weights.get(f, 0.0) for w in s for f in toxicity.features(w))))) for s in sentences if s)
            assert r["toxicity"] == pytest.approx(most, rel=1e-6)
    assert {r["doc_id"]: r["toxicity"] > 0.5 for r in scored if r["doc_id"] in (8, 9) and len(r["text"]) > 10_000} == {8: False, 9: True}
    assert len({r["toxicity"] for r in scored if r["text"] == rows[0][0]}) == 1


def test_toxicity_does_not_rise_with_length(spark):
    rows = [(i, f"good words number {i}. you utter moron {i}! fine again." if i % 3 == 0 else f"good words number {i}. calm and fine.") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trained = toxicity.train(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int"))
    for model in (trained, toxicity.Model({"moron": 9.0, "calm": 1.0}, -8.0)):  # the second has about the bias that sf0.1 gives, and a weak feature
        clean = "calm and fine. other words here. " * 10_000
        assert model.score(clean)[0] < 0.3 and not model.score(clean)[1]
        assert model.score(clean)[0] == model.score("calm and fine. other words here. ")[0]
        score, spans = model.score(clean + "you utter moron! " + clean)
        assert score > 0.5 and len(spans) == 1 and spans[0][0] == len(clean) - 1
        assert model.score(". \n! ")[0] == 0 and model.score("calm. \n. \n. " * 1000)[0] < 0.3


def brute_hits(text, items, size=10):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hit, found = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            phrase = w[k : k + size]
            for i in range(len(words) - len(phrase) + 1):
                if words[i : i + len(phrase)] == phrase:
                    hit |= set(range(i, i + len(phrase)))
                    found.add(str(item))
    return len(words), hit, sorted(found)


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(2)
    word = lambda: rng.choice(["The", "of", "Él", "x1", "and", "to", "moon", "sun"])
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 18)))) for i in range(12)] + [(20, "moon-moon"), (21, ""), (22, None), (23, "..."), (20, "moon-moon")]
    docs = []
    for i in range(40):
        body = [word() for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            body[5:5] = (items[i % 12][1]).upper().split()
        docs.append((i, ", ".join(body)))
    return docs + [(50, None), (51, ""), (52, "!!"), (53, docs[3][1]), (53, docs[3][1]), (54, (docs[0][1] + ", ") * 400)], items


def test_decontamination_against_brute_force(spark, leaks):
    docs, items = leaks
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hit_items", F.lit("mine"))
    b = spark.createDataFrame(items, "item_id long, text string")
    d = d.withColumn("row", F.lit("own"))
    for block_bytes in (1 << 20, 150):
        rows = decontaminate.find(d, b, block_bytes=block_bytes).collect()
        assert len(rows) == len(docs) and all(r["row"] == "own" for r in rows)
        for r in rows:
            n, hit, found = brute_hits(dict(docs)[r["doc_id"]], items)
            assert (r["n_words"], sum(s["end"] - s["start"] for s in r["hit_words"]), r["hit_items"]) == (n, len(hit), found)
            assert all(a["end"] < b["start"] for a, b in pairwise(r["hit_words"]))
    cleaned = decontaminate.remove(d, b, block_bytes=150)
    assert cleaned.columns == d.columns and cleaned.count() == len(docs)
    for r in cleaned.collect():
        assert not brute_hits(r["text"], items)[1]
        if not brute_hits(dict(docs)[r["doc_id"]], items)[1]:
            assert r["text"] == dict(docs)[r["doc_id"]]
    assert decontaminate.find(d, b.limit(0)).where("size(hit_words) > 0").count() == 0
    assert decontaminate.find(d.limit(0), b).count() == 0
    lost = d.where("doc_id < 3").select(F.lit(None).cast("long").alias("doc_id"), "text").union(d.where("doc_id < 3").select("doc_id", "text"))
    one, many = (sorted(map(tuple, decontaminate.find(lost, b, block_bytes=n).collect()), key=str) for n in (1 << 20, 150))
    assert len(one) == 6 and one == many


def test_index_holds_every_word():
    """The index is of the shard, not of what is searched: any stretch of its words is found at all its places."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 40))) for _ in range(30)] + [None, ""]
    shard = decontaminate.Shard(texts)
    assert len(shard.index.bwt.levels[0][1]) - 1 == sum(len((t or "").split()) + 1 for t in texts) + 1
    for size in (1, 3, 6):
        phrase = texts[4].split()[:size]
        found = shard.search([decontaminate.Phrases([("p", " ".join(phrase))], size)])
        for t, (spans, _) in zip(texts, found, strict=True):
            w = (t or "").split()
            hit = {i + k for i in range(len(w) - size + 1) if w[i : i + size] == phrase for k in range(size)}
            assert {i for a, b in spans for i in range(a, b)} == hit


def test_suffix_array_of_repetitive_texts():
    for text in ([5] * 200, [2, 3] * 150, [2, 2, 3] * 70 + [9], [4]):
        t = np.array([*text, 0], np.int64)
        assert decontaminate.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_the_training_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    for n in (1, 7, 60):
        assert len(toxicity._sampled(docs, labels, "doc_id", "text", "toxic", n, 100)) <= n
    assert len(toxicity._sampled(docs, labels, "doc_id", "text", "toxic", 60, 100)) == 51


def test_training_holds_numbers_not_sets_of_words(spark, monkeypatch):
    words = [f"word{k:05d}" for k in range(3000)]
    deal = random.Random(5)
    rows = [{"_label": i % 4 == 0, "_text": ". ".join(" ".join(deal.choices(words, k=15)) for _ in range(100)) + (" you fool." if i % 4 == 0 else ".")} for i in range(300)]
    size = sum(len(r["_text"]) for r in rows)
    monkeypatch.setattr(toxicity, "_sampled", lambda *_: list(rows))
    tracemalloc.start()
    try:
        model = toxicity.train(None, None, rounds=5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert "fool" in model.weights and peak < 6 * size
    rows[:] = [{"_label": i % 2, "_text": t} for i, t in enumerate(["", "...", "\n", " ! "])]  # no words at all
    assert toxicity.train(None, None, rounds=5).weights == {}

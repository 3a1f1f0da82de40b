"""Copies, vectors, archives, pages and chats against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandline.llm import ann, chat, html_extract, near_dup, queries, suffix_dedup, warc
from strandline.llm.warc import base32


def test_columnwise_transform_against_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        strings = list({"".join(rng.choice("aaaab") for _ in range(rng.randint(20, 34))).encode() for _ in range(rng.randint(1, 12))})
        owner = np.array([rng.randint(0, 5) for _ in strings])
        for s, o, got in zip(strings, owner, suffix_dedup.repeated_windows(strings, owner, 20), strict=True):
            assert got.tolist() == [any(s[i : i + 20] == z[j : j + 20] and q < o for z, q in zip(strings, owner, strict=True) for j in range(len(z) - 19)) for i in range(len(s) - 19)]


def brute_removed(rows, length=50):
    first = {}
    for i, text in rows:
        b = (text or "").encode()
        if i is not None:
            for k in range(len(b) - length + 1):
                w = b[k : k + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - length + 1):
                if first[b[k : k + length]] < i:
                    gone[k : k + length] = b"\1" * length
        out.append((i, len(b), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot_key", [20_000, 3])
def test_suffix_dedup_against_brute_force(spark, hot_key):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abcdefghij é\n") for _ in range(n))
    passage, line = make(130), make(40)
    rows = [(i, make(rng.randint(0, 200)) + (passage[: rng.randint(40, 130)] if i % 3 == 0 else line if i % 3 == 1 else "") + make(60)) for i in range(60)]
    rows += [(70, rows[5][1]), (71, rows[5][1]), (71, rows[5][1]), (72, None), (73, ""), (74, "a" * 3000), (75, "a" * 60), (None, rows[5][1]), (76, "x" * 49), (77, "x" * 49), (-1, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("mine")).repartition(5)
    got = suffix_dedup.mark(df, hot_key=hot_key).collect()
    assert sorted(((r["id"], r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in got), key=str) == brute_removed(rows)
    assert suffix_dedup.mark(df.limit(0)).count() == 0


def brute_classes(rows, size, percent=80):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("size", "block", "crowd"), [(2, 1024, 4096), (5, 7, 3)])
def test_near_duplicates_against_brute_force(spark, size, block, crowd, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "CROWD", crowd)
    monkeypatch.setattr(near_dup, "LARGE", 256 if block > 100 else 6)
    rng = random.Random(6)
    word = lambda: rng.choice("alpha Beta gamma delta eps zeta eta theta iota kappa lam mu nu xi".split()) + str(rng.randint(0, 9))
    rows = []
    for family in range(8):
        base = [word() for _ in range(rng.randint(3, 120))]
        for copy in range(12):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, max(1, len(own) // 25), max(1, len(own) // 12)])):
                own[rng.randrange(len(own))] = word()
            rows.append((family * 100 + copy, "  ".join(own)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "a b a b a b"), (907, "a b c"), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bands", F.lit(1)).repartition(4)
    got = near_dup.classes_of(df, size=size).collect()
    expected = brute_classes(rows, size)
    assert len(got) == len(rows)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected
    assert near_dup.classes_of(df.limit(0), size=size).count() == 0


def test_a_bucket_of_unlike_members_is_cut(spark):
    """50,000 members that share one band and nothing else meet nobody; two that share another band meet once."""
    n = 50_000
    bands = F.expr(f"transform(sequence(0, {near_dup.BANDS - 1}), k -> if(k = 0, 42L, xxhash64(if(k < 3 and id < 2, -1L, id), k)))")
    classes = spark.range(n).select(F.col("id").alias("rep"), F.lit(100).cast("long").alias("n_shingles"), bands.alias("bands"), F.array_repeat(F.lit(0).cast("long"), near_dup.SKETCH_BITS // 64).alias("sketch")).cache()
    members = classes.select(F.lit(42).cast("long").alias("bucket"), F.lit(42).cast("long").alias("also"), "rep", "n_shingles")
    comps = spark.createDataFrame([], "node long, component long")
    cells = near_dup._cells(members, comps, classes).cache()
    assert cells.count() <= 8 and {r["rep"] for r in cells.select("rep").collect()} == {0, 1}
    assert [tuple(r) for r in near_dup._between(cells, 0.8, False).collect()] == [(0, 1)]
    classes.unpersist(), cells.unpersist()


def test_large_buckets_confirm_every_text_of_an_id(spark):
    words = lambda name, n=60: " ".join(f"{name}{k}" for k in range(n))
    docs = spark.createDataFrame([(1, words("a")), (1, words("z")), (2, words("z") + " more")], "doc_id long, text string")
    _, x, y = (r for t in docs.collect() for r in near_dup.signatures(spark.createDataFrame([t], docs.schema), "doc_id", "text", 2).collect())
    bucket = next(p for p, q in zip(x["bands"], y["bands"], strict=True) if p == q)
    cells = [(bucket, bucket, 0, 0, side, r["id"], r["id"], r["n_shingles"], r["sketch"], r["bands"], 300) for side, r in ((0, x), (2, y))]
    cells = spark.createDataFrame(cells, "bucket long, also long, i int, j int, side int, rep long, comp long, n_shingles long, sketch array<long>, bands array<long>, n long")
    assert [tuple(r) for r in near_dup._inside(cells, docs, "doc_id", "text", 2, 0.8).collect()] == [(1, 2)]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 32))
    x = (centers[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 32))).astype(np.float32)
    x[100:160] = x[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 32), (5040, [float("nan")] * 32), (5060, [1.0] * 31), (5080, [None] + [1.0] * 31), (5100, [float("inf")] + [1.0] * 31)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).repartition(4)
    got = ann.search(df, df.where("vec_id % 20 = 0"), k=20).toPandas()
    assert set(got.query_id) == set(range(0, 3000, 20))
    scores = x.astype(np.float64) @ x.astype(np.float64).T
    hits = 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and q not in set(own.vec_id)
        assert np.allclose(own.score, scores[q, own.vec_id])
        assert [(-s, v) for s, v in zip(own.score, own.vec_id, strict=True)] == sorted((-s, v) for s, v in zip(own.score, own.vec_id, strict=True))
        best = sorted((i for i in range(3000) if i != q), key=lambda i: (-scores[q, i], i))[:20]
        hits += len(set(best) & set(own.vec_id))
    assert hits / (150 * 20) >= 0.9
    few = df.where("vec_id < 8")
    assert ann.search(few, few.where("vec_id % 20 = 0"), k=20).count() == 7
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_in_double_precision(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8)) * 10.0 ** rng.integers(-3, 40, (60, 1))
    rows = [(i % 55, v) for i, v in enumerate(x.tolist())] + [(70, [1.0, float("nan")] * 4), (71, None), (72, [0.0] * 8), (73, [None] * 8), (74, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("mine"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.search(df, df.where("vec_id = 20"), k=20, recall=1.0).collect()}
    q = x[20]
    scores = []
    for i, v in rows[:60]:
        total = 0.0
        for a, b in zip(q.tolist(), v, strict=True):
            total += a * b
        scores.append((-total, i))
    want = sorted(s for s in scores if s[1] != 20)[:20]
    assert [got[20, r] for r in range(1, 21)] == [(i, -s) for s, i in want]
    assert ann.search(df, df.where("vec_id = 74"), k=3, dim=5).count() == 0 and ann.search(df.limit(0), df, k=3).count() == 0


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.stack(t.embedding).astype(np.float64)
    got = queries.op7_ann(spark, sf).toPandas().groupby("query_id").vec_id.apply(set)
    hits = 0
    for q in got.index:
        row = int(np.flatnonzero(t.vec_id == q)[0])
        s = x @ x[row]
        s[row] = -np.inf
        hits += len(set(t.vec_id.to_numpy()[np.argsort(-s)[:20]]) & got[q])
    assert hits / (20 * len(got)) >= 0.9


def test_warc_round_trip(spark):
    big = "é" * 1_200_000
    rows = [(3, "http://a.b/c d", "x"), (1, None, "x"), (2, "u", big), (7, "u", big), (8, "u", None), (9, "u", ""), (4, "u", "WARC/1.1\r\n\r\nnot a record\r\n"), (None, "u", "x"), (1, None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    files = warc.write(pages)
    chunks = warc.read(files).collect()
    texts = {}
    for r in sorted((c for c in chunks if c["record_type"] == "response"), key=lambda c: c["chunk_no"]):
        texts.setdefault(r["page_id"], [b"", None])
        if r["page_id"] not in (1, None):
            texts[r["page_id"]][0] += bytes(r["data"])
        texts[r["page_id"]][1] = r["digest_so_far"]
    assert texts[2][0].decode() == big and max(c["chunk_no"] for c in chunks if c["page_id"] == 2) == 2
    assert texts[4][0].decode() == rows[6][2]
    ends = sorted(((c["page_id"], c["record_type"], c["refers_to"], c["declared_bytes"], c["declared_digest"]) for c in chunks if c["is_last"]), key=str)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        again = i is not None and i > first
        want.append((i, "revisit" if again else "response", first if again else None, len(data), base32(hashlib.sha1(data).digest())))
    assert ends == sorted(want, key=str)
    assert all(c["digest_so_far"] == c["declared_digest"] for c in chunks if c["is_last"] and c["record_type"] == "response")
    empty = warc.write(pages.limit(0))
    assert empty.count() == 0 and warc.read(empty).count() == 0
    assert {r["record_type"] for r in warc.read(warc.write(pages.where("page_id is not null").dropDuplicates(), least=1 << 30)).collect()} == {"response"}


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="no-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Menu</a></li></ul></nav><div class="cookie-notice">Cookies</div><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p><b>First
 part.<br>Second.<p>Third &lt;tag&gt; caf&eacute;.<ul><li>One<li>Two</ul><form>Name <input></form><aside>Side</aside>
<div id="comments"><p>Reader says</p></div><p hidden>Hidden</p></article><div class="sidebar">Side</div><footer>&copy; Foot</footer></body></html>"""


def test_page_text():
    assert html_extract.blocks(PAGE) == ["Head & line", "First part. Second.", "Third <tag> café.", "One", "Two"]
    assert html_extract.blocks("<article><p>a &am") == ["a &am"]
    assert html_extract.blocks("<div class=ad>x<article>y</article>") == ["y"]
    assert html_extract.blocks("<p>a<!-- never closed") == ["a"]
    assert html_extract.blocks("<p>a<script>never closed") == ["a"]
    assert html_extract.blocks("a < b <> c") == ["a < b <> c"]
    assert html_extract.blocks("plain\ttext") == ["plain text"]


def test_template_text_goes_where_no_article_is_marked(spark):
    page = lambda i: f"<html><body><div><span>The daily site</span></div><div><p>Story {i} alpha {i * 7}.</p></div><div>Write to us</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(8)] + [(50, "http://other.example/", page(3)), (51, None, None), (52, "http://h.example/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert [got[i] for i in range(8)] == [f"Story {i} alpha {i * 7}." for i in range(8)]
    assert got[50].split("\n\n") == ["The daily site", "Story 3 alpha 21.", "Write to us"]
    assert got[51] == got[52] == "" and len(got) == len(rows)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_classes_decide_within_articles(spark):
    """What every page of a host repeats goes, under whatever name; what varies stays, under whatever name."""
    page = lambda i: f"<html><body><article><div class='article-header'><h1>Story {i}</h1></div><div class='x'>Read it in our app</div><p>Body {i * 3}.</p><div class='share-price'>Price {i}</div><div class='related work'>Work {i}</div><p>a{i}<math>{i}</math></p><div class='comments'>Reader {i}</div></article></body></html>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(8)] + [(100 + i, "http://few.example/", page(i)) for i in range(2)] + [(200 + i, "http://copies.example/", page(1)) for i in range(9)] + [(300, "http://h.example/0", page(0))]
    got = {r["page_id"]: r["text"].split("\n\n") for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = lambda i: [f"Story {i}", f"Body {i * 3}.", f"Price {i}", f"Work {i}", f"a{i}{i}"]
    assert [got[i] for i in range(8)] == [own(i) for i in range(8)] and got[300] == own(0)
    assert got[100] == own(0)[:1] + ["Read it in our app"] + own(0)[1:]  # two pages are no template
    assert got[200] == own(1)[:1] + ["Read it in our app"] + own(1)[1:]  # nor are copies of one


def test_classes_need_one_order_and_one_gap(spark):
    swapped = lambda i: f"<html><body><article><p>{'A B'.split()[i % 2]}</p><p>{i}</p><p>{'A B'.split()[1 - i % 2]}</p></article></body></html>"
    rows = [(i, f"http://h.example/{i}", swapped(i)) for i in range(8)]
    got = {r["page_id"]: r["text"].split("\n\n") for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == ["A", "0", "B"] and got[1] == ["B", "1", "A"]


def test_a_long_page_of_unclosed_tags():
    began = time.time()
    assert html_extract.blocks("<article>" + "<div>" * 100_000 + "</b>" * 100_000 + "end") == ["end"]
    assert time.time() - began < 5


def test_pages_of_the_table(spark, sf_dir):
    rows = queries.op9_html(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        want = [" ".join(html_extract.entities.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert [" ".join(x.split()) for x in r["text"].split("\n\n")] == [x for x in want if x]
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("section", [1024, 7])
def test_chat_round_trip(spark, section):
    rng = random.Random(9)
    piece = lambda: rng.choice(["<|im_end|>", "<\\|x", "<|", "\\", "\n", "word ", "é🙂", "<|im_start|>assistant\n", "long " * 60])
    rows = []
    for conv in range(12):
        if conv % 2:
            rows.append((conv, 0, "system", "Be <|kind|>."))
        rows += [(conv, t, ("user", "assistant")[t % 2], "".join(piece() for _ in range(rng.randint(0, 12)))) for t in range(1, rng.randint(2, 40))]
    rows += [(50, 1, "assistant", None), (50, None, None, "first"), (50, 2, "odd\nrole\\", "x"), (50, 2, "odd\nrole\\", "x"), (None, 1, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).repartition(5)
    windows = chat.windows(df, section=section)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    low = (False, 0)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: tuple(low if v is None else (True, v) for v in r[1:]))
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own).encode()
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        row = got[conv]
        assert (row["n_turns"], row["turns_sha256"], row["loss_chars"], row["loss_sha256"]) == (len(own), hashlib.sha256(said).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in windows.collect():
        turns = list(chat.turns_of(w["text"]))
        assert len(turns) == w["n_repeated"] + w["n_new"]
        assert sum(chat.FRAME + chat.estimated(t) for _, t in turns) <= chat.BUDGET or w["n_new"] == 1
        if w["conv_id"] is not None and w["conv_id"] % 2 and w["conv_id"] < 12:
            assert turns[0] == ("system", "Be <|kind|>.")
        if section == 7 and w["section"] > 0 and w["window"] == 0 and (w["conv_id"] or 50) < 12:
            assert w["n_repeated"] >= w["conv_id"] % 2
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0


def test_chat_splits_a_long_conversation(spark):
    n = 100_000
    turns = spark.range(n).selectExpr("7L as conv_id", "id as turn", "if(id = 0, 'system', if(id % 2 = 1, 'user', 'assistant')) as role", "concat('turn ', id) as text")
    windows = chat.windows(turns, (public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN)).cache()
    share = windows.groupBy("section").agg(F.sum("n_new").alias("turns"), F.min("n_repeated").alias("repeated")).collect()
    assert len(share) == 98 and max(r["turns"] for r in share) == 1024
    later = windows.where("section > 0 and window = 0").select("text", "n_repeated").collect()
    assert all(w["n_repeated"] == 3 and w["text"].startswith("<|im_start|>system\nturn 0<|im_end|>") for w in later)
    row = chat.read_back(windows).first()
    said = "".join(f"{'system' if i == 0 else 'user' if i % 2 else 'assistant'}\nturn {i}\n" for i in range(n)).encode()
    assert (row["n_turns"], row["turns_sha256"]) == (n, hashlib.sha256(said).hexdigest())
    windows.unpersist()


def test_chat_adds_the_hard_conversation(spark, sf_dir):
    row = queries.op10_chat(spark, sf_dir).where("conv_id = -1").first()
    hard = "<|im_end|><|im_start|>assistant ok"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(hard)
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{hard}\nassistant\n{hard}\n".encode()).hexdigest()


@pytest.mark.parametrize("length", [50, 120, 300])
def test_suffix_dedup_of_other_lengths(spark, length):
    rng = random.Random(length)
    shared = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(length - 20, 3 * length))) for _ in range(6)]
    some = lambda: "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 150)))
    texts = ["".join(some() + rng.choice([*shared, ""]) for _ in range(3)) + some() for _ in range(40)]
    got = {r["id"]: r for r in suffix_dedup.mark(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=length).collect()}
    first: dict[str, int] = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            first.setdefault(t[i : i + length], k)
    for k, t in enumerate(texts):
        gone = {j for i in range(len(t) - length + 1) if first[t[i : i + length]] < k for j in range(i, i + length)}
        assert bytes(got[k]["kept"]).decode() == "".join(c for j, c in enumerate(t) if j not in gone)


def test_suffix_dedup_refuses_other_lengths(spark):
    for length in (0, 15, 1 << 20):
        with pytest.raises(ValueError, match="length is"):
            suffix_dedup.mark(spark.createDataFrame([(1, "a")], "doc_id long, text string"), length=length)


@pytest.mark.parametrize(("dim", "near"), [(64, True), (61, False)])
def test_nearest_neighbours_where_codes_are_poor(spark, dim, near):
    """Queries that lie apart from all other vectors, close to each other; and vectors that have no parts to be coded in."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, dim))
    if near:
        x[::4] = 0.1 * x[::4] + 5 * np.eye(dim)[0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 20 = 0"), k=20, lists=8).toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(own.vec_id))
    assert got.query_id.nunique() == 300 and hits / (300 * 20) >= 0.9, hits / (300 * 20)


def test_crowded_buckets_lose_no_pair(spark, monkeypatch):
    """At a similarity of 0.5 many pairs share a single band: the classes are the same however a bucket is worked off."""
    rng = random.Random(11)
    rows = []
    for family in range(12):
        base = [f"w{family}x{k}" for k in range(40)]
        rows += [(family * 100 + k, " ".join(w if rng.random() < 0.8 else f"o{rng.randrange(10**6)}" for w in base)) for k in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    classes = lambda: {r["id"]: r["component_id"] for r in near_dup.classes_of(df, size=1, threshold=0.5).collect()}
    whole = classes()
    monkeypatch.setattr(near_dup, "CROWD", 0)
    assert classes() == whole

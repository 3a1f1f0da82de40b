"""Periodic runs, spelling variants and token files against brute force, the tokenizers library and round trips."""

import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm import periodic, queries, spelling, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_runs(words, least=12):
    """All runs of a list of words, period by period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(rng):
    n, k = rng.choice([0, 1, 11, 12, 13, 40, 150, 400]), rng.choice([1, 2, 3, 40])
    words = [f"w{rng.randrange(k)}" for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 4:
            a = rng.randrange(n - 2)
            q, stop = rng.randrange(1, max(2, (n - a) // 2)), rng.randrange(a, n + 1)
            for i in range(a + q, stop):
                words[i] = words[a + (i - a) % q]
    return words


def test_runs_are_those_of_brute_force():
    rng = random.Random(3)
    for _ in range(80):
        texts = [some_words(rng) for _ in range(rng.randrange(1, 10))]
        for words, (split, found) in zip(texts, periodic.of_texts([" ".join(t) for t in texts]), strict=True):
            assert [w.decode() for w in split] == words
            assert [tuple(r) for r in found.tolist()] == plain_runs(words)
            assert periodic.collapsed(split, found).decode() == plain_collapsed(words, plain_runs(words))


def test_sums_are_exact():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 400)
    for size, low, high in ((2, 1, 6), (4, 7, 14), (16, 31, 62)):
        starts = np.arange(0, 300, size)
        at, by = periodic.occurrences(words, starts, size, low, high)
        plain = {(s, d) for s in starts.tolist() for d in range(low, high + 1) if s + d + size <= len(words) and (words[s : s + size] == words[s + d : s + d + size]).all()}
        assert {(s, d) for s, d in zip(at.tolist(), by.tolist(), strict=True) if s + d + size <= len(words)} == plain
    a = rng.integers(0, periodic.PRIME, (64, 3)).astype(np.uint64)
    assert (periodic.back(periodic.transform(a.copy())) == a).all()


def test_a_run_among_runs_is_found():
    inner = ["a", "b"] * 10 + ["c"]
    words = inner * 3 + ["z"] + ["x"] * 50_000 + ["y"]
    (_, found), = periodic.of_texts([" ".join(words)])
    rows = {tuple(r) for r in found.tolist()}
    assert (0, 63, 21) in rows and (0, 20, 2) in rows and (64, 50_000, 1) in rows


def test_run_rows(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, "ha " * 30, "x", 1), (3, "ha " * 30, "x", 1), (None, "one two", "x", 1), (4, "é é " * 12, "x", 1), (5, "w " * 40_000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, Collapsed int")
    out = periodic.find(df).orderBy("doc_id").collect()
    assert [r.doc_id for r in out] == [None, 1, 2, 3, 3, 4, 5] and out[0].collapsed == "one two"
    assert [[tuple(x) for x in r.runs] for r in out[1:]] == [[], [], [(0, 30, 1)], [(0, 30, 1)], [(0, 12, 1)], [(0, 40_000, 1)]]
    assert [r.collapsed for r in out[1:]] == ["", "", "ha", "ha", "é é", "w"]
    assert periodic.find(df.limit(0)).count() == 0


def test_op11_is_brute_force(spark, sf_dir):
    out = {r.doc_id: r for r in queries.op11_periodic(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for doc, text in docs:
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(doc).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 3000:
            continue  # brute force is quadratic; the others of its kind are above
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        got = out[doc]
        assert (got.n_runs, got.start, got.length, got.period) == (len(runs), *best)
        assert got.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert got.runs_sha256 == sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)) and got.collapsed_sha256 == sha(plain_collapsed(words, runs))


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts):
    near = defaultdict(list)
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    root = {}
    for w in words:
        root[w] = w
        while form[root[w]]:
            root[w] = form[root[w]]
    return {(w, counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root[w]) for w in words}


@pytest.mark.parametrize("crowd", [1, 32])
def test_groups_are_those_of_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    rng = random.Random(crowd)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 7))) for _ in range(150)}
    words |= {"prefixed" + "".join(rng.choice("xyz") for _ in range(rng.randint(2, 5))) for _ in range(80)}
    counts = {w: rng.choice([3, 3, 4, 6, 9, 12, 30, 100]) for w in words}
    rows = [(w, n - 1, 7) for w, n in counts.items()] + [(w, 1, 8) for w in counts] + [(None, 5, 0), ("gone", None, 0)]
    out = spelling.group(spark.createDataFrame(rows, "word string, n long, root int"))
    assert out.count() == len(counts)
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in out.collect()} == plain_groups(counts)


def test_one_gap_and_short_halves(spark):
    counts = {"aaaaa": 3, "aaaaaa": 6, "aaaa": 12, "baaaa": 24, "aaaab": 48, "ab": 3, "b": 6, "a": 12}
    out = spelling.group(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in out.collect()} == plain_groups(counts)


def test_word_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "Hello hello HELLO, ÀÉ-Àéàéà wörld1wörld", "a"), (3, "wörld " * 5000, "a"), (None, "hello", "a")], "doc_id long, text string, n string")
    assert {(r.word, r.n) for r in spelling.word_counts(docs).collect()} == {("hello", 4), ("wörld", 5002)}
    assert {(r.word, r.n) for r in spelling.word_counts(docs, least=1).collect()} == {("hello", 4), ("wörld", 5002), ("Àéàéà", 1)}
    assert {(r.word, r.n) for r in spelling.word_counts(docs, change=lambda i, w: w[1:] if w == "hello" else w).collect()} == {("wörld", 5002)}
    assert spelling.group(spelling.word_counts(docs.limit(0))).count() == 0


def test_op12_counts_words_as_stated(spark, sf_dir):
    counts = Counter()
    for doc, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{doc}:{run}".encode())
                counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
            run = ""
    kept = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert {(r.word, r.n) for r in queries.op12_spelling(spark, sf_dir).select("word", "n").collect()} == set(kept.items())


def test_parts_are_encoded_as_the_library_encodes_the_whole():
    library, mine, rng = Tokenizer.from_file(PATH), token_files.Encoder(PATH), random.Random(4)
    pieces = [*"ab cd  \n\t'sé漢.1,:!?", " ", "  ", "\x1c", "\x85", "​", "\x0b", "<|endoftext|>", " the", "'ll", "\r\n", "é "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(8000)]
    for k in range(0, len(texts), 400):
        for text, ids in zip(texts[k : k + 400], mine.encode(texts[k : k + 400]), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_file_round_trip_and_ranges(kind):
    rng = np.random.default_rng(5)
    docs = [(k if k % 7 else None, rng.integers(0, 1 << int(rng.integers(1, 33)), int(rng.integers(0, 700)), dtype=np.uint64).astype("<u4")) for k in range(60)]

    class Sink(io.BytesIO):
        def close(self):
            self.whole = self.getvalue()
            super().close()

    sink = Sink()
    writer = token_files.Writer(sink, kind, block=1000)
    for doc, ids in docs:
        writer.add(doc, ids)
    writer.close()
    reader = token_files.Reader(io.BytesIO(sink.whole))
    back = list(reader.documents())
    assert [(d, i.tolist()) for d, _, i in back] == [(d, i.tolist()) for d, i in docs]
    every = np.concatenate([i for _, i in docs])
    for a, b in ((0, 0), (0, 1), (999, 1001), (1500, 4200), (len(every) - 3, len(every) + 9)):
        assert reader.ids(a, b).tolist() == every[a:b].tolist()

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            data = super().read(n)
            self.taken += len(data)
            return data

    source = Counted(sink.whole)
    reader = token_files.Reader(source)
    source.taken = 0
    reader.ids(2500, 2600)
    assert source.taken == int(reader.sizes[2].sum())  # one block alone
    broken = bytearray(sink.whole)
    broken[20] ^= 1
    with pytest.raises(Exception, match="checksum|zstd|[Dd]ata|decompress"):
        token_files.Reader(io.BytesIO(bytes(broken))).ids(0, 10)
    with pytest.raises(ValueError, match="whole file"):
        token_files.Reader(io.BytesIO(sink.whole[:-1]))


def test_token_file_rows(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(5, "five words are in here", 1), (2, None, 1), (3, "", 1), (7, "same", 1), (7, "same", 1), (None, "no id", 1), (-1, "long " * 50_000, 1), (7, "other", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    files = token_files.write(df, PATH, end=2)
    out = token_files.read(files).orderBy("start").collect()
    assert [r.id for r in out] == [-1, 2, 3, 5, 7, 7, 7, None]
    start = 0
    texts = defaultdict(list)
    for doc, text, _ in rows:
        texts[doc].append(text or "")
    for r in out:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == start and ids[-1] == 2
        assert ids[:-1] in [library.encode(t, add_special_tokens=False).ids for t in texts[r.id]]
        start += len(ids)
    assert files.agg(F.sum("ids"), F.sum("documents")).first() == (start, len(rows))
    assert token_files.read(token_files.write(df.limit(0), PATH, end=None)).count() == 0


def test_op13_is_the_library(spark, sf_dir):
    library, start = Tokenizer.from_file(PATH), 0
    out = {r.doc_id: r for r in queries.op13_token_files(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert len(out) == len(docs)
    for doc, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (out[doc].start, out[doc].n_tokens, out[doc].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)

"""Chunks by the plain loop, scopes by code whose structure is known."""

import random

import pytest

from strandline.operators import chunking, units
from strandline.operators.chunking import _SPECIALS, _WORDS, Counts, tokens

FILE = "doc_id long, project_id string, file_path string, content string, ext string"


def count(text):
    return tokens(len(text), len(_WORDS.findall(text)), len(_SPECIALS.findall(text)))


def plain_windows(text, most, overlap, least):
    """The loop over lines, that counts each text anew."""
    lines, at, out = text.split("\n"), 0, []
    while at < len(lines):
        first, chunk = at, ""
        while at < len(lines):
            longer = chunk + "\n" + lines[at] if chunk else lines[at]
            if count(longer) > most and chunk:
                break
            chunk = longer
            at += 1
        if count(chunk) >= least:
            out.append((first + 1, at, count(chunk), chunk))
        if at < len(lines):
            stop, back, n = at, 0, 0
            while back < stop - first and n < overlap:
                back += 1
                n += count(lines[stop - back])
            at = max(stop - back, first + 1)
            again = "\n".join(lines[at : stop + 1]).lstrip("\n")
            if count(again) > most:
                at = stop
    return out or [(1, len(lines), count(text), text)]


def some_text(rng):
    words = ["a", "word", "x = y;", "", "", "longer_identifier_here", "été", "f(a, b);", "{", "}", "\t", "1 + 2"]
    return "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(8))).strip(" ") for _ in range(rng.randrange(1, 40)))


def test_windows_are_those_of_the_loop(spark):
    rng = random.Random(1)
    texts = [some_text(rng) for _ in range(150)] + ["", "\n\n\n", "y" * 4000, "a\n" + "z" * 2000 + "\nb\nc", "\n\nx\n\n"]
    for most, overlap, least in ((20, 5, 3), (60, 15, 5), (5, 0, 1), (30, 30, 10)):
        for text in texts:
            got = [(a, b, n, chunk) for _, a, b, n, chunk in chunking.sliding(text, most, overlap, least)]
            assert got == plain_windows(text, most, overlap, least), (text, most)
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, content string")
    rows = chunking.chunk_sliding(df, 60, 15, 5).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.chunk_index)
        assert [(r.start_line, r.end_line, r.tokens, r.chunk) for r in own] == plain_windows(text, 60, 15, 5)
    assert not [r for r in rows if r.doc_id == -1] and chunking.chunk_sliding(df.limit(0)).count() == 0


def test_a_long_file_takes_time_by_its_length():
    text = "\n".join(f"line {i} of a long file" for i in range(200_000))
    found = Counts(text).windows(300, 60, 20)
    assert found[-1][1] == 199_999 and all(b[0] <= a[1] + 1 for a, b in zip(found, found[1:], strict=False))


class Code:
    """C# code with the units that it has."""

    def __init__(self, rng):
        self.rng, self.lines, self.types, self.n = rng, [], [], 0

    def add(self, *lines):
        self.lines += lines

    def member(self, owner):
        self.n += 1
        k, first = self.n, len(self.lines) + 1
        kind = self.rng.randrange(12)
        if kind == 0:
            self.add(f"  [Attr(X = \"{{\")] public async Task<Dictionary<int, string>> Do{k}<T>(int a = 1) where T : class", "  {", "    var s = \"}\"; // }", "    for (;;) { if (a > 1) { } }", "  }")
            return first, "method", f"Do{k}"
        if kind == 1:
            self.add(f"  public int Size{k} => new[] {{ 1, 2 }}.Length;")
            return first, "property", f"Size{k}"
        if kind == 2:
            self.add(f"  public string Name{k} {{ get; set; }} = \"{{\";")
            return first, "property", f"Name{k}"
        if kind == 3:
            self.add(f"  private readonly List<int> _x{k} = new()", "  {", "    1, 2", "  };")
            return first, "field", f"_x{k}"
        if kind == 4:
            self.add(f"  public {owner}(int a) : base(a)", "  { /* } */ }")
            return first, "constructor", owner
        if kind == 5:
            self.add(f"  event EventHandler E{k} {{ add {{ }} remove {{ }} }}")
            return first, "event", f"E{k}"
        if kind == 6:
            self.add("  public int this[int i] { get { return i; } }")
            return first, "indexer", "this"
        if kind == 7:
            self.add(f"  public static {owner} operator +({owner} a, {owner} b) => a;")
            return first, "operator", "+"
        if kind == 8:
            self.add("  private int a, b;")
            return first, "field", "a"
        if kind == 9:
            self.add("  public event Action Gone;", "  // { not a brace")
            return first, "member", "unknown"
        if kind == 10:
            self.add("  enum Colour { Red, Green }")
            return first, "member", "unknown"
        self.add(f"  void Abstract{k}(string s = @\"a\"\"{{\", char c = '{{');")
        return first, "method", f"Abstract{k}"

    def type(self, depth, namespace):
        self.n += 1
        kind, name = self.rng.choice(["class", "struct", "interface", "record", "record struct"]), f"T{self.n}"
        place = len(self.types)
        self.types.append(None)
        first = len(self.lines) + 1
        self.add(f"public sealed {kind} {name}<T> : Base where T : class", "{")
        members = []
        for _ in range(self.rng.randrange(5)):
            if depth < 3 and self.rng.random() < 0.35:
                at = len(self.lines) + 1
                self.type(depth + 1, namespace)
                members.append((at, len(self.lines), "member", "unknown"))
            else:
                at, what, called = self.member(name)
                end = len(self.lines) - (self.lines[-1] == "  // { not a brace")
                members.append((at, end, what, called))
        self.add("}")
        self.types[place] = (name, kind, first, len(self.lines), namespace, members)


@pytest.mark.parametrize("seed", range(12))
def test_scopes_of_code_with_known_structure(seed):
    rng = random.Random(seed)
    code = Code(rng)
    code.add("#region {", "using System;", "using A = B.C;", "/* class Not { */")
    style = seed % 3
    if style == 0:
        code.add("namespace One.Two;")
    elif style == 1:
        code.add("namespace One.Two", "{")
    for _ in range(3):
        code.type(0, "One.Two" if style < 2 else None)
    if style == 1:
        code.add("}")
    text = "\n".join(code.lines)
    for most in (0, 12, 25, 60, 10_000):
        want = []
        for name, kind, first, last, namespace, members in code.types:
            if last - first + 1 > most:
                want += [(n, k, a, b, namespace) for a, b, k, n in members]
            else:
                want.append((name, kind, first, last, namespace))
        got = [u[:5] for u in units.units_of(text, ".cs", lambda a, b, most=most: b - a + 1 > most)]
        assert got == want


def test_top_level_and_unbalanced():
    assert [u[:4] for u in units.units_of("using A;\n\nvar x = 1;\nif (x > 0) { Go(); }\nGo();\n", ".cs")] == [("Program", "top-level", 3, 5)]
    assert units.units_of("using (var f = Open()) { }", ".cs")[0].type == "top-level"
    assert units.units_of("using A;\n", ".cs") == [] and units.units_of("", ".cs") == []
    assert [u[:4] for u in units.units_of("public record Person(string Name, int Age);", ".cs")] == [("Person", "record", 1, 1)]
    assert [u[:4] for u in units.units_of("} }\nclass A {\n void M() {\n", ".cs")] == [("A", "class", 2, 3)]
    for part in ("class A {", "{", "}", '"', "'", "/*", '$"{', "[", "(", "a = {", 'x("', "@\"", '"""'):
        text = part * 40_000
        assert isinstance(units.units_of(text, ".cs"), list)  # in time by its length


def test_other_languages():
    java = "import x;\npublic class A {\n  int f(int a) {\n    if (a > 1) { return 2; }\n  }\n}\n"
    assert [u[:4] for u in units.units_of(java, ".java")] == [("f", "method", 3, 5), ("if", "method", 4, 4)]
    assert [u[:4] for u in units.units_of("class A { int x; }\n", ".java")] == [("A", "class", 1, 2)]
    script = "export function run(a) {\n  return [a];\n}\nconst go = (x) => {\n};\nlet one = (y) => y"
    assert [u[:4] for u in units.units_of(script, ".ts")] == [("run", "method", 1, 3), ("go", "method", 4, 5), ("one", "method", 6, 6)]
    python = "\ndef hello():\n    print(1)\n\nclass A:\n  def b(self): pass\n"
    assert [u[:4] for u in units.units_of(python, ".py")] == [("hello", "method", 2, 4), ("b", "method", 6, 7)]
    assert [u[:4] for u in units.units_of("class A:\n  x = 1", ".py")] == [("A", "class", 1, 2)]
    assert units.units_of("class X {}", ".md") == []
    for part in ("f(", "function ", "a=(", "f() {", "def a(", "{", "class "):
        for ext in (".java", ".ts", ".py"):
            assert isinstance(units.units_of(part * 20_000, ext), list)


def plain_chunks(text, name, ext, most, overlap, least):
    out = []
    found = units.units_of(text, ext, lambda a, b: count("\n".join(text.split("\n")[a - 1 : b])) > most)
    if not found and ext != ".cs":
        found = [units.Unit(name, "file", 1, text.count("\n") + 1, None, 0, len(text))]
    for u in found:
        part = text[u.start : u.stop]
        if count(part) > most:
            out += [(u.name, u.type, u.start_line + a - 1, u.start_line + b - 1, n, c) for a, b, n, c in plain_windows(part, most, overlap, least)]
        elif count(part) >= least:
            out.append((u.name, u.type, u.start_line, u.end_line, count(part), part))
    return out or [(name, "file", a, b, n, c) for a, b, n, c in plain_windows(text, most, overlap, least)]


def test_semantic_chunks(spark):
    body = "\n".join(f"    int x{i} = {i};" for i in range(60))
    texts = [(".cs", f"using A;\npublic class Small {{ }}\npublic class Large\n{{\n{body}\n  void M() {{\n{body}\n  }}\n}}\n"), (".cs", "no units here\n" * 30), (".py", f"import a\ndef f():\n{body}\nclass G:\n    pass"), (".ts", "export function f() {\n  return 1;\n}"), (".md", "words " * 200), (".md", "w"), (".cs", "  "), (".cs", None), (".cs", "Go();"), (None, "x y z")]
    df = spark.createDataFrame([(k, "p", f"src/f{e}", t, e) for k, (e, t) in enumerate(texts)], FILE)
    rows = chunking.chunk_corpus(df.withColumnRenamed("doc_id", "doc_id"), 60, 15, 5).collect()
    for k, (ext, text) in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.chunk_index)
        want = plain_chunks(text, f"f{ext}", ext or "", 60, 15, 5) if text and text.strip() else []
        assert [(r.name, r.type, r.start_line, r.end_line, r.tokens, r.chunk) for r in own] == want, k
        assert [r.chunk_index for r in own] == list(range(len(own))) and all(r.total_chunks == len(own) for r in own)
    assert {r.name for r in rows if r.doc_id == 0} >= {"M", "x0"} or {r.type for r in rows if r.doc_id == 0} >= {"method"}
    assert chunking.chunk_corpus(df.limit(0)).count() == 0


def test_units_of_rows(spark):
    df = spark.createDataFrame([(1, ".cs", "namespace N { class A { } }", "x"), (2, ".cs", None, "x"), (3, None, "t", "x")], "doc_id long, ext string, content string, units string")
    got = units.extract_units(df.drop("units")).collect()
    assert [tuple(r) for r in got] == [(1, "A", "class", 1, 1, "N")]
    assert [len(r.units) for r in units.with_units(df).orderBy("doc_id").collect()] == [1, 0, 0]


def test_the_plan_folds_nothing_in_a_filter(spark):
    df = spark.createDataFrame([(1, "p", "a.cs", "x", ".cs")], FILE)
    for plan in (chunking.chunk_sliding(df).where("tokens > 0"), chunking.chunk_corpus(df).where("tokens > 0")):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "aggregate(" not in text and text.count("MapInArrow") == 1


def test_words_of_a_whole_text_are_counted_at_once(monkeypatch):
    rng = random.Random(4)
    for alphabet in ("ab_1 .;(\n", "a\u00e9\u0301\u203f\u00bd\u2160\U0001d7d8 \u4e2d;=\n\r\u2028", "\n", "a"):
        for _ in range(60):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            lines = text.split("\n")
            counts = Counts(text)
            of = lambda part: tokens(len(part), len(_WORDS.findall(part)), len(_SPECIALS.findall(part)))
            assert counts.each == [sum(map(of, lines[:k])) for k in range(len(lines) + 1)] and counts.filled == [k for k, x in enumerate(lines) if x]
            assert all(counts.whole(a, b) == of("\n".join(lines[a : b + 1])) for a in range(len(lines)) for b in range(a, len(lines)))
            assert all(counts.part(a, b) == of(text[a:b]) for a in range(len(text) + 1) for b in range(len(text) + 2))
    calls = []

    class Counted:
        def findall(self, text):
            calls.append(text)
            return []

    monkeypatch.setattr(chunking, "_WORDS", Counted())
    monkeypatch.setattr(chunking, "_SPECIALS", Counted())
    chunking.semantic("a b;\n" * 500, "x/a.md", ".md", 60, 15, 5)
    assert not calls  # before: two searches for each line

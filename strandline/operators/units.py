"""Units of source files: the types of C# files and the members of too large ones, top-level statements, Java and script
functions, Python functions.

C# files are read into a tree of brace scopes. Comments, strings and directives are blanked first, so that braces in them do
not count; then a pass matches the braces, and each body is cut into its statements, from one to the next without looking into
the scopes between. A statement that declares a type is a node. All types are units, as they are met; one that is too large
gives its members in its place, and the types among these are looked into in turn. It is a reading by scopes, not a parser:
what is unbalanced ends with the file.

Other languages have the published patterns: whatever looks like a Java method with a body, script functions and arrows up to
their matching brace, Python functions up to the next definition; a class if there is no such unit, else the file.

Each text is gone through a fixed number of times, and each body by its own statements only, so time grows with the text.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.batches import by_bytes

#: Patterns of units by language.
JAVA_METHOD = regex.compile(r"\b([A-Za-z_][A-Za-z0-9_]*+)\s*+\([^)]*+\)\s*+\{")
SCRIPT = regex.compile(r"function\s++([A-Za-z_][A-Za-z0-9_]*+)\s*+\(|\b([A-Za-z_][A-Za-z0-9_]*+)\s*+=\s*+\([^)]*+\)\s*+=>")
PYTHON = regex.compile(r"^\s*+def\s++([A-Za-z_][A-Za-z0-9_]*+)\s*+\(")
PYTHON_NEXT = regex.compile(r"^\s*+(?:def |class )")
CLASS = regex.compile(r"\bclass\s++([A-Za-z_][A-Za-z0-9_]*+)")
PYTHON_CLASS = regex.compile(r"^\s*+class\s++([A-Za-z_][A-Za-z0-9_]*+)", regex.M)
#: Extensions of the languages.
JAVA, SCRIPTS, PY, CSHARP = (".java",), (".ts", ".tsx", ".js", ".jsx"), (".py",), (".cs",)
#: Characters that a script unit without a brace takes.
SHORT = 200

_BLANK = regex.compile(
    r"""//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?+|^[ \t]*+\#[^\n]*+"""
    r"""|[$@]*+\"{3}(?:[^"]++|\"(?!""))*+(?:\"{3})?+|(?:@\$?+|\$@)"(?:[^"]++|"")*+"?+|\$?+"(?:[^"\\\n]++|\\.)*+"?+|'(?:\\[^'\n]{1,8}+|[^'\\\n])'""",
    regex.M,
)
_MODIFIERS = r"^\s*+(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|ref|unsafe|new|file|virtual|override|async|extern|required|const|volatile)\s++)*+"
_TYPE = regex.compile(_MODIFIERS + r"(class|struct|interface|record(?:\s++(?:struct|class)\b)?)\s++@?+(?!where\b)(\w++)")
_NAMESPACE = regex.compile(r"^\s*+namespace\s++([\w.]++)")
_NO_STATEMENT = regex.compile(r"^\s*+(?:(?:global\s++)?using\b(?!\s*+\()(?!\s++(?:var|await)\b)|extern\s++alias\b|namespace\b|\[\s*+(?:assembly|module)\s*+:)")
_OTHER_TYPE = regex.compile(_MODIFIERS + r"(?:enum|delegate)\b")
_ATTRIBUTES = regex.compile(r"^\s*+(?:\[(?:[^\[\]]++|\[[^\[\]]*+\])*+\]\s*+)++")
_ASSIGNED = regex.compile(r"(?<![=!<>+\-*/|&^%?])=(?![=>])|=>")
_EVENT = regex.compile(r"\{\s*+(?:add|remove)\b")


class Unit(NamedTuple):
    name: str
    type: str
    start_line: int
    end_line: int
    namespace: str | None
    start: int
    stop: int


class Lines:
    """Where the lines of a text begin; the line, from 1, of a place."""

    def __init__(self, text: str):
        self.text = text
        self.begins = [0]
        at = text.find("\n")
        while at >= 0:
            self.begins.append(at + 1)
            at = text.find("\n", at + 1)

    def of(self, place: int) -> int:
        return bisect.bisect_right(self.begins, place)

    def span(self, first: int, last: int) -> tuple[int, int]:
        """Places of the lines first to last, without the last line feed."""
        return self.begins[first - 1], self.begins[last] - 1 if last < len(self.begins) else len(self.text)


def blanked(text: str) -> str:
    """The text with comments and directives as spaces and strings as quotes; line feeds stay."""

    def blank(m: regex.Match) -> str:
        mark = " " if m[0].lstrip()[:1] in "/#" else '"'
        return regex.sub(r"[^\n]", mark, m[0])

    return _BLANK.sub(blank, text)


def matches(text: str) -> dict[int, int]:
    """For each opening brace the place of its closing one; those never closed are left out."""
    found, held = {}, []
    for m in regex.finditer(r"[{}]", text):
        if m[0] == "{":
            held.append(m.start())
        elif held:
            found[held.pop()] = m.start()
    return found


class Scopes:
    """The scopes of a C# text."""

    def __init__(self, text: str):
        self.lines, self.text = Lines(text), blanked(text)
        self.close = matches(self.text)
        self.marks = [m.start() for m in regex.finditer(r"[{};]", self.text)]

    def statements(self, start: int, stop: int) -> Iterator[tuple[int, int, str, int | None]]:
        """(start, stop, head, open) of each statement of a body: up to its semicolon or behind its block, which opens at `open`."""
        begin, open_, k = start, None, bisect.bisect_left(self.marks, start)
        while k < len(self.marks) and (at := self.marks[k]) < stop:
            mark, end = self.text[at], None
            if mark == "{":
                head = self.text[begin:at]
                shut = min(self.close.get(at, stop - 1), stop - 1)
                if open_ is None and not _assigned(head):
                    open_ = at
                    if not regex.compile(r"\s*+=(?!>)").match(self.text, shut + 1, stop):
                        end = shut + 1
                k = bisect.bisect_right(self.marks, shut)
            else:
                end, k = (at + 1 if mark == ";" else None), k + 1
                if mark == "}":  # one too many
                    begin, open_ = at + 1, None
            if end is not None:
                first = self._first(begin, end)
                if first < end - (mark == ";"):
                    yield first, end, self.text[first : open_ if open_ is not None else end], open_
                begin, open_ = end, None

    def _first(self, start: int, stop: int) -> int:
        m = regex.compile(r"\S").search(self.text, start, stop)
        return m.start() if m else stop

    def body(self, open_: int) -> tuple[int, int]:
        return open_ + 1, self.close.get(open_, len(self.text))

    def units(self, too_large: Callable[[int, int], bool]) -> Iterator[Unit]:
        """Types in the order in which they stand; too_large(first line, last line) says which give their members."""
        found, loose = False, []
        todo: list[tuple[Iterator, str | None, bool]] = [(self.statements(0, len(self.text)), None, True)]
        namespace = None
        while todo:
            statements, namespace, top = todo[-1]
            statement = next(statements, None)
            if statement is None:
                todo.pop()
                continue
            start, stop, head, open_ = statement
            bare = _ATTRIBUTES.sub("", head)
            if (m := _NAMESPACE.match(bare)) and top:
                if open_ is None:
                    todo[-1] = (statements, m[1], True)
                else:
                    todo.append((self.statements(*self.body(open_)), m[1], True))
            elif m := _TYPE.match(bare):
                found = True
                first, last = self.lines.of(start), self.lines.of(stop - 1)
                if too_large(first, last):
                    yield from self._members(open_, m[2], namespace)
                else:
                    kind = "record struct" if m[1].startswith("record") and m[1].endswith("struct") else m[1].split()[0]
                    yield Unit(m[2], kind, first, last, namespace, *self.lines.span(first, last))
                if open_ is not None:
                    todo.append((self.statements(*self.body(open_)), namespace, False))
            elif top and len(todo) == 1 and not _NO_STATEMENT.match(head) and not _OTHER_TYPE.match(bare):
                loose = [loose[0] if loose else start, stop]
        if loose and not found:
            first, last = self.lines.of(loose[0]), self.lines.of(loose[1] - 1)
            yield Unit("Program", "top-level", first, last, None, *self.lines.span(first, last))

    def _members(self, open_: int | None, owner: str, namespace: str | None) -> Iterator[Unit]:
        for start, stop, head, at in self.statements(*self.body(open_)) if open_ is not None else ():
            kind, name = member_of(head, owner, self.text[at : at + 400] if at is not None else "")
            first, last = self.lines.of(start), self.lines.of(stop - 1)
            yield Unit(name, kind, first, last, namespace, *self.lines.span(first, last))


def _assigned(head: str) -> bool:
    """True if a block behind this head is part of an expression."""
    if "=" not in head:
        return False
    return bool(_ASSIGNED.search(_flat(_ATTRIBUTES.sub("", head))))


def _flat(head: str) -> str:
    """The head without what stands in round or square brackets; the brackets stay."""
    out, depth = [], 0
    for c in head:
        if c in "([":
            if depth == 0:
                out.append(c)
            depth += 1
        elif c in ")]" and depth:
            depth -= 1
            if depth == 0:
                out.append(c)
        elif depth == 0:
            out.append(c)
    return "".join(out)


def _called(left: str) -> str:
    """The name before the first round brackets that have one; type parameters stand between."""
    at = left.find("()")
    while at >= 0:
        stop, depth = len(left[:at].rstrip()), 0
        while stop and (left[stop - 1] == ">" or depth):
            stop -= 1
            depth += {">": 1, "<": -1}.get(left[stop], 0)
        end = len(left[:stop].rstrip())
        begin = end
        while begin and (left[begin - 1].isalnum() or left[begin - 1] == "_"):
            begin -= 1
        if begin < end:
            return left[begin:end]
        at = left.find("()", at + 2)
    return ""


def member_of(head: str, owner: str, block: str) -> tuple[str, str]:
    """Kind and name of a member, by its head and what its block begins with."""
    bare = regex.sub(_MODIFIERS, "", _ATTRIBUTES.sub("", head)).strip().rstrip(";").rstrip()
    flat = _flat(bare)
    left = _ASSIGNED.split(flat, maxsplit=1)[0].rstrip()
    if _TYPE.match(bare) or _OTHER_TYPE.match(bare) or flat.startswith("~") or regex.match(r"(?:implicit|explicit)\b", flat):
        return "member", "unknown"
    if m := regex.match(r"event\b.*?([\w.]++)\s*+$", left, regex.S):
        return ("event", m[1].rpartition(".")[2]) if _EVENT.match(block) else ("member", "unknown")
    if regex.search(r"\bthis\s*+\[\]", flat):
        return "indexer", "this"
    if m := regex.search(r"\boperator\s*+(?:checked\s++)?+([^\s(]++)", bare):
        return "operator", m[1]
    if name := _called(left):
        return ("constructor" if left.startswith(name) and name == owner else "method"), name
    if block or "=>" in flat:
        return "property", (regex.findall(r"\w++", left) or ["unknown"])[-1]
    first = regex.split(r",(?![^<]*+>)", left)[0]
    names = regex.findall(r"\w++", regex.sub(r"\[\]", "", first))
    return ("field", names[-1]) if len(names) > 1 else ("member", "unknown")


def _braced(text: str, pattern: regex.Pattern) -> Iterator[Unit]:
    """Units that begin where the pattern does and end with the brace that matches the next opening one."""
    lines, close = Lines(text), matches(text)
    opens = [m.start() for m in regex.finditer(r"\{", text)]
    for m in pattern.finditer(text):
        k = bisect.bisect_left(opens, m.start())
        if k == len(opens):
            last, line = min(len(text) - 1, m.start() + SHORT), lines.of(min(len(text), m.start() + SHORT))
        else:
            last = close.get(opens[k], len(text) - 1)
            line = lines.of(last) if opens[k] in close else len(lines.begins)
        yield Unit(m[1] or m[2], "method", lines.of(m.start()), line, None, m.start(), last + 1)


def _python(text: str) -> Iterator[Unit]:
    lines = Lines(text)
    rows = text.split("\n")
    after = len(rows)
    found = []
    for i in range(len(rows) - 1, -1, -1):
        m = PYTHON.match(rows[i])
        if m:
            found.append(Unit(m[1], "method", i + 1, max(i + 1, after), None, *lines.span(i + 1, max(i + 1, after))))
        if m or PYTHON_NEXT.match(rows[i]):
            after = i
    yield from reversed(found)


def units_of(text: str, ext: str, too_large: Callable[[int, int], bool] = lambda first, last: False) -> list[Unit]:
    """The units of a text, none where a language has no rule or its rule finds nothing."""
    if ext in CSHARP:
        return list(Scopes(text).units(too_large))
    if ext in JAVA:
        found, head = list(_braced(text, JAVA_METHOD)), CLASS
    elif ext in SCRIPTS:
        found, head = list(_braced(text, SCRIPT)), None
    elif ext in PY:
        found, head = list(_python(text)), PYTHON_CLASS
    else:
        return []
    if not found and head and (m := head.search(text)):
        found = [Unit(m[1], "class", 1, text.count("\n") + 1, None, 0, len(text))]
    return found


def units_within(text: str, ext: str, most: int | None) -> list[Unit]:
    """The units, C# types of more than `most` tokens by their members; null: none is too large."""
    from strandline.operators.chunking import Counts

    if most is None or ext not in CSHARP:
        return units_of(text, ext)
    counts = Counts(text)
    return units_of(text, ext, lambda first, last: counts.whole(first - 1, last - 1) > most)


FIELDS = ("name", "type", "start_line", "end_line", "namespace")
UNITS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("namespace", T.StringType())]))
KIND = pa.struct([("name", pa.string()), ("type", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("namespace", pa.string())])


def with_units(files: DataFrame, most: int | None = None) -> DataFrame:
    """files with `units`: name, type, first and last line, namespace of each. A C# type of more than `most` tokens gives its
    members; null: none is too large. A narrow step; null texts have no units; a column `units` is replaced."""
    schema = T.StructType([f for f in files.schema if f.name != "units"] + [T.StructField("units", UNITS)])
    names = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "content"):
            column = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
            rows = [[{k: getattr(u, k) for k in FIELDS} for u in units_within(text or "", ext or "", most)] for ext, text in zip(column("ext").to_pylist(), column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*map(column, names), pa.array(rows, pa.list_(KIND))], names=[*names, "units"])

    return files.mapInArrow(run, schema)


def extract_units(files: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, name, type, start_line, end_line, namespace) of the units of all files."""
    return with_units(files.select("doc_id", "ext", "content"), most).select("doc_id", F.inline("units"))

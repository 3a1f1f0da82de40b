"""Chat formatting in budgeted windows.

Turns become `<|im_start|>role`, a line feed, the text, `<|im_end|>` and a line feed. Inside texts and roles a control string's
opening `<|` gets a backslash, and one more where backslashes stand there already, so that reading back is exact.

Running sums of the turns' tokens cut a conversation at turns: a window has the system turn, a limited history repeated from
the window before, and as many new turns as the budget holds, at least one. Loss falls on the text of new assistant turns
only, so a repeated target is masked and every assistant text is learned once. Tokens are counted by a vocabulary that is a
parameter, or estimated from bytes without one.

A conversation is cut at turn numbers: turns of one `section` (turn number divided by SECTION) are dealt to a task together,
sorted, and stream through it, one window in memory. A section's first window repeats the system turn and the last turns of
the section before, as any other window does; these few rows are sent along. So a conversation of any length is formatted by
many tasks. Reading back parses the windows where they lie; only the digest of a conversation, a chain by nature, is
taken over its parsed bytes in order, in a stream.

Defined results: null texts and roles are empty; turns stand in order of turn, then role, then text, nulls first; repeated rows
are repeated turns; rows with a null conversation form one; an empty table gives no window.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe
from .common import pieces, stored

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens of a window, of its repeated history, and turns of that history at most.
BUDGET, HISTORY, HISTORY_TURNS = 512, 128, 2
#: Turn numbers of a section.
SECTION = 1024
#: Ids of long conversations that are broadcast at most, with two numbers each; beyond, a shuffled join does the same.
BROADCAST_IDS = 500_000


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\\" if m[1] == "\\" else "\n", unescape(role))


#: Tokens of a turn's frame: its two control strings, the role and the line feeds.
FRAME = 4


def estimated(text: str) -> int:
    """Tokens where no vocabulary is given: four bytes each."""
    return (len(text.encode("utf-8", "surrogatepass")) + 3) // 4


def counter(vocabulary: tuple[str, str] | None) -> Callable[[str], int]:
    """Tokens of a text by a vocabulary (file, pattern)."""
    if vocabulary is None:
        return estimated
    known = bpe.vocabulary(*vocabulary)
    return lambda text: len(known.packed(text)) // 4 if text else 0


@dataclass
class Windows:
    """Windows of one section, as its turns arrive; given the system turn and the history it begins with."""

    count: Callable[[str], int]
    opening: bool = True
    system: tuple[str, str, int] | None = None
    history: list[tuple[str, str, int]] = field(default_factory=list)
    earlier: list[tuple[str, str, int]] = field(default_factory=list)
    new: list[tuple[str, str, int]] = field(default_factory=list)
    sums: list[int] = field(default_factory=lambda: [0])
    number: int = 0

    def add(self, role: str, text: str) -> tuple | None:
        """Take a turn; returns the window that it closes, if it does."""
        turn, closed = (role, text, FRAME + self.count(text)), None
        frame = (self.system[2] if self.system else 0) + sum(t[2] for t in self.history)
        if self.new and frame + self.sums[-1] + turn[2] > BUDGET:
            closed = self.close()
        self.new.append(turn)
        self.sums.append(self.sums[-1] + turn[2])
        return closed

    def close(self) -> tuple:
        repeated = ([self.system] if self.system else []) + self.history
        parts, spans, at = [], [], 0
        for k, (role, text, _) in enumerate(repeated + self.new):
            head, body = f"{START}{_role(role)}\n", escape(text)
            if k >= len(repeated) and role == "assistant":
                spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts += [head, body, END]
            at += len(head) + len(body) + len(END)
        window = (self.number, "".join(parts), len(repeated), len(self.new), spans)
        if self.opening and self.system is None and self.number == 0 and self.new[0][0] == "system":
            self.system = self.new[0]
        self.remember([t for t in self.history + self.new if t is not self.system])
        self.new, self.sums, self.number = [], [0], self.number + 1
        return window

    def remember(self, turns: list[tuple[str, str, int]]) -> None:
        """Make the last turns, as far as their budget goes, the history."""
        self.history = []
        for turn in reversed(turns[-HISTORY_TURNS:]):
            if sum(t[2] for t in self.history) + turn[2] > HISTORY:
                break
            self.history.insert(0, turn)

    def before(self, kind: int, role: str, text: str) -> None:
        """Take a turn that an earlier section has: the system turn (0), or one of its last ones (1)."""
        turn, self.opening = (role, text, FRAME + self.count(text)), False
        if kind == 0:
            self.system = turn
        elif turn != self.system:
            self.earlier.append(turn)
            self.remember(self.earlier)


WINDOWS = "conv_id long, section long, window int, text string, n_repeated int, n_new int, loss array<struct<start:int,end:int>>"
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("section", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("n_repeated", pa.int32()), ("n_new", pa.int32()), ("loss", _LOSS)])


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    block = []
    for row in rows:
        block.append(row)
        if len(block) == size:
            yield pa.RecordBatch.from_pylist(block, schema=schema)
            block = []
    if block:
        yield pa.RecordBatch.from_pylist(block, schema=schema)


#: Order of the turns of a conversation, nulls first.
ORDER = ("turn", "role", "text")


def _earlier(turns: DataFrame) -> DataFrame:
    """For each section but a conversation's first, the turns of earlier ones that it begins with: kind 0, 1.

    Only conversations of several sections are looked at: where they are few, by a broadcast of checked size."""
    several = stored(turns.groupBy("conv_id").agg(F.min("section").alias("first"), F.max("section").alias("last")).where("first < last"), "long")
    few = several.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    several = F.broadcast(several) if few else several
    long = turns.join(several, turns["conv_id"].eqNullSafe(several["conv_id"]), "left_semi")
    sections = long.select("conv_id", "section").distinct().withColumn("next", F.lead("section").over(Window.partitionBy("conv_id").orderBy("section"))).where("next is not null")
    place = F.row_number().over(Window.partitionBy("conv_id", "section").orderBy(*map(F.desc_nulls_last, ORDER)))
    last = long.withColumn("place", place).where(F.col("place") <= HISTORY_TURNS).drop("place")
    named = sections.select(F.col("conv_id").alias("conv_id_"), F.col("section").alias("section_"), "next")
    history = last.join(named, last["conv_id"].eqNullSafe(named["conv_id_"]) & (last["section"] == named["section_"])).select("conv_id", F.col("next").alias("section"), F.lit(1).alias("kind"), "turn", "role", "text")
    begin = long.join(several.select(F.col("conv_id").alias("c"), "first"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("section") == F.col("first")))
    least = F.min(F.struct(*(x for c in ORDER for x in (F.col(c).isNotNull().alias(f"has_{c}"), F.col(c)))))
    heads = begin.groupBy("conv_id").agg(least.alias("h")).where("h.role = 'system'")
    heads = heads.select(F.col("conv_id").alias("conv_id_"), "h").join(sections, F.col("conv_id_").eqNullSafe(F.col("conv_id"))).select("conv_id", F.col("next").alias("section"), F.lit(0).alias("kind"), F.col("h.turn").alias("turn"), F.col("h.role").alias("role"), F.col("h.text").alias("text"))
    return heads.unionByName(history)


def windows(turns: DataFrame, vocabulary: tuple[str, str] | None = None, section: int = SECTION) -> DataFrame:
    """turns (conv_id, turn, role, text) formatted: text, turns repeated and new, and loss spans (code points) of each window."""
    named = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    named = named.withColumn("section", F.coalesce(F.floor(F.col("turn") / section), F.lit(-(1 << 62))))
    every = named.withColumn("kind", F.lit(2)).unionByName(_earlier(named))
    dealt = every.select("conv_id", "section", "kind", "turn", "role", "text").repartition("conv_id", "section").sortWithinPartitions(F.asc_nulls_first("conv_id"), "section", "kind", *map(F.asc_nulls_first, ORDER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)

        def rows() -> Iterator[dict]:
            current, state = None, None
            for batch in pieces(batches):
                for conv, part, kind, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if state is None or (conv, part) != current:
                        if state is not None:
                            yield shown(current, state.close())
                        current, state = (conv, part), Windows(count)
                    if kind < 2:
                        state.before(kind, role or "", text or "")
                    elif closed := state.add(role or "", text or ""):
                        yield shown(current, closed)
            if state is not None:
                yield shown(current, state.close())

        def shown(at: tuple, window: tuple) -> dict:
            return dict(zip(("conv_id", "section", "window", "text", "n_repeated", "n_new", "loss"), at + window, strict=True))

        yield from _batched(rows(), _SCHEMA)

    return dealt.mapInArrow(run, WINDOWS)


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a window."""
    for part in text.split(START)[1:]:
        role, _, body = part.partition("\n")
        yield _unrole(role), unescape(body[: -len(END)])


SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


PARSED = "conv_id long, section long, window int, n_turns long, turns binary, loss_chars long, loss binary, formatted_chars long"


def parsed(formatted: DataFrame) -> DataFrame:
    """Of each window its new turns as bytes (role, line feed, text, line feed) and the text under the loss mask, unescaped."""
    schema = pa.schema([("conv_id", pa.int64()), ("section", pa.int64()), ("window", pa.int32()), ("n_turns", pa.int64()), ("turns", pa.binary()), ("loss_chars", pa.int64()), ("loss", pa.binary()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for conv, section, window, text, repeated, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = list(turns_of(text))[repeated:]
                targets = [unescape(text[span["start"] : span["end"]]) for span in loss]
                turns = "".join(f"{role}\n{body}\n" for role, body in new).encode("utf-8", "surrogatepass")
                rows.append((conv, section, window, len(new), turns, sum(map(len, targets)), "".join(targets).encode("utf-8", "surrogatepass"), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return formatted.select("conv_id", "section", "window", "text", "n_repeated", "loss").mapInArrow(run, PARSED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its windows: turns and a digest of them, the text under the loss mask and its digest, length."""
    dealt = parsed(formatted).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "section", "window")
    names = [x.split(" ")[0] for x in SUMMARY.split(", ")]
    schema = pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            current, state = None, None
            for batch in pieces(batches):
                for conv, _, _, n, turns, chars, loss, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if state is None or conv != current:
                        if state is not None:
                            yield shown(current, state)
                        current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    state[0] += n
                    state[1].update(turns)
                    state[2] += chars
                    state[3].update(loss)
                    state[4] += length
            if state is not None:
                yield shown(current, state)

        def shown(conv: int | None, s: list) -> dict:
            return dict(zip(names, (conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]), strict=True))

        yield from _batched(rows(), schema)

    return dealt.mapInArrow(run, SUMMARY)

"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only, and one narrow step: no shuffle, no Python. A span has kind, start, end (code points, end
exclusive) and score. Positions come from splitting a text by the pattern: the lengths of gaps and matches in turn, summed.

The patterns are written so that no text makes them slow: a run of characters is consumed once (possessive repeats), and a
match starts where a run starts or where the match before ended.

Defined results: null and empty texts have no spans; repeated rows are scanned each; other columns stay, but for those with
the names of the output columns, which are replaced. Spans of different kinds may overlap; base kinds are never dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points before a match in which context words count, and after it.
BEFORE, AFTER = 48, 24
#: Score of a confirmed span, and what a context word nearby adds.
CONFIRMED, CONTEXT = 0.7, 0.25
#: An unverifiable span counts only with a context word.
PROPOSED = 0.4


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _ip(match: Column) -> Column:
    def fits(part: Column) -> Column:
        plain = F.ltrim(part, F.lit("0"))
        return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(match, r"\."), fits)


def _card(match: Column) -> Column:
    digits = _digits(match)
    return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)


def _phone(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


def _iban(match: Column) -> Column:
    """Mod 97 of the digits with the first four characters moved to the end; a letter counts as 10 to 35."""
    plain = F.replace(match, F.lit(" "))
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c))) == 1)


@dataclass(frozen=True)
class Kind:
    """pattern proposes, holds confirms; hint: characters without which a text has no match; words: context."""

    name: str
    pattern: str
    holds: Callable[[Column], Column] | None
    hint: str
    words: str
    score: float = field(default=CONFIRMED)


#: Base kinds in the order that breaks ties of start, then the kinds that the method adds.
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, "@", r"mail|contact|write|reply"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, ".", r"\bip\b|address|host|server|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card, "", r"card|visa|master|amex|credit|debit|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, "+", r"phone|call|tel|mobile|fax|whatsapp"),
)
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", _iban, "", r"iban|bank|account|konto|transfer"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", None, "-", r"\bssn\b|social security|tax id", PROPOSED),
)
KINDS = BASE + ADDED
SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def prefix_sums(values: Column) -> Column:
    """Running totals of array<bigint> in n log n: each round adds what stands 1, 2, 4, ... places before."""
    n = F.size(values)
    rounds = F.when(n > 1, F.sequence(F.lit(0), F.ceil(F.log2(n.cast("double"))).cast("int"))).otherwise(F.array().cast("array<int>"))

    def double(total: Column, k: Column) -> Column:
        shift = F.least(F.call_function("shiftleft", F.lit(1), k), n)
        return F.zip_with(total, F.concat(F.array_repeat(F.lit(0).cast("bigint"), shift), F.slice(total, F.lit(1), n - shift)), lambda a, b: a + b)

    return F.aggregate(rounds, values, double)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _spans(text: Column, kind: Kind) -> Column:
    """All confirmed spans of one kind, in order of start."""

    def found(matches: Column) -> Column:
        return F.when(F.size(matches) == 0, F.array().cast(SPANS)).otherwise(_let(F.split(text, kind.pattern, -1), lambda gaps: placed(matches, gaps)))

    def placed(matches: Column, gaps: Column) -> Column:
        # ends[i]: where gap i and match i end
        lengths = F.zip_with(gaps, matches, lambda g, m: (F.length(g) + F.coalesce(F.length(m), F.lit(0))).cast("bigint"))
        return _let(prefix_sums(lengths), lambda ends: built(matches, gaps, ends))

    def built(matches: Column, gaps: Column, ends: Column) -> Column:
        def one(match: Column, i: Column) -> Column:
            near = F.concat(F.right(gaps[i], F.lit(BEFORE)), F.lit(" "), F.substring(gaps[i + 1], 1, AFTER))
            context = F.lower(near).rlike(kind.words)
            holds = F.lit(True) if kind.holds is None else kind.holds(match)
            if kind.score < CONFIRMED:
                holds = holds & context
            score = F.lit(kind.score) + F.when(context, F.lit(CONTEXT)).otherwise(F.lit(0.0))
            return F.when(holds, F.struct(F.lit(kind.name).alias("kind"), (ends[i] - F.length(match)).alias("start"), ends[i].alias("end"), score.alias("score")))

        return F.filter(F.transform(matches, one), lambda s: s.isNotNull()).cast(SPANS)

    spans = _let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), found)
    return F.when(F.contains(text, F.lit(kind.hint)), spans).otherwise(F.array().cast(SPANS)) if kind.hint else spans


def _ordered(spans: Column) -> Column:
    """By start, then by kind as listed."""
    place = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k.name), F.lit(i))))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("place"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda x: x["span"])


def find(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with all spans of every whole text, in order of start, as array<struct<kind, start, end, score>>."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumn(out, _ordered(F.concat(*(_spans(whole, kind) for kind in KINDS))))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(docs: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; where spans overlap, the first of them counts."""
    body, found = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{spans}`")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        kept = F.substring(body, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        more = F.struct(s["end"].alias("at"), F.concat(state["parts"], F.array(kept, F.concat(F.lit("<"), s["kind"], F.lit(">")))).alias("parts"))
        return F.when(s["start"] < state["at"], state).otherwise(more)

    joined = F.aggregate(found, start, step, lambda state: F.concat(F.array_join(state["parts"], ""), F.substring(body, (state["at"] + 1).cast("int"), F.length(body))))
    return docs.withColumn(text, F.when(F.col(f"`{text}`").isNotNull(), joined))

"""Operators over findings: gates, consolidation, counts, scores and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.rules import AGENT_ADVICE, ADVICE_ANY, ADVICE_NONE, SEVERITY_CODES


def severity_code(severity: Column, default: str = "medium") -> Column:
    """Code of a severity's name, in any case; the default for other names."""
    out = None
    for name, code in SEVERITY_CODES.items():
        out = F.when(F.lower(severity) == name, code) if out is None else out.when(F.lower(severity) == name, code)
    return out.otherwise(SEVERITY_CODES[default])


#: Categories of findings.
CATEGORIES = ("Performance", "Security", "Architecture", "CodeQuality", "Structure", "Complexity", "Maintainability", "BestPractice", "Other")


def category(name: Column, default: str = "CodeQuality") -> Column:
    """The category of a name in any case; the default for other names."""
    out = None
    for known in CATEGORIES:
        has = F.lower(name) == known.lower()
        out = F.when(has, known) if out is None else out.when(has, known)
    return out.otherwise(default)


def has_evidence(found: DataFrame) -> Column:
    """False for a finding without a file that has no explanation or little confidence."""
    blank = F.coalesce(F.trim("explanation"), F.lit("")) == ""
    return ~(F.col("file_path").isNull() & (blank | (F.col("confidence") < 0.3)))


def _single(name: str) -> Column:
    """The group's value, if all its rows have one; a group of nulls and empty texts has none."""
    return F.when(F.count(name) == F.count("*"), F.max(name)).alias(name)


def merged(found: DataFrame, *more: Column) -> DataFrame:
    """One row for each symbol, file and category of a project, nulls and empty texts alike. Severity: High if any, else Medium
    if any, else the first's. Combined before the shuffle: no texts are gathered."""
    any_of = lambda name: F.bool_or(F.lower("severity") == name)
    keys = [F.coalesce(c, F.lit("")).alias(f"{c}_key") for c in ("symbol", "file_path")]
    return found.groupBy("project_id", *keys, "category").agg(
        _single("symbol"), _single("file_path"),
        F.when(any_of("high"), "High").when(any_of("medium"), "Medium").otherwise(F.coalesce(F.min_by("severity", "ordinal"), F.lit("Medium"))).alias("severity"),
        F.max("confidence").alias("confidence"), F.avg("confidence").alias("avg_confidence"), F.count_if(F.lower("severity") == "high").alias("highs"), F.count("*").alias("merged"), F.min("ordinal").alias("ordinal"), *more,
    ).drop("symbol_key", "file_path_key")


def consolidate(found: DataFrame) -> DataFrame:
    """merged, with the group's descriptions and explanations, joined in the order of `ordinal`, and the first suggestion.

    The texts of a group are its result, so they meet in one row."""
    written = lambda c: F.when(F.trim(c) != "", F.struct("ordinal", F.col(c).alias("text")))
    joined = lambda c, between: F.array_join(F.transform(F.array_sort(F.collect_list(written(c))), lambda x: x["text"]), between)
    first = F.min_by("suggestion", F.when(F.trim("suggestion") != "", F.col("ordinal"))).alias("suggestion")
    return merged(found, joined("description", "\n---\n").alias("description"), joined("explanation", "\n\n").alias("explanation"), first)


def escalate(groups: DataFrame) -> DataFrame:
    """Severity High where two findings were High, or the mean confidence is above 0.85."""
    return groups.withColumn("severity", F.when((F.col("highs") >= 2) | (F.col("avg_confidence") > 0.85), "High").otherwise(F.col("severity")))


def dedupe_and_merge(found: DataFrame, mode: str = "pipeline") -> DataFrame:
    """consolidate, with escalated severities, of groups that have evidence: a file, or an explanation and confidence.

    mode single_pass: the findings as they are. mode pipeline: as the reports do it, of findings that are consolidated already, so
    each group has one row, and only its confidence can escalate it."""
    if mode not in ("pipeline", "single_pass"):
        raise ValueError("mode is pipeline or single_pass")
    rows = consolidate(found)
    if mode == "pipeline":
        rows = consolidate(rows.select(*(F.col(c) for c in ("project_id", "symbol", "file_path", "category", "severity", "confidence", "ordinal", "description", "explanation", "suggestion"))))
    rows = escalate(rows)
    return rows.where(has_evidence(rows))


def agent_advice(found: DataFrame, most: int = 5) -> DataFrame:
    """(project_id, agent, place, advice): the first `most` pieces of advice for each agent of each project, by what its findings
    are; one of no findings has a text of its own. One aggregate with a count for each rule; projects times four agents."""
    rules = [(agent, k, rule) for agent, own in AGENT_ADVICE.items() for k, rule in enumerate((*own, *ADVICE_ANY))]
    severity, text = F.lower("severity"), F.lower(F.coalesce("description", F.lit("")))

    def counted(kind: str, what) -> Column:
        if kind == "category":
            return F.count_if(F.col("category") == what)
        if kind == "word":
            return F.count_if(text.rlike("|".join(what)))
        return F.count("*") if kind == "all" else F.count_if(severity.isin("high", "critical") if kind == "high" else severity == "medium")

    kinds = {(kind, what): f"_n{k}" for k, (kind, what) in enumerate(dict.fromkeys((r[0], r[1]) for _, _, r in rules))}
    numbers = found.groupBy(F.col("project_id").alias("p"), F.col("agent").alias("a")).agg(F.count("*").alias("_all"), *(counted(*k).alias(name) for k, name in kinds.items()))
    agents = found.select("project_id").distinct().withColumn("agent", F.explode(F.array(*map(F.lit, AGENT_ADVICE))))
    rows = agents.join(numbers, F.col("project_id").eqNullSafe(F.col("p")) & (F.col("agent") == F.col("a")), "left")
    n = lambda rule: F.col(kinds[rule[0], rule[1]])
    given = [F.when((F.col("agent") == agent) & (n(rule) > rule[2]), F.replace(F.lit(rule[3]), F.lit("{n}"), n(rule).cast("string"))) for agent, _, rule in rules]
    none = F.when(F.col("_all").isNull(), F.replace(F.lit(ADVICE_NONE), F.lit("{agent}"), F.col("agent")))
    texts = F.slice(F.array_compact(F.array(*given, none)), 1, most)
    return rows.select("project_id", "agent", F.posexplode(texts).alias("place", "advice")).withColumn("place", F.col("place") + 1)


def counts(found: DataFrame, *by: str) -> DataFrame:
    """Counts of each severity by project (or other columns); total is of High, Medium and Low."""
    n = lambda name: F.count_if(F.col("severity") == name)
    return found.groupBy(*(by or ("project_id",))).agg(n("Critical").alias("critical_count"), n("High").alias("high_count"), n("Medium").alias("medium_count"), n("Low").alias("low_count"), n("Info").alias("info_count"), (n("High") + n("Medium") + n("Low")).alias("total"))


REPORT_JSON = "project_id string, critical_count long, high_count long, medium_count long, low_count long, info_count long, total long, health_score int, findings array<struct<ordinal:bigint,agent:string,severity:string,category:string,file_path:string,symbol:string,description:string,explanation:string>>"


def report_json(found: DataFrame) -> DataFrame:
    """(value): a JSON text for each project: counts, score and its findings in order, which a report holds as one document."""
    item = F.struct("ordinal", "agent", "severity", "category", "file_path", "symbol", "description", "explanation")
    nested = found.groupBy(F.col("project_id").alias("p")).agg(F.array_sort(F.collect_list(item)).alias("findings"))
    score = health(F.col("high_count"), F.col("medium_count"), F.col("low_count")).cast("int").alias("health_score")
    rows = counts(found).select("*", score).join(nested, F.col("project_id").eqNullSafe(F.col("p"))).drop("p")
    return rows.select(F.to_json(F.struct(*(c.split()[0] for c in REPORT_JSON.split(", ")))).alias("value"))


def nested(reports: DataFrame, found: DataFrame, most: int, *fields: str) -> DataFrame:
    """reports with `findings`, the first `most` of each in the order of `ordinal`, as an array of those fields; empty if there are
    none. The rank is cut below the shuffle, so that a row is bounded."""
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("ordinal"))
    first = found.withColumn("_place", place).where(F.col("_place") <= most)
    own = first.groupBy(F.col("project_id").alias("_p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", F.struct(*fields).alias("row")))), lambda x: x["row"]).alias("findings"))
    rows = reports.join(own, F.col("project_id").eqNullSafe(F.col("_p")), "left").drop("_p")
    return rows.withColumn("findings", F.coalesce("findings", F.array().cast(dict(own.dtypes)["findings"])))


def health(high: Column, medium: Column, low: Column) -> Column:
    return F.greatest(F.lit(0), 100 - F.least(high * 10, F.lit(50)) - F.least(medium * 3, F.lit(30)) - F.least(low, F.lit(20)))


def band(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 50, "fair").when(score >= 25, "needs improvement").otherwise("critical")


def best_of(found: DataFrame, most: int) -> DataFrame:
    """The most confident finding for each file, symbol and description; of these the best `most` of each agent."""
    same = Window.partitionBy("project_id", "agent", F.coalesce("file_path", F.lit("")), F.coalesce("symbol", F.lit("")), "description").orderBy(F.desc("confidence"), "ordinal")
    top = Window.partitionBy("project_id", "agent").orderBy(F.desc("confidence"), "ordinal")
    return found.withColumn("r", F.row_number().over(same)).where("r = 1").withColumn("place", F.row_number().over(top)).where(F.col("place") <= most).drop("r")


def recommendations(found: DataFrame, most: int = 10) -> DataFrame:
    """(project_id, place, suggestion): a project's first distinct suggestions, in the order of `ordinal`."""
    distinct = found.where(F.trim("suggestion") != "").groupBy("project_id", "suggestion").agg(F.min("ordinal").alias("ordinal"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("ordinal", "suggestion"))
    return distinct.withColumn("place", place).where(F.col("place") <= most).select("project_id", "place", "suggestion")


def report(found: DataFrame, most: int = 10) -> DataFrame:
    """A row for each project: counts of the merged findings, score, band, summary and recommendations."""
    kept = found.where(has_evidence(found) & (F.trim("description") != ""))
    score = health(F.col("high_count"), F.col("medium_count"), F.col("low_count"))
    n = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit("The overall code health is "), F.col("band"), F.lit(" with a score of "), n("health_score"), F.lit("/100. Found "), n("high_count"), F.lit(" high, "), n("medium_count"), F.lit(" medium and "), n("low_count"), F.lit(" low severity findings."))
    rows = counts(escalate(merged(kept))).withColumn("health_score", score.cast("int")).withColumn("band", band(F.col("health_score"))).withColumn("summary", text)
    advice = recommendations(kept, most).groupBy(F.col("project_id").alias("p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "suggestion"))), lambda x: x["suggestion"]).alias("advice"))
    return rows.join(advice, F.col("project_id").eqNullSafe(F.col("p")), "left").drop("p").withColumn("recommendations", F.coalesce(F.array_join("advice", "\n"), F.lit(""))).drop("advice")

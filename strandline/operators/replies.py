"""Model replies as tables: finding the JSON, parsing it tolerantly, validating findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severities and categories that a reply may have.
SEVERITIES = ("High", "Medium", "Low", "Info")
CATEGORIES = ("Architecture", "Security", "Performance", "Maintainability", "CodeQuality", "Testing", "Documentation", "Accessibility", "BestPractice", "Other")
#: Fields that a report must have.
REPORT_FIELDS = ("projectId", "summary", "healthScore", "findings")


def balanced(text: Column) -> Column:
    """The first object or array whose brackets close; null if none does. Brackets in strings count, too."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def step(s: Column, c: Column) -> Column:
        at, live = s["at"] + 1, s["last"] == 0
        opens, closes = live & c.isin("{", "["), live & c.isin("}", "]") & (s["depth"] > 0)
        depth = s["depth"] + opens.cast("int") - closes.cast("int")
        first = F.when(opens & (s["depth"] == 0), at).otherwise(s["first"])
        return F.struct(at.alias("at"), depth.alias("depth"), first.alias("first"), F.when(closes & (depth == 0), at).otherwise(s["last"]).alias("last"))

    span = F.aggregate(F.split(text, ""), start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))
    return F.when(span["last"] > 0, F.substr(text, span["first"], span["last"] - span["first"] + 1))


def extract_json(reply: Column) -> Column:
    """The fenced block of a reply, else its first balanced object or array; null if neither."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.nullif(F.trim(F.when(fenced != "", fenced).otherwise(balanced(reply))), F.lit(""))


def clean_json(text: Column, comments: bool = False) -> Column:
    """From the first [ to the last ]; with comments, // and /* */ go as well (in strings too, so it is off by default)."""
    body = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.regexp_replace(F.regexp_replace(body, r"(?s)/\*.*?\*/", ""), r"(?m)//.*$", "") if comments else body


def _items(replies: DataFrame) -> DataFrame:
    """(reply_id, ordinal, item, m): items of the findings array, and their fields by lower-case name; m null for no object."""
    parsed = replies.withColumn("v", F.try_parse_json(F.coalesce(extract_json(F.col("reply")), F.lit("null"))))
    items = parsed.select("reply_id", F.posexplode(F.expr("coalesce(try_variant_get(v, '$', 'array<variant>'), try_variant_get(v, '$.findings', 'array<variant>'), try_variant_get(v, '$.Findings', 'array<variant>'))")).alias("ordinal", "item"))
    return items.withColumn("m", F.expr("transform_keys(try_variant_get(item, '$', 'map<string,variant>'), (k, x) -> lower(k))"))


def _get(name: str, kind: str) -> Column:
    return F.expr(f"try_variant_get(m['{name}'], '$', '{kind}')")


def parse_findings(replies: DataFrame) -> DataFrame:
    """Rows of the JSON arrays in `reply`. Keys match in any case; fields of another type are converted where that is possible and
null where not. Items that are no objects are in `rejected`. A reply on a cluster (column `cluster`, if there is one, not null)
    is about the cluster as a whole: its name is the path where an item names no file."""
    text = {"severity": "severity", "category": "category", "title": "title", "description": "description", "explanation": "explanation", "suggestedfix": "suggestion", "symbol": "symbol"}
    path = F.coalesce(_get("filepath", "string"), _get("file_path", "string"), _get("file", "string"))
    line = lambda *keys: F.coalesce(*(F.expr(f"try_variant_get(m['linerange'], '$.{k}', 'int')") for k in keys))
    fields = [_get(k, "string").alias(v) for k, v in text.items()]
    items = _items(replies)
    if "cluster" in replies.columns:
        items = items.join(replies.select(F.col("reply_id").alias("_r"), "cluster"), F.col("reply_id") == F.col("_r"))
        path = F.coalesce(path, F.col("cluster"))
    return items.where("m is not null").select("reply_id", "ordinal", *fields, path.alias("file_path"), line("start", "Start").alias("line_start"), line("end", "End").alias("line_end"), _get("confidence", "double").alias("confidence"))


def rejected(replies: DataFrame) -> DataFrame:
    """(reply_id, ordinal, item): items of the arrays that are no findings, and replies without an array, with ordinal null."""
    items = _items(replies)
    none = replies.join(items.select(F.col("reply_id").alias("r")).distinct(), F.col("reply_id") == F.col("r"), "left_anti")
    return items.where("m is null").select("reply_id", "ordinal", F.to_json("item").alias("item")).unionByName(none.select("reply_id", F.lit(None).cast("int").alias("ordinal"), F.col("reply").alias("item")))


def _finding_errors(item: Column, at: Column) -> Column:
    """Errors of a finding (a variant); each names its place."""
    text = lambda key: F.when(F.schema_of_variant(F.try_variant_get(item, f"$.{key}", "variant")) == "STRING", F.try_variant_get(item, f"$.{key}", "string"))
    known = lambda key, values: F.lower(text(key)).isin(*(v.lower() for v in values))
    say = lambda message: F.concat(at, F.lit(message))
    one_of = lambda key, values: F.when(text(key).isNull(), say(f"{key} is required and must be a string")).when(~known(key, values), say(f"{key} must be one of: {', '.join(values)}"))
    sources = F.try_variant_get(item, "$.sources", "variant")
    listed = F.try_variant_get(item, "$.sources", "array<variant>")
    no = F.array().cast("array<string>")
    lacks = lambda x, k, key: F.when(F.try_variant_get(x, f"$.{key}", "string").isNull(), F.concat(at, F.lit("sources["), k.cast("string"), F.lit(f"].{key} is required")))
    each = F.flatten(F.transform(listed, lambda x, k: F.array_compact(F.array(lacks(x, k, "chunkId"), lacks(x, k, "filePath")))))
    blank = F.coalesce(F.trim(text("description")), F.lit("")) == ""
    own = F.array_compact(F.array(F.when(blank, say("description is required and must be a non-empty string")), one_of("severity", SEVERITIES), one_of("category", CATEGORIES), F.when(sources.isNotNull() & listed.isNull(), say("sources must be an array"))))
    return F.concat(own, F.coalesce(each, no))


def validate(replies: DataFrame, kind: str = "response") -> DataFrame:
    """(reply_id, errors): the errors of each reply as a finding, as a response or as a report; none for a good one."""
    v = F.try_parse_json("reply")
    has = lambda key: F.coalesce(F.try_variant_get(v, f"$.{key}", "variant"), F.try_variant_get(v, f"$.{key[0].upper()}{key[1:]}", "variant")).isNotNull()
    items = F.coalesce(F.try_variant_get(v, "$.findings", "array<variant>"), F.try_variant_get(v, "$.Findings", "array<variant>"))
    no = F.array().cast("array<string>")
    listed = F.coalesce(F.flatten(F.transform(items, lambda x, k: _finding_errors(x, F.concat(F.lit("findings["), k.cast("string"), F.lit("]."))))), no)
    if kind == "finding":
        found = _finding_errors(v, F.lit(""))
    elif kind == "response":
        found = F.when(~has("findings"), F.array(F.lit("AgentResponse must have a 'findings' array"))).when(items.isNull(), F.array(F.lit("'findings' must be an array"))).otherwise(listed)
    else:
        found = F.concat(F.array_compact(F.array(*(F.when(~has(f), f"Report must have '{f}' field") for f in REPORT_FIELDS))), listed)
    return replies.select("reply_id", F.when(v.isNull(), F.array(F.lit("Invalid JSON"))).otherwise(found).alias("errors"))


def parse_summary(reply: Column) -> Column:
    """Summary and up to ten distinct recommendations of a reply; the reply itself if it is no JSON."""
    v = F.try_parse_json(F.coalesce(extract_json(reply), F.lit("")))
    text = F.coalesce(*(F.try_variant_get(v, f"$.{k}", "string") for k in ("summary", "summaryText", "narrative")))
    advice = F.slice(F.array_distinct(F.coalesce(F.try_variant_get(v, "$.recommendations", "array<string>"), F.array().cast("array<string>"))), 1, 10)
    return F.struct(F.when(v.isNull(), reply).otherwise(F.coalesce(text, F.lit(""))).alias("summary"), F.when(v.isNull(), F.array().cast("array<string>")).otherwise(advice).alias("recommendations"))

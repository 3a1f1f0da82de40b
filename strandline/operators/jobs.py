"""Operators over jobs, quotas and projects: checks, housekeeping, progress, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.rules import GAUGES, PRICES, REPOSITORY_HOSTS


def repo_url_allowed(url: Column, hosts: Sequence[str] = REPOSITORY_HOSTS) -> Column:
    """An absolute https URL whose host is one of these, or below one of them. A host that merely ends alike is refused."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    known = "|".join(h.replace(".", r"\.") for h in hosts)
    return F.coalesce(F.lower(url).startswith("https://") & host.rlike(rf"(^|\.)({known})$"), F.lit(False))


def project_name_valid(name: Column) -> Column:
    return (F.length(name) <= 200) & name.rlike(r"^[\w\s.-]+$")


def quota_checks(quotas: DataFrame) -> DataFrame:
    """quotas (org_id, credits, credits_used, tokens, tokens_used, storage, storage_used, running, most_running, suspended) with
    whether a job may start and whether credits, tokens and storage are left."""
    left = lambda what: F.col(f"{what}_used") < F.col(what)
    start = ~F.col("suspended") & (F.col("running") < F.col("most_running")) & left("credits")
    return quotas.select("org_id", start.alias("can_start"), left("credits").alias("enough_credits"), left("tokens").alias("enough_tokens"), left("storage").alias("enough_storage"))


def housekeeping(rows: DataFrame, as_of: Column, most_retries: int = 3, keep_days: int = 30) -> DataFrame:
    """(kind, id, due) of what is due at a time: rows have kind (job, session, period, checkpoint), id, status, retries and ts.

    Failed jobs with retries left; sessions that expired; periods that ended; finished checkpoints older than the cutoff."""
    kind, status, ts = F.col("kind"), F.col("status"), F.col("ts")
    due = (
        F.when((kind == "job") & (status == "pending_retry") & (F.col("retries") < most_retries), "retry")
        .when((kind == "session") & (status == "open") & (ts < as_of), "expire")
        .when((kind == "period") & (ts <= as_of), "reset")
        .when((kind == "checkpoint") & status.isin("completed", "failed") & (ts < as_of - F.make_interval(days=F.lit(keep_days))), "delete")
    )
    return rows.select("kind", "id", due.alias("due")).where(F.col("due").isNotNull())


#: Moves of a job's status that are not allowed: from, to.
FORBIDDEN = (("analyzing", "queued"), ("created", "created"), ("completed", "created"), ("failed", "created"))


def bad_transitions(log: DataFrame, forbidden: Sequence[tuple[str, str]] = FORBIDDEN) -> DataFrame:
    """(project_id, event_id, before, status) of the moves in a status log (project_id, event_id, ts, status) that are not allowed:
    into the queue while analysing, and a reset other than from analysing or the queue."""
    before = F.lag("status").over(Window.partitionBy("project_id").orderBy("ts", "event_id"))
    bad = F.lit(False)
    for old, new in forbidden:
        bad |= (F.col("before") == old) & (F.col("status") == new)
    return log.withColumn("before", before).where(bad).select("project_id", "event_id", "before", "status")


def reset_faults(log: DataFrame) -> DataFrame:
    """(project_id, event_id, fault) of the resets in a status log with started_at, ended_at and error: a reset is a move from
    analyzing or queued back to created, and leaves none of these; its first field that is left is the fault."""
    before = F.lag("status").over(Window.partitionBy("project_id").orderBy("ts", "event_id"))
    fault = F.when(F.col("started_at").isNotNull(), "started_at").when(F.col("ended_at").isNotNull(), "ended_at").when(F.col("error").isNotNull(), "error")
    reset = (F.col("status") == "created") & F.col("before").isin("analyzing", "queued")
    return log.withColumn("before", before).where(reset).select("project_id", "event_id", fault.alias("fault")).where("fault is not null")


def progress(rows: DataFrame) -> DataFrame:
    """rows (.., phase, done, total) with percent: indexing runs from 5 to 20, retrieval from 5 to 35, analysis from 40 to 80."""
    share = F.coalesce(F.try_divide(F.col("done").cast("double"), F.col("total")), F.lit(0.0))
    percent = F.when(F.col("phase") == "indexing", 5 + 15 * share).when(F.col("phase") == "retrieval", 5 + 30 * share).when(F.col("phase") == "analysis", 40 + 40 * share)
    return rows.withColumn("percent", percent)


def remaining(rows: DataFrame) -> DataFrame:
    """rows (.., done, total, elapsed) with percent and the seconds left at the pace so far; null where nothing is done."""
    percent = F.try_divide(100.0 * F.col("done"), F.col("total"))
    left = F.try_divide(F.col("elapsed") * (F.col("total") - F.col("done")), F.col("done"))
    return rows.withColumn("percent", percent).withColumn("seconds_left", left)


def page(rows: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20, most: int = 100) -> DataFrame:
    """A page of rows with total, pages, has_next and has_previous. The page starts at 1, its size is at most `most`."""
    number, size = max(1, number), min(max(1, size), most)
    total = rows.agg(F.count("*").alias("total"))  # one row
    shown = rows.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))
    pages = F.ceil(F.col("total") / size)
    return shown.withColumns({"pages": pages, "has_next": pages > number, "has_previous": F.lit(number > 1)})


def price(model: Column, prices: dict[str, str] = PRICES) -> Column:
    """Dollars for a million tokens, as decimals; unknown models are free."""
    out = None
    for name, value in prices.items():
        known = F.lit(value).cast("decimal(8,2)")
        out = F.when(model == name, known) if out is None else out.when(model == name, known)
    return out.otherwise(F.lit("0").cast("decimal(8,2)"))


def telemetry(usage: DataFrame) -> DataFrame:
    """usage (org_id, model, tokens) by organisation: tokens, calls, embedding calls, calls by model and the exact cost."""
    by = usage.groupBy("org_id", "model").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls"))
    cost = F.round(F.sum(F.col("tokens").cast("decimal(20,0)") * price(F.col("model"))) / 1_000_000, 4).cast("double")
    models = F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "calls"))))
    embedding = F.sum(F.when(F.col("model").contains("embedding"), F.col("calls")).otherwise(0))
    return by.groupBy("org_id").agg(F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls"), embedding.alias("embedding_calls"), models.alias("calls_by_model"), cost.alias("cost"))


def retrieval_telemetry(calls: DataFrame, model: str = "text-embedding-3-small", mode: str = "exact") -> DataFrame:
    """Telemetry of each project: calls (project_id, kind, model, input_tokens, output_tokens, chunks, ms, summarized) of kind model,
    embedding or retrieval; models' calls, tokens, retrievals with their chunks, time and summaries, and the cost.

    mode exact: each model's own tokens at its price. mode reference: as the published summary does it, each model's calls times the
    whole tokens of an average call, counted over all models; the price of the embedding model is that of all embeddings."""
    if mode not in ("exact", "reference"):
        raise ValueError("mode is exact or reference")
    n = lambda kind, c=None: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.lit(1) if c is None else F.col(c))), F.lit(0)).cast("long")
    by = calls.groupBy("project_id", "kind", "model").agg(F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("chunks").alias("chunks"), F.sum("ms").alias("ms"), F.count_if("summarized").alias("summaries"))
    own = by.withColumns({"model_calls": F.sum(F.when(F.col("kind") == "model", F.col("calls"))).over(Window.partitionBy("project_id")), "model_tokens": F.sum(F.when(F.col("kind") == "model", F.col("tokens"))).over(Window.partitionBy("project_id"))})
    counted = F.col("tokens") if mode == "exact" else F.floor(F.col("model_tokens") / F.greatest(F.lit(1), F.col("model_calls"))) * F.col("calls")
    spent = F.when(F.col("kind") == "model", counted.cast("decimal(20,0)") * price(F.col("model"))).when(F.col("kind") == "embedding", F.col("tokens").cast("decimal(20,0)") * price(F.lit(model)))
    cost = F.round(F.coalesce(F.sum(spent), F.lit(0).cast("decimal(20,2)")) / 1_000_000, 6).cast("double")
    return own.groupBy("project_id").agg(n("model", "calls").alias("model_calls"), n("model", "tokens").alias("tokens"), n("embedding", "calls").alias("embedding_calls"), n("embedding", "tokens").alias("embedding_tokens"), n("retrieval", "calls").alias("retrievals"), n("retrieval", "chunks").alias("chunks"), n("retrieval", "ms").alias("retrieval_ms"), n("retrieval", "summaries").alias("summaries"), cost.alias("cost"))


def health_snapshot(finished: DataFrame, running: DataFrame, gauges: DataFrame, usage: DataFrame, as_of: Column, most_failures: int = 5) -> DataFrame:
    """One row: the state of the system at a time, by the hour before it and the last value of each gauge.

    finished: (ts, success, seconds) of jobs that ended; running: (started_at, ended_at, null while it runs); gauges: (ts, number,
    name, value); usage: (ts, tokens). Each part is one aggregate without a key, combined before it meets."""
    hour = (F.col("ts") >= as_of - F.expr("interval 1 hour")) & (F.col("ts") <= as_of)
    jobs = finished.where(hour).agg(F.coalesce(F.round(F.avg("seconds"), 5), F.lit(0.0)).alias("avg_seconds"), F.count_if(~F.col("success")).alias("failures"))
    active = running.agg(F.count_if((F.col("started_at") <= as_of) & (F.col("ended_at").isNull() | (F.col("ended_at") > as_of))).alias("active"))
    tokens = usage.where(hour).agg(F.coalesce(F.sum("tokens"), F.lit(0).cast("long")).alias("tokens"))
    last = [F.coalesce(F.max_by(F.when(F.col("name") == g, F.col("value")), F.when(F.col("name") == g, F.struct("ts", "number"))), F.lit(0.0)).alias(g.replace(".", "_")) for g in GAUGES]
    shown = gauges.where(F.col("ts") <= as_of).agg(*last)
    row = jobs.crossJoin(active).crossJoin(tokens).crossJoin(shown)  # one row each
    dead = F.floor("queue_dead_letter_length").cast("long")
    alerts = F.array_compact(F.array(F.when(dead > 0, F.concat(F.lit("Dead letter queue has "), dead.cast("string"), F.lit(" messages"))), F.when(F.col("failures") > most_failures, F.concat(F.col("failures").cast("string"), F.lit(" jobs failed in the last hour")))))
    return row.select(F.floor("queue_length").cast("long").alias("queue_length"), dead.alias("dead_letters"), "active", "avg_seconds", "failures", "tokens", F.floor("memory_peak_bytes").cast("long").alias("peak_bytes"), F.round(100 - F.col("disk_used_percent"), 5).alias("disk_free"), (F.size(alerts) == 0).alias("healthy"), alerts.alias("alerts"))

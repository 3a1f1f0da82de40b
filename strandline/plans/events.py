"""Queries over job events, usage, projects and pages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.rules import GAUGES, PRICES
from strandline.operators import jobs as ops
from strandline.plans.registry import query
from strandline.sources import views
from strandline.streaming import jobs, stateful, upsert

_AS_OF = "timestamp '2024-01-20 00:00:00'"


_PRICE = "case model " + " ".join(f"when '{k}' then {v}" for k, v in PRICES.items()) + " else 0 end"


@query("s17_event_source", "select kind, count(*) as n from job_events group by 1", "job_events")
def event_source(spark, sf_dir):
    """The events read as a stream of files."""
    kinds = jobs.arriving(spark, sf_dir).select(F.expr("case event_type when 'signup' then 'started' when 'purchase' then 'completed' when 'error' then 'failed' when 'view' then 'progress' else 'heartbeat' end").alias("kind"))
    return jobs.settled(kinds.groupBy("kind").agg(F.count("*").alias("n")), ["kind"])


_URL = "case page_id % 6 when 0 then 'https://github.com/a/b' when 1 then 'http://github.com/a' when 2 then 'https://evilgithub.com/a' when 3 then 'https://ssh.dev.azure.com/x' when 4 then 'git@gitlab.com:a' else url end"


@query("f19_repo_url_allowed", f"select page_id, starts_with(lower(u), 'https://') and regexp_matches(lower(u), '^https://([^/?#@]*@)?([^/?#:]*\\.)?(github\\.com|gitlab\\.com|bitbucket\\.org|dev\\.azure\\.com)([/?#:]|$)') as allowed from (select page_id, {_URL} as u from pages)")
def repo_url_allowed(spark, sf_dir):
    """Page addresses, most of them replaced by ones that the rule must tell apart."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", ops.repo_url_allowed(F.expr(_URL)).alias("allowed"))


@query("f20_project_name_valid", "select project_id, length(name) <= 200 and regexp_matches(name, '^[\\w\\s.-]+$') as valid from (select project_id, case project_id % 5 when 0 then name || '!' when 1 then repeat(name, 40) else name end as name from projects)", "projects")
def project_name_valid(spark, sf_dir):
    name = F.expr("case project_id % 5 when 0 then concat(name, '!') when 1 then repeat(name, 40) else name end")
    return views.projects(spark, sf_dir).select("project_id", ops.project_name_valid(name).alias("valid"))


_QUOTAS = "select org_id, 50 as credits, {cost} as credits_used, 10000000 as tokens, sum(tokens) as tokens_used, 2000 as storage, count(*) as storage_used, count(*) % 4 as running, 3 as most_running, org_id = 'org3' as suspended from token_events group by org_id"


@query("f22_quota_checks", f"with u as ({_QUOTAS.format(cost=f'sum(tokens * ({_PRICE})) / 1000000')}) select org_id, not suspended and running < most_running and credits_used < credits as can_start, credits_used < credits as enough_credits, tokens_used < tokens as enough_tokens, storage_used < storage as enough_storage from u", "token_events")
def quota_checks(spark, sf_dir):
    cost = F.sum(F.col("tokens").cast("decimal(20,0)") * ops.price(F.col("model"))) / 1_000_000
    n = F.count("*")
    u = views.token_events(spark, sf_dir).groupBy("org_id").agg(F.lit(50).alias("credits"), cost.alias("credits_used"), F.sum("tokens").alias("tokens_used"), n.alias("storage_used"), (n % 4).alias("running"))
    return ops.quota_checks(u.withColumns({"tokens": F.lit(10_000_000), "storage": F.lit(2000), "most_running": F.lit(3), "suspended": F.col("org_id") == "org3"}))


_KEPT = "select case event_id % 4 when 0 then 'job' when 1 then 'session' when 2 then 'period' else 'checkpoint' end as kind, event_id as id, case kind when 'failed' then case when event_id % 8 < 4 then 'failed' else 'pending_retry' end when 'heartbeat' then 'open' else kind end as status, cast(event_id % 6 as int) as retries, ts from job_events"


@query("f23_job_housekeeping", f"select kind, id, due from (select kind, id, case when kind = 'job' and status = 'pending_retry' and retries < 3 then 'retry' when kind = 'session' and status = 'open' and ts < {_AS_OF} then 'expire' when kind = 'period' and ts <= {_AS_OF} then 'reset' when kind = 'checkpoint' and status in ('completed', 'failed') and ts < {_AS_OF} - interval 14 days then 'delete' end as due from ({_KEPT}) t(kind, id, status, retries, ts)) where due is not null", "job_events")
def job_housekeeping(spark, sf_dir):
    n, kind = F.col("event_id"), F.col("kind")
    status = F.when(kind == "failed", F.when(n % 8 < 4, "failed").otherwise("pending_retry")).when(kind == "heartbeat", "open").otherwise(kind)
    sort = F.when(n % 4 == 0, "job").when(n % 4 == 1, "session").when(n % 4 == 2, "period").otherwise("checkpoint")
    rows = views.job_events(spark, sf_dir).select(sort.alias("kind"), n.alias("id"), status.alias("status"), (n % 6).cast("int").alias("retries"), "ts")
    return ops.housekeeping(rows, F.expr(_AS_OF), 3, 14)


_STATUS = "case kind when 'started' then 'queued' when 'progress' then 'analyzing' when 'heartbeat' then 'created' else kind end"


@query("f25_status_transition_check", f"with l as (select project_id, event_id, {_STATUS} as status, lag({_STATUS}) over (partition by project_id order by ts, event_id) as before from job_events) select project_id, event_id, before, status from l where (before, status) in (('analyzing', 'queued'), ('created', 'created'), ('completed', 'created'), ('failed', 'created'))", "job_events")
def status_transition_check(spark, sf_dir):
    return ops.bad_transitions(views.job_events(spark, sf_dir).withColumn("status", F.expr(_STATUS)))


@query("f25_reset_faults", f"with l as (select project_id, event_id, {_STATUS} as status, lag({_STATUS}) over (partition by project_id order by ts, event_id) as before from job_events) select project_id, event_id, case when event_id % 3 = 0 then 'started_at' when event_id % 5 = 0 then 'ended_at' else 'error' end as fault from l where status = 'created' and before in ('analyzing', 'queued') and (event_id % 3 = 0 or event_id % 5 = 0 or event_id % 7 = 0)", "job_events")
def reset_faults(spark, sf_dir):
    n = F.col("event_id")
    log = views.job_events(spark, sf_dir).withColumns({"status": F.expr(_STATUS), "started_at": F.when(n % 3 == 0, F.col("ts")), "ended_at": F.when(n % 5 == 0, F.col("ts")), "error": F.when(n % 7 == 0, "failed")})
    return ops.reset_faults(log)


def _telemetry_sql(mode: str) -> str:
    counted = "tokens" if mode == "exact" else "(model_tokens // greatest(1, model_calls)) * calls"
    n = lambda kind, c: f"coalesce(sum({c}) filter (where kind = '{kind}'), 0)::bigint"
    return f"with c as (select 'p' || (event_id % 50) as project_id, (['model', 'embedding', 'retrieval'])[event_id % 3 + 1] as kind, model, tokens, event_id % 20 as chunks, tokens % 300 as ms, event_id % 6 = 2 as summarized from token_events), b as (select project_id, kind, model, count(*) as calls, sum(tokens)::bigint as tokens, sum(chunks)::bigint as chunks, sum(ms)::bigint as ms, count(*) filter (where summarized) as summaries from c group by 1, 2, 3), o as (select *, (sum(calls) filter (where kind = 'model') over (partition by project_id))::bigint as model_calls, (sum(tokens) filter (where kind = 'model') over (partition by project_id))::bigint as model_tokens from b) select project_id, {n('model', 'calls')} as model_calls, {n('model', 'tokens')} as tokens, {n('embedding', 'calls')} as embedding_calls, {n('embedding', 'tokens')} as embedding_tokens, {n('retrieval', 'calls')} as retrievals, {n('retrieval', 'chunks')} as chunks, {n('retrieval', 'ms')} as retrieval_ms, {n('retrieval', 'summaries')} as summaries, round(sum(case kind when 'model' then ({counted})::decimal(20,0) * ({_PRICE})::decimal(8,2) when 'embedding' then tokens::decimal(20,0) * {PRICES['text-embedding-3-small']}::decimal(8,2) else 0 end) / 1000000, 6)::double as cost from o group by 1"


def _telemetry(spark, sf_dir, mode):
    n = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("model", "embedding", "retrieval"))), (n % 3 + 1).cast("int"))
    calls = views.token_events(spark, sf_dir).select(F.concat(F.lit("p"), (n % 50).cast("string")).alias("project_id"), kind.alias("kind"), "model", F.col("tokens").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"), (n % 20).alias("chunks"), (F.col("tokens") % 300).alias("ms"), (n % 6 == 2).alias("summarized"))
    return ops.retrieval_telemetry(calls, mode=mode)


@query("a18_retrieval_telemetry", _telemetry_sql("exact"), "token_events")
def retrieval_telemetry(spark, sf_dir):
    return _telemetry(spark, sf_dir, "exact")


@query("a18_telemetry_reference", _telemetry_sql("reference"), "token_events")
def telemetry_reference(spark, sf_dir):
    return _telemetry(spark, sf_dir, "reference")


@query("j1_project_report", "select p.project_id, c.c_name as owner, p.status from projects p left join customer c on c.c_custkey = p.api_key_id and c.c_acctbal > 5000", "projects")
def project_report(spark, sf_dir):
    owners = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 5000").select(F.col("c_custkey").alias("api_key_id"), F.col("c_name").alias("owner"))
    return views.projects(spark, sf_dir).join(owners, "api_key_id", "left").select("project_id", "owner", "status")


@query("j9_missing_parts", "with n as (select l_orderkey, max(l_linenumber) as parts from lineitem group by 1), a as (select l_orderkey, unnest(range(1, parts + 2)) as part from n) select a.l_orderkey as session_id, a.part::int as part from a where not exists (select 1 from lineitem l where l.l_orderkey = a.l_orderkey and l.l_linenumber = a.part)")
def missing_parts(spark, sf_dir):
    """Part numbers up to one more than the highest that no row of the session has."""
    got = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").cast("int").alias("part"))
    wanted = got.groupBy("session_id").agg(F.max("part").alias("n")).select("session_id", F.explode(F.sequence(F.lit(1), F.col("n") + 1)).alias("part"))
    return wanted.join(got, ["session_id", "part"], "left_anti")


@query("a18_a19_telemetry_cost", f"with m as (select org_id, model, sum(tokens) as tokens, count(*) as calls, sum(tokens) * ({_PRICE}) as cost from token_events group by 1, 2) select org_id, sum(tokens)::bigint as tokens, sum(calls)::bigint as calls, sum(case when contains(model, 'embedding') then calls else 0 end)::bigint as embedding_calls, string_agg(model || '=' || calls, ' ' order by model) as calls_by_model, round(sum(cost) / 1000000, 4)::double as cost from m group by 1", "token_events")
def telemetry_cost(spark, sf_dir):
    t = ops.telemetry(views.token_events(spark, sf_dir))
    return t.withColumn("calls_by_model", F.array_join(F.transform(F.map_entries("calls_by_model"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), " "))


@query("a20_over_budget", f"with c as (select org_id, sum(tokens * ({_PRICE})) / 1000000 as cost from token_events group by 1) select org_id from c where cost > 20", "token_events")
def over_budget(spark, sf_dir):
    cost = F.sum(F.col("tokens").cast("decimal(20,0)") * ops.price(F.col("model"))) / 1_000_000
    return views.token_events(spark, sf_dir).groupBy("org_id").agg(cost.alias("cost")).where("cost > 20").select("org_id")


@query("a22_health_snapshot", f"select count(*) filter (where kind = 'failed') as failed, round(avg(value), 5) as avg_value, arg_max(value, (ts, event_id)) as last_value, count(*) filter (where kind = 'failed') > 5 as alert from job_events where ts >= {_AS_OF} - interval 1 hour and ts < {_AS_OF}", "job_events")
def health_snapshot(spark, sf_dir):
    now = F.expr(_AS_OF)
    rows = views.job_events(spark, sf_dir).where((F.col("ts") >= now - F.expr("interval 1 hour")) & (F.col("ts") < now))
    failed = F.count_if(F.col("kind") == "failed")
    return rows.agg(failed.alias("failed"), F.round(F.avg("value"), 5).alias("avg_value"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"), (failed > 5).alias("alert"))


_GAUGE = "(['queue.length', 'queue.dead_letter_length', 'memory.peak_bytes', 'disk.used_percent'])[event_id % 4 + 1]"
_LAST = "coalesce(arg_max(value, (ts, event_id)) filter (where name = '{}'), 0)"


@query("a22_health_report", f"""with j as (select coalesce(round(avg(value), 5), 0) as avg_seconds, count(*) filter (where kind = 'failed') as failures from job_events where kind in ('completed', 'failed') and ts >= {_AS_OF} - interval 1 hour and ts <= {_AS_OF}),
r as (select count(*) filter (where ts <= {_AS_OF} and ts + value * interval 1 minute > {_AS_OF}) as active from job_events where kind = 'started'),
t as (select coalesce(sum(tokens), 0)::bigint as tokens from token_events where ts >= {_AS_OF} - interval 1 hour and ts <= {_AS_OF}),
g as (select floor({_LAST.format('queue.length')})::bigint as queue_length, floor({_LAST.format('queue.dead_letter_length')})::bigint as dead_letters, floor({_LAST.format('memory.peak_bytes')})::bigint as peak_bytes, round(100 - {_LAST.format('disk.used_percent')}, 5) as disk_free from (select ts, event_id, value, {_GAUGE} as name from job_events where kind = 'progress') where ts <= {_AS_OF})
select queue_length, dead_letters, active, avg_seconds, failures, tokens, peak_bytes, disk_free, dead_letters = 0 and failures <= 5 as healthy, array_to_string(list_filter([case when dead_letters > 0 then 'Dead letter queue has ' || dead_letters || ' messages' end, case when failures > 5 then failures || ' jobs failed in the last hour' end], lambda x: x is not null), '; ') as alerts from j, r, t, g""", "job_events", "token_events")
def health_report(spark, sf_dir):
    """The health snapshot with gauges by name, dead letters, active jobs and tokens."""
    events = views.job_events(spark, sf_dir)
    name = F.element_at(F.array(*map(F.lit, GAUGES)), (F.col("event_id") % 4 + 1).cast("int"))
    finished = events.where("kind in ('completed', 'failed')").select("ts", (F.col("kind") == "completed").alias("success"), F.col("value").alias("seconds"))
    end = F.timestamp_micros(F.unix_micros("ts") + (F.col("value") * 60_000_000).cast("long"))
    running = events.where("kind = 'started'").select(F.col("ts").alias("started_at"), end.alias("ended_at"))
    gauges = events.where("kind = 'progress'").select("ts", F.col("event_id").alias("number"), name.alias("name"), "value")
    row = ops.health_snapshot(finished, running, gauges, views.token_events(spark, sf_dir).select("ts", "tokens"), F.expr(_AS_OF))
    return row.withColumn("alerts", F.array_join("alerts", "; "))


@query("a23_dashboard_metrics", "select count(*) as total, count(*) filter (where status = 5) as completed, round(avg(health_score))::int as avg_health, count(*) filter (where created_at >= timestamp '1997-01-01') as recent from projects", "projects")
def dashboard_metrics(spark, sf_dir):
    return views.projects(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("status") == 5).alias("completed"), F.round(F.avg("health_score")).cast("int").alias("avg_health"), F.count_if(F.col("created_at") >= F.expr("timestamp '1997-01-01'")).alias("recent"))


@query("a24_projects_per_day", "with d as (select unnest(generate_series(date '1996-01-01', date '1996-03-01', interval 1 day))::date as day) select d.day::varchar as day, count(p.project_id) as projects from d left join projects p on p.created_at::date = d.day group by 1", "projects")
def projects_per_day(spark, sf_dir):
    days = spark.sql("select explode(sequence(date '1996-01-01', date '1996-03-01')) as day")
    n = views.projects(spark, sf_dir).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    return days.join(n, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("projects"))


@query("a25_api_log_stats", "select client_id, round(avg(duration_ms), 5) as avg_ms, count(*) as requests, round(100.0 * count(*) filter (where status >= 500) / count(*), 5)::double as error_percent, count(*) filter (where ts >= timestamp '2024-01-20 00:00:00' - interval 1 minute and ts < timestamp '2024-01-20 00:00:00') as last_minute from api_log group by 1", "api_log")
def api_log_stats(spark, sf_dir):
    return views.api_log(spark, sf_dir).groupBy("client_id").agg(F.round(F.avg("duration_ms"), 5).alias("avg_ms"), F.count("*").alias("requests"), F.round(100.0 * F.count_if(F.col("status") >= 500) / F.count("*"), 5).alias("error_percent"), F.count_if((F.col("ts") >= F.expr(_AS_OF) - F.expr("interval 1 minute")) & (F.col("ts") < F.expr(_AS_OF))).alias("last_minute"))


@query("a35_upload_progress", "with u as (select distinct l_orderkey, l_linenumber, l_quantity from lineitem) select l_orderkey as session_id, count(distinct l_linenumber) as parts, 2 + l_orderkey % 5 as total_parts, sum(l_quantity)::bigint as bytes, count(distinct l_linenumber) >= 2 + l_orderkey % 5 as complete from u group by l_orderkey")
def upload_progress(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("session_id"), "l_linenumber", "l_quantity").dropDuplicates()
    total = 2 + F.col("session_id") % 5
    g = parts.groupBy("session_id").agg(F.count_distinct("l_linenumber").alias("parts"), F.sum("l_quantity").cast("bigint").alias("bytes"))
    return g.select("session_id", "parts", total.alias("total_parts"), "bytes", (F.col("parts") >= total).alias("complete"))


@query("a36_checkpoint_progress", "select project_id, total, done, round(100.0 * done / total, 5)::double as percent, round(case when done > 0 then elapsed * (total - done) / done end, 5)::double as seconds_left from (select project_id, count(*) as total, count(*) filter (where kind = 'completed') as done, (epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))))::bigint as elapsed from job_events group by 1)", "job_events")
def checkpoint_progress(spark, sf_dir):
    seconds = F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))
    g = views.job_events(spark, sf_dir).groupBy("project_id").agg(F.count("*").alias("total"), F.count_if(F.col("kind") == "completed").alias("done"), seconds.alias("elapsed"))
    return ops.remaining(g).select("project_id", "total", "done", F.round("percent", 5).alias("percent"), F.round("seconds_left", 5).alias("seconds_left"))


@query("w2_latest_checkpoint", "select project_id, event_id from (select project_id, event_id, row_number() over (partition by project_id order by ts desc, event_id desc) as r from job_events) where r = 1", "job_events")
def latest_checkpoint(spark, sf_dir):
    w = Window.partitionBy("project_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return views.job_events(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r = 1").select("project_id", "event_id")


@query("w9_progress_delta", "with p as (select project_id, event_id, ts, case event_id % 3 when 0 then 5 + 15 * (event_id % 10) / 10.0::double when 1 then 5 + 30 * (event_id % 10) / 10.0::double else 40 + 40 * (event_id % 10) / 10.0::double end as percent from job_events where kind = 'progress') select event_id, round(percent, 6) as percent, round(percent - lag(percent) over (partition by project_id order by ts, event_id), 6) as delta from p", "job_events")
def progress_delta(spark, sf_dir):
    w = Window.partitionBy("project_id").orderBy("ts", "event_id")
    phase = F.element_at(F.array(*map(F.lit, ("indexing", "retrieval", "analysis"))), (F.col("event_id") % 3).cast("int") + 1)
    p = ops.progress(views.job_events(spark, sf_dir).where("kind = 'progress'").withColumns({"phase": phase, "done": F.col("event_id") % 10, "total": F.lit(10)}))
    return p.select("event_id", F.round("percent", 6).alias("percent"), F.round(F.col("percent") - F.lag("percent").over(w), 6).alias("delta"))


@query("w10_last_n_samples", "select kind, event_id from (select kind, event_id, row_number() over (partition by kind order by ts desc, event_id desc) as r from job_events) where r <= 1000", "job_events")
def last_n_samples(spark, sf_dir):
    w = Window.partitionBy("kind").orderBy(F.desc("ts"), F.desc("event_id"))
    return views.job_events(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 1000").select("kind", "event_id")


@query("k1_page", "select project_id, name, total, ceil(total / 20.0)::bigint as pages, ceil(total / 20.0) > 2 as has_next, true as has_previous from (select project_id, name, created_at, count(*) over () as total from projects where status = 5) order by created_at desc, project_id limit 20 offset 20", "projects")
def page(spark, sf_dir):
    rows = views.projects(spark, sf_dir).where("status = 5")
    return ops.page(rows, [F.desc("created_at"), F.col("project_id")], 2).select("project_id", "name", "total", "pages", "has_next", "has_previous")


@query("k6_queue_order", f"select event_id, row_number() over (partition by project_id order by value desc, ts, event_id) as place from job_events where kind = 'started' and ts <= {_AS_OF}", "job_events")
def queue_order(spark, sf_dir):
    w = Window.partitionBy("project_id").orderBy(F.desc("value"), "ts", "event_id")
    return views.job_events(spark, sf_dir).where((F.col("kind") == "started") & (F.col("ts") <= F.expr(_AS_OF))).select("event_id", F.row_number().over(w).alias("place"))


@query("t1_t10_progress_latest", "select project_id, max(ts) as ts, arg_max(kind, (ts, event_id)) as kind, arg_max(value, (ts, event_id)) as value, arg_max(event_id, (ts, event_id)) as event_id from job_events group by 1", "job_events")
def progress_latest(spark, sf_dir):
    return jobs.settled(jobs.progress_latest(views.job_events(spark, sf_dir, jobs.arriving)), ["project_id"])


@query("t2_finding_stream", "select severity, count(*) as findings from findings group by 1", "findings")
def finding_stream(spark, sf_dir):
    return jobs.settled(jobs.new_findings(views.findings(spark, sf_dir, jobs.arriving)), ["severity"])


@query("t3_stuck_jobs", "with g as (select project_id, event_id, epoch(date_trunc('second', lead(ts) over (partition by project_id order by ts, event_id)))::bigint - epoch(date_trunc('second', ts))::bigint as gap from job_events where kind = 'heartbeat') select project_id, event_id, gap, gap // 21600 as strikes from g where gap > 21600", "job_events")
def stuck_jobs(spark, sf_dir):
    return jobs.silences(views.job_events(spark, sf_dir), 21_600)


_HEARD = "case when kind in ('heartbeat', 'progress') then e.us else w.heard end"


def _stuck_sql(longest: int, silent: int, check: int, strikes: int) -> str:
    """A step of the recursion for each event of a project: the job as the event leaves it, and the checks before the next one."""
    c, most = check * 1_000_000, strikes
    first = f"((greatest(least(started + {longest * 1_000_000}, heard + {silent * 1_000_000}) + 1, us) + {c - 1}) // {c} * {c})"
    hits = f"case when started is null then 0 else greatest(0, least({most} - struck, (until - {first} + {c - 1}) // {c})) end"
    after = "case when kind = 'started' then {0} when kind in ('completed', 'failed') then null when w.struck + w.n >= " + str(most) + " then null else {1} end"
    step = (
        f"select e.project_id, e.r, e.us, e.until, {after.format('e.us', 'w.started')} as started, {after.format('e.us', _HEARD)} as heard, "
        "case when kind in ('started', 'heartbeat') then 0 else w.struck + w.n end as struck from w join e on e.project_id = w.project_id and e.r = w.r + 1"
    )
    return f"""with recursive h as (select (epoch_ms(max(ts)) - 10000) * 1000 as h from job_events),
e as (select project_id, kind, epoch_us(ts) as us, row_number() over o as r, coalesce(lead(epoch_us(ts)) over o, h) as until from job_events, h where epoch_us(ts) < h window o as (partition by project_id order by ts, event_id)),
w as (select project_id, 0::bigint as r, 0::bigint as us, 0::bigint as until, null::bigint as started, null::bigint as heard, 0::bigint as struck, 0::bigint as n from (select distinct project_id from e)
union all select *, {hits} as n from ({step})),
k as (select project_id, {first} + i * {c} as tick, started, (struck + i + 1)::int as strikes from (select *, unnest(range(0, n)) as i from w where n > 0))
select project_id, make_timestamp(tick) as checked_at, case when tick - started > {longest * 1_000_000} then 'duration' else 'silence' end as reason, strikes, strikes >= {most} as cancelled from k"""


@query("t3_stuck_job_stream", _stuck_sql(172_800, 43_200, 3_600, 3), "job_events")
def stuck_job_stream(spark, sf_dir):
    """The watchdog's strikes, by the stream with timers: jobs of more than two days, or silent for half a day, checked each hour."""
    events = views.job_events(spark, sf_dir, jobs.arriving)
    return jobs.settled(stateful.stuck_jobs(events, 172_800, 43_200, 3_600, 3), mode="append", stateful=True)


@query("t4_heartbeat_sessions", "with b as (select project_id, ts, case when ts - lag(ts) over (partition by project_id order by ts, event_id) < interval 6 hours then 0 else 1 end as new, event_id from job_events where kind = 'heartbeat'), s as (select *, sum(new) over (partition by project_id order by ts, event_id) as n from b) select project_id, min(ts) as start, max(ts) + interval 6 hours as \"end\", count(*) as beats from s group by project_id, n", "job_events")
def heartbeat_sessions(spark, sf_dir):
    return jobs.settled(jobs.heartbeat_sessions(views.job_events(spark, sf_dir, jobs.arriving), "6 hours"), mode="complete")


@query("t5_rate_limit_sliding", "with w as (select client_id, time_bucket(interval 10 minutes, ts) - k * interval 10 minutes as start from api_log, range(0, 6) r(k)) select client_id, start, count(*) as requests from w group by 1, 2 having count(*) > 2", "api_log")
def rate_limit_sliding(spark, sf_dir):
    return jobs.settled(jobs.over_rate(views.api_log(spark, sf_dir, jobs.arriving), 2, "1 hour", "10 minutes"), ["client_id", "start"])


@query("t6_rate_limit_fixed", "select client_id, date_trunc('hour', ts) as start, count(*) as requests from api_log group by 1, 2 having count(*) > 1", "api_log")
def rate_limit_fixed(spark, sf_dir):
    return jobs.settled(jobs.over_rate(views.api_log(spark, sf_dir, jobs.arriving), 1, "1 hour", None), ["client_id", "start"])


@query("t7_token_budget", "select model, date_trunc('hour', ts) as start, sum(tokens)::bigint as tokens, sum(tokens) > 20000 as over from token_events group by 1, 2", "token_events")
def token_budget(spark, sf_dir):
    return jobs.settled(jobs.token_budget(views.token_events(spark, sf_dir, jobs.arriving), 20_000, "1 hour"), ["model", "start"])


@query("t8_metrics_stream", "select kind, date_trunc('hour', ts) as start, count(*) as n, round(sum(value), 4) as total, arg_max(value, (ts, event_id)) as last, quantile_disc(value, 0.95) as p95 from job_events group by 1, 2", "job_events")
def metrics_stream(spark, sf_dir):
    return jobs.settled(jobs.metrics(views.job_events(spark, sf_dir, jobs.arriving)), ["kind", "start"]).withColumn("total", F.round("total", 4))


@query("t9_j12_job_durations", "with a as (select * from job_events where kind = 'started'), b as (select * from job_events where kind in ('completed', 'failed')) select a.event_id as start_id, b.event_id as end_id, b.kind as outcome, epoch(date_trunc('second', b.ts))::bigint - epoch(date_trunc('second', a.ts))::bigint as seconds from a left join b on b.project_id = a.project_id and b.ts >= a.ts and b.ts <= a.ts + interval 2 days", "job_events")
def job_durations(spark, sf_dir):
    """Starts joined with their finishes as two streams; starts that are still open at the end are added from the table."""
    kinds = lambda events: (events.where("kind = 'started'"), events.where("kind in ('completed', 'failed')"))
    live = lambda: views.job_events(spark, sf_dir, jobs.arriving)
    ended = jobs.settled(jobs.job_durations(kinds(live())[0], kinds(live())[1], how="inner"), mode="append")
    started = views.job_events(spark, sf_dir).where("kind = 'started'").select(F.col("event_id").alias("start_id"))
    return ended.unionByName(started.join(ended.select("start_id"), "start_id", "left_anti"), allowMissingColumns=True)


@query("t11_stream_new_chunks", "select distinct project_id || '-' || kind as chunk_id from job_events where project_id % 3 <> 0", "job_events")
def stream_new_chunks(spark, sf_dir):
    """Chunks named in arriving events, but those of every third project, which are stored."""
    name = F.concat(F.col("project_id").cast("string"), F.lit("-"), F.col("kind")).alias("chunk_id")
    stored = views.job_events(spark, sf_dir).where("project_id % 3 = 0").select(name).distinct()
    arriving = views.job_events(spark, sf_dir, jobs.arriving).select(name, "ts")
    return jobs.settled(jobs.new_chunks(arriving, stored), mode="append").select("chunk_id").distinct()


@query("t12_quota_usage", "with d as (select org_id, ts::date as day, sum(tokens) as tokens, count(*) as calls from token_events group by 1, 2), m as (select *, sum(tokens) over (partition by org_id, date_trunc('month', day) order by day)::bigint as used from d) select org_id, day::varchar as day, calls, used, used > 100000 as over, used > 120000 as suspended from m", "token_events")
def quota_usage(spark, sf_dir):
    daily = jobs.settled(jobs.daily_usage(views.token_events(spark, sf_dir, jobs.arriving)), ["org_id", "day"])
    return jobs.quota_usage(daily, 100_000, 20_000).select("org_id", F.col("day").cast("string").alias("day"), "calls", "used", "over", "suspended")


@query("t8_model_tokens", "select model, sum(tokens)::bigint as tokens, count(*) as calls from token_events group by 1", "token_events")
def model_tokens(spark, sf_dir):
    return jobs.settled(jobs.model_tokens(views.token_events(spark, sf_dir, jobs.arriving)), ["model"])


@query("t10_checkpoint_upsert", "with l as (select project_id, arg_max(kind, (ts, event_id)) as phase, floor(arg_max(value, (ts, event_id)))::bigint as done, arg_max(event_id, (ts, event_id)) as event_id from job_events group by 1) select project_id, phase, done, event_id, case when phase <> 'completed' then done + 1 end as next_file from l", "job_events")
def checkpoint_upsert(spark, sf_dir):
    """The table of latest progress that a stream keeps, with where each job would resume."""
    path = jobs.shared_path(spark, "progress")
    table = upsert.Table(spark, f"{path}/table", upsert.PROGRESS, "project_id", ["ts", "event_id"])
    events = views.job_events(spark, sf_dir, jobs.arriving).select("project_id", F.col("kind").alias("phase"), F.floor("value").alias("done"), "event_id", "ts")
    upsert.upsert_stream(events, table, f"{path}/state")
    return table.rows().select("project_id", "phase", "done", "event_id").join(upsert.resume_points(table).select("project_id", "next_file"), "project_id", "left")


_USES = ("tokens", "credits", "storage", "suspend", "resume")


@query("t12_quota_states", """with u as (select org_id, ts, event_id * 5 + k as number, (['tokens', 'credits', 'storage', 'suspend', 'resume'])[k + 1] as kind, case k when 0 then tokens when 1 then ceil(tokens / 1000.0) when 2 then (event_id % 7 - 3) * 1000 else 0 end::double as amount from token_events, range(0, 5) r(k) where k < 3 or (k = 3 and event_id % 97 = 0) or (k = 4 and event_id % 97 = 40)),
v as (select *, year(ts) * 100 + month(ts) as period from u where epoch_us(ts) < (select (epoch_ms(max(ts)) - 10000) * 1000 from token_events)),
w as (select org_id, number, period, sum(case when kind = 'credits' then amount else 0 end) over m as credits, sum(case when kind = 'tokens' then amount else 0 end) over m as tokens, sum(case when kind = 'storage' then amount else 0 end) over o as s, coalesce(last_value(case when kind in ('suspend', 'resume') then kind end ignore nulls) over o, '') = 'suspend' as suspended from v window m as (partition by org_id, period order by ts, number rows unbounded preceding), o as (partition by org_id order by ts, number rows unbounded preceding)),
x as (select *, s - least(0, min(s) over (partition by org_id order by number_ rows unbounded preceding)) as storage from (select *, row_number() over (partition by org_id order by t, number) as number_ from (select w.*, v.ts as t from w join v using (org_id, number))))
select org_id, number, period::bigint as period, credits, tokens, storage, suspended, not suspended and credits < 600 as enough_credits, not suspended and tokens < 500000 as enough_tokens, not suspended and storage < 9000 as enough_storage from x""", "token_events")
def quota_states(spark, sf_dir):
    """Credits, tokens and storage of organisations after each use: a state machine for each, with periods and suspension."""
    kind = lambda name, amount, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(name).alias("kind"), amount.cast("double").alias("amount"), (F.col("event_id") * 5 + _USES.index(name)).alias("number")))
    rest = F.col("event_id") % 97
    uses = F.array_compact(F.array(kind("tokens", F.col("tokens")), kind("credits", F.ceil(F.col("tokens") / 1000)), kind("storage", (F.col("event_id") % 7 - 3) * 1000), kind("suspend", F.lit(0), rest == 0), kind("resume", F.lit(0), rest == 40)))
    usage = views.token_events(spark, sf_dir, jobs.arriving).select("org_id", "ts", F.inline(uses))
    return jobs.settled(stateful.quota_states(usage, 600, 500_000, 9000), mode="append", stateful=True)

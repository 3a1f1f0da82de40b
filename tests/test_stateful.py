"""State machines by event time against plain loops: rows out of order, any batches, stops and restarts; the upserted table."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from strandline.streaming import jobs, stateful, upsert

T0 = datetime.datetime(2024, 1, 30)
EVENT = "project_id long, ts timestamp, event_id long, kind string"


def micros(ts):
    return int((ts - datetime.datetime(1970, 1, 1)).total_seconds() * 1000) * 1000


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def play(spark, folder, parts, schema, plan, name="out"):
    """Run a plan over files, one for each batch; more parts may be played on with the same folder."""
    source = str(folder / "in")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        with jobs.configured(spark, jobs.ROCKSDB):
            query = plan(stream).writeStream.outputMode("append").format("parquet").option("path", str(folder / name)).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
    return [tuple(r) for r in spark.read.parquet(str(folder / name)).collect()]


def plain_watchdog(rows, longest, silent, check, most, until):
    out = []
    for project in sorted({r[0] for r in rows}):
        events, job = sorted((r[1], r[2], r[3]) for r in rows if r[0] == project and r[1] < until), None
        tick = T0
        while tick < until:
            while events and events[0][0] <= tick:
                ts, _, kind = events.pop(0)
                if kind == "started":
                    job = [ts, ts, 0]
                elif kind in ("completed", "failed"):
                    job = None
                elif job:
                    job = [job[0], ts, 0 if kind == "heartbeat" else job[2]]
            if job:
                reason = "duration" if (tick - job[0]).total_seconds() > longest else "silence" if (tick - job[1]).total_seconds() > silent else None
                if reason:
                    job[2] += 1
                    out.append((project, tick, reason, job[2], job[2] >= most))
                    job = job if job[2] < most else None
            tick += datetime.timedelta(seconds=check)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_watchdog_is_the_plain_loop_in_any_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    kinds = ["started", "started", "heartbeat", "heartbeat", "progress", "completed", "failed"]
    rows = [(p, at(rng.randrange(0, 2400)), p * 1000 + k, rng.choice(kinds)) for p in range(5) for k in range(25)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    end = (99, at(2600), 10**6, "heartbeat")
    by_time = sorted(rows, key=lambda r: r[1])
    late = [by_time[k : k + 20] for k in range(0, len(by_time), 20)]
    for k in range(len(late) - 1):  # neighbours change places within the delay
        a, b = late[k][-1], late[k + 1][0]
        if (b[1] - a[1]).total_seconds() < 30:
            late[k][-1], late[k + 1][0] = b, a
    plan = lambda s: stateful.stuck_jobs(s, 150, 120, 30, 2, "60 seconds")
    want = plain_watchdog(rows, 150, 120, 30, 2, at(2540))
    one = play(spark, tmp_path / "one", [[*rows, end]], EVENT, plan)
    many = play(spark, tmp_path / "many", [*[rng.sample(x, len(x)) for x in late], [end]], EVENT, plan)
    assert sorted(one) == want and sorted(many) == want and want
    assert {r[2] for r in want} == {"duration", "silence"}


def test_a_phase_does_not_reset_strikes_and_null_keys_do_not_count(spark, tmp_path):
    rows = [(1, at(0), 1, "started"), (1, at(160), 2, "progress"), (1, at(320), 3, "progress"), (2, at(0), 4, "heartbeat"), (3, at(0), 5, "started"), (3, at(160), 6, "heartbeat"), (3, at(310), 7, "completed"), (None, at(1), 8, "started"), (9, at(700), 9, "progress")]
    got = play(spark, tmp_path, [rows], EVENT, lambda s: stateful.stuck_jobs(s, 6000, 120, 30, 2))
    assert sorted(got) == [(1, at(150), "silence", 1, False), (1, at(300), "silence", 2, True), (3, at(150), "silence", 1, False), (3, at(300), "silence", 1, False)]


USE = "org_id string, ts timestamp, number long, kind string, amount double"


def plain_quota(rows, until):
    out, states = [], {}
    for org, ts, number, kind, amount in sorted((r for r in rows if r[1] < until), key=lambda r: (r[1], r[2])):
        s = states.setdefault(org, {"period": 0, "credits": 0.0, "tokens": 0.0, "storage": 0.0, "suspended": False})
        if ts.year * 100 + ts.month != s["period"]:
            s.update(period=ts.year * 100 + ts.month, credits=0.0, tokens=0.0)
        if kind in s and kind != "suspended":
            s[kind] = max(0.0, s[kind] + amount) if kind == "storage" else s[kind] + amount
        s["suspended"] = True if kind == "suspend" else False if kind == "resume" else s["suspended"]
        out.append((org, number, s["period"], round(s["credits"], 6), s["tokens"], s["storage"], s["suspended"], *(not s["suspended"] and s[k] < 50 for k in ("credits", "tokens", "storage"))))
    return sorted(out)


def test_quota_over_a_change_of_month_and_a_restart(spark, tmp_path):
    rng = random.Random(5)
    kinds = ["credits", "tokens", "storage", "storage", "suspend", "resume"]
    rows = [(f"o{k % 3}", at(k * 3600 + rng.randrange(3600)), k, kind, float(rng.randrange(-20, 20) if kind == "storage" else rng.randrange(20))) for k in range(90) for kind in [rng.choice(kinds)]]
    end = ("z", at(200 * 3600), 10**6, "tokens", 1.0)
    parts = [rng.sample(rows[:30], 30), rng.sample(rows[30:60], 30), rng.sample(rows[60:], 30), [end]]
    got = play(spark, tmp_path, parts, USE, lambda s: stateful.quota_states(s, 50, 50, 50, "100 hours"))
    want = plain_quota(rows, at(100 * 3600))
    assert sorted(got) == want and len({r[2] for r in want}) == 2 and len(want) == 90


def test_the_session_keeps_its_settings(spark):
    name = next(iter(jobs.ROCKSDB))
    before = spark.conf.get(name, None)
    with jobs.configured(spark, {name: "x", "strandline.none": "1"}):
        assert spark.conf.get(name) == "x"
    assert spark.conf.get(name, None) == before and spark.conf.get("strandline.none", None) is None


def table(spark, path):
    return upsert.Table(spark, str(path / "table"), upsert.PROGRESS, "project_id", ["ts", "event_id"], buckets=4)


def batch(spark, *rows):
    return spark.createDataFrame([(p, phase, done, k, at(k)) for p, phase, done, k in rows], upsert.PROGRESS)


def shown(df):
    return sorted((r.project_id, r.phase, r.done) for r in df.collect())


def test_upserts_are_idempotent_and_ordered(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.rows().count() == 0 and t.committed() == -1
    t.upsert(batch(spark, (1, "indexing", 3, 1), (2, "indexing", 5, 2), (1, "indexing", 4, 3), (None, "x", 0, 9)), 0)
    t.upsert(batch(spark, (1, "analysis", 9, 8), (2, "indexing", 1, 1), (3, "completed", 2, 4)), 1)
    want = [(1, "analysis", 9), (2, "indexing", 5), (3, "completed", 2)]
    assert shown(t.rows()) == want
    t.upsert(batch(spark, (1, "again", 0, 99)), 1)  # committed before
    t.upsert(batch(spark, (1, "older", 0, 99)), 0)
    assert shown(t.rows()) == want
    t.upsert(batch(spark), 2)
    assert t.committed() == 2 and shown(t.rows()) == want and shown(t.rows(0)) == [(1, "indexing", 4), (2, "indexing", 5)]
    assert sorted((r.project_id, r.next_file) for r in upsert.resume_points(t).collect()) == [(1, 10), (2, 6)]
    gone = t.vacuum()
    assert gone and all("version=0" in x for x in gone)


def test_a_stop_between_write_and_commit(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "in")
    rows = [[(1, "indexing", 3, 1), (2, "indexing", 1, 2)], [(1, "analysis", 7, 3)], [(2, "completed", 9, 4), (3, "indexing", 0, 5)]]
    stream = lambda: spark.readStream.schema(upsert.PROGRESS).option("maxFilesPerTrigger", 1).parquet(source)
    t = table(spark, tmp_path)
    batch(spark, *rows[0]).coalesce(1).write.mode("append").parquet(source)
    upsert.upsert_stream(stream(), t, str(tmp_path / "state"))
    batch(spark, *rows[1]).coalesce(1).write.mode("append").parquet(source)

    def stop(version):
        raise RuntimeError("stopped")

    monkeypatch.setattr(t, "_commit", stop)
    with pytest.raises(Exception, match="stopped"):
        upsert.upsert_stream(stream(), t, str(tmp_path / "state"))
    assert shown(t.rows()) == [(1, "indexing", 3), (2, "indexing", 1)]  # written, not committed
    monkeypatch.undo()
    batch(spark, *rows[2]).coalesce(1).write.mode("append").parquet(source)
    again = table(spark, tmp_path)
    upsert.upsert_stream(stream(), again, str(tmp_path / "state"))
    assert shown(again.rows()) == [(1, "analysis", 7), (2, "completed", 9), (3, "indexing", 0)]


def test_the_sketch_keeps_its_bound(spark):
    rows = spark.range(20_000).select(F.lit("k").alias("kind"), F.expr("timestamp'2024-01-01 00:10:00'").alias("ts"), F.col("id").alias("event_id"), F.expr("cast((id * 7919) % 20000 as double)").alias("value"))
    got = jobs.metrics(rows).first()
    assert got.n == 20_000 and abs(got.p95 / 20_000 - 0.95) < 0.0166


@pytest.mark.parametrize("n", [1, 19, 20, 21, 220, 1000, 4321])
def test_the_percentile_is_a_value_of_the_window(spark, n):
    values = [float(k * 7919 % 10_007) for k in range(n)]
    rows = spark.createDataFrame([("k", at(k / n), k, v) for k, v in enumerate(values)], "kind string, ts timestamp, event_id long, value double")
    assert jobs.metrics(rows).first().p95 == sorted(values)[-(-95 * n // 100) - 1]


class Store(dict):
    """A value or map state, and the handle that gives it, without Spark."""

    def __init__(self):
        self.timers = []

    getMapState = getValueState = lambda self, name, *_: self.setdefault(("state", name), Store())  # noqa: E731, N815
    exists = lambda self: bool(len(self))
    get = lambda self, key=None: dict.get(self, key)
    getValue = get  # noqa: N815
    update = lambda self, row: self.__setitem__(None, row)
    updateValue = dict.__setitem__  # noqa: N815
    removeKey = dict.__delitem__  # noqa: N815
    registerTimer = lambda self, ms: self.timers.append(ms)  # noqa: E731, N815


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_a_key_of_many_rows_is_kept_and_merged_in_pieces(monkeypatch):
    """2,000 rows of a key in any order, in runs of 300 and pieces of 16 rows, with a watermark that stops in their middle."""
    import pandas as pd

    monkeypatch.setattr(stateful, "RUN", 300)
    monkeypatch.setattr(stateful, "PIECE", 16)
    rng = random.Random(8)
    kinds = ["credits", "tokens", "storage", "storage", "suspend", "resume"]
    rows = [("o", at(rng.randrange(0, 5 * 86_400)), k, rng.choice(kinds), float(rng.randrange(-20, 20))) for k in range(2000)]
    frame = pd.DataFrame([(micros(ts), number, kind, amount) for _, ts, number, kind, amount in rows], columns=["us", "number", "kind", "amount"])
    handle, machine = Store(), stateful.Quota(50, 50, 50)
    machine.init(handle)
    list(machine.handleInputRows(("o",), iter([frame.iloc[k : k + 100] for k in range(0, 2000, 100)]), Clock(0)))
    assert 2000 / 16 <= len(machine.waiting) <= 2000 / 16 + 10
    out = []
    for day in (2.5, 2.5, 6):
        out += list(machine.handleExpiredTimer(("o",), Clock(micros(at(day * 86_400)) // 1000), None))
    got = [tuple(r) for frame in out for r in frame.itertuples(index=False)]
    assert sorted(got) == plain_quota(rows, at(6 * 86_400)) and not len(machine.waiting) and len(out) > 20

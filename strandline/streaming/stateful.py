"""Streams with a state machine for each key, by event time: the watchdog over jobs and the quotas of organisations.

Rows may arrive in any order within the watermark's delay and in any batches. A machine sees them in the order of their times:
a key's rows wait in sorted pieces until the watermark has passed them, when a timer hands them on, sorted, together with the
checks that fall between them. So the output is the same however the input was cut into batches, and after a restart. What a
key keeps is its waiting rows, one state row, and its timers; a machine that ends its key clears all of it.

A clock in milliseconds decides: rows and checks before the watermark are final. The state store is RocksDB, set for the query
only (`jobs.settled`).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


#: Rows that a key's task sorts and cuts at once as they arrive, and rows of a piece, which is one entry of the state.
RUN, PIECE = 1 << 20, 1 << 16
ROW = ("us", "number", "kind", "amount")


def _packed(rows: pd.DataFrame) -> bytes:
    """Rows as an Arrow stream, kinds as codes."""
    kinds = pa.array(rows["kind"], pa.string()).dictionary_encode()
    batch = pa.RecordBatch.from_arrays([pa.array(rows["us"].to_numpy()), pa.array(rows["number"].to_numpy()), kinds, pa.array(rows["amount"].to_numpy())], names=list(ROW))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(piece: bytes) -> pd.DataFrame:
    rows = pa.ipc.open_stream(piece).read_all()
    return rows.set_column(2, "kind", rows.column(2).cast(pa.string())).to_pandas()


def _sorted(rows: pd.DataFrame) -> pd.DataFrame:
    order = np.lexsort((rows["number"].to_numpy(), rows["us"].to_numpy()))
    return rows if (order[1:] > order[:-1]).all() else rows.take(order)


NO_ROWS = pd.DataFrame({"us": [], "number": [], "kind": [], "amount": []})


class Ordered(StatefulProcessor):
    """Hands a key's rows (us, number, kind, amount) on in order of time, then number, once the watermark has passed them.

    Waiting rows are kept in sorted pieces, each one entry by its first time, and merged piece by piece: so a key of very many
    rows costs few calls of the store, and a task holds of it a piece of each run, not all rows.

    A machine gives `STATE`, the schema of its state row; `OUT`, the names of its output columns, of which the first is the key;
    `advance`, which takes the state (None at first), the rows as a frame and the time up to which all is final, and returns the
    new state (None to end the key), the output columns behind the key (None: no rows) and the time of the next check (None: wait
    for rows)."""

    STATE = ""
    OUT: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, part long", "rows binary")
        self.parts = handle.getValueState("parts", "n long")
        self.state = handle.getValueState("state", self.STATE)

    def _keep(self, frames: list[pd.DataFrame], n: int) -> int:
        """Keep rows as pieces; n is the number of the next piece."""
        rows = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
        rows = _sorted(rows)
        for at in range(0, len(rows), PIECE):
            piece = rows.iloc[at : at + PIECE]
            self.waiting.updateValue((int(piece["us"].iloc[0]), n), (_packed(piece),))
            n += 1
        return n

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, n, held, size = None, None, [], 0
        for frame in itertools.chain(rows, [None]):
            if frame is not None and len(frame):
                held.append(frame[list(ROW)].astype({"us": "int64", "number": "int64", "amount": "float64"}))
                size += len(frame)
                least = int(frame["us"].min())
                first = least if first is None else min(first, least)
            if held and (frame is None or size >= RUN):
                if n is None:
                    n = self.parts.get()[0] if self.parts.exists() else 0
                n, held, size = self._keep(held, n), [], 0
        if n is not None:
            self.parts.update((n,))
            self._wake(first, timerValues)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        pieces = sorted((int(k[0]), int(k[1])) for k in self.waiting.keys()) if self.waiting.exists() else []
        state = self.state.get() if self.state.exists() else None
        known, held, check = state is not None, None, None
        due = [p for p in pieces if p[0] < until]
        for piece, follows in itertools.zip_longest(due, [*(p[0] for p in due[1:]), until]):
            if piece is not None:
                rows = _unpacked(self.waiting.getValue(piece)[0])
                self.waiting.removeKey(piece)
                held = rows if held is None or not len(held) else pd.concat([held, rows], ignore_index=True)
            ready, held = (None, None) if held is None else (held[held["us"] < follows], held[held["us"] >= follows])
            if piece is not None and follows < until and not len(ready):
                continue
            ready = NO_ROWS if ready is None else _sorted(ready)
            state, out, check = self.advance(state, ready, follows)
            if out:
                yield pd.DataFrame(dict(zip(self.OUT, ([key[0]] * len(out[0]), *out), strict=True)))
        if state is not None:
            self.state.update(state)
        elif known:
            self.state.clear()
        later = [p[0] for p in pieces if p[0] >= until]
        if held is not None and len(held):
            n = self.parts.get()[0]
            self.parts.update((self._keep([held], n),))
            later.append(int(held["us"].min()))
        elif not later and pieces:
            self.parts.clear()
        for time in (min(later, default=None), check):
            if time is not None:
                self._wake(time, timerValues)

    def _wake(self, us: int, timerValues: Any) -> None:
        """Wake when the watermark has passed this time."""
        self.handle.registerTimer(max(us // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def advance(self, state: tuple | None, rows: pd.DataFrame, until: int) -> tuple[tuple | None, tuple | None, int | None]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def run(events: DataFrame, key: str, machine: Ordered, out: str, delay: str) -> DataFrame:
    """The output of a machine over events (key, ts, number, kind, amount)."""
    rows = events.select(key, "ts", F.unix_micros("ts").alias("us"), "number", "kind", "amount").where(F.col(key).isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", delay)
    return rows.groupBy(key).transformWithStateInPandas(machine, out, "Append", "EventTime")


SECOND = 1_000_000


class Watchdog(Ordered):
    """Jobs between their start and their end. At each check, every `check` seconds of the clock, a job gets a strike if it has run
    longer than `longest`, or else if nothing was heard of it for `silent`; at `strikes` it is cancelled and no longer watched.
    A heartbeat resets the strikes, a phase update counts as heard of but does not; events of jobs not watched do not count."""

    STATE = "started long, last long, strikes int, checked long"
    OUT = ("project_id", "checked_at", "reason", "strikes", "cancelled")

    def __init__(self, longest: int, silent: int, check: int, strikes: int):
        self.longest, self.silent, self.check, self.strikes = longest * SECOND, silent * SECOND, check * SECOND, strikes

    def _first(self, job: tuple, since: int) -> int:
        """The first check from then on at which the job counts as stuck."""
        stuck = min(job[0] + self.longest, job[1] + self.silent) + 1
        return -(-max(stuck, since) // self.check) * self.check

    def advance(self, state, rows, until):
        out = []
        job, since = (state[:3], state[3]) if state else (None, 0)
        for us, kind in zip([*map(int, rows["us"].tolist()), until], [*rows["kind"].tolist(), None], strict=True):
            while job and (at := self._first(job, since)) < us:
                strikes, since = job[2] + 1, at + 1
                out.append((pd.Timestamp(at, unit="us"), "duration" if at - job[0] > self.longest else "silence", strikes, strikes >= self.strikes))
                job = (*job[:2], strikes) if strikes < self.strikes else None
            since = max(since, us)
            if kind == "started":
                job = (us, us, 0)
            elif kind in ("completed", "failed"):
                job = None
            elif job and kind in ("heartbeat", "progress"):
                job = (job[0], us, 0 if kind == "heartbeat" else job[2])
        return (*job, until) if job else None, tuple(map(list, zip(*out, strict=True))), self._first(job, until) if job else None


def stuck_jobs(events: DataFrame, longest: int = 600, silent: int = 120, check: int = 30, strikes: int = 2, delay: str = "10 seconds") -> DataFrame:
    """(project_id, checked_at, reason, strikes, cancelled): the strikes of job events (project_id, ts, event_id, kind)."""
    rows = events.select("project_id", "ts", F.col("event_id").alias("number"), "kind", F.lit(0.0).alias("amount"))
    return run(rows, "project_id", Watchdog(longest, silent, check, strikes), "project_id long, checked_at timestamp, reason string, strikes int, cancelled boolean", delay)


class Quota(Ordered):
    """An organisation's use of its period, a month: credits and tokens begin anew with it, storage and suspension carry over.

    kind: credits, tokens or storage, with the amount used (storage released: below zero, down to nothing), or suspend and
    resume. Each row gives what is used after it, and whether more may start."""

    STATE = "period long, credits double, tokens double, storage double, suspended boolean"
    OUT = ("org_id", "number", "period", "credits", "tokens", "storage", "suspended", "enough_credits", "enough_tokens", "enough_storage")

    def __init__(self, credits: float, tokens: float, storage: float):
        self.most = (credits, tokens, storage)

    def advance(self, state, rows, until):
        if not len(rows):
            return state, None, None
        period, credits, tokens, storage, suspended = state or (0, 0.0, 0.0, 0.0, False)
        day = pd.to_datetime(rows["us"].to_numpy(np.int64), unit="us")
        months = (day.year * 100 + day.month).to_numpy(np.int64)
        kind, amount = rows["kind"].to_numpy(object), rows["amount"].to_numpy(np.float64)
        of = {k: kind == k for k in ("credits", "tokens", "storage", "suspend", "resume")}
        begins = np.flatnonzero(np.diff(months, prepend=period))
        used = {}
        for name, before in (("credits", credits), ("tokens", tokens)):  # sums of each month, in order
            own, cuts = np.where(of[name], amount, 0.0), [*begins.tolist(), len(rows)]
            first = [np.cumsum(np.concatenate([[before], own[: cuts[0]]]))[1:]] if cuts[0] else []
            used[name] = np.concatenate([*first, *(np.cumsum(own[a:b]) for a, b in itertools.pairwise(cuts))])
        at = np.flatnonzero(of["storage"])
        sums = np.cumsum(np.concatenate([[storage], amount[at]]))
        # what would have gone below zero so far is given back: a sum, less its lowest point up to there
        kept = sums - np.minimum(np.minimum.accumulate(sums), 0.0)
        levels = kept[np.cumsum(of["storage"])]
        marks = np.maximum.accumulate(np.where(of["suspend"] | of["resume"], np.arange(len(rows)), -1))
        stopped = np.where(marks >= 0, of["suspend"][np.maximum(marks, 0)], bool(suspended))
        enough = [~stopped & (x < most) for x, most in zip((used["credits"], used["tokens"], levels), self.most, strict=True)]
        out = (rows["number"].to_numpy(np.int64), months, np.round(used["credits"], 6), used["tokens"], levels, stopped, *enough)
        return (int(months[-1]), float(used["credits"][-1]), float(used["tokens"][-1]), float(levels[-1]), bool(stopped[-1])), out, None


def quota_states(usage: DataFrame, credits: float, tokens: float, storage: float, delay: str = "10 seconds") -> DataFrame:
    """(org_id, number, period, credits, tokens, storage, suspended, enough_*) after each row of usage (org_id, ts, number, kind,
    amount)."""
    out = "org_id string, number long, period long, credits double, tokens double, storage double, suspended boolean, enough_credits boolean, enough_tokens boolean, enough_storage boolean"
    return run(usage, "org_id", Quota(credits, tokens, storage), out, delay)

"""The life of ingestion jobs as a keyed stream: commands in, transitions out.

On a stream a job's state lies in Spark's state store under its id; on a table,
which no batch follows, tasks take jobs one after the other and keep the state of
one.  A command either moves the job on, which raises its revision by one, or is
refused; both give a row.
Leases are fenced: who renews or updates must show the token of the running
lease before it ends, and a claim makes a new token, so a worker that was thought
lost can't write any more.  Two timers stand in event time: the end of a lease
and the time of a retry.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sheafline.operators.rounds import dealt

# States, phases, and the fields of a job that no update may name.
FINAL = ("succeeded", "failed", "cancelled")
FIRST_PHASE = "acquire-source"
IMMUTABLE = ("id", "idempotencyKey", "input", "attempt", "maxAttempts", "createdAt", "revision", "updatedAt")
#: What an update may set, by the names that commands use.
PATCH = {"state": "state", "phase": "phase", "nextAttemptAt": "next_attempt_at", "errorCode": "error_code", "lease": None}

COMMANDS = "job_id string, seq long, at timestamp, kind string, key string, max_attempts int, worker string, token string, duration_ms long, patch string"
OUT = "job_id string, seq long, at_ms long, kind string, outcome string, state string, phase string, revision long, attempt int, token string, lease_until long, next_attempt_at long, error_code string"
STATE = "job string"
#: Commands of a table that a task takes.
PER_TASK = 100_000

Job = dict[str, Any]


def new_job(key: str | None, max_attempts: int, at: int) -> Job:
    return {"key": key, "state": "queued", "phase": "queued", "revision": 0, "attempt": 0, "max_attempts": max_attempts, "created_at": at, "updated_at": at}


def changed(job: Job, at: int, **new: Any) -> Job:
    """The next revision; a field set to None goes."""
    merged = job | new | {"revision": job["revision"] + 1, "updated_at": at}
    return {k: v for k, v in merged.items() if v is not None}


def expired(job: Job, at: int) -> bool:
    return job["state"] == "running" and job.get("lease_until", at) <= at


def lease_lost(job: Job, at: int) -> Job:
    return changed(job, at, state="failed", phase="failed", token=None, lease_until=None, next_attempt_at=None, error_code="lease-lost")


def claimed(job: Job, at: int, worker: str | None, duration: int) -> tuple[Job | None, str]:
    """A claim of a job that is queued, due for a retry or abandoned; an abandoned last attempt fails."""
    due = job["state"] == "retry-scheduled" and job.get("next_attempt_at", 0) <= at
    if not (job["state"] == "queued" or due or expired(job, at)):
        return None, "refused"
    if job["attempt"] >= job["max_attempts"]:
        return (lease_lost(job, at), "lease-lost") if expired(job, at) else (None, "refused")
    token = f"{worker}:{job['revision'] + 1}"  # no other claim of the job has this revision
    return changed(job, at, state="running", phase=FIRST_PHASE, attempt=job["attempt"] + 1, next_attempt_at=None, error_code=None, token=token, lease_until=at + duration), "claimed"


def step(job: Job | None, command: dict[str, Any]) -> tuple[Job | None, str]:
    """A job after a command, and what came of it; None where the command changes nothing."""
    kind, at = command["kind"], command["at_ms"]
    if kind == "create":
        if job is None:
            return new_job(command["key"], command["max_attempts"] or 1, at), "created"
        return None, "existing" if job.get("key") == command["key"] else "job-conflict"
    if job is None:
        return None, "unknown"
    if kind == "claim":
        return claimed(job, at, command["worker"], command["duration_ms"] or 0)
    if kind == "cancel":
        if job["state"] in FINAL:
            return None, "existing" if job["state"] == "cancelled" else "refused"
        return changed(job, at, state="cancelled", phase="cancelled", next_attempt_at=None, token=None, lease_until=None, error_code=None), "cancelled"
    fenced = job["state"] == "running" and command["token"] is not None and job.get("token") == command["token"] and not expired(job, at)
    if not fenced:
        return None, "refused"
    if kind == "renew":
        return changed(job, at, lease_until=at + (command["duration_ms"] or 0)), "renewed"
    if kind != "update":
        return None, "unknown"
    patch = json.loads(command["patch"] or "{}")
    if any(name in IMMUTABLE for name in patch):
        return None, "job-conflict"
    new = {PATCH[n]: v for n, v in patch.items() if PATCH.get(n)}
    if new.get("state", "running") != "running":
        new |= {"token": None, "lease_until": None}  # a job that isn't running holds no lease
    return changed(job, at, **new), "updated"


def whole(value: Any) -> int | None:
    """A patch's time as a whole number, which text may give too; a fraction is an error."""
    if isinstance(value, float) and not value.is_integer():
        raise ValueError(f"not a whole number of milliseconds: {value}")
    return None if value is None else int(value)


def row(job_id: str, seq: int | None, at: int, kind: str, outcome: str, job: Job | None) -> dict[str, Any]:
    shown = {n: (job or {}).get(n) for n in ("state", "phase", "revision", "attempt", "token", "lease_until", "next_attempt_at", "error_code")}
    shown["next_attempt_at"] = whole(shown["next_attempt_at"])
    return {"job_id": job_id, "seq": seq, "at_ms": at, "kind": kind, "outcome": outcome, **shown}


def frame(rows: list[dict[str, Any]]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUT.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    whole = ("seq", "at_ms", "revision", "lease_until", "next_attempt_at")
    return out.astype({**dict.fromkeys(whole, "Int64"), "attempt": "Int32"})


class Jobs(StatefulProcessor):
    """Applies a job's commands in the order of their time and number, and its timers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def _load(self) -> Job | None:
        held = self.job.get()
        return None if held is None else json.loads(held[0])

    def _store(self, job: Job) -> None:
        self.job.update((json.dumps(job),))

    def _arm(self, job: Job, watermark: int) -> None:
        """Just the timer that the job waits for now."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        wait = job.get("lease_until") if job["state"] == "running" else job.get("next_attempt_at") if job["state"] == "retry-scheduled" else None
        if wait is not None:
            self.handle.registerTimer(max(int(wait), watermark + 1))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        job, out = self._load(), []
        for batch in [pd.concat(list(rows)).sort_values(["at_ms", "seq"], kind="stable")]:
            for command in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                after, outcome = step(job, command)
                job = after or job
                out.append(row(key[0], command["seq"], command["at_ms"], command["kind"], outcome, job))
        if job is not None:
            self._store(job)
            self._arm(job, timerValues.getCurrentWatermarkInMs())
        yield frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        job, at = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        if job is None:
            return
        if expired(job, at) and job["attempt"] >= job["max_attempts"]:
            job = lease_lost(job, at)
            self._store(job)
            yield frame([row(key[0], None, at, "timer", "lease-lost", job)])
        elif expired(job, at):
            yield frame([row(key[0], None, at, "timer", "abandoned", job)])  # another worker may claim it now
        elif job["state"] == "retry-scheduled" and job.get("next_attempt_at", 0) <= at:
            yield frame([row(key[0], None, at, "timer", "due", job)])


def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The transitions of commands that come sorted by job, time and number; the last job goes on in the next batch."""
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(n, types[t]) for n, t in (c.split() for c in OUT.split(", "))])
    job, own = None, None
    for batch in batches:
        out, names = [], batch.schema.names
        for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            command = dict(zip(names, values, strict=True))
            if command["job_id"] != own:
                job, own = None, command["job_id"]
            after, outcome = step(job, command)
            job = after or job
            out.append(row(own, command["seq"], command["at_ms"], command["kind"], outcome, job))
        yield pa.RecordBatch.from_pylist(out, schema)


def job_transitions(commands: DataFrame, delay: str = "1 minute") -> DataFrame:
    """One row for each command, and one when a lease ends or a retry comes due.

    ``commands`` has the columns of ``COMMANDS``; others are left out.  On a stream
    timers go by the watermark, ``delay`` after the latest time seen, and commands
    later than that are dropped by Spark.  A job's commands of one batch are taken
    in the order of ``at`` and ``seq``; a job of no id has none.  On a table the
    commands alone move jobs; they are dealt to tasks by job, sorted, and taken as
    they come, so that a task holds a batch and one state whatever the size of a
    job.  Needs the RocksDB state store on streams.
    """
    names = [c.split()[0] for c in COMMANDS.split(", ")]
    own = commands.select(*names).where("job_id is not null").withColumn("at_ms", F.unix_millis("at"))
    if not commands.isStreaming:
        ordered = dealt(own.drop("at"), own.count(), PER_TASK, "job_id").sortWithinPartitions("job_id", F.asc_nulls_last("at_ms"), F.asc_nulls_last("seq"))
        return ordered.mapInArrow(in_order, OUT)
    keyed = own.withWatermark("at", delay).groupBy("job_id")
    return keyed.transformWithStateInPandas(statefulProcessor=Jobs(), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def observed(transitions: DataFrame, name: str = "jobs") -> DataFrame:
    """The same rows, with counts of each outcome as metrics that listeners and observations get with every batch."""
    outcomes = ("created", "claimed", "renewed", "updated", "cancelled", "refused", "job-conflict", "lease-lost", "abandoned", "due")
    return transitions.observe(name, F.count("*").alias("rows"), *(F.count_if(F.col("outcome") == o).alias(o) for o in outcomes))

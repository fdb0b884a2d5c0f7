"""Job states as a stream: fencing, retries, lost leases, timers and observed counts."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from sheafline.streaming import job_states as S

DAY = dt.datetime(2024, 1, 1)
MS = 1_704_067_200_000


def command(job, seq, second, kind, token=None, **patch):
    return (job, seq, DAY + dt.timedelta(seconds=second), kind, f"key-{job}", 2, f"w{seq}", token, 10_000, json.dumps(patch) if patch else None)


def held(job, *commands):
    """The job and the outcomes of commands (second, kind, token, patch)."""
    outcomes = []
    for n, (second, kind, token, patch) in enumerate(commands):
        after, outcome = S.step(job, {"kind": kind, "at_ms": MS + second * 1000, "key": "k", "max_attempts": 2, "worker": f"w{n}", "token": token, "duration_ms": 10_000, "patch": json.dumps(patch)})
        job = after or job
        outcomes.append(outcome)
    return job, outcomes


def test_leases_are_fenced():
    job, seen = held(None, (0, "create", None, {}), (1, "claim", None, {}), (2, "claim", None, {}), (3, "renew", "w1:1", {}), (4, "renew", "w2:1", {}), (13, "renew", "w1:1", {}))
    assert seen == ["created", "claimed", "refused", "renewed", "refused", "refused"]  # the lease ended at second 13
    job, seen = held(job, (14, "claim", None, {}), (15, "update", "w1:1", {"phase": "x"}), (16, "update", job["token"], {"phase": "y"}), (17, "update", "w0:3", {"attempt": 1}), (18, "update", "w0:3", {"state": "succeeded"}))
    assert seen == ["claimed", "refused", "refused", "job-conflict", "updated"] and (job["state"], job["attempt"], job["revision"]) == ("succeeded", 2, 4)
    assert "token" not in job and held(job, (19, "cancel", None, {}), (20, "claim", None, {}))[1] == ["refused", "refused"]


def test_the_last_attempt_is_not_claimed_again():
    job, seen = held(None, (0, "create", None, {}), (1, "claim", None, {}), (11, "claim", None, {}), (12, "claim", None, {}), (21, "claim", None, {}), (22, "claim", None, {}))
    assert seen == ["created", "claimed", "claimed", "refused", "lease-lost", "refused"] and (job["state"], job["error_code"]) == ("failed", "lease-lost")
    waits = {"state": "retry-scheduled", "nextAttemptAt": MS + 9000, "errorCode": "fetch-failed"}
    job, seen = held(None, (0, "create", None, {}), (1, "claim", None, {}), (2, "update", "w1:1", waits), (8, "claim", None, {}), (9, "claim", None, {}), (10, "update", "w4:3", waits | {"nextAttemptAt": MS}), (11, "claim", None, {}), (12, "cancel", None, {}), (13, "cancel", None, {}))
    assert seen == ["created", "claimed", "updated", "refused", "claimed", "updated", "refused", "cancelled", "existing"] and job["state"] == "cancelled" and "next_attempt_at" not in job
    assert held(None, (0, "claim", None, {}), (1, "create", None, {}), (2, "create", None, {}), (3, "what", None, {}))[1] == ["unknown", "created", "existing", "refused"]


def test_timers_end_leases_and_call_retries(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    retry = {"state": "retry-scheduled", "nextAttemptAt": MS + 60_000, "errorCode": "fetch-failed"}
    batches = [
        [command("a", 1, 0, "create"), command("a", 2, 1, "claim"), command("b", 3, 0, "create"), command("b", 4, 1, "claim"), command("b", 5, 2, "update", "w4:1", **retry), (None, 9, DAY, "create", "k", 1, None, None, 0, None)],
        [command("c", 6, 200, "create")],  # time goes on
        [command("a", 7, 210, "claim"), command("c", 8, 400, "cancel")],
        [command("d", 10, 900, "create")],
    ]
    counts = []

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            counts.extend(m.asDict() for name, m in event.progress.observedMetrics.items() if name == "jobs")

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    listener = Listener()
    spark.streams.addListener(listener)
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for batch in batches:
        spark.createDataFrame(batch, S.COMMANDS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(S.COMMANDS).parquet(source)
        out = S.observed(S.job_transitions(stream, "0 seconds"))
        out.writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(target)).outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.streams.removeListener(listener)
    rows = spark.read.parquet(target).collect()
    by = {(r.job_id, r.seq if r.seq is not None else r.outcome): r for r in rows}
    assert len(by) == len(rows) and not any(r.job_id is None for r in rows)
    assert by["a", "abandoned"].at_ms == MS + 11_000 and by["b", "due"].at_ms == MS + 60_000
    assert by["a", 7].outcome == "claimed" and by["a", 7].attempt == 2 and by["a", "lease-lost"].state == "failed"
    assert by["c", 8].outcome == "cancelled"
    assert sum(c["claimed"] for c in counts) == 3 and sum(c["due"] for c in counts) == 1


def test_a_table_of_commands(spark):
    rows = [command("a", 2, 1, "claim"), command("a", 1, 1, "create"), command("b", 1, 0, "renew", "t")]
    got = S.job_transitions(spark.createDataFrame(rows, S.COMMANDS).withColumn("more", F.lit(1))).collect()
    assert sorted((r.job_id, r.seq, r.outcome) for r in got) == [("a", 1, "created"), ("a", 2, "claimed"), ("b", 1, "unknown")]
    assert S.job_transitions(spark.createDataFrame([], S.COMMANDS)).count() == 0


def test_a_table_takes_no_call_for_each_job(spark):
    """Jobs go on from one Arrow batch to the next, by their time, and numbers keep their digits beside a missing one."""
    big = 2**53 + 1
    rows = [command(f"j{n}", seq, seq, kind, "w1:1" if kind == "renew" else None) for n in range(39) for seq, kind in enumerate(("create", "claim", "renew", "claim", "cancel", "cancel"))]
    rows += [command("x", None, 3, "cancel"), command("x", big, 2, "create"), command("x", 4, 1, "renew", "t")]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        table = S.job_transitions(spark.createDataFrame(rows, S.COMMANDS).orderBy(F.rand(1)))
        plan, got = table._jdf.queryExecution().executedPlan().toString(), table.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert "TransformWithState" not in plan
    by = {}
    for r in sorted(got, key=lambda r: (r.job_id, r.at_ms)):
        by.setdefault(r.job_id, []).append(r)
    assert [(r.seq, r.outcome) for r in by.pop("x")] == [(4, "unknown"), (big, "created"), (None, "cancelled")]
    assert len(by) == 39 and all([r.outcome for r in own] == ["created", "claimed", "renewed", "refused", "cancelled", "existing"] and own[-1].revision == 3 for own in by.values())


def test_times_of_patches_are_whole(spark):
    assert [S.whole(v) for v in (None, 5, 5.0, "12")] == [None, 5, 5, 12]
    tried = lambda time: S.job_transitions(spark.createDataFrame([command("a", 1, 0, "create"), command("a", 2, 1, "claim"), command("a", 3, 2, "update", "w2:1", nextAttemptAt=time)], S.COMMANDS))
    assert {r.seq: r.next_attempt_at for r in tried("12").collect()} == {1: None, 2: None, 3: 12}
    with pytest.raises(Exception, match="1.5"):
        tried(1.5).collect()

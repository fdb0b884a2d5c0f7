"""Job states over a round of results: retries with jitter, cancellations, failures as bounded envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.streaming.ingest import ATTEMPTS, FIRST_DELAY, LONGEST_DELAY

# Error codes, and the lengths that an envelope's texts are cut to.
CODES = (
    "aborted", "deadline-exceeded", "fetch-failed", "integrity-failed", "invalid-persistence", "invalid-source", "invalid-text", "job-conflict",
    "lease-lost", "malformed", "output-too-large", "processing-failed", "render-failed", "resource-limit", "search-failed", "sink-failed",
    "source-changed", "too-large", "too-many-cells", "too-many-pages", "too-many-slides", "unsupported-runtime", "worker-failed",
)
JITTER = 0.2
MARKER = "ingestion-failure:"
CODE_CHARS, MESSAGE_CHARS = 256, 2048
FAILURE = "version int, code string, message string, retryable boolean, format string, status double"
FINAL = ("succeeded", "failed", "cancelled")


def unit(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone, so that a repeated round gives the same times."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(k.cast("string") for k in key)).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def jittered_delay(attempt: Column, random: Column, jitter: float = JITTER) -> Column:
    """Milliseconds before the next attempt, within ``jitter`` of the doubling delay; null after the last one."""
    plain = F.least(F.lit(LONGEST_DELAY), FIRST_DELAY * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)))) * 1000
    return F.when(attempt < ATTEMPTS, F.floor(plain * (1 - jitter + random * 2 * jitter) + 0.5).cast("long"))


def known_code(code: Column) -> Column:
    """An error code, or that of any other failure."""
    return F.when(code.isin(*CODES), code).otherwise("processing-failed")


def after_results(jobs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Jobs after their results: ``job_id, state, attempt, due_at`` (milliseconds), ``error_code``.

    ``jobs`` has ``job_id, state, attempt``; ``results`` has ``job_id, error_code``
    (null: done) and ``retryable``, one row a job.  Only running jobs change; a late
    result of a job that is final is passed over.
    """
    both = jobs.select("job_id", "state", "attempt").join(results.select("job_id", F.col("error_code").alias("e"), "retryable", F.lit(True).alias("told")), "job_id", "left")
    live = F.col("told").isNotNull() & (F.col("state") == "running")
    delay = F.when(F.coalesce("retryable", F.lit(False)), jittered_delay(F.col("attempt"), unit(F.col("job_id"), F.col("attempt"))))
    state = F.when(~live, F.col("state")).when(F.col("e").isNull(), "succeeded").when(delay.isNotNull(), "retry").otherwise("failed")
    return both.select("job_id", state.alias("state"), "attempt", F.when(state == "retry", now + delay).alias("due_at"), F.when(live & F.col("e").isNotNull(), known_code(F.col("e"))).alias("error_code"))


def cancelled(jobs: DataFrame, cancellations: DataFrame) -> DataFrame:
    """Jobs with the named ones cancelled; final ones stay, so cancelling twice changes nothing."""
    named = cancellations.select("job_id").distinct().withColumn("named", F.lit(True))
    state = F.when(F.col("named") & ~F.col("state").isin(*FINAL), "cancelled").otherwise(F.col("state"))
    return jobs.join(named, "job_id", "left").withColumn("state", state).select(*jobs.columns)


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events for observers: ``job_id, was, state`` of the jobs that are new or changed their state."""
    old = before.select("job_id", F.col("state").alias("was"))
    return after.select("job_id", "state").join(old, "job_id", "left").where(~F.col("was").eqNullSafe(F.col("state"))).select("job_id", "was", "state")


def encoded_failure(code: Column, message: Column, retryable: Column, format: Column, status: Column) -> Column:
    """A failure as one line of text: marker and percent-encoded JSON, with bounded code and message."""
    body = F.struct(
        F.lit(1).alias("version"), F.substring(F.coalesce(code, F.lit("processing-failed")), 1, CODE_CHARS).alias("code"), F.substring(F.coalesce(message, F.lit("")), 1, MESSAGE_CHARS).alias("message"),
        F.coalesce(retryable, F.lit(False)).alias("retryable"), F.substring(format, 1, CODE_CHARS).alias("format"), status.cast("double").alias("status"),
    )
    return F.concat(F.lit(MARKER), F.url_encode(F.to_json(body)))


def decoded_failure(c: Column) -> Column:
    """The failure that a text holds, or null where it has none or one out of bounds."""
    found = F.regexp_extract(c, MARKER + r"([A-Za-z0-9%_.!~*'()+-]+)", 1)
    body = F.from_json(F.try_url_decode(F.nullif(found, F.lit(""))), FAILURE)
    whole = (body["version"] == 1) & (F.length(body["code"]) <= CODE_CHARS) & (F.length(body["message"]) <= MESSAGE_CHARS) & body["retryable"].isNotNull()
    return F.when(whole, body)

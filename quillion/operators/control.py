"""The control plane as data: retries, spacing of requests, statuses of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Attempts, the longest wait that a server may ask for, and messages that are safe to show.
MOST_ATTEMPTS, MOST_WAIT = 2, 5.0
TIMED_OUT, NETWORK, BUDGET, UNEXPECTED = "request timed out", "network error", "exceeded time budget", "unexpected error"


def retry_wait(outcome: Column, retry_after: Column, backoff: Column) -> Column:
    """Seconds before a retry: the backoff; after 429 a whole number of seconds from the server, between backoff and 5."""
    header = F.regexp_replace(retry_after, r"(?U)^\s+|\s+$", "")
    asked = F.when((outcome == "429") & header.rlike("^[0-9]+$"), header.try_cast("double"))
    return F.coalesce(F.least(F.greatest(asked, backoff), F.lit(MOST_WAIT)), backoff)


def decide(attempts: DataFrame) -> DataFrame:
    """Adds action (return, retry, fail), wait and message to (outcome, attempt, retry_after, backoff).

    outcome is a status code, ``timeout`` or ``network``; attempt counts from 0.
    Only 429 and 5xx are retried, once; other codes from 400 up fail; redirects return.
    """
    o = F.col("outcome")
    code = o.try_cast("int")
    busy = F.coalesce((code == 429) | (code >= 500), F.lit(False))
    again = busy & (F.col("attempt") + 1 < MOST_ATTEMPTS)
    action = F.when(o.isin("timeout", "network"), "fail").when(again, "retry").when(busy | (code >= 400), "fail").otherwise("return")
    message = F.when(o == "timeout", TIMED_OUT).when(o == "network", NETWORK).when(busy & ~again, F.concat(F.lit("HTTP "), o, F.lit(" after retry"))).when(~busy & (code >= 400), F.concat(F.lit("HTTP "), o))
    return attempts.withColumns({"action": action, "wait": F.when(again, retry_wait(o, F.col("retry_after"), F.col("backoff"))), "message": message})


def schedule(arrivals: DataFrame, by: str, at_us: str, rate: Column, order: list[str], blocks: int = 1024) -> DataFrame:
    """Adds start_us: the earliest start of each request under its source's rate.

    start(i) = max(arrival(i), start(i-1) + gap), in closed form: the running
    maximum of arrival(i) - i * gap, plus i * gap. A source's time is cut into
    ``blocks``; counts and maxima of whole blocks are carried from one to the
    next, so a task sorts a block of a source, not a source. ``order`` begins
    with ``at_us``; a source's rate is the same for all its requests.
    """
    gap = (F.lit(1_000_000) / rate).cast("long")
    span = arrivals.groupBy(by).agg(F.min(at_us).alias("_a"), F.max(at_us).alias("_z"))
    block = F.floor((F.col(at_us) - F.col("_a")) / F.greatest((F.col("_z") - F.col("_a") + 1) / blocks, F.lit(1))).cast("int")
    df = arrivals.join(span, by).withColumns({"_gap": gap, "_block": block}).drop("_a", "_z")
    w = Window.partitionBy(by, "_block").orderBy(*order)
    df = df.withColumn("_i", (F.row_number().over(w) - 1).cast("long")).withColumn("_own", F.col(at_us) - F.col("_i") * F.col("_gap"))
    whole = df.groupBy(by, "_block").agg(F.count("*").alias("_n"), F.max("_own").alias("_most"), F.max("_gap").alias("_g"))
    past = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("_first", F.coalesce(F.sum("_n").over(past), F.lit(0)))
    whole = whole.withColumn("_carried", F.max(F.col("_most") - F.col("_first") * F.col("_g")).over(past)).select(by, "_block", "_first", "_carried")
    df = df.join(whole, [by, "_block"])
    here = F.max("_own").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_first") * F.col("_gap")
    start = F.greatest(here, F.col("_carried")) + (F.col("_first") + F.col("_i")) * F.col("_gap")
    return df.withColumn("start_us", start).drop("_i", "_gap", "_own", "_block", "_first", "_carried")


def provider_rate(provider: Column, has_key: Column, has_contact: Column) -> Column:
    """Requests a second that each source allows."""
    return F.when(provider == "pubmed", F.when(has_key, 10).otherwise(3)).when(provider == "crossref", F.when(has_contact, 3).otherwise(1))


def provider_status(outcomes: DataFrame) -> DataFrame:
    """(qid, provider, status, paper_count, error) from outcomes (qid, provider, failure, seconds, budget, paper_count).

    A source that failed or ran over its budget is in error and contributes
    nothing; only messages written here or by a source's own handler are shown.
    """
    over = F.coalesce(F.col("seconds") > F.col("budget"), F.lit(False))
    error = F.when(over, F.lit(BUDGET)).otherwise(F.col("failure"))
    return outcomes.select("qid", "provider", F.when(error.isNull(), "ok").otherwise("error").alias("status"), F.when(error.isNull(), F.col("paper_count")).otherwise(0).cast("int").alias("paper_count"), error.alias("error"))


def response_code(statuses: DataFrame) -> DataFrame:
    """(qid, code): 502 if there are sources and all are in error, else 200."""
    return statuses.groupBy("qid").agg(F.when(F.bool_and(F.col("status") == "error"), 502).otherwise(200).alias("code"))

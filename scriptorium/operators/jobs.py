"""Indexing jobs as a log of events: states, queue, progress, and what is kept."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import jobs as J
from scriptorium.operators.library import with_place

KINDS = ("queued", "started", "file_done", "file_failed", "finished", "failed")
KEPT = 40


def fold(events: DataFrame) -> DataFrame:
    """(job_id, status, queued_at, started_at, ended_at, processed, failed): each job's state.

    ``events`` has (job_id, at, event_id, kind). An event counts only in the state it
    belongs to: a start after the queue, files while running, an end after the start; later
    ends and files after the end are ignored, redelivered events (same event_id) count once.
    Jobs never queued have no row. Each step is an aggregate that is combined before it is
    shuffled, so a job with most of the events is no hot spot.
    """
    own = events.select("job_id", F.struct("at", "event_id").alias("t"), "kind").filter(F.col("kind").isin(*KINDS))
    first = own.filter("kind = 'queued'").groupBy("job_id").agg(F.min("t").alias("q"))
    begun = own.filter("kind = 'started'").join(first, "job_id").filter("t > q").groupBy("job_id").agg(F.min("t").alias("s"))
    ends = own.filter("kind in ('finished', 'failed')").join(begun, "job_id").filter("t > s").groupBy("job_id").agg(F.min(F.struct("t", "kind")).alias("e"))
    files = own.filter("kind in ('file_done', 'file_failed')").join(begun, "job_id").join(ends, "job_id", "left").filter("t > s and (e is null or t < e.t)")
    counts = files.distinct().groupBy("job_id").agg(F.count_if(F.col("kind") == "file_done").alias("processed"), F.count_if(F.col("kind") == "file_failed").alias("failed"))
    all_ = first.join(begun, "job_id", "left").join(ends, "job_id", "left").join(counts, "job_id", "left")
    status = F.when(F.col("e.kind") == "failed", "failed").when(F.col("e").isNotNull(), "done").when(F.col("s").isNotNull(), "running").otherwise("queued")
    return all_.select("job_id", status.alias("status"), F.col("q.at").alias("queued_at"), F.col("s.at").alias("started_at"), F.col("e.t.at").alias("ended_at"), F.coalesce("processed", F.lit(0)).alias("processed"), F.coalesce("failed", F.lit(0)).alias("failed"))


def active(status: Column) -> Column:
    return status.isin("running", "queued")


def queue(jobs: DataFrame, *keys: str) -> DataFrame:
    """Queued jobs with queue_position: the running ones, plus their own place in the queue."""
    running = jobs.groupBy(*keys).agg(F.count_if(F.col("status") == "running").alias("running"))
    placed = with_place(jobs.filter("status = 'queued'"), "queued_at", "job_id", keys=keys)
    if keys:
        marks = [F.equal_null(placed[k], running[k]) for k in keys]
        both = placed.join(running, functools.reduce(lambda a, b: a & b, marks)).select(placed["*"], "running")
    else:
        both = placed.withColumn("one", F.lit(1)).join(running.withColumn("one", F.lit(1)), "one").drop("one")
    return both.withColumn("queue_position", F.col("place") + F.col("running")).drop("place", "running")


def startable(jobs: DataFrame, at_once: int = 2, *keys: str) -> DataFrame:
    """Queued jobs that may start now, first come first served, so that ``at_once`` run at most."""
    return queue(jobs, *keys).filter(F.col("queue_position") <= at_once)


def snapshot(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs with percent, elapsed_seconds and eta_seconds at a time.

    ``jobs`` has status, phase, processed, total, current_file, ocr_page, ocr_page_total and
    the times started_ms and file_started_ms; ``now`` is in milliseconds as well.
    """
    c = F.col
    estimate = J.typical_ms(c("current_file"), c("ocr_page_total"))
    own = J.weight(c("current_file"), c("file_started_ms"), estimate, now, c("ocr_page"), c("ocr_page_total"))
    waiting = c("status") == "queued"
    return jobs.withColumns(
        {
            "percent": F.when(waiting, 0).otherwise(J.percent(c("processed"), c("total"), c("phase"), c("current_file"), own)),
            "elapsed_seconds": F.when(waiting, 0).otherwise(F.greatest(F.lit(0), J.rounded((now - c("started_ms")) / 1000))).cast("long"),
            "eta_seconds": F.when(waiting, None).otherwise(J.eta_seconds(c("started_ms"), c("processed"), c("total"), own, estimate, now)).cast("long"),
        }
    )


def listed(jobs: DataFrame, path: str = "") -> DataFrame:
    """Active jobs of interest in a folder, by queue position, then id."""
    own = jobs.filter(active(F.col("status")))
    if path:
        own = own.filter(J.matches_view(F.col("scope_path"), F.col("current_file"), F.lit(path)))
    return own.orderBy(F.coalesce("queue_position", F.lit(999)), "job_id")


def pruned(jobs: DataFrame, kept: int = KEPT, order: str = "started_at") -> DataFrame:
    """The jobs started last; a limit by order, not a window over all jobs in one task."""
    return jobs.orderBy(F.desc_nulls_last(order), F.desc("job_id")).limit(kept)


def accepted(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (slug, scope_path) for which no job is active."""
    busy = jobs.filter(active(F.col("status"))).select("slug", "scope_path")
    return requests.join(busy, ["slug", "scope_path"], "left_anti")


def first_active(jobs: DataFrame) -> DataFrame:
    """For each (slug, scope_path) the active job that was queued first, all its columns."""
    rest = [c for c in jobs.columns if c not in ("slug", "scope_path", "queued_at", "job_id")]
    own = jobs.filter(active(F.col("status"))).groupBy("slug", "scope_path").agg(F.min(F.struct("queued_at", "job_id", *rest)).alias("j"))
    return own.select("slug", "scope_path", "j.*")


def followed(refs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs that a user follows (job_id); those that are gone have no row, repeated ones one."""
    return jobs.join(refs.select("job_id").distinct(), "job_id", "left_semi")


def still_shown(jobs: DataFrame, now: Column, keep_ms: int = 8_000) -> DataFrame:
    """Jobs to show at a time (in milliseconds): active ones, and ended ones for eight seconds."""
    ended = F.unix_millis(F.col("ended_at").cast("timestamp"))
    return jobs.filter(active(F.col("status")) | (ended.isNotNull() & (now - ended < keep_ms)))


def page_progress(events: DataFrame) -> DataFrame:
    """(job_id, ocr_page, ocr_page_total): the page each job was last seen at, of events (job_id,
    at, event_id, page, total); reports without a total don't count."""
    seen = events.filter("total > 0").groupBy("job_id").agg(F.max(F.struct("at", "event_id", "page", "total")).alias("p"))
    return seen.select("job_id", F.col("p.page").alias("ocr_page"), F.col("p.total").alias("ocr_page_total"))


def settled_queries(typed: DataFrame, quiet: str = "350 milliseconds") -> DataFrame:
    """(user, at, query): what is searched for: the last thing a user typed before a pause. The
    same in batches and, with a watermark, in a stream."""
    typing = typed.groupBy("user", F.session_window("at", quiet).alias("w")).agg(F.max(F.struct("at", "query")).alias("q"))
    return typing.select("user", "q.at", "q.query")


def merged(shown: DataFrame, polled: DataFrame, key: str = "job_id", order: str = "updated_at") -> DataFrame:
    """Two lists of jobs as one: the newest state of each."""
    both = shown.unionByName(polled)
    rest = [c for c in both.columns if c not in (key, order)]
    return both.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("j")).select(key, f"j.{order}", *[f"j.{c}" for c in rest])


def rollup(events: DataFrame, at: str, every: str, *keys: str) -> DataFrame:
    """Events and their values per time window and key."""
    own = events.groupBy(F.window(at, every).alias("w"), *keys).agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return own.select(F.col("w.start").alias("window_start"), *keys, "events", "value")

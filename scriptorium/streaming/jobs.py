"""Streams of job events and of new files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "job_id string, status string, processed bigint, failed bigint, updated_at timestamp"
#: Which event moves a job from which states to which.
MOVES = {"queued": ((None,), "queued"), "started": (("queued",), "running"), "finished": (("running",), "done"), "failed": (("running",), "failed")}


def job_states(events: DataFrame, keep: str = "1 hour", forget_after_s: int = 7 * 86_400) -> DataFrame:
    """The state of each job after every micro-batch that holds events of it.

    ``events`` has (job_id, at, event_id, kind); redelivered events within ``keep`` count
    once, and events that a job's state doesn't admit are ignored, as in the batch fold. A job
    without events for ``forget_after_s`` seconds, by the events' times, is forgotten.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, processed, failed, at = state.get if state.exists else (None, 0, 0, None)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        for when, kind in zip(rows["at"], rows["kind"]):
            if kind in MOVES and status in MOVES[kind][0]:
                status, at = MOVES[kind][1], when
            elif kind in ("file_done", "file_failed") and status == "running":
                processed, failed, at = processed + (kind == "file_done"), failed + (kind == "file_failed"), when
        if status is not None:
            state.update((status, processed, failed, at))
            last = max(at, rows["at"].iloc[-1]).timestamp() * 1000
            state.setTimeoutTimestamp(int(max(last, state.getCurrentWatermarkMs())) + forget_after_s * 1000)
            yield pd.DataFrame({"job_id": [key[0]], "status": [status], "processed": [processed], "failed": [failed], "updated_at": [at]})

    once = events.withWatermark("at", keep).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("job_id").applyInPandasWithState(step, STATE, "status string, processed bigint, failed bigint, at timestamp", "update", GroupStateTimeout.EventTimeTimeout)


SESSION = "chat string, slug string, scope_path string, mode string, pending string"


def chat_states(events: DataFrame, late: str = "10 minutes", idle_s: int = 86_400) -> DataFrame:
    """The session of each chat after every micro-batch that holds events of it, by the rules of
    the batch operator; a chat that is idle for ``idle_s`` seconds begins anew.

    ``events`` has (chat, at, event_id, kind, value).
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        slug, scope, mode, pending = state.get if state.exists else ("", "", "none", None)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        for kind, value in zip(rows["kind"], rows["value"]):
            if kind == "direction":
                slug, scope, mode, pending = value, "", "none", None
            elif kind == "folder":
                scope, pending = value, None
            elif kind == "mode":
                mode = value
            elif kind == "question":
                pending = value
            elif kind == "answered":
                pending = None
        state.update((slug, scope, mode, pending))
        last = rows["at"].iloc[-1].timestamp() * 1000
        state.setTimeoutTimestamp(int(max(last, state.getCurrentWatermarkMs())) + idle_s * 1000)
        yield pd.DataFrame({"chat": [key[0]], "slug": [slug], "scope_path": [scope], "mode": [mode], "pending": [pending]})

    once = events.withWatermark("at", late)
    return once.groupBy("chat").applyInPandasWithState(step, SESSION, "slug string, scope_path string, mode string, pending string", "update", GroupStateTimeout.EventTimeTimeout)


def progress(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per window and kind; later ones than ``late`` are dropped."""
    own = events.withWatermark("at", late).groupBy(F.window("at", every).alias("w"), "kind").agg(F.count("*").alias("events"))
    return own.select(F.col("w.start").alias("window_start"), "kind", "events")


def new_files(spark: SparkSession, folder: str, files_at_once: int = 2) -> DataFrame:
    """(path, modified_at, size, content) of files as they arrive, a few per micro-batch."""
    own = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", "true").load(folder)
    return own.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"), "content")


def ingest(files: DataFrame, root: str, store, checkpoint: str):
    """Extract files of a stream and hand each micro-batch to ``store(frame, number)``.

    ``files`` is a stream of ``new_files`` below ``root``, or of the tree's ``arrivals``, which also
    sees names that begin with '_'. A micro-batch that is repeated after a failure has the same number, so a store that
    writes by number holds every file once. One broken file is a row with an error.
    """
    from scriptorium.sources.extract import extract

    if "slug" in files.columns:
        own = files.select("slug", "path", "content")
        return own.writeStream.foreachBatch(lambda df, n: store(extract(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    inside = F.split(F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), f"^.*{root.rstrip('/')}/", ""), "/")
    own = files.select(F.element_at(inside, 1).alias("slug"), F.array_join(F.slice(inside, 2, 1000), "/").alias("path"), "content")
    return own.writeStream.foreachBatch(lambda df, n: store(extract(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""File queues as streams: bounded batches, completion counts, stale claims, event-time windows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def pending(spark: SparkSession, path: str, schema: str, most: int = 100) -> DataFrame:
    """New JSON files of a folder, ``most`` in a batch; hidden files are passed over. The checkpoint is the claim."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most).option("latestFirst", "false").json(path)


def archived(spark: SparkSession, path: str, schema: str, archive: str, most: int = 100) -> DataFrame:
    """As :func:`pending`; files that a finished batch has read move to ``archive``, outside ``path``, under their own path."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", most).option("cleanSource", "archive").option("sourceArchiveDir", archive).json(path)
    )


def quarantined(spark: SparkSession, path: str, schema: str, target: str, poison: str, checkpoint: str, required: list[str] | None = None) -> StreamingQuery:
    """Work off the lines that are there: good records go to ``target``, others with file and ``error`` to ``poison``.

    A line that is no JSON of the schema, or lacks a ``required`` field, is poison. A batch that is run again after a
    loss writes the same folder of each side again, so no line is in the result twice.
    """
    lines = spark.readStream.text(path).where("trim(value) <> ''").select(
        F.col("_metadata.file_path").alias("file"), "value", F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")
    )
    missing = F.lit(False)
    for f in required or []:
        missing = missing | F.col(f"r.{f}").isNull()
    error = F.when(F.col("r._corrupt_record").isNotNull(), "no record").when(missing, "missing field")

    def write(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("error", error)
        marked.where("error IS NULL").select("r.*").drop("_corrupt_record").write.mode("overwrite").json(f"{target}/batch={number}")
        marked.where("error IS NOT NULL").select("file", "value", "error").write.mode("overwrite").json(f"{poison}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(rows: DataFrame, target: str, checkpoint: str, form: str = "parquet", mode: str = "append") -> StreamingQuery:
    """Work off what is there, then stop; run again to go on behind it. Each file is in the result once."""
    return rows.writeStream.format(form).option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def completions(events: DataFrame, index: str, image: str, ok: str, expected: int) -> DataFrame:
    """``index``, ``n_done``, ``n_valid``, once ``expected`` different images have ended with two good ones.

    Failures count as ended; a repeated report of an image counts once. An index is emitted once. State is a
    map with at most ``expected`` entries for each open index, and one flag for each that is done.
    """
    kind = dict(events.dtypes)[index]

    def update(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, sent = (dict(zip(*state.get[:2], strict=True)), state.get[2]) if state.exists else ({}, False)
        for pdf in batches:
            for i, good in zip(pdf[image], pdf[ok], strict=True):
                seen[int(i)] = bool(seen.get(int(i), False) or good)
        done = not sent and len(seen) >= expected
        valid = sum(seen.values())
        state.update((list(seen), [bool(v) for v in seen.values()], bool(sent or done)))
        if done and valid >= 2:
            yield pd.DataFrame({index: [key[0]], "n_done": [len(seen)], "n_valid": [valid]})

    return events.groupBy(index).applyInPandasWithState(
        update, f"{index} {kind}, n_done int, n_valid int", "images array<int>, good array<boolean>, sent boolean", "append", GroupStateTimeout.NoTimeout
    )


def stale(claims: DataFrame, claimed_at: Column, now: Column, seconds: float) -> DataFrame:
    """Claims that are at least so old, to be put back."""
    return claims.where(now.cast("timestamp").cast("double") - claimed_at.cast("timestamp").cast("double") >= seconds)


def reparked(tasks: DataFrame, state: str, claimed_at: str, now: Column, seconds: float) -> DataFrame:
    """``tasks`` with claims that are at least so old pending again, without a time of claim; others as they were."""
    old = (F.col(state) == "claimed") & F.coalesce(now.cast("timestamp").cast("double") - F.col(claimed_at).cast("timestamp").cast("double") >= seconds, F.lit(False))
    return tasks.withColumns({state: F.when(old, F.lit("pending")).otherwise(F.col(state)), claimed_at: F.when(~old, F.col(claimed_at))})


def depth(tasks: DataFrame, state: str) -> DataFrame:
    """How many tasks are in each state."""
    return tasks.groupBy(state).agg(F.count(F.lit(1)).alias("n"))


def progress(tasks: DataFrame, queue: str, state: str, done_at: str, now: Column, window: float = 3600.0) -> DataFrame:
    """For every queue: tasks by state, share done, those done in the last ``window`` seconds and, at that rate, the
    seconds that the others take; null without any done lately."""
    lately = (F.col(state) == "done") & (now.cast("timestamp").cast("double") - F.col(done_at).cast("timestamp").cast("double") < window)
    n = tasks.groupBy(queue).agg(*[F.count_if(F.col(state) == s).alias(s) for s in ("pending", "claimed", "done")], F.count_if(lately).alias("lately"), F.count(F.lit(1)).alias("n"))
    return n.select(queue, "pending", "claimed", "done", (F.col("done") / F.col("n")).alias("share_done"), "lately", F.try_divide((F.col("pending") + F.col("claimed")) * F.lit(window), F.col("lately")).alias("seconds_left"))


def with_retries(call: Callable[[Any], Any], tries: int, wait: Callable[[int], float], keys: list[str] | None = None, sleep: Callable[[float], None] = time.sleep) -> Callable[[Any], Any]:
    """A call that is tried again after a failure, ``wait(k)`` seconds after the k-th, with the next of ``keys`` in turn.

    The call takes the request and, if there are keys, ``key``. The last failure is raised.
    """
    def run(request: Any) -> Any:
        for k in range(tries):
            try:
                return call(request, key=keys[k % len(keys)]) if keys else call(request)
            except Exception:
                if k + 1 == tries:
                    raise
                sleep(wait(k + 1))
        raise ValueError("tries is at least 1")

    return run


# How long is waited after the k-th failure.
WAITS: dict[str, Callable[[int], float]] = {"judge": lambda k: min(1.01**k, 60.0), "grader": lambda k: 1.5**k, "claims": lambda k: 2.0**k * 2.0}


def windowed(events: DataFrame, time: str, key: str, value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums in event-time windows; rows later than ``late`` behind the newest are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(
        F.col("window.start").alias("start"), key, "n", "total"
    )

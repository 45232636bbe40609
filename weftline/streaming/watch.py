"""File events as a stream: debounce, coalescing, and applying them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import pick


def debounce(events: DataFrame, key: str, time: str, gap: str = "2 seconds", late: str | None = "10 minutes") -> DataFrame:
    """(key, first_at, last_at, n_events): one row per burst of events of a key
    with no pause of `gap` between them, in a stream or in a batch. The state is
    one session per key; events later than the watermark are dropped by the
    stream, a batch (late=None) has none."""
    e = events.select(F.col(key).alias("key"), F.col(time).alias("_t"))
    if late is not None and e.isStreaming:
        e = e.withWatermark("_t", late)
    w = F.session_window("_t", gap)
    g = e.groupBy("key", w).agg(F.min("_t").alias("first_at"), F.max("_t").alias("last_at"), F.count(F.lit(1)).alias("n_events"))
    return g.select("key", "first_at", "last_at", "n_events")


def coalesce_requests(batch: DataFrame) -> DataFrame:
    """Requests (kind: index or reindex, path, at, seq) of one batch as few as
    do the same work: of equal ones the last; an index request makes earlier
    reindex requests of its repository (path) needless."""
    one = pick(batch, ["kind", "path"], [F.col("at"), F.col("seq")])
    full = one.where("kind = 'index'").select(F.col("path").alias("_p"), F.struct("at", "seq").alias("_w"))
    j = one.join(full, F.col("path") == F.col("_p"), "left")
    return j.where((F.col("kind") == "index") | F.col("_w").isNull() | (F.struct("at", "seq") > F.col("_w"))).drop("_p", "_w")


def run_writer(requests: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """One writer for a stream of requests: each micro-batch is coalesced and
    handed to apply, which gets the batch number to make repeats harmless. The
    single query is the queue, so writes never overlap."""

    def step(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            apply(coalesce_requests(batch), number)

    w = requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="2 seconds")).start()


def watch_files(spark, folder: str, schema: str = "path string, change string, at timestamp") -> DataFrame:
    """Change events that some watcher drops as JSON lines into a folder."""
    return spark.readStream.schema(schema).json(folder)

"""Streams over vacancy observations: inventory upkeep, liveness, run health."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from talentmesh.operators import inventory_store

OBSERVATION_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def observed(spark: SparkSession, folder: str, schema: str = OBSERVATION_SCHEMA,
             files_per_batch: int = 100) -> DataFrame:
    """File stream of raw observations."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    )


def deduplicated(stream: DataFrame, keys: list[str], delay: str = "2 days") -> DataFrame:
    """First sighting of every key within the watermark; state older than it is dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def keep_inventory(
    stream: DataFrame, path: str, checkpoint: str, to_rows, buckets: int = inventory_store.BUCKETS, ties: tuple[str, ...] = ()
) -> StreamingQuery:
    """Merge every micro-batch into the inventory store at ``path``.

    Batch n writes version n + 1, of which only the buckets that its keys fall into are new. A
    repeated batch writes the same rows again, and late rows only extend first sightings.
    ``to_rows`` turns raw observations into inventory rows with ``seen_at`` and the ``ties``.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        inventory_store.merge_version(to_rows(batch), path, batch_id + 1, f"batch-{batch_id}", buckets, ties=ties)

    return (
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def run_health(stream: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Rows and failures of every source in tumbling windows."""
    return (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "source")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("ok")).alias("failures"))
        .select(F.col("window.start").alias("start"), "source", "rows", "failures")
    )


def latest_windows(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """The newest state of every window, those still open included.

    Update mode hands over what a batch changed; each batch has a folder of its own, so a batch
    that runs again replaces it. Windows past the watermark leave the state.
    """
    spark = stream.sparkSession

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    run = (
        stream.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    rows = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return newest.select(*keys, *[F.col(f"last.{c}").alias(c) for c in values])


#: A sighting of this vacancy only moves the clock of the stream on.
CLOCK = ""


#: Groups that vacancies are dealt to; the state of a group is read and written as a whole.
LIVENESS_GROUPS = 256


class Liveness(StatefulProcessor):
    """Opens, expires and reopens vacancies by the gaps between their sightings, in order of time.

    Sightings wait until the watermark has passed them, so that the order in which they arrive
    does not matter. A vacancy without one for ``ttl_ms`` expires; it is remembered ``forget_ms``
    longer, as one that can reopen, and then leaves the state. Keys are groups of vacancies, worked
    through as columns, since every call for a key and every access to its state costs far more
    than a sighting. Each key has one timer, for what comes first: a waiting sighting, an
    expiry, or the end of a vacancy's memory.
    """

    def __init__(self, ttl_ms: int, forget_ms: int) -> None:
        self.ttl_ms, self.forget_ms = ttl_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "vacancy array<string>, last_ms array<bigint>, open array<boolean>")
        self.waiting = handle.getListState("waiting", "vacancy array<string>, at_ms array<bigint>")
        self.timer = handle.getValueState("timer", "at_ms bigint")

    def _set_timer(self, before: int | None, at_ms: int | None) -> None:
        if at_ms == before:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if at_ms is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at_ms)
            self.timer.update((at_ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat([f[["vacancy", "ts"]] for f in rows])
        seen = seen[seen["vacancy"] != CLOCK]
        if len(seen):
            at = seen["ts"].to_numpy().astype("datetime64[ms]").astype("int64")
            self.waiting.appendList([(seen["vacancy"].tolist(), at.tolist())])
            timer = self.timer.get()
            before, first = timer[0] if timer else None, int(at.min())
            if before is None or first < before:
                self._set_timer(before, first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        pages = list(self.waiting.get())
        waiting = pd.DataFrame({
            "vacancy": pd.Series([v for p in pages for v in p[0]], dtype=object), "at_ms": pd.Series([t for p in pages for t in p[1]], dtype="int64")})
        kept = self.known.get() or ([], [], [])
        known = pd.DataFrame({
            "vacancy": pd.Series(kept[0], dtype=object), "at_ms": pd.Series(kept[1], dtype="int64"), "open": pd.Series(kept[2], dtype=bool)})
        is_due = waiting["at_ms"] <= clock
        due, later = waiting[is_due].sort_values("at_ms"), waiting[~is_due]

        # What is known of a vacancy stands before its sightings; every other row has just been open.
        line = pd.concat([known, due.assign(open=True)], ignore_index=True).sort_values("vacancy", kind="stable")
        of = line.groupby("vacancy", sort=False)
        line = line.assign(before=of["at_ms"].shift(fill_value=0), was_open=of["open"].shift(fill_value=False), nth=of.cumcount())
        line = line[line.index >= len(known)]
        gap = line["was_open"] & (line["at_ms"] > line["before"] + self.ttl_ms)
        starts = line[gap | ~line["was_open"]]
        back = (starts["nth"] > 0) & (starts["at_ms"] <= starts["before"] + self.ttl_ms + self.forget_ms)
        last = pd.concat([known, due.assign(open=True)]).drop_duplicates("vacancy", keep="last")
        out = last["open"] & (clock > last["at_ms"] + self.ttl_ms)
        changes = pd.concat([
            pd.DataFrame({"vacancy": starts["vacancy"], "status": back.map({True: "reopened", False: "opened"}), "at_ms": starts["at_ms"]}),
            *[pd.DataFrame({"vacancy": v, "status": "expired", "at_ms": t + self.ttl_ms}) for v, t in (
                (line["vacancy"][gap], line["before"][gap]), (last["vacancy"][out], last["at_ms"][out]))]])

        last = last.assign(open=last["open"] & ~out)
        last = last[last["open"] | (clock <= last["at_ms"] + self.ttl_ms + self.forget_ms)]
        if len(last):
            self.known.update((last["vacancy"].tolist(), last["at_ms"].tolist(), last["open"].tolist()))
        else:
            self.known.clear()
        if len(later):
            self.waiting.put([(later["vacancy"].tolist(), later["at_ms"].tolist())])
        else:
            self.waiting.clear()
        ends = last["at_ms"] + self.ttl_ms + 1 + (~last["open"]) * self.forget_ms
        self._set_timer(None, min([*later["at_ms"].nsmallest(1).tolist(), *ends.nsmallest(1).tolist()], default=None))
        if len(changes):
            yield changes

    def close(self) -> None:
        pass


def liveness(stream: DataFrame, ttl_ms: int, delay: str = "1 hour", forget_ms: int = 0, groups: int = LIVENESS_GROUPS) -> DataFrame:
    """``vacancy, status, at_ms`` changes of every vacancy (event-time timers).

    Sightings more than ``delay`` behind the newest one may be dropped. A last sighting of
    ``CLOCK``, later than ``ttl_ms`` + ``forget_ms`` + ``delay`` after all others, closes and
    forgets every vacancy. The state of one of the ``groups`` has to fit into a Python worker.
    """
    group = F.pmod(F.xxhash64("vacancy"), F.lit(groups)).cast("int")
    return (
        stream.select("vacancy", "ts", group.alias("group")).withWatermark("ts", delay).groupBy("group")
        .transformWithStateInPandas(
            Liveness(ttl_ms, forget_ms), "vacancy string, status string, at_ms bigint", "Append", "EventTime")
    )

"""The engine as a stream: each micro-batch is a poll.

State is a set of Parquet tables with one folder for each batch id. A batch reads the folders
of the batch before it and writes its own, so a batch that runs again after a failure gives
the same state; older folders are removed. If the settings name a session snapshot, a stream
without a state of its own starts from it, and it is written again after polls, once in the
settings' interval. Samples go to a sink function; a repeated batch sends the same series
with the same stamps.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillmark import schema
from rillmark.config import Settings
from rillmark.operators import flushes, sessions, viewers, watch
from rillmark.operators.metrics import STANDARD, label_names, minute_metrics
from rillmark.plans.samples import samples
from rillmark.sources import logs, snapshot

Sink = Callable[[DataFrame, int], None]
_DIMENSIONS = ["stream", "device_type", "country", "track", "region"]


class EdgeLogStream:
    """Folds batches of log lines into samples and state.

    ``clock`` gives the wall clock in milliseconds for the retention and for flush offsets that
    are forgotten; without it the latest event time stands for both.
    """

    def __init__(self, spark: SparkSession, state_dir: str, sink: Sink, settings: Settings | None = None, geo: DataFrame | None = None, clock: Callable[[], int] | None = None) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.state_dir, self.sink = spark, state_dir.rstrip("/"), sink
        self.settings, self.geo, self.clock = settings or Settings(), geo, clock
        self._saved: float | None = None
        self._totals = None  # schema of the watch totals

    def start(self, path: str, checkpoint: str, trigger: dict | None = None, files_per_batch: int | None = None, clean: str | None = None, archive: str | None = None, lookback_hours: int = 0) -> StreamingQuery:
        lines = logs.stream_lines(self.spark, path, files_per_batch, clean, archive, lookback_hours)
        return lines.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def _path(self, table: str, batch: int) -> str:
        return f"{self.state_dir}/{table}/batch={batch}"

    def _before(self, table: str, batch: int, shape) -> DataFrame:
        """The table as the latest earlier batch left it."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        root = fs_path(f"{self.state_dir}/{table}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        ids = [int(f.getPath().getName().partition("=")[2]) for f in fs.listStatus(root)] if fs.exists(root) else []
        done = [i for i in ids if i < batch and fs.exists(fs_path(f"{self._path(table, i)}/_SUCCESS"))]
        if not done:
            seed = self._seed(table)
            return self.spark.createDataFrame([], shape) if seed is None else seed
        return self.spark.read.schema(shape).parquet(self._path(table, max(done)))

    def _seed(self, table: str) -> DataFrame | None:
        """State of the snapshot that the settings name, for a stream without a batch of its own."""
        path = self.settings.session_state_path
        if table not in ("sessions", "watch") or not path or not Path(path).exists():
            return None
        state, totals = snapshot.load(self.spark, path)
        return state if table == "sessions" else totals

    def _save(self, batch: int) -> None:
        """Write the snapshot that the settings name, at most once in their interval."""
        s, now = self.settings, time.monotonic()
        if not s.session_state_path or (self._saved is not None and now - self._saved < s.session_state_interval_seconds):
            return
        snapshot.save(self.state("sessions", batch), self.state("watch", batch, self._totals), s.session_state_path, s.session_window_seconds, s.session_gap_seconds)
        self._saved = now

    def _forget(self, batch: int) -> None:
        """Remove what no batch can ask for any more: all but this batch and the one before it."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        for table in ("clock", "flushes", "sessions", "watch"):
            root = fs_path(f"{self.state_dir}/{table}")
            fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for f in fs.listStatus(root) if fs.exists(root) else []:
                if int(f.getPath().getName().partition("=")[2]) < batch - 1:
                    fs.delete(f.getPath(), True)

    def _keep(self, df: DataFrame, table: str, batch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(table, batch))
        return self.spark.read.schema(df.schema).parquet(self._path(table, batch))

    def state(self, table: str, batch: int, shape=schema.SESSION) -> DataFrame:
        """A state table as batch ``batch`` left it."""
        return self._before(table, batch + 1, shape)

    def process(self, lines: DataFrame, batch: int) -> None:
        """One micro-batch: metrics and viewers of its minutes, then the session gauges."""
        began = time.monotonic()
        lines = lines.where(F.rlike("value", F.lit(r"\S")))
        if "line" not in lines.columns:
            lines = lines.withColumn("line", logs.line_place("split" if "split" in lines.columns else F.lit(0)))
        parsed = logs.events(logs.parsed(lines), keep=("file", "line"))
        parsed = sessions.in_arrival_order(parsed).persist()
        try:
            latest = parsed.agg(F.max(F.unix_micros("timestamp"))).first()[0]
            before = self._before("clock", batch, "micros long").agg(F.max("micros")).first()[0]
            ref_micros = max((x for x in (latest, before) if x is not None), default=None)
            if ref_micros is None:
                # no event was ever seen, so the files' report has no other clock
                wall = self.clock() if self.clock else time.time_ns() // 1_000_000
                self.sink(reduce(DataFrame.unionByName, self._reports(lines, parsed, wall * 1000, began, latest is not None)), batch)
                return
            self._keep(self.spark.createDataFrame([(ref_micros,)], "micros long"), "clock", batch)
            ref = F.timestamp_micros(F.lit(ref_micros))
            now_ms = self.clock() if self.clock else ref_micros // 1000
            parts = [self._flushed(parsed, batch, now_ms), self._gauges(parsed, batch, ref, ref_micros, now_ms)]
            parts += self._reports(lines, parsed, ref_micros, began, latest is not None)
            self.sink(reduce(DataFrame.unionByName, parts), batch)
            self._save(batch)
            self._forget(batch)
        finally:
            parsed.unpersist()

    def _samples(self, metrics: DataFrame, labels: list[str], now_ms: int | None, prefix: str = "") -> DataFrame:
        return samples(metrics, labels, now_ms, legacy=self.settings.legacy_stream_name, prefix=prefix)

    def _flushed(self, events: DataFrame, batch: int, now_ms: int) -> DataFrame:
        """Per-minute metrics and viewers, each minute with its flush offset."""
        s = self.settings
        state = self._before("flushes", batch, "minute timestamp, n long, first_flush timestamp")
        now = F.timestamp_millis(F.lit(now_ms))
        after, _ = flushes.next_offsets(state, events.select("minute"), now, s.startup_offset_ms)
        after = self._keep(after, "flushes", batch)
        minutes = events.select("minute").distinct()
        offsets = after.join(minutes, "minute").select("minute", (F.col("n") * flushes.STEP_MS + s.startup_offset_ms).alias("offset_ms"))
        stamp = F.unix_millis("minute") + F.col("offset_ms")
        timed = lambda m: m.join(offsets, "minute").withColumn("timestamp_ms", stamp).drop("minute", "offset_ms")
        metrics = timed(minute_metrics(events, STANDARD))
        gauges = timed(viewers.minute_viewers(events, self.geo))
        return self._samples(metrics, label_names(STANDARD), now_ms, s.metric_prefix).unionByName(self._samples(gauges, _DIMENSIONS, None, s.metric_prefix))

    def _gauges(self, events: DataFrame, batch: int, ref: Column, ref_micros: int, now_ms: int) -> DataFrame:
        """Sessions advanced by the batch, unique viewers in the window and watch time so far."""
        s = self.settings
        before = self._before("sessions", batch, schema.SESSION)
        state, closed = sessions.advance(before, sessions.session_events(events, self.geo), ref, s.session_gap_seconds, s.session_window_seconds)
        state = self._keep(state, "sessions", batch)
        fresh = watch.watch_totals(closed)
        self._totals = fresh.schema
        totals = self._keep(watch.add_totals(self._before("watch", batch, fresh.schema), fresh), "watch", batch)
        at = ref_micros // 60_000_000 * 60_000 + s.startup_offset_ms
        unique = sessions.unique_gauges(state, ref, s.unique_window_seconds).withColumn("window", F.lit(s.window_label))
        watched = watch.watch_metrics(totals)
        stamped = lambda m: m.withColumn("timestamp_ms", F.lit(at).cast("long"))
        return self._samples(stamped(unique), ["stream", "device_type", "country", "region", "window"], now_ms, s.metric_prefix).unionByName(
            self._samples(stamped(watched), ["stream", "le", "band"], now_ms, s.metric_prefix)
        )

    def _reports(self, lines: DataFrame, events: DataFrame, ref_micros: int, began: float, any_event: bool) -> list[DataFrame]:
        """Lines of each file, the seconds that the batch took so far, and unmatched agents if there are any.

        A batch of lines without an event has the result ``failure``.
        """
        s = self.settings
        at = F.lit(ref_micros // 60_000_000 * 60_000).cast("long")
        files = logs.file_report(lines).select(
            F.lit("file_lines_processed_total").alias("metric_name"), F.when(F.col("events") > 0, "success").otherwise("failure").alias("result"), "file",
            F.col("lines").cast("double").alias("value"), at.alias("timestamp_ms"),
        )
        took = self.spark.createDataFrame([("file_process_time_seconds", "success" if any_event or lines.isEmpty() else "failure", time.monotonic() - began)], "metric_name string, result string, value double")
        out = [self._samples(files, ["result", "file"], None, s.metric_prefix), self._samples(took.withColumn("timestamp_ms", at), ["result"], None, s.metric_prefix)]
        if s.unmatched_logging:
            total = flushes.unmatched_summary(events, s.unmatched_max_tracked).where("total > 0")
            undefined = total.select(F.lit("viewer_undefined_devices_total").alias("metric_name"), F.col("total").cast("double").alias("value"), at.alias("timestamp_ms"))
            out.append(self._samples(undefined, [], None, s.metric_prefix))
        return out

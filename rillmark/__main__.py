"""Run polls over a folder of logs: ``python -m rillmark --input s3a://bucket/logs --state ... --checkpoint ...``."""

from __future__ import annotations

import argparse
import os
import sys
import time
from itertools import islice

from pyspark.sql import DataFrame, SparkSession

from rillmark.config import Settings
from rillmark.sources import remote_write
from rillmark.sources.logs import hour_glob
from rillmark.streaming.stream import EdgeLogStream

#: Lines of standard input that make a poll.
STDIN_LINES = 100_000


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    env = os.environ.get
    parser = argparse.ArgumentParser(prog="rillmark", description=__doc__)
    parser.add_argument("--input", required=True, help="folder of compressed NDJSON logs, read with all below it; - for lines of standard input")
    parser.add_argument("--state", required=True, help="shared folder for state tables")
    parser.add_argument("--checkpoint", required=True, help="shared folder for the stream's checkpoint")
    parser.add_argument("--url", default=env("PROMETHEUS_URL"), help="remote-write endpoint; without it samples go to --output")
    parser.add_argument("--user", default=env("PROMETHEUS_USER"))
    parser.add_argument("--password", default=env("PROMETHEUS_PASSWORD"))
    parser.add_argument("--output", help="folder for samples as JSON lines, one for each batch")
    parser.add_argument("--geo", help="Parquet table client_ip, country, region")
    parser.add_argument("--poll-interval", type=int, default=60, help="seconds between polls")
    parser.add_argument("--lookback-hours", type=int, default=0, help="leave files older than this before the newest; 0 reads all")
    parser.add_argument("--hours", type=int, help="read only the folders YYYYMMDD/HH of so many last hours, listed anew at each poll")
    parser.add_argument("--files-per-poll", type=int, help="1 flushes after each file")
    parser.add_argument("--clean", choices=("delete", "archive"), help="what becomes of processed files")
    parser.add_argument("--archive", help="folder for archived files")
    parser.add_argument("--once", action="store_true", help="handle what is there and stop")
    args = parser.parse_args(argv)
    if not (args.url or args.output):
        parser.error("give --url or --output")
    return args


def sink_of(args: argparse.Namespace, settings: Settings):
    """Where a batch's samples go."""
    if not args.url:
        return lambda samples, batch: remote_write.write_json(samples, f"{args.output.rstrip('/')}/batch={batch}")
    endpoint = remote_write.Endpoint(
        args.url, args.user, args.password, settings.retry_max_attempts, settings.retry_base_seconds, settings.retry_max_seconds
    )

    def send(samples: DataFrame, batch: int) -> None:
        remote_write.write_samples(samples, endpoint)

    return send


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args, settings = arguments(argv), Settings.from_env()
    spark = spark or SparkSession.builder.appName("rillmark").getOrCreate()
    geo = spark.read.parquet(args.geo) if args.geo else None
    stream = EdgeLogStream(spark, args.state, sink_of(args, settings), settings, geo)
    trigger = {"availableNow": True} if args.once else {"processingTime": f"{max(1, args.poll_interval)} seconds"}
    if args.input == "-":
        for batch, lines in enumerate(iter(lambda: list(islice(sys.stdin, STDIN_LINES)), [])):
            stream.process(spark.createDataFrame([(x, "-", batch * STDIN_LINES + i) for i, x in enumerate(lines)], "value string, file string, line long"), batch)
        return
    while True:
        path = hour_glob(args.input, args.hours) if args.hours else args.input
        # with hours each poll is a run of its own, since a running stream keeps its first pattern
        now = {"availableNow": True} if args.hours else trigger
        stream.start(path, args.checkpoint, now, args.files_per_poll, args.clean, args.archive, args.lookback_hours).awaitTermination()
        if args.once or not args.hours:
            return
        time.sleep(max(1, args.poll_interval))


if __name__ == "__main__":
    main()

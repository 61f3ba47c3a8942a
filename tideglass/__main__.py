"""Command line: incident reports, replay, stress.

    python -m tideglass report PATH [--incident ID] [--analysis FILE]
    python -m tideglass replay -f FILE [-r RATE] [-s K] [-d RATE] [--drift-rate RATE] [--no-update-timestamps]
    python -m tideglass stress [-r RATE] [-t SECONDS | -n COUNT] [-c CONNECTIONS]
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .sources import jsonl, replay
from .sources.synthetic import synthetic_ticks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tideglass")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("report", help="write the Markdown reports of incident bundles")
    one.add_argument("path")
    one.add_argument("--incident", action="append", help="only this incident (may be repeated)")
    one.add_argument("--analysis", help="a text to append to each report")
    to = argparse.ArgumentParser(add_help=False)
    to.add_argument("--host", default=os.environ.get("P2_HOST", "localhost"))
    to.add_argument("--port", type=int, default=int(os.environ.get("P2_PORT", "9001")))
    two = commands.add_parser("replay", parents=[to], help="send recorded events")
    two.add_argument("-f", "--file", required=True)
    two.add_argument("-r", "--rate", type=float, default=0.0)
    two.add_argument("-s", "--shuffle-window", type=int, default=0)
    two.add_argument("-d", "--duplicate-rate", type=float, default=0.0)
    two.add_argument("--drift-rate", type=float, default=0.0)
    two.add_argument("--no-update-timestamps", action="store_true")
    two.add_argument("--seed", type=int, default=0)
    three = commands.add_parser("stress", parents=[to], help="send made-up events")
    three.add_argument("-r", "--rate", type=float, default=1000.0)
    three.add_argument("-t", "--duration", type=float)
    three.add_argument("-n", "--count", type=int)
    three.add_argument("-c", "--connections", type=int, default=1)
    three.add_argument("-s", "--symbol")
    three.add_argument("--seed", type=int, default=0)
    return top


def events_to_send(rate: float, duration: float | None, count: int | None) -> int:
    """The lesser of a count and of rate times duration; ten seconds' worth if neither is given."""
    if duration is None and count is None:
        duration = 10.0
    limits = [] if duration is None or rate <= 0 else [int(rate * duration)]
    if not limits and count is None:
        raise ValueError("without a rate give a count")
    return min(limits + ([] if count is None else [count]))


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Returns how many reports or events were written or sent."""
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("tideglass").getOrCreate()
    if a.command == "report":
        text = open(a.analysis, encoding="utf-8").read() if a.analysis else None
        ids = a.incident or [r[0] for r in jsonl.read_bundles(spark, a.path)[0].select("incident_id").collect()]
        jsonl.write_reports(spark, a.path, None, ids, {i: text for i in ids} if text is not None else None)
        return len(ids)
    if a.command == "replay":
        return replay.replay(spark, a.file, a.host, a.port, a.rate, a.shuffle_window, a.duplicate_rate, a.drift_rate, not a.no_update_timestamps, a.seed)
    ticks = synthetic_ticks(spark, events_to_send(a.rate, a.duration, a.count), a.seed)
    if a.symbol:
        ticks = ticks.withColumn("product_id", F.lit(a.symbol))
    return replay.stress(ticks, a.host, a.port, a.rate, a.connections)


if __name__ == "__main__":
    main()

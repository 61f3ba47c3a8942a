"""Paced sending of recorded or made-up ticks over TCP, as length-framed JSON."""

from __future__ import annotations

import socket
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chaos
from .frames import frame
from .jsonl import read_lines


class TokenBucket:
    """Lets `rate` events a second go, up to `burst` at once after a pause; it starts empty. A rate of 0 never waits."""

    def __init__(self, rate: float, burst: float = 10.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = 0.0, clock()

    def take(self) -> float:
        """Waits for a token and takes it; returns the seconds waited."""
        if self.rate <= 0:
            return 0.0
        now = self.clock()
        self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        wait = max(0.0, (1.0 - self.tokens) / self.rate)
        if wait:
            self.sleep(wait)
            self.at = self.clock()
            self.tokens = 0.0
        else:
            self.tokens -= 1.0
        return wait


def transformed(lines: DataFrame, shuffle_window: int = 0, duplicate_rate: float = 0.0, drift_rate: float = 0.0, seed: int = 0) -> DataFrame:
    """(arrival_seq, raw) with the chaos transforms in their order: shuffle, duplicate, drift."""
    rows = chaos.shuffle(lines.select("arrival_seq", "raw"), shuffle_window, seed)
    rows = chaos.duplicate(rows, duplicate_rate, seed)
    return chaos.inject_drift(rows, drift_rate, seed).select("arrival_seq", "raw") if drift_rate > 0 else rows


def restamped(raw: str, at_ms: int) -> str:
    """The JSON object with its ingest time replaced, or added."""
    import json

    event = json.loads(raw)
    if isinstance(event, dict):
        event["ingest_ts_ms"] = at_ms
    return json.dumps(event, separators=(",", ":"), ensure_ascii=False)


def send(rows: DataFrame, host: str, port: int, rate: float = 0.0, restamp: bool = True) -> int:
    """Sends raw in arrival order over one connection; returns how many went.

    A connection is one order, so one process sends; rows come to it
    partition by partition. A peer that hangs up ends the sending.
    """
    bucket, sent = TokenBucket(rate), 0
    with socket.create_connection((host, port)) as peer:
        try:
            for r in rows.orderBy("arrival_seq").select("raw").toLocalIterator(prefetchPartitions=True):
                text = restamped(r["raw"], time.time_ns() // 1_000_000) if restamp else r["raw"]
                peer.sendall(frame(text.encode()))
                sent += 1
                bucket.take()
        except (BrokenPipeError, ConnectionResetError):
            pass
    return sent


def replay(spark: SparkSession, path: str, host: str, port: int, rate: float = 0.0, shuffle_window: int = 0, duplicate_rate: float = 0.0, drift_rate: float = 0.0, update_timestamps: bool = True, seed: int = 0) -> int:
    """Sends the JSON lines below path, changed by the chaos transforms; malformed lines are left out."""
    lines = read_lines(spark, path)[0].withColumnRenamed("line_no", "arrival_seq")
    return send(transformed(lines, shuffle_window, duplicate_rate, drift_rate, seed), host, port, rate, update_timestamps)


def stress(ticks: DataFrame, host: str, port: int, rate: float = 1000.0, connections: int = 1) -> int:
    """Sends ticks as JSON over several connections at once, each from a task of its own; returns how many went.

    Each connection gets an even share of the rate and of the rows.
    """
    columns = [c for c in ticks.columns if c != "arrival_seq"]
    rows = ticks.select(F.pmod("arrival_seq", F.lit(connections)).cast("int").alias("connection"), "arrival_seq", F.to_json(F.struct(*columns)).alias("raw"))
    share = rate / connections

    def push(batches):
        import pyarrow as pa

        bucket, sent = TokenBucket(share), 0
        peers: dict[int, socket.socket] = {}
        for batch in batches:
            for c, raw in zip(batch.column("connection").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                if c not in peers:
                    peers[c] = socket.create_connection((host, port))
                peers[c].sendall(frame(restamped(raw, time.time_ns() // 1_000_000).encode()))
                sent += 1
                bucket.take()
        for peer in peers.values():
            peer.close()
        yield pa.RecordBatch.from_pydict({"sent": pa.array([sent], pa.int64())})

    dealt = rows.repartitionByRange(connections, "connection").sortWithinPartitions("arrival_seq")
    return dealt.mapInArrow(push, "sent long").agg(F.coalesce(F.sum("sent"), F.lit(0))).first()[0]

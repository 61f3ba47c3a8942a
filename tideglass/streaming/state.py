"""Stateful streaming forms of the order-dependent analyses.

Each keeps its state per key in the state store and sorts a micro-batch's
rows by arrival_seq, so a stream equals the batch form as long as batches
follow the arrival order.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.config import DEFAULTS, EngineConfig
from ..functions.scalars import clamped_latency, iso_ms, money, number, symbol
from ..operators.ingest import for_volume, for_vwap


def _sorted(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values("arrival_seq", ignore_index=True)


class Integrity(StatefulProcessor):
    """Per symbol: largest time, last sequence, and the trade_ids last touched, up to a bound."""

    def __init__(self, ids: int):
        self.ids = ids

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t long, seq long, touch long")
        self.touched = handle.getMapState("touched", "id long", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last_t, last_seq, touch = self.last.get() if self.last.exists() else (None, None, 0)
        # the remembered ids by their last touch, oldest first
        memory = OrderedDict((k[0], v[0]) for k, v in sorted(self.touched.iterator(), key=lambda kv: kv[1][0]))
        before = dict(memory)
        out = []
        for seq_no, trade_id, t, seq in _sorted(rows)[["arrival_seq", "trade_id", "t", "sequence"]].itertuples(index=False):
            duplicate = out_of_order = gap = False
            if not pd.isna(trade_id):
                duplicate = int(trade_id) in memory
                touch += 1
                memory[int(trade_id)] = touch
                memory.move_to_end(int(trade_id))
                if len(memory) > self.ids:
                    memory.popitem(last=False)
            if not pd.isna(t):
                out_of_order = last_t is not None and last_t > 0 and t < last_t
                last_t = int(t) if last_t is None else max(last_t, int(t))
            if not pd.isna(seq):
                gap = last_seq is not None and seq > last_seq + 1
                last_seq = int(seq)
            out.append((seq_no, duplicate, out_of_order, gap))
        for gone in before.keys() - memory.keys():
            self.touched.removeKey((gone,))
        for k, v in memory.items():
            if before.get(k) != v:
                self.touched.updateValue((k,), (v,))
        self.last.update((last_t, last_seq, touch))
        yield pd.DataFrame(out, columns=["arrival_seq", "is_duplicate", "is_out_of_order", "is_gap"])

    def close(self) -> None:
        pass


class LastRows(StatefulProcessor):
    """Per symbol the last (price, size) rows, and their volume-weighted price after each row."""

    def __init__(self, rows: int):
        self.rows = rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getListState("window", "price double, size double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = deque(((r[0], r[1]) for r in self.window.get()), maxlen=self.rows) if self.window.exists() else deque(maxlen=self.rows)
        out = []
        for seq_no, price, size in _sorted(rows)[["arrival_seq", "price", "last_size"]].itertuples(index=False):
            held.append((price, size))
            volume = sum(s for _, s in held)
            out.append((seq_no, key[0], sum(p * s for p, s in held) / volume if volume > 0 else 0.0))
        self.window.put(list(held))
        yield pd.DataFrame(out, columns=["arrival_seq", "product_id", "vwap"])

    def close(self) -> None:
        pass


class Recorder(StatefulProcessor):
    """One key for all events: spike detector and flight recorder; yields a row per completed capture.

    Latencies are kept as a ring of whether each exceeds the threshold.
    """

    def __init__(self, config: EngineConfig):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "bits string, over long, run long")
        self.open = handle.getValueState("open", "end_seq long, last_recv long, seq long, kind string, lo long, hi long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        c = self.config
        bits, over, run = self.ring.get() if self.ring.exists() else ("", 0, 0)
        ring = deque(int(b) for b in bits)
        end, last_recv, seq, kind, lo, hi = self.open.get() if self.open.exists() else (0, None, None, None, None, None)
        done = []
        for at, recv, latency, duplicate, gap in _sorted(rows)[["arrival_seq", "recv_ts_ms", "latency_ms", "is_duplicate", "is_gap"]].itertuples(index=False):
            if seq is not None and at >= hi:
                done.append((seq, kind, lo, hi))
                end, seq = hi, None
            spike = False
            if not pd.isna(latency):
                slow = int(latency > c.spike_threshold_ms)
                ring.append(slow)
                over += slow
                if len(ring) > c.latency_window:
                    over -= ring.popleft()
                n = len(ring)
                if n >= c.latency_least:
                    run = run + 1 if over >= n - n * 99 // 100 else 0
                    if run >= c.spike_consecutive:
                        spike, run = True, 0
            found = "latency_spike" if spike else "duplicate" if duplicate else "gap" if gap else None
            if found and seq is None and (last_recv is None or recv - last_recv >= c.cooldown_ms):
                first = max(end + 1, at - c.pre_events + 1)
                seq, kind, last_recv, lo, hi = at, found, int(recv), (at + 1 if first > at else first), at + c.post_events
        self.ring.update(("".join(map(str, ring)), over, run))
        self.open.update((end, last_recv, seq, kind, lo, hi))
        yield pd.DataFrame(done, columns=["seq", "kind", "lo", "hi"])

    def close(self) -> None:
        pass


def _stateful(df: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    return df.groupBy(key).transformWithStateInPandas(processor, schema, "append", "None")


def integrity_stream(ticks: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    rows = ticks.select("arrival_seq", symbol(F.col("product_id"), "unknown").alias("product_id"), "trade_id", iso_ms(F.col("time")).alias("t"), "sequence")
    return _stateful(rows, "product_id", Integrity(config.lru_ids), "arrival_seq long, is_duplicate boolean, is_out_of_order boolean, is_gap boolean")


def vwap_stream(ticks: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    rows = for_vwap(ticks).select("arrival_seq", symbol(F.col("product_id")).alias("product_id"), number(F.col("price")).alias("price"), number(F.col("last_size")).alias("last_size"))
    return _stateful(rows, "product_id", LastRows(config.vwap_window), "arrival_seq long, product_id string, vwap double")


def recorder_stream(flagged: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Completed captures of a stream of flagged ticks. One key holds all events, as the recorder is one."""
    latency = clamped_latency(F.col("ingest_ts_ms"), F.col("recv_ts_ms"))
    rows = flagged.select(F.lit(0).alias("one"), "arrival_seq", "recv_ts_ms", latency.alias("latency_ms"), "is_duplicate", "is_gap")
    return _stateful(rows, "one", Recorder(config), "seq long, kind string, lo long, hi long")


def volume_stream(ticks: DataFrame, window: str = "10 seconds", lateness: str | None = None) -> DataFrame:
    """Traded value and trades per symbol and event-time window of receipt.

    No row is too late unless a lateness is given, which an append sink needs
    and which bounds the state; without one, write in update mode.
    """
    amount = money(number(F.col("price"))) * money(number(F.col("last_size")))
    timed = for_volume(ticks).withColumn("received", F.timestamp_millis("recv_ts_ms"))
    timed = timed.withWatermark("received", lateness) if lateness else timed
    sums = timed.groupBy(F.window("received", window), symbol(F.col("product_id")).alias("product_id")).agg(F.sum(amount).cast("double").alias("volume"), F.count(F.lit(1)).alias("trades"))
    return sums.select(F.unix_millis("window.start").alias("window_start_ms"), "product_id", "volume", "trades")

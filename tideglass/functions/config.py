"""Settings of the tick engine, with their defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConfig:
    # fixed values: the defaults that results must agree with
    vwap_window: int = 200
    volatility_window: int = 100
    volatility_least: int = 10
    latency_window: int = 3_000
    latency_least: int = 100
    spike_threshold_ms: int = 100
    spike_consecutive: int = 2
    lru_ids: int = 50_000
    pre_events: int = 5_000
    post_events: int = 2_000
    cooldown_ms: int = 60_000
    volume_window_ms: int = 10_000
    health_window_ms: int = 5_000
    max_frame_bytes: int = 1_000_000
    drift_queue: int = 1_000
    recorder_queue: int = 10_000
    consumer_queue: int = 1_000
    forensics_queue: int = 5_000
    backoff_first_s: float = 1.0
    backoff_most_s: float = 10.0
    host: str = "0.0.0.0"
    port: int = 9001
    metrics_port: int = 9090
    symbols: str = "BTC-USD,ETH-USD,SOL-USD"
    record: bool = False
    record_file: str = "data/btcusd.jsonl"
    forensics: bool = True
    drift_file: str = "data/drift_samples.jsonl"
    incidents_dir: str = "data/incidents"
    log_level: str = "INFO"


DEFAULTS = EngineConfig()

# fixed values: environment variables by the setting they give; the cooldown's is in seconds
ENVIRONMENT = {
    "BACKOFF_MAX": "backoff_most_s",
    "DRIFT_SAMPLE_FILE": "drift_file",
    "DUPLICATE_LRU_MAX": "lru_ids",
    "FLIGHT_COOLDOWN_S": "cooldown_ms",
    "FLIGHT_POST_EVENTS": "post_events",
    "FLIGHT_PRE_EVENTS": "pre_events",
    "FORENSICS": "forensics",
    "HOST": "host",
    "INCIDENTS_DIR": "incidents_dir",
    "LATENCY_BUFFER_SIZE": "latency_window",
    "LATENCY_SPIKE_CONSECUTIVE": "spike_consecutive",
    "LATENCY_SPIKE_THRESHOLD_MS": "spike_threshold_ms",
    "LOG_LEVEL": "log_level",
    "METRICS_PORT": "metrics_port",
    "PORT": "port",
    "RECORD": "record",
    "RECORD_FILE": "record_file",
    "SYMBOLS": "symbols",
}


def _parsed(name: str, text: str):
    kind = type(getattr(DEFAULTS, name))
    return text.strip().lower() == "true" if kind is bool else kind(text.strip())


def from_environment(environment: Mapping[str, str] | None = None, base: EngineConfig = DEFAULTS) -> EngineConfig:
    """Settings with those of the environment variables that are set; a value that cannot be read raises ValueError."""
    environment = os.environ if environment is None else environment
    found = {name: _parsed(name, environment[key]) for key, name in ENVIRONMENT.items() if environment.get(key)}
    if "cooldown_ms" in found:
        found["cooldown_ms"] *= 1000
    return replace(base, **found)


def from_session(spark: SparkSession, base: EngineConfig = DEFAULTS, prefix: str = "spark.tideglass.") -> EngineConfig:
    """Settings with those of the session, each under the prefix and its own name."""
    texts = {f.name: spark.conf.get(prefix + f.name, None) for f in fields(EngineConfig)}
    return replace(base, **{name: _parsed(name, text) for name, text in texts.items() if text})

# fixed values: what events, metrics and results are named by
#: Upper edges of the latency histogram, in ms; the last bucket is unbounded.
LATENCY_BUCKETS = (1, 5, 10, 25, 50, 100, 250, 500, 1000)
#: Seconds in a year, for annualised volatility.
YEAR_SECONDS = 86_400 * 365
#: Keys an event must have, and those it may have besides.
REQUIRED_KEYS = ("type", "product_id", "price", "last_size", "time", "ingest_ts_ms")
OPTIONAL_KEYS = ("recv_ts_ms", "trade_id", "sequence")
#: Exported names of the anomaly counters.
ANOMALY_LABELS = {"drift": "schema_drift", "ooo": "out_of_order", "gap": "sequence_gap", "duplicate": "duplicate", "latency_spike": "latency_spike"}

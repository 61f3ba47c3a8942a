"""The tick analyses on hand-made rows and against sequential models."""

from __future__ import annotations

import math
import random
from collections import OrderedDict, deque
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tideglass.functions import config
from tideglass.functions.config import DEFAULTS
from tideglass.functions.scalars import index_capped, index_nearest
from tideglass.operators import analytics, chaos, drift, incidents, ingest, integrity, latency, logs, metrics, report, shedding
from tideglass.sources import endpoint, frames, jsonl, replay
from tideglass.sources.synthetic import synthetic_ticks
from tideglass.streaming import fanout, state, twins

COLUMNS = "arrival_seq long, type string, product_id string, price double, last_size double, time string, trade_id long, sequence long, ingest_ts_ms long, recv_ts_ms long"


def tick(seq, product="A", price=10.0, size=1.0, time="2025-01-01T00:00:00Z", trade=None, sequence=None, ingest=1000, recv=1010):
    return (seq, "ticker", product, price, size, time, trade, sequence, ingest, recv)


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def random_ticks(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(1, n + 1):
        second = max(0, i // 4 + rng.randrange(-3, 3))
        time = rng.choice([f"2025-01-01T00:{second // 60:02d}:{second % 60:02d}.{rng.randrange(1000):03d}Z"] * 9 + ["never"])
        trade = rng.choice([None, rng.randrange(60), rng.randrange(10_000)])
        out.append(tick(i, rng.choice("ABC"), round(rng.uniform(-1, 30), 2), float(rng.randrange(3)), time, trade, rng.choice([None, i // 3, i]), 1000 + i, 1000 + i + rng.choice([0, 5, 90, 300, -20])))
    return out


def test_vwap_window_and_zero_volume(spark):
    rows = [tick(i, price=float(i), size=1.0) for i in range(1, 202)]
    got = {r["arrival_seq"]: r for r in analytics.vwap_rolling(frame(spark, rows)).collect()}
    assert got[200]["vwap"] == pytest.approx(100.5) and got[201]["vwap"] == pytest.approx(101.5)
    assert got[201]["window_rows"] == 200
    zero = analytics.vwap_snapshot(frame(spark, [tick(1, size=0.0), tick(2, price=-1.0), tick(3, price=None)])).collect()
    assert [(r["vwap"], r["window_rows"]) for r in zero] == [(0.0, 1)]


def test_predicates_differ_on_zero_size(spark):
    df = frame(spark, [tick(1, size=0.0), tick(2, price=0.0), tick(3, ingest=0), tick(4)])
    assert [f(df).count() for f in (ingest.for_vwap, ingest.for_volatility, ingest.for_volume)] == [2, 3, 2]


def test_volatility_needs_ten_returns(spark):
    ten, eleven = [tick(i, "A") for i in range(1, 11)], [tick(i, "B", float(i % 3 + 1)) for i in range(20, 31)]
    got = analytics.volatility(frame(spark, ten + eleven)).collect()
    assert [r["product_id"] for r in got] == ["B"]
    returns = [math.log(b[3] / a[3]) for a, b in zip(eleven, eleven[1:])]
    mean = sum(returns) / 10
    expected = math.sqrt(sum((r - mean) ** 2 for r in returns) / 10) * math.sqrt(365 * 86400) * 100
    assert got[0]["volatility_pct"] == pytest.approx(expected, abs=1e-3)
    flat = analytics.volatility(frame(spark, [tick(i) for i in range(1, 20)])).collect()
    assert flat[0]["volatility_pct"] == 0.0


def test_volume_and_health(spark):
    df = frame(spark, [tick(1, recv=10_000, price=2.0, size=3.0), tick(2, recv=19_999, size=0.0), tick(3, recv=20_000)])
    assert {(r["window_start_ms"], r["volume"], r["trades"], r["volume_per_minute"]) for r in analytics.volume(df).collect()} == {(10_000, 6.0, 1, 36.0), (20_000, 10.0, 1, 60.0)}
    assert {(r["window_start_ms"], r["events"]) for r in analytics.health(df).collect()} == {(10_000, 1), (15_000, 1), (20_000, 1)}
    assert analytics.last_price(df).first()[0] == 10.0


def integrity_model(rows, ids):
    states, out = {}, {}
    for seq, _, product, _, _, time, trade, sequence, _, _ in rows:
        s = states.setdefault(product, {"ids": OrderedDict(), "t": None, "q": None})
        dup = trade is not None and trade in s["ids"]
        if trade is not None:
            s["ids"][trade] = 1
            s["ids"].move_to_end(trade)
            if len(s["ids"]) > ids:
                s["ids"].popitem(last=False)
        t = None if time == "never" else int(time[14:16]) * 60_000 + int(time[17:19]) * 1000 + int((time[20:23] if time[19] == "." else "0") or 0)
        late = t is not None and s["t"] is not None and t < s["t"]
        if t is not None:
            s["t"] = t if s["t"] is None else max(s["t"], t)
        gap = sequence is not None and s["q"] is not None and sequence > s["q"] + 1
        s["q"] = s["q"] if sequence is None else sequence
        out[seq] = (dup, late, gap)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_integrity_matches_sequential_model(spark, seed):
    rows = random_ticks(seed)
    got = {r["arrival_seq"]: (r["is_duplicate"], r["is_out_of_order"], r["is_gap"]) for r in integrity.flags(frame(spark, rows)).collect()}
    assert got == integrity_model(rows, 10**9)
    lru = {r[0] for r in integrity.lru_duplicates(frame(spark, rows), 5).collect()}
    assert lru == {seq for seq, (dup, _, _) in integrity_model(rows, 5).items() if dup}


def test_lru_keeps_what_is_touched(spark):
    a = [tick(i, trade=ord(c)) for i, c in enumerate("abca", 1)]
    b = [tick(i, trade=ord(c)) for i, c in enumerate("abaca", 1)]
    assert integrity.lru_duplicates(frame(spark, a), 2).count() == 0
    assert sorted(r[0] for r in integrity.lru_duplicates(frame(spark, b), 2).collect()) == [3, 5]


def spike_model(rows, config):
    ring, run, out = deque(maxlen=config.latency_window), 0, {}
    for seq, *_, ingest_ms, recv in rows:
        if not ingest_ms or not recv:
            continue
        ring.append(max(0, recv - ingest_ms))
        fired = False
        if len(ring) >= config.latency_least:
            if sorted(ring)[len(ring) * 99 // 100] > config.spike_threshold_ms:
                run += 1
                if run >= config.spike_consecutive:
                    fired, run = True, 0
            else:
                run = 0
        out[seq] = fired
    return out


def test_spikes_match_sorting(spark):
    config = replace(DEFAULTS, latency_window=60, latency_least=20)
    rng = random.Random(3)
    rows = [tick(i, ingest=rng.choice([1000] * 20 + [0]), recv=1000 + (300 if (i // 70) % 3 == 1 and rng.random() < 0.3 else rng.randrange(101))) for i in range(1, 500)]
    got = {r["arrival_seq"]: r["is_spike"] for r in latency.spikes(frame(spark, rows), config).collect()}
    assert got == spike_model(rows, config) and any(got.values())


def test_histogram_edges_and_negatives(spark):
    df = frame(spark, [tick(1, recv=1005), tick(2, recv=1006), tick(3, recv=900), tick(4, recv=5000), tick(5, recv=None)])
    assert {r["le"]: r["events"] for r in latency.histogram(df).collect()} == {"1": 0, "5": 1, "10": 2, "25": 2, "50": 2, "100": 2, "250": 2, "500": 2, "1000": 2, "+Inf": 3}
    totals = latency.latency_totals(df).first()
    assert (totals["latency_count"], totals["latency_min"], totals["latency_max"]) == (3, 5, 4000)
    gauge = lambda recvs: latency.least_gauge(frame(spark, [tick(i, recv=1000 + r) for i, r in enumerate(recvs, 1)])).first()[0]
    assert [gauge([7, 5]), gauge([5, 0, 9, 8]), gauge([5, 0])] == [5, 8, 0]


def test_percentile_indices(spark):
    n = spark.range(1, 200).withColumnRenamed("id", "n")
    for r in n.select("n", index_nearest(99).alias("a"), index_capped(95).alias("b")).collect():
        assert r["a"] == round(99 / 100 * (r["n"] - 1)) and r["b"] == min(int(r["n"] * 95 / 100), r["n"] - 1)


DRIFTS = {
    '{"type":"ticker","product_id":"A","price":1.5,"last_size":1,"time":"t","ingest_ts_ms":5}': ("", "", "", False),
    '{"type":"ticker","product_id":"A","price":"1.5","last_size":1,"time":"t","ingest_ts_ms":5}': ("", "price", "", True),
    '{"type":"ticker","product_id":"A","price":true,"last_size":1e3,"time":"t","ingest_ts_ms":false,"recv_ts_ms":null}': ("", "", "", False),
    '{"type":null,"product_id":"A","price":1,"last_size":[1],"time":3,"ingest_ts_ms":5.0}': ("", "ingest_ts_ms,last_size,time,type", "", True),
    '{"product_id":"A","last_size":1,"time":"t","ingest_ts_ms":5,"x":1,"trade_id":2}': ("price,type", "", "x", True),
    '{"type":"ticker","product_id":"A","price":1,"last_size":1,"time":"t","ingest_ts_ms":5,"x":1}': ("", "", "x", False),
    "[1]": ("ingest_ts_ms,last_size,price,product_id,time,type", "", "", True),
    "nonsense": ("ingest_ts_ms,last_size,price,product_id,time,type", "", "", True),
}


def test_drift(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(DRIFTS)], "arrival_seq long, raw string")
    got = {r["raw"]: (r["missing_keys"], r["type_mismatches"], r["unexpected_keys"], r["is_drift"]) for r in drift.check_drift(df).collect()}
    assert got == DRIFTS


def test_ingest_path(spark):
    lines = [
        '{"type":"ticker","product_id":"A","price":"1.5","time":"t","trade_id":"7","sequence":3}',
        '{"type":"heartbeat","product_id":"A","price":1,"time":"t"}',
        '{"type":"ticker","product_id":"A","price":"abc","time":"t"}',
        '{"type":"ticker","product_id":"A","price":2,"time":"t","recv_ts_ms":null}',
        "[1,2]",
        "{broken",
    ]
    objects, rejects = ingest.decode(spark.createDataFrame([(x,) for x in lines], "raw string"))
    assert rejects.count() == 2
    valid = ingest.validate(ingest.only_type(ingest.fields(objects)))
    stamped = ingest.stamp_receipt(ingest.stamp_ingest(valid, F.lit(5)), at=F.lit(9)).orderBy("price").collect()
    assert [(r["price"], r["last_size"], r["trade_id"], r["ingest_ts_ms"], r["recv_ts_ms"]) for r in stamped] == [(1.5, 0.0, 7, 5, 9), (2.0, 0.0, None, 5, None)]
    assert ingest.only_symbols(valid, ["B"]).count() == 0


def recorder_model(candidates, last_seq, config):
    out, end, last = [], 0, None
    by_seq = {c[0]: c for c in candidates}
    ring, capturing = deque(maxlen=config.pre_events), None
    for seq in range(1, last_seq + 1):
        if capturing:
            capturing[3].append(seq)
            if len(capturing[3]) - capturing[4] >= config.post_events:
                out.append((capturing[0], capturing[2], capturing[3][0], capturing[3][-1]))
                capturing = None
                ring.clear()
        else:
            ring.append(seq)
        if seq in by_seq and not capturing:
            _, recv, kind = by_seq[seq]
            if last is None or recv - last >= config.cooldown_ms:
                capturing, last = [seq, recv, kind, list(ring), len(ring)], recv
    return out


@pytest.mark.parametrize("sizes", [(20, 7, 0), (5, 10, 30), (50, 1, 100)])
def test_recorder_matches_event_model(spark, sizes):
    config = replace(DEFAULTS, pre_events=sizes[0], post_events=sizes[1], cooldown_ms=sizes[2])
    rng = random.Random(sizes[0])
    candidates = [(s, s * 10 + rng.randrange(40), rng.choice(["gap", "duplicate"])) for s in sorted(rng.sample(range(1, 400), 150))]
    df = spark.createDataFrame(candidates, "seq long, recv_ms long, kind string")
    got = sorted((r["seq"], r["kind"], r["lo"], r["hi"]) for r in incidents.resolve(df, 400, config).collect())
    assert got == recorder_model(candidates, 400, config)


def test_incident_bundle_and_report(spark, tmp_path):
    rows = [tick(i, "AB"[i % 2], trade=i, sequence=i, ingest=1000 + i, recv=1010 + i) for i in range(1, 60)]
    rows[29] = tick(30, "A", trade=28, sequence=30, ingest=1030, recv=1040)
    config = replace(DEFAULTS, pre_events=50, post_events=10, cooldown_ms=0)
    df = frame(spark, rows)
    found = incidents.incidents(df, config)
    first = found.orderBy("seq").first()
    assert first["reason"] in ("duplicate_detected", "sequence_gap")
    meta, events = incidents.meta(found, config), incidents.capture(df, found, config)
    one = meta.filter(F.col("incident_id") == first["incident_id"]).first()
    assert one["total_events"] == first["hi"] - first["lo"] + 1 and one["post_events"] == one["total_events"] - 50
    jsonl.write_bundles(meta, events, str(tmp_path / "bundles"))
    back_meta, back = jsonl.read_bundles(spark, str(tmp_path / "bundles"))
    assert back.count() == events.count() and back_meta.count() == meta.count()
    texts = jsonl.report_texts(spark, str(tmp_path / "bundles"), analysis={first["incident_id"]: "By hand."})
    text = texts[first["incident_id"]]
    assert text.startswith(f"# Incident Report: {first['incident_id']}") and "0 post)" in text and text.endswith("By hand.")
    assert jsonl.report_texts(spark, str(tmp_path / "bundles"), ["none"]) == {}


def test_report_pieces(spark):
    rows = [tick(1, "A", trade=1, sequence=1, time="2025-01-01T00:00:10Z"), tick(2, "A", trade=1, sequence=3, time="2025-01-01T00:00:05Z"), tick(3, "A", trade=2, sequence=2, time="2025-01-01T00:00:07Z"), tick(4, "B", trade=2, sequence=9), tick(5, "B", trade=None, sequence=12)]
    events = frame(spark, rows).withColumn("incident_id", F.lit("i"))
    assert report.out_of_order(events).first()["out_of_order"] == 1
    assert [(r["product_id"], r["after"], r["before"], r["missing"]) for r in report.gaps(events).collect()] == [("B", 9, 12, 2)]
    assert [r["trade_id"] for r in report.duplicates(events).orderBy("place").collect()] == [1, 2]
    assert report.duplicate_samples(events).count() == 4
    assert report.sample_events(events).count() == 5
    many = frame(spark, [tick(i) for i in range(1, 12)]).withColumn("incident_id", F.lit("i"))
    assert sorted(r["arrival_seq"] for r in report.sample_events(many).collect()) == [1, 2, 3, 4, 5, 7, 8, 9, 10, 11]
    stats = report.latency_stats(many).first()
    assert (stats["latency_min"], stats["latency_p99"], stats["latency_avg"]) == (10, 10, 10.0)


@pytest.mark.parametrize("reason,expected", [("duplicate_detected", "Duplicate event detected"), ("sequence_gap", "between `3` and `7`"), ("latency_spike_p99=9ms", "p99 = 5ms"), ("schema_drift", "Schema drift"), ("other", "other")])
def test_report_causes(reason, expected):
    assert expected in "\n".join(report.cause(reason, [], [(3, 7)], 5))


def test_chaos_is_seeded_and_counted(spark):
    df = frame(spark, [tick(i, trade=i) for i in range(1, 201)]).withColumn("raw", F.to_json(F.struct("type", "product_id", "price", "last_size", "time", "trade_id", "ingest_ts_ms")))
    shuffled = chaos.shuffle(df, 10, 1).orderBy("arrival_seq").collect()
    ids = [r["trade_id"] for r in shuffled]
    assert ids != sorted(ids) and all(sorted(ids[i : i + 10]) == list(range(i + 1, i + 11)) for i in range(0, 200, 10))
    assert [r["trade_id"] for r in chaos.shuffle(df, 10, 1).orderBy("arrival_seq").collect()] == ids
    assert chaos.shuffle(df, 1) is df
    doubled = [r["trade_id"] for r in chaos.duplicate(df, 0.2, 2).orderBy("arrival_seq").collect()]
    assert doubled == sorted(doubled) and 210 < len(doubled) < 280
    hurt = drift.check_drift(chaos.inject_drift(df, 0.5, 3)).collect()
    assert {r["injected"] for r in hurt} == set(range(-1, 6))
    assert all(r["is_drift"] == (r["injected"] not in (-1, 4)) for r in hurt)
    assert all(r["unexpected_keys"] == ("another_field,unexpected_field" if r["injected"] == 4 else "") for r in hurt)


def test_metrics(spark):
    samples = spark.createDataFrame([(1000 * i, "events_total", "", v) for i, v in enumerate([0.0, 10.0, 30.0, 5.0, 15.0])], "at_ms long, name string, label string, value double")
    got = [(r["increase"], r["rate"]) for r in metrics.increase(samples, 2000).orderBy("at_ms").collect()]
    assert got == [(0.0, 0.0), (10.0, 10.0), (30.0, 15.0), (25.0, 12.5), (15.0, 7.5)]
    buckets = [("100", 40.0), ("250", 80.0), ("+Inf", 100.0)]
    rows = [(at, "latency_ms_bucket", le, v * k) for k, at in enumerate([0, 1000]) for le, v in buckets]
    quantile = lambda q: metrics.histogram_quantile(spark.createDataFrame(rows, samples.schema), q, 5000).first()["quantile"]
    assert [round(quantile(q), 6) for q in (0.2, 0.6, 0.99)] == [50.0, 175.0, 250.0]


def test_shedding_and_senders(spark):
    df = frame(spark, [tick(i) for i in range(1, 26)])
    kept = lambda drop: sorted(r["arrival_seq"] for r in shedding.shed(df, 10, 4, drop).filter("not is_dropped").collect())
    assert kept("oldest") == [7, 8, 9, 10, 17, 18, 19, 20, 22, 23, 24, 25]
    assert kept("newest") == [1, 2, 3, 4, 11, 12, 13, 14, 21, 22, 23, 24]
    assert [r["send_ms"] for r in shedding.rate_limited(df, 500.0).orderBy("arrival_seq").limit(2).collect()] == [2.0, 4.0]
    sends = spark.createDataFrame([(c, n, float(n), n == 10, n * 100.0) for c in (1, 2) for n in range(1, 11)], "connection long, n long, latency_ms double, is_error boolean, sent_ms double")
    stats = shedding.sender_stats(sends).first()
    assert (stats["sent"], stats["errors"], stats["p50"], stats["p99"]) == (18, 2, 5.0, 9.0) and stats["throughput"] == pytest.approx(18 / 0.9)


def test_frames(spark, tmp_path):
    payloads = [b'{"a":1}', b"", "é".encode()]
    data = b"".join(map(frames.frame, payloads))
    assert list(frames.unframe(data + b"\x00\x00\x00\x09cut")) == payloads
    assert list(frames.unframe(frames.frame(b"x" * 20) + frames.frame(b"ok"), limit=10)) == [b"ok"]
    (tmp_path / "f.bin").write_bytes(data)
    assert [r["raw"] for r in frames.read_frames(spark, str(tmp_path / "f.bin")).orderBy("place").collect()] == ['{"a":1}', "", "é"]
    column = frames.frame_column(spark.createDataFrame([('{"a":1}',)], "raw string")).first()["frame"]
    assert bytes(column) == frames.frame(b'{"a":1}')
    frames.register(spark)
    assert spark.read.format("frames").option("paths", str(tmp_path / "f.bin")).load().count() == 3
    back = frames.Backoff()
    assert [back.failed() for _ in range(6)] == [1.0, 2.0, 4.0, 8.0, 10.0, 10.0]
    back.succeeded()
    assert back.failed() == 1.0


def test_socket_reader():
    import socket
    import threading

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        peer, _ = server.accept()
        data = b"".join(frames.frame(f'{{"n":{i}}}'.encode()) for i in range(5))
        peer.sendall(data[:13])
        peer.sendall(data[13:])
        peer.close()

    threading.Thread(target=serve, daemon=True).start()
    reader = frames.FrameSocketReader({"host": "127.0.0.1", "port": str(server.getsockname()[1]), "wait": "0.5"})
    rows, end = reader.read(reader.initialOffset())
    assert [raw for _, raw in rows] == [f'{{"n":{i}}}' for i in range(5)] and end == {"n": 5}
    assert list(reader.readBetweenOffsets({"n": 1}, {"n": 3})) == [(1, '{"n":1}'), (2, '{"n":2}')]
    reader.commit(end)
    assert reader.held == {}


def test_lines_in_order(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x":1}\n\n{bad\n{"x":2}\n')
    (tmp_path / "b.jsonl").write_text('{"x":3}\n')
    good, bad = jsonl.read_lines(spark, str(tmp_path))
    assert [(r["line_no"], r["raw"]) for r in good.orderBy("line_no").collect()] == [(1, '{"x":1}'), (2, '{"x":2}'), (3, '{"x":3}')]
    assert [r["value"] for r in bad.collect()] == ["{bad"]
    jsonl.write_drift_samples(spark.createDataFrame([(1, "{}"), (2, "{}")], "arrival_seq long, raw string"), str(tmp_path / "drift"), 1)
    assert spark.read.json(str(tmp_path / "drift")).count() == 1


def test_synthetic(spark):
    df = synthetic_ticks(spark, 3000, 5)
    assert df.collect() == synthetic_ticks(spark, 3000, 5).collect()
    means = {r[0]: r[1] for r in df.groupBy("product_id").agg(F.avg("price")).collect()}
    assert means["BTC-USD"] == pytest.approx(95_000, rel=1e-3) and len(means) == 3
    assert df.agg(F.avg("last_size")).first()[0] == pytest.approx(0.1, rel=0.1)


def test_streams_equal_batch(spark):
    rows = random_ticks(9, 300)
    df = frame(spark, rows)
    flags = {r["arrival_seq"]: (r["is_duplicate"], r["is_out_of_order"], r["is_gap"]) for r in twins.stream_flags(spark, df, replace(DEFAULTS, lru_ids=5)).collect()}
    assert flags == integrity_model(rows, 5)
    config = replace(DEFAULTS, vwap_window=7)
    batch = {r["arrival_seq"]: r["vwap"] for r in analytics.vwap_rolling(df, config).collect()}
    stream = {r["arrival_seq"]: r["vwap"] for r in twins.stream_vwap(spark, df, config).collect()}
    assert stream == pytest.approx(batch)
    small = replace(DEFAULTS, pre_events=20, post_events=7, cooldown_ms=10, latency_window=60, latency_least=20)
    want = {(r["seq"], r["lo"], r["hi"]) for r in incidents.incidents(df, small).collect()}
    assert {(r["seq"], r["lo"], r["hi"]) for r in twins.stream_incidents(spark, df, small).collect()} == want and want


def test_empty_tables(spark):
    df = frame(spark, [])
    for f in (analytics.vwap_rolling, analytics.vwap_snapshot, analytics.volatility, analytics.volume, analytics.health, integrity.flags, latency.spikes, latency.percentiles_index):
        assert f(df).collect() == []
    assert integrity.counters(integrity.flags(df)).first()["processed"] == 0
    assert incidents.incidents(df).collect() == []


def test_prices_that_cannot_be_summed_are_left_out(spark):
    """NaN, infinite and huge prices stop nothing and are in no sum, in neither price nor size."""
    rows = [(1, "A", 10.0, 1.0), (2, "A", float("nan"), 1.0), (3, "A", float("inf"), 1.0), (4, "A", 2e10, 1.0), (5, "A", 20.0, 1.0), (6, "A", 5.0, float("inf")), (7, "B", 3e10, 2.0)]
    df = spark.createDataFrame(rows, "arrival_seq long, product_id string, price double, last_size double")
    df = df.withColumns({"ingest_ts_ms": F.lit(5).cast("long"), "recv_ts_ms": F.lit(6).cast("long")})
    assert [(r["product_id"], r["vwap"], r["window_rows"]) for r in analytics.vwap_snapshot(df).collect()] == [("A", 15.0, 2)]
    assert [(r["product_id"], r["volume"], r["trades"]) for r in analytics.volume(df).collect()] == [("A", 30.0, 2)]
    assert all(math.isfinite(r["log_return"]) for r in analytics.log_returns(df).collect())


def test_synthetic_is_the_same_on_any_number_of_tasks(spark):
    a = synthetic_ticks(spark, 500, 3)
    assert sorted(a.repartition(7).collect()) == sorted(synthetic_ticks(spark, 500, 3).collect())
    prices = [r["price"] for r in synthetic_ticks(spark, 3000, 5).filter("product_id = 'BTC-USD'").collect()]
    assert 900 < len(prices) < 1100 and abs(sum(prices) / len(prices) - 95_000) < 20


def test_counters_and_series_of_marked_ticks(spark):
    """Drift and incidents count where the frame carries them, in totals and as series."""
    rows = [(i, i * 100, i % 5 == 0, i == 20) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "arrival_seq long, recv_ts_ms long, is_drift boolean, is_incident boolean")
    df = df.withColumns({"ingest_ts_ms": F.col("recv_ts_ms"), "is_duplicate": F.lit(False), "is_out_of_order": F.lit(False), "is_gap": F.lit(True)})
    one = integrity.counters(df).first()
    assert (one["drift"], one["incidents"], one["gaps"], one["spikes"]) == (8, 1, 40, 0)
    got = {(r["name"], r["label"]): r["value"] for r in metrics.latest(metrics.snapshots(df, 1000)).collect()}
    assert got["anomalies_total", "schema_drift"] == 8 and got["incidents_total", ""] == 1 and got["anomalies_total", "sequence_gap"] == 40
    assert got["events_per_second", ""] == 1.0  # the last step holds the one event at 4000 ms


def test_periodic_snapshots(spark):
    rows = random_ticks(21, 300)
    df = frame(spark, rows)
    settings = replace(DEFAULTS, vwap_window=7, volatility_window=12)
    rolling = {r["arrival_seq"]: r["vwap"] for r in analytics.vwap_rolling(df, settings).collect()}
    kept = {r["arrival_seq"]: r for r in df.collect() if r["arrival_seq"] in rolling}
    want: dict = {}
    for seq in sorted(rolling):
        want[kept[seq]["recv_ts_ms"] // 50 * 50 + 50, kept[seq]["product_id"]] = rolling[seq]
    got = {(r["at_ms"], r["product_id"]): r["vwap"] for r in analytics.vwap_periodic(df, 50, settings).collect()}
    assert got == pytest.approx(want)
    prices: dict = {}
    want = {}
    for r in sorted(df.collect(), key=lambda r: r["arrival_seq"]):
        if r["price"] is None or r["price"] <= 0:
            continue
        held = prices.setdefault(r["product_id"], [])
        held.append(r["price"])
        returns = [math.log(b / a) for a, b in zip(held, held[1:])][-12:]
        at = r["recv_ts_ms"] // 50 * 50 + 50, r["product_id"]
        if len(returns) >= 10:
            mean = sum(returns) / len(returns)
            want[at] = math.sqrt(sum((x - mean) ** 2 for x in returns) / len(returns)) * math.sqrt(86_400 * 365) * 100
    got = {(r["at_ms"], r["product_id"]): r["volatility_pct"] for r in analytics.volatility_periodic(df, 50, settings).collect()}
    assert got == pytest.approx(want, abs=1e-3) and want


def test_log_lines(spark):
    df = frame(spark, [tick(1, "A", 10.0, 2.0, ingest=1000, recv=1010), tick(2, "B", 2.5, 4000.0, ingest=1000, recv=1020), tick(3, "A", 20.0, 2.0, ingest=6000, recv=6010)])
    lines = lambda found: [(r["at_ms"], r["line"]) for r in found.orderBy("at_ms").collect()]
    assert lines(logs.vwap_lines(analytics.vwap_periodic(df))) == [(5000, "A=10.00 | B=2.50"), (10000, "A=15.00")]
    assert lines(logs.volume_lines(analytics.volume(df), 10_000)) == [(10000, "A=$0.4K/min(2tx) | B=$60.0K/min(1tx)")]
    assert lines(logs.health_lines(analytics.health(df), 5_000)) == [(5000, "eps=0.4 | price=2.5"), (10000, "eps=0.2 | price=20.0")]
    marked = df.withColumns({"is_duplicate": F.col("arrival_seq") == 2, "is_incident": F.lit(False)})
    assert lines(logs.forensics_lines(metrics.snapshots(marked, 5_000)))[1] == (10000, "processed=3 | drift=0 | dup=1 | ooo=0 | gaps=0 | spikes=0 | incidents=0")


def test_settings(spark):
    found = config.from_environment({"DUPLICATE_LRU_MAX": "7", "FLIGHT_COOLDOWN_S": "3", "RECORD": "TRUE", "BACKOFF_MAX": "2.5", "HOME": "x", "PORT": ""})
    assert (found.lru_ids, found.cooldown_ms, found.record, found.backoff_most_s, found.port) == (7, 3000, True, 2.5, 9001)
    assert config.from_environment({}) == DEFAULTS
    with pytest.raises(ValueError):
        config.from_environment({"PORT": "many"})
    spark.conf.set("spark.tideglass.vwap_window", "9")
    try:
        assert config.from_session(spark) == replace(DEFAULTS, vwap_window=9)
    finally:
        spark.conf.unset("spark.tideglass.vwap_window")


def test_endpoint():
    from urllib.error import HTTPError
    from urllib.request import urlopen

    served = endpoint.MetricsEndpoint(lambda: "é 1\n", 0, "127.0.0.1")
    try:
        get = lambda path: urlopen(f"http://127.0.0.1:{served.port}{path}", timeout=5).read().decode()
        assert (get("/metrics"), get("/health")) == ("é 1\n", "OK")
        with pytest.raises(HTTPError) as missing:
            get("/other")
        assert missing.value.code == 404
    finally:
        served.stop()


def test_token_bucket():
    now = [0.0]
    bucket = replay.TokenBucket(10.0, 3.0, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert bucket.take() == pytest.approx(0.1) and bucket.take() == pytest.approx(0.1)
    now[0] += 60
    assert [round(bucket.take(), 6) for _ in range(4)] == [0, 0, 0, 0.1]
    assert replay.TokenBucket(0).take() == 0


def listening(connections):
    """A TCP peer that keeps all frames it is sent, and its port."""
    import socket
    import threading

    server, found, threads = socket.create_server(("127.0.0.1", 0)), [], []

    def take(peer):
        data = b""
        while piece := peer.recv(1 << 16):
            data += piece
        found.append(list(frames.unframe(data)))

    def serve():
        for _ in range(connections):
            threads.append(threading.Thread(target=take, args=(server.accept()[0],)))
            threads[-1].start()

    threads.append(threading.Thread(target=serve, daemon=True))
    threads[0].start()
    return server.getsockname()[1], found, threads


def test_replay_and_stress(spark, tmp_path):
    import json

    from tideglass.__main__ import events_to_send, main

    (tmp_path / "a.jsonl").write_text("".join(f'{{"type":"ticker","sequence":{i},"ingest_ts_ms":5}}\n' for i in range(30)) + "{bad\n")
    port, found, threads = listening(1)
    assert main(["replay", "-f", str(tmp_path / "a.jsonl"), "--host", "127.0.0.1", "--port", str(port), "-s", "5", "-d", "0.3", "--no-update-timestamps"], spark) > 30
    [t.join(10) for t in threads]
    events = [json.loads(x) for x in found[0]]
    assert {e["sequence"] for e in events} == set(range(30)) and all(e["ingest_ts_ms"] == 5 for e in events)
    assert [e["sequence"] for e in events] != sorted(e["sequence"] for e in events)
    port, found, threads = listening(2)
    assert main(["stress", "-r", "0", "-n", "40", "-c", "2", "-s", "X", "--host", "127.0.0.1", "--port", str(port)], spark) == 40
    [t.join(10) for t in list(threads)]
    assert sorted(map(len, found)) == [20, 20] and {json.loads(x)["product_id"] for f in found for x in f} == {"X"}
    assert (events_to_send(1000, None, None), events_to_send(10, 2, 50), events_to_send(10, 9, 50)) == (10_000, 20, 50)


def test_over_long_frames_end_the_connection():
    import socket
    import threading

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        for data in (frames.frame(b"{}") + b"\xff\xff\xff\xff" + b"x" * 100, frames.frame(b'{"a":1}')):
            peer, _ = server.accept()
            peer.sendall(data)
            peer.close()

    threading.Thread(target=serve, daemon=True).start()
    reader = frames.FrameSocketReader({"host": "127.0.0.1", "port": str(server.getsockname()[1]), "wait": "0.5"})
    rows, end = reader.read(reader.initialOffset())
    assert [raw for _, raw in rows] == ["{}"] and reader.rest == b""
    reader.commit(end)
    assert [raw for _, raw in reader.read(end)[0]] == ['{"a":1}']


def test_fan_out_and_restart(spark, tmp_path):
    """Every consumer sees every row once, over a restart as well."""
    schema, seen = "arrival_seq long, price double", []
    source = spark.range(10).selectExpr("id as arrival_seq", "id * 1.0D as price")
    source.coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    def once():
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        consumers = {"a": fanout.write_batch(str(tmp_path / "a")), "b": fanout.write_batch(str(tmp_path / "b"), lambda d: d.filter("price > 4")), "n": lambda batch, number: seen.append((number, batch.count()))}
        fanout.fan_out(stream, consumers, str(tmp_path / "checkpoint"), once=True).awaitTermination()

    once()
    source.selectExpr("arrival_seq + 10 as arrival_seq", "price").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    once()
    assert seen == [(0, 10), (1, 10)]
    assert sorted(r["arrival_seq"] for r in spark.read.parquet(str(tmp_path / "a")).collect()) == list(range(20))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 10


def test_report_files(spark, tmp_path):
    from tideglass.__main__ import main

    df = frame(spark, random_ticks(3, 300))
    small = replace(DEFAULTS, pre_events=20, post_events=7, cooldown_ms=10, latency_window=60, latency_least=20)
    found = incidents.incidents(df, small)
    jsonl.write_bundles(incidents.meta(found, small), incidents.capture(df, found, small), str(tmp_path))
    n = main(["report", str(tmp_path)], spark)
    files = spark.read.text(f"{tmp_path}/reports", wholetext=True).collect()
    assert n == len(files) == found.count() > 0 and all(f["value"].startswith(f"# Incident Report: {f['incident_id']}") for f in files)


def test_volume_stream_drops_nothing_late(spark, tmp_path):
    """A second file with rows hours older than the first still counts."""
    schema = "product_id string, price double, last_size double, recv_ts_ms long"
    for rows in ([("A", 2.0, 3.0, 36_000_000)], [("A", 5.0, 1.0, 1_000), ("A", 1.0, 1.0, 2_000)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = state.volume_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("late_volume").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("late_volume").collect())) == [(0, "A", 6.0, 2), (36_000_000, "A", 6.0, 1)]

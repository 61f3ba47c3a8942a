"""All registered queries of the tick engine, and their SQL.

Queries run over the ticks that sources.ticks derives from the events
table. Windows and capture sizes are the defaults unless a query's name or
comment says otherwise.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import DEFAULTS, LATENCY_BUCKETS
from ..functions.scratch import stored
from ..operators import analytics, chaos, drift, incidents, ingest, integrity, latency, logs, metrics, report, shedding
from ..sources.synthetic import synthetic_ticks
from ..sources.ticks import RAW_SQL, TICKS_SQL, raw_ticks, ticks
from ..streaming import twins

#: Small captures, so that the fixture has many incidents.
SMALL = replace(DEFAULTS, pre_events=500, post_events=200)
#: The fixture's ticks are minutes apart: scrapes every hour, rates over four.
STEP_MS, RATE_MS = 3_600_000, 4 * 3_600_000
LRU_IDS = 3

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, with_ticks: str = TICKS_SQL):
    """Registers a function of (spark, sf_dir) under its name, with SQL over the ticks."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = f"with recursive {with_ticks}{sql}" if with_ticks else sql
        return function

    return add


# SQL pieces that several queries share
PRICED = """, priced as (
  select arrival_seq, product_id, price::decimal(19,8) * last_size::decimal(19,8) as pv, last_size::decimal(19,8) as v,
    row_number() over (partition by product_id order by arrival_seq desc) as newest
  from ticks where price > 0 and last_size >= 0 and ingest_ts_ms > 0
)"""
RETURNS = """, priced as (
  select arrival_seq, product_id, price, lag(price) over (partition by product_id order by arrival_seq) as before from ticks where price > 0
), returns as (
  select arrival_seq, product_id, ln(price / before) as r, row_number() over (partition by product_id order by arrival_seq desc) as newest
  from priced where before is not null
)"""
FLAGS = """, flagged as (
  select arrival_seq, event_id, product_id, trade_id, recv_ts_ms,
    row_number() over (partition by product_id, trade_id order by arrival_seq) > 1 as is_duplicate,
    coalesce(exchange_ms < max(exchange_ms) over (partition by product_id order by arrival_seq rows between unbounded preceding and 1 preceding), false) as is_out_of_order,
    coalesce(sequence > lag(sequence) over (partition by product_id order by arrival_seq) + 1, false) as is_gap
  from ticks
)"""
SPIKES = """, samples as (
  select arrival_seq, greatest(0, recv_ts_ms - ingest_ts_ms) as latency_ms, row_number() over (order by arrival_seq) as sample from ticks
), counted as (
  select *, sum((latency_ms > 100)::int) over (order by sample rows between 2999 preceding and current row) as over, least(sample, 3000) as n from samples
), breaches as (
  select *, n >= 100 and over >= n - n * 99 // 100 as is_breach from counted
), runs as (
  select *, sample - coalesce(max(case when not is_breach then sample end) over (order by sample rows unbounded preceding), 0) as run from breaches
), spiked as (
  select arrival_seq, sample, latency_ms, over::bigint as over, is_breach, is_breach and run % 2 = 0 as is_spike from runs
)"""


def captures(pre: int, post: int) -> str:
    """Triggers, and the recursion that resolves them."""
    return (
        FLAGS
        + SPIKES
        + f""", candidates as (
  select arrival_seq as seq, recv_ts_ms as recv_ms, case when is_spike then 'latency_spike' when is_duplicate then 'duplicate' else 'gap' end as kind
  from flagged join spiked using (arrival_seq) where is_spike or is_duplicate or is_gap
), chain as (
  select * from (select seq, recv_ms, kind, greatest(1, seq - {pre} + 1) as lo, seq + {post} as hi from candidates order by seq limit 1)
  union all
  select seq, recv_ms, kind, lo, hi from (
    select c.seq, c.recv_ms, c.kind, case when i.hi + 1 > c.seq then c.seq + 1 else greatest(i.hi + 1, c.seq - {pre} + 1) end as lo, c.seq + {post} as hi,
      row_number() over (order by c.seq) as k
    from chain i, candidates c where c.seq >= i.hi and c.recv_ms - i.recv_ms >= 60000
  ) where k = 1
), captured as (
  select *, sha256(seq || '|' || kind) as unused from chain where hi <= (select max(arrival_seq) from ticks)
)"""
    )


NAMED = """, reasoned as (
  select c.*, case kind when 'latency_spike' then 'latency_spike_p99=' || (
      select list_sort(list(latency_ms))[count(*) * 99 // 100 + 1] from spiked s
      where s.sample <= t.sample and s.sample > t.sample - 3000)::varchar || 'ms'
    when 'duplicate' then 'duplicate_detected' else 'sequence_gap' end as reason
  from captured c join spiked t on t.arrival_seq = c.seq
), incidents as (
  select strftime(make_timestamp(recv_ms * 1000), '%Y%m%d_%H%M%S') || '_' || left(sha256(seq || '|' || reason), 8) as incident_id,
    seq, recv_ms, reason, lo, hi from reasoned
)"""
EVENTS = ", bundle as (select incident_id, ticks.* from incidents join ticks on arrival_seq between lo and hi)"
SMALL_SQL = captures(500, 200) + NAMED


@query(PRICED + """
select arrival_seq, product_id, case when sum(v) over w > 0 then (sum(pv) over w)::double / (sum(v) over w)::double else 0.0 end as vwap, count(*) over w as window_rows
from priced window w as (partition by product_id order by arrival_seq rows between 199 preceding and current row)""")
def vwap_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.vwap_rolling(ticks(spark, sf_dir))


@query(PRICED + """
select product_id, case when sum(v) > 0 then sum(pv)::double / sum(v)::double else 0.0 end as vwap, count(*) as window_rows
from priced where newest <= 200 group by product_id""")
def vwap_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.vwap_snapshot(ticks(spark, sf_dir))


@query(RETURNS + " select arrival_seq, product_id, round(r, 8) as log_return from returns")
def log_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.log_returns(ticks(spark, sf_dir)).withColumn("log_return", F.round("log_return", 8))


@query(RETURNS + """
select product_id, count(*) as n_returns, round(avg(r), 8) as mean_return, round(stddev_pop(r) * sqrt(31536000.0) * 100, 4) as volatility_pct
from returns where newest <= 100 group by product_id having count(*) >= 10""")
def volatility_annualised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.volatility(ticks(spark, sf_dir))


ROLLED = """, rolled as (
  select arrival_seq, product_id, case when sum(v) over w > 0 then (sum(pv) over w)::double / (sum(v) over w)::double else 0.0 end as vwap, count(*) over w as window_rows
  from priced window w as (partition by product_id order by arrival_seq rows between 199 preceding and current row)
)"""


@query(PRICED + ROLLED + """
select recv_ts_ms // 5000 * 5000 + 5000 as at_ms, r.product_id, max_by(vwap, arrival_seq) as vwap, max_by(window_rows, arrival_seq) as window_rows
from rolled r join ticks using (arrival_seq) group by 1, 2""")
def vwap_every_5s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.vwap_periodic(ticks(spark, sf_dir))


@query(RETURNS + """, rolled as (
  select arrival_seq, product_id, count(*) over w as n, round(stddev_pop(r) over w * sqrt(31536000.0) * 100, 4) as pct
  from returns window w as (partition by product_id order by arrival_seq rows between 99 preceding and current row)
)
select recv_ts_ms // 10000 * 10000 + 10000 as at_ms, r.product_id, max_by(n, arrival_seq) as n_returns, round(max_by(pct, arrival_seq), 1) as volatility_pct
from rolled r join ticks using (arrival_seq) group by 1, 2 having max_by(n, arrival_seq) >= 10""")
def volatility_every_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.volatility_periodic(ticks(spark, sf_dir)).withColumn("volatility_pct", F.round("volatility_pct", 1))


@query("""
select recv_ts_ms // 10000 * 10000 as window_start_ms, product_id, sum(price::decimal(19,8) * last_size::decimal(19,8))::double as volume,
  count(*) as trades, sum(price::decimal(19,8) * last_size::decimal(19,8))::double / 10.0::double * 60.0::double as volume_per_minute
from ticks where price > 0 and last_size > 0 group by 1, 2""")
def volume_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.volume(ticks(spark, sf_dir))


@query("""
select recv_ts_ms // 5000 * 5000 as window_start_ms, count(*) as events, max_by(price, arrival_seq) as last_price, count(*) / 5.0::double as events_per_second
from ticks group by 1""")
def health_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.health(ticks(spark, sf_dir))


@query(" select max_by(price, arrival_seq) as last_price from ticks")
def last_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.last_price(ticks(spark, sf_dir))


@query("""
select arrival_seq, product_id, json_extract_string(raw, '$.price')::double as price, coalesce(json_extract_string(raw, '$.last_size')::double, 0) as last_size,
  json_extract_string(raw, '$.time') as time, json_extract_string(raw, '$.trade_id')::bigint as trade_id
from (select raw.*, json_extract_string(raw, '$.product_id') as product_id from raw)
where json_extract_string(raw, '$.type') = 'ticker' and json_extract_string(raw, '$.price') is not null""", RAW_SQL)
def valid_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding, the type filter, validation and pruning, from raw text."""
    objects, _ = ingest.decode(raw_ticks(spark, sf_dir))
    return ingest.prune(ingest.validate(ingest.only_type(ingest.fields(objects))), "arrival_seq").drop("type")


@query("""
select count(*) filter (price > 0 and last_size >= 0 and ingest_ts_ms > 0) as for_vwap, count(*) filter (price > 0) as for_volatility,
  count(*) filter (price > 0 and last_size > 0) as for_volume from ticks""")
def analysis_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ticks each analysis takes."""
    rows = ticks(spark, sf_dir)
    parts = [f(rows).agg(F.count(F.lit(1)).alias(n)) for n, f in (("for_vwap", ingest.for_vwap), ("for_volatility", ingest.for_volatility), ("for_volume", ingest.for_volume))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # single rows


@query(FLAGS + " select arrival_seq, is_duplicate, is_out_of_order, is_gap from flagged")
def integrity_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.flags(ticks(spark, sf_dir)).select("arrival_seq", "is_duplicate", "is_out_of_order", "is_gap")


@query(f""", touched as (
  select arrival_seq, product_id, trade_id, row_number() over (partition by product_id order by arrival_seq) as i from ticks
), pairs as (
  select *, lag(i) over (partition by product_id, trade_id order by i) as p from touched
)
select arrival_seq from pairs a where p is not null
  and (select count(distinct b.trade_id) from touched b where b.product_id = a.product_id and b.i > a.p and b.i < a.i) < {LRU_IDS}""")
def lru_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a memory of three ids only, so that it forgets."""
    return integrity.lru_duplicates(ticks(spark, sf_dir), LRU_IDS)


DRIFT = """, judged as (
  select arrival_seq, drift_kind,
    list_sort(list_filter(['type', 'product_id', 'price', 'last_size', 'time', 'ingest_ts_ms'], lambda x: not list_contains(json_keys(raw), x))) as missing,
    list_sort(list_filter(json_keys(raw), lambda x: not list_contains(['type', 'product_id', 'price', 'last_size', 'time', 'ingest_ts_ms', 'recv_ts_ms', 'trade_id', 'sequence'], x))) as unexpected,
    list_sort(list_filter([
      case when json_type(raw, '$.type') <> 'VARCHAR' then 'type' end, case when json_type(raw, '$.product_id') <> 'VARCHAR' then 'product_id' end,
      case when json_type(raw, '$.price') not in ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') then 'price' end,
      case when json_type(raw, '$.last_size') not in ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') then 'last_size' end,
      case when json_type(raw, '$.time') <> 'VARCHAR' then 'time' end,
      case when json_type(raw, '$.ingest_ts_ms') not in ('UBIGINT', 'BIGINT', 'BOOLEAN') then 'ingest_ts_ms' end], lambda x: x is not null)) as wrong
  from raw
), drifted as (
  select arrival_seq, drift_kind, coalesce(array_to_string(missing, ','), '') as missing_keys, coalesce(array_to_string(wrong, ','), '') as type_mismatches,
    coalesce(array_to_string(unexpected, ','), '') as unexpected_keys, len(missing) > 0 or len(wrong) > 0 as is_drift from judged
)"""


JUDGED = captures(500, 200) + DRIFT + """, marked as (
  select t.*, is_duplicate, is_out_of_order, is_gap, is_spike, coalesce(d.is_drift, false) as is_drift, c.seq is not null as is_incident
  from ticks t join flagged f using (arrival_seq) join spiked s using (arrival_seq) left join drifted d using (arrival_seq)
    left join captured c on c.seq = t.arrival_seq
)"""
COUNTED = JUDGED + """, counted_all as (
  select count(*) as processed, count(*) filter (is_drift) as drift, count(*) filter (is_duplicate) as duplicates, count(*) filter (is_out_of_order) as out_of_order,
    count(*) filter (is_gap) as gaps, count(*) filter (is_spike) as spikes, count(*) filter (is_incident) as incidents from marked
)"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticks with all flags: integrity, spikes, drift of their raw text, and whether they opened a (small) capture."""
    rows = stored(ticks(spark, sf_dir), "ticks")
    spiked = stored(latency.spikes(rows).select("arrival_seq", "is_spike"), "spiked")
    flagged = integrity.flags(rows)
    drifted = drift.check_drift(raw_ticks(spark, sf_dir)).select("arrival_seq", "is_drift")
    last_seq = rows.agg(F.max("arrival_seq")).first()[0]
    opened = incidents.resolve(incidents.triggers(rows, SMALL, spiked), last_seq, SMALL).select(F.col("seq").alias("arrival_seq"), F.lit(True).alias("is_incident"))
    joined = flagged.join(spiked, "arrival_seq", "left").join(drifted, "arrival_seq", "left").join(opened, "arrival_seq", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_spike", "is_drift", "is_incident")})


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.counters(marked(spark, sf_dir))


@query(COUNTED + " select * from counted_all", RAW_SQL)
def forensics_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir)


@query(COUNTED + """
select unnest(['schema_drift', 'duplicate', 'out_of_order', 'sequence_gap', 'latency_spike']) as type,
  unnest([drift, duplicates, out_of_order, gaps, spikes]) as total from counted_all""", RAW_SQL)
def anomalies_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.anomalies_by_type(counted(spark, sf_dir))


LATENCY = ", latencies as (select product_id, arrival_seq, recv_ts_ms - ingest_ts_ms as ms from ticks where recv_ts_ms >= ingest_ts_ms)"


@query(LATENCY + " ".join(["", *[f"select '{e}' as le, count(*) filter (ms <= {e}) as events from latencies union all" for e in LATENCY_BUCKETS], "select '+Inf', count(*) from latencies"]))
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.histogram(ticks(spark, sf_dir))


@query(LATENCY + " select coalesce(sum(ms), 0)::bigint as latency_sum, count(*) as latency_count, min(ms) as latency_min, max(ms) as latency_max from latencies")
def latency_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.latency_totals(ticks(spark, sf_dir))


@query(LATENCY + """
select coalesce(min(ms), 0) as latency_min_gauge from latencies
where arrival_seq > coalesce((select max(arrival_seq) from latencies where ms = 0), 0)""")
def latency_least_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.least_gauge(ticks(spark, sf_dir))


@query(""", valid as (
  select * from ticks where price > 0 and last_size >= 0 and ingest_ts_ms > 0 order by arrival_seq desc limit 3000
), newest as (select max(recv_ts_ms) as t from ticks), both_kinds as (
  select 'age' as kind, greatest(0, t - ingest_ts_ms) as ms from valid, newest union all select 'pipe', greatest(0, t - recv_ts_ms) from valid, newest
)
select kind, (list_sort(list(ms))[round_even(0.99 * (count(*) - 1), 0)::bigint + 1])::double as p99, count(*) as n from both_kinds group by kind""")
def latency_percentiles_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.percentiles_nearest(ticks(spark, sf_dir))


@query(LATENCY + """
select product_id, count(*) as n, list_sort(list(ms))[least(count(*) * 50 // 100, count(*) - 1) + 1] as p50,
  list_sort(list(ms))[least(count(*) * 95 // 100, count(*) - 1) + 1] as p95, list_sort(list(ms))[count(*) * 99 // 100 + 1] as p99
from latencies group by product_id""")
def latency_percentiles_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.percentiles_index(ticks(spark, sf_dir))


@query(SPIKES + " select arrival_seq, sample, over, is_breach, is_spike from spiked")
def latency_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.spikes(ticks(spark, sf_dir)).select("arrival_seq", "sample", "over", "is_breach", "is_spike")


@query(DRIFT + " select arrival_seq, missing_keys, type_mismatches, unexpected_keys, is_drift from drifted", RAW_SQL)
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.check_drift(raw_ticks(spark, sf_dir)).select("arrival_seq", "missing_keys", "type_mismatches", "unexpected_keys", "is_drift")


@query(DRIFT + " select drift_kind, count(*) as events, count(*) filter (is_drift) as detected from drifted group by drift_kind", RAW_SQL)
def drift_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = drift.check_drift(raw_ticks(spark, sf_dir))
    return judged.groupBy("drift_kind").agg(F.count(F.lit(1)).alias("events"), F.count_if("is_drift").alias("detected"))


def small_incidents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = stored(ticks(spark, sf_dir), "ticks")
    return rows, incidents.incidents(rows, SMALL)


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.capture(*small_incidents(spark, sf_dir), SMALL)


@query(SMALL_SQL + " select incident_id, seq, recv_ms, reason, lo, hi from incidents")
def incident_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_incidents(spark, sf_dir)[1]


@query(captures(5000, 2000) + NAMED + " select incident_id, seq, recv_ms, reason, lo, hi from incidents")
def incident_list_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the default capture sizes."""
    return incidents.incidents(ticks(spark, sf_dir))


@query(SMALL_SQL + EVENTS + " select incident_id, arrival_seq, product_id, trade_id, sequence, recv_ts_ms from bundle")
def incident_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles(spark, sf_dir).select("incident_id", "arrival_seq", "product_id", "trade_id", "sequence", "recv_ts_ms")


@query(SMALL_SQL + """
select incident_id, reason, strftime(make_timestamp(recv_ms * 1000), '%Y-%m-%dT%H:%M:%S.%f+00:00') as timestamp,
  least(hi - lo + 1, 500) as pre_events, hi - lo + 1 - 500 as post_events, hi - lo + 1 as total_events from incidents""")
def incident_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.meta(small_incidents(spark, sf_dir)[1], SMALL)


@query(SMALL_SQL + EVENTS + """, ms as (select incident_id, recv_ts_ms - ingest_ts_ms as ms from bundle where recv_ts_ms >= ingest_ts_ms)
select incident_id, min(ms) as latency_min, max(ms) as latency_max, avg(ms) as latency_avg, list_sort(list(ms))[count(*) * 99 // 100 + 1] as latency_p99
from ms group by incident_id""")
def report_latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.latency_stats(bundles(spark, sf_dir))


DUPLICATES = SMALL_SQL + EVENTS + """, dups as (
  select incident_id, trade_id, count(*) as occurrences, min(arrival_seq) as first_seq from bundle group by 1, 2 having count(*) > 1
), ranked as (select *, row_number() over (partition by incident_id order by first_seq) as place from dups)"""


@query(DUPLICATES + " select incident_id, trade_id, occurrences, first_seq, place from ranked where place <= 10")
def report_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.duplicates(bundles(spark, sf_dir))


@query(DUPLICATES + """
select incident_id, trade_id, place, copy, arrival_seq from (
  select incident_id, trade_id, place, arrival_seq, row_number() over (partition by incident_id, trade_id order by arrival_seq) as copy
  from bundle join ranked using (incident_id, trade_id) where place <= 3) where copy <= 2""")
def report_dup_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.duplicate_samples(bundles(spark, sf_dir)).select("incident_id", "trade_id", "place", "copy", "arrival_seq")


@query(SMALL_SQL + EVENTS + """
select incident_id, count(*) filter (exchange_ms < before) as out_of_order from (
  select incident_id, exchange_ms, lag(exchange_ms) over (partition by incident_id, product_id order by arrival_seq) as before from bundle) group by 1""")
def report_ooo_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.out_of_order(bundles(spark, sf_dir))


@query(SMALL_SQL + EVENTS + """, holes as (
  select *, row_number() over (partition by incident_id order by product_id, after) as place from (
    select incident_id, product_id, sequence as after, lead(sequence) over (partition by incident_id, product_id order by sequence) as before
    from (select distinct incident_id, product_id, sequence from bundle)) where before > after + 1
)
select incident_id, place, product_id, after, before, before - after - 1 as missing from holes where place <= 10""")
def report_gap_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.gaps(bundles(spark, sf_dir))


@query(SMALL_SQL + EVENTS + """
select incident_id, min(time) as first_time, max(time) as last_time, array_to_string(list_sort(list(distinct product_id)), ',') as symbols,
  max(exchange_ms) - min(exchange_ms) as duration_ms from bundle group by incident_id""")
def report_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.time_range(bundles(spark, sf_dir))


@query(SMALL_SQL + EVENTS + """
select incident_id, arrival_seq, trade_id from (
  select incident_id, arrival_seq, trade_id, row_number() over (partition by incident_id order by arrival_seq) as a,
    row_number() over (partition by incident_id order by arrival_seq desc) as z from bundle) where a <= 5 or z <= 5""")
def report_sample_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sample_events(bundles(spark, sf_dir)).select("incident_id", "arrival_seq", "trade_id")


@query(SMALL_SQL + EVENTS + """, ms as (
  select incident_id, list_sort(list(ms))[count(*) * 99 // 100 + 1] as latency_p99
  from (select incident_id, recv_ts_ms - ingest_ts_ms as ms from bundle where recv_ts_ms >= ingest_ts_ms) group by 1
), twice as (
  select incident_id, count(*) as n from (select incident_id, trade_id from bundle group by 1, 2 having count(*) > 1) group by 1
), late as (
  select incident_id, count(*) filter (exchange_ms < before) as out_of_order from (
    select incident_id, exchange_ms, lag(exchange_ms) over (partition by incident_id, product_id order by arrival_seq) as before from bundle) group by 1
), holes as (
  select incident_id, count(*) as n from (
    select incident_id, sequence, lead(sequence) over (partition by incident_id, product_id order by sequence) as before
    from (select distinct incident_id, product_id, sequence from bundle)) where before > sequence + 1 group by 1
), spans as (
  select incident_id, array_to_string(list_sort(list(distinct product_id)), ',') as symbols, max(exchange_ms) - min(exchange_ms) as duration_ms from bundle group by 1
)
select incident_id, reason, hi - lo + 1 as total_events, latency_p99, least(coalesce(twice.n, 0), 10) as duplicates_listed, out_of_order,
  least(coalesce(holes.n, 0), 10) as gaps_listed, symbols, duration_ms
from incidents join ms using (incident_id) left join twice using (incident_id) join late using (incident_id) left join holes using (incident_id) join spans using (incident_id)""")
def incident_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined reports, with their lists as lengths."""
    rows, found = small_incidents(spark, sf_dir)
    whole = report.reports(incidents.meta(found, SMALL), stored(incidents.capture(rows, found, SMALL), "bundles"))
    listed = [F.coalesce(F.size(c), F.lit(0)).cast("long").alias(name) for c, name in (("duplicate_ids", "duplicates_listed"), ("gaps", "gaps_listed"))]
    return whole.select("incident_id", "reason", "total_events", "latency_p99", "out_of_order", "symbols", "duration_ms", *listed)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.snapshots(ticks(spark, sf_dir), STEP_MS)


SNAPSHOTS = f""", steps as (
  select recv_ts_ms // {STEP_MS} * {STEP_MS} + {STEP_MS} as at_ms, count(*) as events, sum(recv_ts_ms - ingest_ts_ms) as s,
    {", ".join(f"count(*) filter (recv_ts_ms - ingest_ts_ms <= {e}) as b{i}" for i, e in enumerate(LATENCY_BUCKETS))}
  from ticks group by 1
), wide as (
  select at_ms, sum(events) over w as events, sum(s) over w as s, {", ".join(f"sum(b{i}) over w as b{i}" for i in range(len(LATENCY_BUCKETS)))}
  from steps window w as (order by at_ms rows unbounded preceding)
), samples as (
  select at_ms, 'events_total' as name, '' as label, events::double as value from wide
  union all select at_ms, 'latency_ms_sum', '', s::double from wide union all select at_ms, 'latency_ms_count', '', events::double from wide
  union all select at_ms, 'latency_ms_bucket', '+Inf', events::double from wide
  {" ".join(f"union all select at_ms, 'latency_ms_bucket', '{e}', b{i}::double from wide" for i, e in enumerate(LATENCY_BUCKETS))}
  union all select at_ms, 'events_per_second', '', events / ({STEP_MS} / 1000.0::double) from steps
), steps_up as (
  select *, coalesce(case when value < before then value else value - before end, 0) as d from (
    select *, lag(value) over (partition by name, label order by at_ms) as before from samples)
), grown as (
  select at_ms, name, label, value, sum(d) over w - first_value(d) over w as increase, at_ms - min(at_ms) over w as ms from steps_up
  window w as (partition by name, label order by at_ms range between {RATE_MS} preceding and current row)
), rates as (
  select at_ms, name, label, value, increase, case when ms > 0 then increase / (ms / 1000.0::double) else 0.0::double end as rate from grown
)"""


@query(SNAPSHOTS + " select at_ms, round(rate * 60, 9) as per_minute from rates where name = 'events_total'")
def prom_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.increase(samples(spark, sf_dir).filter("name = 'events_total'"), RATE_MS)
    return found.select("at_ms", F.round(F.col("rate") * 60, 9).alias("per_minute"))


@query(SNAPSHOTS + " select at_ms, name, label, increase from rates")
def prom_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.increase(samples(spark, sf_dir), RATE_MS).select("at_ms", "name", "label", "increase")


def quantile_sql(q: float) -> str:
    return SNAPSHOTS + f""", edges as (
  select at_ms, case when label = '+Inf' then 'infinity'::double else label::double end as edge, rate from rates where name = 'latency_ms_bucket'
), laid as (
  select *, coalesce(lag(edge) over w, 0) as low, coalesce(lag(rate) over w, 0) as under, max(rate) over (partition by at_ms) as total
  from edges window w as (partition by at_ms order by edge)
), hit as (
  select *, row_number() over (partition by at_ms order by edge) as k from laid where rate >= {q}::double * total and total > 0
)
select at_ms, round(case when edge = 'infinity'::double then low when rate = under then low
  else low + (edge - low) * ({q}::double * total - under) / (rate - under) end, 6) as quantile from hit where k = 1"""


@query(quantile_sql(0.99))
def prom_histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram_quantile(samples(spark, sf_dir), 0.99, RATE_MS).withColumn("quantile", F.round("quantile", 6))


@query(quantile_sql(0.5))
def prom_histogram_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram_quantile(samples(spark, sf_dir), 0.5, RATE_MS).withColumn("quantile", F.round("quantile", 6))


@query("""
select sum(recv_ts_ms - ingest_ts_ms)::double / count(*)::double as mean_latency_ms,
  case when avg(recv_ts_ms - ingest_ts_ms) >= 50 then 'red' when avg(recv_ts_ms - ingest_ts_ms) >= 10 then 'yellow' else 'green' end as band from ticks""")
def prom_avg_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean_latency(samples(spark, sf_dir))


@query(SNAPSHOTS + " select name, label, max_by(value, at_ms) as value from samples group by 1, 2")
def prom_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latest(samples(spark, sf_dir))


def shed_sql(direction: str) -> str:
    return f"""
select burst, count(*) filter (k <= 1000) as kept, count(*) filter (k > 1000) as dropped from (
  select (arrival_seq - 1) // 1500 as burst, row_number() over (partition by (arrival_seq - 1) // 1500 order by arrival_seq {direction}) as k from ticks) group by burst"""


def exposition_sql() -> str:
    lines: list[str] = []

    def head(name: str) -> None:
        kind, text = metrics.METRICS[name]
        lines.extend([f"'# HELP tideglass_{name} {text}'", f"'# TYPE tideglass_{name} {kind}'"])

    def sample(name: str, value: str, label: str = "") -> None:
        lines.append(f"'tideglass_{name}{label} ' || {value}")

    totals = {"events_total": "processed", "events_per_second": "printf('%.2f', eps)", "drops_total": "drops"}
    for name, value in totals.items():
        head(name)
        sample(name, value)
        lines.append("''")
    head("anomalies_total")
    for column, label in (("duplicates", "duplicate"), ("out_of_order", "out_of_order"), ("gaps", "sequence_gap"), ("drift", "schema_drift"), ("spikes", "latency_spike")):
        sample("anomalies_total", column, f'{{type="{label}"}}')
    lines.append("''")
    head("incidents_total")
    sample("incidents_total", "incidents")
    lines.append("''")
    head("latency_ms")
    for i, edge in enumerate(LATENCY_BUCKETS):
        sample("latency_ms_bucket", f"b{i}", f'{{le="{edge}"}}')
    sample("latency_ms_bucket", "c", '{le="+Inf"}')
    sample("latency_ms_sum", "s")
    sample("latency_ms_count", "c")
    lines.append("''")
    head("queue_depth_max")
    sample("queue_depth_max", "depth")
    buckets = ", ".join(f"count(*) filter (ms <= {e}) as b{i}" for i, e in enumerate(LATENCY_BUCKETS))
    return COUNTED + LATENCY + f""", latency_sums as (select coalesce(sum(ms), 0)::bigint as s, count(*) as c, {buckets} from latencies
), rates as (select count(*) / ((max(recv_ts_ms) - min(recv_ts_ms)) / 1000.0::double) as eps from ticks
), queues as ({shed_sql("desc")}), queue_sums as (select sum(dropped)::bigint as drops, max(kept) as depth from queues
), texts as (select [{", ".join(lines)}] as l from counted_all, latency_sums, rates, queue_sums)
select (i - 1)::int as place, l[i] as line from texts, unnest(range(1, len(l) + 1)) as u(i)"""


def queues(rows: DataFrame) -> DataFrame:
    return metrics.queue_totals(shedding.drops(shedding.shed(rows, 1500, DEFAULTS.consumer_queue)))


@query(exposition_sql(), RAW_SQL)
def prometheus_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(marked(spark, sf_dir), "marked")
    return metrics.exposition(rows, integrity.counters(rows), latency.histogram(rows), queues(rows))


MARKS = [("is_duplicate", "duplicate"), ("is_out_of_order", "out_of_order"), ("is_gap", "sequence_gap"), ("is_drift", "schema_drift"), ("is_spike", "latency_spike")]


@query(JUDGED + f""", per_step as (
  select recv_ts_ms // {STEP_MS} * {STEP_MS} + {STEP_MS} as at_ms, {", ".join(f"count(*) filter ({c}) as {c}" for c, _ in MARKS)} from marked group by 1
), long as ({" union all ".join(f"select at_ms, '{label}' as label, {c}::double as d from per_step" for c, label in MARKS)}
)
select at_ms, label, sum(d) over w - first_value(d) over w as increase from long
window w as (partition by label order by at_ms range between {RATE_MS} preceding and current row)""", RAW_SQL)
def prom_anomaly_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of each anomaly's counter over the window; a counter's first value is no growth."""
    found = metrics.snapshots(marked(spark, sf_dir), STEP_MS).filter("name = 'anomalies_total'")
    return metrics.increase(found, RATE_MS).select("at_ms", "label", "increase")


@query(COUNTED + f""", queues as ({shed_sql("desc")}), newest as (
  select count(*) / ({STEP_MS} / 1000.0::double) as eps from ticks where recv_ts_ms // {STEP_MS} = (select max(recv_ts_ms // {STEP_MS}) from ticks)
)
select unnest(['events_total', 'events_per_second', 'incidents_total', 'drops_total', 'queue_depth_max']) as name,
  unnest([processed::double, eps, incidents::double, (select sum(dropped) from queues)::double, (select max(kept) from queues)::double]) as value from counted_all, newest""", RAW_SQL)
def prom_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's single numbers: the last values of the totals and gauges."""
    rows = stored(marked(spark, sf_dir), "marked")
    found = metrics.latest(metrics.snapshots(rows, STEP_MS)).filter("name in ('events_total', 'events_per_second', 'incidents_total')").select("name", "value")
    held = queues(rows).select(F.explode(F.create_map(F.lit("drops_total"), F.col("drops").cast("double"), F.lit("queue_depth_max"), F.col("depth").cast("double"))).alias("name", "value"))
    return found.union(held)


@query("""
select recv_ts_ms // 5000 * 5000 + 5000 as at_ms, printf('eps=%.1f', count(*) / 5.0::double) || ' | price=' || max_by(price, arrival_seq)::varchar as line
from ticks group by 1""")
def log_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.health_lines(analytics.health(ticks(spark, sf_dir)), DEFAULTS.health_window_ms)


@query(JUDGED + f""", per_step as (
  select recv_ts_ms // {STEP_MS} * {STEP_MS} + {STEP_MS} as at_ms, count(*) as n, {", ".join(f"count(*) filter ({c}) as {c}" for c, _ in MARKS)}, count(*) filter (is_incident) as is_incident
  from marked group by 1
)
select at_ms, printf('processed=%d | drift=%d | dup=%d | ooo=%d | gaps=%d | spikes=%d | incidents=%d', (sum(n) over w)::bigint, (sum(is_drift) over w)::bigint,
  (sum(is_duplicate) over w)::bigint, (sum(is_out_of_order) over w)::bigint, (sum(is_gap) over w)::bigint, (sum(is_spike) over w)::bigint, (sum(is_incident) over w)::bigint) as line
from per_step window w as (order by at_ms rows unbounded preceding)""", RAW_SQL)
def log_forensics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.forensics_lines(metrics.snapshots(marked(spark, sf_dir), STEP_MS))


@query(quantile_sql(0.95))
def prom_histogram_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram_quantile(samples(spark, sf_dir), 0.95, RATE_MS).withColumn("quantile", F.round("quantile", 6))


@query()
def chaos_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows only: the permutation is by a hash that SQL engines do not share."""
    return chaos.shuffle(ticks(spark, sf_dir), 10, 7).select("arrival_seq", "trade_id")


@query()
def chaos_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaos.duplicate(ticks(spark, sf_dir), 0.05, 7).select("arrival_seq", "trade_id")


@query()
def chaos_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = raw_ticks(spark, sf_dir).filter("drift_kind < 0")
    injected = drift.check_drift(chaos.inject_drift(clean, 0.03, 7))
    return injected.groupBy("injected").agg(F.count(F.lit(1)).alias("events"), F.count_if("is_drift").alias("detected"))


@query(shed_sql("desc"))
def queue_drop_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shedding.drops(shedding.shed(ticks(spark, sf_dir), 1500, DEFAULTS.consumer_queue))


@query(shed_sql("asc"))
def queue_drop_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shedding.drops(shedding.shed(ticks(spark, sf_dir), 1500, DEFAULTS.drift_queue, "newest"))


@query()
def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic_ticks(spark, 10_000, 7)


@query("""
select recv_ts_ms // 10000 * 10000 as window_start_ms, product_id, sum(price::decimal(19,8) * last_size::decimal(19,8))::double as volume, count(*) as trades
from ticks where price > 0 and last_size > 0 group by 1, 2""")
def stream_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twins.stream_volume(spark, ticks(spark, sf_dir))


@query(FLAGS + " select arrival_seq, is_duplicate, is_out_of_order, is_gap from flagged")
def stream_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twins.stream_flags(spark, ticks(spark, sf_dir))


@query(PRICED + """
select arrival_seq, product_id, round(case when sum(v) over w > 0 then (sum(pv) over w)::double / (sum(v) over w)::double else 0.0 end, 6) as vwap
from priced window w as (partition by product_id order by arrival_seq rows between 199 preceding and current row)""")
def stream_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twins.stream_vwap(spark, ticks(spark, sf_dir)).withColumn("vwap", F.round("vwap", 6))


@query(SMALL_SQL + " select seq, kind, lo, hi from captured")
def stream_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twins.stream_incidents(spark, ticks(spark, sf_dir), SMALL)

"""Incident reports: all bundles' statistics at once, and one bundle's Markdown."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import order_statistic
from ..functions.scalars import index_floor, iso_ms, report_latency, symbol

KEY = ["incident_id"]


def latency_stats(events: DataFrame) -> DataFrame:
    """Least, largest, mean and p99 latency; an incident without samples is not there."""
    samples = events.select("incident_id", report_latency(F.col("ingest_ts_ms"), F.col("recv_ts_ms")).alias("ms")).filter("ms is not null")
    sums = samples.groupBy("incident_id").agg(F.min("ms").alias("latency_min"), F.max("ms").alias("latency_max"), F.avg("ms").alias("latency_avg"))
    return sums.join(order_statistic(samples, KEY, "ms", index_floor(99), "latency_p99").drop("n"), "incident_id")


def duplicates(events: DataFrame, most: int = 10) -> DataFrame:
    """The first trade_ids that occur more than once in a bundle, over all symbols, in order of first sight."""
    found = events.filter("trade_id is not null").groupBy("incident_id", "trade_id").agg(F.count(F.lit(1)).alias("occurrences"), F.min("arrival_seq").alias("first_seq")).filter("occurrences > 1")
    rank = F.row_number().over(Window.partitionBy("incident_id").orderBy("first_seq"))
    return found.withColumn("place", rank.cast("long")).filter(F.col("place") <= most)


def duplicate_samples(events: DataFrame, ids: int = 3, each: int = 2) -> DataFrame:
    """The first two events of each of the first three duplicate trade_ids."""
    chosen = duplicates(events, ids).select("incident_id", "trade_id", "place")
    rank = F.row_number().over(Window.partitionBy("incident_id", "trade_id").orderBy("arrival_seq"))
    return events.join(chosen, ["incident_id", "trade_id"]).withColumn("copy", rank.cast("long")).filter(F.col("copy") <= each)


def out_of_order(events: DataFrame) -> DataFrame:
    """Events whose time is under that of the event before, per symbol: neighbours are compared, unlike online."""
    timed = events.withColumns({"s": symbol(F.col("product_id"), "unknown"), "t": iso_ms(F.col("time"))}).filter("t is not null")
    before = F.lag("t").over(Window.partitionBy("incident_id", "s").orderBy("arrival_seq"))
    return timed.withColumn("b", before).groupBy("incident_id").agg(F.count_if(F.col("t") < F.col("b")).alias("out_of_order"))


def gaps(events: DataFrame, most: int = 10) -> DataFrame:
    """(after, before, missing): holes in the distinct sequences of a symbol, the first ten of each bundle.

    Symbols are taken by name.
    """
    distinct = events.filter("sequence is not null").select("incident_id", symbol(F.col("product_id"), "unknown").alias("product_id"), "sequence").distinct()
    after = F.lead("sequence").over(Window.partitionBy("incident_id", "product_id").orderBy("sequence"))
    holes = distinct.withColumn("before", after).filter(F.col("before") > F.col("sequence") + 1)
    rank = F.row_number().over(Window.partitionBy("incident_id").orderBy("product_id", "sequence"))
    named = holes.withColumn("place", rank.cast("long")).filter(F.col("place") <= most)
    return named.select("incident_id", "place", "product_id", F.col("sequence").alias("after"), "before", (F.col("before") - F.col("sequence") - 1).alias("missing"))


def time_range(events: DataFrame) -> DataFrame:
    """First and last time (as text), the time between, and the symbols, by name."""
    timed = F.when(F.col("time") != "", F.col("time"))
    found = events.groupBy("incident_id").agg(F.min(timed).alias("first_time"), F.max(timed).alias("last_time"), F.array_join(F.array_sort(F.collect_set(symbol(F.col("product_id"), "unknown"))), ",").alias("symbols"))
    return found.withColumn("duration_ms", F.coalesce(iso_ms(F.col("last_time")) - iso_ms(F.col("first_time")), F.lit(0)))


def sample_events(events: DataFrame, each: int = 5) -> DataFrame:
    """The first and last five events of a bundle, or all of one of up to ten."""
    by = Window.partitionBy("incident_id")
    ranked = events.withColumns({"__a": F.row_number().over(by.orderBy("arrival_seq")), "__z": F.row_number().over(by.orderBy(F.desc("arrival_seq")))})
    return ranked.filter((F.col("__a") <= each) | (F.col("__z") <= each)).drop("__a", "__z")


def reports(meta: DataFrame, events: DataFrame) -> DataFrame:
    """One row per incident with all statistics; lists in the order of the report."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "trade_id"))), lambda x: x["trade_id"])
    dups = duplicates(events).groupBy("incident_id").agg(ids.alias("duplicate_ids"))
    holes = F.transform(F.array_sort(F.collect_list(F.struct("place", "after", "before"))), lambda x: F.struct(x["after"].alias("after"), x["before"].alias("before")))
    holed = gaps(events).groupBy("incident_id").agg(holes.alias("gaps"))
    as_json = F.to_json(F.struct(*[c for c in events.columns if c not in ("incident_id", "arrival_seq")]))
    listed = lambda df, name: df.groupBy("incident_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("arrival_seq", as_json.alias("j")))), lambda x: x["j"]).alias(name))
    out = meta
    for part in (latency_stats(events), dups, out_of_order(events), holed, time_range(events), listed(sample_events(events), "samples"), listed(duplicate_samples(events), "duplicate_samples")):
        out = out.join(part, "incident_id", "left")
    return out


def cause(reason: str, duplicate_ids: list[int], holes: list[tuple[int, int]], p99: int) -> list[str]:
    """The lines that explain what set the incident off."""
    kind = reason.lower()
    if "duplicate" in kind:
        first = f"Duplicate trade_id detected: `{duplicate_ids[0]}`" if duplicate_ids else "Duplicate event detected"
        return [f"- **Cause:** {first}", f"- **Total duplicates found:** {len(duplicate_ids)}"]
    if "gap" in kind or "sequence" in kind:
        first = f"Sequence gap detected between `{holes[0][0]}` and `{holes[0][1]}`" if holes else "Sequence gap detected"
        return [f"- **Cause:** {first}", f"- **Total gaps found:** {len(holes)}"]
    if "latency" in kind or "spike" in kind:
        return [f"- **Cause:** Latency spike detected (p99 = {p99}ms)"]
    return ["- **Cause:** Schema drift detected" if "drift" in kind else f"- **Cause:** {reason}"]


def table(head: tuple[str, str], rows: Mapping[str, str]) -> list[str]:
    rule = "|" + "|".join("-" * (len(h) + 2) for h in head) + "|"
    return [f"| {head[0]} | {head[1]} |", rule, *[f"| {k} | {v} |" for k, v in rows.items()], ""]


def markdown(report: Mapping, analysis: str | None = None) -> str:
    """One report row (a dict) as Markdown; analysis is appended under a heading of its own."""
    r = {k: v for k, v in report.items() if v is not None}
    gaps_found = [(g["after"], g["before"]) for g in r.get("gaps", [])]
    ids, p99 = r.get("duplicate_ids", []), r.get("latency_p99", 0)
    counts = f"{r.get('total_events', 0):,} ({r.get('pre_events', 0):,} pre + {max(0, r.get('post_events', 0)):,} post)"
    triggered = r.get("timestamp", "")
    if len(triggered) >= 19 and triggered[10] == "T":
        triggered = triggered[:19].replace("T", " ") + " UTC"
    lines = [f"# Incident Report: {r['incident_id']}", "", "## Summary", ""]
    summary = {
        "**Type**": f"`{r.get('reason', 'unknown')}`",
        "**Triggered**": triggered,
        "**Duration**": f"{r.get('duration_ms', 0):,}ms",
        "**Affected Symbols**": ", ".join(r.get("symbols", "").split(",")) or "N/A",
        "**Total Events**": counts,
    }
    lines += table(("Field", "Value"), summary)
    lines += ["## Latency Stats", ""]
    stats = {"Min": f"{r.get('latency_min', 0)}ms", "Max": f"{r.get('latency_max', 0)}ms", "Avg": f"{r.get('latency_avg', 0.0):.1f}ms", "p99": f"{p99}ms"}
    lines += table(("Metric", "Value"), stats)
    lines += ["## Trigger Context", "", *cause(r.get("reason", "unknown"), ids, gaps_found, p99), f"- **Latency p99 at trigger:** {p99}ms"]
    if r.get("out_of_order", 0) > 0:
        lines.append(f"- **Out-of-order events:** {r['out_of_order']}")
    lines += ["", "## Evidence Samples", ""]
    if r.get("duplicate_samples"):
        lines += ["### Duplicate Events", "```json", *r["duplicate_samples"][:4], "```", ""]
    if gaps_found:
        lines += ["### Sequence Gaps", *[f"- Gap between sequence `{a}` and `{b}` (missing {b - a - 1} events)" for a, b in gaps_found[:5]], ""]
    lines += ["### Sample Events (first 5)", "```json", *r.get("samples", [])[:5], "```", ""]
    if analysis is not None:
        lines += ["---", "", "## AI Analysis", "", analysis]
    return "\n".join(lines)


def pretty(event: str) -> str:
    """An event's JSON, indented."""
    return json.dumps(json.loads(event), indent=2, ensure_ascii=False)

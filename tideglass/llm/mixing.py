"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions.

Every source's documents are shuffled; a document's virtual finish time is
the source's running words divided by the source's target. Merged by that
time all sources fill in proportion, and the merge is cut at the budget.
Running sums are taken in two passes (per bucket, then within buckets), so
neither a source nor the merged order is ever in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_groups, materialize, with_row_key, word_count

#: Rows that a bucket of a running sum holds, on average.
BUCKET_ROWS = 20_000


def source_targets(sizes: DataFrame, weights: Sequence[float], limit: int, budget: int | None) -> DataFrame:
    """Per source: source_rank, source_size, n_docs, target.

    Sources by code point, null last, get the weights in turn. The budget
    (default: all words) is shared by weight; no target passes `limit` times
    its source's size, and what is over is shared again among the others.
    Sorted by limit * size / weight the full sources come first, so sums
    over that order give the final level at once. One row per source.
    """
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "source_rank")
    before, onwards = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) if budget is None else F.lit(int(budget))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int"))
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("source_rank", F.row_number().over(by_name).cast("long"))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(limit))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", total.cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onwards))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
        .withColumn("target", F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")))
        .select("source", "source_rank", "source_size", "n_docs", "target")
    )


def _finish(epoch: int) -> Column:
    passed = F.col("source_size") * epoch + F.col("cum")
    return F.when(F.col("target") > 0, passed.cast("double") / F.col("target")).otherwise(F.when(passed == 0, 0.0).otherwise(float("inf")))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), limit: int = 3, budget: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, finish, copies, taken, and the carried columns.

    finish is the virtual finish time of the first copy, copies (0 to
    `limit`) how often the mix takes the document, taken = copies * size.
    The order in a source is that of md5(doc_id), so reruns agree. A null
    text has size 0, a null source is a source, a null id is shuffled as the
    empty string. Equal rows stand at one place each; if the cut meets them
    they are taken alike. Documents without words cost nothing and are taken
    when their turn is within the budget. Empty in, empty out. The results'
    names win over carried ones. Only ids and sizes go through the sorts;
    carried columns are joined to the finished mix by row.
    """
    own = {"doc_id", "source", "size", "source_size", "target", "finish", "copies", "taken"}
    carried = [c for c in carry if c not in own]
    keyed = with_row_key(docs, ["doc_id", "source", "text", *[c for c in carried if c != "text"]]) if carried else docs.withColumn("__row", F.lit(None))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    narrow = materialize(keyed.select("__row", "doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("order_key")), "mix-sizes")
    n_docs = narrow.count()
    buckets = max(1, -(-n_docs // BUCKET_ROWS))
    # 15 hex digits are 60 bits
    bucket = F.floor(F.conv(F.substring("order_key", 1, 15), 16, 10).cast("double") / float(2**60) * buckets).cast("long")
    narrow = narrow.withColumn("bucket", bucket)
    sources = materialize(source_targets(narrow, weights, limit, budget), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0 if budget is None else int(budget)

    in_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = narrow.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = before.withColumn("before", F.coalesce(F.sum("bucket_size").over(in_source), F.lit(0))).select(
        F.col("source").alias("__s"), F.col("bucket").alias("__b"), "before"
    )
    placed = narrow.join(before, narrow["source"].eqNullSafe(before["__s"]) & (narrow["bucket"] == before["__b"]), "left").drop("__s", "__b")
    in_bucket = Window.partitionBy("source", "bucket").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("cum", F.col("before") + F.sum("size").over(in_bucket)).drop("before", "bucket")
    placed = materialize(join_groups(placed, sources, ["source"], "n_docs", n_docs), "mix-placed")

    rank = ["finish", "source_rank", "order_key", "epoch"]
    items = placed.select("source_rank", "order_key", "size", F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), _finish(e).alias("finish")) for e in range(limit)])).alias("item"))
    items = items.select("source_rank", "order_key", "size", "item.epoch", "item.finish").withColumn("slot", F.floor(F.least("finish", F.lit(1e9)) * max(64, buckets * limit)).cast("long"))
    # the slot of the merged order in which the budget ends, then the place within that slot
    slots = items.groupBy("slot").agg(F.sum("size").alias("slot_size"))
    upto = F.sum("slot_size").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    cut = slots.withColumn("upto", upto).filter(F.col("upto") > total).orderBy("slot").first()
    taken = [F.lit(1)] * limit
    if cut is not None:
        within = F.sum("size").over(Window.orderBy(*rank).rowsBetween(Window.unboundedPreceding, 0))
        left = total - (cut["upto"] - cut["slot_size"])
        last = items.filter(F.col("slot") == cut["slot"]).withColumn("upto", within).filter(F.col("upto") <= left).orderBy(*[F.desc(c) for c in rank]).first()
        scale, place = F.lit(max(64, buckets * limit)), None
        if last is not None:
            place = F.struct(F.lit(last["finish"]), F.lit(last["source_rank"]).cast("long"), F.lit(last["order_key"]), F.lit(last["epoch"]))
        for e in range(limit):
            slot = F.floor(F.least(_finish(e), F.lit(1e9)) * scale).cast("long")
            here = F.struct(_finish(e), F.col("source_rank"), F.col("order_key"), F.lit(e)) <= place if place is not None else F.lit(False)
            taken[e] = F.when(slot < cut["slot"], 1).when(slot == cut["slot"], here.cast("int")).otherwise(0)
    copies = sum(taken[1:], taken[0]).cast("long")
    found = placed.select("__row", "doc_id", "source", "size", "source_size", "target", _finish(0).alias("finish"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    if not carried:
        return found.drop("__row")
    found = found.withColumnRenamed("__row", "__mixed")
    rest = keyed.select("__row", *carried)
    joined = rest.join(F.broadcast(found) if n_docs <= BROADCAST_ROWS else found, F.col("__row") == F.col("__mixed"))
    return joined.select(*[c for c in found.columns if c != "__mixed"], *carried)


OP9_SQL = r"""
with sizes as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5(coalesce(doc_id::varchar, '')) as k
  from documents
), s1 as (
  select source, sum(size)::bigint as source_size from sizes group by source
), s2 as (
  select *, row_number() over (order by source asc nulls last) as r from s1
), s3 as (
  select *, [5.0::double, 2.0::double, 1.0::double][((r - 1) % 3 + 1)::int] as w, source_size * 3.0::double as cap from s2
), s4 as (
  select *, cap / w as ratio, (sum(source_size) over ())::double as total from s3
), s5 as (
  select *, (total - coalesce(sum(cap) over (order by ratio, r rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by ratio, r rows between current row and unbounded following) as level from s4
), s6 as (
  select *, max(case when level <= ratio then level end) over () as lam from s5
), s7 as (
  select source, r, source_size, total, least(coalesce(lam * w, cap), cap) as target from s6
), placed as (
  select sizes.*, r, source_size, total, target,
    (sum(size) over (partition by sizes.source order by k, doc_id, size rows unbounded preceding))::bigint as cum
  from sizes join s7 on sizes.source is not distinct from s7.source
), items as (
  select placed.*, e, case when target > 0 then (source_size * e + cum)::double / target
    when source_size * e + cum = 0 then 0.0 else 'infinity'::double end as finish
  from placed, (values (0), (1), (2)) as epochs(e)
), merged as (
  select *, sum(size) over (order by finish, r, k, e rows unbounded preceding) as upto from items
)
select doc_id, source, size, source_size, target,
  min(case when e = 0 then finish end) as finish,
  count(*) filter (upto <= total) as copies,
  (size * count(*) filter (upto <= total))::bigint as taken
from merged group by doc_id, source, size, source_size, target, k, r
"""

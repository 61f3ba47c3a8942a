"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A log often holds a conversation after each turn. Rolling hashes of the
turn prefixes find conversations that are a prefix of a longer one; an
anti-join keeps the maximal ones, and only those are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, h1, h2) per turn: two rolling hashes of the turns so far.

    A rolling hash is the running sum of hashes of (place, role, text), so a
    window extends it turn by turn, however long the conversation is. Turns
    are placed by turn, then role, then text, nulls first.
    """
    at = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.select("conv_id", F.row_number().over(at).alias("place"), "role", "text")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = F.xxhash64("place", F.octet_length(role), role, text)
    two = F.xxhash64(F.lit(97), F.col("place"), F.octet_length(role), role, text)
    hashed = placed.select("conv_id", "place", one.cast("decimal(20,0)").alias("x1"), two.cast("decimal(20,0)").alias("x2"))
    upto = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return hashed.select("conv_id", "place", F.sum("x1").over(upto).alias("h1"), F.sum("x2").over(upto).alias("h2"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of conversations that prefix no longer one.

    Equal conversations count once, under the smallest conv_id, and n_copies
    says how often they occur. Both sides of the anti-join are distinct
    hashes, so a very common first turn is one row in it.
    """
    prefixes = materialize(turn_prefixes(turns), "prefixes")
    sizes = prefixes.groupBy("conv_id").agg(F.max("place").alias("n_turns")).withColumnRenamed("conv_id", "__conv")
    ends = prefixes.join(sizes, prefixes["conv_id"].eqNullSafe(sizes["__conv"])).drop("__conv")
    ends = materialize(ends, "ends")
    whole = ends.filter("place = n_turns").groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = ends.filter("place < n_turns").select(F.col("place").alias("p"), F.col("h1").alias("q1"), F.col("h2").alias("q2")).distinct()
    same = (whole["n_turns"] == inner["p"]) & (whole["h1"] == inner["q1"]) & (whole["h2"] == inner["q2"])
    return whole.join(inner, same, "left_anti").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies, rendered.

    Each turn renders as <|im_start|>role, a line break, the text,
    <|im_end|> and a line break. Null role or text renders, and compares, as
    empty; null turns come first; a null conv_id is a conversation of its own; rows that
    repeat a turn are turns of their own, by role and text. Empty in, empty
    out; other columns are not looked at.
    """
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kept = materialize(maximal_conversations(turns), "maximal")
    chosen = kept.withColumnRenamed("conv_id", "__conv")
    parts = turns.join(chosen, turns["conv_id"].eqNullSafe(chosen["__conv"])).select("conv_id", "n_turns", "n_copies", F.struct("turn", "role", "text").alias("part"))
    gathered = parts.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_sort(F.collect_list("part")).alias("parts"))
    lines = F.transform("parts", lambda p: F.concat(F.lit("<|im_start|>"), p["role"], F.lit("\n"), p["text"], F.lit("<|im_end|>\n")))
    return gathered.select("conv_id", "n_turns", "n_copies", F.array_join(lines, "").alias("rendered"))


OP5_SQL = r"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place,
    coalesce(role, '') as role, coalesce(text, '') as text
  from conversations
), whole as (
  select conv_id, count(*) as n_turns, list(struct_pack(r := role, t := text) order by place) as turns,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by place) as rendered
  from turns group by conv_id
), once as (
  select min(conv_id) as conv_id, n_turns, turns, rendered, count(*) as n_copies from whole group by n_turns, turns, rendered
)
select conv_id, n_turns, n_copies, rendered from once a
where not exists (select 1 from whole b where b.n_turns > a.n_turns and b.turns[1:a.n_turns] = a.turns)
"""

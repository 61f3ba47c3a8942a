"""Exact dedup, decontamination, chat formatting, URL filter, mixing: small cases and brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.llm import chat, decontaminate, exact_chunks, host_reputation, mixing, order_minhash, toxicity
from tideglass.llm.common import ascii_lower, join_groups, materialize, remove_scratch, without_ids, word_count

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def test_ascii_lower_touches_a_to_z_only(spark):
    text = "AZ aÄÉİΣ ẞ"
    assert spark.range(1).select(ascii_lower(F.lit(text)), ascii_lower(F.lit("ABC"))).first()[:] == ("az aÄÉİΣ ẞ", "abc")


def test_word_count(spark):
    texts = ["a b", "", None, "\u00a0x\u2003y \t\n\x0b\x0c\r z", "  "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(word_count(F.col("text"))).collect()] == [2, 0, 0, 2, 0]


def test_join_groups_keeps_every_row(spark):
    keys = ["hot"] * 50 + [f"k{i}" for i in range(50)] + [None, None]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i long, k string")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = join_groups(rows, groups, ["k"], "n", len(keys), 4).collect()
    assert sorted((r["i"], r["n"]) for r in got) == sorted((i, keys.count(k)) for i, k in enumerate(keys))
    some = join_groups(rows, groups.filter("k in ('hot', 'k3')"), ["k"], "n", len(keys), 4, how="inner")
    assert some.count() == 51


def test_without_ids_keeps_null(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "doc_id long")
    assert sorted(str(r[0]) for r in without_ids(df, df.filter("doc_id = 2")).collect()) == ["1", "None"]


def test_scratch_is_removed(spark):
    kept = materialize(spark.range(3), "probe")
    assert kept.count() == 3 and remove_scratch(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0]).count()


def equal_texts(rows):
    groups: dict = {}
    for i, t, _ in rows:
        norm = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        groups.setdefault(norm, []).append(i)
    return groups


@pytest.mark.parametrize("identifiers", [exact_chunks.IDENTIFIERS, (lambda c: F.length(c), exact_chunks.content), (lambda c: F.length(c),)])
def test_exact_dedup_brute_force(spark, identifiers):
    """A weak identifier (the length) must be seen through and replaced."""
    rng = random.Random(4)
    words = ["One.", "two", "THREE\n", "vier", "Ünf", "six!"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(900))) for _ in range(12)] + ["", "x" * 20_000, "x" * 20_001]
    rows = [(i, None if rng.random() < 0.1 else rng.choice([str, str.upper, str.title])(rng.choice(base)), "s") for i in range(80)]
    got = {r["doc_id"]: r for r in exact_chunks.dedup_exact(documents(spark, rows), identifiers=identifiers).collect()}
    assert len(got) == len(rows)
    for norm, ids in equal_texts(rows).items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()


def test_chunks_join_to_the_text(spark):
    texts = ["", "a", "é" * 9000, ("word. " * 3000), "\n" * 5000, "\U0001f600." * 4000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", exact_chunks.chunks(F.col("text")).alias("c")).collect():
        assert "".join(r["c"]) == r["text"] and all(len(c) <= 8192 for c in r["c"])
    # an early insertion moves later cuts no further than a chunk or two
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(5)) + rng.choice(["", "", "", "."]) for _ in range(9000))
    a, b = (r[0] for r in spark.createDataFrame([(text,), ("Xyz " + text,)], "t string").select(exact_chunks.chunks(F.col("t"))).collect())
    assert len(set(a) & set(b)) > len(a) / 2


def test_exact_dedup_edges(spark):
    assert exact_chunks.dedup_exact(documents(spark, [])).collect() == []
    rows = [(None, "a", "s"), (5, "A", "s"), (5, "a", None), (1, None, "s"), (2, "", "s")]
    df = documents(spark, rows).withColumns({"recipe": F.lit(1), "kept": F.lit("x"), "row": F.lit(0)})
    got = sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in exact_chunks.dedup_exact(df).collect())
    assert got == [("1", 2, 2, False), ("2", 2, 2, True), ("5", 5, 3, False), ("5", 5, 3, True), ("None", 5, 3, False)]
    assert sorted(r["doc_id"] for r in exact_chunks.keep_one_of_each(df.filter("doc_id < 5")).collect()) == [2]


def test_stages_judge_rows_without_or_with_repeated_ids(spark, tmp_path):
    rng = random.Random(14)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    other = " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    rows = [(None, text, "s"), (None, text, "s"), (7, other, "s"), (7, other, "s"), (7, other + " more", "s"), (None, other + " on", "s"), (8, "unlike", "s")]
    documents(spark, rows).write.parquet(str(tmp_path / "d"))
    for docs in (spark.read.parquet(str(tmp_path / "d")), documents(spark, rows)):
        texts = lambda df: sorted(r["text"] for r in df.collect())
        assert texts(exact_chunks.keep_one_of_each(docs)) == sorted({t for _, t, _ in rows})
        assert texts(order_minhash.keep_one_of_each(docs)) == sorted([text, other + " on", "unlike"])
        bench = spark.createDataFrame([(1, text)], "item_id long, text string")
        assert text not in texts(decontaminate.decontaminate(docs, bench))
        assert decontaminate.decontaminate(docs, bench).count() == 5
    model = toxicity.FactorizationMachine(-5.0, *(lambda t: (t, [10.0] * len(t), [[0.0]] * len(t)))(toxicity.TermHasher()("unlike")))
    model.weights, model.vectors = np.array(model.weights), np.array(model.vectors)
    rows = [(None, "unlike", "s"), (7, "unlike", "s"), (7, "fine", "s"), (None, "fine", "s")]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity, "fit", lambda docs, labels: model)
        assert [r["text"] for r in toxicity.drop_toxic(documents(spark, rows), None).collect()] == ["fine"] * 2


def fixed_mix(rows, limit=3):
    """Targets by the stated rounds: cap, reshare, repeat."""
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped: dict = {}
    while True:
        rest = sum(sizes.values()) - sum(capped.values())
        free = [s for s in order if s not in capped]
        total = sum(weights[s] for s in free)
        targets = capped | {s: rest * weights[s] / total for s in free}
        over = [s for s in free if targets[s] > limit * sizes[s]]
        if not over:
            return sizes, targets
        capped |= {s: limit * sizes[s] for s in over}


def test_mix_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 40)
    rng = random.Random(6)
    rows = [(i, None if rng.random() < 0.02 else "w " * rng.randrange(30), rng.choice(["a"] * 20 + ["b"] * 5 + ["c", "d", None])) for i in range(900)]
    got = mixing.mix_sources(documents(spark, rows)).collect()
    sizes, targets = fixed_mix(rows)
    assert len(got) == 900 and sum(r["taken"] for r in got) <= sum(sizes.values())
    taken: dict = {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 60 for s in sizes)
    again = mixing.mix_sources(documents(spark, rows).repartition(3)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    one_bucket = mixing.source_targets
    assert one_bucket is mixing.source_targets
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10**6)
    whole = mixing.mix_sources(documents(spark, rows), carry=["text", "size", "lang"]).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in whole)
    assert {"text", "lang"} <= set(whole[0].asDict())


def test_mix_edges(spark):
    assert mixing.mix_sources(documents(spark, [])).collect() == []
    empty = mixing.mix_sources(documents(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in empty] == [(0, 0, 0.0)] * 2
    ties = mixing.mix_sources(documents(spark, [(None, "a b", "x")] * 3 + [(7, "a", "y")])).collect()
    assert len(ties) == 4 and sum(r["taken"] for r in ties) <= 7


PASSAGE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree at dawn"


def test_decontamination(spark):
    words = PASSAGE.split()
    swapped = list(words)
    for k in (3, 9, 15):
        swapped[k] = "zzz"
    broken = [w if i % 3 else "zzz" for i, w in enumerate(words)]
    texts = {
        1: "intro " * 30 + PASSAGE + " outro",
        2: "start " + " ".join(swapped).upper() + "!",
        3: " ".join(broken),
        4: "nothing of the kind here " * 40,
        5: None,
        6: "",
        7: ", ".join(words[:20]),
        8: " ".join(words[:9] + ["many", "other", "words"] * 10),
    }
    docs = documents(spark, [(i, t, "s") for i, t in texts.items()]).withColumns({"words": F.lit(1), "item_id": F.lit(2), "n": F.lit("x")})
    bench = spark.createDataFrame([(10, PASSAGE), (11, "too short"), (12, None), (10, PASSAGE)], "item_id long, text string")
    found = decontaminate.find_overlaps(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, 10), (2, 10), (7, 10)]
    assert {r["doc_id"]: r["matched"] for r in found} == {1: 20, 2: 17, 7: 20}
    kept = decontaminate.decontaminate(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 8] and kept.columns == docs.columns
    assert decontaminate.find_overlaps(docs.limit(0), bench).collect() == [] == decontaminate.find_overlaps(docs, bench.limit(0)).collect()


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_decontamination_brute_force(spark, monkeypatch, broadcast):
    """Every overlap of 0.8 is found, by whichever join, however short the item."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (5, 5, 6, 7, 8, 9, 10, 10, 11, 12, 15, 19, 24, 29)]
    docs = []
    for i in range(240):
        item = items[i % len(items)]
        piece = [w if rng.random() > rng.choice([0, 0.1, 0.2, 0.4]) else rng.choice(vocabulary) for w in item[rng.randrange(3) :]]
        docs.append([rng.choice(vocabulary) for _ in range(rng.randrange(20))] + piece + [rng.choice(vocabulary) for _ in range(rng.randrange(20))])
    want = set()
    for i, d in enumerate(docs):
        for j, item in enumerate(items):
            length = min(20, len(item))
            for start in range(-len(item), len(d)):
                equal = [0 <= start + p < len(d) and d[start + p] == w for p, w in enumerate(item)]
                if any(sum(equal[p : p + length]) >= 0.8 * length for p in range(len(item) - length + 1)):
                    want.add((i, j))
    frame = documents(spark, [(i, " ".join(d), "s") for i, d in enumerate(docs)])
    bench = spark.createDataFrame([(j, " ".join(t)) for j, t in enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_overlaps(frame, bench).collect()} == want and len({j for _, j in want}) == len(items)


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_collapse_and_render(spark):
    a = [("user", "hi"), ("assistant", "yes"), ("user", "more")]
    rows = [(c, t, *a[t]) for c, n in ((1, 1), (2, 2), (3, 3), (4, 3)) for t in range(n)]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "no"), (6, 0, None, None), (7, None, "user", "n"), (None, 0, "user", "lost"), (8, 1, "b", "y"), (8, 1, "a", "z")]
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["rendered"]) for r in chat.format_chats(spark.createDataFrame(rows, TURNS).withColumn("place", F.lit(0))).collect()}
    line = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got == {
        3: (3, 2, "".join(line(*t) for t in a)),
        5: (2, 1, line("user", "hi") + line("assistant", "no")),
        6: (1, 1, line("", "")),
        7: (1, 1, line("user", "n")),
        None: (1, 1, line("user", "lost")),
        8: (2, 1, line("a", "z") + line("b", "y")),
    }
    assert chat.format_chats(spark.createDataFrame([], TURNS)).collect() == []


def test_chat_prefix_needs_equal_roles_and_cuts(spark):
    """Role and text do not run into each other."""
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (2, 1, "x", "y")]
    assert {r["conv_id"] for r in chat.format_chats(spark.createDataFrame(rows, TURNS)).collect()} == {1, 2}


URLS = {
    "https://WWW.Example.ORG/es/x?q": ("www.example.org", "/es/x", "example.org/es/", "block"),
    "http://example.org/en/17": ("example.org", "/en/17", "example.org/en/1", "block"),
    "http://example.org/en/2#a": ("example.org", "/en/2", "org/", "allow"),
    "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"),
    "http://x.com/de/a": ("x.com", "/de/a", "com/de/", "block"),
    "http://x.org": ("x.org", "", None, None),
    "http://x.com?/de/": ("x.com", "", None, None),
    "x.com/de/": ("", "", None, None),
    "a://b://c/d": ("b:", "//c/d", None, None),
    None: ("", "", None, None),
    "": ("", "", None, None),
    "http://ÄB.com/É": ("Äb.com", "/É", None, None),
}


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, good int")
    got = {r["page_id"]: r for r in host_reputation.judge_urls(pages, none).collect()}
    for i, (host, path, rule, verdict) in enumerate(URLS.values()):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict or (verdict is None and r["verdict"] in ("allow", "block") and r["good_rate"] == 0.5)
    assert host_reputation.judge_urls(pages.limit(0), none).collect() == []


def test_reputation_shrinks(spark):
    """A host without labels follows its domain, one with few is pulled to it, one with many is itself."""
    rows, outcomes, page = [], [], 0
    for host, n, good in (("a.bad.net", 40, 2), ("b.bad.net", 40, 4), ("c.bad.net", 0, 0), ("d.bad.net", 1, 1), ("a.good.net", 200, 200), ("b.good.net", 0, 0), ("one.good.net", 60, 3)):
        for k in range(max(n, 3)):
            rows.append((page, f"http://{host}/{k}"))
            if k < n:
                outcomes.append((page, int(k < good)))
            page += 1
    judged = host_reputation.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good int"))
    rate = {r["host"]: r["good_rate"] for r in judged.select("host", "good_rate").distinct().collect()}
    assert rate["a.bad.net"] < 0.2 and rate["c.bad.net"] < 0.5 < rate["b.good.net"] and rate["d.bad.net"] < 0.75
    assert rate["one.good.net"] < 0.2 < rate["b.good.net"]
    verdict = {r["host"]: r["verdict"] for r in judged.select("host", "verdict").distinct().collect()}
    assert verdict["a.bad.net"] == "block" and verdict["a.good.net"] == "allow"

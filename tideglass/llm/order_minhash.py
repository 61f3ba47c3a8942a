"""Near-duplicate detection by Order MinHash and banded alignment.

A text's k-mers are its runs of five words, each labelled with its
occurrence number. One sketch draws two k-mers of least hash and keeps them
in text order, so texts agree on it with a chance that falls with their edit
distance, moves of passages included. Texts that share a sketch are aligned
within the band that the threshold allows, and linked if they pass; classes
are the connected components of the links.

Texts of more than WHOLE words draw one k-mer from their first half and one
from their second, so texts that have one passage in common and differ
elsewhere seldom meet, however many they are. Shorter ones draw both from the
whole text, and draw more often. Texts of at most SHORT words are met through
pieces, of which an edited text keeps one: no link is missed there. Other
links are found with a chance that grows with the similarity; README.md has
the measured recall.

Texts of the same words are one from the start. Then each text is aligned
with the leaders of the buckets of its first sketches, which connects most of
every group in a number of pairs that grows with the texts only. All buckets
that still hold several components are then compared whole, within tasks that
hold a bounded block of a bucket (or two), and only links leave them: every
two texts that share a sketch are aligned, connected by other links, or ruled
out by their lengths or counts of words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_groups, materialize, rows_per_batch, with_row_key, without_rows
from .words import PIECE, hashes_by_text, mixed

KMER, SIMILARITY = 5, 0.8
#: Texts of up to so many words are met exactly, by pieces; of up to so many k-mers are drawn from the whole text.
SHORT, WHOLE = 30, 80
#: Sketches of a text of up to so many words; each draws two k-mers.
SKETCHES = ((WHOLE, 256), (160, 128), (2**62, 96))
#: So many sketches of a text (a power of two) lead it to aligned leaders before whole buckets are compared.
EARLY = 16
#: A block of a bucket holds about so many texts, and so many words.
BLOCK, BLOCK_WORDS = 2_000, 8_000_000
#: Counters of a text's words.
BINS = 128
#: Pairs of word arrays that a Python worker holds at once, and pairs that share one copy of their leader's array.
ALIGNED_AT_ONCE, LED_AT_ONCE = 200, 2_000
_SEEDS = np.random.default_rng(2_017).integers(1, 2**63, SKETCHES[0][1], dtype=np.uint64) | np.uint64(1)
_MOST = np.uint64(2**64 - 1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: Iterable[str | None]) -> list[np.ndarray]:
    """64-bit hashes of each text's lower-cased words."""
    return hashes_by_text([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts])


def in_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[int], list[str | None]]]:
    """(ids, texts) of each batch, cut after about PIECE characters, so that a batch of long texts is never held as arrays at once."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, text in zip(batch["id"], batch["text"], strict=True):
            ids.append(i)
            texts.append(text)
            size += len(text or "")
            if size >= PIECE:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def labelled_kmers(words: np.ndarray, k: int = KMER) -> np.ndarray:
    """A hash for each run of k words and its number among equal runs; a shorter text is one run."""
    k = min(k, len(words))
    if not k:
        return words
    grams = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        grams = grams * _GOLD + words[j : j + len(grams)]
    order = np.argsort(grams, kind="stable")
    starts = np.r_[True, grams[order][1:] != grams[order][:-1]]
    number = np.arange(len(grams)) - np.maximum.accumulate(np.where(starts, np.arange(len(grams)), 0))
    occurrence = np.empty(len(grams), np.uint64)
    occurrence[order] = number
    return mixed(grams + occurrence * np.uint64(0xD6E8FEB86659FD93))


def order_sketches(kmers: np.ndarray, n: int, halves: bool) -> np.ndarray:
    """n 64-bit keys, one per sketch: its number and two k-mers of least rank, combined in text order.

    The two are the least of the first and of the second half, or else the two least of all.
    """
    if len(kmers) < 2:
        return kmers
    seeds = _SEEDS[:n]
    ranks = (kmers[None, :] ^ seeds[:, None]) * _GOLD
    if halves:
        middle = len(kmers) // 2
        first, second = ranks[:, :middle].argmin(axis=1), middle + ranks[:, middle:].argmin(axis=1)
    else:
        one = ranks.argmin(axis=1)
        ranks[np.arange(n), one] = _MOST
        two = ranks.argmin(axis=1)
        first, second = np.minimum(one, two), np.maximum(one, two)
    return mixed(mixed((seeds + np.uint64(halves)) * _GOLD + kmers[first]) * _GOLD + kmers[second])


def most_edits(longer: int, similarity: float) -> int:
    """Edits that texts may be apart, the longer of so many words."""
    return int((1 - similarity) * longer + 1e-9)


def piece_keys(words: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Keys of which two texts in reach share one if the shorter has at most SHORT words.

    With d edits allowed the longer text is cut into d + 1 pieces. The first
    piece i before whose end there are at most i edits is whole, with i
    edits before it and d - i at most after it, which bounds where it is in
    the shorter one.
    """
    n, keys = len(words), []
    last = int(n / similarity + 1e-9) if n <= SHORT else n
    for longer in range(n, last + 1 if n * similarity <= SHORT + 1e-9 else n):
        d = most_edits(longer, similarity)
        if not d or longer - n > d:
            continue
        cuts = [longer * i // (d + 1) for i in range(d + 2)]
        for i in range(d + 1):
            start, size = cuts[i], cuts[i + 1] - cuts[i]
            if n > SHORT:
                places = [start]
            else:
                shift = n - longer
                places = range(max(0, start - i, start + shift - (d - i)), min(n - size, start + i, start + shift + (d - i)) + 1)
                if longer == n:
                    places = {start, *places}
            for at in places:
                keys.append(xxhash.xxh3_64_intdigest(words[at : at + size].tobytes(), longer * 1000 + i))
    return np.unique(np.array(keys, np.uint64))


def keys_of(words: np.ndarray) -> np.ndarray:
    """The buckets of a text.

    Texts that can be similar draw from the same of the two kinds, or from
    both; the fewer of their numbers of sketches are those they may share.
    A key divisible by EARLY leads to an aligned leader: the first sketches
    of each kind, and a part of the pieces.
    """
    n, kinds = len(words), [_SEEDS[:0], piece_keys(words)]
    if n > SHORT:
        kmers = labelled_kmers(words)
        many = next(m for most, m in SKETCHES if n <= most)
        late = np.arange(many) >= EARLY
        if n <= WHOLE:
            kinds.append(order_sketches(kmers, many, False) & ~np.uint64(EARLY - 1) | late.astype(np.uint64))
        if n >= WHOLE * SIMILARITY:
            kinds.append(order_sketches(kmers, many, True) & ~np.uint64(EARLY - 1) | late.astype(np.uint64))
    return np.concatenate(kinds)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Words to insert, delete or replace to make b of a; None if over `most`.

    Counts of words rule out most pairs; the others are aligned within the
    band of diagonals that `most` edits can reach.
    """
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        d = max(len(a), len(b))
        return d if d <= most else None
    if abs(len(a) - len(b)) > most:
        return None
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    surplus = np.bincount(at[: len(a)], minlength=len(values)) - np.bincount(at[len(a) :], minlength=len(values))
    if max(surplus[surplus > 0].sum(), -surplus[surplus < 0].sum()) > most:
        return None  # the words alone differ by more
    return banded_distance(at[: len(a)].tolist(), at[len(a) :].tolist(), most)


def banded_distance(x: list[int], y: list[int], most: int) -> int | None:
    """Edits to make y of x within the band of `most` diagonals to either side; None if over `most`.

    Column by column the band is two integers, whose bits say where the
    distance grows or falls from one row to the next, so a column is a few
    operations on integers however wide the band is (bit-parallel
    alignment). The distance is followed along the diagonal of the end.
    """
    goal, width = len(x) - len(y), 2 * most + 1
    mask = (1 << width) - 1
    places: dict[int, int] = {}
    for i, word in enumerate(x):
        places[word] = places.get(word, 0) | 1 << i
    # bit t of a column's band is row (column - most + t); rows up to the first grow by column only
    up, down = mask >> most << most, 0
    found, target = abs(goal), 1 << (most + goal)
    for j, word in enumerate(y):
        same = places.get(word, 0)
        same = (same >> (j - most) if j >= most else same << (most - j)) & mask
        level = ((((same & up) + up) ^ up) | same | down) & mask
        if j >= -goal and not level & target:
            found += 1
            if found > most:
                return None
        rises, falls = down | (mask & ~(level | up)), level & up
        level >>= 1
        up, down = falls | (mask & ~(level | rises)), level & rises
    return found


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether 1 - edits / words of the longer text is at least `similarity`."""
    longer = max(len(a), len(b))
    return not longer or edit_distance(a, b, most_edits(longer, similarity)) is not None


def bag(words: np.ndarray) -> np.ndarray:
    """Counts of the words by hash, 255 at most: an edit takes one off a counter, adds one to another, or both."""
    return np.minimum(np.bincount((words % BINS).astype(np.int64), minlength=BINS), 255).astype(np.uint8)


def word_rows(keyed: DataFrame) -> DataFrame:
    """id, doc_id, key1, key2 (128 bits that stand for the lower-cased words), n_words; one narrow row per input row."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+", " "))
    rows = keyed.select(F.col("__row").alias("id"), F.col("doc_id").cast("long").alias("doc_id"), spaced.alias("t"))
    n_words = F.when(F.col("t") == "", 0).otherwise(F.char_length("t") - F.char_length(F.replace("t", F.lit(" "))) + 1)
    return rows.select("id", "doc_id", F.xxhash64("t").alias("key1"), F.xxhash64(F.lit(20_011), "t").alias("key2"), n_words.cast("long").alias("n_words"))


def sketched(source: DataFrame) -> DataFrame:
    """id, n_words and keys of each (id, text)."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in in_pieces(batches):
            rows = [(i, len(w), keys_of(w).view(np.int64)) for i, w in zip(ids, words_of(texts), strict=True)]
            yield pd.DataFrame(rows, columns=["id", "n_words", "keys"])

    return source.mapInPandas(sketch, "id long, n_words int, keys array<long>")


def small(df: DataFrame) -> DataFrame | None:
    """A materialised frame marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else None


def shared_buckets(source: DataFrame, copies: DataFrame) -> DataFrame:
    """(key, id, n_words, leader, led) of all buckets with several texts; copies are ids to leave out.

    A bucket's leader is its least id, of `led` words. No bucket holds more
    than one row of a text, which has dozens, so none is a large share of
    the rows; counting and joining use one shuffle of them.
    """
    gone, few = copies.withColumnRenamed("id", "__gone"), small(copies)
    if few is not None:
        source = source.join(F.broadcast(gone), source["id"] == gone["__gone"], "left_anti")
    texts = sketched(source)
    if few is None:  # the sketches are less to shuffle than the texts
        texts = texts.join(gone, texts["id"] == gone["__gone"], "left_anti")
    rows = texts.select("id", "n_words", F.explode("keys").alias("key")).repartition("key")
    sizes = rows.groupBy("key").agg(F.min(F.struct("id", "n_words")).alias("least"), F.max("id").alias("most"))
    sizes = sizes.filter("least.id <> most").select(F.col("key").alias("__key"), F.col("least.id").alias("leader"), F.col("least.n_words").alias("led"))
    return materialize(rows.join(sizes, F.col("key") == F.col("__key")).drop("__key"), "buckets")


def word_arrays(source: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, words): the word hashes, four bytes each, of the texts in ids (materialised)."""
    wanted = ids.withColumnRenamed("id", "__id")
    chosen = source.join(F.broadcast(wanted) if small(ids) is not None else wanted, source["id"] == wanted["__id"], "left_semi")

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in in_pieces(batches):
            yield pd.DataFrame({"id": ids, "words": [w.astype(np.uint32).tobytes() for w in words_of(texts)]})

    return chosen.mapInPandas(arrays, "id long, words binary")


def near_in_length(a: str, b: str, similarity: float) -> Column:
    """Whether texts of these numbers of words can be similar at all."""
    return F.abs(F.col(a) - F.col(b)) <= F.floor(F.greatest(a, b) * (1 - similarity) + 1e-9)


def aligned(source: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The linked ones of distinct (member, leader) pairs; a leader's array is copied once for LED_AT_ONCE pairs, so no leader is one task's."""
    led = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("led"))
    pairs = materialize(join_groups(pairs, led, ["leader"], "led", pairs.count()), "pairs")
    copies = F.ceil(F.col("led") / LED_AT_ONCE)
    pairs = pairs.select("member", "leader", F.pmod(F.xxhash64("member"), copies).alias("part"), copies.alias("parts"))
    ids = materialize(pairs.select(F.explode(F.array("member", "leader")).alias("id")).distinct(), "wanted")
    arrays = materialize(word_arrays(source, ids), "words")
    leading = pairs.groupBy("leader").agg(F.max("parts").alias("parts")).select(F.col("leader").alias("__leader"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("__part"))
    leading = leading.join(arrays, F.col("__leader") == F.col("id")).drop("id")
    own = pairs.join(arrays.withColumnRenamed("words", "own"), F.col("member") == F.col("id"))
    both = own.join(leading, (F.col("leader") == F.col("__leader")) & (F.col("part") == F.col("__part"))).select("member", "leader", "own", "words")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for member, leader, own, words in batch.itertuples(index=False):
                if similar(np.frombuffer(own, np.uint32), np.frombuffer(words, np.uint32), similarity):
                    rows.append((member, leader))
            yield pd.DataFrame(rows, columns=["member", "leader"])

    with rows_per_batch(source.sparkSession, ALIGNED_AT_ONCE):
        return materialize(both.mapInPandas(align, "member long, leader long"), "links")


def links_across(key: int, keys: list[set[int]], labels: np.ndarray, words: list[np.ndarray], left: np.ndarray, right: np.ndarray, within: bool, similarity: float) -> list[tuple[int, int]]:
    """Links that connect the labels of similar texts, one of left and one of right (or both of left, if within).

    A pair is aligned unless its labels are connected by then, the lengths
    or the counts of words rule it out, or both texts are in an open bucket
    of a lesser key, where it is judged.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    bags = np.stack([bag(w) for w in words]).astype(np.int16)
    joined, links = labels.copy(), []
    for place, i in enumerate(left):
        others = np.r_[right, left[place + 1 :]] if within else right
        longer = np.maximum(sizes[others], sizes[i])
        most = np.floor((1 - similarity) * longer + 1e-9)
        open_ = (joined[others] != joined[i]) & (np.abs(sizes[others] - sizes[i]) <= most)
        others, most = others[open_], most[open_]
        apart = bags[others] - bags[i]
        edits = np.maximum(np.maximum(apart, 0).sum(axis=1), np.maximum(-apart, 0).sum(axis=1))
        others = others[edits <= most]
        while len(others):
            j, others = others[0], others[1:]
            if key == min(keys[i] & keys[j]) and similar(words[i], words[j], similarity):
                links.append((int(labels[i]), int(labels[j])))
                joined[joined == joined[j]] = joined[i]
                others = others[joined[others] != joined[i]]
    return links


def links_in_cell(cell: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Links in a cell: of the small components' texts with the main one's and each other, or of two blocks of small ones."""
    ids, labels, blocks, main = (cell[c].to_numpy() for c in ("id", "label", "block", "main"))
    order = np.argsort(ids, kind="stable")
    ids, labels, blocks, main = ids[order], labels[order], blocks[order], main[order].astype(bool)
    stored = cell["words"].to_pylist()
    words = [np.frombuffer(stored[i], np.uint32) for i in order]
    stored = cell["keys"].to_pylist()
    keys = [set(stored[i]) for i in order]
    first, second = cell["one"][0].as_py(), cell["two"][0].as_py()
    if first < 0:
        left, right, within = np.flatnonzero(blocks == -1 - first), np.flatnonzero(blocks == second), False
    else:
        left, right, within = np.flatnonzero(~main), np.flatnonzero(main), first == 0
    return links_across(cell["key"][0].as_py(), keys, labels, words, left, right, within, similarity)


def compare_whole(source: DataFrame, buckets: DataFrame, labels: DataFrame | None, similarity: float) -> DataFrame | None:
    """(member, leader) links between labels, of all buckets that hold several; None if there is no such bucket.

    Of buckets with the same members one is compared. A bucket of more
    than a block is dealt to cells: the texts of its largest component, in
    blocks beside blocks of all other texts, and those beside each other.
    """
    rows = buckets.select("key", "id", "n_words")
    if labels is None:
        rows = rows.withColumns({"label": F.col("id"), "alike": F.lit(1)})
    else:
        crowd = labels.groupBy("label").agg(F.count(F.lit(1)).alias("alike"))
        sized = materialize(join_groups(labels, crowd, ["label"], "alike", labels.count()), "sized")
        few = F.broadcast(sized) if small(sized) is not None else sized
        rows = rows.join(few, F.col("id") == F.col("node"), "left").select("key", "id", "n_words", F.coalesce("label", "id").alias("label"), F.coalesce("alike", F.lit(1)).alias("alike"))
    rows = materialize(rows, "labelled")
    opened = rows.groupBy("key").agg(
        F.max(F.struct("alike", "label"))["label"].alias("main_label"), F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("members"), F.sum("n_words").alias("words"),
        F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("x2"),
    ).filter("least <> most")
    one = F.max_by(F.struct("key", "main_label", "words"), "key").alias("one")
    opened = opened.groupBy("members", "x1", "x2").agg(one).select(F.col("one.key").alias("__key"), F.col("one.main_label").alias("main_label"), "members", F.col("one.words").alias("words"))
    opened = materialize(opened, "open")
    if opened.isEmpty():
        return None
    total = opened.agg(F.sum("members")).first()[0]
    if small(opened) is not None:
        rows = rows.join(F.broadcast(opened), F.col("key") == F.col("__key")).drop("__key")
    else:
        rows = join_groups(rows, opened.withColumnRenamed("__key", "key"), ["key"], "members", total, how="inner")
    rows = rows.withColumn("main", F.col("label") == F.col("main_label")).select("key", "id", "label", "main", "members", "words", "n_words")
    rows = materialize(rows, "open-rows")
    large = (F.col("members") > BLOCK) | (F.col("words") > BLOCK_WORDS)
    parts = lambda own: F.ceil(F.greatest(F.count_if(own) / BLOCK, F.sum(F.when(own, F.col("n_words")).otherwise(0)) / BLOCK_WORDS))
    split = materialize(rows.filter(large).groupBy("key").agg(F.count(F.lit(1)).alias("held"), parts(F.col("main")).alias("mains"), parts(~F.col("main")).alias("others")), "large")
    if split.isEmpty():
        cells = rows.select("key", "id", "label", "main", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"))
    else:
        placed = join_groups(rows, split, ["key"], "held", total).withColumns({"mains": F.coalesce("mains", F.lit(1)), "others": F.coalesce("others", F.lit(1))})
        placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))))
        zero = F.lit(0).cast("long")
        beside = lambda n, f: F.transform(F.sequence(zero, F.col(n) - 1), f)
        cell = lambda one, two: F.struct(one.alias("one"), two.alias("two"))
        of_main = beside("others", lambda j: cell(F.col("block"), j))
        rest = F.filter(F.sequence(zero, F.col("others") - 1), lambda j: j != F.col("block"))
        of_rest = F.concat(beside("mains", lambda i: cell(i, F.col("block"))), F.transform(rest, lambda j: cell(-1 - F.least(j, F.col("block")), F.greatest(j, F.col("block")))))
        cells = placed.select("key", "id", "label", "main", "block", F.explode(F.when(F.col("main"), of_main).otherwise(of_rest)).alias("cell"))
        cells = cells.select("key", "id", "label", "main", "block", "cell.one", "cell.two")
    held = materialize(rows.groupBy("id").agg(F.collect_set("key").alias("keys")), "wanted")
    arrays = word_arrays(source, held.select("id")).join(held.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id")).drop("__id")
    arrays = materialize(arrays, "words").withColumnRenamed("id", "__id")
    cells = cells.join(arrays, F.col("id") == F.col("__id")).drop("__id")

    def compare(cell: pa.Table) -> pa.Table:
        links = links_in_cell(cell, similarity)
        return pa.table({"member": pa.array([a for a, _ in links], pa.int64()), "leader": pa.array([b for _, b in links], pa.int64())})

    return materialize(cells.groupBy("key", "one", "two").applyInArrow(compare, "member long, leader long"), "links")


def renamed(rows: DataFrame, column: str, pointers: DataFrame, size: str) -> DataFrame:
    """Rows with the column's nodes replaced by those they point to; size is the pointers' column with their number of rows."""
    to = pointers.select(F.col("node").alias(column), F.col("to").alias("__to"), size)
    if small(pointers) is not None:
        joined = rows.join(F.broadcast(to.withColumnRenamed(column, "__node")), F.col(column) == F.col("__node"), "left").drop("__node")
    else:
        joined = join_groups(rows, to, [column], size, rows.count())
    return joined.withColumn(column, F.coalesce("__to", column)).drop("__to", size)


def components(links: DataFrame) -> DataFrame:
    """(node, label): a node that stands for all that each linked node is connected with.

    Round by round every node points to the one of least hash among itself
    and those it is linked with, and links are drawn between what their ends
    point to, until none is left; hashes let long chains shrink fast. Each
    round is a written table; nodes of many links are met by skew-safe joins.
    """
    least = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("node"))
    ways = links.select(F.col("member").alias("a"), F.col("leader").alias("b"))
    edges = materialize(ways.union(ways.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        pointers = edges.groupBy("a").agg(F.min(least("b")).alias("to"), F.count(F.lit(1)).alias("degree"))
        pointers = materialize(pointers.select(F.col("a").alias("node"), F.least("to", least("a"))["node"].alias("to"), "degree"), "pointers")
        edges = renamed(renamed(edges, "a", pointers, "degree"), "b", pointers, "degree")
        edges = materialize(edges.filter("a <> b").distinct(), "edges")
        if labels is None:
            labels = pointers.select("node", F.col("to").alias("label"))
        else:
            crowd = labels.groupBy(F.col("label").alias("node")).agg(F.count(F.lit(1)).alias("crowd"))
            known = materialize(pointers.join(crowd, "node"), "crowds")
            labels = materialize(renamed(labels, "label", known, "crowd"), "labels")
    return links.select(F.col("member").alias("node"), F.col("leader").alias("label")).limit(0) if labels is None else labels


def near_duplicate_classes(keyed: DataFrame, similarity: float) -> DataFrame:
    """id (the __row of keyed), doc_id, n_words, class_id, class_size, best (whether the row stands for its class); materialised."""
    source = keyed.select(F.col("__row").alias("id"), "text")
    rows = materialize(word_rows(keyed), "rows")
    texts = rows.groupBy("key1", "key2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "id")).alias("best"))
    texts = materialize(texts, "texts")
    n_rows, n_texts = rows.count(), texts.count()
    several = texts.filter("copies > 1").select("key1", "key2", "rep", "copies")
    copies = materialize(join_groups(rows.select("id", "key1", "key2"), several, ["key1", "key2"], "copies", n_rows, how="inner").filter("id <> rep").select("id"), "copies")
    buckets = shared_buckets(source, copies)
    early = buckets.filter((F.pmod("key", F.lit(EARLY)) == 0) & (F.col("id") != F.col("leader"))).filter(near_in_length("n_words", "led", similarity))
    pairs = materialize(early.select(F.col("id").alias("member"), "leader").distinct(), "leaders")
    links = None if pairs.isEmpty() else aligned(source, pairs, similarity)
    labels = None if links is None or links.isEmpty() else components(links)
    more = compare_whole(source, buckets, labels, similarity)
    if more is not None and not more.isEmpty():
        above = components(more)
        if labels is None:
            labels = above
        else:
            crowd = labels.groupBy(F.col("label").alias("node")).agg(F.count(F.lit(1)).alias("crowd"))
            grown = above.select("node", F.col("label").alias("to"))
            # nodes that had no link before stand for themselves
            fresh = grown.join(labels.select(F.col("node").alias("__node")), F.col("node") == F.col("__node"), "left_anti").select("node", F.col("to").alias("label"))
            known = materialize(grown.join(crowd, "node", "left").withColumn("crowd", F.coalesce("crowd", F.lit(0))), "crowds")
            labels = materialize(renamed(labels, "label", known, "crowd").union(fresh), "labels")
    classed = texts.withColumn("label", F.col("rep"))
    if labels is not None:
        nodes = labels.withColumnRenamed("label", "__label")
        nodes = F.broadcast(nodes) if small(nodes) is not None else nodes
        classed = classed.join(nodes, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("__label", "rep")).drop("node", "__label")
    classed = materialize(classed, "classed")
    classes = classed.groupBy("label").agg(F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("n_texts"), F.min("best").alias("first"))
    placed = join_groups(classed.drop("best"), classes, ["label"], "n_texts", n_texts).select("key1", "key2", "copies", "class_size", "first")
    out = join_groups(rows, placed, ["key1", "key2"], "copies", n_rows)
    found = out.select("id", "doc_id", "n_words", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("id") == F.col("first.id")).alias("best"))
    return materialize(found, "classes")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, n_words, class_id, class_size, kept.

    class_id is the least doc_id of the class, class_size its rows, kept
    whether the row is the one that stands for the class: its first by
    doc_id, and one of those that repeat that id. Two texts are linked if
    their edit similarity over words is `similarity` or more and they share
    a sketch; classes are chains of links. Words are unspaced runs,
    lower-cased; texts of the same words are alike, so all texts without
    any, null ones too, are one class. Rows are judged by their text, so
    rows that repeat a doc_id are each in the class of their own text; a
    null id is less than any other. Empty in, empty out; other columns are
    not looked at.
    """
    found = near_duplicate_classes(with_row_key(docs, ["doc_id", "text"]), similarity)
    return found.select("doc_id", "n_words", "class_id", "class_size", F.col("best").alias("kept"))


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Of each class of near-duplicates the row of least doc_id; a null id is less than any other, and of equal ids one row stays."""
    keyed = with_row_key(docs)
    found = near_duplicate_classes(keyed, similarity)
    return without_rows(keyed, materialize(found.filter("not best").select("id"), "near-copies"))

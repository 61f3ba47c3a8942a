"""Language-model scoring by context-tree weighting over bytes.

The next byte is eight binary decisions. For each decision the bytes before
it form a context tree whose nodes count zeros and ones. A node's
Krichevsky-Trofimov (KT) block probability P_e and its children's weighted
ones are mixed half and half,

    P_w(s) = 1/2 P_e(s) + 1/2 prod over children P_w(c),

so the code length reflects every depth at once. The tree has every context
of the training texts, however many there are; a context that they lack has
counts of zero and says one half.

No machine holds the tree. All grams (a context of `depth` bytes and the next
byte) of all texts are counted and dealt by their latest three bytes, so that
a subtree below such a context is in one place, of at most 256 ** (depth - 2)
grams. The levels above are small and mixed on the driver. The result is one
number per gram, its log2 probability: the frequent ones are broadcast, the
others meet their texts in a join.

A text is its bytes and one end mark; before its start the context is end
marks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_fold, materialize

#: Bytes of context, and how many of them the driver's levels have.
DEPTH, TOP = 5, 2
#: No UTF-8 text has this byte.
END = 0xFF
#: Positions handled at once; grams and words in the broadcast tables at most (caches: results do not depend on them).
SLICE, FREQUENT_GRAMS, FREQUENT = 1 << 20, 1 << 20, 200_000
#: Grams and words a counting task holds before it passes them on, and grams whose subtrees are worked on at once.
HELD_GRAMS, HELD_WORDS, SUBTREE_GRAMS = 2_000_000, 500_000, 400_000


def lowered(text: str | None) -> bytes:
    """The text's bytes, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def laid_out(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, `depth` end marks before, between and after; and where each starts."""
    marks = bytes([END]) * depth
    starts = np.cumsum([depth] + [len(t) + depth for t in texts])[:-1]
    return np.frombuffer(marks + b"".join([t + marks for t in texts]), np.uint8), starts.astype(np.int64)


def slices(starts: np.ndarray, lengths: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of the array that cover all texts, of `size` positions at most."""
    if len(starts):
        end = int(starts[-1] + lengths[-1] + 1)
        for a in range(int(starts[0]), end, size):
            yield a, min(end, a + size)


def counted_marks(a: int, b: int, ends: np.ndarray, depth: int) -> np.ndarray:
    """Whether each position of [a, b) is a text's byte or its one end mark."""
    kept = np.ones(b - a, bool)
    near = ends[np.searchsorted(ends, a - depth) : np.searchsorted(ends, b)]
    for j in range(1, depth):
        at = near + j - a
        kept[at[(at >= 0) & (at < b - a)]] = False
    return kept


def gram_keys(array: np.ndarray, a: int, b: int, depth: int) -> np.ndarray:
    """The gram at each position of [a, b): the latest context byte is the highest, the next byte the lowest."""
    key = np.zeros(b - a, np.int64)
    for d in range(1, depth + 1):
        key = (key << 8) | array[a - d : b - d]
    return (key << 8) | array[a:b]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts (one or more columns)."""
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


def grams_of(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams and their counts."""
    array, starts = laid_out(texts, depth)
    lengths = np.array([len(t) for t in texts], np.int64)
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, b in slices(starts, lengths):
        key = gram_keys(array, a, b, depth)[counted_marks(a, b, starts + lengths, depth)]
        found, n = np.unique(key, return_counts=True)
        parts.append((found, n.astype(np.int64)))
        if len(parts) > 4:
            parts = [merged(parts)]
    return merged(parts)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function for x of a half or more (Stirling, shifted by eight)."""
    shifted, product = x + 8, x.copy()
    for i in range(1, 8):
        product = product * (x + i)
    inverse = 1 / shifted
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680)))
    return (shifted - 0.5) * np.log(shifted) - shifted + 0.9189385332046727 + series - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the KT block probability."""
    out = np.zeros(zeros.shape)
    seen = (zeros + ones) > 0
    a, b = zeros[seen], ones[seen]
    out[seen] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)
    return out


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Probability of a one."""
    return (ones + 0.5) / (zeros + ones + 1.0)


def mixed(estimate: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of a node's weighted probability, and the posterior weight of ending there."""
    weighted = np.logaddexp(estimate, below) - np.log(2)
    return weighted, np.exp(np.minimum(0, estimate - np.log(2) - weighted))


def decision(keys: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The j-th decision of each gram's next byte: its number (1 to 255) and its outcome."""
    byte = keys & 255
    return (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1


def subtrees(keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, list[np.ndarray]]:
    """Mixes all levels below TOP, from sorted grams and their training counts.

    Returns, per gram and decision, the probability that those levels give
    its outcome, and per (context of TOP bytes, decision) the node's number,
    zeros, ones and the log of its children's product. All grams of a context
    of TOP + 1 bytes have to be there.
    """
    chosen, tops = np.empty((len(keys), 8), np.float32), []
    for j in range(8):
        number, bit = decision(keys, j)
        node = ((keys >> 8) << 8) | number
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
        run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(node)]))
        node = node[starts]
        ones = np.bincount(run, counts * bit, len(starts))
        zeros = np.bincount(run, counts, len(starts)) - ones
        estimate = log_kt(zeros, ones)
        weighted, levels = estimate, [(None, np.ones(len(starts)), kt(zeros, ones))]
        for d in range(depth - 1, TOP - 1, -1):
            node, parent = np.unique(((node >> 16) << 8) | (node & 255), return_inverse=True)
            zeros, ones, below = (np.bincount(parent, v, len(node)) for v in (zeros, ones, weighted))
            if d == TOP:
                tops.append((node, zeros.astype(np.int64), ones.astype(np.int64), below))
            else:
                weighted, stop = mixed(log_kt(zeros, ones), below)
                levels.append((parent, stop, kt(zeros, ones)))
        one, left = None, None
        for i in range(len(levels) - 1, -1, -1):
            _, stop, p = levels[i]
            if one is None:
                one, left = stop * p, 1 - stop
            else:
                up = levels[i + 1][0]
                one, left = one[up] + left[up] * stop * p, left[up] * (1 - stop)
        one = one[run]
        chosen[:, j] = np.where(bit == 1, one, 1 - one)
    return chosen, [np.concatenate([t[i] for t in tops]) for i in range(4)]


def top_levels(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Per node of TOP bytes: mass that ends by then and says zero, that says one, and mass that goes on below."""
    levels, here = [], (node, zeros.astype(float), ones.astype(float), below.astype(float), None)
    for d in range(TOP, -1, -1):
        number, z, o, product, parent = here
        weighted, stop = mixed(log_kt(z, o), product)
        levels.append((parent, stop, kt(z, o)))
        if d:
            above, up = np.unique(((number >> 16) << 8) | (number & 255), return_inverse=True)
            here = (above, *(np.bincount(up, v, len(above)) for v in (z, o, weighted)), up)
    mass = None
    for i in range(TOP, -1, -1):
        _, stop, p = levels[i]
        if mass is None:
            mass = np.stack([stop * (1 - p), stop * p, 1 - stop])
        else:
            zero, one, left = mass[:, levels[i + 1][0]]
            mass = np.stack([zero + left * stop * (1 - p), one + left * stop * p, left * (1 - stop)])
    return mass


def gram_log2(keys: np.ndarray, chosen: np.ndarray, node: np.ndarray, mass: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """log2 probability of each gram's next byte after its context; `node` is sorted."""
    total = np.zeros(len(keys))
    for j in range(8):
        number, bit = decision(keys, j)
        at = np.searchsorted(node, ((keys >> (8 * (depth + 1 - TOP))) << 8) | number)
        total += np.log2(mass[bit, at] + mass[2, at] * chosen[:, j].astype(float))
    return total


def slot_table(keys: np.ndarray, values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """An open-addressing table: (shift, slots with keys or -1, values). Keys are distinct."""
    bits = max(4, int(len(keys) * 2).bit_length())
    shift = 64 - bits
    home = slots_of(keys, shift)
    order = np.argsort(home, kind="stable")
    at = np.maximum.accumulate(home[order] - np.arange(len(order))) + np.arange(len(order)) if len(order) else home
    size = max(1 << bits, int(at[-1]) + 1 if len(at) else 0) + 1
    slots, found = np.full(size, -1, np.int64), np.zeros(size, np.float32)
    slots[at], found[at] = keys[order], values[order]
    return shift, slots, found


def slots_of(keys: np.ndarray, shift: int) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift)).astype(np.int64)


def looked_up(keys: np.ndarray, shift: int, slots: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the keys (0 where the table lacks one), and the places of those it lacks."""
    at = slots_of(keys, shift)
    held = slots[at]
    open_ = np.flatnonzero((held != keys) & (held != -1))
    while len(open_):
        at[open_] += 1
        held = slots[at[open_]]
        open_ = open_[(held != keys[open_]) & (held != -1)]
    out, missed = values[at].astype(np.float64), slots[at] != keys
    out[missed] = 0
    return out, np.flatnonzero(missed)


def text_log2(texts: list[bytes], table: tuple[int, np.ndarray, np.ndarray], depth: int = DEPTH) -> tuple[np.ndarray, list[np.ndarray]]:
    """log2 probability of each text with its end mark, less the grams that the table lacks; and those grams."""
    array, starts = laid_out(texts, depth)
    lengths = np.array([len(t) for t in texts], np.int64)
    out, owners, lacking = np.zeros(len(texts)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in slices(starts, lengths):
        at = np.flatnonzero(counted_marks(a, b, starts + lengths, depth))
        keys = gram_keys(array, a, b, depth)[at]
        bits, missed = looked_up(keys, *table)
        owner = np.searchsorted(starts, at + a, side="right") - 1
        out += np.bincount(owner, bits, len(texts))
        owners.append(owner[missed])
        lacking.append(keys[missed])
    cuts = np.searchsorted(np.concatenate(owners), np.arange(1, len(texts)))
    return out, np.split(np.concatenate(lacking), cuts) if texts else []


def gather_counts(source: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(gram, c, seen) and (word, c, seen) of all texts: c in training texts, seen in all; both written tables.

    Each task sums its own texts before anything is shuffled.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        words, held_words = Counter(), Counter()

        def flush() -> pd.DataFrame:
            every = words.keys() | held_words.keys()
            keys, counts = merged(grams) if grams else (np.zeros(0, np.int64), np.zeros((0, 2), np.int64))
            out = (keys, counts[:, 0], counts[:, 1], [w.decode("utf-8", "surrogatepass") for w in every], [words[w] for w in every], [words[w] + held_words[w] for w in every])
            for held in (grams, words, held_words):
                held.clear()
            return pd.DataFrame([out], columns=["gram", "gram_c", "gram_seen", "word", "word_c", "word_seen"])

        for batch in batches:
            for fold, counter in ((False, words), (True, held_words)):
                texts = [lowered(t) for t in batch["text"][batch["held_out"] == fold]]
                keys, n = grams_of(texts, depth)
                grams.append((keys, np.stack([n * (not fold), n], axis=1)))
                for t in texts:
                    counter.update(t.split())
            if sum(len(g[0]) for g in grams) > HELD_GRAMS:
                grams = [merged(grams)]
            if sum(len(g[0]) for g in grams) > HELD_GRAMS // 2 or len(words) + len(held_words) > HELD_WORDS:
                yield flush()
        if grams or words or held_words:
            yield flush()

    kind = "gram array<long>, gram_c array<long>, gram_seen array<long>, word array<string>, word_c array<long>, word_seen array<long>"
    found = materialize(source.select("held_out", "text").mapInPandas(count, kind), "counts")

    def summed(name: str) -> DataFrame:
        each = found.select(F.explode(F.arrays_zip(name, f"{name}_c", f"{name}_seen")).alias("x"))
        each = each.select(F.col(f"x.{name}").alias(name), F.col(f"x.{name}_c").alias("c"), F.col(f"x.{name}_seen").alias("seen"))
        return materialize(each.groupBy(name).agg(F.sum("c").alias("c"), F.sum("seen").alias("seen")), f"{name}s")

    return summed("gram"), summed("word")


def learn_grams(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, seen, bits) of every gram, bits the log2 probability of its byte; a written table.

    To the driver come the nodes of up to TOP bytes: 256 ** TOP contexts of
    255 decisions at most, those that no text has left out.
    """
    if depth <= TOP:
        raise ValueError(f"depth has to be over {TOP}")
    spark, shift = grams.sparkSession, 8 * (depth - TOP)
    fields = [pa.field("gram", pa.int64()), pa.field("seen", pa.int64()), pa.field("chosen", pa.binary())]
    fields += [pa.field("node", pa.int64()), pa.field("zeros", pa.int64()), pa.field("ones", pa.int64()), pa.field("below", pa.float64())]
    schema = pa.schema(fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done(rows: np.ndarray, counted: np.ndarray) -> Iterator[pa.RecordBatch]:
            chosen, top = subtrees(rows, counted[:, 0], depth)
            lines = pa.Array.from_buffers(pa.binary(8 * 4), len(rows), [None, pa.py_buffer(np.ascontiguousarray(chosen))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(counted[:, 1].copy()), lines, *[pa.nulls(len(rows), f.type) for f in fields[3:]]], schema=schema)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(top[0]), f.type) for f in fields[:3]], *[pa.array(t) for t in top]], schema=schema)

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held.append((columns[0], np.stack(columns[1:], axis=1)))
            if sum(len(h[0]) for h in held) > SUBTREE_GRAMS:
                rows, counted = (np.concatenate([h[i] for h in held]) for i in range(2))
                context = rows >> shift
                cut = int(np.searchsorted(context, context[-1]))
                if cut:
                    yield from done(rows[:cut], counted[:cut])
                held = [(rows[cut:], counted[cut:])]
        if sum(len(h[0]) for h in held):
            yield from done(*(np.concatenate([h[i] for h in held]) for i in range(2)))

    sorted_grams = grams.select("gram", "c", "seen").repartition(F.shiftright("gram", shift)).sortWithinPartitions("gram")
    trees = materialize(sorted_grams.mapInArrow(work, "gram long, seen long, chosen binary, node long, zeros long, ones long, below double"), "trees")
    # decimals, so that the sum does not depend on the order of rows
    top = trees.filter("node is not null").groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum(F.col("below").cast("decimal(28,9)")).cast("double").alias("below"))
    nodes = {name: np.concatenate([np.zeros(0, kind), *parts]) for name, kind, parts in unzipped(top)}
    order = np.argsort(nodes["node"])
    node, zeros, ones, below = (nodes[name][order] for name in ("node", "zeros", "ones", "below"))
    upper = spark.sparkContext.broadcast((node, top_levels(node, zeros, ones, below)))

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            chosen = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gram_log2(rows, chosen, *upper.value, depth))], names=["gram", "seen", "bits"])

    return materialize(trees.filter("gram is not null").select("gram", "seen", "chosen").mapInArrow(value, "gram long, seen long, bits double"), "bits")


def unzipped(df: DataFrame) -> list[tuple[str, type, list[np.ndarray]]]:
    """The columns of a bounded frame of numbers, as arrays."""
    table = df.toArrow()
    return [(name, np.int64 if pa.types.is_integer(table.schema.field(name).type) else np.float64, [table.column(name).to_numpy()]) for name in table.column_names]


def count_bin(c: Column) -> Column:
    """Counts, coarser from 1,024 on (64 bins an octave)."""
    return F.when(c < 1024, c).otherwise(1024 + F.floor(F.log2(c / 1024) * 64)).cast("long")


def frequent_rows(df: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows seen most often, at most `most` of them; all others), by whole bins of `seen`."""
    histogram = {r["b"]: r["n"] for r in df.groupBy(count_bin(F.col("seen")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    kept, least = 0, max(histogram, default=0) + 1
    for b in sorted(histogram, reverse=True):
        kept += histogram[b]
        if kept > most:
            break
        least = b
    inside = count_bin(F.col("seen")) >= least
    return df.filter(inside), df.filter(~inside)


def score_texts(docs: DataFrame, depth: int = DEPTH, frequent: int = FREQUENT, frequent_grams: int = FREQUENT_GRAMS, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Learns from rows whose crc32(doc_id) mod `modulus` is not `remainder`;
    a null id is learned from. score is the tree's log10 probability of the
    lower-cased (A-Z) text and its end mark; base_score that of a
    word-unigram model with one added to every count, over words and one end.
    Null counts as empty: one token, the end. Without training texts the
    tree gives every byte 1/256. Repeated rows are scored and counted each.
    A text of any length is worked on in slices. Empty in, empty out; other
    columns are not looked at. `frequent` and `frequent_grams` bound what is
    broadcast, not what is known.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold(F.col("doc_id"), modulus, remainder).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    ends = source.filter(~F.col("held_out")).count()
    grams, words = gather_counts(source, depth)
    n_words, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    train_tokens, divisor = n_words + ends, n_words + ends + (distinct + (ends > 0)) + 1
    common_words, rare_words = frequent_rows(words, frequent)
    counts = {r["word"].encode("utf-8", "surrogatepass"): r["c"] for r in common_words.collect()}
    common_grams, rare_grams = frequent_rows(learn_grams(grams, depth), frequent_grams)
    (_, _, (keys,)), (_, _, (bits,)) = unzipped(common_grams.select("gram", "bits"))
    # plain values: a worker may not have this module to load a class from
    model = spark.sparkContext.broadcast((slot_table(keys, bits), counts))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, counts = model.value
        logs = {w: float(np.log10((c + 1) / divisor)) for w, c in counts.items()}
        row, end = TaskContext.get().partitionId() << 33, float(np.log10((ends + 1) / divisor))
        for batch in batches:
            texts = [lowered(t) for t in batch.pop("text")]
            out = []
            for t in texts:
                tokens = t.split()
                rare = [w for w in tokens if w not in logs]
                known = sum([counts.get(w, 0) > 0 for w in tokens])
                base = end + sum([logs[w] for w in tokens if w in logs])
                out.append((row, len(t), len(tokens) + 1, known + (ends > 0), base, [w.decode("utf-8", "surrogatepass") for w in rare]))
                row += 1
            columns = pd.DataFrame(out, columns=["row", "n_bytes", "n_tokens", "n_known", "base", "rare"], index=batch.index)
            log2, lacking = text_log2(texts, table, depth)
            yield pd.concat([batch, columns.assign(bits=log2, lacking=lacking)], axis=1)

    kind = "doc_id long, held_out boolean, row long, n_bytes long, n_tokens long, n_known long, base double, rare array<string>, bits double, lacking array<long>"
    scored = materialize(source.mapInPandas(score, kind), "scored")
    # the second tier: what the broadcast tables lack meets its counts in a shuffle; no such key is frequent in any text
    rare = scored.select("row", F.explode("rare").alias("word")).join(rare_words.select(F.col("word").alias("__word"), "c"), F.col("word") == F.col("__word"))
    added = rare.groupBy("row").agg(F.count_if(F.col("c") > 0).alias("more_known"), F.sum(F.log10((F.col("c") + 1) / F.lit(float(divisor)))).alias("more")).withColumnRenamed("row", "__row")
    lacked = scored.select("row", F.explode("lacking").alias("gram")).join(rare_grams.select(F.col("gram").alias("__gram"), F.col("bits").alias("more_bits")), F.col("gram") == F.col("__gram"))
    more_bits = lacked.groupBy("row").agg(F.sum("more_bits").alias("more_bits")).withColumnRenamed("row", "__bits_row")
    whole = scored.drop("rare", "lacking").join(added, F.col("row") == F.col("__row"), "left").join(more_bits, F.col("row") == F.col("__bits_row"), "left")
    bits = F.col("bits") + F.coalesce("more_bits", F.lit(0.0))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (bits * F.log10(F.lit(2.0))).alias("score"), "n_bytes", (-bits / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )

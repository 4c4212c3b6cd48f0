"""Language-model scoring by context-tree weighting over bytes.

A text is its lower-cased tokens, each followed by a space, then an end mark.  For every byte context
of 0 .. DEPTH bytes and every node of the next byte's binary decomposition the training texts give
counts of 0 and 1 bits, a Krichevsky-Trofimov estimate, and the weight with which the context-tree mixture
stops there: the estimate's share of P_w = (P_kt + product of the longer contexts' P_w) / 2.  The model
is frozen after training; a byte costs the product of its eight bits' mixtures over all depths that
training has met on its path.

The base score's token counts are gathered in the same pass.  The WORDS most frequent tokens go to the
executors as a table of hashes; all other tokens of a text meet their counts in a join.

The tree holds every byte string of the training texts and grows with them, so it is never in one place.
Texts are read in blocks; a block's distinct strings go to the shard of their last TOP + 1 context bytes,
and a shard sums them and has all longer contexts whole.  The shards' mixtures meet in the nodes of 0 .. TOP
bytes, which their number of bytes bounds; from these the weights go down to the shards again, and a shard answers each
block with the costs of the block's strings, in the order that both sides know.

Defined cases: null and empty texts have one token, the end, which is scored too; without training texts
every bit has probability 1/2; repeated rows count each time; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DEPTH, WORDS = 5, 800_000
#: The longest contexts whose nodes are in one place.
TOP = 2
#: Bytes of text whose distinct strings are asked for together; texts a shard, if the session's partitions are fewer.
BLOCK, SHARD_TEXTS = 8 << 20, 8000
#: Bytes of text whose strings are in memory at once.
SLICE = 1 << 20
FOLDS, HELD = 5, 1
END = 10
#: Distinct tokens that a task holds before it hands them on.
TASK_WORDS = 3_000_000


def normal_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the normalised texts, DEPTH end marks before each; their starts; token counts."""
    data, offsets = common.text_bytes(column)
    starts, ends, doc = common.words_of(data, offsets)
    n = len(offsets) - 1
    words = np.bincount(doc, minlength=n)
    size = np.bincount(doc, weights=ends - starts + 1, minlength=n).astype(np.int64) + DEPTH + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.full(begin[-1], END, np.uint8)
    # a word's place: its document's start, the marks, and all words of the document before it
    length = ends - starts + 1
    before = np.cumsum(length) - length
    first = np.concatenate([[0], np.cumsum(words)])[:-1]
    base = before[np.minimum(first, max(0, len(before) - 1))] if len(before) else np.zeros(n, np.int64)
    at = begin[:-1][doc] + DEPTH + before - base[doc]
    letters = ~((data == 32) | ((data >= 9) & (data <= 13)))
    kept = common.lowered(data)[letters]
    place = np.repeat(at, ends - starts) + np.arange(len(kept)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
    out[place] = kept
    out[at + length - 1] = 32
    return out, begin, words


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each byte with the DEPTH bytes before it, packed; the document of each; token counts."""
    data, begin, words = normal_bytes(column)
    n = len(data) - DEPTH
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), words
    packed = np.zeros(n, np.uint64)
    for j in range(DEPTH + 1):
        packed = packed << np.uint64(8) | data[j : j + n].astype(np.uint64)
    size = np.diff(begin)
    real = np.ones(n + DEPTH, bool)
    real[(begin[:-1][:, None] + np.arange(DEPTH)).ravel()] = False
    return packed[real[DEPTH:]], np.repeat(np.arange(len(size)), size - DEPTH), words


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every token but the ends, and its document."""
    data, offsets = common.text_bytes(column)
    starts, ends, doc = common.words_of(data, offsets)
    return common.mix(common.span_hash(common.prefix_hash(common.lowered(data)), starts, ends)).view(np.int64), doc


def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The scan's rows (uid first, text last) cut where a block ends; blocks depend on the rows' order alone."""
    before = 0
    for batch in common.slices(batches, "text", SLICE):
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        number = (before + np.cumsum(size) - size) // BLOCK
        before += int(size.sum())
        cut = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            yield (batch.column(0)[i].as_py() >> 33 << 32) + int(number[i]), batch.slice(i, j - i)


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, batch in blocked(batches):
        yield pa.record_batch([pa.array(np.full(batch.num_rows, block)), *batch.columns], names=["block", *batch.schema.names])


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a string: a hash of its last TOP + 1 context bytes."""
    near = keys.astype(np.uint64) >> np.uint64(8) & np.uint64((1 << 8 * (TOP + 1)) - 1)
    return (common.mix(near + np.uint64(1)) % np.uint64(shards)).astype(np.int64)


def pressed(x: np.ndarray) -> bytes:
    """Whole numbers as compressed differences, like bytes side by side."""
    steps = np.diff(x.astype(np.int64), prepend=np.int64(0))
    return pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpressed(raw: bytes, size: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(raw, decompressed_size=8 * size, codec="zstd"), np.uint8)
    return np.cumsum(np.ascontiguousarray(flat.reshape(8, size).T).view(np.int64).ravel())


COUNTS = "kind int, block long, shard long, key long, n long, keys binary, counts binary"


def counter(shards: int):
    """uid, held_out, text -> kind 0: a block's distinct strings of a shard with their counts in training texts; 1: (key, n) of tokens."""

    def rows(kind: int, **columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        kinds = {"kind": pa.int32(), "block": pa.int64(), "shard": pa.int64(), "key": pa.int64(), "n": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}
        columns["kind"] = np.full(n, kind)
        return pa.record_batch([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))

    def strings_of(block: int, parts: list) -> pa.RecordBatch:
        keys, n = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        shard = shard_of(keys, shards)
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.diff(shard[order])) + 1
        split = [i for i in np.split(order, cut) if len(i)]
        return rows(0, block=[block] * len(split), shard=[int(shard[i[0]]) for i in split], n=[len(i) for i in split], keys=[pressed(keys[i]) for i in split], counts=[pressed(n[i]) for i in split])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, words = None, [], (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for block, batch in blocked(batches):
            if block != now and parts:
                yield strings_of(now, parts)
                parts = []
            now = block
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            grams, doc, _ = strings(batch.column(2))
            unseen = held[doc]
            parts.append(np.unique(grams[~unseen].view(np.int64), return_counts=True))
            other = np.unique(grams[unseen].view(np.int64))
            parts.append((other, np.zeros(len(other), np.int64)))
            word, of = word_hashes(batch.column(2))
            keys, times = np.unique(word[~held[of]], return_counts=True)
            words = _summed(np.concatenate([words[0], keys]), np.concatenate([words[1], times]))
            if len(words[0]) > TASK_WORDS:
                yield rows(1, key=words[0], n=words[1])
                words = words[0][:0], words[1][:0]
        if parts:
            yield strings_of(now, parts)
        yield rows(1, key=words[0], n=words[1])

    return count


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma by Stirling's series after shifting small arguments."""
    x = x.astype(np.float64)
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        shift[small] += np.log(x[small])
        x = np.where(small, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) - shift


def block_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    half = math.lgamma(0.5)
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - 2 * half - _lgamma(zeros + ones + 1.0)


def nodes_of(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted nodes (context << 8 | place in the byte's binary tree) of sorted strings, their counts of 0 and 1 bits."""
    byte, head = grams & np.uint64(255), grams & ~np.uint64(255)
    found = []
    for k in range(8):  # a node's strings are neighbours, as strings are sorted
        key = head | (np.uint64(1 << k) | byte >> np.uint64(8 - k) if k else np.uint64(1))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        bit = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
        sums = [np.add.reduceat(x, first) if len(first) else x for x in (n * (1 - bit), n * bit)]
        found.append((key[first], *sums))
    order = np.argsort(np.concatenate([f[0] for f in found]))
    return tuple(np.concatenate([f[i] for f in found])[order] for i in range(3))


def shortened(nodes: np.ndarray, depth: int) -> np.ndarray:
    """The nodes' keys at ``depth`` context bytes."""
    return nodes & np.uint64((1 << 8 * (depth + 1)) - 1)


def climb(levels: list, first: int, below: np.ndarray | None = None) -> tuple[list, list, np.ndarray]:
    """Parents, weights of stopping, and the first level's log mixture of levels (nodes, zeros, ones) from depth ``first``.

    ``below`` is what still longer contexts give the last level; without it the last level stops.
    """
    parent = [None] + [np.searchsorted(levels[i - 1][0], shortened(levels[i][0], first + i - 1)) for i in range(1, len(levels))]
    stop, mixed = [np.ones(len(x[0])) for x in levels], None
    for i in range(len(levels) - 1, -1, -1):
        here = block_estimate(*levels[i][1:])
        if mixed is not None:
            below = np.bincount(parent[i + 1], weights=mixed, minlength=len(here))
        if below is None:
            mixed = here
            continue
        stop[i] = 1 / (1 + np.exp(np.clip(below - here, -700, 700)))
        mixed = np.logaddexp(here, below) + math.log(0.5)
    return parent, stop, mixed


def descend(levels: list, parent: list, stop: list, added: np.ndarray, left: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """The mixture's chance of a 1 at each node; what the last level adds, and what is left for longer contexts."""
    chance = []
    for i, (_, zeros, ones) in enumerate(levels):
        if i:
            added, left = added[parent[i]], left[parent[i]]
        own = (ones + 0.5) / (zeros + ones + 1.0)
        chance.append((added + left * own).astype(np.float32))
        added, left = added + left * stop[i] * own, left * (1 - stop[i])
    return chance, added, left


class Top:
    """The nodes of 0 .. TOP context bytes, from the last depth's nodes, counts and sums of the shards' mixtures."""

    def __init__(self, nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        levels = [(nodes, zeros, ones)]
        for d in range(TOP - 1, -1, -1):
            key, back = np.unique(shortened(nodes, d), return_inverse=True)
            levels.insert(0, (key, *(np.bincount(back, weights=x, minlength=len(key)).astype(np.int64) for x in (zeros, ones))))
        parent, stop, _ = climb(levels, 0, below)
        self.nodes = [x[0] for x in levels]
        self.chance, self.added, self.left = descend(levels, parent, stop, np.zeros(len(self.nodes[0])), np.ones(len(self.nodes[0])))


def longer(grams: np.ndarray, n: np.ndarray) -> list:
    """Levels of more than TOP context bytes of sorted full strings."""
    levels = []
    for d in range(TOP + 1, DEPTH + 1):
        levels.append(nodes_of(*_summed(grams & np.uint64((1 << 8 * (d + 1)) - 1), n)))
    return levels


class Tree:
    """For every depth: sorted nodes and the mixture's chance of a 1; of the strings that share a shard, under ``top``."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]], top: Top | None = None):
        grams, n = tables[-1]
        levels = longer(grams, n)
        parent, stop, mixed = climb(levels, TOP + 1)
        top = top or Top(*upward(levels[0], mixed))
        at = np.searchsorted(top.nodes[TOP], shortened(levels[0][0], TOP))
        chance, _, _ = descend(levels, parent, stop, top.added[at], top.left[at])
        self.nodes, self.chance = top.nodes + [x[0] for x in levels], top.chance + chance
        self.known, self.cost = grams, np.zeros(0, np.float32)
        self.cost = self._walk(self.known).astype(np.float32)

    def _walk(self, grams: np.ndarray) -> np.ndarray:
        """log10 of each string's last byte given the bytes before, bit by bit at the deepest node known."""
        total = np.zeros(len(grams))
        byte = grams & np.uint64(255)
        for k in range(8):
            place = np.uint64(1 << k) | byte >> np.uint64(8 - k) if k else np.full(len(grams), 1, np.uint64)
            bit = (byte >> np.uint64(7 - k)) & np.uint64(1)
            chance, open_ = np.full(len(grams), 0.5), np.ones(len(grams), bool)
            for d in range(len(self.nodes) - 1, -1, -1):
                todo = np.flatnonzero(open_)
                if not len(todo) or not len(self.nodes[d]):
                    continue
                key = (grams[todo] & np.uint64((1 << 8 * (d + 1)) - 1) & ~np.uint64(255)) | place[todo]
                at = np.minimum(np.searchsorted(self.nodes[d], key), len(self.nodes[d]) - 1)
                hit = self.nodes[d][at] == key
                chance[todo[hit]] = self.chance[d][at[hit]]
                open_[todo[hit]] = False
            total += np.log10(np.where(bit == 1, chance, 1 - chance))
        return total

    def costs(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams))
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
            hit = self.known[at] == grams
            out[hit] = self.cost[at[hit]]
        else:
            hit = np.zeros(len(grams), bool)
        out[~hit] = self._walk(grams[~hit])
        return out


def most_frequent(level: DataFrame, most: int) -> int:
    """The least count n such that at most ``most`` keys have n or more."""
    top = 1 << 16
    sizes = {r["n"]: r["k"] for r in level.groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count("*").alias("k")).collect()}
    least, kept = top, sizes.get(top, 0)
    while least > 1 and kept + sizes.get(least - 1, 0) <= most:
        least -= 1
        kept += sizes.get(least, 0)
    return least


def fetched(level: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    got = level.where(F.col("n") >= least).select("key", "n").toArrow()
    keys, n = got.column("key").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def upward(level: tuple, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of TOP context bytes with their counts and the sum of their longer contexts' log mixtures."""
    key, back = np.unique(shortened(level[0], TOP), return_inverse=True)
    return key, *(np.bincount(back, weights=x, minlength=len(key)).astype(np.int64) for x in level[1:]), np.bincount(back, weights=mixed, minlength=len(key))


def shard_strings(part: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A shard's training strings with their counts; the strings of each block."""
    size = part.column("n").to_pylist()
    keys, counts = ([unpressed(raw.as_py(), k) for raw, k in zip(part.column(c), size, strict=True)] for c in ("keys", "counts"))
    key, n = _summed(np.concatenate(keys), np.concatenate(counts))
    return key[n > 0].view(np.uint64), n[n > 0], keys


def climbed(part: pa.Table) -> pa.Table:
    grams, n, _ = shard_strings(part)
    levels = longer(grams, n)
    key, zeros, ones, below = upward(levels[0], climb(levels, TOP + 1)[2])
    return pa.table({"node": key.view(np.int64), "zeros": zeros, "ones": ones, "below": below})


def answerer(top):
    """A shard's blocks -> the costs of each block's strings, in their order."""

    def answer(part: pa.Table) -> pa.Table:
        grams, n, blocks = shard_strings(part)
        tree = Tree([(grams, n)], top.value)
        asked = np.unique(np.concatenate(blocks))
        cost = tree.costs(asked.view(np.uint64)).astype(np.float32)
        return pa.table({"block": part.column("block"), "shard": part.column("shard"), "costs": pa.array([cost[np.searchsorted(asked, b)].tobytes() for b in blocks], pa.binary())})

    return answer


def scorer(model, shards: int):
    """A block's texts (block, uid, doc_id, held_out, text) and its answers -> a row a document, with the tokens that the broadcast table lacks."""

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        known, counts, ends = model.value
        logs = np.log10(counts + 0.5)
        parts, rows = [], []
        for batch in common.slices(iter(texts.to_batches()), "text", SLICE):
            grams, doc, words = strings(batch.column("text"))
            distinct, back = np.unique(grams, return_inverse=True)
            parts.append((batch, words, np.bincount(doc, minlength=batch.num_rows), distinct, back.astype(np.int32)))
            del grams, doc, back
        asked = np.unique(np.concatenate([x[3] for x in parts]))
        order = np.argsort(shard_of(asked, shards), kind="stable")
        got = answers.sort_by("shard").column("costs").to_pylist()
        got = np.frombuffer(b"".join(got), np.float32)
        if len(got) != len(asked):
            raise ValueError(f"{len(asked)} strings of a block were answered by {len(got)} costs: the texts must be a stored table")
        cost = np.empty(len(asked))
        cost[order] = got
        for batch, words, size, distinct, back in parts:
            n = batch.num_rows
            total = np.add.reduceat(cost[np.searchsorted(asked, distinct)][back], np.cumsum(size) - size)  # every text has its end
            word, of = word_hashes(batch.column("text"))
            at = np.minimum(np.searchsorted(known, word), max(0, len(known) - 1))
            hit = known[at] == word if len(known) else np.zeros(len(word), bool)
            base = np.bincount(of[hit], weights=logs[at[hit]], minlength=n) + math.log10(ends + 0.5)
            met = np.bincount(of[hit], minlength=n) + (ends > 0)
            rare = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(of[~hit], minlength=n))]).astype(np.int32), pa.array(word[~hit]))
            columns = [pa.array(words + 1), pa.array(met.astype(np.int64)), pa.array(base), pa.array(total), pa.array(-total / math.log10(2) / size), rare]
            rows.append(pa.record_batch([*(batch.column(c) for c in ("uid", "doc_id", "held_out")), *columns], names=["uid", "doc_id", "held_out", "n_tokens", "met", "base", "score", "bits_per_byte", "rare"]))
        return pa.Table.from_batches(rows)

    return score


SCORES = "uid long, doc_id long, held_out boolean, n_tokens long, met long, base double, score double, bits_per_byte double, rare array<long>"


def report(docs: DataFrame) -> DataFrame:
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD, F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), fold.alias("held_out"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    shards = common.wide_enough(spark, rows.count(), SHARD_TEXTS)
    counted = common.stored(rows.select("uid", "held_out", "text").mapInArrow(counter(shards), COUNTS), "op4-counts")
    asked = counted.where("kind = 0").select("block", "shard", "n", "keys", "counts")
    words = common.stored(counted.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")), "op4-words")
    up = asked.groupBy("shard").applyInArrow(climbed, "node long, zeros long, ones long, below double")
    up = up.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).toArrow().sort_by("node")
    top = Top(*(up.column(c).to_numpy().astype(kind) for c, kind in (("node", np.uint64), ("zeros", np.int64), ("ones", np.int64), ("below", np.float64))))
    answers = asked.groupBy("shard").applyInArrow(answerer(spark.sparkContext.broadcast(top)), "block long, shard long, costs binary")
    answers = common.stored(answers, "op4-answers")
    texts = rows.where(~F.col("held_out")).count()
    tokens = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    all_tokens, distinct = int(tokens["n"] or 0) + texts, int(tokens["v"]) + (texts > 0)
    least = most_frequent(words, WORDS)
    model = spark.sparkContext.broadcast((*fetched(words, least), texts))
    laid = rows.mapInArrow(in_blocks, "block long, uid long, doc_id long, held_out boolean, text string")
    scores = laid.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scorer(model, shards), SCORES)
    scores = common.stored(scores, "op4-scores")
    # tokens met seldom or never: their counts by a join
    rare = scores.select("uid", F.explode("rare").alias("key")).join(words.where(F.col("n") < least), "key", "left")
    rare = rare.groupBy("uid").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.count("n").alias("also"))
    unit = math.log10(all_tokens + 0.5 * (distinct + 1))
    return scores.join(rare, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("met") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"), F.lit(all_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * unit).alias("base_score"), "score", "bits_per_byte",
    )

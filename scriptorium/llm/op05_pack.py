"""Best-fit packing: best-two-fit over the histogram of piece lengths.

A document is its tokens and one end token; longer ones are cut into pieces of the capacity.  What a
bin is filled with depends on nothing but how many pieces of each length are left, so the packing is
computed on the histogram (at most ``capacity`` entries, whatever the input): a bin is filled greedily
with the longest piece that fits, then its smallest piece is replaced by the two unpacked pieces that
fill the expanded gap most tightly, as long as that gains.  The bin found is repeated as often as the
counts allow before the next is computed, so each step uses up a length and the number of steps is
bounded by the capacity's size too.  Pieces then take their places by rank within their length; ranks
are taken in salted groups, so a length that a third of all pieces share is spread.

Defined cases: null text is empty and gives one piece, the end token; an empty table gives an empty
result; repeated rows are packed each; pieces of one length are placed by doc_id, then piece.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CAPACITY, END_ID = 4096, 1
SALTS, SALT_ROWS = 256, 50_000_000
TOKENIZER = "word_bpe_49k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Chunks, and as many words, whose ids a worker remembers; beyond that it forgets those not asked for lately.
REMEMBERED = 200_000
#: What Python's split() takes for white space and the tokenizer does not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"

_tokenizers: dict[str, tuple] = {}
common.memories["op5"] = _tokenizers.clear


class _Recent(dict):
    """Values worked out lately: at half of REMEMBERED they become the older half, from which those asked for come back."""

    def __init__(self, work: Callable[[str], bytes]):
        super().__init__()
        self.work, self.older = work, {}

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.work(key)
        if len(self) >= REMEMBERED // 2:
            self.older = dict(self)
            self.clear()
        self[key] = got
        return got


class _Fast:
    """The ids of chunks of text, each worked out once as long as it is remembered.

    Every step of the tokenizer (composition, lower case, its split pattern, merges) works within a
    chunk between white space.  A chunk of Latin letters below U+0250 is composed already and lower-cased
    the same way by Python, so only its new words meet the merges; any other chunk goes through the whole
    tokenizer.  Letters alone, or with signs after them, are split without the pattern, as it does.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        rules = json.loads(self.whole.to_str())
        steps = rules["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.other = regex.compile("[^\x01-\u012f\u0131-\u024f]|<\\|").search
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in letters]
        self.shown = {b: chr(b) for b in letters} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.code = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        self.chunks, self.words = _Recent(self._chunk), _Recent(self._word)

    def raw(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if any(c in text for c in NOT_SPACE):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def _chunk(self, chunk: str) -> bytes:
        if not (chunk.isascii() and chunk.isalpha()) and self.other(chunk):
            return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        low = chunk.lower()
        if low == chunk:
            low = chunk  # one string for both memories
        stem = low.rstrip(string.punctuation)
        if stem.isalpha():
            return self.words[stem] + self.words[low[len(stem) :]] if len(stem) < len(low) else self.words[stem]
        return b"".join(map(self.words.__getitem__, self.split(low)))

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.shown)
        return b"".join([self.code[t.id] for t in self.model.tokenize(shown)])


def _tokenizer(path: str) -> _Fast:
    if path not in _tokenizers:
        _tokenizers[path] = _Fast(path)
    return _tokenizers[path]


def token_ids(text: str, path: str) -> np.ndarray:
    """The tokenizer's ids of a text."""
    return np.frombuffer(_tokenizer(path).raw(text), "<u4")


def cutter(path: str, capacity: int):
    end, width = END_ID.to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = _tokenizer(path).raw
        for batch in common.slices(batches, "text", 1 << 20):
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = raw(text or "") + end
                for piece, start in enumerate(range(0, len(ids), width)):
                    part = ids[start : start + width]
                    for column, value in zip(out, (doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return cut


def best_two(counts: np.ndarray, gap: int) -> tuple[int, int]:
    """The two lengths left, together at most ``gap`` and as long as can be; (0, 0) if there are none."""
    left = np.flatnonzero(counts[: gap + 1])
    left = left[left > 0]
    if not len(left):
        return 0, 0
    partner = np.searchsorted(left, gap - left, "right") - 1
    ok = partner >= 0
    second = np.where(ok, left[np.maximum(partner, 0)], 0)
    twin = ok & (second == left) & (counts[left] < 2)
    lower = np.maximum(partner - 1, 0)
    second = np.where(twin, np.where(partner > 0, left[lower], 0), second)
    total = np.where(second > 0, left + second, 0)
    best = int(total.argmax())
    return (int(left[best]), int(second[best])) if total[best] else (0, 0)


def greedy(counts: np.ndarray, gap: int) -> tuple[list[int], int]:
    """Lengths that fill a gap, the longest that fits first, and the gap that is left; counts are used up."""
    taken: list[int] = []
    while gap > 0 and (left := np.flatnonzero(counts[: gap + 1])).size and left[-1]:
        size = int(left[-1])
        # a length that fits several times is taken as often as it fits
        times = min(int(counts[size]), gap // size)
        taken += [size] * times
        counts[size] -= times
        gap -= size * times
    return taken, gap


def fill(counts: np.ndarray, capacity: int) -> list[int]:
    """The lengths of one bin: greedy, longest first, then best-two-fit; counts are used up."""
    bin_, gap = greedy(counts, capacity)
    while gap > 0 and len(bin_) > 1:
        least = bin_[-1]
        one, two = best_two(counts, gap + least)
        if one + two <= least:
            break
        counts[least] += 1
        counts[one] -= 1
        counts[two] -= 1
        bin_ = sorted([*bin_[:-1], one, two], reverse=True)
        gap += least - one - two
    return bin_


def pack(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Bins as (lengths, times) that use every piece of the histogram once: the fewer of two ways.

    Pieces of at most a sixth of the capacity either take part from the start or are held back until the
    others are packed, then fill the gaps.
    """
    plain, held = _packed(histogram, capacity, 0), _packed(histogram, capacity, capacity // 6)
    return min(plain, held, key=lambda bins: sum(times for _, times in bins))


def _packed(histogram: dict[int, int], capacity: int, small: int) -> list[tuple[Counter, int]]:
    counts, late = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        (late if length <= small else counts)[length] = n
    main = _filled(counts, capacity)
    out = []
    for bin_, times in main:
        gap = capacity - sum(k * v for k, v in bin_.items())
        while times:
            more = Counter(greedy(late, gap)[0])
            same = times - 1
            if more:  # the same filling again, for as many of these bins as it suffices for
                lengths, each = np.array(list(more)), np.array(list(more.values()))
                same = min(same, int((late[lengths] // each).min()))
                late[lengths] -= same * each
            out.append((bin_ + more, 1 + same))
            times -= 1 + same
    return out + _filled(late, capacity)


def _filled(counts: np.ndarray, capacity: int) -> list[tuple[Counter, int]]:
    out = []
    while counts.any():
        bin_ = Counter(fill(counts, capacity))
        # a bin whose counts still suffice comes out the same again: repeat it until one runs short
        lengths, each = np.array(list(bin_)), np.array(list(bin_.values()))
        more = int((counts[lengths] // each).min())
        counts[lengths] -= more * each
        out.append((bin_, 1 + more))
    return out


def places(bins: list[tuple[Counter, int]]) -> list[tuple]:
    """(length, first rank, ranks, times, first sequence, offset): rank r of a length goes to sequence
    first + (r - first rank) % times, at offset + length * ((r - first rank) // times)."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for bin_, times in bins:
        at = 0
        for length, each in sorted(bin_.items(), reverse=True):
            rows.append((length, used[length], each * times, times, sequence, at))
            used[length] += each * times
            at += length * each
        sequence += times
    return rows


def report(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece with its sequence and its offset there."""
    spark = docs.sparkSession
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.lean(cutter(tokenizer, capacity), "op5"), PIECES)
    pieces = common.stored(pieces.withColumn("uid", F.monotonically_increasing_id()), "op5-pieces")
    salts = SALTS * (1 + pieces.count() // SALT_ROWS)
    pieces = pieces.withColumn("salt", common.salt(F.col("uid"), salts))
    groups = common.stored(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")), "op5-groups")
    histogram = {int(r["length"]): int(r["n"]) for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = places(pack(histogram, capacity))
    plan = spark.createDataFrame(rows or [(0, 0, 0, 1, 0, 0)], "length long, low long, many long, times long, first long, at long")
    # the plan's ranges, gathered by length: a piece finds its own by binary steps over an array
    plan = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "many", "times", "first", "at"))).alias("plan"))
    before = groups.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    before = before.drop("n")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "uid")) - 1 + F.col("before")
    ranked = pieces.join(before, ["length", "salt"]).withColumn("rank", rank)
    # ranges overlap a group of ranks seldom more than once, so the ranges that can hold a group are joined, not the whole plan
    spans = before.join(groups, ["length", "salt"]).join(plan, "length")
    spans = spans.select("length", "salt", F.filter("plan", lambda p: (p["low"] < F.col("before") + F.col("n")) & (p["low"] + p["many"] > F.col("before"))).alias("plan"))
    found = ranked.join(spans, ["length", "salt"]).withColumn("p", F.filter("plan", lambda p: (p["low"] <= F.col("rank")) & (F.col("rank") < p["low"] + p["many"]))[0])
    step = F.col("rank") - F.col("p.low")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("p.first") + step % F.col("p.times")).alias("sequence_id"),
        (F.col("p.at") + F.col("length") * F.floor(step / F.col("p.times"))).cast("long").alias("offset"),
    )

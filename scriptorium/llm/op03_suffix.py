"""Suffix-array dedup: longest-previous-factor arrays over the passages that repeat.

A string of LENGTH bytes that occurs twice has in both places the same smallest K-gram hash (the
leftmost of equal ones), so every window of LENGTH bytes belongs to one anchor, and equal windows to
anchors of the same hash at the same distance.  Runs of neighbouring windows with the same anchor form
a context: the bytes from the first window's start to the last one's end.  Contexts are grouped by
their anchor's hash; a hash that occurs once holds nothing that repeats.  Equal contexts repeat whole.
Only where the contexts of a hash differ are their bytes fetched: one of each kind goes to the hash's
group, where a suffix array (prefix doubling, one alphabet a group), its LCP array and the previous and
next smaller positions in suffix order give for every position the longest earlier factor and its place.

A hash with more than CROWD kinds of context (a common line in different places) is parted before it is
compared: windows that start far before the anchor hold the bytes before it, the others those after it,
so each context falls into two, with anchors longer by half of what is left of the window, and contexts of
the same longer anchor meet.  Crowds of these are parted again, until the anchor is the window itself.
Hashes that come often in one slice of the scan are dealt out by their contexts, not by themselves.

A position whose longest previous factor has LENGTH bytes or more starts a later copy; the place it
points to starts an earlier one.  ``keep_first`` removes only the later copies' bytes (from the second
occurrence by document, then place); without it every byte of a repeated window goes, first copies too.

Defined cases: null is empty; texts shorter than LENGTH keep all; matches never cross documents;
repeated rows are documents of their own and repeat each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, K = 200, 48
ROWS_EACH = 400_000
#: Kinds of context of one anchor hash that are compared in one suffix array; hashes with more are parted first.
CROWD = 1024
#: Rows of one hash in a slice of the scan from which on it is dealt out by its contexts; bytes of text in a slice.
OFTEN, SLICE = 16, 1 << 20
#: Bytes of contexts that share a suffix array, if their hashes have fewer; rows with texts that go to Python at once.
TOGETHER, WIDE_ROWS = 256 << 10, 1000
#: place: the anchor's distance from the start, and the bytes before and after the first anchor that it has grown by.
CONTEXTS = "h long, c long, uid long, start int, size int, place int, often boolean"
#: A context, or with ``mark`` one that is known to repeat whole.
FOUND = CONTEXTS + ", mark boolean"
MARKS = "uid long, start int, end int"


def _anchor_places(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple:
    """Prefix hashes; starts of the context's first window, number of windows and anchor of each context of a batch."""
    n = len(data)
    prefix = common.prefix_hash(data)
    if n < length:
        return prefix, *(np.zeros(0, np.int64) for _ in range(3))
    at = np.arange(n - k + 1)
    gram = common.mix((prefix[at + k] - prefix[at]) * common.powers("down", n + 1)[at])
    # the smallest hash of each window, the leftmost of equal ones: minima over growing powers of two
    span, done, best = length - k + 1, 1, at.copy()
    while done < span:
        step = min(done, span - done)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(gram[right] < gram[left], right, left)
        done += step
    inside = np.ones(len(best), bool)
    # windows that run over a document's end
    for end in offsets[1:]:
        inside[max(0, end - length + 1) : end] = False
    start = np.flatnonzero(inside)
    if not len(start):
        return prefix, *(np.zeros(0, np.int64) for _ in range(3))
    a = best[start]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)]))
    return prefix, start[first], np.diff(np.concatenate([first, [len(start)]])), a[first]


def _context_hash(prefix: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of a context with its anchor's distance from its start."""
    return common.mix(common.span_hash(prefix, start, start + size) + common.mix((at << 32 | size).astype(np.uint64)))


def _contexts(h, c, uid, start, size, place, often, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Rows FOUND of contexts in the order of documents: of equal ones only the first goes on, those that repeat are marked here."""
    order = np.lexsort((c, h))
    same = (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])
    later, marked = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:][same]] = marked[order[1:][same]] = True
    if not keep_first:
        marked[order[:-1][same]] = True
    for rows, mark in ((~later, False), (marked, True)):
        columns = [pa.array(x[rows].view(np.int64)) for x in (h, c, uid)] + [pa.array(x[rows].astype(np.int32)) for x in (start, size, place)]
        yield pa.record_batch([*columns, pa.array(often[rows]), pa.array(np.full(int(rows.sum()), mark))], names=[x.split()[0] for x in FOUND.split(", ")])


def finder(length: int, k: int, keep_first: bool):
    """uid, text -> one row a context."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", SLICE):
            data, offsets = common.text_bytes(batch.column(1))
            prefix, start, windows, anchor = _anchor_places(data, offsets, length, k)
            size = windows + length - 1
            h = common.mix(common.span_hash(prefix, anchor, anchor + k))
            c = _context_hash(prefix, start, size, anchor - start)
            doc = np.searchsorted(offsets, start, "right") - 1
            _, back, times = np.unique(h, return_inverse=True, return_counts=True)
            yield from _contexts(h, c, batch.column(0).to_numpy()[doc], start - offsets[doc], size, anchor - start, times[back] >= OFTEN, keep_first)

    return find


def parter(length: int, k: int, keep_first: bool):
    """Contexts with their bytes -> the two contexts that each falls into: windows far before the anchor, and the others."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.text_bytes(batch.column("bytes"))
            prefix, begin, windows = common.prefix_hash(data), offsets[:-1], np.diff(offsets) - length + 1
            place = batch.column("place").to_numpy().astype(np.int64)
            at, left, right = place & 255, place >> 8 & 255, place >> 16 & 255
            slack = length - k - left - right
            grown = (slack + 1) // 2
            # the windows that start at the context's first ``cut`` bytes hold ``grown`` more bytes before the anchor
            cut = np.clip(at - left - grown + 1, 0, windows)
            for first, last, more, after in ((np.zeros_like(cut), cut, grown, 0 * cut), (cut, windows, 0 * cut, slack + 1 - grown)):
                ok = np.flatnonzero((last > first) & (slack > 0))
                first, size, l, r = first[ok], (last - first + length - 1)[ok], (left + more)[ok], (right + after)[ok]
                from_, to = (begin + at)[ok] - l, (begin + at)[ok] + k + r
                h = common.mix(common.span_hash(prefix, from_, to) + common.mix((l << 8 | r).astype(np.uint64)))
                d = at[ok] - first
                c = _context_hash(prefix, begin[ok] + first, size, d)
                yield from _contexts(h, c, batch.column("uid").to_numpy()[ok], batch.column("start").to_numpy()[ok] + first, size, d | l << 8 | r << 16, np.ones(len(ok), bool), keep_first)

    return part


def suffix_array(text: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order by the first ``depth`` (or more) characters, ties by place, and the ranks of each doubling.

    Characters of different groups differ; a string ends where its group or a 0 ends it.
    """
    n = len(text)
    ranks = [np.unique(group.astype(np.int64) << 9 | text, return_inverse=True)[1].astype(np.int32)]
    step = 1
    while step < depth:
        now = ranks[-1]
        both = now.astype(np.int64) * (int(now.max()) + 2)
        if step < n:
            both[: n - step] += now[step:] + 1
        ranks.append(np.unique(both, return_inverse=True)[1].astype(np.int32))
        step *= 2
    return np.argsort(ranks[-1], kind="stable"), ranks


def adjacent_lcp(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in the order (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    a, b = order[:-1].copy(), order[1:].copy()
    n, got = len(order), np.zeros(len(order) - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        rank = ranks[level]
        same = (a < n) & (b < n)
        same[same] = rank[a[same]] == rank[b[same]]
        # a suffix that ends within the step has a rank of its own, so equal ranks mean equal characters
        got += same << level
        a, b = a + (same << level), b + (same << level)
    out[1:] = got
    return out


def previous_factors(order: np.ndarray, lcp: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For every text place the length of the longest factor that also starts earlier, and that earlier place.

    The earlier places that share most with a suffix are the previous and the next smaller position
    in suffix order; both are found for all suffixes together by jumping along pointers.  A search ends
    where less than ``least`` is shared; lengths below it count as 0.
    """
    n = len(order)
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    place = np.concatenate([order, [-1]])  # the sentinel is smaller than every place
    for side in (-1, 1):
        to = np.arange(n + 1) + side
        to[n] = n
        to[to < 0] = n
        near = np.append(lcp if side < 0 else np.append(lcp[1:], 0)[:n], 0)
        active = np.flatnonzero((near >= least) & (place[to] > place))
        while len(active):
            ahead = to[active]
            near[active] = np.minimum(near[active], near[ahead])
            to[active] = to[ahead]
            active = active[(near[active] >= least) & (place[to[active]] > place[active])]
        better = (near[:n] >= least) & (near[:n] > length[order]) & (place[to[:n]] < order) & (to[:n] < n)
        length[order[better]] = near[:n][better]
        source[order[better]] = place[to[:n][better]]
    return length, source


def repeated_windows(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, length: int, keep_first: bool) -> np.ndarray:
    """For every byte of contexts (of a group each): whether a window that starts there occurs in another of its group."""
    size, n = np.diff(offsets), len(group)
    # the end mark of each context is a character of its own: it never matches
    at = np.arange(len(data)) + np.repeat(np.arange(n), size)
    ends = offsets[1:] + np.arange(n)
    text, own = np.zeros(len(data) + n, np.int32), np.zeros(len(data) + n, np.int32)
    text[at], own[at], own[ends] = data.astype(np.int32) + 1, np.repeat(group, size), np.arange(n) + (int(group.max(initial=0)) + 1)
    order, ranks = suffix_array(text, own, length)
    longest, source = previous_factors(order, adjacent_lcp(order, ranks), length)
    later = longest >= length
    hit = later.copy()
    if not keep_first:
        hit[source[later]] = True
    return hit[at]


def sorter(keep_first: bool):
    """Contexts sorted by (h, c, uid, start) -> those that repeat whole (kind 0) and, of hashes that have several
    kinds of context or come often, the first of each kind (kind 1).  Two rows at most wait for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        waiting = first = None  # a kind's first row that may yet repeat; a hash's first kind that may yet have company

        def out(rows: pa.RecordBatch, kind: int) -> pa.RecordBatch:
            return rows.append_column("kind", pa.array(np.full(rows.num_rows, kind, np.int32)))

        for batch in batches:
            if not batch.num_rows:
                continue
            h, c, often = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(6).to_numpy(zero_copy_only=False).astype(bool)
            new_h = np.concatenate([[h[0] != last[0]], h[1:] != h[:-1]])
            new_c = new_h | np.concatenate([[c[0] != last[1]], c[1:] != c[:-1]])
            again = ~new_c
            if not keep_first:
                again[:-1] |= ~new_c[1:]
                if waiting is not None and not new_c[0]:
                    yield out(waiting, 0)
                waiting = batch.slice(len(h) - 1) if new_c[-1] else None
            yield out(batch.filter(pa.array(again)), 0)
            kinds = np.flatnonzero(new_c)
            if len(kinds):
                company = new_h[kinds] & np.append(~new_h[kinds[1:]], False) | ~new_h[kinds] | often[kinds]
                if first is not None and not new_h[kinds[0]]:
                    yield out(first, 1)
                    first = None
                yield out(batch.take(pa.array(kinds[company])), 1)
                if new_h[kinds].any():
                    first = batch.slice(kinds[-1], 1) if new_h[kinds[-1]] and not often[kinds[-1]] else None
            last = (h[-1], c[-1])

    return run


def removed(docs: DataFrame, length: int = LENGTH, k: int = K, keep_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """Texts (uid, doc_id, text), and the marks (uid, start, end) of bytes to remove, some overlapping."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = texts.select("uid", "text")
    found = common.stored(plain.mapInArrow(finder(length, k, keep_first), FOUND), "op3-contexts", WIDE_ROWS)
    marks = found.select("uid", "start", "start").toDF(*(x.split()[0] for x in MARKS.split(", "))).limit(0)
    count = found.count()
    while count:
        parts = common.wide_enough(spark, count, ROWS_EACH)
        marks = marks.union(found.where("mark").select("uid", "start", (F.col("start") + F.col("size")).cast("int")))
        found = found.where("not mark").drop("mark")
        # rows of hashes that come often somewhere are dealt out by their contexts too
        often = found.where("often").select("h", F.lit(True).alias("spread")).distinct()
        laid = found.drop("often").join(often, "h", "left").withColumn("often", F.coalesce("spread", F.lit(False))).drop("spread")
        laid = laid.repartition(parts, "h", F.when(F.col("often"), F.col("c"))).sortWithinPartitions("h", "c", "uid", "start")
        rows = common.stored(laid.mapInArrow(sorter(keep_first), CONTEXTS + ", kind int"), "op3-kinds")
        marks = marks.union(rows.where("kind = 0").select("uid", "start", (F.col("start") + F.col("size")).cast("int")))
        kinds = rows.where("kind = 1").select("h", "uid", "start", "size", "place")
        company = common.stored(kinds.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "op3-company")
        asked = common.stored(kinds.join(company, "h"), "op3-asked")
        # the bytes of the contexts that must be compared, one of each kind
        lists = asked.groupBy("uid").agg(F.collect_list(F.struct("h", "start", "size", "place", "n")).alias("asked"))
        whole = common.among(plain, asked.select("uid"), "uid")
        fetched = whole.join(lists, "uid").select("uid", F.explode("asked").alias("a"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))
        fetched = fetched.select("a.h", "uid", "a.start", "a.place", "a.n", F.substring("bytes", F.col("a.start") + 1, F.col("a.size")).alias("bytes"))
        fetched = common.stored(fetched, "op3-fetched")
        alone = fetched.where(F.col("n") <= CROWD).select("h", "uid", "start", "bytes")
        parts = common.wide_enough(spark, asked.count(), ROWS_EACH // 4)
        compared = alone.repartition(parts, "h").sortWithinPartitions("h", "uid", "start").mapInArrow(comparer(length, keep_first), MARKS)
        marks = marks.union(common.stored(compared, "op3-compared", WIDE_ROWS))
        found = common.stored(fetched.where(F.col("n") > CROWD).mapInArrow(parter(length, k, keep_first), FOUND), "op3-contexts", WIDE_ROWS)
        count = found.count()
    return texts, marks


def comparer(length: int, keep_first: bool):
    """Contexts (h, uid, start, bytes) sorted by hash -> marks of the windows that repeat; small groups share one suffix array.

    A group has CROWD contexts at most, so what is held is bounded.
    """

    def marks(part: pa.Table) -> pa.RecordBatch:
        h = part.column("h").to_numpy()
        data, offsets = common.text_bytes(part.column("bytes"))
        group = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
        at = np.flatnonzero(repeated_windows(data, offsets, group, length, keep_first))
        of = np.searchsorted(offsets, at, "right") - 1
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (np.diff(at) > length)]) if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1 if len(at) else first
        begin = part.column("start").to_numpy()[of[first]] - offsets[of[first]]
        return pa.record_batch([pa.array(part.column("uid").to_numpy()[of[first]], pa.int64()), pa.array((begin + at[first]).astype(np.int32)), pa.array((begin + at[last] + length).astype(np.int32))], names=["uid", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in (b for whole in batches for b in common.slices(iter([whole]), "bytes", TOGETHER)):
            held.append(batch)
            part = pa.Table.from_batches(held).combine_chunks()
            cut = np.flatnonzero(np.diff(part.column("h").to_numpy())) + 1
            if len(cut) and part.nbytes >= TOGETHER:
                yield marks(part.slice(0, cut[-1]))
                held = part.slice(cut[-1]).to_batches()
        if held:
            yield marks(pa.Table.from_batches(held).combine_chunks())

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, marks in zip(batch.column(1), batch.column(2), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            spans: list[list[int]] = []
            for start, end in sorted((m["start"], m["end"]) for m in marks.as_py() or ()):
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([start, end])
            kept, at = hashlib.sha256(), 0
            for start, end in spans:
                kept.update(data[at:start])
                at = end
            kept.update(data[at:])
            for column, value in zip(out, (len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest()), strict=True):
                column.append(value)
        yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    texts, marks = removed(docs, length)
    per = marks.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("marks"))
    rows = texts.join(per, "uid", "left").select("doc_id", "text", "marks")
    return rows.mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

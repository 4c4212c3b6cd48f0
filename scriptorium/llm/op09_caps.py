"""Embedding near-dedup: spherical-cap filters with structured random product codes.

A vector's coordinates are rotated and cut into BLOCKS blocks; each block has a random code of m unit
vectors, and a filter is one code vector of every block, so m ** BLOCKS directions need no table.  A
vector falls into every filter whose inner product with it exceeds a threshold; these are listed by
going through the blocks' inner products in falling order and cutting off branches whose best completion
falls short.  m grows with the number of vectors so that a filter keeps about PER_FILTER vectors of
spread-out data, and the threshold is set so that a vector falls into FILTERS filters on average.

Vectors are dealt out by the first blocks' words of their filters, a bucket for each such prefix, so a vector
travels once for all filters of a bucket; the worker that holds a bucket lists the other blocks' words itself.
The buckets are dealt in rounds, whose shuffle files go before the next round, so that no more than about
ROUND_SHARE times the vectors' bytes are on their way at once, however often a vector travels in all.

Vectors that share a filter are compared by exact cosine, filters of one size together.  A linked pair that
meets in several filters counts only in the smallest filter both fall into, so links are counted without
listing pairs, and a bucket gives back a count a vector and, for each vector, the least one that its links
reach.  Equal directions collapse to one representative with a multiplicity beforehand.  Buckets with more
rows or bytes than a chunk are cut into chunks by a hash; every pair of chunks is a group of its own.  Filters
of more than SMALL rows are compared in strips of STRIP rows.

Defined cases: null vectors, empty ones, zero vectors, vectors with null or non-finite components and
vectors of another length than most link with nothing and are their own component; repeated rows count
as vectors of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from . import common

THRESHOLD = 0.95
BLOCKS, PER_FILTER, FILTERS, SEED = 4, 2, 16, 11
#: Codes grow with PER_FILTER up to this many words a block, then as if a filter were to keep DENSE vectors.
WORDS, DENSE = 24, 16
#: Every filter this near to a vector's best one is taken, however far the best one is from the threshold.
NEAR_BEST = 0.88
#: Rows and bytes of a bucket's chunk; rows of a strip; the largest filters that are compared together.
BLOCK_ROWS, BLOCK_BYTES, STRIP, SMALL = 1 << 18, 200 << 20, 128, 256
#: Shuffled bytes of a round: this share of the vectors' bytes, but ROUND_LEAST in any case; bytes of a shuffle partition.
ROUND_SHARE, ROUND_LEAST, PART_BYTES = 1.2, 256 << 20, 32 << 20
#: Bytes of a shuffled row beside its vector.
BESIDE = 80
#: Rows with vectors that go to Python at once.
WIDE_ROWS = 1000
LINKS = "rep long, links long, other long"


def words_a_block(count: int, blocks: int) -> int:
    """Code vectors of a block, for ``count`` vectors."""
    of = lambda each: int(np.ceil((count / each * FILTERS / 2) ** (1 / blocks)))
    return max(4, min(of(PER_FILTER), max(WORDS, of(DENSE)))) if blocks > 1 else max(4, min(of(PER_FILTER), 1 << 12))


class Code:
    """The random product code for vectors of one dimension."""

    def __init__(self, dim: int, count: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.blocks = max(1, min(BLOCKS, dim // 4))
        self.cuts = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.m = words_a_block(count, self.blocks)
        self.words = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            w = rng.standard_normal((self.m, b - a))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True))
        self.filters = float(self.m) ** self.blocks
        # the threshold that a random direction exceeds for FILTERS filters on average
        probe = rng.standard_normal((4000, dim))
        probe /= np.linalg.norm(probe, axis=1, keepdims=True)
        sums = np.zeros((4000, 512))
        for dots in self.dots(probe):
            sums += dots[:, rng.integers(0, self.m, 512)]
        share = min(0.5, FILTERS / self.filters)
        self.least = float(np.quantile(sums, 1 - share)) if share * sums.size >= 20 else self._tail(sums, share)

    @staticmethod
    def _tail(sums: np.ndarray, share: float) -> float:
        from statistics import NormalDist

        return float(sums.std() * NormalDist().inv_cdf(1 - share))

    def dots(self, unit: np.ndarray) -> list[np.ndarray]:
        turned = unit @ self.turn
        return [turned[:, a:b] @ w.T for a, b, w in zip(self.cuts[:-1], self.cuts[1:], self.words, strict=True)]

    def decode(self, unit: np.ndarray, upto: int | None = None, under: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for all filters that each row exceeds, rows and their filters in rising order.

        With ``upto``, the prefixes of that many words of these filters instead; with ``under`` (depth, prefix), the filters with that prefix.
        """
        dots = self.dots(unit)
        best = [d.max(1) for d in dots]
        rest = np.zeros((len(dots) + 1, len(unit)))
        for i in range(len(dots) - 1, -1, -1):
            rest[i] = rest[i + 1] + best[i]
        # a vector whose best filter hardly exceeds the threshold, or doesn't, is held to its own best instead
        least = np.minimum(self.least, NEAR_BEST * rest[0])
        row = np.arange(len(unit))
        total, code = np.zeros(len(unit)), np.zeros(len(unit), np.int64)
        fixed, prefix = under or (0, 0)
        for i, d in enumerate(dots[: upto or len(dots)]):
            if i < fixed:
                word = prefix // self.m ** (fixed - 1 - i) % self.m
                total, code = total + d[:, word], code * self.m + word
                continue
            value = total[:, None] + d[row]
            keep, word = np.nonzero(value + rest[i + 1][row][:, None] >= least[row][:, None])
            total, code, row = value[keep, word], code[keep] * self.m + word, row[keep]
        order = np.lexsort((code, row))
        return row[order], code[order]

    def depth(self, rows: int, count: int) -> int:
        """Words of the shortest prefixes whose buckets hold about ``rows`` vectors at most when the data is spread out."""
        probe = np.random.default_rng(SEED + 1).standard_normal((200, len(self.turn)))
        probe /= np.linalg.norm(probe, axis=1, keepdims=True)
        for words in range(1, self.blocks):
            if len(self.decode(probe, words)[0]) / len(probe) * count / self.m**words <= rows:
                return words
        return self.blocks


def units(flat: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors in double precision; scaled by the largest component first, so that squares neither overflow nor vanish."""
    v = flat.reshape(-1, dim).astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    return v


def decoder(dim: int, count: int, depth: int):
    """rep, n, vector -> rep, n, the vector's bytes and the prefixes of its filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(dim, count)
        kind = pa.int32() if code.m**depth < 1 << 31 else pa.int64()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                flat = part.column(2).flatten().to_numpy(zero_copy_only=False)
                row, prefix = code.decode(units(flat, dim), depth)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                vec = pa.array([x.tobytes() for x in flat.reshape(-1, dim)], pa.binary())
                yield pa.record_batch([part.column(0), part.column(1), vec, pa.ListArray.from_arrays(ends, pa.array(prefix, kind))], names=["rep", "n", "vec", "prefixes"])

    return run


def first_shared(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest common value of the sorted lists i and j, for many pairs; -1 where there is none.

    All pairs step through their two lists together; a pair is done at its first common value.
    """
    out = np.full(len(i), -1, np.int64)
    a, b, a_end, b_end, left = starts[i], starts[j], ends[i], ends[j], np.arange(len(i))
    while True:
        go = (a < a_end) & (b < b_end)
        left, a, b, a_end, b_end = left[go], a[go], b[go], a_end[go], b_end[go]
        if not len(left):
            return out
        x, y = values[a], values[b]
        same = x == y
        out[left[same]] = x[same]
        go = ~same
        less = (x < y)[go]
        left, a, b, a_end, b_end = left[go], a[go] + less, b[go] + ~less, a_end[go], b_end[go]


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of rows i and j, pair by pair: ``label`` is each row's least row known to be reached."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def candidates(unit: np.ndarray, row: np.ndarray, filters: np.ndarray, chunk: np.ndarray | None, threshold: float, strip: int) -> Iterator[tuple]:
    """(i, j, filter) of the pairs of rows that share a filter and whose cosine is ``threshold`` or more; with ``chunk`` of those in different chunks."""
    order = np.argsort(filters, kind="stable")
    row, filters = row[order], filters[order]
    first = np.flatnonzero(np.concatenate([[True], filters[1:] != filters[:-1]])) if len(filters) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(filters)))
    dim = unit.shape[1]
    for s in np.unique(size[size > 1]):
        at = first[size == s]
        if s <= SMALL:
            step = max(1, (1 << 19) // int(s * max(s, dim)))
            below = np.tri(s, k=-1, dtype=bool).T
            for some in np.split(at, range(step, len(at), step)):
                who = row[some[:, None] + np.arange(s)]
                u = unit[who]
                g, x, y = np.nonzero((u @ u.transpose(0, 2, 1) >= threshold) & below)
                yield who[g, x], who[g, y], filters[some[g]]
            continue
        for start in at:
            who = row[start : start + s]
            left = right = who
            if chunk is not None:
                left, right = who[chunk[who] == chunk.min()], who[chunk[who] != chunk.min()]
            other = unit[right].T
            for k in range(0, len(left), strip):
                x, y = np.nonzero(unit[left[k : k + strip]] @ other >= threshold)
                ok = slice(None) if chunk is not None else y > k + x
                x, y = x[ok], y[ok]
                yield left[k + x], right[y], np.full(len(x), filters[start])


def comparer(dim: int, count: int, depth: int, kind: str, threshold: float, strip: int):
    """Groups (bucket, low, high) sorted -> rows (rep, links, other): counts of links, and forest edges."""

    def links(code: Code, part: pa.Table, bucket: int, low: int, high: int) -> Iterator[tuple]:
        flat, _ = common.text_bytes(part.column("vec"))
        unit, rep, n = units(flat.view(kind), dim), part.column("rep").to_numpy(), part.column("n").to_numpy()
        chunk = None if low == high else part.column("chunk").to_numpy()
        rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start in range(0, len(unit), 2000):
            r, f = code.decode(unit[start : start + 2000], under=(depth, bucket))
            rows.append(r + start)
            found.append(f)
        total, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        # all filters of the rows that link, listed when first asked for
        values, starts, ends = np.zeros(0, np.int32 if code.filters < 1 << 31 else np.int64), np.full(len(rep), -1, np.int64), np.zeros(len(rep), np.int64)
        for i, j, where in candidates(unit, np.concatenate(rows), np.concatenate(found), chunk, threshold, strip):
            if chunk is not None:
                ok = chunk[i] != chunk[j]
                i, j, where = i[ok], j[ok], where[ok]
            if not len(i):
                continue
            new = np.unique(np.concatenate([i, j]))
            new = new[starts[new] < 0]
            for some in np.split(new, range(2000, len(new), 2000)):
                r, f = code.decode(unit[some])
                cut = len(values) + np.searchsorted(r, np.arange(len(some) + 1))
                starts[some], ends[some] = cut[:-1], cut[1:]
                values = np.concatenate([values, f.astype(values.dtype)])
            own = first_shared(values, starts, ends, i, j) == where
            i, j = i[own], j[own]
            if len(i):
                total += (np.bincount(i, weights=n[j], minlength=len(rep)) + np.bincount(j, weights=n[i], minlength=len(rep))).astype(np.int64)
                merged(label, i, j)
        hit = np.flatnonzero(total)
        yield rep[hit], total[hit], np.full(len(hit), -1, np.int64)
        joined = np.flatnonzero(label != np.arange(len(rep)))
        yield rep[joined], np.zeros(len(joined), np.int64), rep[label[joined]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(dim, count)
        held: list[pa.RecordBatch] = []
        key = None

        def flush():
            part = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            for r, c, o in links(code, part, *key):
                yield pa.record_batch([pa.array(r, pa.int64()), pa.array(c, pa.int64()), pa.array(o, pa.int64())], names=["rep", "links", "other"])

        for batch in batches:
            k = np.stack([batch.column(c).to_numpy() for c in ("bucket", "low", "high")], 1)
            cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1), len(k)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                now = tuple(int(x) for x in k[a])
                if key is not None and now != key:
                    yield from flush()
                key = now
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush()

    return run


def linked(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links and component_id of every row of (vec_id, embedding)."""
    single = vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull)
    given = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    scan = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), given.alias("v"))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scan = scan.withColumn("dim", F.when(sound & F.exists("v", lambda x: x != 0), F.size("v")))
    # equal directions, known by two hashes: one representative; copies that the hashes miss link as neighbours
    wide = F.transform("v", lambda x: x.cast("double"))
    rows = scan.withColumn("v", F.when(F.col("dim").isNotNull(), wide)).withColumn("top", F.array_max(F.transform("v", F.abs)))
    rows = rows.withColumn("v", F.transform("v", lambda x: x / F.col("top")))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).withColumn("unit", F.transform("v", lambda x: x / F.col("norm")))
    rows = common.stored(rows.select("uid", "vec_id", "dim", F.xxhash64("unit").alias("h1"), F.xxhash64(F.lit(1), "unit").alias("h2")), "op9-rows")
    group = ["dim", "h1", "h2"]
    alike = rows.where("dim is not null").groupBy(group).agg(F.min("uid").alias("rep"), F.count("*").alias("n")).where("n > 1")
    alike = common.stored(alike, "op9-alike")
    copies = common.stored(rows.join(alike, group).select("uid", "rep", "n"), "op9-copies")
    more = dict(alike.groupBy("dim").agg(F.sum(F.col("n") - 1)).collect())
    # vectors of different lengths never link: each length is a search of its own
    sizes = rows.where("dim is not null").groupBy("dim").count().collect()
    out = rows.sparkSession.createDataFrame([], LINKS)
    for dim, size in sorted(sizes):
        for part in _search(scan.where(F.col("dim") == dim).select("uid", "v"), copies, dim, size - more.get(dim, 0), single, threshold):
            out = out.union(part)
    total = out.where("other < 0").groupBy("rep").agg(F.sum("links").alias("links"))
    comps = common.connected(out.where("other >= 0").select(F.col("rep").alias("a"), F.col("other").alias("b")), "op9").withColumnRenamed("node", "rep")
    known = rows.select("uid", "vec_id").join(copies, "uid", "left").withColumn("rep", F.coalesce("rep", "uid"))
    known = known.join(total, "rep", "left").join(comps, "rep", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1
    named = common.stored(known.select("vec_id", n_links.cast("long").alias("n_links"), F.coalesce("component", "rep").alias("comp")), "op9-named")
    names = common.stored(named.groupBy("comp").agg(F.min("vec_id").alias("component_id")), "op9-names")
    return named.join(names, "comp").select("vec_id", "n_links", "component_id")


def rounds(rows: int, vectors: int, vector_bytes: int) -> int:
    """Rounds in which ``rows`` shuffled rows are dealt out, for a table of ``vectors``."""
    return max(1, int(np.ceil(rows * (vector_bytes + BESIDE) / max(ROUND_LEAST, ROUND_SHARE * vectors * vector_bytes))))


def _search(rows: DataFrame, copies: DataFrame, dim: int, count: int, single: bool, threshold: float, bits: int = 1 << 24) -> list[DataFrame]:
    """Rows LINKS of all rounds; ``rows`` (uid, v) of one length, of which those in ``copies`` under another's name stay out."""
    spark = rows.sparkSession
    code = Code(dim, count)
    vector_bytes = dim * (4 if single else 8)
    each = min(BLOCK_ROWS, max(64, BLOCK_BYTES // (8 * dim + 8 * FILTERS * code.blocks)))
    depth = code.depth(each, count)
    # only rows that a Bloom filter of the copies may hold are shuffled to find their representative
    marked = common._marked(rows, common._members(copies, "uid", bits), "uid", bits, "left")
    asked = marked.where("__maybe").join(copies, "uid", "left").where("rep is null or rep = uid").select(F.col("uid").alias("rep"), F.coalesce("n", F.lit(1)).cast("long").alias("n"), "v")
    alone = marked.where("not __maybe").select(F.col("uid").alias("rep"), F.lit(1).cast("long").alias("n"), "v")
    kind = "int" if code.m**depth < 1 << 31 else "long"
    lists = alone.union(asked).mapInArrow(decoder(dim, count, depth), f"rep long, n long, vec binary, prefixes array<{kind}>")
    lists = common.stored(lists, "op9-filters", WIDE_ROWS)
    entries = lists.select("rep", "n", "vec", F.explode("prefixes").alias("bucket")).withColumn("bucket", F.col("bucket").cast("long"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("size")).withColumn("chunks", F.ceil(F.col("size") / each).cast("int"))
    sizes = common.stored(sizes, "op9-sizes")
    shipped, most = sizes.agg(F.sum(F.col("size") * F.col("chunks")), F.max("chunks")).first()
    turns = rounds(shipped or 0, count, vector_bytes)
    parts = common.wide_enough(spark, -(-(shipped or 0) // turns), max(1, PART_BYTES // (vector_bytes + BESIDE)))
    out = []
    for turn in range(turns):
        if most == 1:
            now = entries.where(F.pmod("bucket", F.lit(turns)) == turn).select("bucket", *[F.lit(0).alias(x) for x in ("low", "high", "chunk")], "rep", "n", "vec")
        else:
            # members of a large bucket are dealt to chunks by a hash; each pair of chunks is compared once
            cut = sizes.where("chunks > 1").select("bucket", "chunks")
            now = entries.join(cut, "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
            now = now.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            now = now.select("bucket", F.least("chunk", "with").alias("low"), F.greatest("chunk", "with").alias("high"), "chunk", "rep", "n", "vec")
            now = now.where(F.pmod(F.col("bucket") + F.col("low") + F.col("high"), F.lit(turns)) == turn)
        dealt = now.repartition(parts, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
        run = comparer(dim, count, depth, "float32" if single else "float64", threshold, STRIP)
        out.append(common.stored(dealt.mapInArrow(run, LINKS), "op9-links", WIDE_ROWS))
        del now, dealt
    return out


def report(vectors: DataFrame) -> DataFrame:
    return linked(vectors).withColumn("kept", F.col("vec_id") == F.col("component_id"))

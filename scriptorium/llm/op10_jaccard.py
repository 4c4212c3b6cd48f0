"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

Sizes fall into bands a factor 1 / threshold wide, so linked sets lie in one band or in neighbouring
ones.  Two sets of sizes up to ``high`` that link differ in at most ``k = 2 (high - 1) (1 - t) / (1 + t)``
elements, so when the hash range is cut into more than k segments, one segment at least holds the same
elements in both: a document's tile keys are the (band, segment, hash of the segment's elements), under
its own band and, as a guest, under the next.  Documents that share a tile are candidates, and none of
the linked pairs is missed.  Empty segments are no keys: a document with few of them has a non-empty
common segment with every partner by count, and the rare others add keys for their empty segments.

Within a tile a pair meets the size test, then the bitmap bound: of hashed bitmap signatures of both sets
(a power of two of bits; a longer one is folded to a shorter one's length) the differing bits are no more
than the differing elements, so the common count is bounded from above by (|A| + |B| - differing bits) / 2.
A tile's members first meet at about COARSE bits an element; those that have a possible partner meet
again at SHARP bits an element, where hardly a pair passes that doesn't link.  Those that still have one
meet as whole sets, and the pairs that pass are intersected exactly as sorted arrays.

Sets that are equal collapse to one representative first.  A tile first links its members to one member,
in each slice of the scan to the slice's first, and the slices' firsts to the least of them, so a tile
that a third of all rows share is met as one row a slice.  Once these verified links have joined
components, and once more after stars from another member, a tile is searched for pairs whose ends lie in
different components.  Only members leave a tile, and in the end the links that join its components: the pairs
themselves, as many as the square of a group of near copies, never do.  Tiles with more rows or bytes than a chunk are cut into chunks by a hash, and each
pair of chunks is a group of its own.

Defined cases: null and word-less texts have empty sets and link with nothing; fewer words than a
shingle give one shingle of all of them; repeated rows share a doc_id's class; an empty table gives an
empty result; only doc_id and text are read.  The input should be a table's scan, whose rows come in the
same partitions whenever they are read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

N, THRESHOLD = 5, Fraction(4, 5)
#: Further members of each open tile that its others are compared with before all remaining pairs are.
STARS = 1
#: Bits of the shortest signature, and at least this many an element (a power of two more at most).
BITS, COARSE, SHARP = 256, 1.5, 8.0
#: Rows and signature bytes of a tile that are compared at once.
CHUNK_ROWS, CHUNK_BYTES = 2048, 8 << 20
ROWS_EACH = 1_000_000
#: Rows of a part that go back to the JVM at once.
SENT_ROWS = 100_000
#: Bytes of text whose sets are built at once.
SLICE = 1 << 20
#: Rows with texts or signatures that go to Python at once.
WIDE_ROWS = 1000
#: Half the bits an element of a whole set (signatures have up to twice the bits that are asked for).
EXACT = 32.0
SETS = "uid long, doc_id long, n_shingles long, f1 long, f2 long, coarse binary, sharp binary"
ENTRY = "key long, uid long, pivot long"


def shingle_sets(text: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """All documents' distinct shingle hashes, sorted within each, and the n + 1 offsets."""
    data, offsets = common.text_bytes(text)
    starts, ends, doc = common.words_of(data, offsets)
    word = common.mix(common.span_hash(common.prefix_hash(common.lowered(data)), starts, ends))
    docs = len(offsets) - 1
    count = np.bincount(doc, minlength=docs)
    first = np.concatenate([[0], np.cumsum(count)])
    # shingle i starts at word i; a document of fewer than n words has one, of all of them
    rolled = np.zeros(len(word), np.uint64)
    inside = first[doc + 1] - np.arange(len(word))
    short = count < n
    for j in range(n):
        part = np.zeros(len(word), np.uint64)
        part[: len(word) - j] = word[j:]
        rolled += np.where(inside > j, part, np.uint64(0)) * np.uint64(pow(0x9E3779B97F4A7C15, j, 1 << 64))
    rolled = common.mix(rolled ^ np.minimum(inside, n).astype(np.uint64))
    keep = (inside >= n) | (short[doc] & (np.arange(len(word)) == first[doc]))
    rolled, doc = rolled[keep], doc[keep]
    ends = np.cumsum(np.bincount(doc, minlength=docs))
    for start, end in zip(ends - np.diff(ends, prepend=0), ends, strict=True):
        rolled[start:end].sort()
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (rolled[1:] != rolled[:-1])
    rolled, doc = rolled[new], doc[new]
    return rolled, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=docs))])


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64), pa.int64())


def signature(elements: np.ndarray, each: float) -> bytes:
    """A bitmap of the elements' low bits; its length is the power of two from ``each`` to twice that many bits an element."""
    width = max(BITS, 1 << int(np.ceil(np.log2(max(1.0, each * len(elements))))))
    bits = np.zeros(width, bool)
    bits[(elements & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """Signatures (in the last axis) at a shorter length: those that the same sets have there."""
    while bitmap.shape[-1] > words:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] | bitmap[..., half:]
    return bitmap


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, doc_id, text -> the set's size, 128-bit fingerprint and bitmaps."""
    for batch in common.slices(batches, "text", SLICE):
        sets, offsets = shingle_sets(batch.column(2))
        size = np.diff(offsets)
        packed = [pa.array([signature(sets[i:j], each) for i, j in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()) for each in (COARSE, SHARP)]
        f1, f2 = _sums(common.mix(sets), offsets), _sums(common.mix(sets ^ np.uint64(0x5851F42D4C957F2D)), offsets)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(size, pa.int64()), _long(f1), _long(f2), *packed], names=[x.split()[0] for x in SETS.split(", ")])


class Bands:
    """Lower ends of the size bands, and each band's number of segments and of spare ones."""

    def __init__(self, threshold: Fraction, most: int):
        low = [1]
        while low[-1] <= most:
            low.append(max(low[-1] + 1, -(-low[-1] * threshold.denominator // threshold.numerator)))
        low.append(max(low[-1] + 1, -(-low[-1] * threshold.denominator // threshold.numerator)))
        self.low = np.array(low)
        gap = (1 - threshold) / (1 + threshold)
        self.k = np.array([int(2 * (high - 1) * gap) for high in low[1:]])
        self.spare = 1 + self.k // 20
        self.segments = self.k + self.spare

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, "right") - 1


def tile_keys(sets: np.ndarray, offsets: np.ndarray, bands: Bands, up: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, document) for every key of the documents under their own band (up 0) or the next (up 1)."""
    size = np.diff(offsets)
    docs = np.flatnonzero(size)
    band = bands.of(size[docs]) + up
    segments = bands.segments[band]
    per = np.zeros(len(size), np.int64)
    per[docs] = segments
    base = np.concatenate([[0], np.cumsum(per)])
    owner = np.repeat(np.arange(len(size)), size)
    slot = ((sets >> np.uint64(32)) * per[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    place = base[owner] + slot
    # elements of one segment are neighbours: they are sorted by hash, and segments are ranges of it
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else place
    filled = place[first]
    content = np.add.reduceat(common.mix(sets + np.uint64(0x632BE59BD9B4E019)), first) if len(first) else np.zeros(0, np.uint64)
    whose = np.repeat(np.arange(len(size)), per)
    tag = np.zeros(len(size), np.uint64)
    tag[docs] = band.astype(np.uint64) << np.uint64(32)
    index = np.arange(base[-1]) - base[whose]
    salt = common.mix((tag[whose] | index.astype(np.uint64)) ^ np.uint64(0xD6E8FEB86659FD93))
    value = np.zeros(base[-1], np.uint64)
    value[filled] = content
    used = np.zeros(base[-1], bool)
    used[filled] = True
    empty = np.bincount(whose[~used], minlength=len(size))
    spare = np.zeros(len(size), np.int64)
    spare[docs] = bands.spare[band]
    # k segments at most differ; with fewer empty ones than spare some common segment is not empty
    used |= (empty >= spare)[whose]
    return common.mix(value + salt)[used], whose[used]


def entries(bands: Bands):
    """uid, text -> rows (key, uid, pivot); equal sets of a slice are entered once, for their smallest uid.

    Of the documents of a slice that share a key only the first meets other slices (pivot null); all of
    them are joined to it by rows that need meet no others.
    """

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", SLICE):
            sets, offsets = shingle_sets(batch.column(1))
            uid = batch.column(0).to_numpy()
            size = np.diff(offsets)
            prints = np.stack([_sums(common.mix(sets), offsets), _sums(common.mix(sets ^ np.uint64(0x5851F42D4C957F2D)), offsets), size.astype(np.uint64)], 1)
            order = np.argsort(uid, kind="stable")
            _, first = np.unique(prints[order], axis=0, return_index=True)
            keep = np.zeros(len(size), bool)
            keep[order[first]] = True
            found = [tile_keys(sets, offsets, bands, up) for up in (0, 1)]
            key, doc = (np.concatenate(x) for x in zip(*found, strict=True))
            key, doc = key[keep[doc]], doc[keep[doc]]
            order = np.argsort(key, kind="stable")
            key, who = key[order], uid[doc[order]]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            yield pa.record_batch([_long(key[start]), pa.array(who[start], pa.int64()), pa.nulls(len(start), pa.int64())], names=["key", "uid", "pivot"])
            times = np.diff(np.append(start, len(key)))
            joined = np.repeat(times > 1, times)
            yield pa.record_batch([_long(key[joined]), pa.array(who[joined], pa.int64()), pa.array(np.repeat(who[start], times)[joined], pa.int64())], names=["key", "uid", "pivot"])

    return enter


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's entries -> those whose key another one has too, with the key's least uid as pivot; joined rows as they are.

    A part has about ROWS_EACH entries, however many rows share a key: they come as one entry a slice.
    """
    keys, uids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        alone = batch.column(2).is_null()
        yield batch.filter(pc.invert(alone))
        part = batch.filter(alone)
        keys.append(part.column(0).to_numpy())
        uids.append(part.column(1).to_numpy())
    key, uid = np.concatenate(keys), np.concatenate(uids)
    keys.clear()
    uids.clear()
    order = np.argsort(key)
    key, uid = key[order], uid[order]
    del order
    if not len(key):
        return
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(start, len(key)))
    met = np.repeat(times > 1, times)
    pivot = np.repeat(np.minimum.reduceat(uid, start)[times > 1], times[times > 1])
    key, uid = key[met], uid[met]
    for k in range(0, len(key), SENT_ROWS):
        yield pa.record_batch([pa.array(x[k : k + SENT_ROWS]) for x in (key, uid, pivot)], names=["key", "uid", "pivot"])


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum()) if len(a) else 0


def may_link(size_a, size_b, apart, threshold: Fraction) -> np.ndarray:
    """Pairs that sizes and differing bits do not rule out: common <= (|A| + |B| - differing bits) / 2."""
    p, q = threshold.numerator, threshold.denominator
    most = (size_a + size_b - apart) // 2
    return (np.minimum(size_a, size_b) * q >= p * np.maximum(size_a, size_b)) & (q * most >= p * (size_a + size_b - most))


def differing(column: pa.Array, i: np.ndarray, j: np.ndarray, most: int = 8 << 20) -> np.ndarray:
    """Differing bits of the signatures i and j of a column, pair by pair, at the shorter one's length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, offsets = common.text_bytes(column)
    words, at = np.diff(offsets) // 8, offsets[:-1] // 8
    data = data[: len(data) // 8 * 8].view(np.uint64)
    out = np.zeros(len(i), np.int64)
    short, long_ = np.minimum(words[i], words[j]), np.maximum(words[i], words[j])
    shape = short << 32 | long_
    for kind in np.unique(shape):
        low, high = int(kind >> 32), int(kind & 0xFFFFFFFF)
        which = np.flatnonzero(shape == kind)
        step = max(1, most // (8 * (low + high)))
        for part in np.split(which, range(step, len(which), step)):
            a, b = i[part], j[part]
            swap = words[a] > words[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            x = data[at[a][:, None] + np.arange(low)]
            y = folded(data[at[b][:, None] + np.arange(high)], low)
            out[part] = np.bitwise_count(x ^ y).sum(1)
    return out


def group_pairs(last: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of rows of one group, in pieces; ``last`` is the end of each row's group."""
    count = last - np.arange(len(last)) - 1
    total = np.cumsum(count)
    start = 0
    while start < len(last):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + most, "right")))
        n = count[start:end]
        i = np.repeat(np.arange(start, end), n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        start = end


TILE = "key long, low int, high int, chunk int, rep long, comp long, n_shingles long, bits binary"


def possible(part: pa.Table, bits: pa.Array, last: np.ndarray, threshold: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group (TILE; ``last`` is the end of each row's group) in different components that sizes and
    the signatures ``bits`` do not rule out, in pieces.

    In a group of two chunks only pairs between them count.
    """
    chunk, comp, size, low, high = (part.column(c).to_numpy() for c in ("chunk", "comp", "n_shingles", "low", "high"))
    p, q = threshold.numerator, threshold.denominator
    for i, j in group_pairs(last):
        ok = (comp[i] != comp[j]) & ((low[i] == high[i]) | (chunk[i] != chunk[j]))
        ok &= np.minimum(size[i], size[j]) * q >= p * np.maximum(size[i], size[j])
        i, j = i[ok], j[ok]
        ok = may_link(size[i], size[j], differing(bits, i, j), threshold)
        yield i[ok], j[ok]


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups (key, low, high) of sorted rows TILE, and the end of each row's group; chunks bound what is held."""
    held: list[pa.RecordBatch] = []
    for batch in (b for whole in batches for b in common.slices(iter([whole]), "bits", CHUNK_BYTES)):
        held.append(batch)
        part = pa.Table.from_batches(held).combine_chunks()
        k = np.stack([part.column(c).to_numpy() for c in ("key", "low", "high")], 1)
        cut = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        if len(cut):
            # the last group may go on in the next batch
            last = np.repeat(cut, np.diff(cut, prepend=0))
            yield part.slice(0, cut[-1]), last
            held = part.slice(cut[-1]).to_batches()
    if held:
        part = pa.Table.from_batches(held).combine_chunks()
        yield part, np.full(part.num_rows, part.num_rows)


def across(threshold: Fraction):
    """Sorted groups of TILE with signatures -> the members (key, rep) that have a possible partner in another component."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, last in groups(batches):
            found = [np.unique(np.append(i, j)) for i, j in possible(part, part.column("bits"), last, threshold)]
            rows = np.unique(np.concatenate(found))
            key, rep = part.column("key").to_numpy(), part.column("rep").to_numpy()
            yield pa.record_batch([pa.array(key[rows], pa.int64()), pa.array(rep[rows], pa.int64())], names=["key", "rep"])

    return search


def joining(threshold: Fraction):
    """Sorted groups of TILE with whole sets -> links (a, b) that join all components which links of a group join.

    A pair whose components are joined by links given before needs no test and is not given, so a task gives fewer
    links than it has components, however many pairs link.
    """
    p, q = threshold.numerator, threshold.denominator

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = above.get(up, up)
                x = up
            return x

        for part, last in groups(batches):
            data, offsets = common.text_bytes(part.column("bits"))
            sets = [data[i:j].view(np.uint64) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            sharp = pa.array([signature(x, SHARP) for x in sets], pa.binary())
            rep, comp = part.column("rep").to_numpy(), part.column("comp").to_pylist()
            found = []
            for pieces in possible(part, sharp, last, threshold):
                for i, j in zip(*(x.tolist() for x in pieces), strict=True):
                    u, v = root(comp[i]), root(comp[j])
                    if u != v:
                        n = common_count(sets[i], sets[j])
                        if q * n >= p * (len(sets[i]) + len(sets[j]) - n):
                            above[u] = v
                            found.append((i, j))
            i, j = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.record_batch([pa.array(f(rep[i], rep[j]), pa.int64()) for f in (np.minimum, np.maximum)], names=["a", "b"])

    return search


def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, text -> uid and the set's sorted hashes as bytes."""
    for batch in common.slices(batches, "text", SLICE):
        sets, offsets = shingle_sets(batch.column(1))
        packed = [sets[i:j].tobytes() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.record_batch([batch.column(0), pa.array(packed, pa.binary())], names=["rep", "bits"])


def distinct_tiles(rows: DataFrame, least: int) -> DataFrame:
    """Rows (key, rep, ...) of one tile for each set of members (by its size and two hashes), of tiles with ``least`` members or more.

    Long alike documents share hundreds of tiles; what one of them shows, the others show too.
    """
    sets = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("s2"))
    one = sets.where(F.col("n") >= least).groupBy("n", "s1", "s2").agg(F.min("key").alias("key"))
    return rows.join(one.select("key"), "key", "left_semi")


def dealt(rows: DataFrame, bits: DataFrame, each: float, parts: int) -> DataFrame:
    """Rows (key, rep, comp, n) of tiles, as sorted groups of TILE: large tiles cut into chunks, each pair of chunks a group.

    Tiles are dealt out before the signatures ``bits`` (rep, bits), of ``each`` bits an element, come to them.
    """
    size = F.greatest(F.lit(BITS / 8), F.col("n") * (each / 4))
    size = rows.groupBy("key").agg(F.count("*").alias("members"), F.sum(size).alias("bytes"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    size = common.stored(size, "op10-sizes")
    chunks = F.greatest(F.ceil(F.col("members") / CHUNK_ROWS), F.ceil(F.col("bytes") / CHUNK_BYTES)).cast("int")
    rows = rows.join(size.select("key", chunks.alias("chunks")), "key").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("key", F.least("chunk", "with").alias("low"), F.greatest("chunk", "with").alias("high"), "chunk", "rep", "comp", F.col("n").alias("n_shingles"))
    return rows.join(bits, "rep").select([x.split()[0] for x in TILE.split(", ")]).repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high")


def checker(threshold: Fraction):
    """Rows (a, b, text_a, text_b) -> the pairs that link, by exact intersection of their sorted sets."""
    p, q = threshold.numerator, threshold.denominator

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(iter([whole]), "text_b", 1 << 20):
                x, of_x = shingle_sets(batch.column(2))
                y, of_y = shingle_sets(batch.column(3))
                ok = np.zeros(batch.num_rows, bool)
                for i in range(batch.num_rows):
                    left, right = x[of_x[i] : of_x[i + 1]], y[of_y[i] : of_y[i + 1]]
                    n = common_count(left, right)
                    ok[i] = q * n >= p * (len(left) + len(right) - n)
                yield batch.select([0, 1]).filter(pa.array(ok))

    return check


def verified(pairs: DataFrame, texts: DataFrame, known: DataFrame, threshold: Fraction, name: str) -> DataFrame:
    """The distinct candidate pairs (a < b) that link; a pair meets its coarse bitmaps in ``known`` first, then its sets."""
    side = lambda x: known.select(F.col("uid").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("coarse").alias(f"bits_{x}"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(iter([whole]), "bits_b"):
                n = np.arange(batch.num_rows)
                bits = pa.concat_arrays([batch.column("bits_a").cast(pa.large_binary()), batch.column("bits_b").cast(pa.large_binary())])
                ok = may_link(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), differing(bits, n, n + len(n)), threshold)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    left = pairs.distinct().join(side("a"), "a").join(side("b"), "b").mapInArrow(common.lean(bound), "a long, b long")
    left = common.stored(left, f"{name}-bounded", WIDE_ROWS)
    of = lambda x: common.among(texts, left.select(F.col(x).alias("uid")), "uid").select(F.col("uid").alias(x), F.col("text").alias(f"text_{x}"))
    both = left.join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(common.lean(checker(threshold)), "a long, b long")


def classes(docs: DataFrame, n: int = N, threshold: Fraction = THRESHOLD) -> DataFrame:
    """uid, doc_id, n_shingles, component_id for every row."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    facts = common.stored(texts.mapInArrow(common.lean(measure), SETS), "op10-sets", WIDE_ROWS)
    total = facts.agg(F.max("n_shingles"), F.sum("n_shingles")).first()
    bands = Bands(threshold, int(total[0] or 0))
    # equal sets: one representative
    group = ["n_shingles", "f1", "f2"]
    real = facts.where("n_shingles > 0")
    reps = common.stored(real.groupBy(group).agg(F.min("uid").alias("rep")), "op10-reps")
    member = common.stored(real.select("uid", "doc_id", *group).join(reps, group).select("uid", "doc_id", "rep", "n_shingles"), "op10-members")
    known = facts.where("n_shingles > 0").select("uid", "n_shingles", "coarse", "sharp")
    # tiles
    parts = common.wide_enough(spark, int(0.6 * (total[1] or 0)), ROWS_EACH)
    plain = texts.select("uid", "text")
    entered = plain.mapInArrow(common.lean(entries(bands)), ENTRY).repartition(parts, F.expr("if(pivot is null, key, xxhash64(key, uid))"))
    tiles = common.stored(entered.mapInArrow(common.lean(shared), ENTRY), "op10-tiles", 4 * WIDE_ROWS)
    # stars: every member with its tile's first
    rep_of = lambda x: member.select(F.col("uid").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    stars = tiles.where("uid <> pivot").select("uid", "pivot").distinct().join(rep_of("uid"), "uid").join(rep_of("pivot"), "pivot").where("rep_uid <> rep_pivot")
    stars = common.stored(stars, "op10-stars")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    alike = stars.where(F.least("n_uid", "n_pivot") * threshold.denominator >= F.greatest("n_uid", "n_pivot") * threshold.numerator)
    links = common.stored(verified(alike.select(*pair("rep_uid", "rep_pivot")), plain, known, threshold, "op10-star"), "op10-links", WIDE_ROWS)
    linked = common.stored(common.connected(links, "op10-star"), "op10-comps")
    comp_of = lambda x, comps: comps.select(F.col("node").alias(x), F.col("component").alias(f"comp_{x}"))
    # the tiles that still hold several components are those with a star pair across components
    apart = stars.join(comp_of("rep_uid", linked), "rep_uid", "left").join(comp_of("rep_pivot", linked), "rep_pivot", "left")
    apart = apart.where(F.coalesce("comp_rep_uid", "rep_uid") != F.coalesce("comp_rep_pivot", "rep_pivot")).select("uid", "pivot")
    keys = common.stored(tiles.join(apart, ["uid", "pivot"], "left_semi").select("key").distinct(), "op10-open")
    held = tiles.select("key", "uid").join(keys, "key", "left_semi").join(rep_of("uid"), "uid").select("key", F.col("rep_uid").alias("rep"), F.col("n_uid").alias("n")).distinct()
    # of two members one star has said all
    held = common.stored(distinct_tiles(common.stored(held, "op10-placed"), 3), "op10-held")
    # more stars, each from another member of a tile, join what one member of it doesn't link with
    for turn in range(STARS):
        placed = held.join(comp_of("rep", linked), "rep", "left").withColumn("comp", F.coalesce("comp_rep", "rep"))
        chosen = F.struct(F.xxhash64(F.lit(turn), "rep").alias("h"), F.col("rep").alias("pivot"), F.col("n").alias("n_pivot"), F.col("comp").alias("comp_pivot"))
        pivots = common.stored(placed.groupBy("key").agg(F.min(chosen).alias("p")).select("key", "p.*"), "op10-pivots")
        more = placed.join(pivots, "key").where("comp <> comp_pivot")
        more = more.where(F.least("n", "n_pivot") * threshold.denominator >= F.greatest("n", "n_pivot") * threshold.numerator).select(*pair("rep", "pivot"))
        links = common.stored(links.union(verified(more, plain, known, threshold, "op10-star")), "op10-links", WIDE_ROWS)
        linked = common.stored(common.connected(links, "op10-star"), "op10-comps")
    # members with a partner that is left in another component of a tile: first by coarse bitmaps, then by sharp ones
    open_ = common.stored(held.join(comp_of("rep", linked), "rep", "left").select("key", "rep", F.coalesce("comp_rep", "rep").alias("comp"), "n"), "op10-open")
    near = open_
    for column, each in (("coarse", COARSE), ("sharp", SHARP)):
        bits = known.select(F.col("uid").alias("rep"), F.col(column).alias("bits"))
        near = dealt(near, bits, each, parts).mapInArrow(common.lean(across(threshold)), "key long, rep long")
        near = common.stored(near.distinct().join(open_, ["key", "rep"]), "op10-near", WIDE_ROWS)
        near = distinct_tiles(near, 2)
    # their whole sets give the links that join components
    near = common.stored(near, "op10-last")
    bits = common.among(plain, near.select(F.col("rep").alias("uid")), "uid").mapInArrow(common.lean(whole_sets), "rep long, bits binary")
    rest = dealt(near, bits, EXACT, parts).mapInArrow(common.lean(joining(threshold)), "a long, b long")
    rest = common.stored(rest.distinct(), "op10-rest", WIDE_ROWS)
    all_links = common.stored(links.union(rest), "op10-links")
    comps = common.connected(all_links, "op10-all")
    # back to documents: a component is named by its smallest doc_id
    found = member.join(comps.select(F.col("node").alias("rep"), F.col("component").alias("comp")), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    found = common.stored(found.select("uid", "doc_id", "comp"), "op10-found")
    name = found.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("first"))
    name = common.stored(name.select("comp", "component_id", F.col("first.uid").alias("first")), "op10-names")
    named = found.join(name, "comp").select("uid", "component_id", (F.col("first") == F.col("uid")).alias("kept"))
    out = facts.select("uid", "doc_id", "n_shingles").join(named, "uid", "left")
    return out.select("uid", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("kept", F.lit(True)).alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "n_shingles", "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns; documents without words stay."""
    return common.without(docs, classes(docs).where("not kept").select("uid"))

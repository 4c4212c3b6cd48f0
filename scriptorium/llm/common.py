"""Helpers that the operators of this subpackage share: inputs, shared tables, vectorised hashing."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: space and the controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where the session names none and is local itself."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    return (found or "/tmp/checkpoints/scriptorium").rstrip("/")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: later jobs reread it instead of recomputing it.

    While it is written, Python workers get ``rows`` rows at once at most, as suits the rows' width.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(ARROW_ROWS)
    if rows:
        spark.conf.set(ARROW_ROWS, str(rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files of finished jobs now: it waits for the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: By operator, what makes a worker forget what that operator remembers between tasks.
memories: dict[str, Callable[[], None]] = {}


def _trim() -> None:
    """Gives freed memory back to the system, which the allocators of Arrow and C else keep for the worker's next task."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def lean(run: Callable, of: str = "") -> Callable:
    """A function for mapInArrow, in workers that hold no more than they need.

    Workers outlive stages: what operators other than ``of`` remember is forgotten first, and freed memory is given back
    after each task, so that a stage without Python, or an idle worker, leaves the machine's memory to the JVM.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, forget in memories.items():
            if name != of:
                forget()
        try:
            yield from run(batches)
        finally:
            _trim()

    return whole


def _members(ids: DataFrame, column: str, bits: int) -> DataFrame:
    """The Bloom filter of one hash of ``ids``, as words of 64 bits; it has at most bits / 64 rows."""
    place = ids.select(F.pmod(F.xxhash64(column), F.lit(bits)).alias("__place"))
    words = place.select(F.shiftright("__place", 6).alias("__word"), F.expr("shiftleft(1L, cast(__place & 63 as int))").alias("__bit"))
    return stored(words.groupBy("__word").agg(F.bit_or("__bit").alias("__bits")).coalesce(8), "members")


def _marked(rows: DataFrame, words: DataFrame, column: str, bits: int, how: str) -> DataFrame:
    """``rows`` with __maybe: whether the filter may hold their id; an inner join leaves most of the others out at once."""
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    out = rows.withColumn("__place", place).withColumn("__word", F.shiftright("__place", 6)).join(F.broadcast(words), "__word", how)
    hit = F.coalesce(F.expr("(shiftright(__bits, cast(__place & 63 as int)) & 1) = 1"), F.lit(False))
    return out.select(*rows.columns, hit.alias("__maybe"))


def among(rows: DataFrame, ids: DataFrame, column: str, bits: int = 1 << 24) -> DataFrame:
    """Rows whose id may be among ``ids``: a Bloom filter of one hash, of ``bits`` bits whatever the input's size.

    The broadcast side has at most bits / 64 rows.  It only saves shuffling: the join that follows drops the rows
    let through by chance.
    """
    return _marked(rows, _members(ids, column, bits), column, bits, "inner").where("__maybe").drop("__maybe")


def without(docs: DataFrame, drop: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """``docs`` without the rows whose number in the scan (monotonically_increasing_id) is among the column uid of ``drop``.

    Only rows that a Bloom filter of ``drop`` may hold are shuffled; the others stay where they are read.
    """
    drop = stored(drop.select(F.col("uid").alias("__uid")), "dropped")
    rows = _marked(docs.withColumn("__uid", F.monotonically_increasing_id()), _members(drop, "__uid", bits), "__uid", bits, "left")
    asked = rows.where("__maybe").join(drop, "__uid", "left_anti")
    return rows.where("not __maybe").select(docs.columns).union(asked.select(docs.columns))


def wide_enough(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions so that each holds about ``rows_each`` rows, no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def salt(column, n: int):
    """A reproducible bucket in [0, n) of a column."""
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(kind: str, n: int) -> np.ndarray:
    """BASE ** 0 .. BASE ** (n-1) modulo 2**64, or those of its inverse; kept between batches."""
    got = _powers.get(kind)
    if got is None or len(got) < n:
        step = BASE if kind == "up" else BASE_INVERSE
        got = np.full(max(n, 1 << 16), step, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _powers[kind] = got
    return got[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i] the polynomial hash of data[:i]; len(data) + 1 entries."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers("up", len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for every pair, the same wherever the bytes stand."""
    return (prefix[end] - prefix[start]) * powers("down", len(prefix))[start]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of an Arrow column in one array, and the n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``most`` bytes of text; one row is never cut."""
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column) if at is None else at
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every run of bytes outside SPACES; a run never crosses documents."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = letter[inner]
    last[inner - 1] = letter[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def connected(edges: DataFrame, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of an edge the smallest node that links reach.

    Alternating large-star and small-star rounds, each written to the shared folder, so the number of
    rounds grows with the logarithm of a chain's length and lineage stays short.  A hub's neighbours
    meet only as partial minima and in joins that can be split.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), f"{name}-edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
    state = mark(now)
    while True:
        # large star: larger neighbours, and the node, point to the smallest neighbour
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours, and the node, point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = stored(small.where("u <> v").distinct(), f"{name}-edges")
        before, state = state, mark(now)
        if state == before:
            break
    star = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return star.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Exact dedup: a tree merge of sorted digest runs.

Every row is reduced to a digest of its normalised text.  Each of fan ** rounds parts sorts its digests
into a run with one entry a digest.  In every binomial round the parts of a group that differ in one
digit of their number exchange pieces of their runs: an entry moves to the member whose digit is the
digest's, and each member merges the sorted runs it receives, verifying that equal digests carry equal
lengths and equal second hashes and keeping the best row.  After the last round every digest lives in
one part.  A digest that a third of all rows share arrives as one entry a part in round one and as one
entry a group later; no task ever sees its rows together.

Defined cases: null text is empty; empty texts equal each other and white-space-only ones; ties go to
the longest original text, then the smallest doc_id (null last), then one of the repeated rows; an
empty table gives an empty result; columns other than doc_id and text are neither read nor needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Parts that exchange in one round at least and at most, and rows that a part starts with about.
FAN, MOST_FAN, PART_ROWS = 8, 32, 2_000_000
RUN = "part int, digest binary, n_bytes long, check long, n_chars long, doc_id long, uid long, n long"


def digests(docs: DataFrame) -> DataFrame:
    """One small row a document: the digest of its text without white space, a second hash, lengths."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.translate(text, common.SPACES, "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), bare.alias("bare"))
    return rows.select(
        "doc_id", "n_chars", F.unhex(F.sha2("bare", 256)).alias("digest"), F.octet_length("bare").cast("long").alias("n_bytes"),
        F.xxhash64("bare").alias("check"), F.monotonically_increasing_id().alias("uid"), F.lit(1).cast("long").alias("n"),
    )


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each digest of rows sorted by digest, best row first; a digest may span batches."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch.select(held.schema.names).cast(held.schema)]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        digest = np.frombuffer(batch.column("digest").cast(pa.binary(32)).buffers()[1], "V32", batch.num_rows, batch.column("digest").cast(pa.binary(32)).offset * 32)
        new = np.ones(len(digest), bool)
        words = digest.view(np.uint64).reshape(-1, 4)
        new[1:] = (words[1:] != words[:-1]).any(1)
        for name in ("n_bytes", "check"):
            values = batch.column(name).to_numpy()
            if (values[1:] != values[:-1])[~new[1:]].any():
                raise ValueError("two different texts share a digest")
        starts = np.flatnonzero(new)
        out = batch.take(pa.array(starts))
        n = np.add.reduceat(batch.column("n").to_numpy(), starts)
        out = out.set_column(out.schema.get_field_index("n"), "n", pa.array(n, pa.int64()))
        if len(starts) > 1:
            yield out.slice(0, len(starts) - 1)
        held = out.slice(len(starts) - 1)
    if held is not None:
        yield held


def exchange(runs: DataFrame, dest, parts: int) -> DataFrame:
    """Rows sent to the part ``dest``, their sorted runs merged there."""
    names = [x.split()[0] for x in RUN.split(", ")]
    sent = runs.withColumn("part", dest).select(names).repartitionById(parts, "part")
    order = ["part", "digest", F.desc("n_chars"), F.asc_nulls_last("doc_id"), "uid"]
    return sent.sortWithinPartitions(*order).mapInArrow(common.lean(merge), RUN)


def tree(rows: int) -> tuple[int, int]:
    """Rounds, and parts that exchange in one: few rounds of many rather than the reverse, as every round moves all runs."""
    parts = max(FAN**2, -(-rows // PART_ROWS))
    rounds = 2
    while MOST_FAN**rounds < parts:
        rounds += 1
    fan = FAN
    while fan**rounds < parts:
        fan += 1
    return rounds, fan


def exact_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Digest rows joined with the row that stays of their group (keep_uid, keep_id, group_size)."""
    rows = common.stored(digests(docs), "op6-digests")
    rounds, fan = tree(rows.count())
    parts = fan**rounds
    rows = rows.withColumn("part", common.salt(F.col("uid"), parts))
    runs = common.stored(exchange(rows, F.col("part"), parts), "op6-runs")
    merged, home = runs, F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long")
    for r in range(rounds):
        weight = fan**r
        digit, own = (F.pmod(F.floor(x / weight), F.lit(fan)).cast("int") for x in (home, F.col("part")))
        merged = exchange(merged, (F.col("part") + (digit - own) * weight).cast("int"), parts)
    best = merged.select("digest", F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid"), F.col("n").alias("group_size"))
    best = common.stored(best, "op6-best")
    # down the same way: each part's run learns its digests' answers, then the part's rows do
    answers = runs.select("part", "digest").join(best, "digest")
    return rows, rows.join(answers, ["part", "digest"])


def report(docs: DataFrame) -> DataFrame:
    _, out = exact_groups(docs)
    return out.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows one stays.

    ``docs`` should be a table's scan, whose rows come in the same partitions whenever they are read again.
    """
    _, out = exact_groups(docs)
    return common.without(docs, out.where("uid <> keep_uid").select("uid"))

"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over blocks.

Every document falls by a hash into a block of its source, so a source that holds a third of all rows is
many even groups.  A source's target in words is turned into exact quotas: whole passes over its blocks,
then the blocks of one more permuted pass until the target is reached, the last block cut at the document
that comes nearest.  The tree recursively splits the vector of the sources' block quotas between the two
halves of the output shards (each node one multivariate hypergeometric draw), and its leaves say how many
blocks of each source a shard gets.  Shards draw disjoint ranges of each source's permuted blocks: a
document is in the mix once for each draw of its block, in the shard that drew it, and each shard's rows
are shuffled by a hash.  Only the table of sources (one row a source, the size of the mixture's own
configuration) reaches the driver, and the tree's leaves are made there.

Blocks and shards grow with the rows.  Only the rows of the cut blocks, one a source, are ever sorted
before the shards are; texts move once, to their shards.

Defined cases: null text has size 0; the null source is a source of its own, last in order; a source of
size 0 has target 0; an empty table gives an empty mix; repeated rows are units of their own and lie in
the same block; a null doc_id's block is chosen by its text; ties in the hash go by doc_id (null first),
then by the text's hash.  All columns of the input are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: Blocks of a source and output shards at least, and rows of the table for each more of them.
BLOCKS, SHARDS, SEED = 1024, 64, 20240501
BLOCK_ROWS, SHARD_ROWS = 50_000, 200_000
#: Rows of the plan (one a block) that are broadcast; a longer one is joined by shuffling.
SMALL_PLAN = 200_000
KEY = "__source"


def targets(sizes: list[int], weights: list[float], most: float = MOST_PASSES) -> list[float]:
    """Weighted shares of the total; a share above ``most`` times its size stops there, the rest is shared again."""
    out, left, free = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while free:
        unit = left / sum(weights[i] for i in free)
        above = {i for i in free if weights[i] * unit > most * sizes[i]}
        if not above:
            for i in free:
                out[i] = weights[i] * unit
            break
        for i in above:
            out[i] = float(most * sizes[i])
            left -= out[i]
        left = max(left, 0.0)
        free -= above
    return out


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """[shards, sources] block counts whose columns sum to ``quotas`` and whose rows are as even as can be."""
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.asarray(quotas, np.int64))]
    while todo:
        low, high, have = todo.pop()
        if high - low == 1:
            out[low] = have
            continue
        middle = (low + high) // 2
        total = int(have.sum())
        draw = total * (middle - low) // (high - low)
        left, rest, need = np.zeros_like(have), total, draw
        for i in np.flatnonzero(have):  # one multivariate hypergeometric draw, margin by margin
            rest -= int(have[i])
            left[i] = _hypergeometric(rng, int(have[i]), rest, need)
            need -= int(left[i])
        todo += [(low, middle, left), (middle, high, have - left)]
    return out


def _hypergeometric(rng, good: int, bad: int, draw: int) -> int:
    return draw if not bad else int(rng.hypergeometric(good, bad, draw)) if good and draw else 0


def blocks_of(rows: int) -> int:
    return max(BLOCKS, -(-rows // BLOCK_ROWS))


def shards_of(rows: int, sources: int) -> int:
    """Output shards; the tree has a leaf for each shard and source, so few sources may have more shards."""
    return max(SHARDS, min(-(-rows // SHARD_ROWS), 20_000_000 // max(1, sources)))


def sized(docs: DataFrame, blocks: int) -> DataFrame:
    """The documents with their size in words, source key, block and place in the block's order."""
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    tie = F.xxhash64(F.col("text").cast("string"))
    unit = F.xxhash64(F.lit(SEED), F.coalesce(F.col("doc_id").cast("long"), tie))
    place = F.struct(F.xxhash64(F.lit(SEED + 2), unit).alias("h"), F.col("doc_id").cast("long").alias("id"), tie.alias("tie"))
    return docs.withColumns({"__size": words.cast("long"), KEY: key, "__block": F.pmod(unit, F.lit(blocks)), "__place": place})


def plan(rows: DataFrame, shards: int | None = None) -> DataFrame:
    """One row a block of sized rows: source size and target, whole passes, the place up to which one more pass takes rows, draws (pass, shard)."""
    spark = rows.sparkSession
    blocks = common.stored(rows.groupBy(KEY, "__block").agg(F.sum("__size").alias("words"), F.count("*").alias("rows")), "op1-blocks")
    found = sorted((r[KEY], r["size"], r["n"], r["rows"]) for r in blocks.groupBy(KEY).agg(F.sum("words").alias("size"), F.count("*").alias("n"), F.sum("rows").alias("rows")).collect())
    goals = targets([s for _, s, _, _ in found], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))])
    shards = shards or shards_of(sum(r for *_, r in found), len(found))
    known = []
    for (key, size, n, _), goal in zip(found, goals, strict=True):
        passes = min(MOST_PASSES, int(goal // size)) if size else 0
        known.append((key, size, goal, passes, goal - passes * size, n))
    about = spark.createDataFrame(known, f"{KEY} string, source_size long, target double, passes int, remainder double, n long")
    order = Window.partitionBy(KEY).orderBy(F.xxhash64(F.lit(SEED + 1), KEY, "__block"), "__block")
    laid = (
        blocks.join(F.broadcast(about), KEY)
        .withColumns({"nth": F.row_number().over(order) - 1, "before": F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")})
        .withColumn("room", F.col("remainder") - F.col("before"))
        .withColumn("extra", F.when(F.col("room") > 0, 1).otherwise(0))
    )
    laid = common.stored(laid, "op1-laid")
    # the block that the target cuts, one a source: taken in its order while a document's middle is within the room
    cut = laid.where("extra = 1 and room < words").select(KEY, "__block", "room")
    inside = Window.partitionBy(KEY, "__block").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    part = rows.select(KEY, "__block", "__size", "__place").join(F.broadcast(cut), [KEY, "__block"]).withColumn("start", F.sum("__size").over(inside) - F.col("__size"))
    upto = part.where(F.col("start") + F.col("__size") / 2 <= F.col("room")).groupBy(KEY, "__block").agg(F.max("__place").alias("upto"))
    # the tree's leaves: how many block draws of each source every shard makes, as ranges of the source's permuted draws
    quota = {r[KEY]: r["q"] for r in laid.groupBy(KEY).agg(F.sum(F.col("passes") + F.col("extra")).alias("q")).collect()}
    keys = [k[0] for k in known]
    counts = split_tree(np.array([quota[k] for k in keys], np.int64), shards, np.random.default_rng(SEED))
    ends = np.cumsum(counts, axis=0)
    ranges = [(k, s, int(ends[s, i] - counts[s, i]), int(ends[s, i])) for i, k in enumerate(keys) for s in np.flatnonzero(counts[:, i]).tolist()]
    drawn = spark.createDataFrame(ranges, f"{KEY} string, shard int, low long, high long")
    drawn = drawn.select(KEY, "shard", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("at"))
    # a block's draw in pass p stands at place p * n + nth of its source's permuted blocks
    asked = laid.where(F.col("passes") + F.col("extra") > 0).select(KEY, "__block", F.explode(F.sequence(F.lit(0), F.col("passes") + F.col("extra") - 1)).alias("pass"), "n", "nth")
    asked = asked.select(KEY, "__block", "pass", (F.col("pass").cast("long") * F.col("n") + F.col("nth")).alias("at")).join(drawn, [KEY, "at"])
    draws = asked.groupBy(KEY, "__block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("__draws"))
    whole = (F.col("extra") == 1) & (F.col("room") >= F.col("words"))
    out = laid.join(upto, [KEY, "__block"], "left").join(draws, [KEY, "__block"], "left")
    return common.stored(out.select(KEY, "__block", *[F.col(c).alias(f"__{c}") for c in ("source_size", "target", "passes", "upto")], whole.alias("__whole"), "__draws"), "op1-plan")


def counted(rows: DataFrame, laid: DataFrame) -> DataFrame:
    """Sized rows with their block's plan and the number of times the mix takes them (__copies)."""
    laid = F.broadcast(laid) if laid.count() <= SMALL_PLAN else laid
    more = F.when(F.col("__whole") | F.coalesce(F.col("__place") <= F.col("__upto"), F.lit(False)), 1).otherwise(0)
    return rows.join(laid, [KEY, "__block"]).withColumn("__copies", F.col("__passes") + more)


def mix(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The mixed rows, shard by shard and shuffled within: every column of ``docs``, then copy, shard and shuffle_key (with an underscore before, where docs has such a column)."""
    rows = sized(docs, blocks_of(docs.count()))
    laid = plan(rows.select(KEY, "__block", "__size", "__place"), shards)
    drawn = counted(rows, laid).where("__copies > 0").withColumn("__draw", F.explode(F.slice("__draws", F.lit(1), F.col("__copies"))))
    names = ["copy", "shard", "shuffle_key"]
    for i, name in enumerate(names):
        while name in docs.columns:
            name = f"_{name}"
        names[i] = name
    key = F.xxhash64(F.lit(SEED + 3), F.col("__draw.pass"), F.col("__place.h"), F.col("__place.tie"))
    out = drawn.select(*docs.columns, F.col("__draw.pass").alias(names[0]), F.col("__draw.shard").alias(names[1]), key.alias(names[2]))
    used = laid.agg(F.max(F.array_max(F.transform("__draws", lambda d: d["shard"])))).first()[0] or 0
    parts = common.wide_enough(docs.sparkSession, used + 1, 1)
    return out.repartition(parts, names[1]).sortWithinPartitions(names[1], names[2])


def report(docs: DataFrame) -> DataFrame:
    rows = sized(docs.select("doc_id", "text", "source"), blocks_of(docs.count()))
    rows = common.stored(rows.select("doc_id", "__size", KEY, "__block", "__place"), "op1-sizes")
    drawn = F.transform(F.slice(F.coalesce("__draws", F.array()), F.lit(1), F.col("__copies")), lambda d: d["shard"])
    return counted(rows, plan(rows)).select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.size(drawn)).cast("long").alias("taken"), F.size(drawn).alias("copies"), drawn.alias("shards")
    )

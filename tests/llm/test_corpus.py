"""Mixing, packing and the pipeline."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import op01_mix, op05_pack

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, target string, taken string, length int"
public_tokenizers = pytest.importorskip("public_tokenizers")


def store(spark, tmp_path, rows, name="docs", schema=SCHEMA):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.parquet(path)


def docs(n=600):
    rng = np.random.default_rng(2)
    names = ["a", "b", "c", "é", None]
    rows = []
    for i in range(n):
        source = names[0] if i % 3 == 0 else names[1 + i % 4]
        rows.append((i, " ".join(["word"] * int(rng.integers(0, 60))), None, source, None, "t", "t", 1))
    return [*rows, (5000, None, None, "empty", None, "t", "t", 1), (0, "again", None, "a", None, "t", "t", 1), (0, "once more here", None, "a", None, "t", "t", 1), (None, "no id", None, "b", None, "t", "t", 1), (None, "none " * 9, None, "b", None, "t", "t", 1)]


def test_targets():
    assert op01_mix.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    got = op01_mix.targets([10, 500, 490], [5, 2, 1])
    assert got[0] == 30 and np.isclose(sum(got), 1000) and np.isclose(got[1], 2 * got[2])
    assert op01_mix.targets([0, 0], [5, 2]) == [0, 0] and op01_mix.targets([], []) == []


def test_split_tree():
    quotas = np.array([100, 7, 0, 33])
    counts = op01_mix.split_tree(quotas, 8, np.random.default_rng(1))
    assert (counts.sum(0) == quotas).all() and np.ptp(counts.sum(1)) <= 2 and (counts >= 0).all()


def test_mix(spark, tmp_path):
    rows = docs()
    table = store(spark, tmp_path, rows)
    got = op01_mix.report(table).collect()
    assert sorted(map(str, got)) == sorted(map(str, op01_mix.report(table).collect()))
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, op01_mix.targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    taken = dict.fromkeys(order, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and np.isclose(r.target, goal[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 60 for s in order)
    mixed = op01_mix.mix(table)
    # what shards hold is what the tree drew for them: disjoint blocks, as many of each source as its leaves say
    sized = op01_mix.sized(table, op01_mix.BLOCKS)
    laid = op01_mix.plan(sized).collect()
    quota = dict.fromkeys(goal, 0)
    leaves = {}
    for b in laid:
        at = None if b[op01_mix.KEY] == "1" else b[op01_mix.KEY][1:]
        for d in b["__draws"] or ():
            quota[at] += 1
            leaves[at, d.shard] = leaves.get((at, d.shard), 0) + 1
    tree = op01_mix.split_tree(np.array([quota[s] for s in order]), op01_mix.SHARDS, np.random.default_rng(op01_mix.SEED))
    assert all(leaves.get((s, k), 0) == tree[k, i] for i, s in enumerate(order) for k in range(op01_mix.SHARDS))
    shard_of = {}
    for r in got:
        shard_of.setdefault(r.doc_id, []).extend(r.shards)
        assert r.copies == len(r.shards) and r.taken == r.size * r.copies
    found = {}
    for r in mixed.collect():
        found.setdefault(r.doc_id, []).append(r.shard)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in shard_of.items() if v}
    # shards lie one after the other, each shuffled by its key
    keys = [[(r.shard, r.shuffle_key) for r in p] for p in mixed.select("shard", "shuffle_key").rdd.glom().collect()]
    assert all(k == sorted(k) for k in keys) and sum(len({s for s, _ in k}) for k in keys) == len({s for k in keys for s, _ in k})
    assert op01_mix.mix(table.withColumnRenamed("target", "shard")).columns == [*("shard" if c == "target" else c for c in table.columns), "copy", "_shard", "shuffle_key"]
    assert mixed.columns == [*table.columns, "copy", "shard", "shuffle_key"]
    words = mixed.select(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
    assert words == sum(taken.values())
    assert op01_mix.report(table.limit(0)).count() == 0


def test_ids():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(op05_pack.TOKENIZER)
    whole = Tokenizer.from_file(path)
    texts = ["Hello, World! don't 12ab", "a <|endoftext|> b", "ΑΣ ΣΑΣ İ ẞ", "é ́a", "k\x85c d​e", "a\x1cb", "", " ", "naïve Straße " * 50, "\x00a b", "日本語 テスト", "l'eau 'S 'LL", "xİy ı ª²"]
    for text in texts:
        assert list(op05_pack.token_ids(text, path)) == whole.encode(text, add_special_tokens=False).ids, text


def test_tokens_remembered(monkeypatch):
    """What every text has is worked out once, however many other words a worker forgets; ids are the tokenizer's."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(op05_pack.TOKENIZER)
    worked, work = [], op05_pack._Fast._word
    monkeypatch.setattr(op05_pack, "REMEMBERED", 40)
    monkeypatch.setattr(op05_pack._Fast, "_word", lambda self, word: worked.append(word) or work(self, word))
    monkeypatch.setattr(op05_pack, "_tokenizers", {})
    whole = Tokenizer.from_file(path)
    for i in range(60):
        text = f"The {'abcdefghij'[i % 10] * (2 + i // 10)}, don't{'.' * (i % 3)} it's--'s 'S! $x_y {chr(0xe0 + i % 30)}t\x7f' \u01c5a. 1a2 \xaax\xb2 end.'t"
        assert list(op05_pack.token_ids(text, path)) == whole.encode(text, add_special_tokens=False).ids, text
    assert worked.count("the") == 1 and worked.count("don") == 1
    memory = op05_pack._tokenizers[path].chunks
    assert len(memory) + len(memory.older) <= 40


def test_pack_plan():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 101, 3000)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    bins = op05_pack.pack(histogram, 100)
    used = {}
    for b, times in bins:
        assert sum(k * v for k, v in b.items()) <= 100
        for k, v in b.items():
            used[k] = used.get(k, 0) + v * times
    assert used == histogram
    assert sum(t for _, t in bins) <= 1.02 * lengths.sum() / 100
    assert op05_pack.pack({}, 100) == []


def test_pack(spark, tmp_path):
    path = public_tokenizers.path(op05_pack.TOKENIZER)
    rows = [*docs(80), (7000, "long words " * 3000, None, "a", None, "t", "t", 1)]
    table = store(spark, tmp_path, rows)
    got = op05_pack.report(table, path).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.sequence_id, []).append(r)
    for rs in pieces.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    text = {r[0]: r[1] for r in rows if r[0]}
    for r in got:
        if r.doc_id:
            ids = np.append(op05_pack.token_ids(text[r.doc_id] or "", path), 1).astype("<u4")
            assert r.start == 4096 * r.piece and r.length == min(4096, len(ids) - r.start)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert op05_pack.report(table.limit(0), path).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [r[:5] for r in docs(120)]
    rng = np.random.default_rng(9)
    bad = [(10000 + i, " ".join(rng.choice(["red", "blue", "green", "old"], 30)) + " blockhead numskull", None, "a", None) for i in range(40)]
    good = [(20000 + i, " ".join(rng.choice(["red", "blue", "green", "old"], 30)), None, "a", None) for i in range(40)]
    copies = [(30000 + i, good[0][1] + " " * i, None, "b", None) for i in range(5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    store(spark, tmp_path, rows + bad + good + copies, "documents.parquet", schema)
    store(spark, tmp_path, [(r[0], 1) for r in bad] + [(r[0], 0) for r in good], "labels.parquet", "doc_id long, toxic int")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = None
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, at, str(tmp_path))
        assert out.columns == at.columns, name
        out.write.parquet(str(tmp_path / f"out{n}"))
        at = spark.read.parquet(str(tmp_path / f"out{n}"))
        kept = {r.doc_id for r in at.select("doc_id").collect()}
        if n == 0:
            assert not kept & {r[0] for r in bad} and {r[0] for r in good} <= kept
        if n == 1:
            assert len(kept & ({r[0] for r in copies} | {good[0][0]})) == 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_workers_give_memory_back():
    """Pipeline: what a task freed does not stay with its worker, nor what other operators remember."""
    import numpy as np

    from scriptorium.llm import common, op02_toxicity, op05_pack

    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    pinned = []

    def run(batches):
        held = [np.ones(8000) for _ in range(3000)]
        pinned.append(np.ones(8000))  # the heap's end stays in use
        del held
        yield from batches

    op02_toxicity.Scorer.last, op05_pack._tokenizers["x"] = ("x", None), ()
    before = resident()
    assert list(common.lean(run, "op5")(iter([1, 2]))) == [1, 2]
    assert resident() - before < 64 << 20
    assert op02_toxicity.Scorer.last is None and op05_pack._tokenizers.pop("x") == ()
    assert common.memories.keys() == {"op2", "op5"}

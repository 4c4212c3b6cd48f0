"""Exact dedup, Jaccard join, suffix dedup and embedding links against brute force and edge cases."""

import hashlib
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import op03_suffix, op06_exact, op09_caps, op10_jaccard

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, kept int, component_id long, uid string, part string"


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


@pytest.fixture(scope="module")
def rows():
    long = words(4000)
    near = [words(120).replace("w7 ", f"x{i} ") for i in range(12)]
    texts = ["", None, " \n\t", "one", "One", "o ne", "a b c d e f", "A B C D E F", "a b c d e g", long, long + " end", long, "äöü ß " * 30, *near, words(120), words(60, 900) + " " + words(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (None, "one more")]
    return [(i, t, None, None, None, "x", 1, 2, "u", "p") for i, t in rows]


def docs_of(spark, tmp_path, rows):
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_exact(spark, tmp_path, rows):
    docs = docs_of(spark, tmp_path, rows)
    got = op06_exact.report(docs).collect()
    assert len(got) == len(rows)
    bare = {i: re.sub(r"[\x20\x09-\x0d]", "", t or "") for i, t, *_ in rows}
    full = {i: t or "" for i, t, *_ in rows}
    groups = Counter(re.sub(r"[\x20\x09-\x0d]", "", r[1] or "") for r in rows)
    for r in got:
        assert r.text_sha256 == hashlib.sha256(bare[r.doc_id].encode()).hexdigest()
        assert r.group_size == groups[bare[r.doc_id]]
        same = [i for i in bare if i is not None and bare[i] == bare[r.doc_id]]
        if same:
            assert r.keep_id == min(same, key=lambda i: (-len(full[i]), i))
    assert sum(r.kept for r in got) == len(groups)
    kept = op06_exact.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_tree_of_runs():
    for rows in (0, 50_000, 10**8, 10**9, 3 * 10**10, 10**12):
        rounds, fan = op06_exact.tree(rows)
        assert rounds >= 2 and op06_exact.FAN <= fan <= op06_exact.MOST_FAN and fan**rounds * op06_exact.PART_ROWS >= rows


def test_jaccard(spark, tmp_path, rows):
    docs = docs_of(spark, tmp_path, rows)
    got = op10_jaccard.classes(docs).collect()
    assert len(got) == len(rows)
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in combinations([i for i in sets if i is not None], 2):
        n = len(sets[a] & sets[b])
        if sets[a] and 100 * n >= 80 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        if r.doc_id is not None:
            assert r.component_id == root(r.doc_id)
    kept = op10_jaccard.dedup(docs)
    assert kept.columns == docs.columns
    linked = {root(i) for i in sets if i is not None and sets[i]}
    assert kept.count() == len(linked) + sum(not sets[i] for i in sets if i is not None) + 1


def test_jaccard_joining_links(monkeypatch):
    """A group's links join its components and are fewer than those, though all pairs link; pairs that bitmaps let through are tested."""
    monkeypatch.setattr(op10_jaccard, "signature", lambda x, each: bytes(32))
    rng = np.random.default_rng(3)
    sets = [np.sort(np.append(rng.integers(0, 1 << 63, 10, np.int64), np.arange(k, k + 190))).astype(np.uint64) for k in [0] * 40 + [5000] * 30]
    size = [len(x) for x in sets]
    rep = list(range(70))
    columns = [[9] * 70, [0] * 70, [0] * 70, [0] * 70, rep, rep, size, [x.tobytes() for x in sets]]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    batch = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in op10_jaccard.TILE.split(", ")])
    links = [(a, b) for out in op10_jaccard.joining(op10_jaccard.THRESHOLD)(iter([batch])) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    assert len(links) == 39 + 29 and all(a < b and (a < 40) == (b < 40) for a, b in links)
    assert {x for link in links for x in link} == set(rep)


@pytest.mark.parametrize(("crowd", "often"), [(1024, 16), (1, 16), (2, 2)])
def test_suffix(spark, tmp_path, rows, monkeypatch, crowd, often):
    monkeypatch.setattr(op03_suffix, "CROWD", crowd)
    monkeypatch.setattr(op03_suffix, "OFTEN", often)
    docs = docs_of(spark, tmp_path, rows)
    got = {(r.doc_id, r.n_bytes): r for r in op03_suffix.report(docs).collect()}
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    count = Counter(b[k : k + 200] for _, b in data for k in range(len(b) - 199))
    for i, b in data:
        cover = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                cover[k] += 1
                cover[k + 200] -= 1
        gone = np.cumsum(cover)[: len(b)] > 0
        r = got[i, len(b)]
        assert r.n_removed == gone.sum()
        assert r.n_spans == (np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()
        assert r.kept_sha256 == hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()


def test_previous_factors():
    rng = np.random.default_rng(3)
    for _ in range(60):
        x = rng.integers(1, 3, rng.integers(1, 30))
        order, ranks = op03_suffix.suffix_array(x, np.zeros(len(x), np.int64), 64)
        assert list(order) == sorted(range(len(x)), key=lambda i: list(x[i:]))
        length, source = op03_suffix.previous_factors(order, op03_suffix.adjacent_lcp(order, ranks))
        for i in range(len(x)):
            shared = [next((k for k in range(len(x) - i) if x[i + k] != x[j + k]), len(x) - i) for j in range(i)]
            assert length[i] == max(shared, default=0)
            if length[i]:
                assert shared[source[i]] == length[i]


def test_embeddings(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    vectors = [*base.tolist(), *(base[3] + rng.standard_normal((30, 16)) * 0.12).tolist(), base[1].tolist(), (base[1] * 1e150).tolist(), (base[2] * 1e-150).tolist()]
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(100, None), (101, [0.0] * 16), (102, [float("nan")] * 16), (103, [1.0] * 15 + [None]), (104, [float("inf")] + [0.0] * 15), (105, []), (106, [1.0] * 8)]
    path = str(tmp_path / "vectors")
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("uid", F.lit("x")).write.parquet(path)
    got = {r.vec_id: r for r in op09_caps.report(spark.read.parquet(path)).collect()}
    assert len(got) == len(rows)
    u = np.array([np.array(v) / np.abs(v).max() for v in vectors])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    comp = list(range(len(u)))
    for _ in range(len(u)):
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(len(u))]
    for i in range(len(u)):
        assert got[i].n_links == link[i].sum() and got[i].component_id == comp[i] and got[i].kept == (comp[i] == i)
    for i in range(100, 107):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_embeddings_in_chunks(spark, tmp_path, monkeypatch):
    """Every link of 3000 vectors is found, in filters cut into chunks and strips; repeated rows count."""
    monkeypatch.setattr(op09_caps, "BLOCK_ROWS", 40)
    monkeypatch.setattr(op09_caps, "STRIP", 7)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 32))
    near = (base[rng.integers(0, 60, 2600)] + rng.standard_normal((2600, 32)) * rng.uniform(0.02, 0.3, (2600, 1))).tolist()
    vectors = [*base.tolist(), *near, *near[:100]]
    rows = [(i, v) for i, v in enumerate(vectors)]
    path = str(tmp_path / "vectors")
    spark.createDataFrame([*rows, rows[5]], "vec_id long, embedding array<double>").write.parquet(path)
    got = op09_caps.report(spark.read.parquet(path)).collect()
    u = np.array([*vectors, vectors[5]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cosine = u @ u.T
    link = cosine >= 0.95
    np.fill_diagonal(link, False)
    ids = [*range(len(vectors)), 5]
    comp = np.array(ids)
    while True:
        now = np.minimum(comp, np.where(link, comp[None, :], len(ids)).min(1))
        if (now == comp).all():
            break
        comp = now
    want = sorted((ids[k], int(link[k].sum()), int(comp[k])) for k in range(len(ids)))
    have = sorted((r.vec_id, r.n_links, r.component_id) for r in got)
    assert sum(w[1] for w in want) * 0.999 <= sum(h[1] for h in have) <= sum(w[1] for w in want)
    assert sum(a == b for a, b in zip(want, have, strict=True)) >= 0.98 * len(want)


def test_embeddings_in_rounds(spark, tmp_path, monkeypatch):
    """no stage shuffles much more than the vectors' bytes, however many filters a vector falls into; nothing is lost by rounds."""
    monkeypatch.setattr(op09_caps, "ROUND_LEAST", 1 << 18)
    rng = np.random.default_rng(12)
    vectors = rng.standard_normal((4000, 64)).astype(np.float32)
    vectors[2000:2600] = vectors[:600] + rng.standard_normal((600, 64)) * rng.uniform(0.05, 0.3, (600, 1))
    path = str(tmp_path / "vectors")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(path)
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    written = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList()))}
    before = written()
    got = {r.vec_id: r.n_links for r in op09_caps.report(spark.read.parquet(path)).collect()}
    new = {k: n for k, n in written().items() if k not in before}
    assert 0 < max(new.values()) < 3 * vectors.nbytes
    u = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    assert want.sum() > 600 and sum(got.values()) >= 0.999 * want.sum() and all(got[i] <= want[i] for i in got)


def test_empty_tables(spark, tmp_path):
    docs = docs_of(spark, tmp_path, [])
    for report in (op06_exact.report, op10_jaccard.report, op03_suffix.report):
        assert report(docs).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op09_caps.report(vectors).count() == 0

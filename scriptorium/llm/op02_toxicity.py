"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

Words are compared by the gap-weighted subsequence kernel (subsequences of three characters, ends
marked, each skipped character costing DECAY), normalised and raised to a power.  A word that an
inserted or left-out character disguises keeps most of its subsequences, so it stays near the word
meant.  The kernel with all landmarks is worked out from the subsequences themselves, by a table of those
that landmarks have, so no pair is left out.  Landmarks are words that the labels single out and their
nearest harmless neighbours; a word's Nystroem features are K(landmarks, landmarks)^(-1/2) K(landmarks,
word).  A linear support vector machine with squared hinge loss learns on them from labelled sentences:
every word of a harmless sentence is harmless, and a toxic sentence has a witness, the word of it that
the machine of the round before values most (the first round weighs words by how much oftener toxic
sentences have them).  A text's score is a logistic function, fitted on the same labelled texts, of its
three highest word values.

The machine is fitted in one task on at most FIT_EACH labelled texts of each class, chosen by a hash, of
FIT_BYTES together; every text is scored whole.  Words are read as they stand between white space with
everything but letters taken out, and single letters that follow one another are read as one word too.

Defined cases: null and empty texts have no words and get the score of a text without any known word;
labels that are null are not used, repeated ones count once, and of rows with one
doc_id one is learnt from; without both classes among them, every score
is the share of toxic ones (0 without labels); other columns are never read.
"""

from __future__ import annotations

import pickle
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

FIT_EACH, FIT_BYTES = 1000, 32 << 20
FOLDS, HELD = 5, 0
LANDMARKS, NEIGHBOURS, ROUNDS = 160, 24, 2
ORDER, DECAY, POWER = 3, 0.85, 3
#: Word values above which the logistic function may rise at another rate.
KNEES = (0.25, 0.5, 0.75, 0.9)
#: Standard deviations above its share from which on a word may be a landmark.
SURE = 3.5
#: Words with a lower kernel with every landmark are fitted as one.
LEAST_NEAR = 0.01
#: Letters of a word that are compared at once; longer words are read in overlapping windows.
WIDTH = 32
#: Words whose kernels are worked out together.
BLOCK = 4096
#: Word values that a worker remembers.
REMEMBERED = 1_000_000
#: Bytes of text that are scored at once.
SLICE = 1 << 20

_not_letters = regex.compile(r"[^\p{L}\p{M}\n]+")


def letters(words: list[str]) -> list[str]:
    """Words in lower case without anything but letters."""
    return _not_letters.sub("", "\n".join(words).lower()).split("\n") if words else []


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ^word$ in rows of WIDTH + 2, zero-padded, and the lengths."""
    chars = np.array([f"\x01{w[:WIDTH]}\x02" for w in words], f"U{WIDTH + 2}") if words else np.zeros(0, f"U{WIDTH + 2}")
    codes = chars.view(np.uint32).reshape(len(words), WIDTH + 2).astype(np.int32)
    return codes, (codes != 0).sum(1)


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of order ORDER, row by row, of two arrays of code points."""
    n, la, lb = len(a), a.shape[1], b.shape[1]
    inner = np.ones((la + 1, lb + 1, n), np.float32)  # K'_0
    for order in range(1, ORDER):
        after = np.zeros_like(inner)
        for i in range(1, la + 1):
            run = np.zeros(n, np.float32)
            for j in range(1, lb + 1):
                same = (a[:, i - 1] == b[:, j - 1]) & (a[:, i - 1] != 0)
                run = DECAY * run + np.where(same, DECAY * DECAY * inner[i - 1, j - 1], 0)
                after[i, j] = DECAY * after[i - 1, j] + run
        inner = after
    out = np.zeros(n, np.float64)
    for i in range(1, la + 1):
        for j in range(1, lb + 1):
            same = (a[:, i - 1] == b[:, j - 1]) & (a[:, i - 1] != 0)
            out += np.where(same, DECAY * DECAY * inner[i - 1, j - 1], 0)
    return out


def kernel_pairs(a: np.ndarray, b: np.ndarray, block: int = 1024) -> np.ndarray:
    """The kernel of many pairs, in blocks cut to the longest words they hold."""
    out = np.zeros(len(a))
    size = np.maximum((a != 0).sum(1), (b != 0).sum(1))
    order = np.argsort(size, kind="stable")
    for start in range(0, len(a), block):
        rows = order[start : start + block]
        width = int(size[rows[-1]])
        out[rows] = kernel(a[rows, :width], b[rows, :width])
    return out


class Subsequences:
    """The weighted subsequences of ORDER (three) characters of some words, to find the kernel of others with all of them."""

    def __init__(self, codes: np.ndarray):
        self.count = len(codes)
        found = np.unique(codes)
        self.letters = found[found != 0]
        base = len(self.letters) + 1
        rows, keys, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for row, key, weight in self._each(codes):
            rows.append(row)
            keys.append(key)
            weights.append(weight)
        row, key, weight = np.concatenate(rows), np.concatenate(keys), np.concatenate(weights)
        self.keys, back = np.unique(key, return_inverse=True)
        self.value = np.zeros((len(self.keys), self.count), np.float32)
        np.add.at(self.value, (back, row), weight)
        # a dense table of keys where the alphabet is small
        self.place = None
        if base**ORDER <= 1 << 24:
            self.place = np.full(base**ORDER, -1, np.int32)
            self.place[self.keys] = np.arange(len(self.keys))

    def _each(self, codes: np.ndarray, most: int = 1 << 13):
        """(row, subsequence, weight) of all subsequences of known letters, in pieces, words of one length together."""
        at = np.minimum(np.searchsorted(self.letters, codes), max(0, len(self.letters) - 1))
        index = np.where(self.letters[at] == codes, at + 1, 0) if len(self.letters) else np.zeros(codes.shape, np.int64)
        size, base = (codes != 0).sum(1), len(self.letters) + 1
        for n in np.unique(size):
            i, j, k = (np.array(x, np.int64) for x in zip(*combinations(range(n), ORDER), strict=True)) if n >= ORDER else (np.zeros(0, np.int64),) * 3
            weight = DECAY ** (k - i + 1)
            rows = np.flatnonzero(size == n)
            step = max(1, most // max(1, len(i)))
            for start in range(0, len(rows), step):
                part = rows[start : start + step]
                x = index[part]
                a, b, c = x[:, i], x[:, j], x[:, k]
                hit = np.flatnonzero((a != 0) & (b != 0) & (c != 0))
                yield part[hit // max(1, len(i))], ((a * base + b) * base + c).ravel()[hit], weight[hit % max(1, len(i))]

    def kernel(self, codes: np.ndarray) -> np.ndarray:
        """The kernel of every row of codes with every word of the table."""
        out = np.zeros((len(codes), self.count), np.float32)
        for row, key, weight in self._each(codes):
            if self.place is not None:
                at = self.place[key]
                hit = at >= 0
            else:
                at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
                hit = self.keys[at] == key
            row, at, weight = row[hit], at[hit], weight[hit].astype(np.float32)
            if len(row):
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                out[row[first]] = np.add.reduceat(self.value[at] * weight[:, None], first)
        return out


def bent(top: np.ndarray) -> np.ndarray:
    """The three highest values, and by how much the two highest exceed each knee."""
    return np.hstack([top, *[np.maximum(top[:, :2] - k, 0) * 4 for k in KNEES]])


class Machine:
    """Landmarks, their weights, and the logistic function on a text's three highest word values."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, curve: np.ndarray, constant: float | None = None):
        self.landmarks, self.weights, self.bias, self.curve, self.constant = landmarks, weights, bias, curve, constant
        self.name = uuid.uuid4().hex
        self.codes, _ = coded(landmarks)
        self.table = Subsequences(self.codes)
        self.own = np.sqrt(np.maximum(kernel_pairs(self.codes, self.codes), 1e-30)) if landmarks else np.zeros(0)

    def near(self, words: list[str]) -> np.ndarray:
        """The normalised kernel, raised to POWER, of every word with every landmark."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        # words of like length together, so that pieces of the table's work are long runs
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for start in range(0, len(order), BLOCK):
            part = order[start : start + BLOCK]
            codes, _ = coded([words[i] for i in part])
            own = np.sqrt(np.maximum(kernel_pairs(codes, codes), 1e-30))
            out[part] = (self.table.kernel(codes) / own[:, None] / self.own) ** POWER
        return out

    def values(self, words: list[str]) -> np.ndarray:
        """The machine's value of each word; of a long one, of its best window."""
        pieces, owner = list(words), list(range(len(words)))
        for i, word in enumerate(words):
            for start in range(WIDTH // 2, max(0, len(word) - WIDTH // 2), WIDTH // 2):
                pieces.append(word[start : start + WIDTH])
                owner.append(i)
        total = self.near(pieces) @ self.weights.astype(np.float32) + self.bias if self.landmarks else np.full(len(pieces), self.bias)
        out = total[: len(words)].astype(np.float64)
        np.maximum.at(out, np.array(owner[len(words) :], np.int64), total[len(words) :])
        return out

    def chance(self, top: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(top), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + bent(top) @ self.curve[1:], -60, 60)))


def slice_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Hashes of the words of a slice, their documents, the first place of each distinct one, and how to read them.

    Runs of four and more one-letter words are added as one word.
    """
    data, offsets = common.text_bytes(column)
    starts, ends, doc = common.words_of(data, offsets)
    single = ends - starts <= 2
    single &= (ends - starts == 1) | (data[np.minimum(starts, max(0, len(data) - 1))] >= 0xC3) if len(starts) else single
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    runs = [(a, b) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= 4]
    more_s, more_e, more_d = [], [], []
    for a, b in runs:
        cut = [a, *(np.flatnonzero(np.diff(doc[a:b])) + a + 1), b]
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            if y - x >= 4:
                more_s.append(starts[x])
                more_e.append(ends[y - 1])
                more_d.append(doc[x])
    if more_s:
        starts, ends, doc = np.append(starts, more_s), np.append(ends, more_e), np.append(doc, more_d)
    hashes = common.span_hash(common.prefix_hash(data), starts, ends)
    return hashes, doc, starts, [data, ends]


def top_three(values: np.ndarray, doc: np.ndarray, docs: int, floor: float) -> np.ndarray:
    """The three highest values of each document, ``floor`` where it has fewer."""
    out = np.full((docs, 3), floor)
    order = np.lexsort((-values, doc))
    d, v = doc[order], values[order]
    first = np.searchsorted(d, np.arange(docs))
    nth = np.arange(len(d)) - first[d] if len(d) else d
    ok = nth < 3
    out[d[ok], nth[ok]] = v[ok]
    return out


class Scorer:
    """A machine with the values of words met before."""

    #: The scorer that this worker used last, and its machine's name: tasks of one job share what it remembers.
    last: tuple[str, Scorer] | None = None

    def __init__(self, machine: Machine):
        self.machine, self.known, self.value = machine, np.zeros(0, np.uint64), np.zeros(0)

    @classmethod
    def of(cls, machine: Machine) -> Scorer:
        if cls.last is None or cls.last[0] != machine.name:
            cls.last = machine.name, cls(machine)
        return cls.last[1]

    def tops(self, column: pa.Array) -> np.ndarray:
        hashes, doc, starts, (data, ends) = slice_words(column)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        old = self.known[at] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        new = np.flatnonzero(~old)
        value = np.zeros(len(distinct))
        if old.any():
            value[old] = self.value[at[old]]
        if len(new):
            raw = data.tobytes()
            words = [raw[i:j].decode("utf-8", "replace") for i, j in zip(starts[first[new]], ends[first[new]], strict=True)]
            words = letters([w if "\n" not in w else w.replace("\n", " ") for w in words])
            value[new] = self.machine.values(words)
            if len(self.known) + len(new) > REMEMBERED:
                self.known, self.value = distinct, value
            else:
                known = np.concatenate([self.known, distinct[new]])
                order = np.argsort(known, kind="stable")
                self.known, self.value = known[order], np.concatenate([self.value, value[new]])[order]
        # a document's highest values: words below the bias say nothing, most words lie there
        some = value > self.machine.bias
        pick = some[back]
        seen = np.unique(doc[pick] * max(1, len(distinct)) + back[pick])
        return top_three(value[seen % max(1, len(distinct))], seen // max(1, len(distinct)), len(column), self.machine.bias)


def _forget() -> None:
    Scorer.last = None


common.memories["op2"] = _forget


def _solve(x: np.ndarray, plus: np.ndarray, minus: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps on the active rows.

    Each row counts ``plus`` times as toxic and ``minus`` times as harmless; its last feature is 1.
    """
    beta, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(25):
        value = x @ beta.astype(np.float32)
        up, down = plus * (value < 1), minus * (value > -1)
        h = ridge + (x * (up + down).astype(np.float32)[:, None]).T @ x
        step = np.linalg.solve(h, x.T @ (up - down).astype(np.float32))
        if np.allclose(step, beta, atol=1e-5):
            break
        beta = step
    return beta[:-1], float(beta[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - 0.02 * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(texts: list[str], toxic: list[int]) -> Machine:
    """The machine learnt from labelled texts."""
    y = np.array(toxic)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Machine([], np.zeros(0), 0.0, np.zeros(1 + 3 + 2 * len(KNEES)), share)
    bags = [set(filter(None, letters(t.split()))) for t in texts]
    df = [Counter(), Counter()]
    for bag, label in zip(bags, y, strict=True):
        df[label].update(bag)
    n = [int((y == 0).sum()), int(y.sum())]
    odds = {w: np.log((a + 0.5) / (n[1] + 1)) - np.log((df[0][w] + 0.5) / (n[0] + 1)) for w, a in df[1].items() if a >= 3}
    # words that toxic texts have oftener than their share by more than chance would
    due = {w: (df[0][w] + df[1][w]) * share for w in odds}
    gain = {w: (df[1][w] - df[0][w] * n[1] / n[0]) * o for w, o in odds.items() if o > 1 and df[1][w] - due[w] >= SURE * np.sqrt(due[w] + 1)}
    marks = sorted(gain, key=lambda w: (-gain[w], w))[:LANDMARKS]
    if not marks:
        return Machine([], np.zeros(0), 0.0, np.zeros(1 + 3 + 2 * len(KNEES)), share)
    words = sorted(w for w in set(df[0]) | set(df[1]) if df[1][w] or df[0][w] > 1)
    blank = np.zeros(1 + 3 + 2 * len(KNEES))
    closest = Machine(marks, np.zeros(len(marks)), 0.0, blank).near(words).max(1)
    harmless = [i for i in np.argsort(-closest * np.array([np.log1p(df[0][w]) * (df[0][w] * n[1] >= df[1][w] * n[0]) for w in words]))[:NEIGHBOURS] if closest[i] > 0.05 and words[i] not in gain]
    marks = marks + [words[i] for i in harmless]
    machine = Machine(marks, np.zeros(len(marks)), 0.0, blank)
    # Nystroem features of the words; those that share next to nothing with any landmark are one harmless row of zeros
    gram = machine.near(marks).astype(np.float64)
    vals, vecs = np.linalg.eigh((gram + gram.T) / 2)
    root = vecs @ np.diag(1 / np.sqrt(np.maximum(vals, 1e-2))) @ vecs.T
    raw = machine.near(words)
    used = np.flatnonzero(raw.max(1) >= LEAST_NEAR)
    x = np.zeros((len(used) + 1, len(marks) + 1), np.float32)
    x[:, -1] = 1
    x[:-1, :-1] = raw[used] @ root.astype(np.float32)
    del raw
    a = np.array([df[1][words[i]] for i in used], float)
    b = np.array([df[0][words[i]] for i in used], float) * n[1] / n[0]
    far = float(max(len(words) - len(used), 1))
    minus = np.append(b + np.minimum(a, b), far) + 1e-6
    place = {words[i]: k for k, i in enumerate(used)}
    sentences = [np.array([place[w] for w in bag if w in place]) for bag, label in zip(bags, y, strict=True) if label]
    plus = np.append(np.maximum(0, a - b) * (a >= 3 * b), 0)
    for turn in range(ROUNDS + 1):
        beta, bias = _solve(x, plus + 1e-6, minus)
        if turn < ROUNDS:
            value = x[:, :-1] @ beta.astype(np.float32)
            witness = [s[np.argmax(value[s])] for s in sentences if len(s)]
            plus = np.bincount(np.array(witness, np.int64), minlength=len(x)).astype(float)
    machine.weights, machine.bias = root @ beta, min(bias, 0.0)
    scorer = Scorer(machine)
    top = np.concatenate([scorer.tops(pa.array(texts[i : i + 100], pa.string())) for i in range(0, len(texts), 100)])
    machine.curve = _logistic(bent(top), y)
    return machine


def labelled(docs: DataFrame, labels: DataFrame) -> Machine:
    """The machine fitted, in one task, on a bounded sample: FIT_EACH ids of each class by a hash, one text an id, FIT_BYTES together."""
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(fold != HELD)
    ids = [known.where(F.col("toxic") == c).orderBy(*order).limit(FIT_EACH) for c in (0, 1)]
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids[0].union(ids[1])), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max(F.struct("text", "toxic")).alias("r")).select("doc_id", "r.text", "r.toxic")
    before = F.sum(F.octet_length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("bytes", before).where(F.col("bytes") <= FIT_BYTES).select("doc_id", "text", "toxic").repartition(1)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        machine = fit([t for _, t, _ in found], [int(c > 0) for _, _, c in found])
        yield pa.record_batch([pa.array([pickle.dumps(machine)], pa.binary())], names=["machine"])

    got = rows.mapInArrow(common.lean(fitted, "op2"), "machine binary").first()  # none if no task has rows
    return pickle.loads(got[0]) if got else fit([], [])


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """uid, doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(shared.value)
        for batch in common.slices(batches, "text", SLICE):
            chance = shared.value.chance(scorer.tops(batch.column(2)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(chance)], names=["uid", "doc_id", "score"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(common.lean(score, "op2"), "uid long, doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, labelled(docs, labels))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, learn_from: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns, in one pass over them."""
    machine = labelled(learn_from, labels)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(shared.value)
        for batch in common.slices(batches, "text", SLICE):
            yield batch.filter(pa.array(shared.value.chance(scorer.tops(batch.column(at))) < 0.5))

    return docs.mapInArrow(common.lean(keep, "op2"), docs.schema)

"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1; an n-gram's vector binds (multiplies) its letters'
vectors, each permuted by its distance from the end; a text's vector bundles (adds) those of all its
trigrams, word ends counting as a letter.  A language's prototype bundles the unit vectors of all its
training texts, summed on the executors; a text gets the language whose prototype has the highest cosine.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text when
nothing can be learned; rows without a language are not learned from; equal cosines go to the first language
in code-point order; the score is the cosine, 0 where it is negative; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIM, SEED = 1024, 7
FOLDS, HELD = 4, 2
#: n-grams whose vectors are held at once.
BLOCK = 8192

_letter: list[np.ndarray] = []
_vectors: dict[int, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letter:
        _letter.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letter[0]


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """The random vectors of code points, the same in every process; 0 is the word end."""
    for code in codes.tolist():
        if code not in _vectors:
            _vectors[code] = np.random.default_rng((SEED, code)).integers(0, 2, DIM, np.int8) * 2 - 1
    return np.stack([_vectors[c] for c in codes.tolist()])


def profiles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vector of each text, and whether it has a letter."""
    texts = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(f"\n{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    codes = np.where(letter_table()[codes], codes, 0)
    # neighbouring word ends of a text count as one
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (doc[1:] != doc[:-1])
    codes, doc = codes[keep], doc[keep]
    out = np.zeros((len(texts), DIM), np.float32)
    has = np.bincount(doc[codes != 0], minlength=len(texts)) > 0
    if len(codes) < 3:
        return out, has
    present = np.zeros(0x110000, bool)
    present[codes] = True
    alphabet = np.flatnonzero(present)
    index = np.zeros(0x110000, np.int64)
    index[alphabet] = np.arange(len(alphabet))
    small, n = index[codes], len(alphabet)
    gram = (small[:-2] * n + small[1:-1]) * n + small[2:]
    ok = (doc[:-2] == doc[2:]) & has[doc[:-2]]
    gram, doc = gram[ok], doc[:-2][ok]
    distinct, back = np.unique(gram, return_inverse=True)
    pair, times = np.unique(doc * len(distinct) + back, return_counts=True) if len(distinct) else (gram, gram)
    row, col = np.divmod(pair, max(1, len(distinct)))
    base = letter_vectors(alphabet)
    first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    order = np.argsort(col, kind="stable")
    row, col, times = row[order], col[order], times[order]
    for start in range(0, len(distinct), BLOCK):
        grams = distinct[start : start + BLOCK]
        a, b, c = grams // (n * n), grams // n % n, grams % n
        vectors = (first[a] * second[b] * base[c]).astype(np.float32)
        low, high = np.searchsorted(col, [start, start + len(grams)])
        counts = np.zeros((len(texts), len(grams)), np.float32)
        counts[row[low:high], col[low:high] - start] = times[low:high]
        out += counts @ vectors
    return out, has


def unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in common.slices(batches, "text", 1 << 20):
        vectors, has = profiles(batch.column(0).to_pylist())
        vectors, langs = unit(vectors), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            rows = np.array([x == lang for x in langs]) & has
            if rows.any():
                total[lang] = total.get(lang, 0) + vectors[rows].sum(0)
    for lang, vector in total.items():
        yield pa.record_batch([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(vector.astype(np.float64))], names=["lang", "at", "value"])


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages, in order, and their unit prototypes; one row of DIM numbers a language reaches the driver.

    Sums are rounded before they are compared, so that the order of additions does not show.
    """
    rows = docs.where("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    total = rows.mapInArrow(_bundle, "lang string, at int, value double").groupBy("lang", "at").agg(F.round(F.sum("value"), 6).alias("value"))
    found: dict[str, np.ndarray] = {}
    for r in total.collect():
        found.setdefault(r["lang"], np.zeros(DIM))[r["at"]] = r["value"]
    names = sorted(found)
    return names, unit(np.stack([found[x] for x in names])) if names else np.zeros((0, DIM))


def predicted(docs: DataFrame, names: list[str], vectors: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    model = docs.sparkSession.sparkContext.broadcast((names, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, known = model.value
        for batch in common.slices(batches, "text", 1 << 20):
            bundle, has = profiles(batch.column(1).to_pylist())
            if langs:
                cosine = unit(bundle) @ known.T
                best = cosine.argmax(1)
                score = np.where(has, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
                names = [langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)]
            else:
                score, names = np.zeros(batch.num_rows), ["und"] * batch.num_rows
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD
    names, vectors = prototypes(docs.where(~F.coalesce(fold, F.lit(False))))
    return predicted(docs, names, vectors).select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "lang_pred", "score")

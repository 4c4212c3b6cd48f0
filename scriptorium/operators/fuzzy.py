"""Dictionary correction of unknown words: close matches, then Jaro-Winkler, within a bounded vocabulary.

The vocabulary is an argument (a collection of words, shipped to the workers; at most MOST_WORDS).  A
worker looks each distinct unknown word up once.  Ties go to the larger word among close matches, and to
the smaller one among Jaro-Winkler matches.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import filled

# Shortest word, least similarity of either kind, and how much the lengths may differ.
MIN_LENGTH, CLOSE, JARO, BAND = 4, 0.80, 0.82, 2
MOST_WORDS = 1_000_000


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used: set[int] = set()
    left = []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == c), None)
        if j is not None:
            used.add(j)
            left.append(c)
    m = len(left)
    if not m:
        return 0.0
    moved = sum(x != b[j] for x, j in zip(left, sorted(used), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + 0.1 * same * (1 - jaro) if jaro > 0.7 else jaro


class Vocabulary:
    def __init__(self, words: Iterable[str]):
        self.words = frozenset(w.lower() for w in words if w)
        if len(self.words) > MOST_WORDS:
            raise ValueError(f"a vocabulary has {MOST_WORDS} words at most")
        self.by_length: dict[int, list[str]] = {}
        for w in sorted(self.words):
            self.by_length.setdefault(len(w), []).append(w)
        self.found: dict[str, str | None] = {}

    def suggestion(self, word: str) -> str | None:
        if word not in self.found:
            close = difflib.get_close_matches(word, self.words, 5, CLOSE)
            near = [w for n in range(max(1, len(word) - BAND), len(word) + BAND + 1) for w in self.by_length.get(n, ())] if not close else []
            rated = [(jaro_winkler(word, w), w) for w in near]
            best = min(rated, key=lambda x: (-x[0], x[1])) if rated else (0.0, "")
            self.found[word] = close[0] if close else best[1] if best[0] >= JARO else None
        return self.found[word]

    def unknown(self, word: str, sure: dict[str, float] | None = None) -> bool:
        known = len(word) < MIN_LENGTH or not word.isalpha() or word[0].isupper() or word.lower() in self.words
        return not known and not (sure and sure.get(word, 1.0) >= 0.85)

    def corrected(self, line: str, sure: dict[str, float] | None = None) -> str:
        out = []
        for token in line.split():
            inner = re.sub(r"^[^a-zA-Z]+|[^a-zA-Z]+$", "", token)
            better = self.suggestion(inner.lower()) if self.unknown(inner, sure) else None
            out.append(token.replace(inner, better, 1) if better and better != inner.lower() else token)
        return " ".join(out)

    def corrected_lines(self, text: str) -> str:
        """Each line corrected, but for short, spelt-out and sign-ridden ones."""
        out = []
        for line in text.split("\n"):
            leave = len(line.split()) < 3 or re.search(r"\b[A-Z]\b(?:\s+[A-Z]\b){2,}", line) or len(re.findall(r"[^\w\s]", line)) > 0.2 * len(line)
            out.append(("" if not line.strip() else line) if leave else self.corrected(line))
        return "\n".join(out)


def corrector(words: Iterable[str], by_line: bool = True):
    """A column function that corrects texts with a vocabulary."""
    vocabulary = Vocabulary(words)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(vocabulary.corrected_lines if by_line else vocabulary.corrected, na_action="ignore")

    return run


def unknown_words(df: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): lower-case words that may be corrected and the vocabulary (word) lacks, with their counts."""
    tokens = df.select(F.explode(F.regexp_extract_all(filled(F.col(text)), F.lit(r"(?U)\S+"), F.lit(0))).alias("token"))
    word = F.regexp_replace("token", "^[^a-zA-Z]+|[^a-zA-Z]+$", "")
    words = tokens.select(word.alias("word")).where((F.length("word") >= MIN_LENGTH) & F.col("word").rlike(r"^\p{L}+$") & ~F.col("word").rlike(r"^\p{Lu}"))
    counted = words.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    return counted.join(vocabulary.select(F.lower("word").alias("word")).distinct(), "word", "left_anti")


def edit_matches(unknown: DataFrame, vocabulary: DataFrame, most: int = 2) -> DataFrame:
    """(word, match, distance): for each word the nearest vocabulary word within ``most`` edits.

    Joined on length and a deletion-free key would miss edits, so words meet by length band (an equi-join on each
    length within reach) and then by Levenshtein distance.
    """
    reach = unknown.select("word", F.explode(F.sequence(F.length("word") - most, F.length("word") + most)).alias("len"))
    known = vocabulary.select(F.lower("word").alias("match")).distinct().withColumn("len", F.length("match"))
    pairs = reach.join(known, "len").withColumn("distance", F.levenshtein("word", "match", most)).where("distance >= 0")
    return pairs.groupBy("word").agg(F.min(F.struct("distance", "match")).alias("m")).select("word", "m.match", "m.distance")


def match_case(original: Column, replacement: Column) -> Column:
    upper = (original == F.upper(original)) & (original != F.lower(original))
    return F.when(upper, F.upper(replacement)).when(original.rlike(r"^\p{Lu}\P{Lu}*$"), F.concat(F.upper(F.substring(replacement, 1, 1)), F.lower(F.substring(replacement, 2, 1 << 30)))).otherwise(replacement)

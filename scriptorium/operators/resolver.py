"""Context fixes within lines, then list markers back on lines of their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import rules
from scriptorium.functions.text import NUMBER_BOUNDARIES, NUMBER_MEETS_LETTER, RN_TO_M, STANDALONE_I, Rules, blank, by_line, capitalised, filled, fold, fold_where_any, let, raised_letter, where_found

RUN_ON: Rules = (("([.!?])([A-Z][a-z])", "$1 $2"), ("(,)([A-Z][a-z]{2,})", "$1 $2"))
PUNCTUATION: Rules = (
    (r"(?U)\s+([.,!?;:])", "$1"), ("([.,!?;:])([A-Za-z0-9])", "$1 $2"), ("([.!?]){2,}", "$1"),
    (r"(?U)\(\s+", "("), (r"(?U)\s+\)", ")"),
)
LIST_MARKERS: Rules = ((r"(?U)(?<=\w)\s+(\d{1,2}[.)]\s+[A-Z])", "\n$1"), (r"(?U)(?<=\w)\s+([-•*]\s+[A-Z])", "\n$1"))


def rn_to_m(c: Column) -> Column:
    return fold(c, RN_TO_M)


def word_fixes(c: Column) -> Column:
    return fold_where_any(c, rules.RESOLVER_WORDS)


def run_on(c: Column) -> Column:
    return fold(c, RUN_ON)


def punctuation(c: Column) -> Column:
    return fold(c, PUNCTUATION)


def standalone_i(c: Column) -> Column:
    return fold(c, STANDALONE_I)


def sentence_case(c: Column) -> Column:
    return capitalised(c, r"(?U:[.!?]\s)", raised_letter)


def list_markers(c: Column) -> Column:
    return where_found(c, r"(?U)\s(?:\d{1,2}[.)]|[-•*])\s+[A-Z]", lambda x: fold(x, LIST_MARKERS))


def number_boundaries(c: Column) -> Column:
    return where_found(c, NUMBER_MEETS_LETTER, lambda x: fold(x, NUMBER_BOUNDARIES))


def resolve_line(line: Column) -> Column:
    fixed = sentence_case(standalone_i(punctuation(run_on(word_fixes(rn_to_m(line))))))
    return F.when(blank(line), F.lit("")).otherwise(number_boundaries(fixed))


def resolve(c: Column) -> Column:
    return let(filled(c), lambda x: F.when(blank(x), x).otherwise(list_markers(by_line(x, resolve_line))))

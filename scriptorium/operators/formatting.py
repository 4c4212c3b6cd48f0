"""Layout of corrected text by kind: plain and letter, list, form."""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import rules
from scriptorium.functions.text import blank, by_line, filled, fold, stripped, sub
from scriptorium.operators.postprocess import split_lines


def output_kind(c: Column) -> Column:
    """letter, form, list or plain."""
    c = filled(c)
    low = F.lower(c)
    letter = F.lit(False)
    for word in rules.LETTER_WORDS:
        letter = letter | low.contains(word)
    fields = sum((low.contains(w).cast("int") for w in rules.FORM_WORDS), F.lit(0))
    rows = F.when(c == "", F.array().cast("array<string>")).otherwise(split_lines(c))
    marked = F.size(F.filter(rows, lambda x: stripped(x).rlike(r"(?U)^\s*(\d+[.)]\s|[-•*]\s)")))
    is_list = (F.size(rows) > 3) & (marked / F.greatest(F.size(rows), F.lit(1)) > 0.4)
    return F.when(letter, "letter").when(fields >= 2, "form").when(is_list, "list").otherwise("plain")


def plain(c: Column) -> Column:
    """Paragraphs without white space at their ends, apart by one blank line; runs of spaces within become one."""
    paragraphs = F.transform(F.split(filled(c), r"\n{2,}", -1), lambda p: sub(stripped(p), "  +", " "))
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n")


def listed(c: Column) -> Column:
    """Lines without trailing white space, one blank line at most between them, none at the ends."""
    rows = F.transform(split_lines(filled(c)), lambda x: sub(x, r"(?U)\s+\z"))
    return fold(F.array_join(rows, "\n"), ((r"\n{3,}", "\n\n"), (r"\A\n+|\n+\z", "")))


def form(c: Column) -> Column:
    """Every label on a line of its own."""
    broken = sub(filled(c), r"(?U)(?<!\n)([A-Z][a-zA-Z\s]{1,20}:)", "\n$1")
    rows = F.transform(split_lines(broken), stripped)
    return fold(F.array_join(rows, "\n"), ((r"\n{3,}", "\n\n"), (r"\A\n+|\n+\z", "")))


def formatted(c: Column, kind: Column) -> Column:
    return F.when(kind == "list", listed(c)).when(kind == "form", form(c)).otherwise(plain(c))


def wrap_rows(df, width: int, text: str = "text"):
    """One row a rendered line: (is_blank, text, indent, line_no); long lines wrapped, the indent on the first piece."""
    @F.pandas_udf("array<struct<is_blank boolean, text string, indent int>>")
    def laid(texts: pd.Series) -> pd.Series:
        def one(value: str | None) -> list[dict]:
            rows = []
            for line in (value or "").split("\n"):
                body = line.rstrip().lstrip(" \t")
                if not body.strip():
                    rows.append({"is_blank": True, "text": "", "indent": 0})
                    continue
                pieces = [body] if len(body) <= width else textwrap.wrap(body, width)
                rows += [{"is_blank": False, "text": p, "indent": 0 if i else len(line.rstrip()) - len(body)} for i, p in enumerate(pieces)]
            return rows

        return texts.map(one)

    keep = [x for x in df.columns if x != text]
    return df.select(*keep, F.posexplode(laid(F.col(text))).alias("line_no", "line")).select(*keep, "line_no", "line.*")


def emptied(c: Column) -> Column:
    """White-space lines made empty."""
    return by_line(c, lambda x: F.when(blank(x), F.lit("")).otherwise(x))

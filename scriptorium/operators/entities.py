"""Entities in text: e-mail, phone, date, URL, currency and postal codes, cleaned and without repeats."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import rules
from scriptorium.functions.text import filled, let, stripped, sub

KINDS = ("email", "phone", "date", "url", "currency")
_EMAIL = r"^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}$"


#: What may come first in a match, looked at before its pattern; an e-mail address starts where its characters do, or a match has ended.
_STARTS = {"email": r"(?:\G|(?<![a-zA-Z0-9._%+\-]))", "phone": r"(?=[+\s\-\d])", "date": r"(?=[\dJFMASOND])", "zipcode": r"(?=\d)"}


def matches(c: Column, kind: str, group: int = 0) -> Column:
    return F.regexp_extract_all(filled(c), F.lit("(?iuU)" + _STARTS.get(kind, "") + rules.ENTITY[kind]), F.lit(group))


def cleaned(kind: str, x: Column) -> Column:
    """A match in its normal form; empty if it is not valid."""
    x = stripped(x)
    if kind == "email":
        return F.when(F.lower(x).rlike(_EMAIL), F.lower(x)).otherwise("")
    if kind == "phone":
        kept = stripped(sub(x, r"(?U)[^\d\s\-+().x]"))
        return F.when(F.length(sub(kept, r"(?U)\D")) >= 7, kept).otherwise("")
    if kind == "date":
        return stripped(sub(x, r"[.,;:]+$"))
    if kind == "url":
        bare = stripped(sub(x, r"[.,;:!?)\]>]+$"))
        return F.when(bare.startswith("http"), bare).otherwise("")
    if kind == "currency":
        return sub(x, r"(?U)([$€£¥₹])\s+(\d)", "$1$2")
    digits = sub(x, r"(?U)\D")
    value = F.expr("0") + F.coalesce(F.try_to_number(F.when(digits.rlike("^[0-9]{5,6}$"), digits), F.lit("999999")).cast("int"), F.lit(-1))
    good = ((F.length(digits) == 6) & value.between(100000, 999999)) | ((F.length(digits) == 5) & value.between(501, 99950))
    return F.when(x.rlike(r"(?U)^\d{5}-\d{4}$"), x).when(good, digits).otherwise("")


def first_of_each(values: Column) -> Column:
    """Values whose lower case has not come before, in order; empty ones go."""
    first = lambda kept, lower: F.filter(kept, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)
    return let(F.filter(values, lambda x: x != ""), lambda kept: let(F.transform(kept, F.lower), lambda lower: first(kept, lower)))


def zipcodes(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(matches(c, "zipcode"), lambda x: cleaned("zipcode", x)), lambda x: x != "")))


def entity(c: Column, kind: str, whole: bool = False, zips: Column | None = None) -> Column:
    """All entities of a kind.  ``whole`` gives currency amounts; without it, as by default, their symbols only.

    ``zips``, if they are known already, are the text's postal codes, which are no phone numbers.
    """
    if kind == "zipcode":
        return zipcodes(c)
    group = 1 if kind in ("phone", "date") or (kind == "currency" and not whole) else 0
    values = F.transform(matches(c, kind, group), lambda x: cleaned(kind, x))
    if kind != "phone":
        return first_of_each(values)
    apart = lambda z: first_of_each(F.filter(values, lambda x: ~F.array_contains(z, x)))
    return let(zipcodes(c), apart) if zips is None else apart(zips)


def entity_map(c: Column, whole: bool = False) -> Column:
    """Every kind with its entities; postal codes come first."""
    pairs = lambda z: [F.lit("zipcode"), z, *(x for kind in KINDS for x in (F.lit(kind), entity(c, kind, whole, z)))]
    return let(zipcodes(c), lambda z: F.create_map(*pairs(z)))


def summary(entities: Column) -> Column:
    """KIND: up to five values, a line a kind; a fixed sentence for none."""

    def row(kind: str, v: Column) -> Column:
        return F.when(F.size(v) > 0, F.concat(F.lit(kind.upper() + ": "), F.array_join(F.slice(v, 1, 5), ", "), F.when(F.size(v) > 5, "…").otherwise("")))

    text = let(entities, lambda found: F.concat_ws("\n", *(row(kind, F.element_at(found, kind)) for kind in ("zipcode", *KINDS))))
    return let(text, lambda t: F.when(t == "", "No entities detected.").otherwise(t))


def long_form(df: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """(key, etype, ord, value), one row an entity."""
    found = df.select(key, F.explode(entity_map(F.col(text), whole)).alias("etype", "values"))
    return found.select(key, "etype", F.posexplode("values").alias("ord", "value"))


def with_positions(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, etype, value, start, end) of every match, repeats and all; offsets in code points, end exclusive."""
    patterns = {k: re.compile(p, re.I) for k, p in rules.ENTITY.items()}

    @F.pandas_udf("array<struct<etype string, value string, start int, end int>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"etype": k, "value": m.group(), "start": m.start(), "end": m.end()} for k, p in patterns.items() for m in p.finditer(t or "")])

    rows = df.select(key, F.explode(found(F.col(text))).alias("m")).select(key, "m.*")
    value = F.lit(None).cast("string")
    for kind in rules.ENTITY:
        value = F.when(F.col("etype") == kind, cleaned(kind, F.col("value"))).otherwise(value)
    return rows.withColumn("value", value).where("value <> ''")

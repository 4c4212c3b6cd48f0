"""Line-by-line cleaning: control characters, ligatures, noise, misread signs, run-together words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import rules
from scriptorium.functions.text import NUMBER_BOUNDARIES, NUMBER_MEETS_LETTER, Rules, blank, by_line, filled, fold, let, letters, stripped, sub, where_found

LONE_NOISE: Rules = ((r"(?U)(?<!\S)[^a-zA-Z0-9$€£¥₹.,!?;:'\-\"](?!\S)", ""),)
HYPHEN_BREAK: Rules = ((r"(?U)(\w)-\s{2,}(\w)", "$1$2"),)
MERGED_WORDS: Rules = ((rf"({rules.MERGED_PREFIXES})([A-Z][a-z])", "$1 $2"), ("([a-z])([A-Z][a-z])", "$1 $2"))


def control_chars(c: Column) -> Column:
    return sub(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def ligatures(c: Column) -> Column:
    def change(c: Column) -> Column:
        for wrong, right in rules.LIGATURES.items():
            c = F.replace(c, F.lit(wrong), F.lit(right))
        return c

    return where_found(c, r"[|\x{80}-\x{10FFFF}]", change)


def lone_noise(c: Column) -> Column:
    return fold(c, LONE_NOISE)


def hyphen_break(c: Column) -> Column:
    return where_found(c, r"(?U)-\s\s", lambda x: fold(x, HYPHEN_BREAK))


def exclamation(c: Column) -> Column:
    """! for l or I inside words; tokens that are nothing but ! have no letter beside them and stay."""
    return where_found(c, "!", lambda x: fold(x, rules.EXCLAMATION))


def number_boundaries(c: Column) -> Column:
    return where_found(c, NUMBER_MEETS_LETTER, lambda x: fold(x, NUMBER_BOUNDARIES))


def merged_words(c: Column) -> Column:
    return where_found(c, "[a-zA-Z][A-Z][a-z]", lambda x: fold(x, MERGED_WORDS))


def ambiguous(c: Column) -> Column:
    """Digits that stand for letters within mostly alphabetic tokens; tokens are joined by single spaces."""
    tokens = F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0))
    inner = lambda t: sub(t, "^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$")
    share_of = lambda inside: letters(inside) / F.greatest(F.length(inside), F.lit(1))

    def changed(tok: Column, inside: Column, share: Column) -> Column:
        kept = tok.rlike(r"^[0-9][0-9.,]+$") | tok.contains("@") | tok.contains("://") | (F.length(inside) < 2) | (share < 0.5)
        out = F.when(inside.contains("0") & ~inside.rlike("[1-9]"), F.replace(tok, F.lit("0"), F.lit("O"))).otherwise(tok)
        out = F.when(inside.rlike(r"^1\p{L}"), sub(out, "^([^1]*)1", "$1I")).when(inside.rlike(r"\p{L}1$"), sub(out, "1([^1]*)$", "l$1")).otherwise(out)
        out = sub(out, "(?<=[a-zA-Z])1(?=[a-zA-Z])", "l")
        out = F.when(inside.rlike(r"^5\p{L}.") & (F.length(inside) > 2), sub(out, "^([^5]*)5", "$1S")).otherwise(out)
        out = F.when(inside.contains("6") & (share > 0.7), sub(out, "(?<=[a-zA-Z])6(?=[a-zA-Z])", "G")).otherwise(out)
        return F.when(kept, tok).otherwise(out)

    # only tokens with a letter and one of these digits can change
    rated = lambda t: let(inner(t), lambda inside: let(share_of(inside), lambda share: changed(t, inside, share)))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("[0156]") & t.rlike(r"[a-zA-Z\p{L}]"), rated(t)).otherwise(t)), " ")


def rebuild_paragraphs(c: Column) -> Column:
    """White-space lines emptied, runs of them made one, none at either end."""
    emptied = by_line(c, lambda x: F.when(blank(x), F.lit("")).otherwise(x))
    return fold(emptied, ((r"\n{3,}", "\n\n"), (r"\A\n+|\n+\z", "")))


def clean_line(line: Column) -> Column:
    """One line after all fixes, its indent kept; null if nothing is left of it."""
    fixed = merged_words(number_boundaries(ambiguous(exclamation(hyphen_break(lone_noise(ligatures(control_chars(line))))))))
    fixed = sub(stripped(fixed), r"[ \t]+", " ")
    kept = F.concat(F.regexp_extract(line, r"(?U)^(\s*)", 1), fixed)
    # the indent joins the fixed text, so what is blank then was emptied by the fixes
    return F.when(blank(line), F.lit("")).otherwise(let(kept, lambda x: F.when(~blank(x), x)))


def clean(c: Column, speller=None, confidence: Column | None = None) -> Column:
    """All cleaning steps; ``speller`` maps a line to a spell-checked one and applies below confidence 0.82."""
    unix = F.replace(F.replace(filled(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    line = clean_line
    if speller is not None and confidence is not None:
        line = lambda x: F.when(confidence < 0.82, speller(clean_line(x))).otherwise(clean_line(x))
    return F.when(blank(filled(c)), F.lit("")).otherwise(rebuild_paragraphs(by_line(unix, line)))

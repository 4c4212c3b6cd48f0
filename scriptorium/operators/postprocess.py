"""Post-processing of recognised text: kind of document, garbage, structure, words, paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import rules
from scriptorium.functions.text import NUMBER_BOUNDARIES, NUMBER_MEETS_LETTER, SINGLE_SPACES, STANDALONE_I, Rules, blank, by_line, capitalised, filled, fold, fold_where_any, let, letter_share, lines, stripped, sub, title_word, where_found, words

#: Found where a rule of POST_CHARS may match, and where one of word spacing may.
POST_CHAR = r"(?U)[|\x{80}-\x{10FFFF}]|(?m:^l )|L(?!\w)|Dear \w+,\s"
SPACED = rf"[.!?,;:)\]][A-Za-z]|{NUMBER_MEETS_LETTER}|  "
SPACING: Rules = (("([.!?])([A-Za-z])", "$1 $2"), ("([,;:])([A-Za-z])", "$1 $2"))
BRACKETS: Rules = ((r"([)\]])([A-Za-z])", "$1 $2"),)
STRUCTURE: Rules = (
    (r"(?<!\n)\n(?!\n)", " "), ("  +", " "), (r"(?U)^\s+|\s+$", ""),
    (r"(?U)(\b\d{6}\b)\s+", "$1\n\n"),
    (rf"(?iuU)\s+(\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{rules.MONTH_WORDS})\s+\d{{2,4}})", "\n\n$1"),
    (r"(?U)\s+(Dear\s+[A-Z][a-z]+[,.]?)", "\n\n$1"),
    (r"(?iuU)\s+(With\s+(?:lots|love|warm|kind)\s+of\s+\w+[,.]?|Yours\s+\w+[,.]?|Sincerely[,.]?|Regards[,.]?|Take\s+care[,.]?|Best\s+wishes[,.]?)", "\n\n$1"),
    (rf"(?U)([.!?])\s+((?:{rules.PARAGRAPH_STARTS}))", "$1\n\n$2"),
    (r"\n{3,}", "\n\n"), (r"(?U)^\s+|\s+$", ""),
)
NOTES_HEADERS: Rules = (
    (r"(?U)\bQ\s*[lIi.]*\s*1\b", "Q1."), (r"(?U)\bQ\s*[lIi]\b(?!\w)", "Q1."), (r"(?U)\bQ\s*\.\s*1\b", "Q1."),
    *((rf"(?U)\bQ\s*{n}\s*[:.]\s*", f"Q{n}. ") for n in (1, 2, 3)), (r"(?U)(?<!\n)(Q\d+\.)", "\n$1"),
)
NOTES_STRUCTURE: Rules = (
    (r"(?U)(?<!\n)(\s*)(\d{1,2}[).]\s+)(?=[A-Z])", "\n$2"), (r"(?iuU)(?<!\n)(def\s*[°^on.]*\s*[-:–]\s*)", "\ndef. — "),
    (r"(?U)(?<!\n)([→➔]\s*)", "\n$1"), (r"(?U)(?<!\n)([A-Z][a-z]+ (?:of|for|by) [a-z]+\s*:-)", "\n$1"), (r"\n{3,}", "\n\n"),
)


def document_kind(c: Column) -> Column:
    """notes, letter or generic, by the signs found."""
    c = filled(c)
    notes, letter = F.regexp_count(c, F.lit(rules.NOTES_SIGNAL)), F.regexp_count(c, F.lit(rules.LETTER_SIGNAL))
    return F.when(notes >= 2, "notes").when(letter >= 2, "letter").when(notes >= 1, "notes").otherwise("generic")


def garbage_free(c: Column) -> Column:
    """Lines that look like text: structural, starting with a capitalised word, or alphabetic enough."""

    def keep(line: Column) -> Column:
        text = stripped(line)
        enough = F.when(F.length(text) >= 12, letter_share(text) >= 0.35).otherwise((F.length(text) >= 3) & (letter_share(text) >= 0.55))
        return blank(line) | text.rlike(rules.KEPT_LINE) | title_word(text, 3) | enough

    return F.array_join(F.filter(lines(filled(c)), keep), "\n")


def recognised_lines(c: Column) -> Column:
    """The recogniser's own filter: rn to m, then short, structural, capitalised or at least 20 % alphabetic lines."""

    def keep(line: Column) -> Column:
        text = stripped(line)
        return blank(line) | text.rlike(rules.KEPT_OCR_LINE) | title_word(text, 2, loose=True) | (F.length(text) <= 8) | (letter_share(text) >= 0.2)

    fixed = sub(filled(c), "(?<=[a-z])rn(?=[a-z])", "m")
    return F.array_join(F.filter(split_lines(fixed), keep), "\n")


def split_lines(c: Column) -> Column:
    """Lines at every kind of line end; a final end makes no empty line."""
    return F.split(sub(c, "(?:\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ])\\z"), "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", -1)


def reconstructed(c: Column) -> Column:
    """Paragraph breaks around codes, dates, openings and closings, unless the text has breaks already."""
    c = filled(c)
    return F.when(c.contains("\n\n"), c).otherwise(fold(c, STRUCTURE))


def chars(c: Column) -> Column:
    return fold(where_found(c, POST_CHAR, lambda x: fold(x, rules.POST_CHARS)), SINGLE_SPACES)


def academic(c: Column) -> Column:
    return fold_where_any(c, rules.ACADEMIC)


def notes_headers(c: Column) -> Column:
    return fold(c, NOTES_HEADERS)


def notes_structure(c: Column) -> Column:
    return fold(c, NOTES_STRUCTURE)


def word_fixes(c: Column) -> Column:
    return fold(fold_where_any(c, rules.POST_WORDS), STANDALONE_I)


def common_errors(c: Column) -> Column:
    return fold_where_any(c, rules.COMMON_ERRORS)


def names(c: Column) -> Column:
    return fold_where_any(c, rules.NAMES)


def merged_words(c: Column) -> Column:
    """Run-together words apart, then camel case within words of five ASCII letters and more."""

    def apart(c: Column) -> Column:
        parts = F.regexp_extract_all(c, F.lit(r"(?U)(?s)(\w+|\W+)"), F.lit(0))
        camel = F.transform(parts, lambda w: F.when(w.rlike("^[A-Za-z]{5,}$") & (w != F.upper(w)), sub(w, "([a-z])([A-Z])", "$1 $2")).otherwise(w))
        return F.array_join(camel, "")

    return where_found(fold_where_any(c, rules.MERGED), "[a-z][A-Z]", apart)


def word_spacing(c: Column, brackets: bool = True) -> Column:
    """Spaces after signs and between numbers and letters, line by line; without the bracket rule for PDF text."""
    chain = SPACING + (BRACKETS if brackets else ()) + NUMBER_BOUNDARIES + SINGLE_SPACES
    return by_line(filled(c), lambda x: where_found(x, SPACED, lambda y: F.when(blank(y), y).otherwise(fold(y, chain))))


def trailing_garbage_free(c: Column) -> Column:
    """Nothing after the last closing line but up to two short, alphabetic lines without digits."""
    return let(filled(c), _without_trail)


def _without_trail(c: Column) -> Column:
    rows = F.transform(lines(c), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    closings = F.transform(F.filter(rows, lambda s: s["x"].rlike(rules.CLOSING_LINE)), lambda s: s["i"])

    def cut(last: Column) -> Column:
        def keep(s: Column) -> Column:
            name = words(s["x"]).between(1, 3) & (letter_share(stripped(s["x"])) >= 0.7) & ~s["x"].rlike(r"(?U)\d")
            return (s["i"] <= last) | ((s["i"] <= last + 2) & (blank(s["x"]) | name))

        kept = F.transform(F.filter(rows, keep), lambda s: F.when((s["i"] > last) & blank(s["x"]), F.lit("")).otherwise(s["x"]))
        return F.when(last.isNull(), c).otherwise(F.array_join(kept, "\n"))

    return let(F.array_max(closings), cut)


def notes_paragraphs(c: Column) -> Column:
    """Paragraphs of notes: blank lines out, line ends kept."""
    return F.filter(
        F.transform(F.split(stripped(c), r"\n{2,}", -1), lambda p: F.array_join(F.transform(F.filter(lines(p), lambda x: ~blank(x)), lambda x: sub(x, r"(?U)\s+\z")), "\n")), lambda p: p != ""
    )


DATE = r"[0-9]{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]{1,9}\.?\s+1?20[0-9]{2}"
DATE_PARTS = r"(?iU)^([0-9]{1,2}(?:st|nd|rd|th)?)\s+([A-Za-z]{1,9})\.?\s+1?(20[0-9]{2})$"


def repaired_dates(c: Column) -> Column:
    """Dates written day, month, year: the month spelt out (May for its usual misreadings), 12023 read as 2023.

    The text is cut, without loss, into dates, digits and what lies between; only dates change.
    """
    known = rules.MONTH_OF | dict.fromkeys(rules.MISREAD_MAY, "May")
    months = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    heads = F.create_map(*(F.lit(x) for m in rules.MONTHS for x in (m[:3].lower(), m)), F.lit("nay"), F.lit("May"), F.lit("way"), F.lit("May"))

    def repair(part: Column) -> Column:
        day, word, year = (F.regexp_extract(part, DATE_PARTS, i) for i in (1, 2, 3))
        month = let(F.lower(word), lambda w: F.coalesce(F.try_element_at(months, w), F.try_element_at(heads, F.when(F.length(w) > 2, F.substring(w, 1, 3))), F.initcap(w)))
        return F.when(part.rlike(DATE_PARTS), F.concat_ws(" ", day, month, year)).otherwise(part)

    parts = lambda x: F.regexp_extract_all(x, F.lit(rf"(?iU)({DATE}|[^0-9]+|[0-9])"), F.lit(1))
    dated = where_found(filled(c), f"(?iU){DATE}", lambda x: F.array_join(F.transform(parts(x), repair), ""))
    return sub(dated, r"(?U)(?=1)\b1(202[0-9])\b", "$1")


# What tells addresses, dates, openings and closings among paragraphs.
_CODE = re.compile(r"\b\d{5,6}\b")
_PLACE = re.compile(r"\b(Road|Street|Avenue|Nagar|Colony|Residency|Flat|House|Block|Sector|Phase|Floor|Wing|MG|RC|Lane|Park)\b", re.I)
_FULL = "|".join(rules.MONTHS)
_DATED = re.compile(rf"\b(\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{rules.MONTH_WORDS})\s+\d{{2,4}}|(?:{_FULL})\s+\d{{1,2}},?\s+\d{{2,4}})\b", re.I)
_OPENING = re.compile(r"(Dear|Hi|Hello|To\s+Whom)\b", re.I)
_CLOSING = re.compile(r"(Yours|Sincerely|Regards|Best|With\s+(love|lots|warm|kind|regards)|Take\s+care|Warm|Love|Faithfully)\b", re.I)
_OPENED = re.compile(r"((?:Dear|Hi|Hello)\s+[A-Za-z]+[,.]?)\s+(.*)", re.I | re.S)
_CLOSED = re.compile(r"((?:Yours|With\s+\w[\w\s]*|Sincerely|Regards|Best[\w\s]*|Warm[\w\s]*|Take\s+care|Love)[^,\n]*[,.]?)\s*,?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)$", re.I)


def letter_parts(text: str) -> list[str]:
    """Paragraphs of a letter: address blocks whole, leading dates, openings and closings on their own."""
    out: list[str] = []
    for block in re.split(r"\n{2,}", text.strip()):
        rows = [r for r in map(str.strip, block.split("\n")) if r]
        while rows:
            whole = " ".join(rows)
            if len(rows) <= 4 and len(whole.split()) <= 14 and (_CODE.search(whole) or _PLACE.search(whole)):
                out.append("\n".join(rows))
                break
            if len(rows[0].split()) <= 6 and _DATED.search(rows[0]):
                out.append(rows.pop(0))
                continue
            apart = _OPENED.match(whole) if _OPENING.match(whole) else _CLOSED.match(whole) if _CLOSING.match(whole) else None
            pair = [p.strip() for p in apart.groups()] if apart else []
            out += pair if pair and all(pair[1:]) else [whole]
            break
    return out


def letter_paragraphs(df: DataFrame, text: str, parts: str) -> DataFrame:
    """``df`` with the paragraphs of its column ``text``, null for null; an operator of its own, so Python stays out of SQL lambdas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if t is None else letter_parts(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, parts])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(parts, T.ArrayType(T.StringType()))]))


def polished(paragraphs: Column) -> Column:
    """Spaces and capitals of paragraphs; empty ones go."""

    def one(p: Column) -> Column:
        p = by_line(p, lambda x: stripped(sub(x, "  +", " ")))
        p = fold(p, ((" ([,!?;:])", "$1"), ("([,!?;:])([A-Za-z])", "$1 $2")))
        return stripped(capitalised(p, "[.!?] "))

    return F.filter(F.transform(paragraphs, one), lambda p: p != "")


def vocabulary_share(c: Column, vocabulary: Column) -> Column:
    """Share of the words of two ASCII letters and more that the vocabulary (an array) holds; 0 for none."""
    found = F.regexp_extract_all(filled(c), F.lit(r"(?U)\b[a-zA-Z]{2,}\b"), F.lit(0))
    hits = F.size(F.filter(found, lambda w: F.array_contains(vocabulary, F.lower(w))))
    return F.when(F.size(found) > 0, hits / F.greatest(F.size(found), F.lit(1))).otherwise(F.lit(0.0))


def notes_text(c: Column) -> Column:
    """Everything done to lecture notes, but for the paragraphs."""
    return notes_structure(names(word_spacing(merged_words(common_errors(word_fixes(repaired_dates(notes_headers(academic(chars(garbage_free(c)))))))))))


def letter_text(c: Column) -> Column:
    """Everything done to letters and other texts, but for the paragraphs."""
    return trailing_garbage_free(names(word_spacing(merged_words(common_errors(word_fixes(repaired_dates(chars(reconstructed(c)))))))))


def processed(df, text: str = "text", vocabulary: tuple[str, ...] = ()):
    """``df`` with doc_type, post_text, confidence, confidence_pct and paragraphs of its column ``text``."""
    kind = F.when(blank(filled(F.col(text))), F.lit(None).cast("string")).otherwise(document_kind(F.col(text)))
    notes = F.when(F.col("doc_type") == "notes", notes_paragraphs(notes_text(F.col(text))))
    # one pass for all kinds: each text meets the chain of its own kind, and notes go by Python as nulls
    out = df.withColumn("doc_type", kind).withColumn("__text", F.when(F.col("doc_type") != "notes", letter_text(F.col(text))))
    out = letter_paragraphs(out, "__text", "__parts").withColumn("__parts", F.coalesce(notes, F.col("__parts"), F.array().cast("array<string>"))).drop("__text")
    out = out.withColumn("post_text", F.array_join(polished(F.col("__parts")), "\n\n")).drop("__parts")
    share = vocabulary_share(F.col("post_text"), F.array(*map(F.lit, vocabulary)).cast("array<string>"))
    return out.withColumns({"confidence": F.round(share, 4), "confidence_pct": F.round(share * 100, 1), "paragraphs": F.filter(F.split("post_text", "\n\n", -1), lambda p: ~blank(p))})

"""Registered queries of the document-text operators, each beside its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import rules, text
from scriptorium.operators import classify, cleaner, ensemble, entities, formatting, fuzzy, postprocess, quality, resolver, signal
from scriptorium.plans import pipeline, render
from scriptorium.plans.render import LETTERS_SQL, NOISY_SQL, NOTES_SQL, table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def T():
    return F.col("text")


DOCS_SQL = "SELECT doc_id, text FROM documents"
SOURCES = {"documents": DOCS_SQL, "letters": LETTERS_SQL, "notes": NOTES_SQL, "noisy": NOISY_SQL}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "documents":
        return table(spark, sf_dir, "documents").select("doc_id", "text")
    return getattr(render, name)(spark, sf_dir)


def column_query(name: str, of: str, outputs: Callable[[], dict], sql: str | None = None) -> None:
    """A query of doc_id and expressions over one text source; ``sql`` is the select list over (doc_id, text)."""
    _queries[name] = lambda spark, sf_dir: source(spark, sf_dir, of).select("doc_id", *(c.alias(k) for k, c in outputs().items()))
    if sql:
        _oracles[name] = f"SELECT doc_id, {sql} FROM ({SOURCES[of]}) s"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return add


# --- SQL building blocks -------------------------------------------------------------------------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_sub(expr: str, *steps: tuple[str, str], flags: str = "g") -> str:
    for pattern, to in steps:
        expr = f"regexp_replace({expr}, {q(pattern)}, {q(to)}, {q(flags)})"
    return expr


def sql_score(t: str) -> str:
    size = f"length(replace(replace({t}, ' ', ''), chr(10), ''))"
    return f"CASE WHEN {size} > 0 THEN least(length({sql_sub(t, (r'[^\p{L}]', ''))})::double / {size}, 1.0) ELSE 0.0 END"


def sql_words(t: str) -> str:
    return f"len(regexp_extract_all({t}, '\\S+'))"


def sql_lines(t: str, change: str, keep: str = "true") -> str:
    """Lines x of t that satisfy ``keep``, each replaced by ``change``."""
    return f"array_to_string(list_transform(list_filter(string_split({t}, chr(10)), lambda x: {keep}), lambda x: {change}), chr(10))"


SQL_NOISY = f"({sql_words('text')} < 3 OR regexp_matches(text, '\\b[A-Z]\\b(\\s+[A-Z]\\b){{2,}}') OR len(regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]')) > length(text) * 0.15)"
SQL_STRIP = lambda x: sql_sub(x, (r"^\s+|\s+$", ""))
SQL_SHARE = lambda x: f"length({sql_sub(x, (r'[^\p{L}]', ''))})::double / greatest(length({x}), 1)"
NEWLINES = r"\n{3,}"

# --- measures ------------------------------------------------------------------------------------------------------

column_query("text_score", "documents", lambda: {"score": text.score(T())}, f"{sql_score('text')} AS score")
column_query("word_count", "documents", lambda: {"words": text.words(T()).cast("long")}, f"{sql_words('text')} AS words")
column_query("is_noisy", "documents", lambda: {"noisy": text.noisy(T())}, f"{SQL_NOISY} AS noisy")


def _other():
    """The text without digits and bars, as a second reading."""
    return text.sub(T(), "[0-9|]")


_sql_other = sql_sub("text", ("[0-9|]", ""))
column_query(
    "choose_better", "documents", lambda: {"better": ensemble.better_of_two(T(), _other())},
    f"CASE WHEN {sql_score('text')} * (1 + 0.01 * {sql_words('text')}) >= {sql_score(_sql_other)} * (1 + 0.01 * {sql_words(_sql_other)}) THEN text ELSE {_sql_other} END AS better",
)
column_query("normalized_whitespace", "documents", lambda: {"out": text.normalize_whitespace(T())}, SQL_STRIP(sql_sub("text", (r"[ \t]+", " "), (NEWLINES, "\n\n"))) + " AS out")
column_query(
    "correction_gate", "documents", lambda: {"needs": quality.needs_correction(T(), F.lit(1.0))},
    f"({SQL_NOISY} OR least(1.0, {sql_score('text')}) < 0.65 OR {sql_score('text')} < 0.70) AS needs",
)

# --- best of several -----------------------------------------------------------------------------------------------


@query(f"""
WITH c AS (SELECT doc_id, 0 AS ord, text FROM documents UNION ALL SELECT doc_id, 1, {_sql_other} FROM documents UNION ALL SELECT doc_id, 2, {sql_sub("text", ("[|]", "I"))} FROM documents),
v AS (SELECT *, {sql_score("text")} * (1 + 0.005 * {sql_words("text")}) AS v FROM c WHERE regexp_matches(text, '\\S'))
SELECT d.doc_id, coalesce(b.text, '') AS text FROM documents d LEFT JOIN
 (SELECT doc_id, text FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, ord) = 1) b USING (doc_id)""")
def best_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    readings = F.array(*(F.struct(F.lit(i).alias("ord"), c.alias("text")) for i, c in enumerate((T(), _other(), text.sub(T(), "[|]", "I")))))
    return ensemble.best_reading(docs.select("doc_id", F.inline(readings)))


_a, _b = f"({sql_score('text')} * (1 + 0.005 * {sql_words('text')}) * 0.45)", f"({sql_score(_sql_other)} * (1 + 0.005 * {sql_words(_sql_other)}) * 0.35)"
column_query(
    "weighted_merge", "documents", lambda: {"merged": ensemble.weighted_merge(T(), _other())},
    f"CASE WHEN NOT regexp_matches(text, '\\S') THEN {_sql_other} WHEN NOT regexp_matches({_sql_other}, '\\S') THEN text WHEN abs({_a} - {_b}) < 0.05 THEN text || chr(10) || {_sql_other} WHEN {_a} >= {_b} THEN text ELSE {_sql_other} END AS merged",
)

# --- cleaning ------------------------------------------------------------------------------------------------------

column_query("control_chars", "documents", lambda: {"out": cleaner.control_chars(T())}, sql_sub("text", (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")) + " AS out")
_sql_ligatures = "text"
for _wrong, _right in rules.LIGATURES.items():
    _sql_ligatures = f"replace({_sql_ligatures}, {q(_wrong)}, {q(_right)})"
column_query("ligatures", "documents", lambda: {"out": cleaner.ligatures(T())}, f"{_sql_ligatures} AS out")
# two passes, as neighbouring matches share a space there; the negated class leaves white space out, so runs of three spaces must not occur
_noise = (r"(^|\s)[^a-zA-Z0-9$€£¥₹.,!?;:'\-" + '"' + r"\s](\s|$)", r"\1\2")
column_query("lone_noise", "documents", lambda: {"out": cleaner.lone_noise(T())}, sql_sub("text", _noise, _noise) + " AS out")
column_query("hyphen_break", "documents", lambda: {"out": cleaner.hyphen_break(T())}, sql_sub("text", (r"([\p{L}\p{N}_])-\s{2,}([\p{L}\p{N}_])", r"\1\2")) + " AS out")
_sql_numbers = (
    "array_to_string(list_transform(regexp_extract_all({t}, '[0-9]+[a-zA-Z]*|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]+[a-zA-Z]+$') AND NOT regexp_matches(x, '^[0-9]+(st|nd|rd|th)$', 'i') "
    "THEN regexp_replace(x, '^([0-9]+)', '\\1 ') ELSE x END), '')"
)
_SQL_LETTER_DIGIT = ("([a-zA-Z]{2,})([0-9])", r"\1 \2")
column_query("number_boundaries", "documents", lambda: {"out": cleaner.number_boundaries(T())}, sql_sub(_sql_numbers.format(t="text"), _SQL_LETTER_DIGIT) + " AS out")
column_query("merged_words", "documents", lambda: {"out": cleaner.merged_words(T())}, sql_sub("text", (f"({rules.MERGED_PREFIXES})([A-Z][a-z])", r"\1 \2"), ("([a-z])([A-Z][a-z])", r"\1 \2")) + " AS out")
column_query("exclamation", "noisy", lambda: {"out": cleaner.exclamation(T())}, sql_sub("text", ("([a-z])!([a-z])", r"\1l\2")) + " AS out")
column_query("ambiguous", "noisy", lambda: {"out": text.by_line(T(), cleaner.ambiguous)})
column_query("rebuild_paragraphs", "letters", lambda: {"out": cleaner.rebuild_paragraphs(T())}, sql_sub(sql_lines("text", "CASE WHEN regexp_matches(x, '\\S') THEN x ELSE '' END"), (NEWLINES, "\n\n"), (r"^\n+|\n+$", "")) + " AS out")
column_query("clean", "documents", lambda: {"out": cleaner.clean(T())})
column_query("clean_noisy", "noisy", lambda: {"out": cleaner.clean(T())})

# --- resolving -----------------------------------------------------------------------------------------------------

_RN = ("([a-z])rn([a-z])", r"\1m\2")
column_query("rn_to_m", "documents", lambda: {"out": resolver.rn_to_m(T())}, sql_sub("text", _RN, _RN) + " AS out")
_sql_words_fixed = sql_sub("text", *((p.removeprefix("(?iuU)"), r) for p, r in rules.RESOLVER_WORDS), flags="gi")
column_query("resolver_words", "noisy", lambda: {"out": resolver.word_fixes(T())}, f"{_sql_words_fixed} AS out")
column_query("run_on", "letters", lambda: {"out": resolver.run_on(T())}, sql_sub("text", ("([.!?])([A-Z][a-z])", r"\1 \2"), ("(,)([A-Z][a-z]{2,})", r"\1 \2")) + " AS out")
column_query(
    "punctuation", "documents", lambda: {"out": resolver.punctuation(T())},
    sql_sub("text", (r"\s+([.,!?;:])", r"\1"), ("([.,!?;:])([A-Za-z0-9])", r"\1 \2"), ("([.!?]){2,}", r"\1"), (r"\(\s+", "("), (r"\s+\)", ")")) + " AS out",
)
_LONE_I = (r"(^|[^\p{L}\p{N}_])i([^\p{L}\p{N}_]|$)", r"\1I\2")
column_query("standalone_i", "documents", lambda: {"out": resolver.standalone_i(T())}, sql_sub("text", _LONE_I, _LONE_I) + " AS out")
column_query("sentence_case", "documents", lambda: {"out": text.by_line(T(), resolver.sentence_case)})
column_query("list_markers", "notes", lambda: {"out": resolver.list_markers(T())}, sql_sub("text", (r"([\p{L}\p{N}_])\s+([0-9]{1,2}[.)]\s+[A-Z])", "\\1\n\\2"), (r"([\p{L}\p{N}_])\s+([-•*]\s+[A-Z])", "\\1\n\\2")) + " AS out")
column_query("resolve", "documents", lambda: {"out": resolver.resolve(T())})
column_query("resolve_noisy", "noisy", lambda: {"out": resolver.resolve(cleaner.clean(T()))})

# --- whole chains, line by line: each step's SQL over a line x ---------------------------------------------------------

_NOT_BLANK = lambda x: f"regexp_matches({x}, '\\S')"
_sql_boundaries = lambda x: sql_sub(_sql_numbers.format(t=x).replace("lambda x:", "lambda w:").replace("(x, '^[0-9]", "(w, '^[0-9]").replace("(x, '^([0-9]", "(w, '^([0-9]").replace("ELSE x END", "ELSE w END"), _SQL_LETTER_DIGIT)


def _sql_ambiguous(line: str) -> str:
    """Digits within mostly alphabetic tokens t, token by token."""
    inner = sql_sub("t", ("^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$", ""))
    share, within = SQL_SHARE(inner), lambda digit, letter: ((f"([a-zA-Z]){digit}([a-zA-Z])", f"\\1{letter}\\2"),) * 2
    has = lambda pattern: f"regexp_matches({inner}, {q(pattern)})"
    out = f"CASE WHEN contains({inner}, '0') AND NOT {has('[1-9]')} THEN replace(t, '0', 'O') ELSE t END"
    out = f"CASE WHEN {has(r'^1' + chr(92) + 'p{L}')} THEN regexp_replace({out}, '^([^1]*)1', '\\1I') WHEN {has(chr(92) + 'p{L}1$')} THEN regexp_replace({out}, '1([^1]*)$', 'l\\1') ELSE {out} END"
    out = sql_sub(out, *within(1, "l"))
    out = f"CASE WHEN {has('^5' + chr(92) + 'p{L}.')} AND length({inner}) > 2 THEN regexp_replace({out}, '^([^5]*)5', '\\1S') ELSE {out} END"
    out = f"CASE WHEN contains({inner}, '6') AND {share} > 0.7 THEN {sql_sub(out, *within(6, 'G'))} ELSE {out} END"
    kept = f"regexp_matches(t, '^[0-9][0-9.,]+$') OR contains(t, '@') OR contains(t, '://') OR length({inner}) < 2 OR {share} < 0.5"
    return f"array_to_string(list_transform(regexp_extract_all({line}, '\\S+'), lambda t: CASE WHEN {kept} THEN t ELSE {out} END), ' ')"


def _sql_sentence_case(line: str) -> str:
    raised = f"array_to_string(list_transform(regexp_extract_all({line}, '[.!?]\\s[a-z]|(?s:.)'), lambda g: CASE WHEN length(g) = 3 THEN upper(g) ELSE g END), '')"
    return f"CASE WHEN regexp_matches({raised}, '^\\p{{Ll}}') THEN upper(substr({raised}, 1, 1)) || substr({raised}, 2) ELSE {raised} END"


def _sql_clean_line() -> str:
    line = sql_sub("x", (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))
    line = _sql_ligatures.replace("text", line, 1)
    line = sql_sub(line, _noise, _noise, (r"([\p{L}\p{N}_])-\s{2,}([\p{L}\p{N}_])", r"\1\2"), *_SQL_EXCLAMATION)
    line = sql_sub(_sql_boundaries(_sql_ambiguous(line)), (f"({rules.MERGED_PREFIXES})([A-Z][a-z])", r"\1 \2"), ("([a-z])([A-Z][a-z])", r"\1 \2"))
    return "regexp_extract(x, '^\\s*') || " + sql_sub(SQL_STRIP(line), (r"[ \t]+", " "))


def _sql_cleaned(of: str) -> str:
    """doc_id and the cleaned text: lines that the steps empty go, white-space lines stay empty."""
    lines = f"SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: CASE WHEN {_NOT_BLANK('x')} THEN {_sql_clean_line()} ELSE NULL END) AS cs, string_split(text, chr(10)) AS ls FROM ({of}) o"
    rows = "list_transform(list_filter(range(1, len(ls) + 1), lambda i: cs[i] IS NULL OR regexp_matches(cs[i], '\\S')), lambda i: coalesce(cs[i], ''))"
    return f"SELECT doc_id, CASE WHEN {_NOT_BLANK('text')} THEN {sql_sub(f'array_to_string({rows}, chr(10))', (NEWLINES, chr(10) * 2), (r'^' + chr(92) + 'n+|' + chr(92) + 'n+$', ''))} ELSE '' END AS out FROM ({lines}) l"


def _sql_resolved(of: str) -> str:
    """doc_id and the resolved text of rows (doc_id, text)."""
    line = sql_sub(sql_sub("x", _RN, _RN), *((p.removeprefix("(?iuU)"), r) for p, r in rules.RESOLVER_WORDS), flags="gi")
    line = sql_sub(line, ("([.!?])([A-Z][a-z])", r"\1 \2"), ("(,)([A-Z][a-z]{2,})", r"\1 \2"))
    line = sql_sub(line, (r"\s+([.,!?;:])", r"\1"), ("([.,!?;:])([A-Za-z0-9])", r"\1 \2"), ("([.!?]){2,}", r"\1"), (r"\(\s+", "("), (r"\s+\)", ")"), _LONE_I, _LONE_I)
    rows = f"SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM ({of}) o"
    fixed = f"SELECT doc_id, text, i, x AS raw, {line} AS x FROM ({rows}) r"
    cased = f"SELECT doc_id, text, i, raw, {_sql_sentence_case('x')} AS x FROM ({fixed}) f"
    whole = f"SELECT doc_id, text, string_agg(CASE WHEN {_NOT_BLANK('raw')} THEN {_sql_boundaries('x')} ELSE '' END, chr(10) ORDER BY i) AS y FROM ({cased}) c GROUP BY ALL"
    marked = sql_sub("y", (r"([\p{L}\p{N}_])\s+([0-9]{1,2}[.)]\s+[A-Z])", "\\1\n\\2"), (r"([\p{L}\p{N}_])\s+([-•*]\s+[A-Z])", "\\1\n\\2"))
    return f"SELECT doc_id, CASE WHEN {_NOT_BLANK('text')} THEN {marked} ELSE text END AS out FROM ({whole}) w"


_SQL_EXCLAMATION = (("([a-z])!([a-z])", r"\1l\2"),) * 2
_oracles["ambiguous"] = f"SELECT doc_id, {sql_lines('text', _sql_ambiguous('x'))} AS out FROM ({NOISY_SQL}) s"
_oracles["sentence_case"] = f"SELECT doc_id, {sql_lines('text', _sql_sentence_case('x'))} AS out FROM ({DOCS_SQL}) s"
_oracles["clean"] = _sql_cleaned(DOCS_SQL)
_oracles["clean_noisy"] = _sql_cleaned(NOISY_SQL)
_oracles["resolve"] = _sql_resolved(DOCS_SQL)
_oracles["resolve_noisy"] = _sql_resolved(f"SELECT doc_id, out AS text FROM ({_sql_cleaned(NOISY_SQL)}) n")
for _name, _more in (("word_spacing", ((r"([)\]])([A-Za-z])", r"\1 \2"),)), ("pdf_spacing", ())):
    _spaced = sql_sub(_sql_boundaries(sql_sub("x", ("([.!?])([A-Za-z])", r"\1 \2"), ("([,;:])([A-Za-z])", r"\1 \2"), *_more)), ("  +", " "))
    _oracles[_name] = f"SELECT doc_id, {sql_lines('text', f'CASE WHEN {_NOT_BLANK(chr(120))} THEN {_spaced} ELSE x END')} AS out FROM ({LETTERS_SQL}) s"
_labelled = sql_sub("text", (r"(^|[^\n])([A-Z][a-zA-Z\s]{1,20}:)", "\\1\n\\2"))
_oracles["format_form"] = f"SELECT doc_id, {sql_sub(sql_lines(_labelled, SQL_STRIP('x')), (NEWLINES, chr(10) * 2), (r'^' + chr(92) + 'n+|' + chr(92) + 'n+$', ''))} AS out FROM ({LETTERS_SQL}) s"

# --- post-processing -----------------------------------------------------------------------------------------------

_sql_kind = lambda p: f"len(regexp_extract_all(text, {q('(?i)' + p.removeprefix('(?iuU)'))}))"
for _of in ("letters", "notes", "documents"):
    column_query(
        f"document_kind_{_of}", _of, lambda: {"kind": postprocess.document_kind(T())},
        f"CASE WHEN {_sql_kind(rules.NOTES_SIGNAL)} >= 2 THEN 'notes' WHEN {_sql_kind(rules.LETTER_SIGNAL)} >= 2 THEN 'letter' WHEN {_sql_kind(rules.NOTES_SIGNAL)} >= 1 THEN 'notes' ELSE 'generic' END AS kind",
    )
_sql_first = sql_sub("regexp_extract(x, '^\\s*(\\S+)', 1)", (r"[.,!?;:\-]+$", ""))
_sql_title = f"(regexp_matches({_sql_first}, '^\\p{{Lu}}') AND length({_sql_first}) >= @least AND (regexp_matches(substr({_sql_first}, 2), '\\p{{Ll}}') AND NOT regexp_matches(substr({_sql_first}, 2), '[\\p{{Lu}}\\p{{Lt}}]')@loose))"
_sql_kept = f"NOT regexp_matches(x, '\\S') OR regexp_matches(x, {q('(?i)' + rules.KEPT_LINE.removeprefix('(?iuU)'))}) OR {_sql_title.replace('@least', '3').replace('@loose', '')} OR CASE WHEN length({SQL_STRIP('x')}) >= 12 THEN {SQL_SHARE(SQL_STRIP('x'))} >= 0.35 ELSE length({SQL_STRIP('x')}) >= 3 AND {SQL_SHARE(SQL_STRIP('x'))} >= 0.55 END"
for _of in ("documents", "notes"):
    column_query(f"garbage_free_{_of}", _of, lambda: {"out": postprocess.garbage_free(T())}, sql_lines("text", "x", _sql_kept) + " AS out")
_sql_loose = f" OR regexp_matches(substr({_sql_first}, 2, 1), '\\p{{Ll}}')"
_sql_ocr = f"NOT regexp_matches(x, '\\S') OR regexp_matches(x, {q('(?i)' + rules.KEPT_OCR_LINE.removeprefix('(?iuU)'))}) OR {_sql_title.replace('@least', '2').replace('@loose', _sql_loose)} OR length({SQL_STRIP('x')}) <= 8 OR {SQL_SHARE(SQL_STRIP('x'))} >= 0.2"
column_query("recognised_lines", "notes", lambda: {"out": postprocess.recognised_lines(T())}, sql_lines(sql_sub("text", _RN, _RN), "x", _sql_ocr) + " AS out")
column_query("word_spacing", "letters", lambda: {"out": postprocess.word_spacing(T())})
column_query("pdf_spacing", "letters", lambda: {"out": postprocess.word_spacing(T(), brackets=False)})
column_query("post_chars", "documents", lambda: {"out": postprocess.chars(T())})
column_query("post_words", "noisy", lambda: {"out": postprocess.word_fixes(T())}, sql_sub(sql_sub("text", *((p.removeprefix("(?iuU)"), r) for p, r in rules.POST_WORDS), flags="gi"), _LONE_I, _LONE_I) + " AS out")
column_query("names", "letters", lambda: {"out": postprocess.names(F.replace(T(), F.lit("Asha"), F.lit("nikkil arjnn")))}, sql_sub("replace(text, 'Asha', 'nikkil arjnn')", *((p.removeprefix("(?iuU)"), r) for p, r in rules.NAMES), flags="gi") + " AS out")
column_query("trailing_garbage_free", "letters", lambda: {"out": postprocess.trailing_garbage_free(F.concat(T(), F.lit("\n12 xx\nsome more words than three")))}, "text AS out")
column_query("academic", "notes", lambda: {"out": postprocess.academic(T())})
column_query("notes_paragraphs", "letters", lambda: {"paragraphs": F.array_join(postprocess.notes_paragraphs(T()), "¶")}, f"array_to_string(list_filter(list_transform(regexp_split_to_array({SQL_STRIP('text')}, '\\n{{2,}}'), lambda p: array_to_string(list_transform(list_filter(string_split(p, chr(10)), lambda y: regexp_matches(y, '\\S')), lambda y: regexp_replace(y, '\\s+$', '')), chr(10))), lambda p: p <> ''), '¶') AS paragraphs")
column_query("reconstructed", "noisy", lambda: {"out": postprocess.reconstructed(F.replace(T(), F.lit("\n\n"), F.lit("\n")))})


@query("""
WITH v AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[a-zA-Z]{2,}'))) AS w FROM benchmark),
w AS (SELECT doc_id, lower(unnest(regexp_extract_all(regexp_replace(text, '[\\p{L}\\p{N}\\p{M}_]*[^\\x00-\\x7F\\s\\p{P}\\p{S}][\\p{L}\\p{N}\\p{M}_]*', ' ', 'g'), '\\b[a-zA-Z]{2,}\\b'))) AS w FROM documents)
SELECT w AS word, count(*) AS n FROM w WHERE w NOT IN (SELECT w FROM v) GROUP BY 1""")
def words_outside_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = lambda c, p: F.explode(F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(0)), F.lower))
    known = table(spark, sf_dir, "benchmark").select(pattern(T(), "[a-zA-Z]{2,}").alias("word")).distinct()
    ascii_only = text.sub(T(), r"[\p{L}\p{N}\p{M}_]*[^\x00-\x7F\s\p{P}\p{S}][\p{L}\p{N}\p{M}_]*", " ")
    found = table(spark, sf_dir, "documents").select(pattern(ascii_only, r"\b[a-zA-Z]{2,}\b").alias("word"))
    return found.groupBy("word").agg(F.count("*").alias("n")).join(known, "word", "left_anti")


@query()
def post_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source(spark, sf_dir, "notes").unionByName(source(spark, sf_dir, "letters").withColumn("doc_id", -F.col("doc_id")))
    out = postprocess.processed(rows, vocabulary=("the", "order", "date", "meaning", "wealth", "welfare", "write", "see"))
    return out.select("doc_id", "doc_type", "post_text", "confidence", "confidence_pct", F.size("paragraphs").alias("paragraphs"))


# --- layout --------------------------------------------------------------------------------------------------------

_sql_paragraphs = f"list_transform(regexp_split_to_array(text, '\\n{{2,}}'), lambda p: {sql_sub(SQL_STRIP('p'), (' {2,}', ' '))})"
column_query("format_plain", "letters", lambda: {"out": formatting.plain(T())}, f"array_to_string(list_filter({_sql_paragraphs}, lambda p: p <> ''), chr(10) || chr(10)) AS out")
# indented lines, tabs and white-space lines stay within a paragraph
_ragged = lambda: F.replace(F.replace(T(), F.lit("Write "), F.lit("  \n \tWrite  ")), F.lit(" is "), F.lit("\n    is\t\tnow   "))
_sql_ragged = "replace(replace(text, 'Write ', '  ' || chr(10) || ' ' || chr(9) || 'Write  '), ' is ', chr(10) || '    is' || chr(9) || chr(9) || 'now   ')"
column_query("format_ragged", "letters", lambda: {"out": formatting.plain(_ragged())}, f"array_to_string(list_filter({_sql_paragraphs.replace('(text,', f'({_sql_ragged},')}, lambda p: p <> ''), chr(10) || chr(10)) AS out")
column_query("format_list", "notes", lambda: {"out": formatting.listed(T())}, sql_sub(sql_lines("text", "regexp_replace(x, '\\s+$', '')"), (NEWLINES, "\n\n"), (r"^\n+|\n+$", "")) + " AS out")
column_query("format_form", "letters", lambda: {"out": formatting.form(T())})
_low = "lower(text)"
_sql_letter = " OR ".join(f"contains({_low}, {q(w)})" for w in rules.LETTER_WORDS)
_sql_fields = " + ".join(f"contains({_low}, {q(w)})::int" for w in rules.FORM_WORDS)
_sql_marked = r"len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^\s*(\d+[.)]\s|[-•*]\s)')))"
_sql_rows = "len(string_split(regexp_replace(text, '\\n$', ''), chr(10)))"
for _of in ("documents", "letters"):
    column_query(
        f"output_kind_{_of}", _of, lambda: {"kind": formatting.output_kind(T())},
        f"CASE WHEN {_sql_letter} THEN 'letter' WHEN {_sql_fields} >= 2 THEN 'form' WHEN {_sql_rows} > 3 AND {_sql_marked}::double / {_sql_rows} > 0.4 THEN 'list' ELSE 'plain' END AS kind",
    )


@query()
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.wrap_rows(source(spark, sf_dir, "documents"), 80)


# --- quality -------------------------------------------------------------------------------------------------------

_clean_sql = sql_sub("text", ("[|]", "I"), ("  +", " "))
_kept_sql = f"least({sql_words(_clean_sql)}::double / greatest({sql_words('text')}, 1), 1.0)"
_places = lambda x: f"floor(({x}) * 10000 + 0.5) / 10000"


@query(f"""SELECT doc_id, {sql_words("text")} AS raw_words, {sql_words(_clean_sql)} AS cleaned_words, {_places(sql_score("text"))} AS raw_quality, {_places(sql_score(_clean_sql))} AS cleaned_quality,
 {_places(sql_score(_clean_sql) + " - " + sql_score("text"))} AS improvement, {sql_score(_clean_sql)} >= 0.85 AS target_met, {_places(_kept_sql)} AS word_retention,
 CASE WHEN {_places(sql_score(_clean_sql))} * 0.7 + {_places(_kept_sql)} * 0.3 >= 0.9 THEN 'green' WHEN {_places(sql_score(_clean_sql))} * 0.7 + {_places(_kept_sql)} * 0.3 >= 0.75 THEN 'amber' ELSE 'red' END AS bucket FROM documents""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = text.fold(T(), (("[|]", "I"), ("  +", " ")))
    columns = quality.report(T(), clean)
    columns.pop("confidence_pct")
    share = columns["cleaned_quality"] * quality.SCORE_WEIGHT + columns["word_retention"] * quality.KEPT_WEIGHT
    bucket = F.when(share >= 0.9, "green").when(share >= 0.75, "amber").otherwise("red")
    return source(spark, sf_dir, "documents").select("doc_id", *(c.cast("long").alias(k) if k.endswith("words") else c.alias(k) for k, c in columns.items()), bucket.alias("bucket"))


# --- entities ------------------------------------------------------------------------------------------------------


def _entity_query(name: str, of: str, kind: str, sql: str | None, whole: bool = False) -> None:
    _queries[name] = lambda spark, sf_dir: source(spark, sf_dir, of).select("doc_id", F.posexplode(entities.entity(T(), kind, whole)).alias("ord", "value"))
    if sql:
        _oracles[name] = sql


def _sql_entity(of: str, pattern: str, change: str, keep: str, group: int = 0, first: bool = True) -> str:
    """Matches in order, cleaned, the first of each lower-cased value kept and numbered from 0."""
    return f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, {q('(?i)' + pattern)}, {group})) AS raw, generate_subscripts(regexp_extract_all(text, {q('(?i)' + pattern)}, {group}), 1) AS i FROM ({SOURCES[of]}) s),
c AS (SELECT doc_id, i, {change} AS value FROM m),
f AS (SELECT doc_id, i, value FROM c WHERE {keep} QUALIFY row_number() OVER (PARTITION BY doc_id, lower(value) ORDER BY i) = 1)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::int AS ord, value FROM f"""


_zip_ok = "(regexp_matches(value, '^\\d{5}-\\d{4}$') OR (length(value) = 6 AND value::bigint BETWEEN 100000 AND 999999) OR (length(value) = 5 AND value::bigint BETWEEN 501 AND 99950))"
_email_ok = "regexp_matches(value, '^[a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.[a-z]{2,}$')"
for _of in ("documents", "letters"):
    _entity_query(f"entity_email_{_of}", _of, "email", _sql_entity(_of, rules.ENTITY["email"], "lower(raw)", _email_ok))
_entity_query("entity_date", "letters", "date", _sql_entity("letters", rules.ENTITY["date"], "regexp_replace(raw, '[.,;:]+$', '')", "value <> ''", 1))
_entity_query("entity_url", "letters", "url", _sql_entity("letters", rules.ENTITY["url"].replace('\\"', '"'), r"regexp_replace(raw, '[.,;:!?)\]>]+$', '')", "starts_with(value, 'http')"))
_entity_query("entity_currency_whole", "letters", "currency", _sql_entity("letters", rules.ENTITY["currency"], r"regexp_replace(trim(raw), '([$€£¥₹])\s+(\d)', '\1\2', 'g')", "value <> ''"), whole=True)
_entity_query("entity_currency", "letters", "currency", _sql_entity("letters", rules.ENTITY["currency"], "coalesce(raw, '')", "value <> ''", 1))
_sql_zip = _sql_entity("letters", rules.ENTITY["zipcode"], "raw", _zip_ok).replace("(PARTITION BY doc_id ORDER BY i) - 1", "(PARTITION BY doc_id ORDER BY value) - 1")
_entity_query("entity_zipcode", "letters", "zipcode", _sql_zip)
_phone = (r"regexp_replace(regexp_replace(raw, '[^\d\s\-+().x]', '', 'g'), '^\s+|\s+$', '', 'g')", r"length(regexp_replace(value, '\D', '', 'g')) >= 7")
for _of in ("documents", "letters"):
    _zips = _sql_entity(_of, rules.ENTITY["zipcode"], "raw", _zip_ok)
    _entity_query(f"entity_phone_{_of}", _of, "phone", _sql_entity(_of, rules.ENTITY["phone"], _phone[0], _phone[1] + f" AND (doc_id, value) NOT IN (SELECT (doc_id, value) FROM ({_zips}) z)", 1))


_date, _url = "regexp_replace(raw, '[.,;:]+$', '')", r"regexp_replace(raw, '[.,;:!?)\]>]+$', '')"
_KIND_SQL = {
    "zipcode": _sql_zip,
    "email": _sql_entity("letters", rules.ENTITY["email"], "lower(raw)", _email_ok),
    "phone": _oracles["entity_phone_letters"],
    "date": _oracles["entity_date"],
    "url": _oracles["entity_url"],
}


def _sql_kinds(currency: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, {q(kind)} AS etype, ord, value FROM ({sql}) k" for kind, sql in (_KIND_SQL | {"currency": _oracles[currency]}).items())


@query(_sql_kinds("entity_currency_whole"))
def entity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.long_form(source(spark, sf_dir, "letters"), whole=True)


@query(f"""WITH k AS (SELECT doc_id, etype, count(*) AS n, list(value ORDER BY ord) AS v FROM ({_sql_kinds("entity_currency")}) e GROUP BY 1, 2),
s AS (SELECT doc_id, string_agg(upper(etype) || ': ' || array_to_string(v[1:5], ', ') || CASE WHEN n > 5 THEN '…' ELSE '' END, chr(10) ORDER BY list_position(['zipcode', 'email', 'phone', 'date', 'url', 'currency'], etype)) AS summary FROM k GROUP BY 1)
SELECT doc_id, coalesce(summary, 'No entities detected.') AS summary FROM ({LETTERS_SQL}) l LEFT JOIN s USING (doc_id)""")
def entity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir, "letters").select("doc_id", entities.summary(entities.entity_map(T())).alias("summary"))


def _sql_positions() -> str:
    """Matches with their places: a match starts after the pieces and the matches before it."""
    change = {
        "email": "lower(raw)", "phone": _phone[0], "date": r"regexp_replace(raw, '[.,;:]+$', '')", "url": r"regexp_replace(raw, '[.,;:!?)\]>]+$', '')",
        "currency": r"regexp_replace(trim(raw), '([$€£¥₹])\s+(\d)', '\1\2', 'g')", "zipcode": "raw",
    }
    keep = {"email": _email_ok, "phone": _phone[1], "date": "value <> ''", "url": "starts_with(value, 'http')", "currency": "value <> ''", "zipcode": _zip_ok}
    parts = []
    for kind, pattern in rules.ENTITY.items():
        found = q("(?i)" + pattern)
        places = f"SELECT doc_id, regexp_extract_all(text, {found}) AS ms, regexp_split_to_array(text, {found}) AS ps FROM ({LETTERS_SQL}) l"
        each = f"SELECT doc_id, unnest(ms) AS raw, generate_subscripts(ms, 1) AS i, ms, ps FROM ({places}) p"
        at = f"SELECT doc_id, raw, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS place FROM ({each}) e"
        parts.append(f"SELECT doc_id, {q(kind)} AS etype, value, place::int AS \"start\", (place + length(raw))::int AS \"end\" FROM (SELECT *, {change[kind]} AS value FROM ({at}) a) v WHERE {keep[kind]}")
    return " UNION ALL ".join(parts)


@query(_sql_positions())
def entity_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.with_positions(source(spark, sf_dir, "letters"))


# --- page measures, made from columns of like range -----------------------------------------------------------------

_features = {"edge_density": "l_discount * 1.5", "height_variance": "l_tax * 6", "connectivity": "(l_quantity % 20) / 1000", "stroke_cov": "l_linenumber / 10"}
_votes = " + ".join(
    f"CASE WHEN {n} < {lo} THEN {w if low else 0.0} WHEN {n} < {hi} THEN {w / 2} ELSE {0.0 if low else w} END" for n, lo, hi, w, low in classify.VOTES
)


@query(f"""WITH f AS (SELECT l_orderkey, l_linenumber, {", ".join(f"({e})::double AS {n}" for n, e in _features.items())} FROM lineitem),
p AS (SELECT *, ({_votes})::double / 4.0 AS p FROM f)
SELECT l_orderkey, l_linenumber, CASE WHEN p > 0.65 THEN 'printed' WHEN 1 - p > 0.65 THEN 'handwritten' ELSE 'mixed' END AS doc_type,
round(CASE WHEN p > 0.65 THEN p WHEN 1 - p > 0.65 THEN 1 - p ELSE 1 - abs(2 * p - 1) END, 6) AS confidence FROM p""")
def classifier_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.expr(e).cast("double").alias(n) for n, e in _features.items()))
    kind, sure = classify.decision()
    return rows.select("l_orderkey", "l_linenumber", kind.alias("doc_type"), F.round(sure, 6).alias("confidence"))


@query("""SELECT p_partkey, CASE WHEN greatest(p_size * 30, 700) < 1200 THEN floor(p_size * 30 * (1200.0 / greatest(p_size * 30, 700)))::int ELSE p_size * 30 END AS width,
CASE WHEN greatest(p_size * 30, 700) < 1200 THEN floor(700 * (1200.0 / greatest(p_size * 30, 700)))::int ELSE 700 END AS height FROM part""")
def scaled_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    width, height = signal.scaled_size((F.col("p_size") * 30), F.lit(700))
    return table(spark, sf_dir, "part").select("p_partkey", width.alias("width"), height.alias("height"))


# --- signals over events ---------------------------------------------------------------------------------------------

_SERIES_SQL = """SELECT event_type AS series, floor(epoch(ts) / 600)::bigint - (SELECT floor(epoch(min(ts)) / 600)::bigint FROM events) AS pos, count(*)::double AS val FROM events GROUP BY 1, 2"""
_SMOOTH_SQL = f"SELECT *, sum(val) OVER (PARTITION BY series ORDER BY pos RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS smooth FROM ({_SERIES_SQL}) s"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each kind in ten-minute steps from the first one."""
    step = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600_000_000)
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), step.alias("step"))
    first = events.agg(F.min("step").alias("first"))
    counted = events.groupBy("series", "step").agg(F.count("*").cast("double").alias("val"))
    return counted.join(F.broadcast(first)).select("series", (F.col("step") - F.col("first")).alias("pos"), "val")  # one row is broadcast


@query(f"SELECT series, pos, val, round(smooth, 6) AS smooth FROM ({_SMOOTH_SQL}) s")
def moving_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.moving_mean(series(spark, sf_dir)).withColumn("smooth", F.round("smooth", 6))


@query(f"""WITH s AS ({_SMOOTH_SQL}), z AS (SELECT series, max(smooth) * 0.6 AS level, max(pos) + 1 AS size FROM s GROUP BY 1),
o AS (SELECT s.*, size, smooth > level AS up FROM s JOIN z USING (series)),
r AS (SELECT *, up AND NOT coalesce(lag(up) OVER w, false) AS begins FROM o WINDOW w AS (PARTITION BY series ORDER BY pos)),
n AS (SELECT *, sum(begins::int) OVER (PARTITION BY series ORDER BY pos) AS run FROM r),
b AS (SELECT series, run, min(pos) AS a, max(pos) AS b, any_value(size) AS size FROM n WHERE up GROUP BY 1, 2),
c AS (SELECT series, greatest(0, a - 4) AS top, CASE WHEN b + 1 >= size THEN size ELSE least(size, b + 5) END AS bottom, b + 1 >= size AS open FROM b)
SELECT series, top, bottom FROM c WHERE open OR bottom - top > 8""")
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.bands(series(spark, sf_dir), share=0.6)


@query("""WITH h AS (SELECT event_type, floor(value)::bigint AS val, count(*) AS n FROM events GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER u AS w, sum(n * val) OVER u AS s, sum(n) OVER (PARTITION BY event_type) AS tw, sum(n * val) OVER (PARTITION BY event_type) AS ts FROM h
 WINDOW u AS (PARTITION BY event_type ORDER BY val ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, coalesce(w * (tw - w) * power(s::double / w - (ts - s)::double / nullif(tw - w, 0), 2), 0) AS between_ FROM c)
SELECT event_type, val AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY between_ DESC, val) = 1""")
def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.floor("value").alias("val"))
    return signal.otsu(rows, "val", ("event_type",))


@query("""WITH p AS (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM events)
SELECT event_id, round(least(greatest((value - lo) / nullif(hi - lo, 0) * 255, 0), 255), 4) AS stretched FROM events, p""")
def contrast_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.contrast_stretch(table(spark, sf_dir, "events").select("event_id", "value"), "value")
    return out.select("event_id", F.round("stretched", 4).alias("stretched"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::double AS v FROM embeddings)
SELECT vec_id, round(CASE WHEN count(v) < 10 THEN 0.5 ELSE coalesce(least(stddev_pop(abs(v)) / nullif(avg(abs(v)), 0), 2.0) / 2, 0.5) END, 6) AS cov FROM e GROUP BY 1""")
def variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "embeddings").select("vec_id", F.explode("embedding").alias("v")).select("vec_id", F.abs(F.col("v").cast("double")).alias("val"))
    return signal.variation(values, ["vec_id"]).withColumn("cov", F.round("cov", 6))


# --- dictionary ------------------------------------------------------------------------------------------------------


@query("""WITH k AS (SELECT DISTINCT p_type AS t FROM part), v AS (SELECT DISTINCT lower(unnest(regexp_extract_all(t, '[A-Za-z]+'))) AS match FROM k),
u AS (SELECT DISTINCT left(match, 2) || substr(match, 4) AS word FROM v),
d AS (SELECT word, match, levenshtein(word, match) AS distance FROM u, v WHERE abs(length(word) - length(match)) <= 2)
SELECT word, match, distance::int AS distance FROM d WHERE distance <= 2 QUALIFY row_number() OVER (PARTITION BY word ORDER BY distance, match) = 1""")
def edit_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select("p_type").distinct().select(F.explode(F.transform(F.regexp_extract_all("p_type", F.lit("[A-Za-z]+"), F.lit(0)), F.lower)).alias("word")).distinct()
    damaged = words.select(F.concat(F.substring("word", 1, 2), F.substring("word", 4, 1000)).alias("word")).distinct()
    return fuzzy.edit_matches(damaged, words)


@query()
def dictionary_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    fix = fuzzy.corrector(rules.COMMON_WORDS)
    return source(spark, sf_dir, "noisy").select("doc_id", fix(T()).alias("out"))


# --- whole pipelines -------------------------------------------------------------------------------------------------


def corrected_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipeline.reported(source(spark, sf_dir, "noisy"), vocabulary=rules.COMMON_WORDS)
    return out.select("doc_id", "output_kind", "final_text", "cleaned_quality", "target_met", "confidence_pct", F.to_json("raw_entities").alias("raw_entities"))


_queries["corrected_letters"] = corrected_letters


@query(f"""WITH d AS (SELECT lang, {sql_score("text")} AS score, {sql_words("text")} AS words, {SQL_NOISY} AS noisy, regexp_extract_all(text, {q(rules.ENTITY["email"])}) AS emails FROM documents)
SELECT lang, count(*) AS docs, sum(words)::bigint AS words, sum(noisy::int)::bigint AS noisy_docs, round(avg(score), 6) AS mean_score, sum(len(list_distinct(list_transform(emails, lambda x: lower(x)))))::bigint AS emails FROM d GROUP BY 1""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: documents, words, noisy documents, mean score and distinct e-mail addresses a document."""
    docs = table(spark, sf_dir, "documents").select("lang", text.score(T()).alias("score"), text.words(T()).alias("words"), text.noisy(T()).alias("noisy"), F.size(entities.entity(T(), "email")).alias("emails"))
    return docs.groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum("words").cast("long").alias("words"), F.sum(F.col("noisy").cast("long")).alias("noisy_docs"), F.round(F.avg("score"), 6).alias("mean_score"), F.sum("emails").cast("long").alias("emails")
    )


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)

"""Scalar text functions as Column expressions; the two that need Python are Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that the keyword index leaves out.
STOP_WORDS = (
    "a an and are as at be by did do does for from had has have how in into is it its of on or that the their them then "
    "there these this those to was were what when where which who whom why with would could should about after before "
    "between during than more most such also can may"
).split()

#: Section names that count as headings without a number.
HEADING_NAMES = (
    "abstract introduction background method methods results discussion conclusion conclusions summary acknowledgments "
    "acknowledgements"
).split() + ["related work"]

#: Fixed patterns, on which results depend: keywords, headings, references, bare numbers.
TOKEN = r"[a-z0-9]+(?:[.,'\-][a-z0-9]+)*"
NUMBERED_HEADING = r"(?U)^(?:[0-9]+(?:\.[0-9]+)*\.?|[IVX]+\.)\s+[A-Z][\w ,:&'()\-]{2,70}$"
REFERENCES = r"(?i)^\s*([0-9]+\.?\s*)?(references|bibliography|literature cited)\s*$"
FIRST_REFERENCE = r"^\[1\]\s"
BARE_NUMBER = r"^[0-9\s\-–]+$"

#: Fixed patterns and what replaces them: cleaning, then display.
CLEANING = (
    (r"(?U)(\w)-\n(\w)", "$1$2"),
    (r"[ \t]*\n[ \t]*", "\n"),
    (r"(?<!\n)\n(?!\n)", " "),
    (r"[ \t]{2,}", " "),
    (r"\n{3,}", "\n\n"),
    (r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""),
)
DISPLAY = (
    (r"(?:(?<![\w.])[-+]?\d[\d.,]*%?\s+){5,}[-+]?\d[\d.,]*%?", " … "),
    (r"(?:(?<!\S)\S{1,2}\s+){6,}", " … "),
    (r"\s+", " "),
    (r"(?:\s*…\s*){2,}", " … "),
    (r"^\s+|\s+$", ""),
)


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def _without_braces(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else strip_braced(t, "{\\displaystyle"))


def strip_braced(text: str, opener: str) -> str:
    """text without each block from opener to the brace that closes it; an unclosed block runs to the end."""
    kept, depth = [], 0
    for part in re.split("(" + re.escape(opener) + "|[{}])", text):
        if depth:
            depth += (part == "{" or part == opener) - (part == "}")
        elif part == opener:
            depth = 1
        else:
            kept.append(part)
    return "".join(kept)


def replaced(text: Column, *steps: tuple[str, str]) -> Column:
    """Regular-expression replacements, one after the other."""
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def nfkc(text: Column) -> Column:
    """NFKC form; pure ASCII, which it never changes, doesn't leave the JVM."""
    beyond = F.octet_length(text) != F.length(text)
    return F.when(beyond, _nfkc(F.when(beyond, text))).otherwise(text)


def _where(text: Column, needed: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """change(text) where needed(text), else text, which is computed once."""
    return F.transform(F.array(text), lambda t: F.when(needed(t), change(t)).otherwise(t))[0]


def _holds(*parts: str) -> Callable[[Column], Column]:
    return lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(p)) for p in parts])


def _edged(white: str) -> Callable[[Column], Column]:
    """Whether a text begins or ends with a character of a class."""
    return lambda t: F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1)).rlike(white)


#: For each step of CLEANING, a cheap test that holds wherever the step changes the text; most texts pass without an expression.
_NEEDED = (_holds("-\n"), _holds(" \n", "\t\n", "\n ", "\n\t"), _holds("\n"), _holds("  ", "\t"), _holds("\n\n\n"), _edged(r"(?U)[\s\x1c-\x1f]"))


def clean_text(text: Column, unicode_form: bool = True) -> Column:
    """Whitespace and hyphenation repair: one space within a paragraph, one empty line between paragraphs."""
    text = nfkc(text) if unicode_form else text
    text = _where(text, _holds("\u00ad"), lambda t: F.translate(t, "\u00ad", ""))
    for needed, (pattern, by) in zip(_NEEDED, CLEANING, strict=True):
        text = _where(text, needed, lambda t, pattern=pattern, by=by: F.regexp_replace(t, pattern, by))
    return text


def trimmed(text: Column) -> Column:
    """text without Unicode's white space at its ends."""
    return _where(text, _edged(r"(?U)\s"), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))


def heading_of(block: Column) -> Column:
    """The heading that the block is, without trailing . and :, or null."""

    def heading(line: Column) -> Column:
        bare = F.regexp_replace(line, r"[.:]+$", "")
        number = F.regexp_extract(line, r"^([0-9]+)", 1).try_cast("int")
        numbered = line.rlike(NUMBERED_HEADING) & (number.isNull() & ~line.rlike("^[0-9]") | (number <= 15))
        named = F.lower(bare).isin(HEADING_NAMES)
        return F.when(F.length(line) <= 80, F.when(~F.contains(line, F.lit("\n")) & (numbered | named), bare))

    return F.transform(F.array(trimmed(block)), heading)[0]


def is_bare_number(block: Column) -> Column:
    """Whether the block holds nothing but digits, white space and dashes."""
    return block.rlike(BARE_NUMBER)


def line_key(block: Column) -> Column:
    """What running headers and footers of different pages have in common."""
    return F.regexp_replace(F.lower(F.trim(block)), "[0-9]+", "#")


def is_reference_start(block: Column) -> Column:
    """Whether the block heads the list of references or is its first entry."""
    return block.rlike(REFERENCES) | block.rlike(FIRST_REFERENCE)


def tokens(text: Column) -> Column:
    """Keywords of the lower-cased text, repeats included, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1)), lambda t: ~t.isin(STOP_WORDS))


def citations(answer: Column, retrieved: Column) -> Column:
    """Sorted distinct numbers n of [n] with 1 <= n <= retrieved."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: n.between(1, retrieved))))


def superscripts(answer: Column) -> Column:
    return F.regexp_replace(answer, r"\[(\d+)\]", "<sup>[$1]</sup>")


def escape_html(text: Column) -> Column:
    """& < > as entities."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def clip(text: Column, n: int) -> Column:
    """text, or its first n characters up to a word's end, with an ellipsis."""
    cut = F.regexp_replace(F.regexp_replace(F.substring(text, 1, n), " [^ ]*$", ""), "[,.;:]+$", "")
    return F.when(F.length(text) <= n, text).otherwise(F.concat(cut, F.lit("…")))


def snippet(text: Column, pattern: Column, before: int = 160, after: int = 220) -> Column:
    """The surroundings of the first match of pattern; null without one."""
    at = F.regexp_instr(text, pattern)
    begin = F.greatest(F.lit(1), at - before)
    size = F.length(F.regexp_substr(text, pattern))
    return F.when(at > 0, F.substring(text, begin, at - begin + size + after))


def preview_start(text: Column, terms: Column) -> Column:
    """0-based start of a preview: 60 characters before the first of the terms of more than one letter."""
    places = F.filter(F.transform(F.filter(terms, lambda t: F.length(t) > 1), lambda t: F.instr(F.lower(text), t)), lambda p: p > 0)
    return F.coalesce(F.greatest(F.lit(0), F.array_min(places) - 61), F.lit(0))


def body_after_header(text: Column) -> Column:
    """What follows the first line; the whole text if there is one line."""
    return F.element_at(F.split(text, "\n", 2), -1)


def display_clean(text: Column, braces: bool = True) -> Column:
    """Text for display: no header line, no markup blocks, no runs of numbers or of one-symbol words."""
    headed = F.startswith(text, F.lit("[")) & F.contains(F.substring(text, 1, 400), F.lit("]\n"))
    text = F.when(headed, F.element_at(F.split(text, r"\]\n", 2), -1)).otherwise(text)
    if braces:
        text = F.when(F.contains(text, F.lit("{\\displaystyle")), _without_braces(text)).otherwise(text)
    return replaced(text, *DISPLAY)


def share_label(part: Column, whole: Column) -> Column:
    """part/whole (p%), or n/a."""
    percent = F.rint(100.0 * part / whole).cast("long")
    return F.when(whole == 0, F.lit("n/a")).otherwise(F.concat(part.cast("string"), F.lit("/"), whole.cast("string"), F.lit(" ("), percent.cast("string"), F.lit("%)")))


def chunk_header(title: Column, year: Column, section: Column) -> Column:
    """[Title (Year) | Section] and a line break; without the section if it is empty or null."""
    where = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" | "), section)).otherwise("")
    return F.concat(F.lit("["), title, F.lit(" ("), year.cast("string"), F.lit(")"), where, F.lit("]\n"))


def chunk_id(doc_id: Column, number: Column) -> Column:
    return F.format_string("%s::%04d", doc_id.cast("string"), number)

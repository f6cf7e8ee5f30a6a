"""Scalar text rules: white space, pattern extraction, marks, slugs. All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that trimming and patterns mean, as a character class body.
SPACE_CHARS = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
S = f"[{SPACE_CHARS}]"

# Patterns of exam documents. \z is the end of the text; an absent match is null.
TOTAL_MARKS = rf"(?i)\[{S}*Total:{S}*([0-9]+){S}*\]{S}*\z"
MARKS = rf"\[{S}*([0-9]+){S}*\]{S}*\z"
SUBPART = rf"^\(([a-hj-uwy-z])\){S}*(.*)\z"
SUBSUBPART = rf"^\(([ivx]+)\){S}*(.*)\z"
QUESTION = rf"^([0-9]{{1,2}}){S}+(.+)\z"
INLINE_OPTIONS = rf"^A{S}+(.*?){S}+B{S}+(.*?){S}+C{S}+(.*?){S}+D{S}+(.*)\z"
OPTION = rf"^([A-D]){S}+(.+)\z"
COPYRIGHT = r"^©"
BLANK_PAGE = rf"(?i)^BLANK{S}+PAGE\z"
PAGE_NUMBER = r"^[0-9]{1,4}\z"
MCQ_ROW = rf"^([0-9]{{1,2}}){S}+([A-D]){S}+([0-9]+)\z"
MCQ_DISCOUNTED = rf"(?i)^([0-9]{{1,2}}){S}+Question{S}+Discounted{S}+([0-9]+)\z"
PAPER_MARKER = r"^Paper ([0-9]{4}/[0-9]{2})\z"
QUESTION_HEADING = r"^Question ([0-9]{1,2})\z"
TOPIC_ROW = rf"^([0-9]){S}+(.+)\z"
AO_HEADING = rf"^(AO[0-9]){S}+(.+)\z"
AO_BULLET = rf"^•{S}*(.+)\z"
AO_WEIGHT = rf"^(AO[0-9]){S}+.+?{S}+([0-9]+)\z"
SUBJECT_HEADING = rf"^(.*?){S}*\(([A-Za-z0-9_-]+)\){S}*\z"


#: The characters of SPACE_CHARS one by one.
SPACES = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def trim(x: Column) -> Column:
    """Looks at a text's ends alone, not at all of it as a pattern does."""
    return F.trim(x, F.lit(SPACES))


def extract(x: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without one (an empty group is ''). The pattern runs once."""
    return F.get(F.regexp_extract_all(x, F.lit(pattern), F.lit(group)), F.lit(0))


def extract_int(x: Column, pattern: str, group: int = 1) -> Column:
    return extract(x, pattern, group).try_cast("int")


def ends_in_bracket(x: Column) -> Column:
    """Whether a trimmed text may end in marks: only then are their patterns run."""
    return F.endswith(x, F.lit("]"))


def strip_marks(x: Column) -> Column:
    """Without a closing total and then a closing marks bracket, trimmed."""
    bare = trim(x)
    return F.when(ends_in_bracket(bare), trim(F.regexp_replace(F.regexp_replace(bare, TOTAL_MARKS, ""), MARKS, ""))).otherwise(bare)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(trim(F.lower(x)), "[^a-z0-9]+", "-"), r"^-|-\z", "")


def ordered_join(items: Column, sep: str = " ") -> Column:
    """Joins the last field of collected ``struct(order..., text)`` in order; empty texts keep their separators."""
    return F.array_join(F.transform(F.array_sort(items), lambda s: s["text"]), sep)

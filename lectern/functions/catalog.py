"""Expressions of the resource catalogue: titles, sessions, ids, storage paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import S, extract_int, slug

# How types are abbreviated in ids, months of each session, session names, board prefixes.
ABBREVIATIONS = {
    "SYLLABUS": "SYL",
    "QUESTION_PAPER": "QP",
    "MARK_SCHEME": "MS",
    "EXAMINER_REPORT": "ER",
    "CONFIDENTIAL_INSTRUCTIONS": "CI",
    "SPECIMEN_PAPER": "QP",
    "OTHER": "OTH",
}
TITLE_TYPES = [
    ("mark scheme", "MARK_SCHEME"),
    ("examiner report", "EXAMINER_REPORT"),
    ("confidential instructions", "CONFIDENTIAL_INSTRUCTIONS"),
    ("specimen", "SPECIMEN_PAPER"),
    ("question paper", "QUESTION_PAPER"),
    ("syllabus", "SYLLABUS"),
]
TITLE_SESSIONS = [("march|february", "FM"), ("june|may", "MJ"), ("november|october", "ON")]
MONTH_SESSIONS = {2: "FM", 3: "FM", 5: "MJ", 6: "MJ", 10: "ON", 11: "ON"}
SESSION_NAMES = {"MJ": "June", "ON": "November", "FM": "March"}
BOARD_PREFIXES = {"Cambridge": "CAM"}
SESSIONLESS = "SPC"
PAST_PAPER_TYPES = ("QUESTION_PAPER", "MARK_SCHEME", "EXAMINER_REPORT", "CONFIDENTIAL_INSTRUCTIONS")
SECTION_LABELS = [("past paper", "past_papers"), ("published resource|endorsed resource", "published_resources"), ("support", "support")]

YEAR = r"(?<![A-Za-z0-9_])(20[0-9]{2})(?![A-Za-z0-9_])"
PAPER = rf"(?i)paper{S}+([0-9])([0-9])?(?![A-Za-z0-9_])"


def lookup(pairs: dict, key: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in reversed(pairs.items()):
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out


def _first_match(rules: list[tuple[str, str]], x: Column, default: Column) -> Column:
    out = default
    for pattern, value in reversed(rules):
        out = F.when(x.rlike(f"(?i){pattern}"), F.lit(value)).otherwise(out)
    return out


def title_type(title: Column) -> Column:
    return _first_match(TITLE_TYPES, title, F.lit("OTHER"))


def title_session(title: Column) -> Column:
    return _first_match(TITLE_SESSIONS, title, F.lit(None).cast("string"))


def title_year(title: Column) -> Column:
    return extract_int(title, YEAR)


def title_paper(title: Column) -> Column:
    return extract_int(title, PAPER, 1)


def title_variant(title: Column) -> Column:
    return extract_int(title, PAPER, 2)


def classify_title(title: Column) -> Column:
    return F.struct(
        title_type(title).alias("type"),
        title_year(title).alias("year"),
        title_session(title).alias("session"),
        title_paper(title).alias("paper"),
        title_variant(title).alias("variant"),
    )


def paper_code(paper: Column, variant: Column) -> Column:
    return F.concat(paper.cast("string"), F.coalesce(variant.cast("string"), F.lit("")))


def board_prefix(board: Column) -> Column:
    return lookup(BOARD_PREFIXES, board)


def resource_id(kind: Column, board: Column, code: Column, session: Column, year: Column, paper: Column, variant: Column) -> Column:
    """Parts joined by '-', nulls left out; a syllabus has neither session nor paper."""
    year = year.cast("string")
    plain = F.concat_ws("-", board_prefix(board), code, F.coalesce(session, F.lit(SESSIONLESS)), year, paper_code(paper, variant), lookup(ABBREVIATIONS, kind))
    return F.when(kind == "SYLLABUS", F.concat_ws("-", board_prefix(board), code, F.lit("SYL"), year)).otherwise(plain)


def strip_board(qualification: Column) -> Column:
    return F.regexp_replace(qualification, rf"(?i)^cambridge{S}+", "")


def subject_id(board: Column, qualification: Column, code: Column) -> Column:
    return F.concat_ws("-", board_prefix(board), F.regexp_replace(F.upper(strip_board(qualification)), "[^A-Z0-9]+", ""), code)


def category_path(kind: Column, title: Column, session: Column, year: Column, paper: Column, variant: Column) -> Column:
    year = F.when(year != 0, year.cast("string"))
    code = paper_code(paper, variant)
    return (
        F.when(kind == "SYLLABUS", F.lit("syllabus"))
        .when((kind == "SPECIMEN_PAPER") | title.rlike("(?i)specimen"), F.concat_ws("/", F.lit("specimen-papers"), year, code))
        .when(session.isNotNull() | kind.isin(*PAST_PAPER_TYPES), F.concat_ws("/", F.lit("past-papers"), year, F.lower(session), code))
        .otherwise(F.lit("other"))
    )


def storage_path(board: Column, qualification: Column, subject: Column, code: Column, category: Column) -> Column:
    return F.concat_ws("/", slug(board), slug(strip_board(qualification)), slug(subject), slug(code), category)


def url_path(url: Column) -> Column:
    """The path of a URL, '/' if it has none; malformed ones give what a path pattern finds."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*\z", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.when(bare == "", F.lit("/")).otherwise(bare)


def url_basename(url: Column) -> Column:
    """The decoded last part of the URL's path; null if that is empty. A plus sign stays one."""
    last = F.element_at(F.split(url_path(url), "/", -1), -1)
    return F.nullif(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), F.lit(""))


def is_pdf_link(href: Column) -> Column:
    return F.endswith(F.regexp_replace(F.lower(href), r"[?#].*\z", ""), F.lit(".pdf"))


def link_title(text: Column) -> Column:
    """Without a bracket on PDF, white space collapsed; null if nothing is left."""
    bare = F.regexp_replace(text, r"(?i)\(PDF[^)]*\)", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, f"{S}+", " "), r"^ | \z", ""), F.lit(""))


def fold_dots(path: Column) -> Column:
    """A rooted path with '.' and '..' parts worked off; '..' stops at the root, and a last dot part leaves a slash."""
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/", -1)
    last = F.element_at(parts, -1)
    drop = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", drop(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    folded = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))
    return F.when(path.rlike(r"(^|/)\.\.?(/|\z)"), folded).otherwise(path)


def resolve_url(href: Column, base: Column) -> Column:
    """A link against ``base``: absolute, protocol-relative, root-relative and relative ones, dot parts folded, a bare query or fragment, and '' for the page itself."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_replace(url_path(base), r"[^/]*\z", "")
    path, tail = F.regexp_replace(href, r"[?#](?s:.*)\z", ""), F.regexp_extract(href, r"([?#](?s:.*))\z", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    far = F.regexp_extract(href, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    whole = F.when((far != "") & path.rlike(r"/\.\.?(/|\z)"), F.concat(far, fold_dots(url_path(href)), tail)).otherwise(href)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), whole)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(path.startswith("/"), F.concat(origin, fold_dots(path), tail))
        .when(path != "", F.concat(origin, fold_dots(F.concat(folder, path)), tail))
        .when(tail.startswith("?"), F.concat(origin, url_path(base), tail))
        .otherwise(F.concat(origin, url_path(base), query, tail))
    )


# Fixed value: the address of the page that lists a subject's past papers.
COURSE_PAGE = "https://www.savemyexams.com/%s/%s/cie/past-papers/"


def course_url(qualification: Column, subject: Column) -> Column:
    return F.format_string(COURSE_PAGE, qualification, subject)


# Versions of the records that each step makes.
VERSIONS = {"document": "0.2.0", "questions": "0.2.0", "mark_scheme": "0.1.0", "examiner_report": "0.1.0", "syllabus": "0.1.0", "topics": "0.1.0", "knowledge": "0.1.0"}


def version_of(step: str) -> Column:
    return F.lit(VERSIONS[step])

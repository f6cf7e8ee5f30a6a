"""Crawled pages as sources: links, headings, sections, embedded JSON. Column functions on an ``html`` column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.catalog import SECTION_LABELS, _first_match, is_pdf_link, link_title, resolve_url
from lectern.functions.text import SUBJECT_HEADING, extract, trim
from lectern.operators.knowledge import first_wins, last_wins

# How a link, a main heading and the embedded data look.
LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
HEADING = r"(?is)<h1[^>]*>(.*?)</h1>"
NEXT_DATA = r"""(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>"""
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def plain(fragment: Column) -> Column:
    """A fragment's text: tags removed, the common character references decoded."""
    out = F.regexp_replace(fragment, r"(?s)<[^>]*>", "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def links(pages: DataFrame) -> DataFrame:
    """``page_id, url, ord, href, text`` of every link, in page order."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("text"))
    rows = pages.select("page_id", "url", F.posexplode(found).alias("ord", "l"))
    return rows.select("page_id", "url", "ord", plain(F.col("l.href")).alias("href"), trim(plain(F.col("l.text"))).alias("text"))


def pdf_links(links_: DataFrame) -> DataFrame:
    """Links to PDFs with cleaned titles and absolute addresses; those without a title are dropped."""
    told = links_.where(is_pdf_link(F.col("href"))).withColumn("title", link_title(F.col("text"))).where("title is not null")
    return told.select("page_id", "ord", "title", resolve_url(F.col("href"), F.col("url")).alias("target"))


def dedupe_by_url(resources: DataFrame, key: str, *order: str) -> DataFrame:
    """The first resource of each address."""
    return first_wins(resources, [key], *order)


def not_stored(resources: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Resources whose place isn't in the stored catalogue yet."""
    return resources.join(stored.select(key).distinct(), key, "left_anti")


def subject_heading(pages: DataFrame) -> DataFrame:
    """``page_id, subject, code, error`` from the main heading 'Name (code)'; others are told apart, not failed."""
    h = trim(F.regexp_replace(plain(F.regexp_extract("html", HEADING, 1)), r"\s+", " "))
    told = pages.withColumn("_h", h)
    subject, code = trim(extract(F.col("_h"), SUBJECT_HEADING, 1)), extract(F.col("_h"), SUBJECT_HEADING, 2)
    return told.select("page_id", subject.alias("subject"), code.alias("code"), F.when(code.isNull(), "heading").alias("error"))


def section_links(links_: DataFrame) -> DataFrame:
    """``page_id, label, target``: the section that a link's text names; of links for one section the last counts.

    Sections lie below the subject's own page: its address, the link as it is, and a slash.
    """
    label = _first_match(SECTION_LABELS, F.col("text"), F.lit(None).cast("string"))
    target = F.concat(F.regexp_replace("url", r"/+\z", ""), "href", F.lit("/"))
    rows = links_.where("href is not null and href <> ''").withColumn("label", label).where("label is not null").select("page_id", "label", "ord", target.alias("target"))
    return last_wins(rows, ["page_id", "label"], "ord").select("page_id", "label", "target")


def section_map(pages: DataFrame, links_: DataFrame) -> DataFrame:
    """``page_id, syllabus, past_papers, published_resources, support`` of each page; the syllabus is the page itself."""
    own = pages.select("page_id", F.concat(F.regexp_replace("url", r"/+\z", ""), F.lit("/")).alias("syllabus"))
    names = [name for _, name in SECTION_LABELS]
    wide = section_links(links_).groupBy("page_id").agg(*[F.max(F.when(F.col("label") == n, F.col("target"))).alias(n) for n in names])
    return own.join(wide, "page_id", "left")


def embedded_json(pages: DataFrame) -> DataFrame:
    """``page_id, data, error``: the page's embedded data as a variant; missing or broken data is told in ``error``."""
    raw = F.nullif(F.regexp_extract("html", NEXT_DATA, 1), F.lit(""))
    return pages.select("page_id", F.try_parse_json(raw).alias("data"), F.when(raw.isNull(), "missing").when(F.try_parse_json(raw).isNull(), "broken").alias("error"))


def course_papers(pages: DataFrame) -> DataFrame:
    """``page_id, course, exam_code, papers, error``: a course page's past-paper records, an array of variants.

    ``error`` tells pages without data, with broken data, and those whose records aren't an array.
    """
    at = "$.props.pageProps"
    told = embedded_json(pages).withColumn("papers", F.try_variant_get("data", f"{at}.pastPapers", "array<variant>"))
    attribute = lambda name: F.try_variant_get("data", f"{at}.course.attributes.{name}", "string").alias({"name": "course"}.get(name, name))
    return told.select("page_id", attribute("name"), attribute("exam_code"), "papers", F.coalesce("error", F.when(F.col("papers").isNull(), "no past papers")).alias("error"))

"""Queries over pages, parts and orders shaped as crawled sites and resource catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import catalog as c
from lectern.functions.text import SPACE_CHARS, slug
from lectern.operators import resources
from lectern.plans.documents import sql_trim
from lectern.sources import web
from lectern.sources.adapters import table

TITLES = [
    "June 2024 Question Paper 11", "March 2023 Mark Scheme Paper 42", "2023 Specimen Paper 1 Mark Scheme", "November 2022 Examiner Report", "2023-2025 Syllabus",
    "October 2021 Confidential Instructions paper 5", "2025 Specimen Paper 3", "Maybe 1999 notes", "May 2020 Question Paper 123", "Grade Threshold Table",
]


def _titles(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    pick = F.get(F.array(*map(F.lit, TITLES)), (F.col("o_orderkey") % len(TITLES)).cast("int"))
    year = F.concat(F.lit(" "), F.year("o_orderdate").cast("string"))
    title = F.when(F.col("o_orderkey") % 3 == 0, F.concat(pick, year)).otherwise(pick)
    return o.select(F.col("o_orderkey").alias("k"), title.alias("title"))


TITLE_SQL = f"""
titles AS (SELECT o_orderkey AS k, {TITLES}[CAST(o_orderkey % {len(TITLES)} + 1 AS INT)] || CASE WHEN o_orderkey % 3 = 0 THEN ' ' || year(o_orderdate) ELSE '' END AS title FROM orders),
cl AS (
  SELECT *, CASE WHEN title ILIKE '%mark scheme%' THEN 'MARK_SCHEME' WHEN title ILIKE '%examiner report%' THEN 'EXAMINER_REPORT' WHEN title ILIKE '%confidential instructions%' THEN 'CONFIDENTIAL_INSTRUCTIONS'
      WHEN title ILIKE '%specimen%' THEN 'SPECIMEN_PAPER' WHEN title ILIKE '%question paper%' THEN 'QUESTION_PAPER' WHEN title ILIKE '%syllabus%' THEN 'SYLLABUS' ELSE 'OTHER' END AS type,
    TRY_CAST(nullif(regexp_extract(title, '\\b(20[0-9]{{2}})\\b', 1), '') AS INT) AS year,
    CASE WHEN regexp_matches(title, '(?i)march|february') THEN 'FM' WHEN regexp_matches(title, '(?i)june|may') THEN 'MJ' WHEN regexp_matches(title, '(?i)november|october') THEN 'ON' END AS session,
    TRY_CAST(nullif(regexp_extract(title, '(?i)paper\\s+([0-9])([0-9])?\\b', 1), '') AS INT) AS paper, TRY_CAST(nullif(regexp_extract(title, '(?i)paper\\s+([0-9])([0-9])?\\b', 2), '') AS INT) AS variant
  FROM titles),
coded AS (SELECT *, CAST(paper AS VARCHAR) || coalesce(CAST(variant AS VARCHAR), '') AS code, CAST(year AS VARCHAR) AS ys FROM cl)"""


def doc_title_classify(spark: SparkSession, d: str) -> DataFrame:
    return resources.classify_titles(_titles(spark, d)).select("k", "type")


def session_year_paper(spark: SparkSession, d: str) -> DataFrame:
    return resources.classify_titles(_titles(spark, d)).select("k", "year", "session", "paper", "variant")


def resource_id(spark: SparkSession, d: str) -> DataFrame:
    return resources.identify(resources.classify_titles(_titles(spark, d)), "Cambridge", "Cambridge IGCSE", "0625").select("k", "resource_id")


def subject_id(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    q = F.concat(F.lit("cambridge  "), "p_type", F.lit(" & "), "p_brand")
    return p.select("p_partkey", c.subject_id(F.lit("Cambridge"), q, F.col("p_size").cast("string")).alias("subject_id"))


def slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", slug(F.concat(F.lit("  #"), "p_brand", F.lit(" -- "), "p_name", F.lit(" ("), "p_type", F.lit(")! "))).alias("slug"))


def storage_path(spark: SparkSession, d: str) -> DataFrame:
    t = resources.classify_titles(_titles(spark, d))
    cat = c.category_path(F.col("type"), F.col("title"), F.col("session"), F.col("year"), F.col("paper"), F.col("variant"))
    return t.select("k", c.storage_path(F.lit("Cambridge"), F.lit("Cambridge IGCSE"), F.lit("Physics A"), F.lit("0625"), cat).alias("path"))


def filename_from_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", c.url_basename(F.concat(F.regexp_replace("url", r"([0-9]+)", "a%20b+$1"), F.lit("#x"))).alias("filename"))


def html_links(spark: SparkSession, d: str) -> DataFrame:
    return web.links(table(spark, d, "pages")).select("page_id", "ord", "href", "text")


def _pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    return web.links(table(spark, d, "pages")).select("page_id", "url", "ord", F.concat("href", F.when(F.col("ord") % 2 == 0, ".PDF?v=1").otherwise(".html")).alias("href"), F.concat("text", F.lit("  (PDF, 2MB) ")).alias("text"))


def pdf_links(spark: SparkSession, d: str) -> DataFrame:
    return web.pdf_links(_pdf_pages(spark, d)).select("page_id", "ord", "target")


def link_titles(spark: SparkSession, d: str) -> DataFrame:
    return web.pdf_links(_pdf_pages(spark, d)).select("page_id", "ord", "title")


def heading_parse(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("<h1 class='t'>Subject "), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, "").otherwise(" (06-25_x) "), F.lit("</h1>")).alias("html"))
    return web.subject_heading(p)


def section_links(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ["Past papers", "Published resources", "Support material", "Contact", "All PAST PAPERS"]))
    ls = web.links(table(spark, d, "pages")).withColumn("text", F.get(names, F.col("ord") % 5))
    return web.section_links(ls)


def embedded_json(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    body = F.when(F.col("event_id") % 7 == 0, "{broken").otherwise(F.col("props"))
    html = F.when(F.col("event_id") % 5 == 0, "<html></html>").otherwise(F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), body, F.lit("</script>")))
    told = web.embedded_json(e.select(F.col("event_id").alias("page_id"), html.alias("html")))
    return told.select("page_id", F.try_variant_get("data", "$.k", "bigint").alias("k"), "error")


def _papers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    months = F.array(*map(F.lit, [2, 3, 5, 6, 10, 11, 1]))
    codes = F.array(*map(F.lit, ["0972/11", "0972/01", "0972", "0972/3", "0972/42"]))
    name = F.concat(F.lit("https://x/"), (k % 500).cast("string"), F.lit("-"), F.year("o_orderdate").cast("string"), F.lit("-p.pdf"))
    return table(spark, d, "orders").select(
        k.alias("k"),
        F.when(k % 4 != 0, F.year("o_orderdate")).alias("year"),
        F.when(k % 9 != 0, F.get(months, (k % 7).cast("int"))).alias("month"),
        F.get(codes, (k % 5).cast("int")).alias("code"),
        (k % 6 == 0).alias("is_specimen"),
        F.when(k % 5 != 1, name).alias("exam_paper"),
        F.when(k % 3 == 1, F.concat(name, F.lit("?ms"))).when(k % 3 == 2, "").alias("mark_scheme"),
    )


PAPERS_SQL = """
raw AS (SELECT o_orderkey AS k, 'https://x/' || (o_orderkey % 500) || '-' || year(o_orderdate) || '-p.pdf' AS name, o_orderdate FROM orders),
papers AS (SELECT k, CASE WHEN k % 4 <> 0 THEN year(o_orderdate) END AS year0, CASE WHEN k % 9 <> 0 THEN [2, 3, 5, 6, 10, 11, 1][CAST(k % 7 + 1 AS INT)] END AS month,
  ['0972/11', '0972/01', '0972', '0972/3', '0972/42'][CAST(k % 5 + 1 AS INT)] AS code, k % 6 = 0 AS is_specimen, CASE WHEN k % 5 <> 1 THEN name END AS exam_paper, CASE WHEN k % 3 = 1 THEN name || '?ms' WHEN k % 3 = 2 THEN '' END AS mark_scheme FROM raw),
cp AS (SELECT *, coalesce(year0, TRY_CAST(nullif(regexp_extract(coalesce(exam_paper, mark_scheme, ''), '\\b(20[0-9]{2})\\b', 1), '') AS INT)) AS year,
  CASE WHEN month IN (2, 3) THEN 'FM' WHEN month IN (5, 6) THEN 'MJ' WHEN month IN (10, 11) THEN 'ON' END AS session,
  CASE WHEN is_specimen THEN CASE WHEN split_part(code, '/', 2) = '' THEN 0 ELSE TRY_CAST(split_part(code, '/', 2) AS INT) END ELSE TRY_CAST(nullif(substr(split_part(code, '/', 2), 1, 1), '') AS INT) END AS paper,
  CASE WHEN NOT is_specimen AND length(split_part(code, '/', 2)) > 1 THEN TRY_CAST(substr(split_part(code, '/', 2), 2, 1) AS INT) END AS variant FROM papers),
ti AS (SELECT *, CASE WHEN is_specimen THEN trim(coalesce(CAST(year AS VARCHAR), '') || ' Specimen Paper ' || coalesce(CAST(paper AS VARCHAR), ''))
  ELSE trim(regexp_replace(CASE session WHEN 'MJ' THEN 'June' WHEN 'ON' THEN 'November' WHEN 'FM' THEN 'March' ELSE '' END || ' ' || coalesce(CAST(year AS VARCHAR), '') || ' Paper ' || coalesce(CAST(paper AS VARCHAR) || coalesce(CAST(variant AS VARCHAR), ''), ''), '\\s+', ' ', 'g')) END AS title FROM cp),
fan AS (SELECT k, year, session, paper, variant, CASE WHEN is_specimen THEN 'SPECIMEN_PAPER' ELSE 'QUESTION_PAPER' END AS type, title || ' Question Paper' AS title, exam_paper AS target FROM ti WHERE exam_paper <> ''
  UNION ALL SELECT k, year, session, paper, variant, 'MARK_SCHEME', title || ' Mark Scheme', mark_scheme FROM ti WHERE mark_scheme <> '')"""


def past_paper_classify(spark: SparkSession, d: str) -> DataFrame:
    return resources.classify_past_papers(_papers(spark, d)).select("k", "year", "session", "paper", "variant", "is_specimen")


def paper_titles(spark: SparkSession, d: str) -> DataFrame:
    return resources.paper_title(resources.classify_past_papers(_papers(spark, d))).select("k", "title")


def paper_fanout(spark: SparkSession, d: str) -> DataFrame:
    return resources.fan_out(resources.paper_title(resources.classify_past_papers(_papers(spark, d))), "k")


def dedupe_url_first_wins(spark: SparkSession, d: str) -> DataFrame:
    r = resources.fan_out(resources.paper_title(resources.classify_past_papers(_papers(spark, d))), "k")
    return web.dedupe_by_url(r.withColumn("rank", F.when(F.col("type") == "MARK_SCHEME", 1).otherwise(0)), "target", "k", "rank").select("target", "k", "type", "title")


def stored_anti_join(spark: SparkSession, d: str) -> DataFrame:
    o, p = table(spark, d, "orders"), table(spark, d, "customer")
    return web.not_stored(o.select("o_orderkey", F.col("o_custkey").alias("place")), p.where("c_acctbal > 0").select(F.col("c_custkey").alias("place")), "place")


def unique_section_urls(spark: SparkSession, d: str) -> DataFrame:
    return web.links(table(spark, d, "pages")).where("href is not null and href <> ''").select("href").distinct()


LINK_SQL = r"""
found AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS hs, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2) AS ts FROM pages),
flat AS (SELECT page_id, url, CAST(i - 1 AS INT) AS ord, hs[i] AS h, ts[i] AS t FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM found)),
links AS (SELECT page_id, url, ord, PLAIN_H AS href, PLAIN_T AS text FROM flat)""".replace(
    "PLAIN_H", "replace(replace(replace(replace(replace(replace(regexp_replace(h, '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
).replace("PLAIN_T", sql_trim("replace(replace(replace(replace(replace(replace(regexp_replace(t, '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"))

ORIGIN = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
PDF_SQL = rf"""
pdf AS (SELECT page_id, url, ord, href || CASE WHEN ord % 2 = 0 THEN '.PDF?v=1' ELSE '.html' END AS href,
  nullif(regexp_replace(regexp_replace(regexp_replace(text || '  (PDF, 2MB) ', '(?i)\(PDF[^)]*\)', '', 'g'), '[{SPACE_CHARS}]+', ' ', 'g'), '^ | \z', '', 'g'), '') AS title FROM links),
pdfs AS (SELECT page_id, ord, title, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '/%' THEN {ORIGIN} || href ELSE NULL END AS target FROM pdf WHERE ord % 2 = 0 AND title IS NOT NULL)"""

QUERIES = {
    "doc_title_classify": (doc_title_classify, f"WITH {TITLE_SQL} SELECT k, type FROM cl"),
    "session_year_paper": (session_year_paper, f"WITH {TITLE_SQL} SELECT k, year, session, paper, variant FROM cl"),
    "resource_id": (
        resource_id,
        f"""WITH {TITLE_SQL} SELECT k, CASE WHEN type = 'SYLLABUS' THEN concat_ws('-', 'CAM', '0625', 'SYL', ys) ELSE concat_ws('-', 'CAM', '0625', coalesce(session, 'SPC'), ys, code,
        CASE type WHEN 'QUESTION_PAPER' THEN 'QP' WHEN 'SPECIMEN_PAPER' THEN 'QP' WHEN 'MARK_SCHEME' THEN 'MS' WHEN 'EXAMINER_REPORT' THEN 'ER' WHEN 'CONFIDENTIAL_INSTRUCTIONS' THEN 'CI' ELSE 'OTH' END) END AS resource_id FROM coded""",
    ),
    "subject_id": (subject_id, "SELECT p_partkey, 'CAM-' || regexp_replace(upper(p_type || ' & ' || p_brand), '[^A-Z0-9]+', '', 'g') || '-' || p_size AS subject_id FROM part"),
    "slugify": (slugify, "SELECT p_partkey, regexp_replace(regexp_replace(lower(trim('  #' || p_brand || ' -- ' || p_name || ' (' || p_type || ')! ')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part"),
    "storage_path": (
        storage_path,
        f"""WITH {TITLE_SQL} SELECT k, 'cambridge/igcse/physics-a/0625/' || CASE WHEN type = 'SYLLABUS' THEN 'syllabus' WHEN type = 'SPECIMEN_PAPER' OR title ILIKE '%specimen%' THEN concat_ws('/', 'specimen-papers', ys, code)
        WHEN session IS NOT NULL OR type IN ('QUESTION_PAPER', 'MARK_SCHEME', 'EXAMINER_REPORT', 'CONFIDENTIAL_INSTRUCTIONS') THEN concat_ws('/', 'past-papers', ys, lower(session), code) ELSE 'other' END AS path FROM coded""",
    ),
    "filename_from_url": (
        filename_from_url,
        r"""SELECT page_id, nullif(replace(regexp_extract(regexp_replace(regexp_replace(regexp_replace(url, '([0-9]+)', 'a%20b+\1', 'g'), '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '([^/]*)$', 1), '%20', ' '), '') AS filename FROM pages""",
    ),
    "html_links": (html_links, f"WITH {LINK_SQL} SELECT page_id, ord, href, text FROM links"),
    "pdf_links": (pdf_links, f"WITH {LINK_SQL}, {PDF_SQL} SELECT page_id, ord, target FROM pdfs"),
    "link_titles": (link_titles, f"WITH {LINK_SQL}, {PDF_SQL} SELECT page_id, ord, title FROM pdfs"),
    "heading_parse": (
        heading_parse,
        "SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'Subject ' || page_id END AS subject, CASE WHEN page_id % 3 <> 0 THEN '06-25_x' END AS code, CASE WHEN page_id % 3 = 0 THEN 'heading' END AS error FROM pages",
    ),
    "section_links": (
        section_links,
        f"""WITH {LINK_SQL}, lab AS (SELECT *, CASE WHEN ord % 5 IN (0, 4) THEN 'past_papers' WHEN ord % 5 = 1 THEN 'published_resources' WHEN ord % 5 = 2 THEN 'support' END AS label FROM links)
        SELECT page_id, label, arg_max(regexp_replace(url, '/+$', '') || href || '/', ord) AS target FROM lab WHERE label IS NOT NULL AND href <> '' GROUP BY 1, 2""",
    ),
    "embedded_json": (
        embedded_json,
        """SELECT event_id AS page_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
        CASE WHEN event_id % 5 = 0 THEN 'missing' WHEN event_id % 7 = 0 THEN 'broken' END AS error FROM events""",
    ),
    "past_paper_classify": (past_paper_classify, f"WITH {PAPERS_SQL} SELECT k, year, session, paper, variant, is_specimen FROM cp"),
    "paper_titles": (paper_titles, f"WITH {PAPERS_SQL} SELECT k, title FROM ti"),
    "paper_fanout": (paper_fanout, f"WITH {PAPERS_SQL} SELECT k, year, session, paper, variant, type, title, target FROM fan"),
    "dedupe_url_first_wins": (
        dedupe_url_first_wins,
        f"WITH {PAPERS_SQL} SELECT target, k, type, title FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY k, CASE WHEN type = 'MARK_SCHEME' THEN 1 ELSE 0 END) AS rn FROM fan) WHERE rn = 1",
    ),
    "stored_anti_join": (stored_anti_join, "SELECT o_custkey AS place, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"),
    "unique_section_urls": (unique_section_urls, f"WITH {LINK_SQL} SELECT DISTINCT href FROM links WHERE href <> ''"),
}

"""Queries over statistics, topics by syllabus, reconciled marks, course pages, addresses and overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import catalog as c
from lectern.operators import geometry, knowledge, lines, sections, topics
from lectern.plans.catalog import LINK_SQL
from lectern.plans.documents import DOCUMENT_TOPICS, ONLY_LINES, PAPER, SYLLABUS, _lines, _nodes, _topic_sql
from lectern.sources import adapters as a
from lectern.sources import web
from lectern.sources.adapters import table

ITEMS = "items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS ord FROM lineitem)"


def document_statistics(spark: SparkSession, d: str) -> DataFrame:
    items = a.order_items(table(spark, d, "lineitem"))
    key = F.col("l_orderkey").alias("resource_id")
    return lines.analyze_documents(
        items.select(key, (F.col("l_linenumber") % 3).alias("page")), items.where("l_linenumber > 1").select(key, F.col("l_returnflag").alias("font")), a.order_operations(items)
    )


def syllabus_topic_assign(spark: SparkSession, d: str) -> DataFrame:
    q = topics.question_text(_nodes(spark, d)).withColumn("syllabus_id", F.col("resource_id") % 6)
    r = table(spark, d, "region").where("r_regionkey < 4").select(F.col("r_regionkey").cast("long").alias("syllabus_id"), F.posexplode(F.array(*map(F.lit, ["first", "other", "third", "second"]))).alias("ord", "name"))
    r = r.where("syllabus_id <> 3 or ord < 2").select("syllabus_id", "ord", (F.col("syllabus_id") * 10 + F.col("ord") + 1).alias("number"), "name")
    found = topics.assign_syllabus_topics(q, r, DOCUMENT_TOPICS)
    return found.select("resource_id", "question", "topic_number", "topic_name", F.array_join("matched", ",").alias("matched"))


def _syllabus_topic_sql() -> str:
    scored = _topic_sql().split("best AS (")[0].rstrip().rstrip(",")
    return f"""{scored},
tp AS (SELECT r_regionkey AS syllabus_id, i AS ord, r_regionkey * 10 + i + 1 AS number, ['first', 'other', 'third', 'second'][i + 1] AS name FROM region CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i) WHERE r_regionkey < 4 AND (r_regionkey <> 3 OR i < 2)),
cand AS (SELECT qt.resource_id, qt.question, tp.number, tp.name, coalesce(sc.m, []) AS m FROM qt JOIN tp ON qt.resource_id % 6 = tp.syllabus_id
         LEFT JOIN sc ON sc.resource_id = qt.resource_id AND sc.question = qt.question AND sc.topic = tp.name),
best AS (SELECT *, max(len(m)) OVER (PARTITION BY resource_id, question) AS b FROM cand),
lead AS (SELECT resource_id, question, any_value(number) AS topic_number, any_value(name) AS topic_name, any_value(m) AS m FROM best WHERE len(m) = b AND b > 0 GROUP BY 1, 2 HAVING count(*) = 1)
SELECT qt.resource_id, qt.question, l.topic_number, l.topic_name, coalesce(array_to_string(l.m, ','), '') AS matched FROM qt LEFT JOIN lead l ON l.resource_id = qt.resource_id AND l.question = qt.question"""


def quality_question_marks(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.question_marks_reconciled(_nodes(spark, d))


def course_scan(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    papers = F.when(F.col("o_orderkey") % 4 == 0, F.lit('"none"')).when(F.col("o_orderkey") % 4 == 1, F.lit("[]")).otherwise(F.concat(F.lit('[{"code":"'), k, F.lit('"},{"code":"b"}]')))
    course = F.when(F.col("o_orderkey") % 5 == 0, F.lit("null")).otherwise(F.concat(F.lit('{"attributes":{"name":"Course '), k, F.lit('","exam_code":"'), k, F.lit('/x"}}')))
    data = F.concat(F.lit('{"props":{"pageProps":{"course":'), course, F.lit(',"pastPapers":'), papers, F.lit("}}}"))
    html = F.when(F.col("o_orderkey") % 7 == 0, F.lit("<p>none</p>")).otherwise(F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script>")))
    told = web.course_papers(table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), html.alias("html")))
    return told.select("page_id", "course", "exam_code", F.when(F.col("papers").isNotNull(), F.size("papers")).alias("n_papers"), F.try_variant_get(F.get("papers", 0), "$.code", "string").alias("first_code"), "error")


def busiest_pages(spark: SparkSession, d: str) -> DataFrame:
    counts = _lines(spark, d).groupBy("resource_id", "page").agg(F.count("*").alias("n"))
    return knowledge.top_rows(counts, ["resource_id"], 2, F.desc("n"), "page")


# Links of every kind, by page: a page's address has two parts of a path and maybe a query and a fragment.
HREFS = ["../x", "./y?z=1", "?q=1", "#f", "", "a/../b", "/r/./s#t", "../../..", "//other.org/p", "mailto:x@y.z", "../../../u/."]


def resolve_urls(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url", F.explode(F.array(*map(F.lit, HREFS))).alias("href"))
    return p.select("page_id", "href", c.resolve_url(F.col("href"), F.col("url")).alias("target"))


RESOLVE_SQL = f"""
WITH p AS (SELECT page_id, url, unnest({HREFS}) AS href FROM pages),
b AS (SELECT *, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, regexp_extract(url, '^([a-z]+:)', 1) AS scheme, regexp_extract(url, '^[^?#]*([?][^#]*)', 1) AS query,
  CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END AS path FROM p),
f AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS folder, CASE WHEN regexp_replace(path, '[^/]*$', '') = '/' THEN '/' ELSE regexp_replace(path, '[^/]*/[^/]*$', '') END AS up FROM b)
SELECT page_id, href, CASE href WHEN '../x' THEN origin || up || 'x' WHEN './y?z=1' THEN origin || folder || 'y?z=1' WHEN '?q=1' THEN origin || path || '?q=1' WHEN '#f' THEN origin || path || query || '#f'
  WHEN '' THEN origin || path || query WHEN 'a/../b' THEN origin || folder || 'b' WHEN '/r/./s#t' THEN origin || '/r/s#t' WHEN '../../..' THEN origin || '/' WHEN '//other.org/p' THEN scheme || '//other.org/p'
  WHEN '../../../u/.' THEN origin || '/u/' ELSE href END AS target FROM f"""


def section_map(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ["Past papers", "Endorsed resources", "Contact", "Support material", "All PAST PAPERS"]))
    p = table(spark, d, "pages")
    return web.section_map(p, web.links(p).withColumn("text", F.get(names, (F.col("ord") + F.col("page_id")) % 5)))


SECTION_SQL = f"""WITH {LINK_SQL},
lab AS (SELECT *, CASE (ord + page_id) % 5 WHEN 0 THEN 'p' WHEN 4 THEN 'p' WHEN 1 THEN 'r' WHEN 3 THEN 's' END AS label, regexp_replace(url, '/+$', '') || href || '/' AS target FROM links WHERE href <> '')
SELECT p.page_id, regexp_replace(any_value(p.url), '/+$', '') || '/' AS syllabus, arg_max(l.target, l.ord) FILTER (WHERE l.label = 'p') AS past_papers,
  arg_max(l.target, l.ord) FILTER (WHERE l.label = 'r') AS published_resources, arg_max(l.target, l.ord) FILTER (WHERE l.label = 's') AS support
FROM pages p LEFT JOIN lab l ON l.page_id = p.page_id GROUP BY p.page_id"""


def course_urls(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", c.course_url(F.lower("p_type"), F.lower("p_brand")).alias("url"), c.version_of("document").alias("version"))


def syllabus_overview(spark: SparkSession, d: str) -> DataFrame:
    o = sections.syllabus_overview(a.syllabus_lines(table(spark, d, "documents")))
    topic = F.transform("topics", lambda t: F.concat(t["number"].cast("string"), F.lit(" "), t["name"]))
    objective = F.transform("objectives", lambda x: F.concat_ws(" ", x["code"], x["weight"].cast("string"), x["name"], x["description"]))
    return o.select("resource_id", F.array_join(topic, ";").alias("topics"), F.array_join(objective, ";").alias("objectives"))


def image_elements(spark: SparkSession, d: str) -> DataFrame:
    items = a.order_items(table(spark, d, "lineitem"))
    names = items.select(F.col("l_orderkey").alias("resource_id"), F.col("ord").alias("op_idx"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_returnflag")).alias("name"))
    ops = a.order_operations(items).join(names, ["resource_id", "op_idx"]).withColumn("fn", F.when(F.col("op_idx") % 2 == 0, "paintInlineImageXObject").otherwise(F.col("fn")))
    return geometry.image_elements(geometry.track_ctm(ops)).select("resource_id", "page", "n", "element_id", "name")


QUERIES = {
    "document_statistics": (
        document_statistics,
        f"""WITH {ITEMS} SELECT l_orderkey AS resource_id, count(DISTINCT l_linenumber % 3) AS n_pages, count(CASE WHEN l_linenumber > 1 THEN 1 END) AS n_text, count(CASE WHEN ord % 5 = 4 THEN 1 END) AS n_images,
        count(CASE WHEN ord % 5 = 3 THEN 1 END) AS n_drawings, count(DISTINCT CASE WHEN l_linenumber > 1 THEN l_returnflag END) AS n_fonts, CASE WHEN count(CASE WHEN l_linenumber > 1 THEN 1 END) = 0 THEN 'scanned' ELSE 'hybrid' END AS kind,
        CASE WHEN count(CASE WHEN l_linenumber > 1 THEN 1 END) = 0 THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM items GROUP BY l_orderkey""",
    ),
    "syllabus_topic_assign": (syllabus_topic_assign, _syllabus_topic_sql()),
    "quality_question_marks": (
        quality_question_marks,
        f"""{PAPER}, sub AS (SELECT resource_id, q, p, sum(coalesce(marks, 0)) AS m FROM nodes WHERE level = 'subpart' GROUP BY 1, 2, 3),
        pt AS (SELECT n.resource_id, n.q, sum(coalesce(n.marks, sub.m, 0)) AS sum_marks FROM nodes n LEFT JOIN sub ON sub.resource_id = n.resource_id AND sub.q = n.q AND sub.p = n.p WHERE n.level = 'part' GROUP BY 1, 2)
        SELECT n.resource_id, n.q, n.marks AS total, pt.sum_marks, n.marks = pt.sum_marks AS agrees FROM nodes n JOIN pt ON pt.resource_id = n.resource_id AND pt.q = n.q WHERE n.level = 'question' AND n.marks IS NOT NULL""",
    ),
    "course_scan": (
        course_scan,
        """SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN 'Course ' || o_orderkey END AS course, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN o_orderkey || '/x' END AS exam_code,
        CASE WHEN o_orderkey % 7 <> 0 THEN CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 2 END END AS n_papers, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 4 > 1 THEN CAST(o_orderkey AS VARCHAR) END AS first_code,
        CASE WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_orderkey % 4 = 0 THEN 'no past papers' END AS error FROM orders""",
    ),
    "busiest_pages": (
        busiest_pages,
        f"""{ONLY_LINES}, n AS (SELECT resource_id, page, count(*) AS n FROM lines GROUP BY 1, 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY n DESC, page) AS rank FROM n) WHERE rank <= 2""",
    ),
    "resolve_urls": (resolve_urls, RESOLVE_SQL),
    "section_map": (section_map, SECTION_SQL),
    "course_urls": (course_urls, "SELECT p_partkey, 'https://www.savemyexams.com/' || lower(p_type) || '/' || lower(p_brand) || '/cie/past-papers/' AS url, '0.2.0' AS version FROM part"),
    "syllabus_overview": (
        syllabus_overview,
        f"""WITH {SYLLABUS}, t AS (SELECT resource_id, string_agg(number || ' ' || name, ';' ORDER BY ord) AS topics FROM top GROUP BY 1),
        o AS (SELECT b.resource_id, string_agg(concat_ws(' ', b.code, CAST(w.weight AS VARCHAR), b.name, b.description), ';' ORDER BY b.block) AS objectives FROM blocks b LEFT JOIN weights w ON w.resource_id = b.resource_id AND w.code = b.code GROUP BY 1)
        SELECT d.doc_id AS resource_id, coalesce(t.topics, '') AS topics, coalesce(o.objectives, '') AS objectives FROM documents d LEFT JOIN t ON t.resource_id = d.doc_id LEFT JOIN o ON o.resource_id = d.doc_id""",
    ),
    "image_elements": (
        image_elements,
        f"""WITH {ITEMS}, im AS (SELECT l_orderkey AS resource_id, ord, l_returnflag AS name FROM items WHERE (ord % 2 = 0 OR ord % 5 = 4) AND l_linenumber % 3 > 0)
        SELECT resource_id, 1 AS page, row_number() OVER w - 1 AS n, '1-image-' || (row_number() OVER w - 1) AS element_id, name FROM im WINDOW w AS (PARTITION BY resource_id ORDER BY ord)""",
    ),
}

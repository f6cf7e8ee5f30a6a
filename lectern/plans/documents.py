"""Queries over documents and conversations shaped as exam papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as rules
from lectern.functions.text import S, extract, extract_int, strip_marks, trim
from lectern.operators import knowledge, lines, questions, sections, topics
from lectern.sources import adapters as a
from lectern.sources.adapters import table


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return a.document_lines(table(spark, d, "documents"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    ls = _lines(spark, d)
    return questions.build_questions(ls, a.document_elements(ls))


def _talk(spark: SparkSession, d: str) -> DataFrame:
    return questions.build_questions(a.conversation_lines(table(spark, d, "conversations")))


def _flat(nodes: DataFrame) -> DataFrame:
    """Nodes with arrays written as text, as SQL has them."""
    options = F.array_join(F.transform("options", lambda o: F.concat(o["label"], F.lit("="), o["text"])), "|")
    return nodes.withColumns({"pages": F.array_join("pages", ","), "options": options, **{k: F.array_join(k, ",") for k in ("images", "drawings", "tables")}})


def sql_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{S}+|{S}+\z', '', 'g')"


def sql_get(x: str, pattern: str, group: int = 1) -> str:
    return f"(CASE WHEN regexp_matches({x}, '{pattern}') THEN regexp_extract({x}, '{pattern}', {group}) END)"


def sql_strip(x: str) -> str:
    return sql_trim(f"regexp_replace(regexp_replace({x}, '{rules.TOTAL_MARKS}', ''), '{rules.MARKS}', '')")


LINES = """
raw AS (
  SELECT doc_id AS resource_id, unnest(string_split(replace(text, chr(10), ' '), '. ')) AS raw,
         generate_subscripts(string_split(replace(text, chr(10), ' '), '. '), 1) - 1 AS p
  FROM documents),
lines AS (
  SELECT resource_id, CAST(p // 12 + 1 AS INT) AS page, CAST(p AS INT) AS ord,
         CASE p % 6 WHEN 0 THEN CAST(p // 6 % 99 + 1 AS VARCHAR) || ' ' || raw WHEN 1 THEN '(a) ' || raw WHEN 2 THEN raw || ' [3]'
                    WHEN 3 THEN '(b) ' || raw WHEN 4 THEN '(i) ' || raw || ' [2]' ELSE raw || ' [Total: 5]' END AS text,
         CASE p % 6 WHEN 0 THEN 50.0 WHEN 1 THEN 72.0 WHEN 2 THEN 95.0 WHEN 3 THEN 72.0 WHEN 4 THEN 96.0 ELSE 504.0 END::DOUBLE AS x,
         (62 + 20 * (p % 12))::DOUBLE AS y, (6 * length(raw))::DOUBLE AS width, 11.0::DOUBLE AS height
  FROM raw WHERE trim(raw) <> '')"""

ELEMENTS = """
elements AS (
  SELECT resource_id, page, ord, y + 1 AS y, kind, page || '-' || kind || '-' || ord AS element_id
  FROM (SELECT *, CASE ord % 12 WHEN 2 THEN 'image' WHEN 4 THEN 'drawing' WHEN 8 THEN 'table' END AS kind FROM lines) WHERE kind IS NOT NULL)"""

MARGIN = """
margin AS (
  SELECT resource_id, coalesce(min(CASE WHEN n >= 3 THEN bucket END), min(x)) AS left_margin
  FROM (SELECT resource_id, floor(x + 0.5) AS bucket, count(*) AS n, min(x) AS x FROM lines GROUP BY resource_id, floor(x + 0.5)) GROUP BY resource_id)"""

CLASSIFIED = rf"""
t AS (SELECT l.*, {sql_trim('l.text')} AS t, m.left_margin FROM lines l JOIN margin m USING (resource_id)),
roles AS (
  SELECT *, {sql_trim(sql_get('t', rules.SUBPART, 2))} AS after_sub, {sql_trim(sql_get('t', rules.QUESTION, 2))} AS after_q,
    CASE WHEN regexp_matches(t, '{rules.COPYRIGHT}') OR regexp_matches(t, '{rules.BLANK_PAGE}') OR (regexp_matches(t, '{rules.PAGE_NUMBER}') AND y < 60) THEN 'boilerplate'
         WHEN regexp_matches(t, '{rules.SUBPART}') THEN 'subpart'
         WHEN regexp_matches(t, '{rules.SUBSUBPART}') THEN 'subSubpart'
         WHEN regexp_matches(t, '{rules.QUESTION}') AND x <= left_margin + 5 THEN 'questionNumber'
         WHEN regexp_matches(t, '{rules.INLINE_OPTIONS}') THEN 'inline'
         WHEN regexp_matches(t, '{rules.OPTION}') THEN 'option' ELSE 'body' END AS r
  FROM t),
roles2 AS (SELECT *, {sql_trim(sql_get('after_q', rules.SUBPART, 2))} AS after_emb FROM roles),
classified AS (
  SELECT resource_id, page, ord, text, x, y, width, height, CASE WHEN r IN ('inline', 'option') THEN 'body' ELSE r END AS role,
    CASE WHEN r = 'questionNumber' THEN CAST({sql_get('t', rules.QUESTION)} AS INT) END AS question_number,
    CASE r WHEN 'subpart' THEN {sql_get('t', rules.SUBPART)} WHEN 'subSubpart' THEN {sql_get('t', rules.SUBSUBPART)} WHEN 'questionNumber' THEN {sql_get('after_q', rules.SUBPART)} END AS part_label,
    CASE r WHEN 'subpart' THEN {sql_get('after_sub', rules.SUBSUBPART)} WHEN 'questionNumber' THEN {sql_get('after_emb', rules.SUBSUBPART)} END AS nested_label,
    sub_ord,
    {sql_strip(f'''CASE r WHEN 'subpart' THEN coalesce({sql_trim(sql_get('after_sub', rules.SUBSUBPART, 2))}, after_sub)
      WHEN 'subSubpart' THEN {sql_trim(sql_get('t', rules.SUBSUBPART, 2))}
      WHEN 'questionNumber' THEN coalesce({sql_trim(sql_get('after_emb', rules.SUBSUBPART, 2))}, after_emb, after_q)
      WHEN 'option' THEN {sql_trim(sql_get('t', rules.OPTION, 2))}
      WHEN 'inline' THEN {sql_trim(f"CASE sub_ord WHEN 0 THEN regexp_extract(t, '{rules.INLINE_OPTIONS}', 1) WHEN 1 THEN regexp_extract(t, '{rules.INLINE_OPTIONS}', 2) WHEN 2 THEN regexp_extract(t, '{rules.INLINE_OPTIONS}', 3) ELSE regexp_extract(t, '{rules.INLINE_OPTIONS}', 4) END")}
      ELSE t END''')} AS content,
    CASE r WHEN 'option' THEN {sql_get('t', rules.OPTION)} WHEN 'inline' THEN substr('ABCD', sub_ord + 1, 1) END AS option_label,
    CASE WHEN r <> 'inline' THEN TRY_CAST({sql_get('t', rules.MARKS)} AS INT) END AS marks,
    CASE WHEN r <> 'inline' THEN TRY_CAST({sql_get('t', rules.TOTAL_MARKS)} AS INT) END AS total_marks
  FROM roles2 CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS sub_ord) WHERE r = 'inline' OR sub_ord = 0)"""

NODES = """
events AS (
  SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY page, y, CASE kind WHEN 'line' THEN 0 WHEN 'image' THEN 1 WHEN 'drawing' THEN 2 ELSE 3 END, ord, sub_ord) AS event_no
  FROM (SELECT resource_id, page, y, 'line' AS kind, ord, sub_ord, NULL AS element_id, role, content, question_number, part_label, nested_label, marks, total_marks, option_label FROM classified
        UNION ALL SELECT resource_id, page, y, kind, ord, 0, element_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM elements)),
e1 AS (SELECT * FROM (SELECT *, count(CASE WHEN role = 'questionNumber' THEN 1 END) OVER (PARTITION BY resource_id ORDER BY event_no) AS q FROM events) WHERE q > 0),
e2 AS (SELECT *, count(CASE WHEN role = 'subpart' OR role = 'questionNumber' AND part_label IS NOT NULL THEN 1 END) OVER (PARTITION BY resource_id, q ORDER BY event_no) AS p FROM e1),
e3 AS (SELECT * FROM e2 WHERE role IS NULL OR role <> 'boilerplate' AND (role <> 'subSubpart' OR p > 0)),
e4 AS (SELECT *, CASE WHEN p > 0 THEN count(CASE WHEN role = 'subSubpart' OR role IN ('subpart', 'questionNumber') AND nested_label IS NOT NULL THEN 1 END) OVER (PARTITION BY resource_id, q, p ORDER BY event_no) ELSE 0 END AS s FROM e3),
stem AS (SELECT resource_id, q, event_no, option_label, row_number() OVER (PARTITION BY resource_id, q ORDER BY event_no) AS n FROM e4 WHERE role = 'body' AND p = 0),
run_a AS (SELECT resource_id, q, min(n) AS a FROM stem WHERE option_label = 'A' GROUP BY 1, 2),
run_k AS (SELECT s.*, n - a AS k, coalesce(option_label = substr('ABCD', CAST(n - a + 1 AS INT), 1), false) AS fits FROM stem s JOIN run_a USING (resource_id, q) WHERE n - a BETWEEN 0 AND 3),
run_n AS (SELECT resource_id, q, coalesce(min(CASE WHEN NOT fits THEN k END), max(k) + 1) AS len FROM run_k GROUP BY 1, 2),
opt AS (SELECT resource_id, event_no, CASE WHEN len = 4 THEN 'option' ELSE 'recovered' END AS state FROM run_k JOIN run_n USING (resource_id, q) WHERE k < len),
located AS (SELECT e4.*, opt.state, CASE WHEN s > 0 THEN 2 WHEN p > 0 THEN 1 ELSE 0 END AS deep FROM e4 LEFT JOIN opt USING (resource_id, event_no)),
spread AS (SELECT l.*, lv, lv = deep AS here FROM located l JOIN (SELECT unnest([0, 1, 2]) AS lv) ON lv <= deep),
given AS (
  SELECT *, CASE WHEN lv >= 1 THEN p ELSE 0 END AS np, CASE WHEN lv >= 2 THEN s ELSE 0 END AS ns,
    CASE WHEN lv = 0 THEN CASE WHEN state IS NOT NULL THEN NULL
           WHEN p = 0 AND role = 'questionNumber' THEN coalesce(total_marks, marks) WHEN p = 0 AND role = 'body' THEN coalesce(marks, total_marks) ELSE total_marks END
         WHEN here THEN marks END AS g
  FROM spread),
pages AS (SELECT resource_id, q, np, ns, string_agg(CAST(page AS VARCHAR), ',' ORDER BY first) AS pages
          FROM (SELECT resource_id, q, np, ns, page, min(event_no) AS first FROM given WHERE role IS NOT NULL GROUP BY ALL) GROUP BY ALL),
nodes AS (
  SELECT resource_id, q, np AS p, ns AS s, CASE max(lv) WHEN 0 THEN 'question' WHEN 1 THEN 'part' ELSE 'subpart' END AS level,
    max(CASE WHEN lv = 0 AND role = 'questionNumber' THEN question_number END) AS number,
    max(CASE WHEN lv = 1 AND role IN ('questionNumber', 'subpart') THEN part_label WHEN lv = 2 AND role = 'subSubpart' THEN part_label WHEN lv = 2 AND role IN ('subpart', 'questionNumber') THEN nested_label END) AS label,
    TRIMMED AS text,
    arg_max(g, event_no) FILTER (WHERE g IS NOT NULL) AS marks,
    any_value(pg.pages) AS pages,
    coalesce(string_agg(option_label || '=' || content, '|' ORDER BY event_no) FILTER (WHERE here AND state = 'option'), '') AS options,
    coalesce(string_agg(element_id, ',' ORDER BY event_no) FILTER (WHERE here AND kind = 'image'), '') AS images,
    coalesce(string_agg(element_id, ',' ORDER BY event_no) FILTER (WHERE here AND kind = 'drawing'), '') AS drawings,
    coalesce(string_agg(element_id, ',' ORDER BY event_no) FILTER (WHERE here AND kind = 'table'), '') AS tables
  FROM given JOIN pages pg USING (resource_id, q, np, ns) GROUP BY resource_id, q, np, ns)""".replace(
    "TRIMMED",
    sql_trim("coalesce(string_agg(CASE WHEN state = 'recovered' THEN option_label || ' ' || content ELSE content END, ' ' ORDER BY event_no) FILTER (WHERE role IS NOT NULL AND here AND coalesce(state, '') <> 'option'), '')"),
)

PAPER = f"WITH RECURSIVE {LINES}, {ELEMENTS}, {MARGIN}, {CLASSIFIED}, {NODES}"
ONLY_LINES = f"WITH {LINES}"
UPTO_ROLES = f"WITH {LINES}, {MARGIN}, {CLASSIFIED}"

CONVERSATION_LINES = """
lines AS (
  SELECT conv_id AS resource_id, 1 AS page, CAST(turn AS INT) AS ord,
         CASE WHEN turn = 0 THEN '1 ' WHEN role = 'system' THEN 'note ' ELSE substr('ABCD', CAST((turn - 1) % 4 + 1 AS INT), 1) || ' ' END || replace(text, chr(10), ' ') AS text,
         CASE WHEN turn = 0 THEN 50.0 ELSE 80.0 END::DOUBLE AS x, (100 + 20 * turn)::DOUBLE AS y, 100.0::DOUBLE AS width, 11.0::DOUBLE AS height
  FROM conversations)"""
NO_ELEMENTS = "elements AS (SELECT resource_id, page, ord, y, 'image' AS kind, '' AS element_id FROM lines WHERE false)"
TALK = f"WITH RECURSIVE {CONVERSATION_LINES}, {NO_ELEMENTS}, {MARGIN}, {CLASSIFIED}, {NODES}"

NODE_COLUMNS = "resource_id, q, p, s, level, number, label, text, marks, pages, options, images, drawings, tables"


def role_counts(spark: SparkSession, d: str) -> DataFrame:
    c = questions.classify_lines(_lines(spark, d))
    return c.groupBy("role").agg(F.count("*").alias("n"), F.sum("marks").alias("marks"), F.sum("total_marks").alias("total_marks"))


def left_margin(spark: SparkSession, d: str) -> DataFrame:
    return lines.left_margin(_lines(spark, d))


def boilerplate_filter(spark: SparkSession, d: str) -> DataFrame:
    ls = _lines(spark, d).withColumn("text", F.when(F.col("ord") % 12 == 7, F.col("page").cast("string")).when(F.col("ord") % 12 == 8, F.lit("© X")).otherwise(F.col("text")))
    ls = ls.withColumn("y", F.col("y") - F.when(F.col("page") % 2 == 0, 200.0).otherwise(0.0))
    return ls.where(~questions.is_boilerplate(trim(F.col("text")), F.col("y"))).select("resource_id", "ord", "text")


def classified_lines(spark: SparkSession, d: str) -> DataFrame:
    c = questions.classify_lines(_lines(spark, d))
    return c.select("resource_id", "ord", "role", "content", "question_number", "part_label", "nested_label", "marks", "total_marks", "option_label", "sub_ord")


def _pattern(name: str, pattern: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = trim(F.col("text"))
        return _lines(spark, d).where(t.rlike(pattern)).select("resource_id", "ord", extract(t, pattern, 1).alias("label"), trim(extract(t, pattern, 2)).alias("rest"))

    run.__name__ = name
    sql = f"{ONLY_LINES} SELECT resource_id, ord, regexp_extract(t, '{pattern}', 1) AS label, {sql_trim(f'''regexp_extract(t, '{pattern}', 2)''')} AS rest FROM (SELECT *, {sql_trim('text')} AS t FROM lines) WHERE regexp_matches(t, '{pattern}')"
    return run, sql


def marks_extract(spark: SparkSession, d: str) -> DataFrame:
    t = trim(F.col("text"))
    return _lines(spark, d).select("resource_id", "ord", extract_int(t, rules.MARKS).alias("marks"), extract_int(t, rules.TOTAL_MARKS).alias("total_marks"))


def marks_strip(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("resource_id", "ord", strip_marks(F.col("text")).alias("content"))


def option_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = questions.classify_lines(a.conversation_lines(table(spark, d, "conversations")))
    return c.where("option_label is not null").select("resource_id", "ord", "option_label", "content")


def inline_options_explode(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    text = F.concat(F.lit("A "), "p_name", F.lit("  B "), "p_brand", F.lit(" C "), F.col("p_size").cast("string"), F.lit(" D "), "p_type", F.lit(" [1]"))
    ls = p.select(F.col("p_partkey").alias("resource_id"), F.lit(1).alias("page"), F.lit(0).alias("ord"), text.alias("text"), F.lit(80.0).alias("x"), F.lit(100.0).alias("y"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"))
    return questions.classify_lines(ls).select("resource_id", "role", "sub_ord", "option_label", "content", "marks")


def reconstruct_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.reconstruct_lines(a.document_runs(_lines(spark, d)))


def event_merge(spark: SparkSession, d: str) -> DataFrame:
    ls = _lines(spark, d)
    return questions.merge_events(questions.classify_lines(ls), a.document_elements(ls)).select("resource_id", "event_no", "kind", "page", "ord", "element_id")


def question_tree_flat(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_nodes(spark, d))


def question_tree_nested(spark: SparkSession, d: str) -> DataFrame:
    n = questions.nested_questions(_nodes(spark, d))
    inner = F.transform("parts", lambda p: F.concat(p["label"], F.lit(":"), F.array_join(F.transform(p["sub_parts"], lambda s: s["label"]), "+")))
    return n.select("resource_id", "q", "number", "marks", F.coalesce(F.array_join(inner, ";"), F.lit("")).alias("outline"))


def option_runs(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_talk(spark, d)).select("resource_id", "q", "number", "text", "options", "marks", "pages")


def element_refs(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.ref_totals(_nodes(spark, d))


def page_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_nodes(spark, d)).select("resource_id", "q", "p", "s", "pages")


def doc_statistics(spark: SparkSession, d: str) -> DataFrame:
    return lines.page_statistics(_pages(spark, d))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    c = _lines(spark, d)
    return c.groupBy("resource_id", "page").agg(
        F.count("*").alias("n_text"), F.sum((F.col("ord") % 12 == 2).cast("int")).alias("n_images"), F.sum((F.col("ord") % 12 == 4).cast("int")).alias("n_paths"), F.collect_set(F.col("x").cast("string")).alias("fonts")
    )


def doc_type(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", F.floor(F.col("n_chars") / 5).alias("n_text"), (F.col("doc_id") % 30).alias("n_images"))
    s = s.withColumn("n_text", F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.col("n_text")))
    return s.withColumn("k", lines.layout_kind(F.col("n_text"), F.col("n_images"))).select("doc_id", "n_text", "k.kind", "k.confidence")


def report_papers(spark: SparkSession, d: str) -> DataFrame:
    return sections.report_papers(a.report_lines(table(spark, d, "conversations")))


def question_comments(spark: SparkSession, d: str) -> DataFrame:
    return sections.question_comments(a.report_lines(table(spark, d, "conversations")))


def paper_first_wins(spark: SparkSession, d: str) -> DataFrame:
    papers = sections.report_papers(a.report_lines(table(spark, d, "conversations"))).withColumn("paper", F.concat(F.lit("0001/1"), (F.col("paper_no") % 3).cast("string")))
    return sections.pick_paper(papers, "0001/12").select("resource_id", "paper", "n_lines")


def syllabus_topics(spark: SparkSession, d: str) -> DataFrame:
    return sections.syllabus_topics(a.syllabus_lines(table(spark, d, "documents")))


def ao_blocks(spark: SparkSession, d: str) -> DataFrame:
    return sections.objective_blocks(a.syllabus_lines(table(spark, d, "documents")))


def ao_weights(spark: SparkSession, d: str) -> DataFrame:
    return sections.assessment_objectives(a.syllabus_lines(table(spark, d, "documents"))).select("resource_id", "block", "code", "weight")


def quality_options(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.option_summary(_talk(spark, d))


def quality_sequence(spark: SparkSession, d: str) -> DataFrame:
    c = questions.classify_lines(_lines(spark, d)).where("question_number is not null")
    return knowledge.sequence_breaks(c, "resource_id", "question_number", "ord")


def document_topics(spark: SparkSession, d: str) -> DataFrame:
    q = topics.question_text(_nodes(spark, d))
    found = topics.assign_topics(q, DOCUMENT_TOPICS)
    return found.select("resource_id", "question", "topic_no", "topic", F.array_join("matched", ",").alias("matched"))


DOCUMENT_TOPICS = {"first": ["the", "idiot", "nt"], "second": ["les", "une", "nicht"], "third": ["that of", "de la", "e.m.f."]}

REPORT_LINES = """
rep AS (
  SELECT conv_id // 16 AS resource_id, conv_id * 100 + turn * 10 + i - 1 AS ord, ls[i] AS text, CASE WHEN turn = 3 AND i = 2 THEN 820.0 ELSE 100.0 + turn END AS y
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (
    SELECT conv_id, turn, list_concat(CASE turn WHEN 0 THEN ['Paper ' || lpad(CAST(conv_id % 10000 AS VARCHAR), 4, '0') || '/11', 'General comments']
           WHEN 1 THEN ['Comments on specific questions', 'Question 1'] ELSE ['Question ' || turn] END, [replace(text, chr(10), ' ')]) AS ls FROM conversations))),
body AS (SELECT *, TT AS t FROM rep WHERE y BETWEEN 40 AND 800),
marked AS (SELECT *, CASE WHEN regexp_matches(t, 'PM') THEN regexp_extract(t, 'PM', 1) END AS m FROM body),
chunks AS (SELECT *, count(m) OVER w AS paper_no, last_value(m IGNORE NULLS) OVER w AS paper FROM marked WINDOW w AS (PARTITION BY resource_id ORDER BY ord)),
ch AS (SELECT * FROM chunks WHERE m IS NULL AND paper_no > 0),
marks AS (SELECT *, min(CASE WHEN t = 'General comments' THEN ord END) OVER w AS gs, min(CASE WHEN t = 'Comments on specific questions' THEN ord END) OVER w AS cs FROM ch WINDOW w AS (PARTITION BY resource_id, paper_no)),
general AS (SELECT resource_id, paper_no, GG AS general_comments FROM marks WHERE ord > gs AND (cs IS NULL OR cs < gs OR ord < cs) GROUP BY 1, 2),
papers AS (SELECT c.resource_id, c.paper_no, c.paper, coalesce(any_value(g.general_comments), '') AS general_comments, count(*) AS n_lines
           FROM ch c LEFT JOIN general g USING (resource_id, paper_no) GROUP BY 1, 2, 3),
heads AS (SELECT *, TRY_CAST(CASE WHEN regexp_matches(t, 'QH') THEN regexp_extract(t, 'QH', 1) END AS INT) AS qn FROM marks WHERE ord > cs),
blocks AS (SELECT * FROM (SELECT *, count(qn) OVER (PARTITION BY resource_id, paper_no ORDER BY ord) AS block FROM heads) WHERE block > 0),
comments AS (SELECT resource_id, paper_no, paper, block, max(qn) AS question_number, CC AS comment FROM blocks GROUP BY 1, 2, 3, 4)
""".replace("TT", sql_trim("text")).replace("PM", rules.PAPER_MARKER).replace("QH", rules.QUESTION_HEADING).replace("GG", sql_trim("string_agg(t, ' ' ORDER BY ord)")).replace(
    "CC", sql_trim("coalesce(string_agg(t, ' ' ORDER BY ord) FILTER (WHERE qn IS NULL), '')")
)

SYLLABUS = rf"""
parts AS (SELECT doc_id AS resource_id, unnest(string_split(replace(text, chr(10), ' '), '. ')) AS s, generate_subscripts(string_split(replace(text, chr(10), ' '), '. '), 1) - 1 AS i FROM documents),
syl AS (SELECT *, {sql_trim('text')} AS t FROM (
  SELECT doc_id AS resource_id, h.ord, h.t AS text, 50 AS x FROM documents CROSS JOIN (SELECT unnest([
    {{'ord': 0, 't': 'Content overview'}}, {{'ord': 2000000, 't': 'Assessment overview'}}, {{'ord': 3000000, 't': 'Assessment objectives'}}, {{'ord': 5000000, 't': 'Weighting for assessment objectives'}},
    {{'ord': 5000001, 't': 'Assessment objective Weighting in IGCSE %'}}, {{'ord': 7000000, 't': 'Assessment objectives as a percentage of each component'}}, {{'ord': 7000001, 't': 'AO1 x 99'}}]) AS h)
  UNION ALL SELECT resource_id, i + 1, (i % 9) || ' ' || s, CASE WHEN i % 3 = 1 THEN 17 ELSE 55 END FROM parts
  UNION ALL SELECT resource_id, i + 3000001, CASE i % 3 WHEN 0 THEN 'AO' || (i % 9) || ' ' || s WHEN 1 THEN '• ' || s ELSE s END, 55 FROM parts
  UNION ALL SELECT resource_id, i + 5000002, 'AO' || (i % 9) || ' ' || s || ' ' || (i % 60), 55 FROM parts)),
top AS (SELECT resource_id, ord, CAST(regexp_extract(t, '{rules.TOPIC_ROW}', 1) AS INT) AS number, {sql_trim(f"regexp_extract(t, '{rules.TOPIC_ROW}', 2)")} AS name
        FROM syl WHERE ord BETWEEN 1 AND 1999999 AND x BETWEEN 50 AND 65 AND regexp_matches(t, '{rules.TOPIC_ROW}')),
obj AS (SELECT * FROM (SELECT *, {sql_get('t', rules.AO_HEADING)} AS code, count({sql_get('t', rules.AO_HEADING)}) OVER (PARTITION BY resource_id ORDER BY ord) AS block FROM syl WHERE ord BETWEEN 3000001 AND 4999999 AND x BETWEEN 50 AND 65) WHERE block > 0),
blocks AS (SELECT resource_id, block, max(code) AS code, max(CASE WHEN code IS NOT NULL THEN {sql_trim(sql_get('t', rules.AO_HEADING, 2))} END) AS name,
           coalesce(string_agg({sql_trim(sql_get('t', rules.AO_BULLET))}, '|' ORDER BY ord) FILTER (WHERE regexp_matches(t, '{rules.AO_BULLET}')), '') AS description FROM obj GROUP BY 1, 2),
weights AS (SELECT resource_id, regexp_extract(t, '{rules.AO_WEIGHT}', 1) AS code, arg_max(TRY_CAST(regexp_extract(t, '{rules.AO_WEIGHT}', 2) AS INT), ord) AS weight
            FROM syl WHERE ord BETWEEN 5000002 AND 6999999 AND regexp_matches(t, '{rules.AO_WEIGHT}') GROUP BY 1, 2)"""

RUNS = rf"""
runs0 AS (
  SELECT resource_id, page, ord * 2 + 1 AS ord, substr(text, 1, CAST(length(text) // 2 AS INT)) AS text, x, y, height FROM lines
  UNION ALL SELECT resource_id, page, ord * 2, substr(text, CAST(length(text) // 2 + 1 AS INT)), x + 6 * (length(text) // 2), y + 2, height FROM lines),
runs AS (SELECT *, 6.0 * length(text) AS width, y + height / 2 AS cy, row_number() OVER (PARTITION BY resource_id, page ORDER BY y + height / 2, x, ord) AS k FROM runs0 WHERE {sql_trim('text')} <> ''),
walk AS (
  SELECT resource_id, page, k, 0 AS line_ord, cy AS anchor, height AS last_h FROM runs WHERE k = 1
  UNION ALL
  SELECT r.resource_id, r.page, r.k, CASE WHEN abs(r.cy - w.anchor) <= 0.5 * greatest(r.height, w.last_h) THEN w.line_ord ELSE w.line_ord + 1 END,
         CASE WHEN abs(r.cy - w.anchor) <= 0.5 * greatest(r.height, w.last_h) THEN w.anchor ELSE r.cy END, r.height
  FROM walk w JOIN runs r ON r.resource_id = w.resource_id AND r.page = w.page AND r.k = w.k + 1)"""

WORD_EDGE = {"nt": r"\bnts?\b"}


def _topic_sql() -> str:
    scores = []
    for i, (t, ks) in enumerate(DOCUMENT_TOPICS.items(), 1):
        tests = ", ".join(f"CASE WHEN regexp_matches(low, '\\b{k.replace('.', chr(92) + '.')}{'' if ' ' in k else 's?'}\\b') THEN '{k}' END" for k in ks)
        scores.append(f"SELECT resource_id, question, {i} AS topic_no, '{t}' AS topic, list_filter([{tests}], lambda x: x IS NOT NULL) AS m FROM qt")
    return f"""{PAPER},
qt AS (SELECT resource_id, q AS question, lower(string_agg(CASE WHEN options <> '' THEN concat_ws(' ', text, regexp_replace(replace(options, '|', ' '), '([A-D])=', '', 'g')) ELSE text END, ' ' ORDER BY p, s)) AS low FROM nodes GROUP BY 1, 2),
sc AS ({' UNION ALL '.join(scores)}),
best AS (SELECT *, max(len(m)) OVER (PARTITION BY resource_id, question) AS b FROM sc),
lead AS (SELECT resource_id, question, any_value(topic_no) AS topic_no, any_value(topic) AS topic, any_value(m) AS m FROM best WHERE len(m) = b AND b > 0 GROUP BY 1, 2 HAVING count(*) = 1)
SELECT qt.resource_id, qt.question, l.topic_no, l.topic, coalesce(array_to_string(l.m, ','), '') AS matched FROM qt LEFT JOIN lead l USING (resource_id, question)"""


QUERIES = {
    "role_counts": (role_counts, f"{UPTO_ROLES} SELECT role, count(*) AS n, sum(marks) AS marks, sum(total_marks) AS total_marks FROM classified GROUP BY role"),
    "left_margin": (left_margin, f"WITH {LINES}, {MARGIN} SELECT * FROM margin"),
    "boilerplate_filter": (
        boilerplate_filter,
        rf"""{ONLY_LINES}, b AS (SELECT resource_id, ord, CASE ord % 12 WHEN 7 THEN CAST(page AS VARCHAR) WHEN 8 THEN '© X' ELSE text END AS text, y - CASE WHEN page % 2 = 0 THEN 200 ELSE 0 END AS y FROM lines),
        t AS (SELECT *, {sql_trim('text')} AS t FROM b)
        SELECT resource_id, ord, text FROM t WHERE NOT (regexp_matches(t, '{rules.COPYRIGHT}') OR regexp_matches(t, '{rules.BLANK_PAGE}') OR (regexp_matches(t, '{rules.PAGE_NUMBER}') AND y < 60))""",
    ),
    "classified_lines": (classified_lines, f"{UPTO_ROLES} SELECT resource_id, ord, role, content, question_number, part_label, nested_label, marks, total_marks, option_label, sub_ord FROM classified"),
    "subpart_extract": _pattern("subpart_extract", rules.SUBPART),
    "subsubpart_extract": _pattern("subsubpart_extract", rules.SUBSUBPART),
    "question_number_extract": _pattern("question_number_extract", rules.QUESTION),
    "marks_extract": (marks_extract, f"{ONLY_LINES} SELECT resource_id, ord, TRY_CAST({sql_get('t', rules.MARKS)} AS INT) AS marks, TRY_CAST({sql_get('t', rules.TOTAL_MARKS)} AS INT) AS total_marks FROM (SELECT *, {sql_trim('text')} AS t FROM lines)"),
    "marks_strip": (marks_strip, f"{ONLY_LINES} SELECT resource_id, ord, {sql_strip('text')} AS content FROM lines"),
    "option_candidates": (option_candidates, f"WITH {CONVERSATION_LINES}, {MARGIN}, {CLASSIFIED} SELECT resource_id, ord, option_label, content FROM classified WHERE option_label IS NOT NULL"),
    "inline_options_explode": (
        inline_options_explode,
        f"""WITH lines AS (SELECT p_partkey AS resource_id, 1 AS page, 0 AS ord, 'A ' || p_name || '  B ' || p_brand || ' C ' || p_size || ' D ' || p_type || ' [1]' AS text, 80.0 AS x, 100.0 AS y, 1.0 AS width, 1.0 AS height FROM part),
        {MARGIN}, {CLASSIFIED} SELECT resource_id, role, sub_ord, option_label, content, marks FROM classified""",
    ),
    "reconstruct_lines": (
        reconstruct_lines,
        f"""WITH RECURSIVE {LINES}, {RUNS}
        SELECT resource_id, page, line_ord, string_agg({sql_trim('text')}, ' ' ORDER BY x, cy, ord) AS text, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height, count(*) AS n_runs
        FROM walk JOIN runs USING (resource_id, page, k) GROUP BY 1, 2, 3""",
    ),
    "event_merge": (event_merge, f"{PAPER} SELECT resource_id, event_no, kind, page, ord, element_id FROM events"),
    "question_tree_flat": (question_tree_flat, f"{PAPER} SELECT {NODE_COLUMNS} FROM nodes"),
    "question_tree_nested": (
        question_tree_nested,
        f"""{PAPER}, subs AS (SELECT resource_id, q, p, string_agg(label, '+' ORDER BY s) AS ls FROM nodes WHERE level = 'subpart' GROUP BY 1, 2, 3),
        ps AS (SELECT resource_id, q, string_agg(label || ':' || coalesce(ls, ''), ';' ORDER BY p) AS outline FROM nodes LEFT JOIN subs USING (resource_id, q, p) WHERE level = 'part' GROUP BY 1, 2)
        SELECT resource_id, q, number, marks, coalesce(outline, '') AS outline FROM nodes LEFT JOIN ps USING (resource_id, q) WHERE level = 'question'""",
    ),
    "option_runs": (option_runs, f"{TALK} SELECT resource_id, q, number, text, options, marks, pages FROM nodes"),
    "element_refs": (
        element_refs,
        f"""{PAPER} SELECT resource_id, sum(CASE WHEN images = '' THEN 0 ELSE len(string_split(images, ',')) END) AS images, sum(CASE WHEN drawings = '' THEN 0 ELSE len(string_split(drawings, ',')) END) AS drawings,
        sum(CASE WHEN tables = '' THEN 0 ELSE len(string_split(tables, ',')) END) AS tables FROM nodes GROUP BY 1""",
    ),
    "page_numbers": (page_numbers, f"{PAPER} SELECT resource_id, q, p, s, pages FROM nodes"),
    "doc_statistics": (
        doc_statistics,
        f"{ONLY_LINES} SELECT resource_id, count(DISTINCT page) AS n_pages, count(*) AS n_text, sum(CASE WHEN ord % 12 = 2 THEN 1 ELSE 0 END) AS n_images, sum(CASE WHEN ord % 12 = 4 THEN 1 ELSE 0 END) AS n_paths, count(DISTINCT x) AS n_fonts FROM lines GROUP BY 1",
    ),
    "doc_type": (
        doc_type,
        """SELECT doc_id, n_text, CASE WHEN n_text = 0 THEN 'scanned' WHEN n_text > 500 AND n_images < 20 THEN 'native' ELSE 'hybrid' END AS kind,
        CASE WHEN n_text = 0 THEN 0.9 WHEN n_text > 500 AND n_images < 20 THEN 0.99 ELSE 0.7 END::DOUBLE AS confidence
        FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars // 5 END AS n_text, doc_id % 30 AS n_images FROM documents)""",
    ),
    "report_papers": (report_papers, f"WITH {REPORT_LINES} SELECT * FROM papers"),
    "question_comments": (question_comments, f"WITH {REPORT_LINES} SELECT * FROM comments"),
    "paper_first_wins": (
        paper_first_wins,
        f"WITH {REPORT_LINES} SELECT resource_id, '0001/12' AS paper, arg_min(n_lines, paper_no) AS n_lines FROM papers WHERE paper_no % 3 = 2 GROUP BY resource_id",
    ),
    "syllabus_topics": (syllabus_topics, f"WITH {SYLLABUS} SELECT * FROM top"),
    "ao_blocks": (ao_blocks, f"WITH {SYLLABUS} SELECT * FROM blocks"),
    "ao_weights": (ao_weights, f"WITH {SYLLABUS} SELECT b.resource_id, b.block, b.code, w.weight FROM blocks b LEFT JOIN weights w USING (resource_id, code)"),
    "quality_options": (
        quality_options,
        f"""{TALK} SELECT resource_id, count(*) AS n_questions, sum(CASE WHEN options <> '' THEN 1 ELSE 0 END) AS n_with_options,
        sum(CASE WHEN state4 = 4 THEN 1 ELSE 0 END) AS n_four, sum(CASE WHEN labels = 'A,B,C,D' THEN 0 ELSE 1 END) AS n_bad_labels
        FROM (SELECT n.*, coalesce(o.k, 0) AS state4, coalesce(o.labels, '') AS labels FROM nodes n LEFT JOIN (
          SELECT resource_id, q, count(*) AS k, string_agg(option_label, ',' ORDER BY event_no) AS labels FROM located WHERE state = 'option' GROUP BY 1, 2) o USING (resource_id, q)) WHERE level = 'question' GROUP BY 1""",
    ),
    "quality_sequence": (
        quality_sequence,
        f"""{UPTO_ROLES}, n AS (SELECT resource_id, ord, question_number, first_value(question_number) OVER w AS f, row_number() OVER w AS k FROM classified WHERE question_number IS NOT NULL WINDOW w AS (PARTITION BY resource_id ORDER BY ord))
        SELECT resource_id, count(*) AS n, any_value(f) AS first, bool_and(question_number = f + k - 1) AS sequential FROM n GROUP BY 1""",
    ),
    "document_topics": (document_topics, _topic_sql()),
}

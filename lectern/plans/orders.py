"""Queries over orders and line items shaped as boxes, drawing operators, mark schemes and knowledge records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as rules
from lectern.operators import geometry, knowledge, lines, schemes, topics
from lectern.plans.documents import sql_trim
from lectern.sources import adapters as a
from lectern.sources.adapters import table

GAP = 60.0


def _items(spark: SparkSession, d: str) -> DataFrame:
    return a.order_items(table(spark, d, "lineitem"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return a.order_boxes(_items(spark, d))


ITEMS = """
items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS ord FROM lineitem)"""
BOXES = ITEMS + """,
boxes AS (SELECT l_orderkey AS resource_id, 1 AS page, ord, l_quantity * 10 AS x, l_extendedprice / 100 AS y, l_discount * 100 AS width, l_tax * 100 AS height FROM items)"""
LATTICE = ITEMS + """,
boxes AS (SELECT l_orderkey AS resource_id, 1 AS page, ord,
  CASE WHEN ord % 2 = 0 THEN 10.0 ELSE 10.0 + (l_linenumber % 4) * 30.0 END::DOUBLE AS x, CASE WHEN ord % 2 = 0 THEN 10.0 + (l_linenumber % 3) * 25.0 ELSE 10.0 END::DOUBLE AS y,
  CASE WHEN ord % 2 = 0 THEN 90.0::DOUBLE ELSE l_discount * 10 END AS width, CASE WHEN ord % 2 = 0 THEN l_tax * 10 ELSE 50.0::DOUBLE END AS height FROM items)"""
NEAR = "a.resource_id = b.resource_id AND a.x <= b.x + b.width + GAP AND b.x <= a.x + a.width + GAP AND a.y <= b.y + b.height + GAP AND b.y <= a.y + a.height + GAP"


def _clusters_sql(source: str, gap: float) -> str:
    """Cluster numbers of ``src``, by a walk to every box reachable."""
    near = NEAR.replace("GAP", str(gap))
    return f"""
src AS ({source}),
reach(resource_id, start, ord) AS (SELECT resource_id, ord, ord FROM src UNION SELECT r.resource_id, r.start, b.ord FROM reach r JOIN src a ON a.resource_id = r.resource_id AND a.ord = r.ord JOIN src b ON {near}),
low AS (SELECT resource_id, start AS ord, min(ord) AS root FROM reach GROUP BY 1, 2),
clustered AS (SELECT s.*, CAST(dense_rank() OVER (PARTITION BY s.resource_id ORDER BY root) - 1 AS INT) AS cluster FROM src s JOIN low USING (resource_id, ord))"""


def union_bbox(spark: SparkSession, d: str) -> DataFrame:
    return lines.union_box(_boxes(spark, d), "resource_id")


def thin_box_classify(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    w, h = F.col("width"), F.col("height")
    return b.select("resource_id", "ord", geometry.is_thin(w, h).alias("thin"), geometry.thin_kind(w, h).alias("kind"))


def near_pairs(spark: SparkSession, d: str) -> DataFrame:
    return geometry.near_pairs(_boxes(spark, d), GAP).drop("page")


def box_clusters(spark: SparkSession, d: str) -> DataFrame:
    return geometry.cluster_boxes(_boxes(spark, d), GAP).select("resource_id", "ord", "cluster")


def drawing_elements(spark: SparkSession, d: str) -> DataFrame:
    return geometry.drawings(_boxes(spark, d)).select("resource_id", "element_id", "x", "y", "width", "height", "n_boxes")


def unique_positions(spark: SparkSession, d: str) -> DataFrame:
    g = _items(spark, d).groupBy(F.col("l_orderkey").alias("resource_id")).agg(F.collect_set(F.col("l_quantity").cast("double")).alias("v"))
    return g.select("resource_id", F.array_join(F.transform(lines.unique_positions(F.col("v")), lambda x: x.cast("int").cast("string")), ",").alias("positions"))


def table_lattice(spark: SparkSession, d: str) -> DataFrame:
    t = geometry.table_lattices(a.lattice_boxes(_items(spark, d)))
    whole = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), ",").alias(c)
    return t.select("resource_id", "element_id", "n_rows", "n_columns", whole("row_bounds"), whole("col_bounds"))


def _tables(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    bounds = lambda n, step: F.array(*[F.lit(float(i * step)) for i in range(n)])
    return o.select(F.col("o_orderkey").alias("resource_id"), F.lit(1).alias("page"), F.lit(0).alias("ord"), bounds(5, 200).alias("row_bounds"), bounds(4, 120).alias("col_bounds"))


def _cell_runs(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select(
        F.col("l_orderkey").alias("resource_id"), F.lit(1).alias("page"), "ord", F.concat(F.lit(" "), "l_returnflag", "l_linestatus").alias("text"), (F.col("l_quantity") * 10).alias("x"), (F.col("l_partkey") % 1000).cast("double").alias("y"), F.lit(10.0).alias("width"), F.lit(8.0).alias("height")
    )


def cell_binning(spark: SparkSession, d: str) -> DataFrame:
    r = _cell_runs(spark, d)
    rb, cb = F.array(*[F.lit(float(i * 200)) for i in range(5)]), F.array(*[F.lit(float(i * 120)) for i in range(4)])
    return r.select("resource_id", "ord", lines.bin_index(F.col("y") + 4, rb).alias("row"), lines.bin_index(F.col("x") + 5, cb).alias("col"))


def cell_text(spark: SparkSession, d: str) -> DataFrame:
    return lines.cell_text(_cell_runs(spark, d), _tables(spark, d)).select("resource_id", "row", "col", "text")


def _tracked(spark: SparkSession, d: str) -> DataFrame:
    return geometry.track_ctm(a.order_operations(_items(spark, d)))


def ctm_track(spark: SparkSession, d: str) -> DataFrame:
    return _tracked(spark, d).select("resource_id", "op_idx", "fn", *[f"ctm.{c}" for c in "abcdef"])


def path_boxes(spark: SparkSession, d: str) -> DataFrame:
    return geometry.path_boxes(_tracked(spark, d), _viewport()).drop("page")


def image_boxes(spark: SparkSession, d: str) -> DataFrame:
    return geometry.image_boxes(_tracked(spark, d), _viewport()).drop("page")


def _viewport():
    return geometry.matrix(1.0, 0.0, 0.0, -1.0, 0.0, 842.0)


def mcq_answers(spark: SparkSession, d: str) -> DataFrame:
    i = _items(spark, d)
    n = F.col("l_linenumber").cast("string")
    text = F.when(F.col("ord") % 6 == 5, F.concat(n, F.lit(" question  Discounted 1"))).when(F.col("ord") % 6 == 4, F.concat(F.lit("Question "), n)).otherwise(F.concat(n, F.lit(" "), F.substring(F.lit("ABCDE"), (F.col("l_partkey") % 5 + 1).cast("int"), F.lit(1)), F.lit(" 1")))
    return schemes.mcq_answers(i.select(F.col("l_orderkey").alias("resource_id"), "ord", text.alias("text")))


def scheme_tables(spark: SparkSession, d: str) -> DataFrame:
    t = a.scheme_tables(_items(spark, d))
    return t.select("resource_id", "ord", schemes.is_scheme_table(F.col("cells")).alias("is_scheme"))


def theory_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    return schemes.forward_fill(schemes.scheme_rows(a.scheme_tables(_items(spark, d))))


def theory_grouped(spark: SparkSession, d: str) -> DataFrame:
    return schemes.theory_scheme(a.scheme_tables(_items(spark, d)))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select((F.col("o_orderkey") % 97).alias("resource_id"), F.col("o_orderkey").alias("question"), F.col("o_orderpriority").alias("text"), F.col("o_custkey"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    p = schemes.group_points(
        _items(spark, d).select((F.col("l_orderkey") % 97).alias("resource_id"), F.col("l_orderkey").cast("string").alias("question_ref"), F.col("ord").cast("long").alias("ord"), F.col("l_returnflag").alias("answer"), F.col("l_linenumber").cast("string").alias("mark"))
    )
    return p.select("resource_id", knowledge.leading_number(F.col("question_ref")).cast("long").alias("question"), "n_points", "points")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).where("l_linenumber <= 3").select((F.col("l_orderkey") % 97).alias("resource_id"), F.col("l_orderkey").alias("question"), F.col("l_linestatus").alias("answer"), F.col("l_quantity").cast("int").alias("answer_marks"), "ord")


def _comments(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select((F.col("event_id") * 3 % 97).alias("resource_id"), (F.col("event_id") * 3).alias("question"), F.col("event_type").alias("comment"), F.col("event_id").alias("ord"))


def knowledge_document(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d)
    parts = table(spark, d, "part").select(F.col("p_partkey"), "p_name")
    named = q.join(parts, (F.col("question") % 2000) == F.col("p_partkey"), "left").select("resource_id", "question", "p_name")
    found = topics.assign_topics(named.select("resource_id", "question", F.coalesce("p_name", F.lit("")).alias("text")), PART_TOPICS)
    t = found.select("resource_id", "question", "topic", F.array_join("matched", ",").alias("matched"), F.lit(0).alias("ord"))
    k = knowledge.knowledge_records(q.drop("o_custkey"), t, _answers(spark, d), _points(spark, d), _comments(spark, d))
    return k.select("resource_id", "question", "text", "topic", "matched", "answer", "answer_marks", "n_points", "points", "comment")


# Keywords that occur in part names, for queries on small texts.
PART_TOPICS = {"size": ["small", "large", "big"], "colour": ["red", "blue", "green"], "shape": ["ring", "widget", "bolt", "nut"], "empty": []}


def enrich_left(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return knowledge.enrich(docs.select("doc_id", "lang"), [labels], ["doc_id"])


def enrich_last_wins(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    i = _items(spark, d).select(F.col("l_orderkey").alias("k"), "l_partkey", "l_returnflag", "ord")
    return knowledge.enrich(o, [knowledge.last_wins(i, ["k"], "ord")], ["k"]).drop("ord")


def points_grouped(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d)


def quality_marks_sum(spark: SparkSession, d: str) -> DataFrame:
    parts = _items(spark, d).select(F.col("l_orderkey").alias("key"), F.when(F.col("l_linenumber") < 6, F.col("l_linenumber")).alias("marks"))
    declared = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 20).alias("total"))
    return knowledge.marks_reconciled(parts, declared)


def quality_coverage(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.coverage(knowledge_document(spark, d), "topic", "answer", "points", "comment")


def keyword_scores(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.lit(1).alias("resource_id"), F.col("p_partkey").alias("question"), F.col("p_name").alias("text"))
    return topics.keyword_scores(p, PART_TOPICS).select("question", "topic_no", "topic", F.array_join("matched", ",").alias("matched"), "score")


def topic_assign(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.lit(1).alias("resource_id"), F.col("p_partkey").alias("question"), F.col("p_name").alias("text"))
    return topics.best_by_score(topics.keyword_scores(p, PART_TOPICS)).select("question", "topic_no", "topic", F.array_join("matched", ",").alias("matched"))


def topic_unclassified(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.lit(1).alias("resource_id"), F.col("p_partkey").alias("question"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return topics.assign_topics(p, PART_TOPICS).where("topic is null").select("question", F.size("matched").alias("n_matched"))


PHRASES = ["waves and speed", "a star; the MOON's orbit", "e.m.f. of a cell", "magnets", "x-rays, electrons", "the wave speed", "nothing", "half-life of isotopes", "mass and weight", "Sound waves echo"]


def physics_topics(spark: SparkSession, d: str) -> DataFrame:
    words = F.get(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % 10).cast("int"))
    q = table(spark, d, "documents").select(F.lit(1).alias("resource_id"), F.col("doc_id").alias("question"), F.concat_ws(" ", "text", words).alias("text"))
    return topics.assign_topics(q).select("question", "topic_no", "topic", F.array_join("matched", ",").alias("matched"))


def _scores_sql(text: str, source: str, table_: dict) -> str:
    rows = []
    for i, (t, ks) in enumerate(table_.items(), 1):
        tests = ", ".join(f"CASE WHEN regexp_matches(lower({text}), '\\b{k.replace('.', chr(92) + '.')}{'' if ' ' in k else 's?'}\\b') THEN '{k}' END" for k in ks) or "NULL"
        rows.append(f"SELECT question, {i} AS topic_no, '{t}' AS topic, list_filter([{tests}], lambda x: x IS NOT NULL) AS m FROM {source}")
    return " UNION ALL ".join(rows)


def _assign_sql(text: str, source: str, table_: dict) -> str:
    return f"""sc AS ({_scores_sql(text, source, table_)}),
best AS (SELECT *, max(len(m)) OVER (PARTITION BY question) AS b FROM sc),
lead AS (SELECT question, any_value(topic_no) AS topic_no, any_value(topic) AS topic, array_to_string(any_value(m), ',') AS matched FROM best WHERE len(m) = b AND b > 0 GROUP BY 1 HAVING count(*) = 1)"""


SCHEME = ITEMS + rf""",
st AS (SELECT l_orderkey AS resource_id, (ord - 1) // 4 AS t, ord, CASE WHEN ord % 3 = 1 THEN l_linenumber || '(a)' ELSE '' END AS question,
         CASE WHEN l_linenumber = 5 THEN '' ELSE l_returnflag || ' ' || l_linestatus END AS answer, CASE WHEN l_linenumber = 5 THEN '' ELSE 'B' || l_linenumber END AS mark FROM items),
sr AS (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY ord) AS n FROM st WHERE t <> 2),
content AS (SELECT * FROM sr WHERE answer <> '' OR mark <> ''),
filled AS (SELECT resource_id, n AS ord, last_value(nullif(question, '') IGNORE NULLS) OVER (PARTITION BY resource_id ORDER BY n) AS question_ref, answer, mark FROM content),
ff AS (SELECT * FROM filled WHERE question_ref IS NOT NULL)"""

OPS = ITEMS + """,
ops AS (SELECT l_orderkey AS resource_id, ord AS k, CASE ord % 5 WHEN 1 THEN 'save' WHEN 2 THEN 'transform' WHEN 3 THEN 'constructPath' WHEN 4 THEN 'paintImageXObject' ELSE 'restore' END AS fn,
               l_quantity::DOUBLE AS q, l_linenumber::DOUBLE AS n FROM items),
walk AS (
  SELECT resource_id, k, fn, q, {'a': 1.0::DOUBLE, 'b': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 'd': 1.0::DOUBLE, 'e': 0.0::DOUBLE, 'f': 0.0::DOUBLE} AS now, [{'a': 1.0::DOUBLE, 'b': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 'd': 1.0::DOUBLE, 'e': 0.0::DOUBLE, 'f': 0.0::DOUBLE}] AS stack, n FROM ops WHERE k = 1
  UNION ALL
  SELECT o.resource_id, o.k, o.fn, o.q,
    CASE w.fn WHEN 'transform' THEN {'a': 2 * w.now.a, 'b': 2 * w.now.b, 'c': 2 * w.now.c, 'd': 2 * w.now.d, 'e': w.q * w.now.a + w.n * w.now.c + w.now.e, 'f': w.q * w.now.b + w.n * w.now.d + w.now.f}
              WHEN 'restore' THEN CASE WHEN len(w.stack) > 1 THEN w.stack[len(w.stack)] ELSE w.stack[1] END ELSE w.now END,
    CASE w.fn WHEN 'save' THEN list_append(w.stack, w.now) WHEN 'restore' THEN CASE WHEN len(w.stack) > 1 THEN w.stack[1:len(w.stack) - 1] ELSE w.stack END ELSE w.stack END, o.n
  FROM walk w JOIN ops o ON o.resource_id = w.resource_id AND o.k = w.k + 1)"""

CORNERS = """x0 * now.a + y0 * now.c + now.e AS xa, x0 * now.a + y1 * now.c + now.e AS xb, x1 * now.a + y0 * now.c + now.e AS xc, x1 * now.a + y1 * now.c + now.e AS xd,
842 - (x0 * now.b + y0 * now.d + now.f) AS ya, 842 - (x0 * now.b + y1 * now.d + now.f) AS yb, 842 - (x1 * now.b + y0 * now.d + now.f) AS yc, 842 - (x1 * now.b + y1 * now.d + now.f) AS yd"""
AABB = "least(xa, xb, xc, xd) AS x, least(ya, yb, yc, yd) AS y, greatest(xa, xb, xc, xd) - least(xa, xb, xc, xd) AS width, greatest(ya, yb, yc, yd) - least(ya, yb, yc, yd) AS height"

POINTS = ITEMS + """,
pts AS (SELECT l_orderkey % 97 AS resource_id, l_orderkey AS question, count(*) AS n_points, string_agg(l_returnflag || '|' || l_linenumber, '; ' ORDER BY ord) AS points FROM items GROUP BY 1, 2)"""
KNOWLEDGE = f"""WITH {POINTS},
named AS (SELECT o_orderkey AS question, coalesce(p_name, '') AS p_name FROM orders LEFT JOIN part ON o_orderkey % 2000 = p_partkey),
{_assign_sql('p_name', 'named', PART_TOPICS)},
ans AS (SELECT l_orderkey AS question, arg_max(l_linestatus, ord) AS answer, CAST(arg_max(l_quantity, ord) AS INT) AS answer_marks FROM items WHERE l_linenumber <= 3 GROUP BY 1),
com AS (SELECT event_id * 3 AS question, arg_max(event_type, event_id) AS comment FROM events GROUP BY 1),
know AS (SELECT o_orderkey % 97 AS resource_id, o_orderkey AS question, o_orderpriority AS text, l.topic, coalesce(l.matched, '') AS matched, a.answer, a.answer_marks, p.n_points, p.points, c.comment
  FROM orders o LEFT JOIN lead l ON l.question = o_orderkey LEFT JOIN ans a ON a.question = o_orderkey LEFT JOIN pts p ON p.question = o_orderkey LEFT JOIN com c ON c.question = o_orderkey)"""

UNIQUE = """
vals AS (SELECT resource_id, v, row_number() OVER (PARTITION BY resource_id ORDER BY v) AS k FROM (SELECT DISTINCT resource_id, v FROM src)),
uw AS (SELECT resource_id, k, v AS last, true AS kept, v FROM vals WHERE k = 1
  UNION ALL SELECT x.resource_id, x.k, CASE WHEN x.v > w.last + 2 THEN x.v ELSE w.last END, x.v > w.last + 2, x.v FROM uw w JOIN vals x ON x.resource_id = w.resource_id AND x.k = w.k + 1)"""


def _lattice_sql() -> str:
    kind = "CASE WHEN width <= 1 AND height > 1 THEN 'v' WHEN height <= 1 AND width > 1 THEN 'h' END"
    walk = lambda name, col, k: f"""
{name}0 AS (SELECT resource_id, cluster, v, row_number() OVER (PARTITION BY resource_id, cluster ORDER BY v) AS k FROM (SELECT DISTINCT resource_id, cluster, {col} AS v FROM clustered WHERE {kind} = '{k}')),
{name}w AS (SELECT resource_id, cluster, k, v AS last, true AS kept, v FROM {name}0 WHERE k = 1
  UNION ALL SELECT x.resource_id, x.cluster, x.k, CASE WHEN x.v > w.last + 2 THEN x.v ELSE w.last END, x.v > w.last + 2, x.v FROM {name}w w JOIN {name}0 x ON x.resource_id = w.resource_id AND x.cluster = w.cluster AND x.k = w.k + 1),
{name} AS (SELECT resource_id, cluster, count(*) - 1 AS n, string_agg(CAST(CAST(v AS INT) AS VARCHAR), ',' ORDER BY v) AS bounds FROM {name}w WHERE kept GROUP BY 1, 2)"""  # noqa: E731
    return f"""WITH RECURSIVE {LATTICE}, {_clusters_sql(f"SELECT * FROM boxes WHERE {kind} IS NOT NULL", 3.0)}, {walk('hh', 'y', 'h')}, {walk('vv', 'x', 'v')},
ext AS (SELECT resource_id, cluster, max(x + width) - min(x) AS w, max(y + height) - min(y) AS h FROM clustered GROUP BY 1, 2)
SELECT resource_id, '1-table-' || cluster AS element_id, CAST(hh.n AS INT) AS n_rows, CAST(vv.n AS INT) AS n_columns, hh.bounds AS row_bounds, vv.bounds AS col_bounds
FROM ext JOIN hh USING (resource_id, cluster) JOIN vv USING (resource_id, cluster) WHERE w >= 20 AND h >= 20 AND hh.n >= 1 AND vv.n >= 1"""


PHYSICS_TEXT = "concat_ws(' ', text, [" + ", ".join("'" + x.replace("'", "''") + "'" for x in PHRASES) + "][CAST(doc_id % 10 + 1 AS INT)])"

QUERIES = {
    "union_bbox": (union_bbox, f"WITH {BOXES} SELECT resource_id, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM boxes GROUP BY 1"),
    "thin_box_classify": (thin_box_classify, f"WITH {BOXES} SELECT resource_id, ord, width <= 1 OR height <= 1 AS thin, CASE WHEN width <= 1 AND height > 1 THEN 'vertical' WHEN height <= 1 AND width > 1 THEN 'horizontal' END AS kind FROM boxes"),
    "near_pairs": (near_pairs, f"WITH {BOXES} SELECT a.resource_id, a.ord AS ord_a, b.ord AS ord_b FROM boxes a JOIN boxes b ON {NEAR.replace('GAP', str(GAP))} AND a.ord < b.ord"),
    "box_clusters": (box_clusters, f"WITH RECURSIVE {BOXES}, {_clusters_sql('SELECT * FROM boxes', GAP)} SELECT resource_id, CAST(ord AS INT) AS ord, cluster FROM clustered"),
    "drawing_elements": (
        drawing_elements,
        f"""WITH RECURSIVE {BOXES}, {_clusters_sql('SELECT * FROM boxes WHERE width > 1 AND height > 1', 6.0)}
        SELECT resource_id, '1-drawing-' || cluster AS element_id, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height, count(*) AS n_boxes FROM clustered GROUP BY resource_id, cluster""",
    ),
    "unique_positions": (
        unique_positions,
        f"WITH RECURSIVE src AS (SELECT l_orderkey AS resource_id, l_quantity::DOUBLE AS v FROM lineitem), {UNIQUE} SELECT resource_id, string_agg(CAST(CAST(v AS INT) AS VARCHAR), ',' ORDER BY v) AS positions FROM uw WHERE kept GROUP BY 1",
    ),
    "table_lattice": (table_lattice, _lattice_sql()),
    "cell_binning": (
        cell_binning,
        f"""WITH {ITEMS} SELECT l_orderkey AS resource_id, ord, CASE WHEN l_partkey % 1000 + 4 < 800 THEN CAST((l_partkey % 1000 + 4) // 200 AS INT) END AS row,
        CASE WHEN l_quantity * 10 + 5 < 360 THEN CAST(floor((l_quantity * 10 + 5) / 120) AS INT) END AS col FROM items""",
    ),
    "cell_text": (
        cell_text,
        f"""WITH {ITEMS} SELECT l_orderkey AS resource_id, CAST((l_partkey % 1000 + 4) // 200 AS INT) AS row, CAST(floor((l_quantity * 10 + 5) / 120) AS INT) AS col,
        string_agg(l_returnflag || l_linestatus, ' ' ORDER BY l_partkey % 1000, l_quantity, ord) AS text FROM items WHERE l_partkey % 1000 + 4 < 800 AND l_quantity * 10 + 5 < 360 GROUP BY 1, 2, 3""",
    ),
    "ctm_track": (ctm_track, f"WITH RECURSIVE {OPS} SELECT resource_id, CAST(k AS INT) AS op_idx, fn, now.a AS a, now.b AS b, now.c AS c, now.d AS d, now.e AS e, now.f AS f FROM walk"),
    "path_boxes": (path_boxes, f"WITH RECURSIVE {OPS} SELECT resource_id, ord, {AABB} FROM (SELECT resource_id, CAST(k AS INT) AS ord, {CORNERS} FROM (SELECT *, 0 AS x0, 0 AS y0, q AS x1, 10 AS y1 FROM walk WHERE fn = 'constructPath'))"),
    "image_boxes": (image_boxes, f"WITH RECURSIVE {OPS} SELECT resource_id, ord, {AABB} FROM (SELECT resource_id, CAST(k AS INT) AS ord, {CORNERS} FROM (SELECT *, 0 AS x0, 0 AS y0, 1 AS x1, 1 AS y1 FROM walk WHERE fn = 'paintImageXObject'))"),
    "mcq_answers": (
        mcq_answers,
        rf"""WITH {ITEMS}, t AS (SELECT l_orderkey AS resource_id, ord, CASE WHEN ord % 6 = 5 THEN l_linenumber || ' question  Discounted 1' WHEN ord % 6 = 4 THEN 'Question ' || l_linenumber ELSE l_linenumber || ' ' || substr('ABCDE', CAST(l_partkey % 5 + 1 AS INT), 1) || ' 1' END AS t FROM items)
        SELECT resource_id, ord, CAST(regexp_extract(t, '^([0-9]{{1,2}})', 1) AS INT) AS question_number, CASE WHEN regexp_matches(t, '{rules.MCQ_ROW}') THEN regexp_extract(t, '{rules.MCQ_ROW}', 2) ELSE 'Discounted' END AS answer,
        CASE WHEN regexp_matches(t, '{rules.MCQ_ROW}') THEN CAST(regexp_extract(t, '{rules.MCQ_ROW}', 3) AS INT) ELSE CAST(regexp_extract(t, '{rules.MCQ_DISCOUNTED}', 2) AS INT) END AS marks
        FROM t WHERE regexp_matches(t, '{rules.MCQ_ROW}') OR regexp_matches(t, '{rules.MCQ_DISCOUNTED}')""",
    ),
    "scheme_tables": (scheme_tables, f"WITH {ITEMS} SELECT DISTINCT l_orderkey AS resource_id, CAST((ord - 1) // 4 AS INT) AS ord, (ord - 1) // 4 <> 2 AS is_scheme FROM items"),
    "theory_forward_fill": (theory_forward_fill, f"WITH {SCHEME} SELECT resource_id, CAST(ord AS INT) AS ord, question_ref, answer, mark FROM ff"),
    "theory_grouped": (theory_grouped, f"WITH {SCHEME} SELECT resource_id, question_ref, CAST(min(ord) AS INT) AS first_ord, count(*) AS n_points, string_agg(concat_ws('|', answer, mark), '; ' ORDER BY ord) AS points FROM ff GROUP BY 1, 2"),
    "knowledge_document": (knowledge_document, f"{KNOWLEDGE} SELECT * FROM know"),
    "enrich_left": (enrich_left, "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"),
    "enrich_last_wins": (enrich_last_wins, f"WITH {ITEMS}, last AS (SELECT l_orderkey AS k, arg_max(l_partkey, ord) AS l_partkey, arg_max(l_returnflag, ord) AS l_returnflag FROM items GROUP BY 1) SELECT o_orderkey AS k, o_orderstatus, l_partkey, l_returnflag FROM orders LEFT JOIN last ON k = o_orderkey"),
    "points_grouped": (points_grouped, f"WITH {POINTS} SELECT * FROM pts"),
    "quality_marks_sum": (
        quality_marks_sum,
        """SELECT o_orderkey AS key, o_custkey % 20 AS total, coalesce(s, 0) AS sum_marks, o_custkey % 20 = coalesce(s, 0) AS agrees
        FROM orders LEFT JOIN (SELECT l_orderkey, sum(CASE WHEN l_linenumber < 6 THEN l_linenumber ELSE 0 END)::BIGINT AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    ),
    "quality_coverage": (quality_coverage, f"{KNOWLEDGE} SELECT count(*) AS n, avg((topic IS NOT NULL)::INT) AS topic, avg((answer IS NOT NULL)::INT) AS answer, avg((points IS NOT NULL)::INT) AS points, avg((comment IS NOT NULL)::INT) AS comment FROM know"),
    "keyword_scores": (keyword_scores, f"WITH p AS (SELECT p_partkey AS question, p_name FROM part), sc AS ({_scores_sql('p_name', 'p', PART_TOPICS)}) SELECT question, topic_no, topic, coalesce(array_to_string(m, ','), '') AS matched, CAST(len(m) AS INT) AS score FROM sc"),
    "topic_assign": (topic_assign, f"WITH p AS (SELECT p_partkey AS question, p_name FROM part), {_assign_sql('p_name', 'p', PART_TOPICS)} SELECT question, topic_no, topic, matched FROM lead"),
    "topic_unclassified": (topic_unclassified, f"WITH p AS (SELECT p_partkey AS question, p_name || ' ' || p_type AS t FROM part), {_assign_sql('t', 'p', PART_TOPICS)} SELECT question, 0 AS n_matched FROM p WHERE question NOT IN (SELECT question FROM lead)"),
    "physics_topics": (
        physics_topics,
        f"WITH p AS (SELECT doc_id AS question, {PHYSICS_TEXT} AS t FROM documents), {_assign_sql('t', 'p', topics.PHYSICS_KEYWORDS)} SELECT p.question, topic_no, topic, coalesce(matched, '') AS matched FROM p LEFT JOIN lead USING (question)",
    ),
}

from pyspark.sql import functions as F

from lectern.functions import catalog as c
from lectern.operators import geometry, knowledge, resources, schemes, sections, topics
from lectern.sources import web


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


def test_mcq_key(spark):
    rows = [(1, i, t) for i, t in enumerate(["1 A 1", "Question Answer Marks", "14 Question Discounted 1", "2 E 1", "3  D  2"])]
    got = schemes.mcq_answers(spark.createDataFrame(rows, "resource_id long, ord int, text string")).orderBy("ord").collect()
    assert [(r["question_number"], r["answer"], r["marks"]) for r in got] == [(1, "A", 1), (14, "Discounted", 1), (3, "D", 2)]


def test_theory_scheme(spark):
    head = ["Question", "Answer", "Marks"]
    tables = [
        (1, 1, 0, 10.0, [head, ["2(a)(i)", "x", "B1"], ["", "y", "C1"], ["3", " ", ""], ["", "z", "A1"]]),
        (1, 1, 1, 90.0, [["Question", "Marks"], ["9", "no"]]),
        (1, 2, 0, 10.0, [head, ["", "w", "B1"], ["2(b)", "v", "B1"]]),
    ]
    got = schemes.theory_scheme(spark.createDataFrame(tables, "resource_id long, page int, ord int, y double, cells array<array<string>>")).orderBy("first_ord").collect()
    assert [(r["question_ref"], r["n_points"], r["points"]) for r in got] == [("2(a)(i)", 4, "x|B1; y|C1; z|A1; w|B1"), ("2(b)", 1, "v|B1")]


REPORT = ["Paper 0625/11", "General comments", "Well done.", "Comments on specific questions", "Intro.", "Question 3", "Many erred.", "Again.", "Question 7", "Good.", "Paper 0625/12", "General comments", "Poor."]


def test_report(spark):
    rows = [(1, i, t, 60.0, 100.0) for i, t in enumerate(REPORT)] + [(1, 99, "footer", 60.0, 820.0)]
    ls = spark.createDataFrame(rows, "resource_id long, ord int, text string, x double, y double")
    papers = sections.report_papers(ls).orderBy("paper_no").collect()
    assert [(p["paper"], p["general_comments"]) for p in papers] == [("0625/11", "Well done."), ("0625/12", "Poor.")]
    got = sections.question_comments(ls).orderBy("block").collect()
    assert [(q["paper"], q["question_number"], q["comment"]) for q in got] == [("0625/11", 3, "Many erred. Again."), ("0625/11", 7, "Good.")]
    assert sections.report_papers(ls.where("ord > 0 and ord < 10")).count() == 0


def test_syllabus(spark):
    rows = ["Content overview", "1 Motion", "2 Thermal", "Assessment overview", "3 Not", "Assessment objectives", "AO1 Knowledge", "• a", "prose", "• b", "AO2 Handling", "• c", "Weighting for assessment objectives", "Assessment objective Weighting in IGCSE %", "AO1 Knowledge 50", "AO2 Handling 30", "Assessment objectives as a percentage of each component"]
    ls = spark.createDataFrame([(1, i, t, 55.0) for i, t in enumerate(rows)] + [(1, 2, "9 footer", 17.0)], "resource_id long, ord int, text string, x double")
    assert [(r["number"], r["name"]) for r in sections.syllabus_topics(ls).orderBy("ord").collect()] == [(1, "Motion"), (2, "Thermal")]
    got = sections.assessment_objectives(ls).orderBy("block").collect()
    assert [(r["code"], r["description"], r["weight"]) for r in got] == [("AO1", "a|b", 50), ("AO2", "c", 30)]
    assert sections.syllabus_topics(ls.where("ord > 0")).count() == 0


def test_topics(spark):
    rows = [(1, 1, "acceleration, a resultant force and mass"), (1, 2, "nothing"), (1, 3, "a magnet and a star"), (1, 4, "WAVES"), (1, 5, "e.m.f. of"), (1, 6, "éwave")]
    got = topics.assign_topics(spark.createDataFrame(rows, "resource_id long, question long, text string")).orderBy("question").collect()
    assert [r["topic_no"] for r in got] == [1, None, None, 3, None, 3]
    assert got[0]["matched"] == ["acceleration", "mass", "resultant force"] and got[2]["matched"] == []
    assert sum(map(len, topics.PHYSICS_KEYWORDS.values())) == 131
    none = topics.assign_topics(spark.createDataFrame(rows, "resource_id long, question long, text string"), {})
    assert none.where("topic is not null").count() == 0


def test_knowledge_last_wins_and_nulls(spark):
    q = spark.createDataFrame([(1, 1), (1, 2)], "resource_id long, question long")
    side = lambda name, *rows: spark.createDataFrame(list(rows), f"resource_id long, question long, {name} string, ord int")
    points = side("points", (1, 1, "p", 0)).drop("ord")
    got = knowledge.knowledge_records(q, side("topic", (1, 1, "t", 0)), side("answer", (1, 1, "A", 0), (1, 1, "B", 1)), points, side("comment", (1, 2, "c", 0))).orderBy("question").collect()
    assert [(r["topic"], r["answer"], r["points"], r["comment"]) for r in got] == [("t", "B", "p", None), (None, None, None, "c")]


def test_geometry(spark):
    box = "resource_id long, page int, ord int, x double, y double, width double, height double"
    rows = [(1, 1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 1, 16.0, 0.0, 10.0, 10.0), (1, 1, 2, 33.0, 0.0, 5.0, 5.0), (1, 1, 3, 0.0, 0.0, 0.5, 0.5)]
    b = spark.createDataFrame(rows, box)
    assert sorted((r["ord_a"], r["ord_b"]) for r in geometry.near_pairs(b.where("ord < 3"), 6.0).collect()) == [(0, 1)]
    assert sorted((r["element_id"], r["n_boxes"]) for r in geometry.drawings(b).collect()) == [("1-drawing-0", 2), ("1-drawing-1", 1)]
    kinds = b.select(geometry.thin_kind(F.col("width"), F.col("height")).alias("k")).collect()
    assert [k["k"] for k in kinds] == [None] * 4
    lines = [(1, 1, i, 0.0, y, 100.0, 0.5) for i, y in enumerate((0.0, 25.0, 50.0))] + [(1, 1, 9 + i, x, 0.0, 0.5, 50.0) for i, x in enumerate((0.0, 100.0))]
    t = geometry.table_lattices(spark.createDataFrame(lines, box)).collect()
    assert [(r["n_rows"], r["n_columns"]) for r in t] == [(2, 1)]


def test_ctm(spark):
    ops = [(1, 1, 0, "restore", []), (1, 1, 1, "save", []), (1, 1, 2, "transform", [2.0, 0.0, 0.0, 2.0, 5.0, 6.0]), (1, 1, 3, "constructPath", [0.0, 0.0, 1.0, 1.0]), (1, 1, 4, "restore", []), (1, 1, 5, "paintImageXObject", [])]
    tracked = geometry.track_ctm(spark.createDataFrame(ops, "resource_id long, page int, op_idx int, fn string, args array<double>"))
    p, i = geometry.path_boxes(tracked).first(), geometry.image_boxes(tracked).first()
    assert (p["x"], p["y"], p["width"], p["height"]) == (5.0, 6.0, 2.0, 2.0) and (i["x"], i["width"]) == (0.0, 1.0)


def test_catalogue(spark):
    assert one(spark, "2023 Specimen Paper 1 Mark Scheme", c.title_type) == "MARK_SCHEME"
    assert one(spark, "Paper 123", c.title_paper) is None and one(spark, "paper 42", c.title_variant) == 2
    assert one(spark, "Maybe 1999", c.title_session) == "MJ" and one(spark, "x 2024.", c.title_year) == 2024
    rows = [("QUESTION_PAPER", "MJ", 2024, 4, 1), ("SYLLABUS", None, 2026, None, None), ("SPECIMEN_PAPER", None, 2023, 1, None)]
    df = spark.createDataFrame(rows, "type string, session string, year int, paper int, variant int")
    got = [r["resource_id"] for r in resources.identify(df, "Cambridge", "Cambridge IGCSE", "0625").collect()]
    assert got == ["CAM-0625-MJ-2024-41-QP", "CAM-0625-SYL-2026", "CAM-0625-SPC-2023-1-QP"]
    assert one(spark, "https://x/a/b%20c+d.pdf?q=1", c.url_basename) == "b c+d.pdf" and one(spark, "https://x", c.url_basename) is None


def test_web(spark):
    html = '<h1>Physics <i>x</i> (0625)</h1><a class="k" href="/a.PDF?x=1">Paper &amp; key (PDF, 2MB)</a><a href="b/c.html">no</a><a href="/e.pdf"> (PDF) </a><script id="__NEXT_DATA__" type="a">{"k": 3}</script>'
    pages = spark.createDataFrame([(1, "https://h.x/s/t?q", html), (2, "https://h.x", None)], "page_id long, url string, html string")
    ls = web.links(pages)
    assert [(r["href"], r["text"]) for r in ls.orderBy("ord").collect()][:1] == [("/a.PDF?x=1", "Paper & key (PDF, 2MB)")]
    assert [(r["title"], r["target"]) for r in web.pdf_links(ls).collect()] == [("Paper & key", "https://h.x/a.PDF?x=1")]
    head = web.subject_heading(pages).orderBy("page_id").collect()
    assert [(h["subject"], h["code"], h["error"]) for h in head] == [("Physics x", "0625", None), (None, None, "heading")]
    assert [r["error"] for r in web.embedded_json(pages).orderBy("page_id").collect()] == [None, "missing"]
    assert one(spark, "x", lambda v: c.resolve_url(F.lit("c.html"), F.lit("https://h.x/s/t?q"))) == "https://h.x/s/c.html"


def test_past_papers(spark):
    rows = [(2024, 6, "0972/11", False, "u1", "u2"), (None, None, "0972/01", True, "https://x/5-2023-s.pdf", None), (None, 3, "0972", True, "", "v"), (2020, 1, "0972", False, "w", "u1")]
    got = resources.classify_past_papers(spark.createDataFrame(rows, resources.PAPER)).collect()
    assert [(r["year"], r["session"], r["paper"], r["variant"]) for r in got] == [(2024, "MJ", 1, 1), (2023, None, 1, None), (None, "FM", 0, None), (2020, None, None, None)]
    fan = resources.fan_out(resources.paper_title(resources.classify_past_papers(spark.createDataFrame(rows, resources.PAPER))), "code")
    assert sorted(r["title"] for r in fan.where("target in ('u1', 'u2')").collect()) == ["2020 Paper Mark Scheme", "June 2024 Paper 11 Mark Scheme", "June 2024 Paper 11 Question Paper"]
    assert web.dedupe_by_url(fan, "target", "code", "type").count() == 5

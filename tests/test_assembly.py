"""One paper's knowledge from four documents, and small operators beside it."""

from pyspark.sql import functions as F

from lectern.functions import catalog
from lectern.operators import assembly, knowledge, questions, sections, topics

LINE = "resource_id long, page int, ord int, text string, x double, y double, width double, height double"


def lines_of(spark, docs):
    rows = [(i, 1, n, t, float(x), 100.0 + 10 * n, 1.0, 1.0) for i, items in docs.items() for n, (x, t) in enumerate(items)]
    return spark.createDataFrame(rows, LINE)


def test_papers_are_assembled_by_their_scheme(spark):
    paper = [(50, "1 What floats?"), (50, "2 A long one."), (72, "(a) Why? [2]"), (72, "(b) How? [1]"), (50, "3 Unknown")]
    lines = lines_of(spark, {10: paper, 11: paper, 12: paper})
    keys = lines_of(spark, {20: [(50, "1 B 1"), (50, "2 C 1"), (50, "1 D 1")]})
    tables = spark.createDataFrame(
        [(30, 1, 0, 0.0, [["Question", "Answer", "Marks"], ["1", "wood", "B1"], ["2(a)", "because", "B1"], ["", "or so", "B1"], ["2(b)", "thus", "M1"]])],
        "resource_id long, page int, ord int, y double, cells array<array<string>>",
    )
    syllabus = lines_of(spark, {40: [(50, "Content overview"), (55, "4 floating"), (55, "7 deep"), (50, "Assessment overview")]})
    report = lines_of(spark, {50: [(60, "Paper 0001/11"), (60, "Comments on specific questions"), (60, "Question 1"), (60, "Well done."), (60, "Paper 0001/12"), (60, "Comments on specific questions"), (60, "Question 2"), (60, "Hard.")]})
    papers = spark.createDataFrame(
        [(10, "mcq", 20, 40, 50, "0001/11"), (11, "theory", 30, 40, 50, "0001/12"), (12, "theory", 31, 41, None, None)],
        "resource_id long, scheme string, scheme_id long, syllabus_id long, report_id long, report_code string",
    )
    got = assembly.assemble_knowledge(papers, lines, None, keys, tables, syllabus, report, {"floating": ["float"], "deep": ["why", "how"]})
    rows = {(r["resource_id"], r["number"]): (r["topic_number"], r["answer"], r["points"], r["comment"]) for r in got.collect()}
    assert rows == {
        (10, 1): (4, "D", None, "Well done."), (10, 2): (7, "C", None, None), (10, 3): (None, None, None, None),
        (11, 1): (4, None, "wood|B1", None), (11, 2): (7, None, "because|B1; or so|B1; thus|M1", "Hard."), (11, 3): (None, None, None, None),
        (12, 1): (None,) * 4, (12, 2): (None,) * 4, (12, 3): (None,) * 4,
    }


def test_topics_of_a_syllabus(spark):
    q = spark.createDataFrame([(1, 5, 1, "a wave"), (1, 5, 2, "a wave and a magnet"), (1, 5, 3, "none"), (2, 6, 1, "a wave"), (3, 5, 1, None)], "resource_id long, syllabus_id long, question int, text string")
    t = spark.createDataFrame([(5, 0, 3, "Waves"), (5, 1, 9, "Electricity and magnetism"), (5, 2, 8, "Unheard of")], "syllabus_id long, ord int, number int, name string")
    got = {(r["resource_id"], r["question"]): (r["topic_number"], r["topic_name"], r["matched"]) for r in topics.assign_syllabus_topics(q, t).collect()}
    nothing = (None, None, [])
    assert got == {(1, 1): (3, "Waves", ["wave"]), (1, 2): nothing, (1, 3): nothing, (2, 1): nothing, (3, 1): nothing}


def test_question_marks_fall_back_to_sub_parts(spark):
    doc = lines_of(spark, {1: [
        (50, "1 Whole"), (72, "(a) x [2]"), (72, "(b) y"), (72, "(i) one [1]"), (72, "(ii) two [3]"), (500, "[Total: 6]"),
        (50, "2 Wrong"), (72, "(a) x [2]"), (500, "[Total: 5]"), (50, "3 No parts [4]"), (50, "4 No total"), (72, "(a) x [2]"),
    ]})
    got = knowledge.question_marks_reconciled(questions.build_questions(doc)).orderBy("q").collect()
    assert [(r["q"], r["total"], r["sum_marks"], r["agrees"]) for r in got] == [(1, 6, 6, True), (2, 5, 2, False)]


def test_option_text_may_hold_any_mark(spark):
    doc = lines_of(spark, {1: [(50, "1 Which?"), (70, "A |v|"), (70, "B a=b"), (70, "C c,d"), (70, "D e"), (50, "2 None")]})
    nodes = questions.build_questions(doc)
    assert topics.question_text(nodes).orderBy("question").first()["text"] == "Which? |v| a=b c,d e"
    r = knowledge.option_summary(nodes).first()
    assert (r["n_questions"], r["n_with_options"], r["n_four"], r["n_bad_labels"]) == (2, 1, 1, 1)


def test_overview_without_sections_is_empty(spark):
    r = sections.syllabus_overview(lines_of(spark, {1: [(50, "Nothing here")]})).first()
    assert r["topics"] == [] and r["objectives"] == []


def test_urls_resolve(spark):
    base = "https://h.org/a/b/c?q=1#f"
    want = {
        "x": "https://h.org/a/b/x", "./x": "https://h.org/a/b/x", "../x": "https://h.org/a/x", "../../../x": "https://h.org/x", "..": "https://h.org/a/", ".": "https://h.org/a/b/", "?z": "https://h.org/a/b/c?z",
        "#z": "https://h.org/a/b/c?q=1#z", "": "https://h.org/a/b/c?q=1", "/": "https://h.org/", "/y/../z?a=../b": "https://h.org/z?a=../b", "//o.org/x": "https://o.org/x", "http://o.org/a/./b/../c": "http://o.org/a/c", "tel:1": "tel:1",
        "a/..b/.c": "https://h.org/a/b/a/..b/.c",
    }
    df = spark.createDataFrame([(k,) for k in want], "href string")
    assert {r["href"]: r["t"] for r in df.select("href", catalog.resolve_url(F.col("href"), F.lit(base)).alias("t")).collect()} == want
    assert spark.range(1).select(catalog.resolve_url(F.lit("x"), F.lit("https://h.org")).alias("t")).first()["t"] == "https://h.org/x"

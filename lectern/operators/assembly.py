"""One paper's knowledge from its four documents: questions, mark scheme, syllabus, examiner report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.knowledge import enrich, last_wins
from lectern.operators.questions import build_questions
from lectern.operators.schemes import forward_fill, group_points, mcq_answers, scheme_rows
from lectern.operators.sections import pick_papers, question_comments, syllabus_topics
from lectern.operators.topics import assign_syllabus_topics, question_text


def assemble_knowledge(
    papers: DataFrame,
    question_lines: DataFrame,
    elements: DataFrame | None,
    key_lines: DataFrame,
    scheme_tables: DataFrame,
    syllabus_lines: DataFrame,
    report_lines: DataFrame,
    keywords: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Questions of every paper with topic, answer, marking points and commentary:

    ``resource_id, question, number, text, marks, topic_number, topic_name, answer, answer_marks, points, comment``.

    ``papers(resource_id, scheme, scheme_id, syllabus_id, report_id, report_code)`` says which documents
    belong together; ``scheme`` is mcq or theory and picks the extractor, so a paper has answers or points,
    never both. The others hold lines and tables by their own ``resource_id``. Of a report's parts the first
    with the paper's code counts. What is missing stays null. Each document is extracted once, however
    many papers name it, and meets the questions by key.
    """
    nodes = build_questions(question_lines.join(papers.select("resource_id").distinct(), "resource_id", "left_semi"), elements)
    own = nodes.where("level = 'question'").select("resource_id", F.col("q").alias("question"), "number", "text", "marks")
    named = question_text(nodes).join(papers.select("resource_id", "syllabus_id"), "resource_id")
    topics = assign_syllabus_topics(named, syllabus_topics(syllabus_lines).withColumnRenamed("resource_id", "syllabus_id"), keywords).drop("matched")
    of = lambda kind: papers.where(F.col("scheme") == kind).select("resource_id", F.col("scheme_id").alias("_id"))
    keyed = lambda df, kind: df.withColumnRenamed("resource_id", "_id").join(of(kind), "_id").drop("_id")
    answers = last_wins(mcq_answers(key_lines), ["resource_id", "question_number"], "ord").select("resource_id", F.col("question_number").alias("number"), "answer", F.col("marks").alias("answer_marks"))
    filled = forward_fill(scheme_rows(scheme_tables)).withColumn("question_ref", F.regexp_extract("question_ref", "^([0-9]+)", 1)).where("question_ref <> ''")
    points = group_points(filled).select("resource_id", F.col("question_ref").cast("int").alias("number"), "points")
    reports = papers.where("report_code is not null").select(F.col("resource_id").alias("_paper"), F.col("report_id").alias("resource_id"), F.col("report_code").alias("paper"))
    comments = pick_papers(question_comments(report_lines), reports).select(F.col("_paper").alias("resource_id"), F.col("question_number").alias("number"), "comment", "block")
    comments = last_wins(comments, ["resource_id", "number"], "block").drop("block")
    told = enrich(own, [topics], ["resource_id", "question"])
    told = enrich(told, [keyed(answers, "mcq"), keyed(points, "theory"), comments], ["resource_id", "number"])
    return told.select("resource_id", "question", "number", "text", "marks", "topic_number", "topic_name", "answer", "answer_marks", "points", "comment")

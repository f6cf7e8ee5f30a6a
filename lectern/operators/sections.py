"""Sections of ordered lines: examiner reports and syllabus overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as rules
from lectern.functions.text import extract, extract_int, ordered_join, trim

# Exact headings, and where page furniture and body text lie.
GENERAL_COMMENTS = "General comments"
SPECIFIC_COMMENTS = "Comments on specific questions"
TOPICS = ("Content overview", "Assessment overview")
OBJECTIVES = ("Assessment objectives", "Weighting for assessment objectives")
WEIGHTS = ("Assessment objective Weighting in IGCSE %", "Assessment objectives as a percentage of each component")
REPORT_BODY = (40.0, 800.0)
BODY_X = (50.0, 65.0)


def report_body(lines: DataFrame) -> DataFrame:
    """Without page headers and footers."""
    return lines.where((F.col("y") >= REPORT_BODY[0]) & (F.col("y") <= REPORT_BODY[1]))


def chunk(lines: DataFrame, pattern: str, key: str, *by: str) -> DataFrame:
    """Lines after a marker up to the next one; adds ``key`` (what the marker names) and ``<key>_no``.

    ``by`` names the columns that part the lines (a document, a chunk of it); ``ord`` orders them. Lines
    before the first marker, and the markers, are dropped.
    """
    upto = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    t = trim(F.col("text"))
    mark = F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1))
    told = lines.withColumn("_m", mark).withColumn(f"{key}_no", F.count("_m").over(upto)).withColumn(key, F.last("_m", ignorenulls=True).over(upto))
    return told.where(F.col("_m").isNull() & (F.col(f"{key}_no") > 0)).drop("_m")


def section(lines: DataFrame, start: str, ends: tuple[str, ...], *by: str) -> DataFrame:
    """Lines after the first ``start`` heading up to the first end heading after it, else to the end."""
    t, whole = trim(F.col("text")), Window.partitionBy(*by)
    told = lines.withColumn("_start", F.min(F.when(t == start, F.col("ord"))).over(whole))
    told = told.withColumn("_end", F.min(F.when(t.isin(*ends) & (F.col("ord") > F.col("_start")), F.col("ord"))).over(whole) if ends else F.lit(None).cast("long"))
    return told.where((F.col("ord") > F.col("_start")) & (F.col("_end").isNull() | (F.col("ord") < F.col("_end")))).drop("_start", "_end")


def report_papers(lines: DataFrame) -> DataFrame:
    """``resource_id, paper_no, paper, general_comments, n_lines`` of each paper in each report."""
    chunks = chunk(report_body(lines), rules.PAPER_MARKER, "paper", "resource_id")
    general = section(chunks, GENERAL_COMMENTS, (SPECIFIC_COMMENTS,), "resource_id", "paper_no")
    text = general.groupBy("resource_id", "paper_no").agg(trim(ordered_join(F.collect_list(F.struct("ord", trim(F.col("text")).alias("text"))))).alias("general_comments"))
    papers = chunks.groupBy("resource_id", "paper_no", "paper").agg(F.count("*").alias("n_lines"))
    return papers.join(text, ["resource_id", "paper_no"], "left").select("resource_id", "paper_no", "paper", F.coalesce("general_comments", F.lit("")).alias("general_comments"), "n_lines")


def question_comments(lines: DataFrame) -> DataFrame:
    """``resource_id, paper_no, paper, block, question_number, comment``; a repeated heading is another block."""
    chunks = chunk(report_body(lines), rules.PAPER_MARKER, "paper", "resource_id")
    specific = section(chunks, SPECIFIC_COMMENTS, (), "resource_id", "paper_no")
    upto = Window.partitionBy("resource_id", "paper_no").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    heading = extract_int(trim(F.col("text")), rules.QUESTION_HEADING)
    told = specific.withColumn("_q", heading).withColumn("block", F.count("_q").over(upto)).where("block > 0")
    items = F.collect_list(F.when(F.col("_q").isNull(), F.struct("ord", trim(F.col("text")).alias("text"))))
    return told.groupBy("resource_id", "paper_no", "paper", "block").agg(F.max("_q").alias("question_number"), trim(ordered_join(items)).alias("comment"))


def pick_paper(papers: DataFrame, code: str) -> DataFrame:
    """The first paper of each report with the code."""
    rest = [c for c in papers.columns if c not in ("resource_id", "paper_no")]
    first = papers.where(F.col("paper") == code).groupBy("resource_id").agg(F.min_by(F.struct(*rest), "paper_no").alias("p"))
    return first.select("resource_id", *[f"p.{c}" for c in rest])


def pick_papers(comments: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of each report's first part with the code that ``wanted(resource_id, paper, ...)`` names, with what else it names."""
    first = comments.groupBy("resource_id", "paper").agg(F.min("paper_no").alias("paper_no"))
    return comments.join(first, ["resource_id", "paper", "paper_no"]).join(wanted, ["resource_id", "paper"])


def in_body(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("x").between(*BODY_X))


def syllabus_topics(lines: DataFrame) -> DataFrame:
    """``resource_id, ord, number, name`` of the content overview's numbered rows."""
    t = trim(F.col("text"))
    rows = in_body(section(lines, TOPICS[0], (TOPICS[1],), "resource_id")).where(t.rlike(rules.TOPIC_ROW))
    return rows.select("resource_id", "ord", extract_int(t, rules.TOPIC_ROW, 1).alias("number"), trim(extract(t, rules.TOPIC_ROW, 2)).alias("name"))


def objective_blocks(lines: DataFrame) -> DataFrame:
    """``resource_id, block, code, name, description`` with the bullets under each objective's heading, bar-joined."""
    t = trim(F.col("text"))
    body = in_body(section(lines, OBJECTIVES[0], (OBJECTIVES[1],), "resource_id"))
    upto = Window.partitionBy("resource_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    told = body.withColumn("_code", extract(t, rules.AO_HEADING, 1)).withColumn("block", F.count("_code").over(upto)).where("block > 0")
    bullets = F.collect_list(F.when(t.rlike(rules.AO_BULLET), F.struct("ord", trim(extract(t, rules.AO_BULLET)).alias("text"))))
    return told.groupBy("resource_id", "block").agg(F.max("_code").alias("code"), F.max(F.when(F.col("_code").isNotNull(), trim(extract(t, rules.AO_HEADING, 2)))).alias("name"), ordered_join(bullets, "|").alias("description"))


def objective_weights(lines: DataFrame) -> DataFrame:
    """``resource_id, code, weight``; of rows that repeat a code the last counts."""
    t = trim(F.col("text"))
    rows = section(lines, WEIGHTS[0], (WEIGHTS[1],), "resource_id").where(t.rlike(rules.AO_WEIGHT))
    return rows.groupBy("resource_id", extract(t, rules.AO_WEIGHT, 1).alias("code")).agg(F.max_by(extract_int(t, rules.AO_WEIGHT, 2), "ord").alias("weight"))


def assessment_objectives(lines: DataFrame) -> DataFrame:
    return objective_blocks(lines).join(objective_weights(lines), ["resource_id", "code"], "left")


def syllabus_overview(lines: DataFrame) -> DataFrame:
    """One record a syllabus: ``resource_id, topics, objectives``, arrays of structs in order, empty where there are none."""
    topics = syllabus_topics(lines).groupBy("resource_id").agg(F.array_sort(F.collect_list(F.struct("ord", "number", "name"))).alias("topics"))
    objectives = assessment_objectives(lines).groupBy("resource_id").agg(F.array_sort(F.collect_list(F.struct("block", "code", "name", "description", "weight"))).alias("objectives"))
    all_ = lines.select("resource_id").distinct().join(topics, "resource_id", "left").join(objectives, "resource_id", "left")
    empty = lambda df, c: F.coalesce(c, F.array().cast(df.schema[c].dataType)).alias(c)
    return all_.select("resource_id", empty(topics, "topics"), empty(objectives, "objectives"))

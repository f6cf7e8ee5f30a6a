"""Enrichment of questions into knowledge records, and checks of the records' quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_wins(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key: the one that comes last. Reduced before any join, so joins don't fan out."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[f"_r.{c}" for c in rest])


def first_wins(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[f"_r.{c}" for c in rest])


def enrich(base: DataFrame, sides: list[DataFrame], keys: list[str]) -> DataFrame:
    """Left joins of sides that are unique in ``keys``; what is missing stays null, never an empty list.

    No side is forced to be broadcast: each grows with the data, and the optimiser knows the sizes.
    """
    for side in sides:
        base = base.join(side, keys, "left")
    return base


def knowledge_records(questions: DataFrame, topics: DataFrame, answers: DataFrame, points: DataFrame, comments: DataFrame) -> DataFrame:
    """Questions with topic, answer, marking points and commentary, all keyed by ``resource_id, question``.

    Of repeated answers, topics and comments the last counts; points come grouped by question.
    """
    keys = ["resource_id", "question"]
    return enrich(questions, [last_wins(topics, keys, "ord"), last_wins(answers, keys, "ord"), points, last_wins(comments, keys, "ord")], keys)


def leading_number(ref: Column) -> Column:
    return F.when(ref.rlike("^[0-9]+"), F.regexp_extract(ref, "^([0-9]+)", 1)).try_cast("int")


def marks_reconciled(parts: DataFrame, declared: DataFrame) -> DataFrame:
    """Sum of part marks against the declared total: ``key, total, sum_marks, agrees``; no parts give 0."""
    sums = parts.groupBy("key").agg(F.sum(F.coalesce("marks", F.lit(0))).alias("sum_marks"))
    joined = declared.join(sums, "key", "left").withColumn("sum_marks", F.coalesce("sum_marks", F.lit(0)))
    return joined.select("key", "total", "sum_marks", (F.col("total") == F.col("sum_marks")).alias("agrees"))


def question_marks_reconciled(nodes: DataFrame) -> DataFrame:
    """``resource_id, q, total, sum_marks, agrees`` of questions that declare a total and have parts.

    A part counts with its marks, or with the sum of its sub-parts' where it has none itself; missing
    marks are 0. Questions without a total or without parts aren't judged.
    """
    own = nodes.where("level = 'question'").select("resource_id", "q", F.col("marks").alias("total")).where("total is not null")
    part = nodes.where("level <> 'question'").groupBy("resource_id", "q", "p").agg(
        F.max(F.when(F.col("level") == "part", F.col("marks"))).alias("part_marks"), F.sum(F.when(F.col("level") == "subpart", F.coalesce("marks", F.lit(0))).otherwise(0)).alias("sub_marks")
    )
    sums = part.groupBy("resource_id", "q").agg(F.sum(F.coalesce("part_marks", "sub_marks")).alias("sum_marks"))
    return own.join(sums, ["resource_id", "q"]).select("resource_id", "q", "total", "sum_marks", (F.col("total") == F.col("sum_marks")).alias("agrees"))


def sequence_breaks(rows: DataFrame, key: str, number: str, *order: str) -> DataFrame:
    """Whether the numbers of each key are first, first + 1, ...: ``key, n, first, sequential``."""
    w = Window.partitionBy(key).orderBy(*order)
    told = rows.withColumn("_first", F.first(number).over(w)).withColumn("_ok", F.col(number) == F.col("_first") + F.row_number().over(w) - 1)
    return told.groupBy(key).agg(F.count("*").alias("n"), F.first("_first").alias("first"), F.bool_and("_ok").alias("sequential"))


def coverage(records: DataFrame, *columns: str) -> DataFrame:
    """The share of records in which each column isn't null."""
    return records.agg(F.count("*").alias("n"), *[F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in columns])


def option_summary(nodes: DataFrame) -> DataFrame:
    """``n_questions, n_with_options, n_four, n_bad_labels`` per document, from question nodes.

    Labels are bad unless they are A, B, C, D in order.
    """
    n, labels = F.size("options"), F.array_join(F.transform("options", lambda o: o["label"]), ",")
    return nodes.where("level = 'question'").groupBy("resource_id").agg(
        F.count("*").alias("n_questions"),
        F.sum((n > 0).cast("int")).alias("n_with_options"),
        F.sum((n == 4).cast("int")).alias("n_four"),
        F.sum((labels != "A,B,C,D").cast("int")).alias("n_bad_labels"),
    )


def top_rows(rows: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    """The first ``k`` rows of each key by ``order``, with their ``rank``; the planner keeps k rows a key before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def ref_totals(nodes: DataFrame) -> DataFrame:
    """References to images, drawings and tables over all levels, per document."""
    count = lambda c: F.sum(F.size(c)).alias(c)
    return nodes.groupBy("resource_id").agg(count("images"), count("drawings"), count("tables"))

"""Mark schemes: multiple-choice keys and theory mark points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as rules
from lectern.functions.text import extract, extract_int, trim

# Fixed value: the header cells of a theory scheme's table, lower-cased.
HEADER = ("question", "answer", "marks")


def mcq_answers(lines: DataFrame) -> DataFrame:
    """Lines of a key -> ``resource_id, ord, question_number, answer, marks``; other lines are dropped."""
    t = trim(F.col("text"))
    plain, gone = t.rlike(rules.MCQ_ROW), t.rlike(rules.MCQ_DISCOUNTED)
    return lines.where(plain | gone).select(
        "resource_id",
        "ord",
        F.when(plain, extract_int(t, rules.MCQ_ROW, 1)).otherwise(extract_int(t, rules.MCQ_DISCOUNTED, 1)).alias("question_number"),
        F.when(plain, extract(t, rules.MCQ_ROW, 2)).otherwise(F.lit("Discounted")).alias("answer"),
        F.when(plain, extract_int(t, rules.MCQ_ROW, 3)).otherwise(extract_int(t, rules.MCQ_DISCOUNTED, 2)).alias("marks"),
    )


def is_scheme_table(cells: Column) -> Column:
    """Whether an array of rows of cells starts with the scheme's header."""
    header = F.get(cells, 0)
    return F.coalesce((F.size(header) == len(HEADER)) & (F.transform(header, lambda c: F.lower(trim(c))) == F.array(*map(F.lit, HEADER))), F.lit(False))


def scheme_rows(tables: DataFrame) -> DataFrame:
    """Tables ``resource_id, page, ord, y, cells`` -> body rows ``resource_id, ord, question, answer, mark``.

    Only tables with the header count; rows go by page, y of the table, and place in it.
    """
    order = Window.partitionBy("resource_id").orderBy("page", "y", "table_ord", "row")
    rows = tables.where(is_scheme_table(F.col("cells"))).select("resource_id", "page", "y", F.col("ord").alias("table_ord"), F.posexplode("cells").alias("row", "cell")).where("row > 0")
    return rows.select(
        "resource_id", F.row_number().over(order).alias("ord"), *[F.coalesce(trim(F.get("cell", i)), F.lit("")).alias(n) for i, n in enumerate(("question", "answer", "mark"))]
    )


def forward_fill(rows: DataFrame) -> DataFrame:
    """Carries a blank question cell's key from above: ``resource_id, ord, question_ref, answer, mark``.

    Rows without answer and mark are dropped first, so they don't move the key; rows before the first
    key are dropped too.
    """
    content = rows.where((trim(F.col("answer")) != "") | (trim(F.col("mark")) != ""))
    upto = Window.partitionBy("resource_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    key = F.last(F.nullif(trim(F.col("question")), F.lit("")), ignorenulls=True).over(upto)
    return content.withColumn("question_ref", key).where("question_ref is not null").select("resource_id", "ord", "question_ref", "answer", "mark")


def group_points(points: DataFrame, sep: str = "; ") -> DataFrame:
    """Points by question, in order of first appearance: ``resource_id, question_ref, first_ord, n_points, points``."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("ord", "answer", "mark"))), lambda p: F.concat_ws("|", p["answer"], p["mark"]))
    return points.groupBy("resource_id", "question_ref").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n_points"), F.array_join(items, sep).alias("points"))


def theory_scheme(tables: DataFrame) -> DataFrame:
    return group_points(forward_fill(scheme_rows(tables)))

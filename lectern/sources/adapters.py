"""Supplied tables shaped as positioned document content, with integer arithmetic that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(documents: DataFrame) -> DataFrame:
    """Sentences as lines of an exam paper: ``resource_id, page, ord, text, x, y, width, height``.

    Of each six sentences the first opens a question, then come part (a), a body line with marks, part
    (b), sub-part (i) with marks, and a line with the total. Blank sentences are left out.
    """
    parts = documents.select(F.col("doc_id").alias("resource_id"), F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. ", -1)).alias("p", "raw"))
    p, raw, k = F.col("p"), F.col("raw"), F.col("p") % 6
    number = (F.floor(p / 6) % 99 + 1).cast("string")
    text = (
        F.when(k == 0, F.concat(number, F.lit(" "), raw))
        .when(k == 1, F.concat(F.lit("(a) "), raw))
        .when(k == 2, F.concat(raw, F.lit(" [3]")))
        .when(k == 3, F.concat(F.lit("(b) "), raw))
        .when(k == 4, F.concat(F.lit("(i) "), raw, F.lit(" [2]")))
        .otherwise(F.concat(raw, F.lit(" [Total: 5]")))
    )
    x = F.when(k == 0, 50.0).when(k.isin(1, 3), 72.0).when(k == 2, 95.0).when(k == 4, 96.0).otherwise(504.0)
    return parts.where(F.trim(raw) != "").select(
        "resource_id",
        (F.floor(p / 12) + 1).cast("int").alias("page"),
        p.alias("ord"),
        text.alias("text"),
        x.alias("x"),
        (62.0 + 20.0 * (p % 12)).alias("y"),
        (F.length(raw) * 6.0).alias("width"),
        F.lit(11.0).alias("height"),
    )


def document_runs(lines: DataFrame) -> DataFrame:
    """Each line as two text runs, the second 2 px lower and listed first, as a page's own order may have it."""
    half = F.floor(F.length("text") / 2).cast("int")
    first = F.struct((F.col("ord") * 2 + 1).alias("ord"), F.substring("text", F.lit(1), half).alias("text"), F.col("x").alias("x"), F.col("y").alias("y"))
    second = F.struct((F.col("ord") * 2).alias("ord"), F.substring("text", half + 1, F.length("text")).alias("text"), (F.col("x") + half * 6.0).alias("x"), (F.col("y") + 2.0).alias("y"))
    runs = lines.select("resource_id", "page", "height", F.explode(F.array(first, second)).alias("r"))
    return runs.select("resource_id", "page", "r.ord", "r.text", "r.x", "r.y", (F.length("r.text") * 6.0).alias("width"), "height")


def order_items(lineitem: DataFrame) -> DataFrame:
    """lineitem with ``ord``, an ordinal that is unique in its order."""
    return lineitem.withColumn("ord", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)))


def order_boxes(items: DataFrame) -> DataFrame:
    """Line items as boxes of a page: ``resource_id, page, ord, x, y, width, height``."""
    return items.select(
        F.col("l_orderkey").alias("resource_id"),
        F.lit(1).alias("page"),
        "ord",
        (F.col("l_quantity") * 10).alias("x"),
        (F.col("l_extendedprice") / 100).alias("y"),
        (F.col("l_discount") * 100).alias("width"),
        (F.col("l_tax") * 100).alias("height"),
    )


def lattice_boxes(items: DataFrame) -> DataFrame:
    """Line items as rulings of a small grid, thin one way or the other, by the parity of the ordinal."""
    n, across = F.col("ord"), F.col("ord") % 2 == 0
    return items.select(
        F.col("l_orderkey").alias("resource_id"),
        F.lit(1).alias("page"),
        "ord",
        F.when(across, 10.0).otherwise(10.0 + (F.col("l_linenumber") % 4) * 30.0).alias("x"),
        F.when(across, 10.0 + (F.col("l_linenumber") % 3) * 25.0).otherwise(10.0).alias("y"),
        F.when(across, 90.0).otherwise(F.col("l_discount") * 10).alias("width"),
        F.when(across, F.col("l_tax") * 10).otherwise(50.0).alias("height"),
        n.alias("n"),
    ).drop("n")


def order_operations(items: DataFrame) -> DataFrame:
    """Line items as a page's drawing operators: ``resource_id, page, op_idx, fn, args``."""
    k = F.col("ord") % 5
    fn = F.when(k == 1, "save").when(k == 2, "transform").when(k == 3, "constructPath").when(k == 4, "paintImageXObject").otherwise("restore")
    q = F.col("l_quantity").cast("double")
    args = (
        F.when(k == 2, F.array(F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(2.0), q, F.col("l_linenumber").cast("double")))
        .when(k == 3, F.array(F.lit(0.0), F.lit(0.0), q, F.lit(10.0)))
        .otherwise(F.array().cast("array<double>"))
    )
    return items.select(F.col("l_orderkey").alias("resource_id"), F.lit(1).alias("page"), F.col("ord").alias("op_idx"), fn.alias("fn"), args.alias("args"))


def document_elements(lines: DataFrame) -> DataFrame:
    """Images, drawings and tables just below some of the lines: ``resource_id, page, ord, y, kind, element_id``."""
    k = F.col("ord") % 12
    kind = F.when(k == 2, "image").when(k == 4, "drawing").when(k == 8, "table")
    rows = lines.withColumn("kind", kind).where("kind is not null")
    return rows.select("resource_id", "page", "ord", (F.col("y") + 1).alias("y"), "kind", F.concat_ws("-", "page", "kind", "ord").alias("element_id"))


def conversation_lines(conversations: DataFrame) -> DataFrame:
    """Each conversation as one question: the first turn its stem, others options by turn, a system turn a note."""
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    label = F.substring(F.lit("ABCD"), ((F.col("turn") - 1) % 4 + 1).cast("int"), F.lit(1))
    text = F.when(F.col("turn") == 0, F.concat(F.lit("1 "), flat)).when(F.col("role") == "system", F.concat(F.lit("note "), flat)).otherwise(F.concat(label, F.lit(" "), flat))
    return conversations.select(
        F.col("conv_id").alias("resource_id"),
        F.lit(1).alias("page"),
        F.col("turn").cast("int").alias("ord"),
        text.alias("text"),
        F.when(F.col("turn") == 0, 50.0).otherwise(80.0).alias("x"),
        (100.0 + 20.0 * F.col("turn")).alias("y"),
        F.lit(100.0).alias("width"),
        F.lit(11.0).alias("height"),
    )


def scheme_tables(items: DataFrame) -> DataFrame:
    """Each order as a mark-scheme page: two tables, the second continuing the first, one of three headed otherwise."""
    n = F.col("ord")
    question = F.when(n % 3 == 1, F.concat(F.col("l_linenumber").cast("string"), F.lit("(a)"))).otherwise(F.lit(""))
    blank = F.col("l_linenumber") == 5
    answer = F.when(blank, F.lit(" ")).otherwise(F.concat("l_returnflag", F.lit(" "), "l_linestatus"))
    mark = F.when(blank, F.lit("")).otherwise(F.concat(F.lit("B"), F.col("l_linenumber").cast("string")))
    rows = items.withColumn("t", F.floor((n - 1) / 4).cast("int")).groupBy(F.col("l_orderkey").alias("resource_id"), "t").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", F.array(question, answer, mark).alias("c")))), lambda r: r["c"]).alias("body")
    )
    header = F.when(F.col("t") == 2, F.array(F.lit("Question"), F.lit("Marks"))).otherwise(F.array(F.lit("Question "), F.lit("ANSWER"), F.lit("Marks")))
    return rows.select("resource_id", F.lit(1).alias("page"), F.col("t").alias("ord"), (F.col("t") * 100.0).alias("y"), F.concat(F.array(header), "body").alias("cells"))


def report_lines(conversations: DataFrame) -> DataFrame:
    """Sixteen conversations each as one report in which each is a paper: general comments, then a comment for each turn."""
    kind = F.col("turn")
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    code = F.concat(F.lit("Paper "), F.lpad((F.col("conv_id") % 10000).cast("string"), 4, "0"), F.lit("/11"))
    head = (
        F.when(kind == 0, F.array(code, F.lit("General comments")))
        .when(kind == 1, F.array(F.lit("Comments on specific questions"), F.lit("Question 1")))
        .otherwise(F.array(F.concat(F.lit("Question "), F.col("turn").cast("string"))))
    )
    rows = conversations.select(F.floor(F.col("conv_id") / 16).alias("resource_id"), F.col("conv_id"), "turn", F.posexplode(F.concat(head, F.array(flat))).alias("i", "text"))
    return rows.select(
        "resource_id",
        (F.col("conv_id") * 100 + F.col("turn") * 10 + F.col("i")).alias("ord"),
        "text",
        F.lit(60.0).alias("x"),
        F.when((F.col("turn") == 3) & (F.col("i") == 1), 820.0).otherwise(100.0 + F.col("turn")).alias("y"),
    )


def syllabus_lines(documents: DataFrame) -> DataFrame:
    """Each document as a syllabus: all its sentences as topics, then as objectives and bullets, then as weights, under the fixed headings."""
    s = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. ", -1)
    line = lambda ord_, x, text: F.struct(ord_.cast("long").alias("ord"), x.cast("double").alias("x"), text.alias("text"))
    fixed = lambda ord_, text: F.array(line(F.lit(ord_), F.lit(50), F.lit(text)))
    number = lambda i: (i % 9).cast("string")
    each = lambda make: F.coalesce(F.transform(s, make), F.array())
    topics = each(lambda t, i: line(i + 1, F.when(i % 3 == 1, 17).otherwise(55), F.concat(number(i), F.lit(" "), t)))
    aims = each(lambda t, i: line(i + 3000001, F.lit(55), F.when(i % 3 == 0, F.concat(F.lit("AO"), number(i), F.lit(" "), t)).when(i % 3 == 1, F.concat(F.lit("• "), t)).otherwise(t)))
    weights = each(lambda t, i: line(i + 5000002, F.lit(55), F.concat(F.lit("AO"), number(i), F.lit(" "), t, F.lit(" "), (i % 60).cast("string"))))
    lines = F.concat(
        fixed(0, "Content overview"), topics, fixed(2000000, "Assessment overview"), fixed(3000000, "Assessment objectives"), aims, fixed(5000000, "Weighting for assessment objectives"),
        fixed(5000001, "Assessment objective Weighting in IGCSE %"), weights, fixed(7000000, "Assessment objectives as a percentage of each component"), fixed(7000001, "AO1 x 99"),
    )
    rows = documents.select(F.col("doc_id").alias("resource_id"), F.explode(lines).alias("l"))
    return rows.select("resource_id", "l.ord", "l.text", "l.x", F.lit(100.0).alias("y"))

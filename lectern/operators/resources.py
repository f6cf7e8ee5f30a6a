"""Past papers as resources: structured records classified, titled and fanned out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.catalog import MONTH_SESSIONS, SESSION_NAMES, YEAR, classify_title, lookup, paper_code, resource_id, subject_id
from lectern.functions.text import extract_int, trim

PAPER = "year int, month int, code string, is_specimen boolean, exam_paper string, mark_scheme string"


def classify_past_papers(papers: DataFrame) -> DataFrame:
    """Adds ``session, paper, variant`` and fills ``year`` from the address where it is null.

    A specimen's whole second code part is its paper; else the first digit is, and a further one the
    variant. A code without '/' gives a specimen the paper 0 and others none.
    """
    part = F.coalesce(F.get(F.split("code", "/", -1), 1), F.lit(""))
    session = F.lit(None).cast("string")
    for month, name in MONTH_SESSIONS.items():
        session = F.when(F.col("month") == month, name).otherwise(session)
    specimen = F.col("is_specimen")
    url = F.coalesce("exam_paper", "mark_scheme", F.lit(""))
    return papers.withColumns(
        {
            "year": F.coalesce("year", extract_int(url, YEAR)),
            "session": session,
            "paper": F.when(specimen, F.when(part == "", 0).otherwise(part.try_cast("int"))).otherwise(F.substring(part, 1, 1).try_cast("int")),
            "variant": F.when(~specimen & (F.length(part) > 1), F.substring(part, 2, 1).try_cast("int")),
        }
    )


def paper_title(classified: DataFrame) -> DataFrame:
    """Adds ``title``: 'Year Specimen Paper P', or 'Month Year Paper PV'."""
    year = F.coalesce(F.col("year").cast("string"), F.lit(""))
    month = F.coalesce(lookup(SESSION_NAMES, F.col("session")), F.lit(""))
    code = F.coalesce(paper_code(F.col("paper"), F.col("variant")), F.lit(""))
    plain = F.concat(month, F.lit(" "), year, F.lit(" Paper "), code)
    specimen = trim(F.concat(year, F.lit(" Specimen Paper "), F.coalesce(F.col("paper").cast("string"), F.lit(""))))
    return classified.withColumn("title", F.when(F.col("is_specimen"), specimen).otherwise(trim(F.regexp_replace(plain, r"\s+", " "))))


def fan_out(titled: DataFrame, *keep: str) -> DataFrame:
    """A row for each file of a paper: question paper and mark scheme; null or empty addresses give none."""
    kind = F.when(F.col("is_specimen"), "SPECIMEN_PAPER").otherwise("QUESTION_PAPER")
    qp = F.struct(kind.alias("type"), F.concat("title", F.lit(" Question Paper")).alias("full_title"), F.col("exam_paper").alias("target"))
    ms = F.struct(F.lit("MARK_SCHEME").alias("type"), F.concat("title", F.lit(" Mark Scheme")).alias("full_title"), F.col("mark_scheme").alias("target"))
    rows = titled.withColumn("_f", F.explode(F.array(qp, ms)))
    return rows.select(*keep, "year", "session", "paper", "variant", "_f.type", F.col("_f.full_title").alias("title"), "_f.target").where("target is not null and target <> ''")


def identify(resources: DataFrame, board: str, qualification: str, code: str) -> DataFrame:
    """Adds ``resource_id`` and ``subject_id``."""
    b, q, c = F.lit(board), F.lit(qualification), F.lit(code)
    rid = resource_id(F.col("type"), b, c, F.col("session"), F.col("year"), F.col("paper"), F.col("variant"))
    return resources.withColumns({"resource_id": rid, "subject_id": subject_id(b, q, c)})


def classify_titles(titles: DataFrame) -> DataFrame:
    """Adds ``type, year, session, paper, variant``, read off ``title``."""
    return titles.withColumn("_c", classify_title(F.col("title"))).select("*", "_c.*").drop("_c")

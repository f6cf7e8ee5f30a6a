"""Lines, margins and tables from positioned text runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.functions.text import ordered_join, round_half_up, trim


def _line_numbers(centre: np.ndarray, height: np.ndarray) -> list[int]:
    """Line of each run of a page, runs in order; one pass."""
    out, line, anchor, last = [], -1, 0.0, 0.0
    for c, h in zip(centre.tolist(), height.tolist()):
        if line < 0 or abs(c - anchor) > 0.5 * max(h, last):
            line, anchor = line + 1, c
        last = h
        out.append(line)
    return out


def reconstruct_lines(runs: DataFrame) -> DataFrame:
    """Text runs -> lines in reading order: ``resource_id, page, line_ord, text, x, y, width, height, n_runs``.

    Blank runs are dropped. By centre, then x, a run joins the current line if its centre is within half
    the larger height (its own, or that of the line's last run) of the line's first centre, which never
    moves. That is a fold over a page's runs: a page is one row of arrays, numbered in one pass, and a batch
    of the function holds many pages.
    """
    c = F.col("y").cast("double") + F.col("height").cast("double") / 2
    kept = runs.where(trim(F.col("text")) != "").select("resource_id", "page", F.struct(c.alias("cy"), "x", "ord", "text", "y", "width", F.col("height").cast("double").alias("height")).alias("r"))
    pages = kept.groupBy("resource_id", "page").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    number = F.pandas_udf(lambda c, h: pd.Series([_line_numbers(np.asarray(x), np.asarray(y)) for x, y in zip(c, h)], dtype=object), T.ArrayType(T.IntegerType()))
    numbered = pages.withColumn("lines", number(F.col("rs.cy"), F.col("rs.height")))
    zipped = numbered.select("resource_id", "page", F.explode(F.arrays_zip(F.col("lines").alias("line"), F.col("rs").alias("r"))).alias("z"))
    flat = zipped.select("resource_id", "page", F.col("z.line").alias("line_ord"), "z.r.*")
    members = F.collect_list(F.struct("x", "cy", "ord", trim(F.col("text")).alias("text")))
    boxed = flat.groupBy("resource_id", "page", "line_ord").agg(ordered_join(members).alias("text"), *_union_box(), F.count("*").alias("n_runs"))
    return boxed.select("resource_id", "page", "line_ord", "text", "x", "y", "width", "height", "n_runs")


def _union_box() -> list[Column]:
    return [
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"),
        (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"),
    ]


def union_box(boxes: DataFrame, *keys: str) -> DataFrame:
    """The box around each group's boxes."""
    return boxes.groupBy(*keys).agg(*_union_box())


def left_margin(lines: DataFrame, least: int = 3) -> DataFrame:
    """``resource_id, left_margin``: the smallest rounded x that ``least`` lines share, else the smallest x.

    Counts are taken per document and rounded x first, so partial sums leave the map side.
    """
    counts = lines.groupBy("resource_id", round_half_up(F.col("x")).cast("double").alias("bucket")).agg(F.count("*").alias("n"), F.min("x").alias("x"))
    return counts.groupBy("resource_id").agg(F.coalesce(F.min(F.when(F.col("n") >= least, F.col("bucket"))), F.min("x")).alias("left_margin"))


def with_left_margin(lines: DataFrame, least: int = 3) -> DataFrame:
    """``lines`` with the ``left_margin`` of their document, in one partitioning by document and without a second scan."""
    bucket = round_half_up(F.col("x")).cast("double")
    told = lines.withColumn("_bucket", bucket).repartition("resource_id").withColumn("_n", F.count("*").over(Window.partitionBy("resource_id", "_bucket")))
    whole = Window.partitionBy("resource_id")
    margin = F.coalesce(F.min(F.when(F.col("_n") >= least, F.col("_bucket"))).over(whole), F.min("x").over(whole))
    return told.withColumn("left_margin", margin).drop("_bucket", "_n")


def unique_positions(values: Column, gap: float = 2.0) -> Column:
    """Of an array of positions, in order, those more than ``gap`` beyond the last one kept."""
    empty = F.array().cast("array<double>")
    return F.aggregate(
        F.array_sort(values),
        empty,
        lambda kept, v: F.when((F.size(kept) == 0) | (v > F.element_at(kept, -1) + gap), F.concat(kept, F.array(v))).otherwise(kept),
    )


def bin_index(value: Column, bounds: Column) -> Column:
    """0-based i with bounds[i] <= value < bounds[i+1]; null outside."""
    below = F.size(F.filter(bounds, lambda b: b <= value))
    return F.when((below >= 1) & (below < F.size(bounds)), below - 1)


def cell_text(runs: DataFrame, tables: DataFrame) -> DataFrame:
    """Runs put into the cells their centres lie in: ``resource_id, page, table_ord, row, col, text``.

    Cells are half open; a run outside every cell is dropped. Texts of a cell are joined by y, then x.
    """
    t = tables.select("resource_id", "page", F.col("ord").alias("table_ord"), "row_bounds", "col_bounds")
    placed = runs.join(t, ["resource_id", "page"]).select(
        "resource_id",
        "page",
        "table_ord",
        bin_index(F.col("y") + F.col("height") / 2, F.col("row_bounds")).alias("row"),
        bin_index(F.col("x") + F.col("width") / 2, F.col("col_bounds")).alias("col"),
        F.struct("y", "x", "ord", trim(F.col("text")).alias("text")).alias("t"),
    )
    inside = placed.where("row is not null and col is not null").where(F.col("t.text") != "")
    return inside.groupBy("resource_id", "page", "table_ord", "row", "col").agg(ordered_join(F.collect_list("t")).alias("text"))


def page_statistics(pages: DataFrame) -> DataFrame:
    """Page rows ``resource_id, page, n_text, n_images, n_paths, fonts`` -> one row per document.

    Distinct fonts are counted over all pages.
    """
    fonts = pages.select("resource_id", F.explode_outer("fonts").alias("font"))
    n_fonts = fonts.groupBy("resource_id").agg(F.countDistinct("font").alias("n_fonts"))
    sums = pages.groupBy("resource_id").agg(
        F.count("*").alias("n_pages"), F.sum("n_text").alias("n_text"), F.sum("n_images").alias("n_images"), F.sum("n_paths").alias("n_paths")
    )
    return sums.join(n_fonts, "resource_id", "left")


# The operators that paint image data, and the one that draws a path.
PAINT_OPERATORS = (
    "paintImageXObject", "paintImageXObjectRepeat", "paintImageMaskXObject", "paintImageMaskXObjectRepeat", "paintImageMaskXObjectGroup", "paintInlineImageXObject",
    "paintInlineImageXObjectGroup", "paintSolidColorImageMask",
)
PATH_OPERATOR = "constructPath"


def document_statistics(pages: DataFrame, runs: DataFrame, operations: DataFrame) -> DataFrame:
    """``resource_id, n_pages, n_text, n_images, n_drawings, n_fonts`` of each document of ``pages(resource_id, page)``.

    Text runs ``(resource_id, font)`` and operations ``(resource_id, fn)`` are summed apart before they
    meet, so nothing fans out; fonts are counted once over all pages.
    """
    n_pages = pages.groupBy("resource_id").agg(F.countDistinct("page").alias("n_pages"))
    texts = runs.groupBy("resource_id").agg(F.count("*").alias("n_text"), F.countDistinct("font").alias("n_fonts"))
    ops = operations.groupBy("resource_id").agg(
        F.count_if(F.col("fn").isin(*PAINT_OPERATORS)).alias("n_images"), F.count_if(F.col("fn") == PATH_OPERATOR).alias("n_drawings")
    )
    joined = n_pages.join(texts, "resource_id", "left").join(ops, "resource_id", "left")
    return joined.select("resource_id", "n_pages", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_text", "n_images", "n_drawings", "n_fonts")])


def analyze_documents(pages: DataFrame, runs: DataFrame, operations: DataFrame) -> DataFrame:
    """The statistics of each document with its ``kind`` and ``confidence``."""
    told = document_statistics(pages, runs, operations).withColumn("_k", layout_kind(F.col("n_text"), F.col("n_images")))
    return told.select("*", "_k.kind", "_k.confidence").drop("_k")


def layout_kind(n_text: Column, n_images: Column) -> Column:
    """``struct(kind, confidence)``: scanned without text, native with much text and few images, else hybrid."""
    native = (n_text > 500) & (n_images < 20)
    kind = F.when(n_text == 0, "scanned").when(native, "native").otherwise("hybrid")
    return F.struct(kind.alias("kind"), F.when(n_text == 0, 0.9).when(native, 0.99).otherwise(0.7).alias("confidence"))

"""Boxes on pages: shapes, transforms, proximity, clusters, drawings, tables and images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.operators.lines import unique_positions

THIN = 1.0
DRAWING_GAP = 6.0
TABLE_GAP = 3.0
TABLE_LEAST = 20.0
# The painting operators that make image elements, and all that count as images.
IMAGE_OPERATORS = ("paintImageXObject", "paintInlineImageXObject", "paintImageXObjectRepeat")
MATRIX = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"


def is_thin(width: Column, height: Column) -> Column:
    return (width <= THIN) | (height <= THIN)


def thin_kind(width: Column, height: Column) -> Column:
    """vertical, horizontal, or null for a dot and for what isn't thin."""
    w, h = width <= THIN, height <= THIN
    return F.when(w & ~h, "vertical").when(h & ~w, "horizontal")


def is_near(a: str, b: str, gap: float) -> Column:
    """Whether two boxes, as column prefixes, overlap once one is widened by ``gap``; touching counts."""
    c = lambda p, n: F.col(f"{p}.{n}")
    reach = lambda p, q, at, size: c(p, at) <= c(q, at) + c(q, size) + gap
    return reach(a, b, "x", "width") & reach(b, a, "x", "width") & reach(a, b, "y", "height") & reach(b, a, "y", "height")


def near_pairs(boxes: DataFrame, gap: float, cell: float = 200.0) -> DataFrame:
    """``resource_id, page, ord_a, ord_b`` (a before b) of boxes of a page within ``gap``.

    Boxes are joined on grid cells that they, widened, reach into, not with all others of the page; a
    pair is kept in the first cell that both share, so none comes twice.
    """
    span = lambda at, size: F.sequence(F.floor((F.col(at) - gap / 2) / cell), F.floor((F.col(at) + F.col(size) + gap / 2) / cell))
    cells = boxes.withColumn("_cx", span("x", "width")).withColumn("_cy", span("y", "height"))
    spread = cells.withColumn("cx", F.explode("_cx")).withColumn("cy", F.explode("_cy")).withColumn("_x0", F.get("_cx", 0)).withColumn("_y0", F.get("_cy", 0)).drop("_cx", "_cy")
    a, b = spread.alias("a"), spread.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("resource_id", "page", "cx", "cy")]
    first = (F.col("a.cx") == F.greatest("a._x0", "b._x0")) & (F.col("a.cy") == F.greatest("a._y0", "b._y0"))
    pairs = a.join(b, [*same, F.col("a.ord") < F.col("b.ord"), first, is_near("a", "b", gap)])
    return pairs.select("a.resource_id", "a.page", F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b"))


def _clusters_of(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, gap: float) -> list[int]:
    """Cluster number of each box of a page, by order of each cluster's first box; a sweep along x."""
    parent = list(range(len(x)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by_x = np.argsort(x, kind="stable")
    sorted_x, widest = x[by_x], float(w.max(initial=0.0))
    for n, i in enumerate(by_x):
        js = by_x[np.searchsorted(sorted_x, x[i] - widest - gap) : n]
        near = (x[i] <= x[js] + w[js] + gap) & (x[js] <= x[i] + w[i] + gap) & (y[i] <= y[js] + h[js] + gap) & (y[js] <= y[i] + h[i] + gap)
        for j in js[near]:
            a, b = root(int(i)), root(int(j))
            parent[max(a, b)] = min(a, b)
    numbers: dict[int, int] = {}
    return [numbers.setdefault(root(i), len(numbers)) for i in range(len(x))]


def cluster_boxes(boxes: DataFrame, gap: float) -> DataFrame:
    """Adds ``cluster``: connected components of nearness in each page, numbered by their first box.

    A page's boxes are one row of arrays, so a batch of the function holds many pages, and no more than a
    page is looked at together.
    """
    box = F.struct(F.col("ord").cast("int").alias("ord"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")])
    pages = boxes.groupBy("resource_id", "page").agg(F.array_sort(F.collect_list(box)).alias("_b"))

    def run(x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([_clusters_of(*map(np.asarray, page), gap) for page in zip(x, y, w, h)])

    found = F.pandas_udf(run, T.ArrayType(T.IntegerType()))(*[F.col(f"_b.{c}") for c in ("x", "y", "width", "height")])
    rows = pages.withColumn("_c", found).select("resource_id", "page", F.explode(F.arrays_zip(F.col("_b").alias("b"), F.col("_c").alias("cluster"))).alias("z"))
    return rows.select("resource_id", "page", "z.b.*", "z.cluster")


def _cluster_box() -> list[Column]:
    return [
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"),
        (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"),
    ]


def drawings(boxes: DataFrame) -> DataFrame:
    """Clusters of boxes that aren't thin: ``resource_id, page, cluster, element_id, x, y, width, height, n_boxes``."""
    found = cluster_boxes(boxes.where(~is_thin(F.col("width"), F.col("height"))), DRAWING_GAP)
    out = found.groupBy("resource_id", "page", "cluster").agg(*_cluster_box(), F.count("*").alias("n_boxes"))
    return out.withColumn("element_id", F.concat_ws("-", "page", F.lit("drawing"), "cluster"))


def table_lattices(boxes: DataFrame) -> DataFrame:
    """Tables from thin lines: ``resource_id, page, cluster, element_id, x, y, width, height, row_bounds, col_bounds, n_rows, n_columns``.

    A cluster of rulings is a table with two or more distinct positions each way, at least 20 by 20.
    Clusters are numbered before that filter.
    """
    kinds = boxes.withColumn("kind", thin_kind(F.col("width"), F.col("height"))).where("kind is not null")
    found = cluster_boxes(kinds, TABLE_GAP).withColumn("kind", thin_kind(F.col("width"), F.col("height")))
    out = found.groupBy("resource_id", "page", "cluster").agg(
        *_cluster_box(),
        unique_positions(F.collect_list(F.when(F.col("kind") == "horizontal", F.col("y")))).alias("row_bounds"),
        unique_positions(F.collect_list(F.when(F.col("kind") == "vertical", F.col("x")))).alias("col_bounds"),
    )
    out = out.withColumn("n_rows", F.size("row_bounds") - 1).withColumn("n_columns", F.size("col_bounds") - 1)
    whole = (F.col("n_rows") >= 1) & (F.col("n_columns") >= 1) & (F.col("width") >= TABLE_LEAST) & (F.col("height") >= TABLE_LEAST)
    return out.where(whole).withColumn("element_id", F.concat_ws("-", "page", F.lit("table"), "cluster"))


def matrix(a=1.0, b=0.0, c=0.0, d=1.0, e=0.0, f=0.0) -> Column:
    names = zip("abcdef", (a, b, c, d, e, f))
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(k) for k, v in names])


def to_matrix(args: Column) -> Column:
    return F.when(F.size(args) == 6, matrix(*[F.get(args, i) for i in range(6)]))


def multiply(m: Column, n: Column) -> Column:
    """m, then n, for row vectors."""
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"],
        m["a"] * n["b"] + m["b"] * n["d"],
        m["c"] * n["a"] + m["d"] * n["c"],
        m["c"] * n["b"] + m["d"] * n["d"],
        m["e"] * n["a"] + m["f"] * n["c"] + n["e"],
        m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    )


def apply_matrix(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return x * m["a"] + y * m["c"] + m["e"], x * m["b"] + y * m["d"] + m["f"]


def transformed_box(m: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    """The upright box around the transformed corners, as x, y, width, height."""
    corners = [apply_matrix(m, x, y) for x in (x0, x1) for y in (y0, y1)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return [F.least(*xs).alias("x"), F.least(*ys).alias("y"), (F.greatest(*xs) - F.least(*xs)).alias("width"), (F.greatest(*ys) - F.least(*ys)).alias("height")]


IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _matrices(names: list[str], args: list) -> np.ndarray:
    """The current matrix before each operation of a page, six numbers each; one pass with a stack."""
    now, stack, out = IDENTITY, [], np.empty((len(names), 6))
    for i, (name, m) in enumerate(zip(names, args)):
        out[i] = now
        if name in ("save", "paintFormXObjectBegin"):
            stack.append(now)
        elif name in ("restore", "paintFormXObjectEnd"):
            now = stack.pop() if stack else IDENTITY
        if name in ("transform", "paintFormXObjectBegin") and m is not None and len(m) == 6 and not any(x is None for x in m):
            a, b, c, d, e, f = map(float, m)
            A, B, C, D, E, G = now
            now = (a * A + b * C, a * B + b * D, c * A + d * C, c * B + d * D, e * A + f * C + E, e * B + f * D + G)
    return out.ravel()


def track_ctm(operations: DataFrame) -> DataFrame:
    """Adds ``ctm``, the current matrix before each operation takes effect.

    A fold over a page's operations: save pushes, restore pops (the identity from an empty stack),
    transform multiplies from the left, a form pushes and multiplies when it begins, and pops at its end.
    A page is one row of arrays, worked off in one pass; a batch of the function holds many pages.
    """
    more = [c for c in ("name",) if c in operations.columns]
    op = F.struct("op_idx", "fn", F.col("args").cast("array<double>").alias("args"), *more)
    pages = operations.groupBy("resource_id", "page").agg(F.array_sort(F.collect_list(op)).alias("ops"))
    fold = F.pandas_udf(lambda fn, args: pd.Series([_matrices(n, a) for n, a in zip(fn, args)], dtype=object), T.ArrayType(T.DoubleType()))
    folded = pages.withColumn("seen", fold(F.col("ops.fn"), F.col("ops.args")))
    rows = folded.select("resource_id", "page", "seen", F.posexplode("ops").alias("i", "o"))
    ctm = matrix(*[F.get("seen", F.col("i") * 6 + k) for k in range(6)])
    return rows.select("resource_id", "page", "o.op_idx", "o.fn", "o.args", *[f"o.{c}" for c in more], ctm.alias("ctm"))


def path_boxes(tracked: DataFrame, viewport: Column | None = None) -> DataFrame:
    """Boxes of paths: the extent of each ``constructPath`` through the current matrix and the viewport's."""
    m = F.col("ctm") if viewport is None else multiply(F.col("ctm"), viewport)
    rows = tracked.where((F.col("fn") == "constructPath") & (F.size("args") == 4)).withColumn("_m", m)
    a = [F.get("args", i) for i in range(4)]
    return rows.select("resource_id", "page", F.col("op_idx").alias("ord"), *transformed_box(F.col("_m"), *a))


def image_elements(tracked: DataFrame, viewport: Column | None = None) -> DataFrame:
    """Images of pages: ``resource_id, page, n, element_id, name, x, y, width, height``.

    The unit square through the current matrix and the viewport's. Operations without an object ``name``
    are skipped; the rest are numbered in paint order, before any of them turns out to have no pixels.
    """
    m = F.col("ctm") if viewport is None else multiply(F.col("ctm"), viewport)
    rows = tracked.where(F.col("fn").isin(*IMAGE_OPERATORS) & F.col("name").isNotNull()).withColumn("_m", m)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("resource_id", "page").orderBy("op_idx")) - 1)
    zero, one = F.lit(0.0), F.lit(1.0)
    return rows.select("resource_id", "page", "n", F.concat_ws("-", "page", F.lit("image"), "n").alias("element_id"), "name", *transformed_box(F.col("_m"), zero, zero, one, one))


def image_boxes(tracked: DataFrame, viewport: Column | None = None) -> DataFrame:
    """Boxes of images: the unit square through the current matrix and the viewport's."""
    m = F.col("ctm") if viewport is None else multiply(F.col("ctm"), viewport)
    rows = tracked.where(F.col("fn").isin(*IMAGE_OPERATORS)).withColumn("_m", m)
    zero, one = F.lit(0.0), F.lit(1.0)
    return rows.select("resource_id", "page", F.col("op_idx").alias("ord"), *transformed_box(F.col("_m"), zero, zero, one, one))

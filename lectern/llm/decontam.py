"""Benchmark decontamination by winnowing, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import Stash, ascii_lower

# Words of lower-cased text, and of text as it is. Naming what they hold is three times
# faster in Java's regular expressions than naming what they don't.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
ANY_CASE_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
GRAM = 4
#: Benchmark fingerprints sent to the executors at once; more are worked off in blocks of this many.
BLOCK_ROWS = 200_000


def words_of(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _window_id(words: F.Column) -> F.Column:
    """The SHA-256 of a window's words, which have no spaces: what windows are compared by."""
    return F.unhex(F.sha2(F.concat_ws(" ", words), 256))


def _grams(df: DataFrame, span: int) -> DataFrame:
    """Adds ``pos, gram``: the gram hashes that winnowing keeps of ``words``, for shared spans of ``span`` words.

    k-grams of k = min(4, span) words; of each span - k + 1 grams in a row the least hash is kept (all,
    in a tie, so both sides keep the same). Every run of ``span`` words holds a kept gram, and it is the
    same one on either side. Whether a gram is least in some window is read off its neighbours: it is
    if the grams not less than it reach over a whole window around it.
    """
    k = min(GRAM, span)
    w = span - k + 1
    each = F.transform(F.sequence(F.lit(0), F.size("words") - F.lit(k)), lambda i: F.xxhash64(*[F.get(F.col("words"), i + j) for j in range(k)]))
    hashed = df.withColumn("grams", F.when(F.size("words") >= span, each))
    # The outer form keeps the optimiser from pushing a filter on the array, which would compute the words anew for each gram.
    rows = hashed.select(*df.columns, "grams", F.posexplode_outer("grams").alias("pos", "gram")).where("pos is not null")
    if w > 1:
        near = {d: F.coalesce(F.get(F.col("grams"), F.col("pos") + d) >= F.col("gram"), F.lit(False)) for d in range(1 - w, w) if d}

        def reach(sign: int) -> F.Column:
            out, run = F.lit(0), F.lit(True)
            for d in range(1, w):
                run = run & near[sign * d]
                out = out + F.when(run, 1).otherwise(0)
            return out

        rows = rows.where(reach(-1) + reach(1) >= w - 1)
    return rows.select(*df.columns, "pos", "gram")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_key``.

    Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. A window is ``window``
    words in a row of a benchmark item, or a whole shorter one. Winnowed fingerprints of documents are
    joined with those of the benchmark; each match is extended to the whole window and compared by its
    words' SHA-256, so the result is exact. ``n_hit`` counts words inside any occurrence of a window, ``n_items``
    the items with occurring windows, ``items_sha256`` digests their sorted ids, comma-joined.

    Null and empty texts have no words and no hits; repeated rows give repeated rows; a null doc_id
    stays. Items with a null id or no words are no items; equal item_ids are one item. An empty
    benchmark hits nothing. Other columns are ignored. Documents are hashed once for each length of
    windows (at most ``window``) and each block of about ``block_rows`` benchmark fingerprints; a block is
    what is broadcast, rows of fixed size dealt out by their own hash, so one frequent gram fills none.
    """
    stash = Stash(docs.sparkSession, "winnow")
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("span", F.least(F.size("words"), F.lit(window)))
    windows = stash.put(
        items.select("item", "span", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("span") + 1), lambda i: F.slice(F.col("words"), i, F.col("span")))).alias("words"))
        .select("item", "span", "words", _window_id(F.col("words")).alias("wid"))
        .distinct()
    )
    spans = sorted(r["span"] for r in windows.select("span").distinct().collect())  # at most `window` numbers
    text = docs.select(F.col("text"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_key"))
    hits = None
    for span in spans:
        table = stash.put(_grams(windows.where(F.col("span") == span).select("wid", "words").distinct(), span).select("wid", "pos", "gram"))
        blocks = max(1, math.ceil(table.count() / block_rows))
        for b in range(blocks):
            block = table.where(F.pmod(F.xxhash64("wid", "pos"), F.lit(blocks)) == b) if blocks > 1 else table
            block = F.broadcast(block.select("wid", F.col("pos").alias("item_pos"), F.col("gram").alias("item_gram")))
            found = (
                _grams(text.select("text_key", words_of(F.col("text")).alias("words")), span)
                .join(block, F.col("gram") == F.col("item_gram"))
                .withColumn("start", F.col("pos") - F.col("item_pos"))
                .where((F.col("start") >= 0) & (_window_id(F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.lit(span))) == F.col("wid")))
                .select("text_key", "start", F.lit(span).alias("span"), "wid")
            )
            hits = found if hits is None else hits.union(found)
    base = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_key"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"))
    none = F.sha2(F.lit(""), 256)
    if hits is None:
        return base.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"), "text_key")
    hits = stash.put(hits.distinct())
    starts = hits.groupBy("text_key", "start").agg(F.max(F.col("start") + F.col("span")).alias("end"))
    before = Window.partitionBy("text_key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        starts.withColumn("done", F.coalesce(F.max("end").over(before), F.lit(0)))
        .groupBy("text_key")
        .agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "done"))).cast("long").alias("n_hit"))
    )
    named = hits.select("text_key", "wid").distinct().join(windows.select("wid", "item"), "wid").groupBy("text_key").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    per_text = stash.put(covered.join(named, "text_key"))
    return base.join(per_text, "text_key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce(F.size("ids"), F.lit(0)) >= min_items).alias("contaminated"),
        "text_key",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = 1) -> DataFrame:
    """``docs`` without the rows whose text holds windows of ``min_items`` or more benchmark items.

    All columns stay as they are; rows are told apart by their text, so null ids and repeated rows do no harm.
    """
    found = decontaminate(docs, benchmark, min_items=min_items).where("contaminated").select("text_key").distinct()
    gone = Stash(docs.sparkSession, "leaks").put(found)
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    return docs.join(gone, key == gone["text_key"], "left_anti").select(*[docs[c] for c in docs.columns])

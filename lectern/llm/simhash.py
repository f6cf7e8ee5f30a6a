"""SimHash fingerprints and near-duplicate groups by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import Stash
from lectern.llm.components import connected_components

BLOCK = 1 << 16
SEGMENT_BITS = 32
#: Fingerprints with one value of a segment; where there are more, their other segment is searched by its halves.
CROWD = 1024


def fingerprint(text: str | None, n: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the n-word shingles; 0 for a text without words or null.

    Works in blocks of shingles, so its memory doesn't depend on the text's number of shingles.
    """
    words = (text or "").encode().lower().split()  # bytes: A-Z alone, and white space \x20\x09-\x0D alone
    if not words:
        return 0
    n = min(n, len(words))
    fill, digest = b" ".join([b"%b"] * n), xxhash.xxh64_intdigest
    ones, count = np.zeros(64, np.int64), len(words) - n + 1
    for at in range(0, count, BLOCK):
        part = words[at : at + BLOCK + n - 1]
        hashes = np.fromiter((digest(fill % s, seed) for s in zip(*(part[i:] for i in range(n)))), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0])


def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(x) for x in text], dtype=np.uint64).view(np.int64))


def fingerprint_of(text: str) -> F.Column:
    return F.pandas_udf(_fingerprints, T.LongType())(text)


def similar_fingerprints(prints: DataFrame, stash: Stash, radius: int = 3, crowd: int = CROWD) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of the distinct longs ``fp`` at ``radius`` or fewer differing bits.

    The 64 bits are two segments of 32. Two fingerprints within 3 bits agree within 1 bit in one of
    them, so each fingerprint looks up the 33 values of the radius-1 ball around each of its segments
    in a table keyed by segment and value; whole distances are verified inside the join. Segments this
    long keep buckets short: unrelated fingerprints meet with chance 2**-32 per lookup. Values that more
    than ``crowd`` fingerprints share, as in large groups of near copies, are searched a second time in
    the same way: the other segment's halves of 16 bits, one of which agrees within 1 bit, are looked up
    in a table keyed by the value and the half, so a bucket holds at most 2**16 fingerprints.
    """
    ball = radius // 2
    if ball > 1:
        raise ValueError("radius above 3 needs more segments")
    low = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    high = F.shiftrightunsigned("fp", SEGMENT_BITS)
    mark = 1 << SEGMENT_BITS
    probes = F.array(*[F.lit((s << SEGMENT_BITS) | m) for s in (0, 1) for m in [0] + [1 << i for i in range(SEGMENT_BITS) if ball]])
    part = F.when(F.col("probe") < F.lit(mark), low).otherwise(high)
    looking = prints.select("fp", F.explode(probes).alias("probe")).select(F.col("fp").alias("a"), part.bitwiseXOR(F.col("probe")).alias("key"))
    table = prints.select(F.col("fp").alias("b"), F.explode(F.array(low, high.bitwiseOR(F.lit(mark)))).alias("key"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    hot = stash.put(table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"))
    if hot.isEmpty():
        return looking.join(table, "key").where(close).select("a", "b").distinct()
    plain = looking.join(hot, "key", "left_anti").join(table, "key").where(close).select("a", "b")
    half = SEGMENT_BITS // 2

    def other(name: str, shift: int) -> F.Column:
        whole = F.when(F.col("key") < F.lit(mark), F.shiftrightunsigned(name, SEGMENT_BITS)).otherwise(F.col(name).bitwiseAND(F.lit(mark - 1)))
        return F.shiftrightunsigned(whole, shift).bitwiseAND(F.lit((1 << half) - 1))

    halves = F.array(*[other("b", s * half).bitwiseOR(F.lit(s << half)) for s in (0, 1)])
    around = F.array(*[other("a", s * half).bitwiseXOR(F.lit(m)).bitwiseOR(F.lit(s << half)) for s in (0, 1) for m in [0] + [1 << i for i in range(half)]])
    finer = looking.join(hot, "key", "left_semi").select("a", "key", F.explode(around).alias("half"))
    crowded = finer.join(table.join(hot, "key", "left_semi").select("b", "key", F.explode(halves).alias("half")), ["key", "half"])
    return plain.union(crowded.where(close).select("a", "b")).distinct()


def simhash_groups(docs: DataFrame, radius: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per document: ``doc_id, fingerprint, component_id``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest doc_id reachable over
    links of ``radius`` or fewer differing bits, itself included. Null and empty texts have the
    fingerprint zero and link like any other. Repeated rows stay repeated; a null doc_id stays null
    and takes the component of its fingerprint (null if that holds null ids alone). Other columns are
    ignored. Equal fingerprints are one node, so copies are never expanded into pairs.
    """
    stash = Stash(docs.sparkSession, "simhash")
    prints = stash.put(docs.select("doc_id", fingerprint_of("text").alias("fp")))
    nodes = stash.put(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    links = connected_components(similar_fingerprints(nodes.select("fp"), stash, radius), stash)
    labels = stash.put(nodes.join(links, nodes["fp"] == links["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component")))
    lowest = stash.put(labels.groupBy("component").agg(F.min("first_id").alias("component_id")))
    groups = stash.put(labels.join(lowest, "component").select("fp", "component_id"))
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Keeps of each group the document with the smallest doc_id; all columns stay as they are.

    Rows of one doc_id are one document. Rows without a doc_id can't be told apart and stay.
    """
    groups = simhash_groups(docs, radius)
    gone = Stash(docs.sparkSession, "simhash-gone").put(groups.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)

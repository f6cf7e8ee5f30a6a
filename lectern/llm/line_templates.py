"""Line dedup by a fixed-depth log-template tree."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Stash, text_key

WILD = b"<*>"
#: Masks that reorder 60-bit line hashes, each giving another least line of a document.
ORDERS = (0, 0xFFFFFFFFFFFFFFF, 0x555555555555555, 0xAAAAAAAAAAAAAAA)
#: The weight of one family of documents; a document that is one of c counts for UNIT // c.
UNIT = 27720
#: Keys of texts that a task remembers.
SEEN = 1 << 20

_DIGIT = re.compile(rb"[0-9]").search
LINES = "text_key binary, t long, line int, n int, whole long, leaf long, masked string"


def _short(key: bytes) -> int:
    """The first half of a text's key, which tells texts apart where they are only counted."""
    return int.from_bytes(key[:8], "big", signed=True)


def text_lines(docs: DataFrame, lead: int = 2) -> DataFrame:
    """``LINES`` of each line that isn't blank. What is counted is counted by texts, so a text that a task has seen is left out.

    ``masked`` has single spaces, and each token that holds a digit is generalised to a wildcard. The
    tree's first level is the token count ``n``, the next ``lead`` levels are the leading tokens; these make
    the ``leaf``. ``whole`` is a 60-bit hash of the masked line that SQL has too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        names, md5, xxh = [x.split()[0] for x in LINES.split(", ")], hashlib.md5, xxhash.xxh3_64_intdigest
        seen: set[bytes] = set()
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(0).to_pylist():
                raw = text.encode()
                key = md5(raw).digest()
                if key in seen:
                    continue
                seen.add(key)
                t = _short(key)
                for i, line in enumerate(raw.split(b"\n")):
                    tokens = line.split()  # bytes: at ASCII white space alone
                    if tokens:
                        if _DIGIT(line):
                            tokens = [WILD if _DIGIT(x) else x for x in tokens]
                        masked, n = b" ".join(tokens), len(tokens)
                        leaf = xxh(b"%d " % n + b" ".join(tokens[:lead])) - (1 << 63)
                        out.append((key, t, i, n, int(md5(masked).hexdigest()[:15], 16), leaf, masked))
                if len(out) > 1 << 14:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
            if len(seen) > SEEN:
                seen.clear()

    return docs.where("text is not null").select("text").mapInArrow(run, LINES)


def leaf_templates(lines: DataFrame, stash: Stash, min_docs: int, min_constant: int, constant_share: float) -> DataFrame:
    """``t, line, template`` of the lines that a template with wildcards describes.

    Below a leaf each position is a wildcard but where the line's token stands there in ``min_docs``
    different texts of the leaf; a token with a digit always is one. The constant tokens and their places
    are the template. It describes a line only with ``min_constant`` constants or more, and these at least
    ``constant_share`` of the tokens: so a name in a short line varies, and prose that begins alike is none.
    """
    long = lines.where(F.col("n") > min_constant).select("t", "line", "n", "leaf", "masked")
    busy = stash.put(long.groupBy("leaf").agg(F.count("*").alias("c")).where(F.col("c") >= min_docs).select("leaf"))
    each = long.join(busy, "leaf", "left_semi").select("t", "line", "n", "leaf", F.posexplode(F.split("masked", " ", -1)).alias("at", "token"))
    placed = stash.put(each.where(F.col("token") != F.lit(WILD.decode())).select(F.xxhash64("leaf", "at", "token").alias("place"), "t", "line", "n"))
    often = stash.put(placed.select("place", "t").distinct().groupBy("place").agg(F.count("*").alias("c")).where(F.col("c") >= min_docs).select("place"))
    constant = placed.join(often, "place", "left_semi").groupBy("t", "line", "n").agg(F.count("*").alias("k"), F.sort_array(F.collect_list("place")).alias("kept"))
    enough = (F.col("k") >= min_constant) & (F.col("k") >= F.col("n") * constant_share) & (F.col("k") < F.col("n"))
    out = stash.put(constant.where(enough).select("t", "line", F.xxhash64("kept").alias("template")))
    for old in (busy, placed, often):
        stash.drop(old)
    return out


def recurring_lines(lines: DataFrame, stash: Stash, min_docs: int = 10, min_constant: int = 4, constant_share: float = 0.6) -> DataFrame:
    """``t, line``: the lines whose whole form or template recurs in ``min_docs`` families of documents.

    Equal texts count once. Copies with changes are told from unrelated documents by their other lines: in
    each of four orders of line hashes a text's least line but this one puts it into a group, and a text
    that is one of c in its group counts for 1/c. Of its four groups the second largest is taken: a
    changed copy falls out of its family's group in one order or another, hardly in three; a second line
    that always stands beside this one is least in one order or another only. A text of this line alone is
    one family with others like it. The sum of these shares is the number of families, rounded. Only lines
    in ``min_docs`` texts are looked at so closely, and all groups are counted by partial sums.
    """
    often = lambda rows, key: rows.select(key, "t").distinct().groupBy(key).agg(F.count("*").alias("c")).where(F.col("c") >= min_docs).select(key)
    found = leaf_templates(lines, stash, min_docs, min_constant, constant_share)
    slim = lines.select("t", "line", "whole")
    wholes = slim.join(stash.put(often(slim, "whole")), "whole", "left_semi").select("t", "line", F.xxhash64(F.lit("whole"), "whole").alias("key"))
    varied = found.join(stash.put(often(found, "template")), "template", "left_semi").select("t", "line", F.xxhash64(F.lit("template"), "template").alias("key"))
    seen = stash.put(wholes.union(varied))
    own = seen.groupBy("key", "t").agg(F.collect_set("line").alias("mine"))
    texts = slim.join(stash.put(seen.select("t").distinct()), "t", "left_semi").groupBy("t").agg(F.collect_list(F.struct("line", "whole")).alias("all"))  # one text's lines
    least = F.array_min(F.transform(F.filter("all", lambda x: F.array_contains("mine", x["line"])), lambda x: x["whole"]))
    placed = own.join(texts, "t").select("key", "t", F.transform("all", lambda x: x["whole"]).alias("all"), least.alias("own"))
    others = F.array(*[F.coalesce(F.array_min(F.transform(F.filter("all", lambda h: h != F.col("own")), lambda h: h.bitwiseXOR(o))), F.lit(-1)) for o in ORDERS])  # noqa: B023
    grouped = stash.put(placed.select("key", "t", F.posexplode(others).alias("i", "other")))
    group = ["key", "i", "other"]
    shares = grouped.join(grouped.groupBy(*group).agg(F.count("*").alias("c")), group).select("key", "t", F.floor(F.lit(UNIT) / F.col("c")).alias("share"))
    per_text = shares.groupBy("key", "t").agg(F.sort_array(F.collect_list("share"))[1].alias("share"))
    families = per_text.groupBy("key").agg(F.sum("share").alias("s")).where(F.col("s") >= int((min_docs - 0.5) * UNIT)).select("key")
    return seen.join(stash.put(families), "key", "left_semi").select("t", "line").distinct()


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_constant: int = 4, constant_share: float = 0.6, lead: int = 2) -> DataFrame:
    """``docs`` with the lines of recurring templates dropped from ``text``; adds ``n_lines, n_dropped``.

    All other columns stay. Lines are divided by \\n; blank ones are never dropped. A null text stays
    null, with 0 lines; an empty text has one blank line. What is dropped depends on texts alone, so
    repeated rows lose the same lines, and null ids are fine. No document is dropped: one whose every line
    recurs keeps an empty text. An empty table gives an empty table.
    """
    stash = Stash(docs.sparkSession, "lines")
    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    lines = stash.put(text_lines(docs.select("text"), lead))
    found = recurring_lines(lines, stash, min_docs, min_constant, constant_share).groupBy("t").agg(F.collect_set("line").alias("_gone"))
    gone = stash.put(found.join(lines.select("t", "text_key").distinct(), "t").drop("t"))
    stash.drop(lines)
    marked = docs.select(F.struct(*own).alias("_own"), "text", text_key("text").alias("text_key")).join(gone, "text_key", "left")  # apart, as names may clash
    all_lines, drop = F.split("text", "\n", -1), F.coalesce("_gone", F.array().cast("array<int>"))
    left = F.when(F.size(drop) == 0, F.col("text")).otherwise(F.array_join(F.filter(all_lines, lambda x, i: ~F.array_contains(drop, i)), "\n"))
    n_lines = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    told = marked.select("_own", F.struct(left.alias("text"), F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.size(drop).cast("long").alias("n_dropped")).alias("_new"))
    return told.select("_own.*", "_new.*")

"""Packing of tokenised documents into training sequences by best-fit decreasing."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Remainders sorted together; more in one task follow in further rounds, into the windows that are still open.
ROUND = 1 << 18
#: A sequence's number holds its task's above these bits.
TASK_SHIFT = 40


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree over the capacities 0 to ``size``.

    A node knows whether any window below it has its capacity, so the least capacity that is at least
    a piece's length is found in log(size) steps: the tightest open window.
    """

    def __init__(self, size: int):
        self.size, self.leaves = size, 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        at = self.leaves + capacity
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Removes and gives a window of the least capacity >= length, and that capacity."""
        count, at = self.count, self.leaves + length
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        while at:
            count[at] -= 1
            at >>= 1
        return self.windows[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, free: OpenWindows, opened: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Window number and offset of each piece, and the number of windows, counted on from ``opened``; ties go by place.

    ``free`` holds the windows left open by rounds before, which pieces may join.
    """
    size = free.size
    window, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        found = free.take(n)
        if found is None:
            found, opened = (opened, size), opened + 1
        window[i], offset[i] = found[0], size - found[1]
        if found[1] > n:
            free.add(found[1] - n, found[0])
    return window, offset, opened


# Fixed value: the pre-tokenisation pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PROBES = ("", " ", "a  b\n\n c\t", "Don't we'll 1234 x2 -- (é) ñandú 日本語 \U0001f600\u200d!", "\u00a0\u2003x\x00\x85y\r\n")


def _ranked(path: str) -> Callable[[str], list[int]] | None:
    """The encoder that the vocabulary at ``path`` says, by ranks; None unless it is plain byte-level BPE, whose merges have the order of their ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not plain or spec.get("normalizer") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    if any(x.get(k) for x in added for k in ("lstrip", "rstrip", "single_word")):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these bytes stand for themselves, the rest follow from 256 on
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {x["content"]: x["id"] for x in added}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    if sorted(ranks.values()) != list(range(len(ranks))) or [model["vocab"].get(a + b) for a, b in merges] != list(range(256, len(ranks))):
        return None
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: [y for x in _runs(text) for y in encoding.encode(x, allowed_special="all")]


def encoder(path: str) -> Callable[[str], list[int]]:
    """A function from a text to the ids that ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives.

    Strings of added tokens in a text get these tokens' ids. Where the vocabulary's own file shows it to be
    plain byte-level BPE, and probes confirm it, the same ids are worked out by ranks, several times faster.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    slow, fast = (lambda text: tokenizer.encode(text, add_special_tokens=False).ids), _ranked(path)
    if fast is None:
        return slow
    added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    probes = [*_PROBES, *(f"a {x} b{x}{x[:-1]}" for x in added)]
    return fast if all(fast(x) == slow(x) for x in probes) else slow


def _runs(text: str, most: int = 1 << 20) -> Iterator[str]:
    """A long text in runs that tokenise as in the whole: cut where a letter is followed by a space and a letter."""
    at = 0
    while len(text) - at > most:
        cut = next((i for i in range(at + most, at + most // 2, -1) if text[i] == " " and text[i - 1].isalpha() and text[i + 1 : i + 2].isalpha()), None)
        if cut is None:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 0, round_rows: int = ROUND, by: str | None = None) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``, as in ``PIECES``, and ``by`` if it is named.

    A document is its ids and ``end_id``. Documents of ``size`` or more are first cut into full windows,
    which are sequences of their own; what remains of each is packed best-fit decreasing with the other
    remainders of its task, so packing needs no shuffle and a lost task is done again alike. A null or
    empty text is ``end_id`` alone. Repeated rows and null ids are documents like any other. A task sorts
    ``round_rows`` remainders at a time and holds lengths and digests of these alone; later ones go into the
    windows still open. ``sequence_id`` is the task's number, shifted, plus a count. Each task may leave its
    last windows unfilled, so sequences are the fuller the more documents a task has.

    ``by`` names a column, as the language: a sequence then holds documents of one value of it alone (null
    is one, too), and each value may leave its last windows of a task unfilled. Open windows take some
    100 KB for each value that a task has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, context = encoder(vocabulary), TaskContext.get()
        base, used = (context.partitionId() if context else 0) << TASK_SHIFT, 0
        free: dict[str | None, OpenWindows] = defaultdict(lambda: OpenWindows(size))
        rest: dict[str | None, list[tuple]] = defaultdict(list)
        columns = [x.split()[0] for x in PIECES.split(", ")]

        def packed() -> Iterator[pd.DataFrame]:
            nonlocal used
            for group, rows in rest.items():
                window, offset, used = best_fit_decreasing(np.array([x[2] for x in rows], np.int64), free[group], used)
                out = pd.DataFrame(rows, columns=columns[:5])
                out["sequence_id"], out["offset"] = window + base, offset
                yield _typed(out if by is None else out.assign(**{by: group}))
            rest.clear()

        for batch in batches:
            full, groups = [], []
            for doc_id, text, group in zip(batch["doc_id"].array, batch["text"].array, [None] * len(batch) if by is None else batch[by].array):
                group = group if isinstance(group, str) else None
                ids = encode(text) if isinstance(text, str) else []
                ids.append(end_id)
                raw, n = np.array(ids, "<u4"), len(ids)
                for at in range(0, n, size):
                    piece = raw[at : at + size]
                    row = (doc_id, at, len(piece), crc32(piece.tobytes()), n)
                    if len(piece) == size:
                        full.append((*row, base + used, 0))
                        groups.append(group)
                        used += 1
                    else:
                        rest[group].append(row)
            if full:
                out = pd.DataFrame(full, columns=columns)
                yield _typed(out if by is None else out.assign(**{by: groups}))
            if sum(map(len, rest.values())) >= round_rows:
                yield from packed()
        yield from packed()

    if by is None:
        return docs.select("doc_id", "text").mapInPandas(run, PIECES)
    return docs.select("doc_id", "text", F.col(by).cast("string").alias(by)).mapInPandas(run, f"{PIECES}, `{by}` string")


def _typed(rows: pd.DataFrame) -> pd.DataFrame:
    rows["doc_id"] = pd.array([None if x is None or x is pd.NA or x != x else int(x) for x in rows["doc_id"]], "Int64")
    return rows


def padding(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """``sequences, tokens, fill``: how full the sequences are."""
    return pieces.agg(F.countDistinct("sequence_id").alias("sequences"), F.sum("length").alias("tokens")).withColumn("fill", F.col("tokens") / (F.col("sequences") * size))

"""Substring dedup: MinHash banding of paragraphs, exact Jaccard, and components of what repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.llm.common import Stash, text_key
from lectern.llm.components import connected_components

SHINGLE = 5
#: Bands of the passages found, and MinHash rows of each; runs of MIN_WORDS words have one band of one row.
BANDS, ROWS = 4, 3
MIN_WORDS = 20
#: Bytes of text hashed at once; a longer text is hashed in blocks that end between words.
RUN = 1 << 20
#: Hashes that a task remembers, so as to keep one text of each.
SEEN = 1 << 20
#: Seeds of a bucket that are compared in one place, by the memory of a task; more are dealt out.
CROWD = 1 << 17
#: Rounds in which a bucket's passages are held against one leader, before what is still apart is compared in blocks.
LEADERS = 2
#: Passages of a bucket that are compared with so many others at once.
BLOCK = 512

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_KEEP = np.zeros(256, bool)
_KEEP[48:58] = _KEEP[97:123] = _KEEP[128:] = True
_rng = np.random.default_rng(3)
_MUL = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (_BASE, _INVERSE))
    return base, inverse


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of the shingle that begins at each word but the last SHINGLE - 1."""
    n = max(0, len(words) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out += _mix(words[i : i + n] + np.uint64(i + 1)) * np.uint64(2 * i + 3)
    return _mix(out)


class Words:
    """The words of a UTF-8 text: ``start, end`` (bytes), ``hash`` and ``line`` of each.

    Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. They are hashed in
    blocks that end between words, so memory beyond some 30 bytes a word doesn't grow with the text.
    """

    _tables: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, raw: bytes):
        if Words._tables is None:
            Words._tables = _powers(RUN)
        low, parts, at, lines = raw.lower(), [], 0, 0
        while at < len(low):
            stop = self._break(low, at)
            b = np.frombuffer(low, np.uint8, stop - at, at)
            edge = np.flatnonzero(np.diff(np.r_[False, _KEEP[b], False].astype(np.int8)))
            start, end = edge[::2], edge[1::2]
            power, inverse = Words._tables if len(b) <= RUN else _powers(len(b))
            total = np.r_[np.uint64(0), np.cumsum(b.astype(np.uint64) * power[: len(b)], dtype=np.uint64)]
            breaks = np.flatnonzero(b == 10)
            parts.append((start + at, end + at, _mix((total[end] - total[start]) * inverse[start]), np.searchsorted(breaks, start) + lines))
            at, lines = stop, lines + len(breaks)
        empty = np.zeros(0, np.int64)
        self.start, self.end, self.hash, self.line = (np.concatenate(x) for x in zip(*parts)) if parts else (empty, empty, empty.view(np.uint64), empty)

    @staticmethod
    def _break(low: bytes, at: int) -> int:
        """End of the block that begins at ``at``: a byte that is in no word, RUN bytes on if there is one in between, else as far as it takes."""
        stop = at + RUN
        if stop >= len(low):
            return len(low)
        while stop > at and _KEEP[low[stop]]:
            stop -= 1
        if stop == at:
            stop = at + RUN
            while stop < len(low) and _KEEP[low[stop]]:
                stop += 1
        return stop


#: A seed's place takes the low bits of its hash when the least of a run is looked for.
_PLACE = np.uint64((1 << 28) - 1)


class Block:
    """Texts joined by line breaks and hashed together: ``words``, and of each text its first word and the end."""

    def __init__(self, texts: list[bytes]):
        self.words = Words(b"\n".join(texts))
        self.at = np.cumsum([0, *(len(t) + 1 for t in texts)])  # first byte of each text
        self.text = np.searchsorted(self.at, self.words.start, "right") - 1
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))

    @staticmethod
    def each(texts: list[bytes]) -> Iterator[tuple[int, Block]]:
        """Blocks of about RUN bytes, each with the number of its first text; a longer text is a block of its own."""
        first, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > RUN:
                yield first, Block(texts[first:i])
                first, size = i, 0
            size += len(t) + 1
        if size:
            yield first, Block(texts[first:])


def seeds(block: Block, span: int = MIN_WORDS) -> np.ndarray:
    """Words where the least shingle of some run of ``span`` words begins, in order.

    The least shingle hash is the run's MinHash of one row, so runs share a seed with the chance of their
    Jaccard similarity, and equal ones always. Neighbouring runs mostly have the same one: a text has
    about two seeds in span - SHINGLE + 2 words, though every run of it is banded. Of equal hashes the first counts.
    """
    s, wide = shingle_hashes(block.words.hash), span - SHINGLE + 1
    if len(s) < wide:
        return np.zeros(0, np.int64)
    least = (s & ~_PLACE) | np.arange(len(s), dtype=np.uint64)
    size = 1
    while size * 2 <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < wide:
        least = np.minimum(least[: len(s) - wide + 1], least[wide - size :])
    inside = block.text[: len(least)] == block.text[span - 1 :]  # runs of one text
    return np.unique(least[inside] & _PLACE).astype(np.int64)


def around(block: Block, at: np.ndarray, reach: int) -> np.ndarray:
    """A byte for each of the ``reach`` words before a seed, nearest first, and after it; 0 is outside the text."""
    place = np.arange(len(block.text)) + (block.text + 1) * reach
    code = np.zeros(len(block.text) + len(block.first) * reach, np.uint8)
    code[place] = block.words.hash % np.uint64(255) + np.uint64(1)
    return code[place[at][:, None] + np.r_[-1 - np.arange(reach), SHINGLE + np.arange(reach)]]


def _binary(rows: np.ndarray) -> pa.Array:
    ends = pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _raw(column: pa.Array) -> list[bytes]:
    return [x.encode() for x in column.to_pylist()]


def _seed_rows(texts: DataFrame, span: int) -> DataFrame:
    """``row, doc, at, key, near`` of each seed; ``near`` is what ``around`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, docs = batch.column("row").to_numpy(), batch.column("doc").to_numpy()
            for number, block in Block.each(_raw(batch.column("text"))):
                at = seeds(block, span)
                of = block.text[at]
                keys = shingle_hashes(block.words.hash)[at].view(np.int64)
                plain = (rows[number + of], docs[number + of], (at - block.first[of]).astype(np.int32), keys)
                yield pa.RecordBatch.from_arrays([*map(pa.array, plain), _binary(around(block, at, span - SHINGLE))], ["row", "doc", "at", "key", "near"])

    return texts.select("row", "doc", "text").mapInArrow(run, "row long, doc long, at int, key long, near binary")


_SEEDS = "g long, side int, salted boolean, row long, doc long, at int, near binary"
_FOUND = "kind int, lower boolean, start int, end int, other long, g long, side int, row long, doc long, at int, near binary"
_WEIGHTS = _rng.integers(1, 1 << 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Rows:
    """Seeds of whole groups, in order of group and document, as arrays; and what comparing them finds."""

    def __init__(self, g: np.ndarray, salt: np.ndarray, side: np.ndarray, salted: np.ndarray, row: np.ndarray, doc: np.ndarray, at: np.ndarray, near: np.ndarray, span: int):
        self.g, self.side, self.salted, self.row, self.doc, self.at, self.near, self.span = g, side, salted, row, doc, at, near, span
        self.group = np.cumsum(np.r_[False, (g[1:] != g[:-1]) | (salt[1:] != salt[:-1])])
        self.reach = span - SHINGLE
        self.hits: list[tuple[np.ndarray, ...]] = []  # row, lower, start, end, other

    def _hit(self, a: np.ndarray, b: np.ndarray, before: np.ndarray, length: np.ndarray) -> None:
        for x, y, lower in ((a, b, True), (b, a, False)):
            start = self.at[x] - before
            self.hits.append((self.row[x], np.full(len(x), lower), start, start + length, self.doc[y]))

    def _groups(self, of: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``of`` ordered by group and value, the number of each one's bucket, and each bucket's first, which has the least document."""
        by = np.lexsort((value, self.group[of]))
        order, value = of[by], value[by]
        group = self.group[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (value[1:] != value[:-1])][: len(order)]
        return order, np.cumsum(new) - 1, order[new]

    def compare(self) -> tuple[np.ndarray, np.ndarray]:
        """Finds the hits; returns the buckets' leaders, and seeds that are unlike theirs, of salted groups alone."""
        n, unlike, leaders = self.reach, [], []
        side = -(-n // 2)
        for k in (0, 1):
            part = self.near[:, k * n : k * n + side]
            of = np.flatnonzero(self.side == k)
            order, bucket, first = self._groups(of, (part[of].astype(np.uint64) * _WEIGHTS[:side]).sum(axis=1, dtype=np.uint64))
            lead = first[bucket]
            others = np.flatnonzero(self.doc[order] != self.doc[lead])
            a, b = order[others], lead[others]
            same = np.logical_and.accumulate(((self.near[a] == self.near[b]) & (self.near[a] > 0)).reshape(-1, 2, n), axis=2).sum(axis=2)
            enough = same.sum(axis=1) >= n
            self._hit(a[enough], b[enough], same[enough, 0], SHINGLE + same[enough].sum(axis=1))
            odd = np.zeros(len(first), bool)
            odd[bucket[others[~enough]]] = True
            unlike.append(order[odd[bucket]])
            leaders.append(first[self.salted[first]])
        rest = np.unique(np.concatenate(unlike))
        here = rest[~self.salted[rest]]
        which, before, value = self.windows(here)
        value = _grouped(value, self.g[which])
        order = np.lexsort((which, value))
        new = np.r_[True, value[order][1:] != value[order][:-1]][: len(order)]
        lead = order[new][np.cumsum(new) - 1]
        apart = self.doc[which[order]] != self.doc[which[lead]]
        self._hit(which[order[apart]], which[lead[apart]], before[order[apart]], np.full(apart.sum(), self.span))
        return np.unique(np.concatenate(leaders)), rest[self.salted[rest]]

    def windows(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each run of ``span`` words around each of the seeds: the seed, the words before it, and a hash of the words around it."""
        n, out = self.reach, []
        weighed = self.near[of].astype(np.uint64) * _WEIGHTS[: 2 * n]
        ahead, behind = (np.concatenate([np.zeros((len(of), 1), np.uint64), np.cumsum(x, axis=1, dtype=np.uint64)], axis=1) for x in (weighed[:, :n], weighed[:, n:]))
        for k in range(n + 1):
            whole = np.ones(len(of), bool)
            if k:
                whole &= self.near[of, k - 1] > 0
            if k < n:
                whole &= self.near[of, 2 * n - 1 - k] > 0
            out.append((of[whole], np.full(whole.sum(), k), _mix(ahead[whole, k] + behind[whole, n - k] + np.uint64(k + 1))))
        return tuple(np.concatenate(x) for x in zip(*out))

    def found(self) -> tuple[np.ndarray, ...]:
        """The hits, each once, with the least of the other documents."""
        row, lower, start, end, other = (np.concatenate(x) for x in zip(*self.hits))
        order = np.lexsort((other, end, start, lower, row))
        keys = [x[order] for x in (row, lower, start, end)]
        new = np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in keys])][: len(order)]
        return *(x[new] for x in keys), other[order][new]


def _compared(rows: DataFrame, span: int) -> DataFrame:
    """``rows`` (as ``_SEEDS``, with ``salt``), a group of ``g`` and ``salt`` in one place -> ``_FOUND``: hits (kind 0), and of
    salted groups the leaders (kind 1) and the seeds that are unlike their leader (kind 2)."""
    names = [x.split()[0] for x in _FOUND.split(", ")]

    def one(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        g, salt, side, salted, row, doc, at, near = (np.concatenate(x) for x in zip(*parts))
        x = _Rows(g, salt, side, salted, row, doc, at.astype(np.int64), near, span)
        leaders, unlike = x.compare()
        none = pa.nulls
        hit = x.found()
        n = len(hit[0])
        own = [pa.array(np.zeros(n, np.int32)), pa.array(hit[1]), *(pa.array(v.astype(np.int32)) for v in hit[2:4]), pa.array(hit[4])]
        yield pa.RecordBatch.from_arrays([*own, none(n, pa.int64()), none(n, pa.int32()), pa.array(hit[0]), none(n, pa.int64()), none(n, pa.int32()), none(n, pa.binary())], names)
        for kind, of in ((1, leaders), (2, unlike)):
            k = len(of)
            if k:
                head = [pa.array(np.full(k, kind, np.int32)), none(k, pa.bool_()), none(k, pa.int32()), none(k, pa.int32()), none(k, pa.int64())]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array(v[of]) for v in (g, side, row, doc, at)), _binary(near[of])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: batch.column(k) for k in batch.schema.names}
            near = np.frombuffer(b"".join(c["near"].to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            part = (*(c[k].to_numpy(zero_copy_only=False) for k in ("g", "salt", "side", "salted", "row", "doc", "at")), near)
            g, salt = part[:2]
            new = np.flatnonzero(np.r_[(g[0], salt[0]) != last, (g[1:] != g[:-1]) | (salt[1:] != salt[:-1])])
            last = (g[-1], salt[-1])
            if len(new):  # the groups before the last that begins here are whole
                cut = new[-1]
                before = [*held, tuple(x[:cut] for x in part)]
                if sum(len(x[0]) for x in before):
                    yield from one(before)
                held = [tuple(x[cut:] for x in part)]
            else:
                held.append(part)
        if held:
            yield from one(held)

    dealt = rows.repartition("g", "salt").sortWithinPartitions("g", "salt", "doc", "row", "at")
    return dealt.select("g", "salt", "side", "salted", "row", "doc", "at", "near").mapInArrow(run, _FOUND)


def _runs_around(rows: DataFrame, span: int) -> DataFrame:
    """``run, row, doc, start`` of every run of ``span`` words around the seeds ``rows``, told by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                g, row, doc, at = (batch.column(i).to_numpy() for i in range(4))
                near = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                no = np.zeros(len(g), np.int64)
                which, before, value = _Rows(g, no, no, no, row, doc, at, near, span).windows(np.arange(len(g)))
                yield pa.RecordBatch.from_arrays([pa.array(_grouped(value, g[which]).view(np.int64)), pa.array(row[which]), pa.array(doc[which]), pa.array((at[which] - before).astype(np.int32))], ["run", "row", "doc", "start"])

    return rows.select("g", "row", "doc", "at", "near").mapInArrow(run, "run long, row long, doc long, start int")


def _grouped(value: np.ndarray, g: np.ndarray) -> np.ndarray:
    return _mix(value + g.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shared_runs(texts: DataFrame, stash: Stash, span: int = MIN_WORDS, crowd: int = CROWD) -> DataFrame:
    """Runs of ``span`` words or more that texts of different documents share, around each seed:

    ``texts(row, doc, text)`` -> ``row, lower, start, end, other`` (in words): a run that the document ``other``
    has too, one with a lesser (``lower``) or greater number than the row's own.

    Seeds (one-row MinHash bands of all runs of ``span`` words) that several documents have make buckets by
    the eight words on either side of them. In a bucket each is held word by word against the one of the
    least document. Where one has no such run in common with that, all of the bucket's runs around the seed
    are compared with each other, by their hashes. So around each seed of each run that any other document
    has a run is found, without pairs; it goes as far as with the least such document. Buckets of more than
    ``crowd`` seeds are dealt out at random: their leaders then meet in a second round, and the runs around
    seeds that are unlike their leader are looked up among all runs of the bucket, by their hashes. Words
    beside the seed are compared by one byte each: a run may go a word too far (1 in 255).
    """
    reach = span - SHINGLE
    side = -(-reach // 2)
    every = _seed_rows(texts, span)
    again = stash.put(every.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("key"))
    held = stash.put(every.join(again, "key", "left_semi"))
    flat = [x.split()[0] for x in _SEEDS.split(", ")]
    zero, part = F.lit(bytearray(1)), lambda first, n: F.substring("near", first, n)
    both = F.array(*[F.when(part(k * reach + side, 1) != zero, F.struct(F.xxhash64("key", F.lit(k), part(k * reach + 1, side)).alias("g"), F.lit(k).alias("side"))) for k in (0, 1)])
    dealt = held.select(F.explode(F.array_compact(both)).alias("b"), *flat[3:]).select("b.g", "b.side", *flat[3:])
    sizes = dealt.groupBy("g").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("g", "m")
    salt = F.when(F.col("salted"), F.pmod(F.xxhash64("row"), F.ceil(F.col("m") / crowd))).otherwise(F.lit(0)).cast("long")
    rows = dealt.join(stash.put(sizes), "g").withColumn("salted", F.col("m") > crowd).select(*flat, salt.alias("salt"))
    found = []
    first = stash.put(_compared(rows, span))
    columns = ["row", "lower", "start", "end", "other"]
    found.append(first.where("kind = 0").select(*columns))
    if not first.where("kind > 0").isEmpty():
        leaders = first.where("kind = 1").select("g", "side", F.lit(True).alias("salted"), *flat[3:], F.lit(0).cast("long").alias("salt"))
        second = stash.put(_compared(leaders, span))
        found.append(second.where("kind = 0").select(*columns))
        unlike = stash.put(first.union(second).where("kind = 2").select("g", *flat[3:]).dropDuplicates(["g", "row", "at"]))
        every_run = _runs_around(rows.where("salted").join(unlike.select("g").distinct(), "g", "left_semi"), span)
        shared = stash.put(every_run.groupBy("run").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi"))
        lower = F.col("doc") > F.col("lo")
        own = _runs_around(unlike, span).join(shared, "run").select("row", lower.alias("lower"), "start", (F.col("start") + span).alias("end"), F.when(lower, F.col("lo")).otherwise(F.col("hi")).alias("other"))
        found.append(own)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    out = stash.put(out.groupBy("row", "lower", "start", "end").agg(F.min("other").alias("other")))
    for old in (again, held, first):
        stash.drop(old)
    return out


def joined_runs(of: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of one owner (``of``, a small number) that overlap by a shingle or more as one, with the least of their other documents."""
    order = np.lexsort((start, of))
    of, start, end, other = of[order], start[order], end[order], other[order]
    if not len(of):
        return of, start, end, other
    far = np.maximum.accumulate((of.astype(np.int64) << 32) + end)  # an owner's ends lie above those of the owners before
    new = np.r_[True, (of[1:] != of[:-1]) | (start[1:] > far[:-1] - (of[1:].astype(np.int64) << 32) - SHINGLE)]
    heads = np.flatnonzero(new)
    return of[new], start[new], np.maximum.reduceat(end, heads), np.minimum.reduceat(other, heads)


def passage_bands(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hash and MinHash band keys of passages of SHINGLE words or more, each a range of ``words``."""
    power, inverse = Words._tables if len(words) < RUN else _powers(len(words))
    sums = np.r_[np.uint64(0), np.cumsum(words * power[: len(words)], dtype=np.uint64)]
    whole = _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    size = end - start - SHINGLE + 1
    heads = np.cumsum(size) - size
    own = shingle_hashes(words)[np.repeat(start - heads, size) + np.arange(size.sum())]
    mins = [_mix(np.minimum.reduceat(own * m + a, heads)) if len(heads) else own for m, a in zip(_MUL, _ADD)]
    keys = []
    for i in range(BANDS):
        key = np.full(len(start), i, np.uint64)
        for j in range(ROWS):
            key += mins[i * ROWS + j] * np.uint64(2 * j + 1)
        keys.append(_mix(key).view(np.int64))
    return whole.view(np.int64), keys


PASSAGES = "row long, doc long, level int, first int, end int, words int, hash long, lower boolean, other long, " + ", ".join(f"band{i} long" for i in range(BANDS)) + ", text string"


def _passages(texts: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """The passages of texts with runs (level 0) and whole texts that have copies (level 2), as ``PASSAGES``; bytes are their places.

    Of those with one hash only the first in a task has bands and a text, whole texts have neither.
    """
    by_row = found.groupBy("row").agg(F.collect_list(F.struct("lower", "start", "end", "other")).alias("runs"))  # so many at most for each word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen = [x.split()[0] for x in PASSAGES.split(", ")], set()
        for batch in batches:
            rows, docs, copied, raws, runs = batch.column("row").to_numpy(), batch.column("doc").to_numpy(), batch.column("copied").to_numpy(zero_copy_only=False), _raw(batch.column("text")), batch.column("runs")
            of, flat = np.repeat(np.arange(len(rows)), runs.value_lengths().fill_null(0).to_numpy()), runs.flatten()
            lower, start, end, other = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("lower", "start", "end", "other"))
            for number, block in Block.each(raws):
                n = len(block.first) - 1
                mine = (of >= number) & (of < number + n)
                own, a, b, least_doc = joined_runs((of[mine] - number) * 2 + lower[mine], start[mine], end[mine], other[mine])
                text = own // 2
                sizes = np.diff(block.first)
                whole = np.flatnonzero(copied[number : number + n].astype(bool) & (sizes >= least))
                a, b = np.r_[block.first[text] + a, block.first[whole]], np.r_[block.first[text] + b, block.first[whole + 1]]
                level = np.r_[np.zeros(len(text), np.int32), np.full(len(whole), 2, np.int32)]
                text = np.r_[text, whole]
                key, bands = passage_bands(block.words.hash, a, b)
                new = np.zeros(len(key), bool)
                runs_only = np.flatnonzero(level == 0)
                new[runs_only[np.unique(key[runs_only], return_index=True)[1]]] = True
                new[new] = [h not in seen for h in key[new].tolist()]
                seen.update(key[new].tolist())
                first, stop = block.words.start[a] - block.at[text], block.words.end[b - 1] - block.at[text]
                said = pa.array([raws[number + i][x:y].decode("utf-8", "replace") if is_new else None for is_new, i, x, y in zip(new.tolist(), text.tolist(), first.tolist(), stop.tolist())], pa.string())
                is_run = level == 0
                partner = pa.array(np.r_[least_doc, np.zeros(len(whole), np.int64)], mask=~is_run)
                plain = (rows[number + text], docs[number + text], level, first.astype(np.int32), stop.astype(np.int32), (b - a).astype(np.int32), key)
                side = pa.array(np.r_[own % 2 == 1, np.zeros(len(whole), bool)])
                yield pa.RecordBatch.from_arrays([*map(pa.array, plain), side, partner, *(pa.array(x, mask=~new) for x in bands), said], names)
            if len(seen) > SEEN:
                seen.clear()

    joined = texts.join(by_row, "row", "left").where("runs is not null or hi <> doc")
    return joined.select("row", "doc", (F.col("hi") != F.col("doc")).alias("copied"), "text", "runs").mapInArrow(run, PASSAGES)


def words_in(raw: bytes) -> list[bytes]:
    return bytes(c if _KEEP[c] else 32 for c in raw.lower()).split()


def shingle_set(text: str) -> frozenset:
    words = words_in(text.encode())
    n = min(SHINGLE, len(words))
    return frozenset(zip(*(words[i:] for i in range(n))))


def jaccard(a: str, b: str) -> float:
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / max(1, len(x | y))


def similar_passages(passages: DataFrame, similarity: float, stash: Stash, leaders: int = LEADERS) -> DataFrame:
    """``(a, b)``: hashes of passages with a band in common and that Jaccard similarity or more.

    In each band's bucket every passage is verified against a leader, the least hash; those that are unlike
    it are held against the least among them, and so on for ``leaders`` rounds. What that leaves apart is
    verified in ``_links_left``. So the links join all that the verified pairs of all buckets would join,
    though not each such pair has a link of its own. No bucket is collected into one task.
    """
    fresh = passages.where("text is not null")
    texts = stash.put(fresh.select("hash", "text").dropDuplicates(["hash"]))
    bands = fresh.select("hash", F.explode(F.array(*[f"band{i}" for i in range(BANDS)])).alias("band")).distinct()
    crowd = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    bands = stash.put(bands.join(crowd, "band", "left_semi"))
    text, left, found, old = texts.select("hash", "text"), bands, None, []
    same = F.pandas_udf(lambda a, b: pd.Series([jaccard(x, y) for x, y in zip(a, b)], dtype=float), T.DoubleType())
    for _ in range(leaders):
        lead = stash.put(left.groupBy("band").agg(F.min("hash").alias("a")))
        others = left.join(lead, "band").where("hash <> a")
        pairs = others.select("a", F.col("hash").alias("b")).distinct().join(text.toDF("a", "text_a"), "a").join(text.toDF("b", "text_b"), "b")
        known = stash.put(pairs.select("a", "b", (same("text_a", "text_b") >= similarity).alias("like")))
        like = known.where("like").select("a", "b")
        found = like if found is None else found.union(like)
        old.append(lead)
        left = stash.put(others.join(known.where("not like").select("a", F.col("b").alias("hash")), ["a", "hash"]).select("hash", "band"))
        old.append(left)
        if left.isEmpty():
            break
    more = _links_left(bands, found, text, similarity, stash)
    for x in (*old, bands, texts):
        stash.drop(x)
    return found.union(more)


def _linked(group: list[tuple[int, int, bool, str]], similarity: float) -> Iterator[tuple[int, int]]:
    """``(a, b)`` of ``(hash, label, odd, text)``: links of the given similarity between those that are odd and all, as few as join all that can be joined."""
    group = sorted(group, key=lambda x: (x[2], x[0]))
    parent = {x[1]: x[1] for x in group}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    sets = [shingle_set(x[3]) for x in group]
    sizes = np.array([len(x) for x in sets])
    holding: dict[tuple, list[int]] = {}
    for i, x in enumerate(group):
        if not x[2]:
            for y in sets[i]:
                holding.setdefault(y, []).append(i)
    holders = {x: np.array(at) for x, at in holding.items()}
    for i, (key, label, odd, _) in enumerate(group):
        at = [holders[x] for x in sets[i] if x in holders] if odd else []
        if not at:
            continue
        both = np.bincount(np.concatenate(at), minlength=len(sets))
        for j in np.flatnonzero((both > 0) & (both / (sizes + sizes[i] - both) >= similarity)).tolist():
            x, y = root(label), root(group[j][1])
            if x != y:
                parent[x] = y
                yield min(key, group[j][0]), max(key, group[j][0])


def _links_left(bands: DataFrame, found: DataFrame, texts: DataFrame, similarity: float, stash: Stash, block: int = BLOCK) -> DataFrame:
    """The links between passages of one bucket that ``found`` doesn't join yet.

    In each bucket of more than two (of fewer, every pair is verified already) that lies in several
    components, all passages outside the bucket's largest component are verified against all of the
    bucket, in blocks of about ``block`` by ``block``, dealt out to tasks by bucket and block.
    """
    joined = connected_components(found, stash)
    members = stash.put(bands.join(joined, F.col("hash") == F.col("node"), "left").select("band", "hash", F.coalesce("component", "hash").alias("label")))
    per_label = members.groupBy("band", "label").agg(F.count("*").alias("n"))
    buckets = per_label.groupBy("band").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("main"), F.count("*").alias("labels"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    apart = stash.put(
        members.join(buckets.where("size > 2 and labels > 1"), "band").select(
            "band", "hash", "label", (F.col("label") != F.col("main.label")).alias("odd"), blocks(F.col("size")).alias("i_n"), blocks(F.col("size") - F.col("main.n")).alias("j_n")
        )
    )
    deal = lambda n: F.pmod(F.xxhash64("hash"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = apart.select("band", "hash", "label", F.lit(False).alias("odd"), deal(F.col("i_n")).alias("i"), each("j_n").alias("j"))
    against = apart.where("odd").select("band", "hash", "label", "odd", each("i_n").alias("i"), deal(F.col("j_n")).alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last, out = [], None, []
        for batch in batches:
            for *at, key, label, odd, text in zip(*(c.to_pylist() for c in batch.columns)):
                if at != last:
                    out += _linked(group, similarity)
                    group, last = [], at
                group.append((key, label, odd, text))
            if len(out) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])
                out = []
        out += _linked(group, similarity)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])

    dealt = every.union(against).join(texts, "hash").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    more = stash.put(dealt.select("band", "i", "j", "hash", "label", "odd", "text").mapInArrow(run, "a long, b long").distinct())
    for old in (members, apart):
        stash.drop(old)
    return more


def repeated_passages(docs: DataFrame, similarity: float = 0.8, min_words: int = MIN_WORDS) -> DataFrame:
    """The passages of ``docs(doc_id, text)`` that repeat across documents, one row each:

    ``doc_id, level, first_byte, end_byte, n_words, component_id, first_doc_id, removed, text_key``.

    Every run of ``min_words`` words (5 or more) of every text is a paragraph with a MinHash band of one row;
    runs that collide are compared word by word and extended as far as they agree (``shared_runs``). Runs of
    a text that overlap by a shingle make a passage (level 0), those that lesser documents have apart from
    those that greater ones have. A text that several documents have is a passage too (level 2); its runs
    are searched once, and listed for the least of these documents. Passages are then banded themselves
    (``BANDS`` of ``ROWS``), those that collide are verified by exact Jaccard similarity on five-word
    shingles, and links form components. Near copies of paragraphs share runs: two paragraphs of more than
    ``min_words + 1`` words that are similar by 0.8 always have one of ``min_words`` words in common.

    ``removed`` is true where a lesser document has the passage, or is in its component; ``first_doc_id`` is
    the least such. Documents without repeats have no row. Null and empty texts have none; rows with the
    same doc_id are the same document, told apart by their text; rows with a null doc_id are ignored. Other
    columns are ignored. Bytes count in the text's UTF-8 form. ``component_id`` is the least of its hashes.
    """
    if min_words < SHINGLE:
        raise ValueError("passages have a shingle at least")
    stash = Stash(docs.sparkSession, "passages")
    keyed = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("text_key"), "text")
    distinct = keyed.groupBy("text_key").agg(F.min("doc_id").alias("doc"), F.max("doc_id").alias("hi"), F.first("text").alias("text"))
    texts = stash.put(distinct.withColumn("row", F.monotonically_increasing_id()))
    found = shared_runs(texts, stash, min_words)
    passages = stash.put(_passages(texts, found, min_words))
    keys = stash.put(texts.select("row", "text_key", "doc", "hi"))
    stash.drop(texts)
    links = connected_components(similar_passages(passages, similarity, stash), stash)
    slim = passages.select("row", "doc", "level", "first", "end", "words", "hash", F.when(F.col("lower"), F.col("other")).alias("lesser"))
    slim = stash.put(slim.join(links, F.col("hash") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "hash")).drop("hash", "node", "component"))
    spread = slim.groupBy("component_id").agg(F.min(F.least("doc", "lesser")).alias("first_doc_id"))
    salts = 32  # a component may hold a third of all rows
    wide = spread.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    kept = slim.withColumn("_salt", F.pmod("row", F.lit(salts)).cast("int")).join(wide, ["component_id", "_salt"]).drop("_salt")
    kept = kept.join(keys.drop("doc", "hi"), "row")
    copies = keyed.select("doc_id", "text_key").distinct().join(kept.where("level = 2").drop("doc"), "text_key")
    every = kept.where("level = 0").withColumnRenamed("doc", "doc_id").unionByName(copies)
    return every.select(
        "doc_id",
        "level",
        F.col("first").alias("first_byte"),
        F.col("end").alias("end_byte"),
        F.col("words").alias("n_words"),
        "component_id",
        "first_doc_id",
        (F.col("doc_id") != F.col("first_doc_id")).alias("removed"),
        "text_key",
    )


def cut_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` without the removed passages: what ``repeated_passages`` marks is cut from each text.

    A row is known by its doc_id and text, so rows that share a doc_id alone keep what is theirs.
    """
    spans = passages.where("removed").groupBy("doc_id", F.col("text_key").alias("_key")).agg(F.array_distinct(F.array_sort(F.collect_list(F.struct("first_byte", "end_byte")))).alias("_spans"))

    def cut(text: pd.Series, first: pd.Series, end: pd.Series) -> pd.Series:
        out = []
        for t, a, e in zip(text, first, end):
            if t is not None and a is not None:
                raw, at, parts = t.encode(), 0, []
                for x, y in zip(a, e):  # lines and runs overlap
                    parts.append(raw[at:x])
                    at = max(at, y)
                t = b"".join([*parts, raw[at:]]).decode("utf-8", "replace")
            out.append(t)
        return pd.Series(out, dtype=object)

    left = F.pandas_udf(cut, T.StringType())("text", F.col("_spans.first_byte"), F.col("_spans.end_byte"))
    own = docs.columns
    keyed = docs.withColumn("_key", text_key("text"))
    return keyed.join(Stash(docs.sparkSession, "cuts").put(spans), ["doc_id", "_key"], "left").withColumn("text", left).select(*own)

"""ISO base media containers: writing raw samples, walking boxes, decoding sample tables."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME = 576  # one 24 x 24 picture of 8-bit grey samples
SIDE = 24
TIMESCALE = 25
KEY_EVERY = 12
PER_CHUNK = 64

# Fixed values of the container format: boxes that hold boxes, and how many bytes come before these.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0}


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return b"".join((head, *parts))


def full_box(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(raw: bytes, unit: int = FRAME) -> bytes:
    """``raw`` with bytes 255 appended up to a positive multiple of ``unit``."""
    return raw + b"\xff" * (max(1, -(-len(raw) // unit)) * unit - len(raw))


def write_container(payload: bytes) -> bytes:
    """A file of one video track whose samples are the payload's frames of 8-bit grey, uncompressed.

    The media data come first, so that sample offsets don't depend on the size of the tables.
    """
    frames = len(payload) // FRAME
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    kinds = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    data = box(b"mdat", payload)
    first = len(kinds) + len(data) - len(payload)
    keys = np.arange(1, frames + 1, KEY_EVERY, dtype=">u4")
    chunks = -(-frames // PER_CHUNK)
    runs = [(1, PER_CHUNK, 1)] if chunks > 1 or frames == PER_CHUNK else []
    if frames % PER_CHUNK:
        runs.append((chunks, frames % PER_CHUNK, 1))
    offsets = first + np.arange(chunks, dtype=np.int64) * (PER_CHUNK * FRAME)
    far = bool(offsets[-1] >> 32)
    entry = box(
        b"raw ",
        struct.pack(">6xH16xHHIIIH32sHh", 1, SIDE, SIDE, 0x480000, 0x480000, 0, 1, b"\x00" * 32, 40, -1),
    )
    table = box(
        b"stbl",
        full_box(b"stsd", 0, 0, struct.pack(">I", 1), entry),
        full_box(b"stts", 0, 0, struct.pack(">III", 1, frames, 1)),
        full_box(b"stss", 0, 0, struct.pack(">I", len(keys)), keys.tobytes()),
        full_box(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full_box(b"stsz", 0, 0, struct.pack(">II", FRAME, frames)),
        full_box(b"co64" if far else b"stco", 0, 0, struct.pack(">I", chunks), offsets.astype(">u8" if far else ">u4").tobytes()),
    )
    info = box(
        b"minf",
        full_box(b"vmhd", 0, 1, bytes(8)),
        box(b"dinf", full_box(b"dref", 0, 0, struct.pack(">I", 1), full_box(b"url ", 0, 1))),
        table,
    )
    media = box(
        b"mdia",
        full_box(b"mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)),
        full_box(b"hdlr", 0, 0, struct.pack(">I4s12x", 0, b"vide"), b"frames\x00"),
        info,
    )
    track = box(b"trak", full_box(b"tkhd", 1, 3, struct.pack(">QQIIQ8xhhhH", 0, 0, 1, 0, frames, 0, 0, 0, 0), matrix, struct.pack(">II", SIDE << 16, SIDE << 16)), media)
    movie = full_box(b"mvhd", 1, 0, struct.pack(">QQIQIH10x", 0, 0, TIMESCALE, frames, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2))
    return b"".join((kinds, data, box(b"moov", movie, track)))


class Malformed(ValueError):
    """A box whose counts or places don't fit its bounds, or the file's."""


def walk(raw: bytes, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int, int]]:
    """``(path, first byte of the body, end, first byte of the box)`` of each box, outer before inner; a bad size ends its level."""
    end = len(raw) if end is None else end
    while end - start >= 8:
        size, kind = struct.unpack_from(">I4s", raw, start)
        head = 8
        if size == 1 and end - start >= 16:
            size, head = struct.unpack_from(">Q", raw, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        here = (*path, kind)
        yield here, start + head, start + size, start
        if kind in CONTAINERS and len(here) < 16:
            yield from walk(raw, start + head + CONTAINERS[kind], start + size, here)
        start += size


class _Body:
    """The body of a full box, read within its bounds."""

    def __init__(self, raw: bytes, at: int, end: int, kind: bytes):
        self.raw, self.at, self.end, self.kind = raw, at, end, kind

    def _within(self, at: int, size: int) -> int:
        if size < 0 or at + size > self.end:
            raise Malformed(f"{self.kind.decode('latin-1')} ends before its content")
        return at

    def read(self, form: str, shift: int) -> tuple:
        return struct.unpack_from(form, self.raw, self._within(self.at + shift, struct.calcsize(form)))

    def number(self, shift: int = 4) -> int:
        return self.read(">I", shift)[0]

    def rows(self, shift: int, width: int, count: int, kind: str = ">u4") -> np.ndarray:
        at = self._within(self.at + shift, count * width * int(kind[-1]))
        return np.frombuffer(self.raw, kind, count * width, at).reshape(count, width).astype(np.int64)


def _runs_of(t: dict, raw: bytes) -> None:
    """Offsets, times and key samples of a track by its sample tables."""
    sizes, chunks, runs = (t.setdefault(k, np.zeros(s, np.int64)) for k, s in (("sizes", 0), ("chunks", 0), ("runs", (0, 3))))
    firsts = runs[:, 0]
    if len(runs) and (firsts[0] != 1 or (np.diff(firsts) <= 0).any() or firsts[-1] > len(chunks)):
        raise Malformed("stsc names chunks out of order")
    per = np.repeat(runs[:, 1], np.diff(np.r_[firsts, len(chunks) + 1])) if len(runs) else np.zeros(0, np.int64)
    before = np.cumsum(per) - per
    if len(sizes) and (not len(per) or before[-1] >= len(sizes) or before[-1] + per[-1] < len(sizes)):
        raise Malformed("stsc holds another number of samples than stsz")
    per = np.minimum(per, len(sizes) - before) if len(sizes) else per[:0]
    where = np.repeat(np.arange(len(per)), per)
    ahead = np.cumsum(sizes) - sizes
    t["offsets"] = chunks[where] + ahead - ahead[before[where]] if len(sizes) else np.zeros(0, np.int64)
    deltas = t.setdefault("deltas", np.zeros((0, 2), np.int64))
    if deltas[:, 0].sum() > len(sizes):
        raise Malformed("stts holds more samples than stsz")
    t["times"] = np.cumsum(np.repeat(deltas[:, 1], deltas[:, 0]))
    keys = t["keys"]
    if keys is None:
        t["keys"] = np.arange(1, len(sizes) + 1)
    elif len(keys) and (keys.min() < 1 or keys.max() > len(sizes)):
        raise Malformed("stss names samples that aren't there")


def _fragment(body: _Body, t: dict, base: int, default: dict, at: int) -> int:
    """Adds the samples of a ``trun`` box to a track; returns where its data end."""
    flags, count = body.number(0) & 0xFFFFFF, body.number()
    shift, first_flags = 8, None
    if flags & 1:
        at = base + body.read(">i", shift)[0]
        shift += 4
    if flags & 4:
        first_flags = body.number(shift)
        shift += 4
    fields = [k for bit, k in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
    if not fields and count * max(1, default["size"]) > len(body.raw):
        raise Malformed("trun holds more samples than the file has bytes")
    table = body.rows(shift, len(fields), count) if fields else np.zeros((count, 0), np.int64)
    column = {k: table[:, fields.index(k)] if k in fields else np.full(count, default.get(k, 0), np.int64) for k in ("duration", "size", "flags")}
    if first_flags is not None and count:
        column["flags"][0] = first_flags
    ends, seen = at + np.cumsum(column["size"]), len(t["sizes"])
    start = int(t["times"][-1]) if len(t["times"]) else 0
    t["offsets"], t["sizes"] = np.r_[t["offsets"], ends - column["size"]], np.r_[t["sizes"], column["size"]]
    t["times"] = np.r_[t["times"], start + np.cumsum(column["duration"])]
    t["keys"] = np.r_[t["keys"], seen + 1 + np.flatnonzero((column["flags"] & 0x10000) == 0)]
    return int(ends[-1]) if count else at


def read_tracks(raw: bytes) -> list[dict]:
    """Of each track: codec, handler, timescale, duration, sample offsets, sizes, times, key samples.

    Read from the tables alone, of the movie and of its fragments; payload bytes aren't touched. A file
    without tracks gives none. Every count is held against its box, and every sample against the file:
    ``Malformed`` is raised rather than memory taken for what isn't there.
    """
    tracks: list[dict] = []
    defaults: dict[int, dict] = {}
    runs: list[tuple] = []
    moof, held = 0, {}
    for path, at, end, first in walk(raw):
        kind, body = path[-1], _Body(raw, at, end, path[-1])
        if kind == b"trak":
            tracks.append({"codec": "", "handler": "", "timescale": 0, "duration": 0, "keys": None, "id": len(tracks) + 1})
        elif kind == b"trex":
            defaults[body.number()] = dict(zip(("duration", "size", "flags"), body.read(">III", 12)))
        elif kind == b"moof":
            moof = first
        elif kind == b"tfhd":
            flags, shift = body.number(0) & 0xFFFFFF, 8
            held = {"id": body.number(), "base": moof, **{"duration": 0, "size": 0, "flags": 0}, **defaults.get(body.number(), {})}
            for bit, name, form in ((1, "base", ">Q"), (2, "description", ">I"), (8, "duration", ">I"), (16, "size", ">I"), (32, "flags", ">I")):
                if flags & bit:
                    held[name] = body.read(form, shift)[0]
                    shift += struct.calcsize(form)
        elif kind == b"trun" and held:
            runs.append((body, held))
        if b"trak" not in path or not tracks:
            continue
        t, n = tracks[-1], body.number
        if kind == b"tkhd":
            t["id"] = n(20 if body.read(">B", 0)[0] == 1 else 12)
        elif kind == b"mdhd":
            t["timescale"], t["duration"] = body.read(">IQ", 20) if body.read(">B", 0)[0] == 1 else body.read(">II", 12)
        elif kind == b"hdlr":
            t["handler"] = body.read(">4s", 8)[0].decode("latin-1")
        elif kind == b"stsd" and n():
            t["codec"] = body.read(">4s", 12)[0].decode("latin-1")
            t["width"], t["height"] = body.read(">HH", 40)
        elif kind == b"stts":
            t["deltas"] = body.rows(8, 2, n())
        elif kind == b"stss":
            t["keys"] = body.rows(8, 1, n())[:, 0]
        elif kind == b"stsc":
            t["runs"] = body.rows(8, 3, n())
        elif kind == b"stsz":
            if n() and n(8) > len(raw) // n():
                raise Malformed("stsz holds more bytes than the file")
            t["sizes"] = np.full(n(8), n(), np.int64) if n() else body.rows(12, 1, n(8))[:, 0]
        elif kind in (b"stco", b"co64"):
            t["chunks"] = body.rows(8, 1, n(), ">u8" if kind == b"co64" else ">u4")[:, 0]
    for t in tracks:
        _runs_of(t, raw)
    known, ends = {t["id"]: t for t in tracks}, {}
    for body, default in runs:
        if default["id"] in known:
            at = ends.get(id(default), default["base"])
            ends[id(default)] = _fragment(body, known[default["id"]], default["base"], default, at)
    for t in tracks:
        if runs and not t["duration"] and len(t["times"]):
            t["duration"] = int(t["times"][-1])
        if len(t["offsets"]) and (t["offsets"].min() < 0 or (t["offsets"] + t["sizes"]).max() > len(raw)):
            raise Malformed("samples lie outside the file")
    return tracks


def read_payload(raw: bytes, track: dict) -> bytes:
    """The track's samples in order, by its tables; samples that follow each other are read at once."""
    offsets, ends = track["offsets"], track["offsets"] + track["sizes"]
    cuts = np.flatnonzero(np.r_[True, offsets[1:] != ends[:-1]]) if len(offsets) else np.zeros(0, np.int64)
    stops = np.r_[cuts[1:], len(offsets)] - 1 if len(cuts) else cuts
    return b"".join(raw[offsets[a] : ends[b]] for a, b in zip(cuts, stops))


def key_ranges(track: dict) -> list[tuple[int, int]]:
    """First byte and end of each key sample."""
    at = track["keys"] - 1
    return list(zip(track["offsets"][at].tolist(), (track["offsets"][at] + track["sizes"][at]).tolist()))


FILE = "track int, handler string, codec string, duration_s double, n_samples long, key_ranges array<struct<start:long,end:long>>"


def describe_file(raw: bytes | None) -> tuple[list[tuple], str | None]:
    """``FILE`` of each track of a media file, and what is wrong with it, if anything; null and empty files have no tracks."""
    try:
        tracks = read_tracks(raw or b"")
    except Malformed as e:
        return [], str(e)
    return [(i, t["handler"], t["codec"].strip(), t["duration"] / t["timescale"] if t["timescale"] else 0.0, len(t["sizes"]), key_ranges(t)) for i, t in enumerate(tracks)], None


def container_columns(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` without ``content``, with ``tracks`` (array of ``FILE``) and ``error``; payloads aren't decoded.

    A file that can't be read has no tracks and says why in ``error``. Columns with these names are replaced.
    """
    track = T.StructType.fromDDL(FILE)
    kind = T.StructType([T.StructField("tracks", T.ArrayType(track)), T.StructField("error", T.StringType())])
    names = track.names

    def described(raw: pd.Series) -> pd.DataFrame:
        out = []
        for x in raw:
            tracks, error = describe_file(x)
            out.append(([dict(zip(names, (*t[:-1], [{"start": a, "end": b} for a, b in t[-1]]))) for t in tracks], error))
        return pd.DataFrame(out, columns=["tracks", "error"])

    own = [c for c in files.columns if c not in (content, "tracks", "error")]
    return files.select(*own, F.pandas_udf(described, kind)(content).alias("_said")).select(*own, "_said.tracks", "_said.error")


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, n_keyframes long, key_ranges array<struct<start:long,end:long>>"


def describe(text: str | None) -> tuple:
    """All columns of ``MEDIA`` but the first, for one text, by way of the stored file."""
    raw = (text or "").encode()
    stored = write_container(pad(raw))
    (track,) = read_tracks(stored)
    back = read_payload(stored, track)
    ranges = key_ranges(track)
    seconds = track["duration"] / track["timescale"]
    digest = hashlib.sha256(np.array(ranges, "<i8").tobytes()).hexdigest()[:16]
    feature = f"{track['codec'].strip()};{track['width']}x{track['height']};samples={len(track['sizes'])};seconds={seconds:g};keys={len(ranges)};ranges={digest}"
    return (
        len(raw), len(back), hashlib.sha256(back).hexdigest(), crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature,
        track["codec"].strip(), seconds, len(ranges), [{"start": a, "end": b} for a, b in ranges],
    )


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per document of ``docs(doc_id, text)``, as in ``MEDIA``.

    The text's UTF-8 bytes, padded to whole frames, are written into an ISO media file as uncompressed
    samples and read back by the file's own sample tables. A null or empty text is one frame of padding.
    Repeated rows and null ids are rows like any other; one file is in memory at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in MEDIA.split(", ")]
        for batch in batches:
            out = pd.DataFrame([describe(x if isinstance(x, str) else None) for x in batch["text"].array], columns=names[1:])
            out.insert(0, "doc_id", pd.array([None if x is None or x != x else int(x) for x in batch["doc_id"].array], "Int64"))
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, MEDIA)

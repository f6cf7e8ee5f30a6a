"""Sinks: the dataset tree with sidecars, and images as PNG."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = ["board", "qualification", "subject", "syllabus_code", "category"]


def write_tree(resources: DataFrame, target: str) -> None:
    """Resources as a partitioned table; readers that filter on the parts skip the other folders."""
    resources.write.mode("append").partitionBy(*[p for p in PARTS if p in resources.columns]).parquet(target)


def sidecars(resources: DataFrame) -> DataFrame:
    """``path, metadata``: the JSON that lies beside each stored file, named after it."""
    rest = [c for c in resources.columns if c not in ("path", "content")]
    return resources.select(F.concat("path", F.lit(".metadata.json")).alias("path"), F.to_json(F.struct(*rest)).alias("metadata"))


def png(width: int, height: int, data: bytes) -> bytes | None:
    """A PNG of 8-bit RGB or RGBA pixels; null for data of another kind or size."""
    depth = len(data) // max(1, width * height)
    if depth not in (3, 4) or len(data) != width * height * depth or not data:
        return None
    step = width * depth
    rows = b"".join(b"\0" + data[i : i + step] for i in range(0, len(data), step))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if depth == 3 else 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def image_files(images: DataFrame) -> DataFrame:
    """``path, page, n, width, height, pixels`` -> ``image_path, png``; images that can't be written are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"image_path": b["image_path"], "png": [png(w, h, p) if p is not None else None for w, h, p in zip(b["width"], b["height"], b["pixels"])]})

    stem = F.regexp_replace("path", r"\.[A-Za-z]+\z", "")
    named = images.select(F.concat(stem, F.lit(".images/page-"), "page", F.lit("-image-"), "n", F.lit(".png")).alias("image_path"), "width", "height", "pixels")
    return named.mapInPandas(run, "image_path string, png binary").where("png is not null")

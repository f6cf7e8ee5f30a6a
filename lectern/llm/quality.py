"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import Stash
from lectern.llm.langid import is_held_out

#: Tasks whose partial sums of the normal equations reach the driver, one for each fold.
PARTS = 4
#: Folds of the sample: each is calibrated by weights fitted on the others.
FOLDS = 2


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; zeros for a null or empty one."""
    if not text:
        return [0.0] * 17
    raw = text.encode()
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    upper, lower, digits = by[65:91].sum(), by[97:123].sum(), by[48:58].sum()
    letters = upper + lower + by[128:].sum()
    space = by[32] + by[9:14].sum()
    common = by[[46, 44, 39, 45, 34, 58, 59, 63, 40, 41]].sum()  # . , ' - " : ; ? ( )
    symbols = max(0, n - letters - digits - space - common)
    words = text.split()
    w = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    counts = Counter(words)
    packed = zlib.compressobj(1)
    size = sum(len(packed.compress(raw[i : i + (1 << 20)])) for i in range(0, n, 1 << 20)) + len(packed.flush())
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return [
        np.log1p(n),
        np.log1p(w),
        float(lengths.mean()) if len(words) else 0.0,
        float(np.minimum(lengths, 40).std()) if len(words) else 0.0,
        upper / max(1, letters),
        digits / n,
        symbols / n,
        np.log1p(1000 * symbols / n),
        by[33] / n,
        common / n,
        space / n,
        len(counts) / w,
        len(counts) / w**0.75,
        max(counts.values(), default=0) / w,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        size / (n + 20),
    ]


class Model:
    """Standardised statistics, random Fourier features, ridge weights and a calibration curve."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.omega = rng.normal(0, 1 / width, (len(mean), features))
        self.phase = rng.uniform(0, 2 * np.pi, features)
        self.weights, self.knots, self.values = np.zeros(features + 1), np.array([0.0]), np.array([0.5])

    def expand(self, x: np.ndarray) -> np.ndarray:
        """cos(x W + b), whose inner products approximate a Gaussian kernel, and a constant."""
        z = np.cos(np.clip((x - self.mean) / self.std, -8, 8) @ self.omega + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the least-squares non-decreasing curve, by pooling adjacent violators."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of y, sum of raw, count
    for r, v in zip(raw[order], y[order]):
        blocks.append([v, r, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[1] / b[2] for b in blocks]), np.array([b[0] / b[2] for b in blocks])


def _stats_of(text: str) -> F.Column:
    return F.pandas_udf(lambda s: pd.Series([statistics(x if isinstance(x, str) else None) for x in s.array]), T.ArrayType(T.DoubleType()))(text)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8192, features: int = 256, width: float = 4.0, ridge: float = 1e-2, seed: int = 11) -> Model | None:
    """A model from at most ``sample_rows`` labelled documents, those of least doc_id hash.

    Labels with a null id or quality don't teach; of labels that repeat an id the greatest counts. Each of
    ``PARTS`` tasks at most sums its share of the normal equations of each fold, and the driver adds these up
    and solves them: for all folds, and without each fold, which gives that fold's raw scores. The curve of
    calibration is fitted to these, scores of rows that their weights haven't seen. None without both labels.
    The sample's ids are broadcast: ``sample_rows`` bounds them.
    """
    stash = Stash(docs.sparkSession, "quality")
    known = labels.where("doc_id is not null and quality is not null")
    picked = known.groupBy("doc_id").agg(F.max("quality").cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = stash.put(docs.select("doc_id", "text").join(F.broadcast(stash.put(picked)), "doc_id").select("doc_id", "y", _stats_of("text").alias("x")))
    n = len(statistics(None))
    sums = rows.agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"), *[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(n) for k, f in (("m", F.mean), ("s", F.stddev_pop))]).first()
    if not sums["n"] or sums["lo"] == sums["hi"]:
        return None
    model = Model(np.array([sums[f"m{i}"] for i in range(n)]), np.array([sums[f"s{i}"] for i in range(n)]), features, width, seed)

    size = features + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
        for batch in batches:
            z, y, fold = model.expand(np.stack(batch["x"].to_numpy())), batch["y"].to_numpy(float), batch["fold"].to_numpy()
            for f in range(FOLDS):
                own = z[fold == f]
                a[f] += own.T @ own
                b[f] += own.T @ y[fold == f]
        yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()]})

    def weights(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        penalty = np.eye(size) * ridge * a[-1, -1] / features
        penalty[-1, -1] = 0
        return np.linalg.lstsq(a + penalty, b, rcond=None)[0]

    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))
    parts = rows.coalesce(PARTS).mapInPandas(partial, "a binary, b binary").collect()  # about a MB each
    a = sum(np.frombuffer(p["a"]) for p in parts).reshape(FOLDS, size, size)
    b = sum(np.frombuffer(p["b"]) for p in parts).reshape(FOLDS, size)
    sample = rows.select("doc_id", "y", "x", "fold").toPandas().sort_values("doc_id", kind="stable")  # sample_rows rows of 17 numbers
    z, fold, y = model.expand(np.stack(sample["x"].to_numpy())), sample["fold"].to_numpy(), sample["y"].to_numpy(float)
    raw = np.zeros(len(z))
    for f in range(FOLDS):
        raw[fold == f] = z[fold == f] @ weights(a.sum(axis=0) - a[f], b.sum(axis=0) - b[f])
    model.weights = weights(a.sum(axis=0), b.sum(axis=0))
    model.knots, model.values = isotonic(raw, y)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = 8192) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Only the text's statistics enter a score. Null and empty texts are scored as texts of zero length;
    without labels to learn from every score is 0.5. Repeated rows and null ids are rows like any other.
    """
    held = is_held_out(4, 2)
    model = fit(docs, labels.where(~held), sample_rows)

    def score(text: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series([0.5] * len(text))
        return pd.Series(model.score(np.array([statistics(x if isinstance(x, str) else None) for x in text.array]).reshape(len(text), -1)))

    scored = docs.select("doc_id", held.alias("held_out"), F.pandas_udf(score, T.DoubleType())("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


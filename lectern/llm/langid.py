"""Language ID by error-correcting output codes over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hashed n-gram features: byte pairs and byte triples share one table of this size.
WIDTH = 1 << 13
UNDETERMINED = "und"
#: Bytes of text whose features are worked out at once.
CHUNK = 1 << 20

# Bytes to symbols: ASCII letters lower-cased, bytes of non-ASCII characters as they are, anything else one gap.
_SYMBOL = np.full(256, 32, np.uint32)
_SYMBOL[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_SYMBOL[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_SYMBOL[128:] = np.arange(128, 256)


def features(text: str) -> np.ndarray:
    """Counts of the text's hashed byte pairs and triples over the whole text, in blocks."""
    raw, counts = np.frombuffer((" " + text.lower() + "  ").encode(), np.uint8), np.zeros(WIDTH, np.int64)
    for at in range(0, len(raw) - 2, CHUNK):
        s = _SYMBOL[raw[at : at + CHUNK + 2]]
        a, b, c = s[:-2], s[1:-1], s[2:]
        pairs = (a * np.uint32(2654435761) ^ b * np.uint32(40503)) >> np.uint32(7)
        triples = (a * np.uint32(2246822519) ^ b * np.uint32(3266489917) ^ c * np.uint32(668265263)) >> np.uint32(9)
        letters = (b != 32) | (a != 32)
        counts += np.bincount(pairs[letters] % WIDTH, minlength=WIDTH)
        counts += np.bincount(triples[letters] % WIDTH, minlength=WIDTH)
    return counts


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def codewords(n: int, seed: int = 7, extra: int = 24) -> np.ndarray:
    """An n x bits code of -1 and 1 whose rows lie far apart, each bit splitting the languages.

    Up to 5 languages: every split (2**(n-1) - 1 bits). More: the best of 200 random codes by least
    distance between rows.
    """
    if n == 1:
        return np.ones((1, 1), np.int8)
    if n <= 5:
        bits = [[1] + [1 if (k >> i) & 1 else -1 for i in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(bits, np.int8).T
    width, rng, best, apart = extra + 8 * int(np.ceil(np.log2(n))), np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        least = min(int((code[i] != code[j]).sum()) for i, j in combinations(range(n), 2))
        if least > apart:
            best, apart = code, least
    return best


class Model:
    """Binary n-gram classifiers, one for each bit of the code.

    Each is a log-odds classifier: a feature's weight is the log ratio of its smoothed share among the
    languages with the bit set and among the others. A text's margin for a bit is the mean weight of its
    n-grams. Decoding sums the logistic loss of each codeword's bits, weighted by how far each bit's
    classifier parted the training languages, and takes the codeword of least loss.
    """

    def __init__(self, langs: list[str], counts: np.ndarray, sharpness: float = 12.0):
        self.langs, self.code, self.sharpness = langs, codewords(len(langs)), sharpness
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        self.weights = np.zeros((WIDTH, self.code.shape[1]))
        self.loss_weight = np.ones(self.code.shape[1])
        for b in range(self.code.shape[1]):
            yes, no = self.code[:, b] > 0, self.code[:, b] < 0
            if yes.any() and no.any():
                self.weights[:, b] = np.log(share[yes].mean(axis=0)) - np.log(share[no].mean(axis=0))
                margins = share @ self.weights[:, b] * self.code[:, b]
                self.loss_weight[b] = max(margins.min(), 1e-3)
        self.loss_weight /= self.loss_weight.sum()

    def decode(self, counts: np.ndarray) -> tuple[int, float, float]:
        """The language's place, a score from 0 to 1, and the gap in loss to the second best."""
        margin = counts @ self.weights / max(1, counts.sum()) * self.sharpness
        loss = (np.logaddexp(0, -self.code * margin) * self.loss_weight).sum(axis=1)
        odds = np.exp(-(loss - loss.min()) * self.sharpness)
        order = np.argsort(loss, kind="stable")
        gap = float(loss[order[1]] - loss[order[0]]) if len(loss) > 1 else float("inf")
        return int(order[0]), float(odds[order[0]] / odds.sum()), gap


def fit(docs: DataFrame, held_out: F.Column, per_language: int = 500, languages: int = 256) -> Model | None:
    """A model from about ``per_language`` labelled documents of each of the ``languages`` most frequent languages, whole texts.

    ``per_language`` bounds the sample: of a language with n documents those are taken whose doc_id hash
    lies in its first ``per_language / n``, so the sample doesn't depend on the order of rows. Rows with a
    null text, language or doc_id don't teach. None if there is nothing to learn from. The driver gets
    one number for each language and feature, however large the input.
    """
    able = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counted = able.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    sizes = {r["lang"]: r["n"] for r in counted.collect()}
    if not sizes:
        return None
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    share = F.coalesce(F.try_element_at(shares, "lang"), F.lit(0.0))
    picked = able.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * F.lit(1 << 30)).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                f = features(text).astype(float)
                total[lang] = total.get(lang, 0.0) + f / max(1.0, np.sqrt(f.sum()))
        if total:
            yield pd.DataFrame({"lang": list(total), "counts": [x.tolist() for x in total.values()]}, columns=["lang", "counts"])

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("counts", T.ArrayType(T.DoubleType()))])
    parts = picked.mapInPandas(count, schema).select("lang", F.posexplode_outer("counts").alias("pos", "c"))
    merged = parts.where("c > 0").groupBy("lang", "pos").agg(F.sum("c").alias("c")).toArrow()  # languages times WIDTH numbers
    langs = sorted(sizes)
    counts = np.zeros((len(langs), WIDTH))
    place = {lang: i for i, lang in enumerate(langs)}
    at = [place[x] for x in merged.column("lang").to_pylist()], merged.column("pos").to_numpy()
    counts[at] = merged.column("c").to_numpy().round(6)  # sums in any order agree to this
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model | None, ambiguous_gap: float = 0.02) -> DataFrame:
    """Adds ``lang_pred, score, ambiguous`` to ``docs``; only ``text`` is read.

    ``und`` with score 0 where the text is null, has no letter, or there is no model. ``ambiguous`` flags
    a nearest codeword that is less than ``ambiguous_gap`` of loss ahead of the second. Rows and other
    columns stay as they are.
    """

    def predict(text: pd.Series) -> pd.DataFrame:
        out = []
        for x in text:
            if model is None or not has_letter(x):
                out.append((UNDETERMINED, 0.0, True))
            else:
                i, score, gap = model.decode(features(x))
                out.append((model.langs[i], score, gap < ambiguous_gap))
        return pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])

    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    said = F.pandas_udf(predict, kind).asNondeterministic()  # or a filter on its result runs it a second time
    return docs.select(*own, said("text").alias("_said")).select(*own, "_said.lang_pred", "_said.score", "_said.ambiguous")


def is_held_out(mod: int = 3, rest: int = 1) -> F.Column:
    """Whether crc32 of doc_id as text leaves ``rest``; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def crc_of(doc_id: int) -> int:
    return crc32(str(doc_id).encode())


def language_id(docs: DataFrame, per_language: int = 500) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, ambiguous``; see fit and identify."""
    model = fit(docs, is_held_out(), per_language)
    return identify(docs.select("doc_id", "text", is_held_out().alias("held_out")), model).drop("text")


def keep_identified(docs: DataFrame, per_language: int = 500, min_score: float = 0.0) -> DataFrame:
    """Documents whose language is told, with what was told as their ``lang``, whether or not they had one.

    Those without one (``und``), or scored below ``min_score``, go. Other columns stay as they are.
    """
    told = identify(docs, fit(docs, is_held_out(), per_language))
    kept = told.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)

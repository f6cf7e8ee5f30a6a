"""The two trained operators against models worked out in one place, without Spark's partial sums."""

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import langid, quality
from lectern.llm.common import table


def plain_features(text):
    raw = (" " + text.lower() + "  ").encode()
    s = [c if 97 <= c <= 122 or c >= 128 else 32 for c in raw]
    counts = [0] * langid.WIDTH
    for a, b, c in zip(s, s[1:], s[2:]):
        if (a, b) != (32, 32):
            counts[(((a * 2654435761 & 0xFFFFFFFF) ^ (b * 40503 & 0xFFFFFFFF)) >> 7) % langid.WIDTH] += 1
            counts[(((a * 2246822519 & 0xFFFFFFFF) ^ (b * 3266489917 & 0xFFFFFFFF) ^ (c * 668265263 & 0xFFFFFFFF)) >> 9) % langid.WIDTH] += 1
    return counts


def test_features_and_decoding_against_brute_force(monkeypatch):
    texts = ["The cat", "Éa  12 ß!\nx", "", "日本", "a" * 50]
    for size in (1 << 20, 7):
        monkeypatch.setattr(langid, "CHUNK", size)
        for t in texts:
            assert langid.features(t).tolist() == plain_features(t)
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"], rng.integers(0, 50, (3, langid.WIDTH)).astype(float))
    for t in texts:
        f = plain_features(t)
        margin = [sum(x * w for x, w in zip(f, model.weights[:, b])) / max(1, sum(f)) * model.sharpness for b in range(model.code.shape[1])]
        loss = [sum(w * np.log1p(np.exp(-c * m)) for w, c, m in zip(model.loss_weight, row, margin)) for row in model.code]
        place, score, gap = model.decode(np.array(f))
        assert place == int(np.argmin(loss)) and np.isclose(gap, sorted(loss)[1] - sorted(loss)[0], atol=1e-9) and 1 / 3 <= score <= 1


def test_language_id_against_a_model_of_one_place(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    rows = df.select("doc_id", "text", "lang").collect()
    counts = {}
    for r in rows:
        if r["text"] is not None and r["lang"] is not None and langid.crc_of(r["doc_id"]) % 3 != 1:
            f = np.array(plain_features(r["text"]), float)
            counts[r["lang"]] = counts.get(r["lang"], 0.0) + f / max(1.0, np.sqrt(f.sum()))
    langs = sorted(counts)
    model = langid.Model(langs, np.array([counts[x] for x in langs]).round(6))
    got = {r["doc_id"]: r for r in langid.language_id(df).collect()}
    for r in rows:
        i, score, gap = model.decode(np.array(plain_features(r["text"])))
        assert got[r["doc_id"]]["lang_pred"] == langs[i] and np.isclose(got[r["doc_id"]]["score"], score, atol=1e-4) and got[r["doc_id"]]["ambiguous"] == (gap < 0.02)


def test_only_the_most_frequent_languages_are_learned(spark):
    rows = [(i, "abc def", lang) for i, lang in enumerate(["x"] * 5 + ["y"] * 4 + ["z"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(df, F.lit(False), languages=2).langs == ["x", "y"]


def test_quality_against_a_model_of_one_place(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.where(~quality.is_held_out(4, 2)).where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    rows = docs.join(known, "doc_id").withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(quality.FOLDS))).select("doc_id", "text", "y", "fold").collect()
    rows.sort(key=lambda r: r["doc_id"])
    x, y, fold = np.array([quality.statistics(r["text"]) for r in rows]), np.array([r["y"] for r in rows], float), np.array([r["fold"] for r in rows])
    model = quality.Model(x.mean(axis=0), x.std(axis=0), 256, 4.0, 11)
    z = model.expand(x)

    def solved(mine):
        a, b = z[mine].T @ z[mine], z[mine].T @ y[mine]
        penalty = np.eye(257) * 1e-2 * mine.sum() / 256
        penalty[-1, -1] = 0
        return np.linalg.solve(a + penalty, b)

    raw = np.zeros(len(y))
    for f in range(quality.FOLDS):
        raw[fold == f] = z[fold == f] @ solved(fold != f)
    model.weights = solved(np.ones(len(y), bool))
    model.knots, model.values = quality.isotonic(raw, y)
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs.withColumn("score", F.lit(1)).withColumn("x", F.lit(1)).withColumn("y", F.lit(1)), labels).collect()}
    want = model.score(np.array([quality.statistics(r["text"]) for r in docs.orderBy("doc_id").collect()]))
    assert np.allclose([got[i] for i in sorted(got)], want, atol=1e-4)

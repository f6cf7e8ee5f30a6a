"""The pipeline's stages, each on what the one before kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import langid, packing
from lectern.llm.common import Stash, table
from lectern.llm.queries import vocabulary


def test_stages(spark, sf_dir):
    stash, docs = Stash(spark, "t"), table(spark, sf_dir, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stash.put(stage(spark, docs, sf_dir))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns and docs.count() <= before.count()
    assert list(seen) == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]
    before, after = seen["line_dedup"]
    assert before.count() == after.count() and after.where("n_chars <> char_length(text)").count() == 0
    before, after = seen["packing"]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}
    assert corpus_pipeline.run(spark, sf_dir).count() == after.count()


def test_identified_language_decides_sequences(spark, sf_dir):
    """Documents without a given language, or with a wrong one, are packed with those of the language that their text tells."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    wrong = sorted(i for i in truth if langid.crc_of(i) % 3 == 1)[::3]
    given = F.when(F.col("doc_id").isin(wrong), F.when(F.col("doc_id") % 2 == 0, F.lit("xx"))).otherwise(F.col("lang"))
    docs = docs.withColumn("lang", given).coalesce(1)
    told = {r["doc_id"]: r["lang_pred"] for r in langid.language_id(docs).collect()}
    assert len(wrong) > 10 and sum(told[i] == truth[i] for i in wrong) > 0.9 * len(wrong)
    kept = corpus_pipeline.language(spark, docs, sf_dir)
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1  # predicts once
    kept = Stash(spark, "t").put(kept)
    assert {r["doc_id"]: r["lang"] for r in kept.collect()} == told
    pieces = corpus_pipeline.packing(spark, kept, sf_dir).collect()
    assert {r["doc_id"] for r in pieces} == set(truth) and all(r["lang"] == told[r["doc_id"]] for r in pieces)
    langs = {}
    for r in pieces:
        langs.setdefault(r["sequence_id"], set()).add(r["lang"])
    assert all(len(x) == 1 for x in langs.values()) and len(set.union(*langs.values())) > 1


def test_packing_by_a_column(spark):
    rows = [(i, "a b c", (None, "x", "y")[i % 3]) for i in range(30)] + [(90, "a b " * 20, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string").coalesce(1)
    got = packing.pack(df, vocabulary(), size=8, round_rows=7, by="kind").collect()
    plain = packing.pack(df, vocabulary(), size=8, round_rows=7).collect()
    cut = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    assert cut(got) == cut(plain) and "kind" not in plain[0]
    for s in {r["sequence_id"] for r in got}:
        own = sorted((r["offset"], r["length"], r["kind"]) for r in got if r["sequence_id"] == s)
        assert len({x[2] for x in own}) == 1 and own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and sum(x[1] for x in own) <= 8
    assert {r["doc_id"]: r["kind"] for r in got} == {i: k for i, _, k in rows}

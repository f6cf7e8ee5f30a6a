"""SimHash groups, repeated passages and line templates, against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import components, line_templates, simhash, substring
from lectern.llm.common import Stash, table

WORDS = [a + b for a in ("th", "re", "on", "er", "in", "st", "ed") for b in ("and", "ing", "or", "a", "ly", "ou", "es")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "an", "en"]) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def wrap(texts):
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(rows):
    prints = {i: plain_fingerprint(t) for i, t in rows}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (f"{prints[i]:016x}", root(i)) for i in ids}


def test_simhash_against_brute_force(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    want = plain_groups([(r["doc_id"], r["text"]) for r in df.collect()])
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(df).collect()} == want


def test_simhash_edges(spark):
    rng = random.Random(1)
    base = prose(rng, 300)
    texts = [None, "", " \n", "É Éa", "é Éa", "one", "one two", base, base.replace(" ", "\x0b"), base + " x", "A" * 200_000 + " b c d"]
    df = docs_of(spark, wrap(texts)).union(docs_of(spark, [(7, base, "en", "s", 1), (None, base, "en", "s", 1)]))
    got = simhash.simhash_groups(df.withColumn("fingerprint", F.lit(1)).withColumn("component_id", F.lit(1))).collect()
    want = plain_groups(list(enumerate(texts)))
    assert len(got) == 13
    for r in got:
        assert (r["fingerprint"], r["component_id"]) == want[7 if r["doc_id"] is None else r["doc_id"]]
    assert simhash.simhash_groups(df.where("false")).count() == 0
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    firsts = {c for _, c in want.values()}
    assert {r["doc_id"] for r in kept.collect()} == firsts | {None}


@pytest.mark.parametrize("crowd", [1024, 3])
def test_pairs_within_three_bits(spark, crowd):
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = [s ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for s in seeds for k in (1, 2, 3, 4)]
    all_ = np.unique(np.r_[seeds, flips]).astype(np.uint64)
    signed = all_.view(np.int64)
    got = {(r["a"], r["b"]) for r in simhash.similar_fingerprints(spark.createDataFrame([(int(x),) for x in signed], "fp long"), Stash(spark, "t"), crowd=crowd).collect()}
    want = {tuple(sorted((int(signed[i]), int(signed[j])))) for i in range(len(all_)) for j in range(i) if int(all_[i] ^ all_[j]).bit_count() <= 3}
    assert got == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(1000, x) for x in range(1001, 1200)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), Stash(spark, "t")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {n: find(n) for n in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), Stash(spark, "t")).count() == 0


def test_passages_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(4)
    texts = ["\n".join(prose(rng, rng.randrange(30, 120)) for _ in range(4)) for _ in range(60)]
    inline, paragraph, near = prose(rng, 90), prose(rng, 60), prose(rng, 70)
    changed = near.split()
    changed[-1] = "otherword"
    for i in (3, 17):
        cut = texts[i].index(" ", 40)
        texts[i] = texts[i][:cut] + " " + inline + texts[i][cut:]
    for i in (5, 21, 40):
        texts[i] += "\n" + paragraph
    texts[8] += "\n" + near
    texts[30] = " ".join(changed) + "\n" + texts[30]
    for i in range(50, 60):
        texts[i] += "\nA common line of nine words is no passage."
    df = docs_of(spark, wrap(texts))
    got = substring.repeated_passages(df).collect()
    assert {r["doc_id"] for r in got} == {3, 17, 5, 21, 40, 8, 30}
    for group in ((3, 17), (5, 21, 40), (8, 30)):
        assert {r["first_doc_id"] for r in got if r["doc_id"] in group} == {group[0]}
    assert {r["doc_id"] for r in got if not r["removed"]} == {3, 5, 8}
    runs = {i: {texts[i].encode()[r["first_byte"] : r["end_byte"]].decode() for r in got if r["doc_id"] == i and not r["level"]} for i in (3, 17, 5, 21, 40)}
    assert runs[3] == runs[17] == {inline} and runs[5] == runs[21] == runs[40] == {paragraph}
    left = {r["doc_id"]: r["text"] for r in substring.cut_passages(df, substring.repeated_passages(df)).collect()}
    assert left[3] == texts[3] and left[0] == texts[0] and len(left[17]) < len(texts[17]) - 300 and len(left) == 60


def test_words_of_blocks_agree_with_those_of_the_whole(monkeypatch):
    rng = random.Random(8)
    text = ("\n".join(prose(rng, rng.randrange(0, 90)) for _ in range(20)) + "É" * 200 + "\n\n x").encode()
    whole = substring.Words(text)
    assert [text[a:b].lower() for a, b in zip(whole.start, whole.end)] == substring.words_in(text)
    assert whole.line.tolist() == [text[:a].count(b"\n") for a in whole.start]
    for size in (64, 100, 1000):
        monkeypatch.setattr(substring, "RUN", size)
        monkeypatch.setattr(substring.Words, "_tables", None)
        parts = substring.Words(text)
        for k in ("start", "end", "hash", "line"):
            assert np.array_equal(getattr(whole, k), getattr(parts, k))
    monkeypatch.setattr(substring.Words, "_tables", None)


def test_seeds_do_not_depend_on_the_texts_beside():
    rng = random.Random(10)
    texts = [prose(rng, rng.randrange(0, 90)).encode() for _ in range(60)] + [b"", b"one", b"a b c d e " * 30]
    ((_, whole),) = substring.Block.each(texts)
    at = substring.seeds(whole)
    near = substring.around(whole, at, 15)
    for i, t in enumerate(texts):
        one = substring.Block([t])
        own = substring.seeds(one)
        s = substring.shingle_hashes(one.words.hash) >> np.uint64(28)
        assert own.tolist() == sorted({j + int(np.argmin(s[j : j + 16])) for j in range(len(s) - 15)})
        mine = whole.text[at] == i
        assert (at[mine] - whole.first[i]).tolist() == own.tolist() and np.array_equal(near[mine], substring.around(one, own, 15))


def runs_by_brute_force(texts, span):
    """Words of each text in a run of ``span`` words that a text of another document has."""
    words, where = {i: substring.words_in(t.encode()) for i, t in texts.items()}, {}
    for i, w in words.items():
        for k in range(len(w) - span + 1):
            where.setdefault(tuple(w[k : k + span]), set()).add(i)
    return {i: {x for k in range(len(w) - span + 1) if len(where[tuple(w[k : k + span])]) > 1 for x in range(k, k + span)} for i, w in words.items()}


@pytest.mark.parametrize("crowd", [20_000, 5])
@pytest.mark.parametrize("vocab", [8, 5000])
def test_shared_runs_against_brute_force(spark, vocab, crowd):
    """With few words seeds collide by chance all the time, so that leaders are often unlike; a small crowd deals most of them out."""
    rng = random.Random(vocab)
    line = lambda n: " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))
    texts = {i: line(rng.randrange(1, 90)) for i in range(120)}
    shared = [line(n) for n in (20, 20, 21, 25, 30, 60)]
    for i in range(0, 120, 2):
        w = texts[i].split()
        at = rng.randrange(len(w) + 1)
        texts[i] = " ".join([*w[:at], rng.choice(shared), *w[at:]])
    df = spark.createDataFrame([(i, i, t) for i, t in texts.items()], "row long, doc long, text string")
    found = substring.shared_runs(df, Stash(spark, "t"), crowd=crowd).collect()
    got = {i: set() for i in texts}
    for r in found:
        got[r["row"]].update(range(r["start"], r["end"]))
        assert r["lower"] == (r["other"] < r["row"])
    want = runs_by_brute_force(texts, 20)
    assert any(got.values()) and all(bool(got[i]) == bool(want[i]) for i in texts)
    assert sum(len(got[i] - want[i]) for i in texts) <= 5  # a word too far, 1 in 255
    if vocab > 1000:
        assert all(got[i] >= want[i] for i in texts)
    else:  # runs go as far as with the least document that has 20 words of them, so others may share a few words more
        assert sum(map(len, got.values())) > 0.95 * sum(map(len, want.values()))


@pytest.mark.parametrize("n", [20, 25, 30, 40, 51])
def test_pasted_passages_are_found(spark, n):
    rng = random.Random(n)
    texts = []
    for _ in range(100):
        shared = prose(rng, n)
        for _ in range(2):
            w = prose(rng, 80).split()
            at = rng.randrange(10, 70)
            texts.append(" ".join([*w[:at], shared, *w[at:]]))
    clean = [prose(rng, rng.randrange(5, 200)) for _ in range(200)]
    found = {r["doc_id"] for r in substring.repeated_passages(docs_of(spark, wrap(texts + clean))).collect()}
    assert found == set(range(200))


@pytest.mark.parametrize("n", [40, 60, 110])
def test_near_copies_of_pasted_passages_are_found(spark, n):
    """Passages with edits that leave a Jaccard similarity of 0.8 to 0.9."""
    rng, texts = random.Random(n), []
    while len(texts) < 200:
        base = prose(rng, n).split()
        copy = list(base)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(n)] = f"edit{rng.randrange(10**6)}"
        if 0.8 <= substring.jaccard(" ".join(base), " ".join(copy)) <= 0.9:
            for shared in (base, copy):
                w = prose(rng, 80).split()
                at = rng.randrange(10, 70)
                texts.append(" ".join([*w[:at], *shared, *w[at:]]))
    found = {r["doc_id"] for r in substring.repeated_passages(docs_of(spark, wrap(texts))).collect()}
    assert len(found) == 200


def test_cutting_goes_by_text_where_ids_repeat(spark):
    rng = random.Random(12)
    shared, one, two = prose(rng, 60), prose(rng, 90), prose(rng, 90)
    rows = [(1, shared + " " + one), (2, two), (2, two + " " + shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = substring.cut_passages(df, substring.repeated_passages(df))
    assert sorted(r["text"].strip() for r in out.collect()) == sorted([shared + " " + one, two, two])


def passages_like(spark, texts):
    words = [substring.Words(t.encode()).hash for t in texts]
    keys = [[int(b[0]) for b in substring.passage_bands(w, np.array([0]), np.array([len(w)]))[1]] for w in words]
    return spark.createDataFrame([(i, t, *k) for i, (t, k) in enumerate(zip(texts, keys))], "hash long, text string, " + ", ".join(f"band{i} long" for i in range(substring.BANDS)))


def test_near_paragraphs_are_linked(spark):
    rng = random.Random(5)
    stash, texts = Stash(spark, "t"), []
    for _ in range(40):
        words = prose(rng, 60).split()
        texts.append(" ".join(words))
        texts.append(" ".join(words[:-1] + ["changed"]))
    rows = dict(enumerate(texts))
    links = {tuple(sorted((r["a"], r["b"]))) for r in substring.similar_passages(passages_like(spark, texts), 0.8, stash).collect()}
    want = {tuple(sorted((a, b))) for a in rows for b in rows if a < b and substring.jaccard(rows[a], rows[b]) >= 0.8}
    assert links <= want and len(links) >= 0.9 * len(want)


@pytest.mark.parametrize("block", [512, 50])
def test_star_of_near_paragraphs_is_joined_as_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(substring._links_left, "__defaults__", (block,))
    rng = random.Random(9)
    base = prose(rng, 110).split()
    texts = [" ".join(base)]
    for n in range(1000):
        copy = list(base)
        for at in rng.sample(range(8, 102), 2):
            copy[at] = f"edit{n}at{at}"
        texts.append(" ".join(copy))
    stash = Stash(spark, "t")
    rows = passages_like(spark, texts).collect()
    sets, buckets, parent = {r["hash"]: substring.shingle_set(r["text"]) for r in rows}, {}, {r["hash"]: r["hash"] for r in rows}
    for r in rows:
        for i in range(substring.BANDS):
            buckets.setdefault(r[f"band{i}"], []).append(r["hash"])

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for group in buckets.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                if root(a) != root(b) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    parent[root(a)] = root(b)
    links = substring.similar_passages(passages_like(spark, texts), 0.8, stash).collect()
    assert all(len(sets[r["a"]] & sets[r["b"]]) >= 0.8 * len(sets[r["a"]] | sets[r["b"]]) for r in links)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), stash).collect()}
    groups = lambda of: {frozenset(x for x in sets if of(x) == c) for c in map(of, sets)}
    want = groups(root)
    assert groups(lambda x: got.get(x, x)) == want and max(map(len, want)) > 900


def test_passage_edges(spark):
    long = "wörter " * 300_000
    df = docs_of(spark, wrap([None, "", "\n\n", "x", long, long]) + [(None, long, None, None, None), (4, long, None, None, None)])
    got = substring.repeated_passages(df.withColumn("hash", F.lit(1)).withColumn("row", F.lit(1)))
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == {4, 5}
    assert substring.repeated_passages(df.where("false")).count() == 0


def plain_dedup(rows, min_docs=10):
    """Lines dropped by brute force, straight from the definition."""
    from collections import Counter, defaultdict

    def masked(line):
        tokens = [t for t in line.replace("\t", " ").replace("\r", " ").split(" ") if t]
        return tuple("<*>" if any(c in "0123456789" for c in t) else t for t in tokens)

    def digest(t):
        return int(hashlib.md5(" ".join(t).encode()).hexdigest()[:15], 16)

    texts = {t for _, t in rows if t is not None}
    lines = {t: [(i, m) for i, m in enumerate(map(masked, t.split("\n"))) if m] for t in texts}
    often, found = defaultdict(set), defaultdict(lambda: defaultdict(set))
    for t, ls in lines.items():
        for _, m in ls:
            for p, w in enumerate(m):
                often[len(m), m[:2], p, w].add(t)
    where = defaultdict(set)
    for t, ls in lines.items():
        for i, m in ls:
            kept = tuple((p, w) for p, w in enumerate(m) if w != "<*>" and len(often[len(m), m[:2], p, w]) >= min_docs)
            for key in [m] + [(len(m), m[:2], kept)] * (4 <= len(kept) < len(m) and 10 * len(kept) >= 6 * len(m)):
                found[key][t].add(digest(m))
                where[key].add((t, i))
    gone = defaultdict(set)
    for key, of in found.items():
        shares = defaultdict(list)
        for order in line_templates.ORDERS:
            sig = {t: min((digest(m) ^ order for _, m in lines[t] if digest(m) != min(own)), default=-1) for t, own in of.items()}
            sizes = Counter(sig.values())
            for t in of:
                shares[t].append(27720 // sizes[sig[t]])
        if len(of) >= min_docs and sum(sorted(x)[1] for x in shares.values()) >= (min_docs - 0.5) * 27720:
            for t, i in where[key]:
                gone[t].add(i)
    return [(i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[t]), len(gone[t])) for i, t in rows]


def dropped(spark, texts):
    return {r["doc_id"]: r["n_dropped"] for r in line_templates.dedup_lines(docs_of(spark, wrap(texts))).collect()}


def test_line_templates(spark):
    rng = random.Random(6)
    texts = ["\n".join([prose(rng, 12), f"Posted on {rng.randrange(30)} May 20{rng.randrange(10, 30)} by  admin", prose(rng, 9)]) for _ in range(15)]
    texts += ["\n".join([prose(rng, 10), "Share this page with all your good friends on " + prose(rng, 6)]) for _ in range(12)]
    copied = "\n".join(prose(rng, 14) for _ in range(5))
    texts += [copied] * 30 + [None, "", " \n", "Only one 7"]
    df = docs_of(spark, wrap(texts)).withColumn("_row", F.lit(0)).withColumn("key", F.lit(1)).withColumn("_gone", F.lit(1))
    got = sorted((r["doc_id"], r["text"], r["n_dropped"]) for r in line_templates.dedup_lines(df).collect() if r["text"] is not None)
    want = sorted(x for x in plain_dedup(list(enumerate(texts))) if x[1] is not None)
    assert got == want
    assert sum(g[2] for g in got) == 27
    assert all(t == copied for i, t, _ in got if 27 <= i < 57)
    out = line_templates.dedup_lines(df.where("false"))
    assert out.count() == 0 and set(out.columns) == {*df.columns, "n_lines", "n_dropped"}


def test_a_name_in_a_short_line_varies_and_prose_that_begins_alike_does_not(spark):
    rng = random.Random(13)
    names = [f"{a}{b}" for a in ("Ann", "Ber", "Car", "Dor", "Eli", "Fay", "Gus") for b in ("a", "o")]
    posted = [prose(rng, 12) + f"\nPosted by {x} in News\n" + prose(rng, 8) for x in names]
    prose_alike = [prose(rng, 12) + "\nOn the other hand " + prose(rng, 4) + "\n" + prose(rng, 8) for _ in range(14)]
    got = dropped(spark, posted + prose_alike)
    assert all(got[i] == 1 for i in range(14)) and all(got[i] == 0 for i in range(14, 28))


@pytest.mark.parametrize("edit", [False, True])
def test_copies_do_not_shield_a_line_and_lose_no_line(spark, edit):
    rng = random.Random(14)
    licence = "All rights reserved by the owners of this work"
    texts = [licence + "\n" + "\n".join(prose(rng, 9) for _ in range(rng.randrange(1, 6))) for _ in range(100)]
    body = [prose(rng, 15) for _ in range(9)]
    for _ in range(120):  # copies of one document with the line, changed in a line each if edit is set
        copy = [licence, *body]
        if edit:
            copy[rng.randrange(1, 10)] = prose(rng, 15)
        texts.append("\n".join(copy))
    assert set(dropped(spark, texts).values()) == {1}
    assert plain_dedup(list(enumerate(texts))) == sorted((r["doc_id"], r["text"], r["n_dropped"]) for r in line_templates.dedup_lines(docs_of(spark, wrap(texts))).collect())


def test_a_block_of_lines_that_stand_together_recurs(spark):
    rng = random.Random(15)
    block = [prose(rng, 7) for _ in range(3)]
    texts = ["\n".join([prose(rng, 10), prose(rng, 10), prose(rng, 10), *block]) for _ in range(40)]
    assert set(dropped(spark, texts).values()) == {3}

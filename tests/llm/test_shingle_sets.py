import numpy as np
import pytest
from test_duplicates import parts

import corpus_pipeline
from attestry.llm import shingle_sets, simhash


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def wanted(docs):
    """Ids that stay, by brute force: the first of each group of Jaccard similarity 0.8."""
    docs = sorted(docs)
    sets = [shingles(t) for _, t in docs]
    alike = lambda a, b: a == b or 10 * len(a & b) >= 8 * len(a | b)
    root = parts(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if alike(sets[i], sets[j])])
    return {docs[k][0] for k in set(root)}


def near_copies():
    """Texts of 4 to 300 words with one to eight words replaced, a crowd of near copies, and a passage that many share."""
    rng = np.random.default_rng(7)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    docs = []
    for k in range(60):
        base = text(int(rng.integers(4, 300)))
        docs.append(base)
        for at in range(1, 9, 2):
            copy = list(base)
            for p in rng.integers(0, len(base), at):
                copy[p] = "new"
            docs.append(copy)
    base = text(200)
    for k in range(80):
        copy = list(base)
        for p in rng.integers(0, 200, 1 + k % 6):
            copy[p] = f"crowd{k}"
        docs.append(copy)
    passage = text(40)
    docs += [passage + text(int(n)) for n in rng.integers(2, 60, 60)]
    return [(k, " ".join(t)) for k, t in enumerate(docs)]


def test_near_dedup_stage_against_brute_force_jaccard(spark, documents):
    docs = near_copies()
    want = wanted(docs)
    assert len(want) < len(docs) - 150
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == want
    # The two bits of operator 3 leave most near copies.
    assert simhash.one_of_each(df).count() > len(want) + 50
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, documents, "").collect()}
    assert got == wanted([(r.doc_id, r.text) for r in documents.collect()])


@pytest.mark.parametrize("crowd", [2, 1000])
def test_the_order_and_the_crowds_decide_nothing(spark, monkeypatch, crowd):
    docs = near_copies()
    monkeypatch.setattr(shingle_sets, "CROWD", crowd)
    monkeypatch.setattr(shingle_sets, "often", lambda *a: np.zeros(0, np.int64))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each(df, shingle=5, similarity=0.8).collect()} == wanted(docs)


def test_odd_documents(odd_documents):
    kept = simhash.one_of_each(odd_documents, shingle=5, similarity=0.8)
    assert kept.columns == odd_documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 5, 6, 7, 9, 10] and None in ids
    assert simhash.one_of_each(odd_documents.limit(0), shingle=5, similarity=0.8).count() == 0


def test_near_dedup_compares_what_the_simhash_index_finds(spark, monkeypatch):
    docs = near_copies() + [(5000, "one two three four five six seven " * 3), (5001, "one two three four five six seven " * 4), (5002, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bits = {r.doc_id: r.bits & (1 << 64) - 1 for r in shingle_sets.prefixes(df, 5, 0.8).collect()}
    assert bits == {i: simhash.fingerprint(t or "", 5) for i, t in docs}
    found, asked = [], shingle_sets.by_simhash
    monkeypatch.setattr(shingle_sets, "by_simhash", lambda distinct, *a: found.append((distinct, asked(distinct, *a))) or found[-1][1])
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert kept == wanted([(i, t or "") for i, t in docs])
    (distinct, near), own = found[0], {}
    for r in distinct.collect():
        own[r.fp] = r.bits & (1 << 64) - 1
    # Those whose SimHashes differ in two bytes at most, sets of one SimHash through the one that stands for them.
    bytes_apart = lambda a, b: sum((a ^ b) >> 8 * k & 255 > 0 for k in range(8))
    pairs = {tuple(sorted((r.a, r.b))) for r in near.collect()}
    assert len(pairs) > 20 and all(bytes_apart(own[a], own[b]) <= 2 for a, b in pairs)
    small = {r.fp: r.k for r in distinct.collect()}
    at = {fp: n for n, fp in enumerate(own)}
    root = parts(len(at), [(at[a], at[b]) for a, b in pairs])
    fps = list(own)
    assert all(root[at[a]] == root[at[b]] for a in fps for b in fps if bin(own[a] ^ own[b]).count("1") <= 2 and min(small[a], small[b]) >= 0.8 * max(small[a], small[b]))

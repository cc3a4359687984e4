import numpy as np

from attestry.llm.packing import ShardIndex


def bm25(documents, idf, mean_length, seed):
    """Scores of all documents against all distinct terms of one, term by term."""
    out = np.zeros(len(documents))
    for t in np.unique(documents[seed]):
        tf = np.array([np.count_nonzero(d == t) for d in documents])
        lens = np.array([len(d) for d in documents])
        out += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lens / mean_length))
    return out


def test_ranking_is_that_of_all_terms():
    rng = np.random.default_rng(9)
    documents = [(1 + 400 * rng.random(int(n)) ** 2).astype(np.uint32) for n in rng.integers(60, 200, 120)]
    documents.append(documents[5].copy())
    assert min(len(np.unique(d)) for d in documents) > 24
    seen = np.zeros(402)
    for d in documents:
        seen[np.unique(d)] += 1
    idf = np.log1p((len(documents) - seen + 0.5) / (seen + 0.5)).astype(np.float32)
    mean_length = sum(map(len, documents)) / len(documents)
    index, used = ShardIndex(documents, idf, mean_length), np.zeros(len(documents), bool)
    for seed in rng.permutation(len(documents))[:115].tolist():
        used[seed] = True
        want = bm25(documents, idf, mean_length, seed)
        want[used] = 0
        got = index.ranked(seed, used)
        assert set(got.tolist()) == set(np.flatnonzero(want).tolist())
        assert np.allclose(want[got], np.sort(want[want > 0])[::-1], rtol=1e-6)

import numpy as np
import pytest

from attestry.llm import ann, mips


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 64))
    x[500:700] = x[500]  # one vector that many rows share
    x[:50] *= rng.uniform(0.1, 5, (50, 1))
    return [(k, [float(v) for v in row]) for k, row in enumerate(x.astype(np.float32))]


ODD = [(1000, None), (1020, []), (1040, [float("nan")] * 64), (1060, [0.0] * 64), (None, [1.0] * 64), (1080, [1.0, None] + [0.0] * 62), (1100, [1.0, 2.0])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as first", "2 as score", "'x' as c1")


def test_nearest(spark, vectors):
    got = {}
    for r in ann.search(frame(spark, vectors + ODD)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = np.array([v for _, v in vectors], np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert set(got) == {k for k in range(0, 900, 50)} | {1100} - {1100}
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5] and q not in {r[1] for r in rows}
        cos = u @ u[q]
        assert all(abs(s - cos[v]) < 1e-12 for _, v, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1])) or all(a[2] >= b[2] for a, b in zip(rows, rows[1:]))
        best = [v for v in np.lexsort((np.arange(900), -np.round(cos, 12))) if v != q][:5]
        hits += len({r[1] for r in rows} & set(best))
    assert hits >= 0.9 * 5 * len(got)
    assert [r[1] for r in got[500]] == [501, 502, 503, 504, 505]
    assert ann.search(frame(spark, ODD)).count() == 0


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in ann.search(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len(got[q] & {int(i) for i in [ids[v] for v in np.argsort(-(u @ u[k])) if v != k][:5]}) for k, q in enumerate(ids) if q % 50 == 0)
    assert hit >= 0.9 * 5 * len(got)


def products(vectors, every, k):
    whole = {i: [int(np.floor(64.0 * np.float64(np.float32(c)))) for c in v] for i, v in vectors}
    out = []
    for q in whole:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[v])), v) for v in whole if v != q and len(whole[v]) == len(whole[q]))[:k]
            out += [(q, n + 1, v, -s) for n, (s, v) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("group, block", [(64, 7), (8192, 4096)])
def test_inner_products_are_exact(spark, vectors, group, block):
    rows = vectors[:300] + vectors[500:620] + [(1060, [0.0] * 64), (1100, [1.0, 2.0]), (1120, [0.5, -1.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in mips.search(frame(spark, rows + ODD[:3] + ODD[4:6]), group=group, block=block).collect())
    assert got == products(rows, 20, 20)


def test_lengths_and_coordinates_prune_nothing_that_counts():
    rng = np.random.default_rng(6)
    x = np.floor(64 * rng.normal(size=(500, 8)) * rng.uniform(0.2, 3, (500, 1)))
    x[:40] = np.floor(x[0] * rng.uniform(0.9, 1.1, (40, 1)))
    q = np.concatenate([x[:5], np.floor(64 * rng.normal(size=(20, 8)))])
    exact = (q @ x.T).astype(np.int64)
    floors = np.sort(exact, axis=1)[:, -5].astype(float)
    a, b, s = mips.group_top(mips.Group(x), q, floors, np.arange(500), 5)
    for k in range(len(q)):
        want = sorted(((-v, i) for i, v in enumerate(exact[k].tolist()) if v >= floors[k]))[:5]
        assert sorted(zip((-s[a == k]).tolist(), b[a == k].tolist())) == want


def test_huge_components_stay_exact(spark):
    rows = [(0, [3e15, 1.0]), (20, [1e15, -1.0]), (1, [2e15, 5.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in mips.search(frame(spark, rows)).collect())
    top = (1 << 63) - 1
    assert got == [(0, 1, 1, top), (0, 2, 20, top), (20, 1, 0, top), (20, 2, 1, top)]


def test_no_usable_vectors_or_queries(spark):
    assert mips.search(frame(spark, ODD[:3])).count() == 0
    assert mips.search(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert ann.search(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert [(r.query_id, r.vec_id) for r in mips.search(frame(spark, [(20, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()] == [(20, 2)]


def test_ties_of_different_vectors_and_repeated_ids(spark):
    """Equal nearness of vectors that differ goes by vec_id; a repeated vec_id is a candidate with each of its rows."""
    rows = [(100, [1.0, 0.0]), (7, [3.0, 0.0]), (3, [2.0, 0.0]), (9, [0.5, 0.0]), (5, [4.0, 0.0]), (5, [0.0, 1.0]), (5, [8.0, 0.0])]
    got = sorted({(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(frame(spark, rows)).collect()})
    assert got == [(100, 1, 3, 1.0), (100, 2, 5, 1.0), (100, 3, 5, 1.0), (100, 4, 7, 1.0), (100, 5, 9, 1.0)]
    whole = [(20, [1.0, 1.0]), (8, [0.0, 2.0]), (2, [2.0, 0.0]), (4, [1.0, 1.0]), (6, [0.5, 1.5]), (6, [0.0, 0.0]), (1, [-1.0, 3.0])]
    got = [(r["rank"], r.vec_id, r.score) for r in mips.search(frame(spark, whole)).collect()]
    assert sorted(got) == [(1, 1, 8192), (2, 2, 8192), (3, 4, 8192), (4, 6, 8192), (5, 8, 8192), (6, 6, 0)]

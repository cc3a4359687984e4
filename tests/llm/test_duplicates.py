import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from attestry.llm import line_dedup, simhash
from attestry.llm.graph import components


def parts(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [tuple(e) for e in rng.integers(200, 400, (120, 2)).tolist()] + [(5, 5), (7, 6), (7, 6)]
    links = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(links, "test").collect()}
    want = parts(400, edges)
    assert all(got.get(x, x) == want[x] for x in range(400))
    assert components(links.limit(0), "test").count() == 0


def fingerprint(text, shingle=3):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    h = [xxh64_intdigest(" ".join(words[k : k + shingle]).encode(), 42) for k in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check_groups(rows, docs):
    fps = [fingerprint(t or "") for _, t in docs]
    a = np.array(fps, np.uint64)
    near = [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2)]
    ids = {}
    for k, root in enumerate(parts(len(docs), near)):
        ids.setdefault(root, []).append(docs[k][0])
    least = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    want = sorted((i is None, i or 0, f"{f:016x}", least[r]) for (i, _), f, r in zip(docs, fps, parts(len(docs), near)))
    got = sorted((r.doc_id is None, r.doc_id or 0, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in rows)
    assert got == want


def test_simhash_against_brute_force(spark, documents, odd_documents):
    check_groups(simhash.groups(documents).collect(), [(r.doc_id, r.text) for r in documents.collect()])
    check_groups(simhash.groups(odd_documents).collect(), [(r.doc_id, r.text) for r in odd_documents.collect()])
    assert simhash.groups(documents.limit(0)).count() == 0


@pytest.mark.parametrize("long_list", [2, 1000])
def test_links_lose_none_of_any_list(spark, long_list):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 6)
    values = {int(b) for b in base} | {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (40, 2))}
    values = sorted(values)
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), long_list)
    at = {v: k for k, v in enumerate(values)}
    got = parts(len(values), [(at[r.a], at[r.b]) for r in links.collect()])
    a = np.array(values, np.uint64)
    assert got == parts(len(values), [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2)])


def test_tally_is_the_guaranteed_minimum(spark):
    """Pairs are tallied 3 times or more exactly if they share 6 positional bytes; the count rejects others that met."""
    assert len(simhash.POSTINGS) == 14
    rng = np.random.default_rng(6)
    values = set()
    for base in rng.integers(0, 1 << 62, 8).tolist():
        for _ in range(30):
            change = sum(int(rng.integers(1, 256)) << 8 * int(k) for k in rng.choice(7, int(rng.integers(0, 5)), replace=False))
            values.add(base ^ change)
    values = sorted(values)
    bytes_ = np.array(values, np.int64).view(np.uint8).reshape(-1, 8)
    same = (bytes_[:, None] == bytes_[None]).sum(axis=2)
    want = {(values[i], values[j]) for i, j in zip(*np.nonzero(same >= 6)) if i < j}
    rows = simhash.tallied(simhash.postings(spark.createDataFrame([(v,) for v in values], "fp long"))).collect()
    assert {(r.a, r.b) for r in rows if r.shared >= simhash.LEAST_SHARED} == want
    assert len(rows) > len(want) > 0


def test_one_of_each_group_stays(odd_documents):
    kept = simhash.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r.doc_id for r in kept.collect()]
    # 1, 2 and 8 have no words; 3 and both rows of 4 are copies.
    assert sorted(i for i in ids if i is not None) == [1, 3, 5, 6, 7, 9, 10] and None in ids


def words_of(line):
    return tuple(w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", line.lower()) if w)


def distance(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return most + 1
        row = new
    return row[-1]


def alike(a, b):
    most = int(0.2 * max(len(a), len(b)) + 1e-9)
    return abs(len(a) - len(b)) <= most and distance(a, b, most) <= most


def similar_pairs(lines):
    """All pairs of distinct lines with an edit similarity of 0.8, by edit distance alone: each shares one of its rarest words."""
    count = Counter(w for x in lines for w in set(x))
    lists = defaultdict(list)
    for k, x in enumerate(lines):
        for w in sorted(set(x), key=lambda w: (count[w], w))[: int(0.25 * len(x) + 1e-9) + 1]:
            lists[w].append(k)
    met = {(i, j) for v in lists.values() for j in v for i in v if i < j}
    return {(i, j) for i, j in met if alike(lines[i], lines[j])}


def lines_and_links(docs, **options):
    """Distinct lines, the pairs of them that ``links`` finds, all similar pairs, and the places of every line."""
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    text = dict(rows)
    lines, distinct = line_dedup.distinct_lines(docs)
    of = {r.h: words_of(text[r.id].split("\n")[r.n]) for r in distinct.collect()}
    number = {w: k for k, w in enumerate(sorted(set(of.values())))}
    assert len(number) == len(of)
    found = {tuple(sorted((number[of[r.a]], number[of[r.b]]))) for r in line_dedup.links(docs, distinct, **options).collect()}
    places = [(d, n, number[w]) for d, t in rows for n, x in enumerate(t.split("\n")) if (w := words_of(x))]
    return sorted(number), found, places, text


def kept(places, text, root):
    seen, gone = set(), defaultdict(set)
    for d, n, line in places:
        if root[line] in seen:
            gone[d].add(n)
        seen.add(root[line])
    return {d: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d]) for d, t in text.items()}


@pytest.fixture(scope="module")
def some_documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def line_links(some_documents):
    return lines_and_links(some_documents)


def test_line_links_against_edit_similarity_alone(line_links):
    lines, found, _, _ = line_links
    want = similar_pairs(lines)
    assert len(want) > 300 and all(alike(lines[a], lines[b]) for a, b in found)
    root = parts(len(lines), found)
    assert sum(root[a] == root[b] for a, b in want) >= 0.92 * len(want)
    longer = [(a, b) for a, b in want if len(lines[a]) >= 20]
    assert sum(root[a] == root[b] for a, b in longer) >= 0.94 * len(longer)


def test_first_line_of_each_group_stays(some_documents, line_links):
    lines, found, places, text = line_links
    got = {r.doc_id: r.text for r in line_dedup.dedup(some_documents).collect()}
    assert got == kept(places, text, parts(len(lines), found))


def crowd(spark, shared=0):
    """Copies of one line with up to three words changed, and short lines; ``shared`` lines have a passage in common."""
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(60)]
    docs = [(0, " ".join(base))]
    for k in range(1, 120):
        words = list(base)
        for at in rng.integers(0, 60, 1 + k % 3):
            words[at] = f"v{int(rng.integers(0, 50))}"
        docs.append((k, " ".join(words) + "\n" + f"number {k % 30} comes again"))
    for k in range(shared):
        own = [f"x{int(v)}" for v in rng.integers(0, 400, 12)]
        docs.append((1000 + k, " ".join([*own, *(f"p{j}" for j in range(28))])))
    return spark.createDataFrame(docs, "doc_id long, text string")


@pytest.mark.parametrize("options", [{}, {"crowd": 4, "long_list": 8}, {"crowd": 1000, "long_list": 2}])
def test_crowded_lists_lose_no_link(spark, options):
    lines, found, places, text = lines_and_links(crowd(spark, 90), **options)
    want = similar_pairs(lines)
    assert len(want) > 200 and all(alike(lines[a], lines[b]) for a, b in found)
    assert kept(places, text, parts(len(lines), found)) == kept(places, text, parts(len(lines), want))


def test_rare_words_lose_no_pair_of_lines_in_different_lists(spark):
    """Lines are searched by their rare words as lines, without the lists that they came from."""
    docs = crowd(spark, 90)
    lines, _, _, text = lines_and_links(docs)
    _, distinct = line_dedup.distinct_lines(docs)
    number = {w: k for k, w in enumerate(lines)}
    of = {r.h: number[words_of(text[r.id].split("\n")[r.n])] for r in distinct.collect()}
    members = distinct.select("h", "k", distinct.h.alias("part"))
    near = line_dedup._by_rare_words(docs, distinct, members.union(members))
    found = [tuple(sorted((of[r.a], of[r.b]))) for r in near.collect()]
    want = {(a, b) for a, b in similar_pairs(lines) if min(len(lines[a]), len(lines[b])) >= 5}
    assert len(want) > 200 and want <= set(found) and len(set(found)) == len(found)


def test_words_of_one_sign_are_told_apart(spark):
    """Lines just within and just beyond the similarity, with enough words that some share a sign."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        base = [f"n{int(v)}" for v in rng.choice(200_000, 400, replace=False)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: 320 - k % 2] + [f"m{int(v)}" for v in rng.choice(200_000, 80 + k % 2, replace=False)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, distinct = line_dedup.distinct_lines(docs)
    h = {r.id: r.h for r in distinct.collect()}
    near = spark.createDataFrame([(h[2 * k], h[2 * k + 1]) for k in range(60)], "a long, b long")
    got = {(r.a, r.b) for r in line_dedup._verified(docs, distinct, near).collect()}
    assert got == {(h[2 * k], h[2 * k + 1]) for k in range(60) if alike(*(tuple(rows[2 * k + j][1].split()) for j in (0, 1)))}
    assert 0 < len(got) < 60


def test_line_dedup_of_odd_documents(odd_documents):
    out = line_dedup.dedup(odd_documents)
    rows = {(r.doc_id, r.text) for r in out.collect()}
    assert out.count() == odd_documents.count()
    assert {(1, ""), (2, ""), (3, "one two three four five six"), (4, ""), (8, "   \n\t ")} <= rows
    assert (7, "One two, three four\nfive six seven\n") in rows
    assert line_dedup.dedup(odd_documents.limit(0)).count() == 0


def test_votes_of_long_and_repetitive_lines_fit(spark):
    rows = [(1, " ".join(f"w{k % 5000}" for k in range(200_000))), (2, "same " * 300_000)]
    got = {r.id: r for r in line_dedup.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].k, got[2].k) == (200_000, 300_000)
    vote = (xxh64_intdigest("same", 42) & 0x15555555) + (4 << 34)
    assert sorted(got[2][f"s{j}"] for j in range(8)) == [0] * 7 + [300_000 * vote]
    h = {w: xxh64_intdigest(w, 42) for w in (f"w{k}" for k in range(5000))}
    for j in range(8):
        assert got[1][f"s{j}"] == 40 * sum((x & 0x15555555) + (len(w) << 34) for w, x in h.items() if x >> 61 == j)


def test_no_pair_of_short_lines_is_lost(spark, line_links):
    lines, found, _, _ = line_links
    root = parts(len(lines), found)
    short = [(a, b) for a, b in similar_pairs(lines) if min(len(lines[a]), len(lines[b])) < 20]
    assert len(short) > 40 and all(root[a] == root[b] for a, b in short)
    texts = ["of the and to", "of the new and to", "ha ha ha ha ha", "ha ha ha ha", "a b c d e", "x b c d e", "a b c d", "one two three four five six seven eight nine ten", "one six three four five two seven eight nine ten"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines, found, _, _ = lines_and_links(docs)
    assert parts(len(lines), found) == parts(len(lines), similar_pairs(lines))


@pytest.mark.parametrize("common", [-1, 40, 127])
def test_short_lines_share_a_key_of_rare_words(spark, monkeypatch, common):
    """Similar lines meet in a key, whether all words count as common or none does; words repeat in some lines."""
    monkeypatch.setattr(line_dedup, "COMMON", common)
    rng = np.random.default_rng(8)
    rows = []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 3 if k % 3 == 0 else 400, int(rng.integers(4, 20)))]
        rows += [" ".join(words), " ".join(words[1:])]
        words[int(rng.integers(0, len(words)))] = "new"
        rows.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    _, distinct = line_dedup.distinct_lines(docs)
    of = {r.h: words_of(rows[r.id]) for r in distinct.collect()}
    keys = defaultdict(set)
    for r in line_dedup.rare_keys(distinct).collect():
        keys[of[r.h]].add(r.key)
    lines = sorted(set(of.values()))
    want = similar_pairs(lines)
    assert len(want) > 80 and all(keys[lines[a]] & keys[lines[b]] for a, b in want if min(len(lines[a]), len(lines[b])) >= 4)


def test_words_are_split_once_and_added_up_by_plain_keys(spark, documents):
    """A filter on the words would split each line again for the sample of frequencies; an array among the keys slows every word down."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(line_dedup._short_words(documents, 1)).count("regexp_replace(") == 1
    found = line_dedup.fingerprints(documents)
    assert plan(found).count("regexp_replace(") == 1
    assert not [c for c, kind in found.dtypes if kind.startswith("array")]
    texts = [r.text or "" for r in documents.collect()]
    want = Counter(w for t in texts for x in t.split("\n") if 4 <= len(words_of(x)) <= 25 for w in words_of(x))
    got = Counter({r.word: r.n for r in line_dedup._short_words(documents, 1).where("word is not null").groupBy("word").count().toDF("word", "n").collect()})
    assert got == want


def test_pairs_are_compared_up_to_their_last_edit(spark):
    """Distances around the steps of the comparison, and around the most that the similarity allows."""
    rows = []
    for k, n in enumerate((5, 20, 25, 79, 80, 85, 320, 330)):
        most = int(0.2 * n + 1e-9)
        for edits in sorted({1, 4, 5, 16, 17, 64, 65, most, most + 1}):
            if edits < n:
                rows += [" ".join(f"n{k}x{j}" for j in range(n)), " ".join(f"m{k}x{edits}x{j}" if j < edits else f"n{k}x{j}" for j in range(n))]
    lines = sorted({x: None for x in rows})
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    _, distinct = line_dedup.distinct_lines(docs)
    h = {lines[r.id]: r.h for r in distinct.collect()}
    pairs = [(h[a], h[b], alike(a.split(), b.split())) for a, b in zip(rows[::2], rows[1::2])]
    near = spark.createDataFrame([p[:2] for p in pairs], "a long, b long")
    got = {(r.a, r.b) for r in line_dedup._verified(docs, distinct, near).collect()}
    assert got == {(a, b) for a, b, same in pairs if same} and 0 < len(got) < len(pairs)

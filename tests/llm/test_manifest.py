import hashlib
import zlib

import pytest

from attestry.llm import merkle

NULL_FIRST = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    for level in levels[:-1]:
        lo = at - at % 3
        yield "".join(level[lo:at]), "".join(level[at + 1 : lo + 3])
        at //= 3


def by_hand(rows):
    """What the contract says of rows (doc_id, source, lang, n_chars, text), one at a time."""
    known = []
    for doc_id, source, lang, n_chars, text in rows:
        head = "".join(map(field, (doc_id, source, lang, n_chars)))
        leaf = shown = sha(head + field(text))
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            shown = sha(head + field(text if text is None else text.replace("\n", "")))
        known.append((source, doc_id, leaf, shown))
    sources = sorted({r[0] for r in known}, key=NULL_FIRST)
    own = {s: sorted((r for r in known if r[0] == s), key=lambda r: (NULL_FIRST(r[1]), r[2])) for s in sources}
    trees = {s: tree([r[2] for r in own[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    for k, s in enumerate(sources):
        for at, (_, doc_id, leaf, node) in enumerate(own[s]):
            path = [*siblings(trees[s], at), *siblings(top, k)]
            for before, after in path:
                node = sha(before + node + after)
            yield doc_id, leaf, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]


def alike(df, rows):
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, by_hand(rows)))


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    alike(merkle.op11_manifest(spark, "/root/testdata/sf0.01"), [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])


@pytest.mark.parametrize("size", [1, 2, 3, 4, 9, 10, 27, 28, 90])
def test_blocks_of_several_rounds(spark, monkeypatch, size):
    """Blocks of nine nodes, so that 28 and 90 leaves ask for two and three rounds."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    rows = [(k, "hot" if k < size else f"s{k}", "en", k, f"text {k}\n") for k in range(size + 12)]
    alike(merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")), rows)


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [(None, None, None, None, None), (None, "a", "en", 1, "x\ny"), (1, None, "en", None, ""), (2, "a", None, 2, "\n"), (2, "a", None, 2, "\n"), (2, "a", "de", 2, "other"), (3, "", "en", 3, None),
            (4, "Ж", "en", 4, "日本\n語"), (5, "z", "en", 5, "word \n" * 200_000), (6, "é", "en", 6, "a"), (7, "a-", "en", -7, "1:2-")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    clash = df.selectExpr("1 as rank", "*", *[f"'x' as {c}" for c in ("node", "tree", "block", "leaf", "root", "path", "at", "n", "all", "upper", "changed", "part", "first")])
    alike(merkle.manifest(clash), rows)
    assert merkle.manifest(df.limit(0)).count() == 0


def test_any_change_of_a_row_is_found(spark):
    """The roots differ as soon as one field of one row does, whatever moves between neighbouring fields."""
    rows = [(k, "s", "en", 1, f"t{k}") for k in range(5)]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    roots = {merkle.manifest(spark.createDataFrame([*rows[:4], last], schema)).first().root for last in (rows[4], (4, "s", "e", 1, "t4"), (4, "s", "en", 1, "t"), (4, "s", "en", 11, "t4"), (5, "s", "en", 1, "t4"))}
    assert len(roots) == 5

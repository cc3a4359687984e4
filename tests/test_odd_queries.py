"""Queries against their SQL on rows that the given tables lack."""

from collections import Counter

import duckdb
from test_queries import plain

from attestry.plans import catalogue


def differences(spark, path, name, **tables):
    """Rows of a query without a like in its SQL, and the reverse, over ``tables``: name -> (rows, schema)."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{path}/{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{path}/{t}.parquet/*.parquet')")
    got = catalogue.queries()[name](spark, f"file://{path}")
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({catalogue.oracles()[name]})").fetchall()
    rows = lambda rs: Counter(tuple(plain(x) for x in r) for r in rs)
    got, want = rows(got.select(*columns).collect()), rows(want)
    return got - want, want - got


def test_lexicon_flags_have_the_word_bounds_of_their_sql(spark, tmp_path):
    texts = ["é" + "no", "noé", "may", "émay", "will", "wİll", "Known", "don’t know", "unſure", "ſpending", "not Known", "sentß", "ünever", "asked " + "é" * 100 + " to", "asked " + "é" * 101 + " to", "x_no", "9no", "", None]
    assert differences(spark, tmp_path, "lexicon_flags", documents=(list(enumerate(texts)), "doc_id long, text string")) == (Counter(), Counter())


_TURNS = "conv_id long, turn int, role string, text string"


def test_screen_metrics_hold_strings_in_one_text(spark, tmp_path):
    # "the.\nA" would run from the end of one text to the begin of its like, "" be found where there is no fact at all.
    turns = [(1, 1, "user", "Go the.\nA way"), (1, 2, "assistant", "A lamp is on the."), (2, 3, "user", "two  blanks"), (2, 4, "assistant", "que"), (3, 1, "user", "abc"), (3, 2, "assistant", ""), (3, 3, "user", None), (3, 4, "user", "")]
    assert differences(spark, tmp_path, "screen_metrics", conversations=(turns, _TURNS)) == (Counter(), Counter())


def test_uncovered_added_adds_every_line_but_the_first(spark, tmp_path):
    texts = ["Of.\nLamp of it. Of. On.\nOf.\nLamp\n--\nLamp", "One line", "", None, "\nA\nA", "x\n" + "word " * 500, " a \n b \n b b"]
    turns = [(k, 1, "user", t) for k, t in enumerate(texts)]
    assert differences(spark, tmp_path, "uncovered_added", conversations=(turns, _TURNS)) == (Counter(), Counter())


def test_variant_roll_up_names_every_failure_in_order(spark, tmp_path):
    docs = [(k, None if k % 5 == 0 else "en" if k % 2 else "fr", 10 * k) for k in range(40)] + [(3, "en", 1)]
    labels = [(k, None if k == 7 else k % 2, (k // 2) % 2) for k in range(39)]
    assert "failures" in catalogue.queries()["variant_roll_up"](spark, "/root/testdata/sf0.001").columns
    got = differences(spark, tmp_path, "variant_roll_up", documents=(docs, "doc_id long, lang string, n_chars long"), labels=(labels, "doc_id long, quality int, toxic int"))
    assert got == (Counter(), Counter())

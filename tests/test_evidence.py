import random
import time

import pytest
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import intervals, segment


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4095, 4096, 4160, 270_000])
def test_running_sums_and_maxima(spark, n):
    pick = random.Random(n).randrange
    values = [pick(100) for _ in range(n)]
    row = spark.createDataFrame([(values,)], "v array<int>").select(T.running(F.col("v")).alias("sums"), T.running(F.col("v"), -1, lambda a, b: F.greatest(a, b)).alias("most")).first()
    sums, most = [0], [-1]
    for v in values:
        sums.append(sums[-1] + v)
        most.append(max(most[-1], v))
    assert row.sums == sums and row.most == most


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 1000])
def test_first_index(spark, n):
    asked = range(-1, n + 2)
    rows = spark.createDataFrame([(list(range(n)), k) for k in asked], "v array<int>, k int")
    got = {r.k: r.i for r in rows.select("k", T.first_index(F.size("v"), lambda i: F.get("v", i) > F.col("k")).alias("i")).collect()}
    assert got == {k: min(max(k + 1, 0), n) for k in asked}


def by_hand(event, quote):
    """Each sign of the joined text on its own: where it stands in the note, if it does."""
    place = {}
    for s in event.source_segments:
        for k in range(s.local_start, s.local_end):
            place[k] = s.start + k - s.local_start
    out, at = [], event.source_text.find(quote)
    while at >= 0:
        spans = []
        for k in range(at, at + len(quote)):
            if k in place:
                if spans and spans[-1][1] == place[k]:
                    spans[-1][1] += 1
                else:
                    spans.append([place[k], place[k] + 1])
        if spans and spans not in out:
            out.append(spans)
        at = event.source_text.find(quote, at + 1)
    return out


def test_places_equal_those_of_each_sign(spark):
    pick = random.Random(47)
    note = "🙂 Vorab.\r\n"
    for k, end in enumerate(["\n", "\r", "\r\n", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x85", " ", " "] * 2):
        note += "EVENT: " + ["Tür", "Akte", "Wort"][k % 3] + end + ["🙂 zu.", "Frist offen.", "未確認.", "\n\naa\n"][k % 4] + end
    notes = spark.createDataFrame([(1, note)], "id int, text string")
    groups = segment.event_groups(notes).collect()
    assert len(groups) == 4 and all(g.error is None for g in groups)
    asked = {(g.event_id, "\n") for g in groups} | {(g.event_id, "\n\n") for g in groups}
    for g in groups:
        for _ in range(60):
            at = pick.randrange(len(g.source_text))
            asked.add((g.event_id, g.source_text[at : at + pick.randint(1, 25)]))
    found = intervals.locate(spark.createDataFrame(groups, segment.event_groups(notes).schema), spark.createDataFrame([(1, *a) for a in asked], "id int, event_id string, quote string")).collect()
    own = {g.event_id: g for g in groups}
    assert len(found) == len(asked)
    for r in found:
        want = by_hand(own[r.event_id], r.quote)
        assert [[[s.start, s.end] for s in c.segments] for c in r.candidates] == want
        assert r.ambiguous == (len(want) > 1)


def test_ten_thousand_updates_of_one_event(spark):
    """As many occurrences as segments: twice the square of it would be some hundred million looks at a segment."""
    n = 10_000
    note = "EVENT: Status\nPending.\n" * n
    notes = spark.createDataFrame([(1, note)], "id int, text string")
    start = time.time()
    found = intervals.with_lines(intervals.locate(segment.event_groups(notes), spark.createDataFrame([(1, "event-1", "Pending."), (1, "event-1", "Pending.\n\nPending."), (1, "event-1", "gone")], "id int, event_id string, quote string")), notes).collect()
    took = time.time() - start
    got = {r.quote: [[tuple(s) for s in c.segments] for c in r.candidates] for r in found}
    size = len("EVENT: Status\nPending.\n")
    assert got["gone"] == [] and len(got["Pending."]) == n and len(got["Pending.\n\nPending."]) == n - 1
    assert got["Pending."][1234] == [(1234 * size + 14, 1234 * size + 22, 2470, 2470)]
    assert got["Pending.\n\nPending."][17] == [(17 * size + 14, 17 * size + 23, 36, 36), (18 * size + 14, 18 * size + 22, 38, 38)]
    assert took < 30


def test_white_space_of_all_kinds(spark):
    signs = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    rows = spark.createDataFrame([(c, f"{c}a{c}{c}b{c}") for c in signs] + [(c, f"{c}a{c}{c}b{c}") for c in "​᠎﻿_"], "c string, t string")
    got = {r.c: (r.s, r.n) for r in rows.select("c", T.strip(F.col("t")).alias("s"), T.collapse(F.col("t")).alias("n")).collect()}
    assert got == {c: (f"{c}a{c}{c}b{c}".strip(), " ".join(f"{c}a{c}{c}b{c}".split())) for c in got}


def test_case_folding_of_every_sign(spark):
    signs = [k for k in range(0x110000) if not 0xD800 <= k < 0xE000 and k]
    blocks = [[chr(c) for c in signs[k : k + 4000]] for k in range(0, len(signs), 4000)]
    df = spark.createDataFrame([(b,) for b in blocks], "c array<string>")
    for r in df.select("c", F.transform("c", T.casefold).alias("f")).collect():
        assert r.f == [c.casefold() for c in r.c]
    texts = ["ΣΑΣ ΟΔΟΣ", "ﬁne ﬂ", "Straße", "İstanbul", "plain ASCII Z", "", "ŉ ǰ և 🙂 Ꭰ"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.casefold(F.col("t")).alias("f")).collect()
    assert [r.f for r in got] == [t.casefold() for t in texts]


def test_rounding_by_the_binary_value(spark):
    pick = random.Random(3)
    values = [0.1234565, 2.5, 3.5, 0.5, 1.5, -2.5, 0.0, -0.0, 1e-9, 5e-7, 2.5e-7, 1e300, 5e-324, 9007199254.740993, 2.0**40 + 0.5, 2.675, 1.005, float("inf"), float("-inf")]
    values += [pick.uniform(-1, 1) * 10.0 ** pick.randint(-8, 12) for _ in range(5_000)]
    values += [(pick.randrange(10**9) * 2 + 1) / 2.0 ** pick.randint(1, 12) for _ in range(2_500)]  # many of them halves of the last place
    values += [round(pick.uniform(0, 1000), 7) // 1e-6 * 1e-6 + 5e-7 for _ in range(2_500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 2, 6):
        for r in df.select("v", T.round_half_even(F.col("v"), digits).alias("r")).collect():
            assert r.r == round(r.v, digits), (r.v, digits)
    assert str(df.limit(0).unionAll(spark.sql("select double('nan')")).select(T.round_half_even(F.col("v"), 2).alias("r")).first().r) == "nan"
    assert spark.sql("select cast(null as double) as v").select(T.round_half_even(F.col("v"), 2).alias("r")).first().r is None

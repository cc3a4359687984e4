import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestry.llm import conversations as C

FITS = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
KEEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def cheapest(rows):
    """(cost, audit, rows left) over all sequences of edits of rows (role, text, fault): every cheapest one is kept till the end."""
    ways = {0: {("", ()): 0}}

    def least(ways):
        return {s: {k: c for k, c in d.items() if c == min(d.values())} for s, d in ways.items()}

    def inserted(ways):
        for _ in range(3):
            for s in list(ways):
                role, to = FITS[s]
                for (audit, out), cost in list(ways[s].items()):
                    key, d = (audit + "I", out + ((role, ""),)), ways.setdefault(to, {})
                    if not audit.endswith("III") and d.get(key, 1e9) > cost + 3:
                        d[key] = cost + 3
        return least(ways)

    ways = inserted(ways)
    for role, text, fault in rows:
        new = {}
        for s, d in ways.items():
            for (audit, out), cost in d.items():
                edits = [(s, "D", out, 4)]
                if fault in ("", "truncated"):
                    more = 3 * bool(fault)
                    if s in KEEPS.get(role[:1], {}):
                        edits.append((KEEPS[role[:1]][s], "K", out + ((role, text),), more))
                    edits.append((FITS[s][1], "R", out + ((FITS[s][0], text),), 3 + more))
                for to, letter, left, c in edits:
                    key = (audit + letter, left)
                    new.setdefault(to, {})[key] = min(cost + c, new.get(to, {}).get(key, 1e9))
        ways = inserted(least(new))
    return min((cost, audit, out) for s in (0, 3) for (audit, out), cost in ways.get(s, {}).items())


def by_hand(rows):
    convs = {}
    for conv, turn, role, text in rows:
        some = lambda v: " " if v is None else str(v)
        kind, role, text = zlib.crc32(f"{some(conv)}:{some(turn)}".encode()) % 20, some(role), some(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip("\x20\t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, left = cheapest([(r, t, f) for (_, r, t), f in zip(own, faults)]) if own else (0, "", ())
        text = "\n".join(f"{r}:{t}" for r, t in left)
        yield conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def alike(df, rows):
    assert df.columns == ["conv_id", *[c.split()[0] for c in C.RESULT.split(", ")]]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, by_hand(rows)))


SCHEMA = "conv_id long, turn long, role string, text string"


def test_whole_table_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    alike(C.op12_repair(spark, "/root/testdata/sf0.1"), [tuple(r) for r in rows])


@pytest.mark.parametrize("seed", range(3))
def test_nulls_ties_repeats_and_odd_roles(spark, seed):
    pick = random.Random(seed).choice
    rows = [(pick([None, *range(60)]), pick([None, *range(9)]), pick(["system", "user", "assistant", "user", "assistant", "tool", "", None]), pick(["a.", "b!", "c", "", "  \t\n", "hi? ", None, "x\ny.", "\u00a0", "ü"])) for _ in range(500)]
    rows += [(1000, k, "user", "." * 100_000) for k in range(3)] + [(1001, 5, "assistant", "same.")] * 40
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as n", "1 as copy", "2 as fault", "3 as digest", "4 as here", "5 as first", "6 as gaps")
    alike(C.repaired(C.damaged(df)), rows)


def test_dropped_and_empty(spark):
    dropped = [(c, 0, "user", "x.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = C.repaired(C.damaged(spark.createDataFrame(dropped, SCHEMA))).collect()
    assert len(got) == len(dropped) > 3
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert C.repaired(C.damaged(spark.createDataFrame([], SCHEMA))).count() == 0


def test_long_conversation_crosses_batches(spark):
    """9,000 turns are several batches: distances are carried over; by hand, a plain table of distances stands in for all the ways."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        pick = random.Random(7).choice
        rows = [(1, k, pick(["user", "assistant", "system"]), pick([f"text {k}.", f"cut {k}", ""])) for k in range(9_000)]
        got = C.repaired(C.damaged(spark.createDataFrame(rows, SCHEMA))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    marked = C.marked(C.damaged(spark.createDataFrame(rows, SCHEMA))).where("role is not null").orderBy("turn", "role", "digest", "copy").collect()
    far = [None] * len(marked) + [list(C.AT_END)]
    for k in range(len(marked) - 1, -1, -1):
        d = [min(c + far[k + 1][to] for _, c, to in C.arcs(marked[k].role[:1], marked[k].fault, s)) for s in C.STATES]
        for _ in range(3):
            d = [min(d[s], 3 + d[FITS[s][1]]) for s in C.STATES]
        far[k] = d
    assert len(got) == 1 and got[0].cost == far[0][0]
    assert len(got[0].audit) - got[0].audit.count("I") == len(marked)


@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.sampled_from([C.SOUND, C.CUT, C.BLANK, C.DUPLICATE])), max_size=7))
@settings(max_examples=200, deadline=None)
def test_buckets_and_walk_find_the_least_of_all_ways(rows):
    names = {C.SOUND: "", C.CUT: "truncated", C.BLANK: "blank", C.DUPLICATE: "duplicate"}
    here = C.dial(rows, C.AT_END)[::-1]
    walk = C._Walk()
    for k, (role, fault) in enumerate(rows):
        walk.row(k, role, "x", fault, here[k])
    got = walk.close()
    cost, audit, left = cheapest([(r, "x", names[f]) for r, f in rows])
    assert (got["cost"], got["audit"]) == (cost, audit)
    assert got["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()

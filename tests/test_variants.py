import copy
import json
import random

from pyspark.sql import functions as F

from attestry.operators import provenance
from attestry.operators import variants as V


def made(rnd, depth=0):
    """A JSON value of any kind."""
    kind = rnd.randrange(8 if depth < 5 else 5)
    if kind < 5:
        return [None, True, rnd.randrange(3), rnd.choice(["", "x", "é.[0]"]), rnd.choice([0.5, 1.0, -2e20])][kind]
    if kind == 5:
        return [made(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    return {k: made(rnd, depth + 1) for k in rnd.sample(["a", "b", "c.d", "é", "path"], rnd.randrange(4))}


def changed(rnd, value):
    """A copy in which fields were dropped, added, retyped or shifted."""
    value = copy.deepcopy(value)
    if rnd.random() < 0.2:
        return made(rnd, 4)
    if isinstance(value, dict):
        for k in list(value):
            if rnd.random() < 0.15:
                del value[k]
            else:
                value[k] = changed(rnd, value[k])
    elif isinstance(value, list):
        value = [changed(rnd, x) for x in value]
        if value and rnd.random() < 0.3:
            value.pop(rnd.randrange(len(value)))
    return value


def kind(v):
    return {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")


def by_hand(path, a, b):
    if kind(a) != kind(b):
        yield path, "retyped"
    elif isinstance(a, dict):
        for k in sorted({*a, *b}):
            if k not in a or k not in b:
                yield f"{path}.{k}", "added" if k in a else "dropped"
            else:
                yield from by_hand(f"{path}.{k}", a[k], b[k])
    elif isinstance(a, list):
        for k in range(max(len(a), len(b))):
            if k >= len(a) or k >= len(b):
                yield f"{path}[{k}]", "added" if k < len(a) else "dropped"
            else:
                yield from by_hand(f"{path}[{k}]", a[k], b[k])
    elif a != b:
        yield path, "changed"


def walked(path, value, key=None):
    yield path, key
    for step, k, x in [(f".{k}", k, x) for k, x in value.items()] if isinstance(value, dict) else [(f"[{k}]", None, x) for k, x in enumerate(value)] if isinstance(value, list) else []:
        yield from walked(path + step, x, k)


def test_walk_and_differences_against_recursion(spark):
    rnd = random.Random(11)
    pairs = [(made(rnd), None) for _ in range(200)]
    pairs = [(a, changed(rnd, a)) for a, _ in pairs]
    df = spark.createDataFrame([(k, json.dumps(a), json.dumps(b)) for k, (a, b) in enumerate(pairs)], "id int, a string, b string")
    rows = df.select("id", F.try_parse_json("a").alias("a"), F.try_parse_json("b").alias("b"))
    rows = rows.select("id", V.differences(F.col("a"), F.col("b"), 8).alias("d"), F.transform(V.nodes(F.col("a"), 8), lambda n: F.struct(n.path, n.key, n.open)).alias("n")).collect()
    some = 0
    for r in rows:
        a, b = pairs[r.id]
        assert sorted((d.path, d.change) for d in r.d) == sorted(by_hand("$", a, b)), (a, b)
        assert sorted((x[0], str(x[1])) for x in r.n) == sorted((p, str(k)) for p, k in walked("$", a)) and not any(x[2] for x in r.n)
        some += bool(r.d)
    assert 50 < some < 200


def test_absent_null_and_what_is_too_deep(spark):
    deep = lambda n, x: json.loads("[" * n + json.dumps(x) + "]" * n)
    pairs = [(None, {"a": 1}), ({"a": 1}, None), (None, None), ({"a": None}, {}), ({"a": None}, {"a": 0}), (deep(5, 1), deep(5, 2)), (deep(5, 1), deep(5, 1))]
    df = spark.createDataFrame([(k, None if a is None else json.dumps(a), None if b is None else json.dumps(b)) for k, (a, b) in enumerate(pairs)], "id int, a string, b string")
    got = df.select("id", V.differences(F.try_parse_json("a"), F.try_parse_json("b"), 3).alias("d")).orderBy("id").collect()
    assert [[tuple(d) for d in r.d] for r in got] == [
        [("$", "dropped", None, '{"a":1}')], [("$", "added", '{"a":1}', None)], [], [("$.a", "added", "null", None)], [("$.a", "retyped", "null", "0")], [("$[0][0][0]", "changed", "[[1]]", "[[2]]")], []]


def test_private_fields_however_deep(spark):
    leaf = {"password": "x", "token": "ghp_" + "a" * 30, "Secret": "", "secret": None, "/home/me": False, "api_key": [], "n": 1}
    nested = leaf
    for k in range(30):
        nested = {"in": nested} if k % 2 else [0, nested]
    path = "$" + "".join(".in" if k % 2 else ".1" for k in reversed(range(30)))
    rows = [(1, json.dumps(nested)), (2, json.dumps(leaf)), (3, "{"), (4, None), (5, '{"a":1,"a":2}'), (6, '"C:/x"'), (7, json.dumps([leaf]))]
    got = {}
    for r in provenance.private_fields(spark.createDataFrame(rows, "id int, json string")).collect():
        got.setdefault(r.id, []).append((r.path, r.reason))
    want = lambda p: sorted([(f"{p}.password", "key"), (f"{p}.token", "value"), (f"{p}./home/me", "name"), (f"{p}.api_key", "key")])
    assert {k: sorted(v) for k, v in got.items()} == {1: want(path), 2: want("$"), 3: [("$", "json")], 5: [("$", "json")], 6: [("$", "value")], 7: want("$.0")}

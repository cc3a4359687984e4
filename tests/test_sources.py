import json

import pytest
from pyspark.sql import functions as F

from attestry.sources import runs, tables
from attestry.streaming import progress


def test_json_lines(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"id": "a", "n": 1}\n\n{"id": "é", "n": null}\n')
    df = tables.read_jsonl(spark, path, "id string, n int")
    assert sorted((r.id, r.n) for r in df.collect()) == [("a", 1), ("é", None)]
    with pytest.raises(Exception, match="malformed"):
        tables.read_jsonl(spark, path, "id string, n int", blank_lines=False).collect()
    out = f"file://{tmp_path}/out"
    tables.write_jsonl(df.coalesce(1), out)
    lines = "".join(p.read_text() for p in (tmp_path / "out").glob("*.json")).splitlines()
    assert {"id": "é", "n": None} in map(json.loads, lines) and "é" in "".join(lines)
    with pytest.raises(Exception, match="already exists"):
        tables.write_jsonl(df, out)
    tables.append_log(df, out)
    assert spark.read.json(out).count() == 4


def test_documents_publishing_and_cases(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"a":\n [1]}')
    assert tables.read_json_document(spark, f"file://{tmp_path}/d.json").first().file == "d.json"
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, ord int")
    target = f"file://{tmp_path}/published"
    with pytest.raises(ValueError):
        tables.publish(df, target, lambda d: d.where("ord = 2"))
    tables.publish(df, target, lambda d: d.where("ord > 2"))
    assert spark.read.parquet(target).count() == 2
    assert [r.id for r in tables.select_cases(df, ["b"]).collect()] == ["b"]
    with pytest.raises(ValueError, match="unknown"):
        tables.select_cases(df, ["z"])
    with pytest.raises(PermissionError):
        tables.select_cases(df, reserved=True)


def arrive(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("id", "n", "out"), r))) for r in rows))


SCHEMA = "id string, n int, out string"


@pytest.mark.parametrize("every", [1, 2, 100])
def test_latest_of_each_case_across_batches_and_restarts(spark, tmp_path, every):
    source, target = tmp_path / "in", f"file://{tmp_path}/t"
    follow = lambda: progress.follow(progress.read_results(spark, f"file://{source}", SCHEMA, files_per_trigger=1), target, f"file://{tmp_path}/c", ["id"], "n", every).awaitTermination()
    table = lambda: sorted((tuple(r) for r in progress.latest(spark, target, ["id"], "n", SCHEMA).collect()), key=str)
    assert table() == []
    arrive(source, "0.json", [("a", 1, "x"), ("a", 2, "y"), (None, 1, "null id")])
    arrive(source, "1.json", [("a", 5, "late"), ("b", 1, "z"), ("b", 1, "z")])
    follow()
    assert table() == sorted([("a", 5, "late"), ("b", 1, "z"), (None, 1, "null id")], key=str)
    arrive(source, "2.json", [("a", 3, "older than the table"), ("c", 1, None), ("b", 1, "zz")])
    follow()  # a new query over the same checkpoint
    want = sorted([("a", 5, "late"), ("b", 1, "zz"), ("c", 1, None), (None, 1, "null id")], key=str)
    assert table() == want
    progress.compact(spark, target, ["id"], "n", SCHEMA)
    progress.tidy(spark, target)
    assert [p.name for p in (tmp_path / "t").iterdir()] == ["base=2"]
    assert table() == want
    follow()  # nothing new
    assert table() == want


def test_a_merge_cut_short_is_not_read(spark, tmp_path):
    target = f"file://{tmp_path}/t"
    arrive(tmp_path / "in", "0.json", [("a", 1, "x")])
    progress.follow(progress.read_results(spark, f"file://{tmp_path}/in", SCHEMA), target, f"file://{tmp_path}/c", ["id"], "n").awaitTermination()
    (tmp_path / "t" / "base=7").mkdir()
    (tmp_path / "t" / "base=7" / "part-0.parquet").write_bytes(b"half")
    assert [tuple(r) for r in progress.latest(spark, target, ["id"], "n", SCHEMA).collect()] == [("a", 1, "x")]


class Killed(Exception):
    pass


PAIRS = "id string, variant string, out string, error string"


def test_a_run_goes_on_where_it_was_killed(spark, tmp_path):
    cases = spark.createDataFrame([(f"c{k}", 9 - k, f"text {k}") for k in range(5)], "id string, ord int, text string")
    calls, folder = [], f"file://{tmp_path}/run"

    def generate(stop):
        def of(pairs):
            rows = pairs.collect()
            if len(calls) + len(rows) > stop:
                raise Killed
            calls.extend((r.id, r.variant) for r in rows)
            return spark.createDataFrame([(r.id, r.variant, None if r.id == "c3" else r.text.upper(), "boom" if r.id == "c3" else None) for r in rows], PAIRS)

        return of

    for stop in (1, 4, 4):
        with pytest.raises(Killed):
            runs.run(cases, ["new", "base"], generate(stop), folder, PAIRS)
        assert len(calls) == stop == runs.results(spark, folder, PAIRS).count()
    (tmp_path / "run" / "next").mkdir()  # as a writer leaves it that dies halfway
    done = runs.run(cases, ["new", "base"], generate(99), folder, PAIRS).collect()
    assert calls == [(f"c{k}", v) for k in (4, 3, 2, 1, 0) for v in ("new", "base")]
    assert {(r.id, r.variant): r.out for r in done} == {(f"c{k}", v): None if k == 3 else f"TEXT {k}" for k in range(5) for v in ("new", "base")}
    runs.run(cases, ["new", "base"], generate(0), folder, PAIRS)  # nothing is left to do
    with pytest.raises(ValueError, match="other cases"):
        runs.run(cases.where("id <> 'c0'"), ["new", "base"], generate(99), folder, PAIRS)


def test_a_run_in_larger_commits_and_what_generate_must_keep(spark, tmp_path):
    cases = spark.createDataFrame([(f"c{k}", k) for k in range(7)], "id string, ord int")
    echo = lambda pairs: pairs.selectExpr("id", "variant", "id as out", "cast(null as string) as error")
    assert runs.run(cases, ["a", "b", "c"], echo, f"file://{tmp_path}/r", PAIRS, size=8).count() == 21
    assert len(list((tmp_path / "r").glob("part=*"))) == 3
    for bad in (lambda p: echo(p).limit(1), lambda p: echo(p).unionAll(echo(p)), lambda p: echo(p).withColumn("variant", F.lit("z"))):
        with pytest.raises(ValueError, match="each of its pairs once"):
            runs.run(cases, ["a", "b"], bad, f"file://{tmp_path}/bad", PAIRS, size=4)
        assert runs.results(spark, f"file://{tmp_path}/bad", PAIRS).count() == 0
    assert runs.run(cases.limit(0), ["a"], echo, f"file://{tmp_path}/none", PAIRS).count() == 0


def test_replay_needs_a_record_that_fits(spark):
    cases = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, chunk int, text string")
    outputs = [("a", 1, "x", "out a"), ("b", 1, "y", None)]
    got = lambda rows: tables.replay(cases, spark.createDataFrame(rows, "id string, chunk int, text string, raw_output string"), ["id", "chunk"], ["text"]).collect()
    assert {r.id: r.raw_output for r in got(outputs)} == {"a": "out a", "b": None}
    for rows, why in ((outputs[:1], "no recorded output"), ([*outputs, ("c", 1, "z", "")], "without a case"), ([*outputs, outputs[0]], "several"), ([outputs[0], ("b", 1, "Y", "out")], "text has changed")):
        with pytest.raises(Exception, match=why):
            got(rows)

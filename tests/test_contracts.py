import json
import random

import pytest
from pyspark.sql import functions as F

from attestry.functions import lexicon as L
from attestry.functions import prompts
from attestry.operators import contracts, corpus, provenance, schema, segment
from attestry.sources import model, synthetic

FACT = {"text": "It stuck.", "evidence": ["stuck"]}
TIP = {"section": "plan", "text": "Consider oil.", "basis": ["stuck"], "confirm": "When?"}


def record(**changes):
    return {"event_type": "other", "sections": {s: [FACT] if s == "action" else [] for s in L.SECTIONS}, "suggestions": [TIP]} | changes


def test_compiled_schemas_name_every_breach(spark):
    sections = lambda **k: record(sections=record()["sections"] | k)
    cases = [
        (record(), []), ({**record(), "extra": 1}, ["$.extra unknown"]), (record(event_type="x"), ["$.event_type value"]), (record(event_type=1), ["$.event_type type"]), (record(suggestions=[TIP] * 7), ["$.suggestions most"]),
        (record(suggestions={}), ["$.suggestions type"]), (record(suggestions=[TIP | {"section": "action", "confirm": "x" * 301}, {**TIP, "n": 0}]), ["$.suggestions[0].confirm most", "$.suggestions[1].n unknown"]),
        (sections(plan=None), ["$.sections.plan type"]), (sections(other=[]), ["$.sections.other unknown"]), (sections(plan=[FACT] * 13), ["$.sections.plan most"]), (sections(plan=[{"text": "", "evidence": []}]), ["$.sections.plan[0].text least", "$.sections.plan[0].evidence least"]),
        (sections(plan=[{"text": "é" * 1200, "evidence": ["q" * 1601, ""]}, 3]), ["$.sections.plan[0].evidence[0] most", "$.sections.plan[0].evidence[1] least", "$.sections.plan[1] type"]),
        (sections(plan=[{"text": "x", "evidence": ["q"] * 64}]), []), (sections(plan=[{"text": "x", "evidence": ["q"] * 65}]), ["$.sections.plan[0].evidence most"]), ([record()], ["$ type"]), (None, ["$ type"]),
        ({k: v for k, v in record().items() if k != "sections"}, ["$.sections missing"]),
    ]
    rows = [(k, json.dumps(c)) for k, (c, _) in enumerate(cases)] + [(90, "{"), (91, None), (92, " \n" + json.dumps(record()) + "\n"), (93, '{"event_type": "other", "event_type": "other"}')]
    got = {r.id: r.e for r in spark.createDataFrame(rows, "id int, raw string").select("id", schema.errors(F.col("raw"), schema.RECORD).alias("e")).collect()}
    for k, (_, want) in enumerate(cases):
        assert sorted(got[k]) == sorted(want)
    assert got[90] == got[91] == got[93] == ["$ type"] and got[92] == []
    other = {"object": {"ok": {"is": True}, "n": {"whole": 1}, "x": {"any": None}}}
    rows = [('{"ok": true, "n": 2, "x": null}', []), ('{"ok": false, "n": 0, "x": 1}', ["$.ok value", "$.n least"]), ('{"ok": "true", "n": 1.5}', ["$.ok type", "$.n type", "$.x missing"]), ('{"ok": true, "n": 1.0, "x": {}}', [])]
    df = spark.createDataFrame([(r,) for r, _ in rows], "raw string").select(schema.errors(F.col("raw"), other).alias("e"))
    assert [r.e for r in df.collect()] == [w for _, w in rows]


def test_checks_without_a_label_are_about_the_whole_note(spark):
    notes = spark.createDataFrame([(1, "The door stuck.\nAll quiet."), (2, "Loose words.\nEVENT: Door\nstuck")], "id int, text string")
    groups = segment.event_groups(notes)
    checks = [(1, 0, None, ["QUIET"], []), (1, 1, None, ["lamp"], []), (1, 2, "Supplied notes", ["door"], []), (2, 3, None, ["stuck"], []), (2, 4, " DOOR", ["stuck"], []), (2, 5, "Unassigned context", ["loose"], []), (3, 6, None, [], ["x"])]
    df = spark.createDataFrame(checks, "id int, ord int, label string, required array<string>, forbidden array<string>")
    want = [(1, "absent"), (2, "label"), (3, "label"), (5, "label"), (6, "label")]
    assert sorted((r.ord, r.error) for r in contracts.unsupported_checks(df, groups).collect()) == want
    plain = groups.select("id", F.when(F.col("grouping") == "explicit", F.col("label")).alias("label"), "source_text").where("label is not null or id = 1")
    assert sorted((r.ord, r.error) for r in contracts.unsupported_checks(df, plain).collect()) == want


def test_chats_of_a_curriculum_and_what_changes_in_them(spark):
    rows = synthetic.curriculum(spark, [f"train {k}" for k in range(3)], ["later 0"], ["train 1"]).cache()
    check = lambda df: contracts.chat_errors(df, synthetic.MAIN_PROMPT, synthetic.HELPER_PROMPT)
    assert check(rows).where("size(errors) > 0").count() == 0
    chats = [r.asDict(recursive=True) for r in [*rows.where("task = 'main'").limit(1).collect(), *rows.where("task = 'helper' and size(focus) = 1 and size(suggestions) = 1").limit(1).collect()]]
    main, helper = chats
    asked = json.loads(helper["messages"][1]["content"])
    message = lambda row, k, text: {**row, "messages": [m if n != k else {**m, "content": text} for n, m in enumerate(row["messages"])]}
    target = json.loads(main["expected"])
    cases = [
        (main, []), (helper, []), (message(main, 0, "Another prompt."), ["prompt contract"]), ({**main, "mode": "review" if main["mode"] == "draft" else "draft"}, ["prompt contract"]), ({**main, "source": main["source"] + " "}, ["prompt contract"]),
        (message(main, 2, json.dumps({**target, "event_type": "conversation"})), ["target differs from expected"]), (message(main, 2, json.dumps(target, indent=2)), []), ({**main, "messages": main["messages"][:2]}, ["target differs from expected", "prompt contract"]),
        ({**main, "messages": []}, ["target differs from expected", "prompt contract"]), ({**main, "expected": "{}"}, ["schema", "target differs from expected"]), ({**helper, "source": "other"}, ["helper source", "prompt contract"]),
        (message(helper, 1, json.dumps({**asked, "focus_sections": []}, ensure_ascii=False, separators=(", ", ": "))), ["prompt contract", "outside the focus"]), (message(helper, 1, "no json"), ["helper source", "prompt contract", "outside the focus"]),
    ]
    df = spark.createDataFrame([{**row, "id": f"{k:02d}"} for k, (row, _) in enumerate(cases)], rows.schema)
    got = {r.id: r.errors for r in check(df).collect()}
    for k, (_, want) in enumerate(cases):
        assert got[f"{k:02d}"] == want, k
    rows.unpersist()


@pytest.mark.parametrize("budgets", [(10_000, 60), (90, 10_000), (70, 45), (10_000, 10_000)])
def test_two_budgets(spark, budgets):
    rnd = random.Random(5)
    words = lambda n: " ".join(rnd.choice(["ab", "c", "d-e"]) for _ in range(n))
    rows = [(k, words(rnd.randint(1, 20)), [words(rnd.randint(1, 15)) for _ in range(rnd.randint(0, 9))]) for k in range(60)] + [(100, words(200), ["a"]), (101, "x", None), (102, None, ["a"])]
    build = lambda row, some: ("\n".join([row["note"] or "", *some]), "ask: " + "\n".join([row["note"] or "", *some, *some[:1]]))
    count = lambda text: len(text.replace("-", " - ").split())
    df = spark.createDataFrame(rows, "id int, note string, paragraphs array<string>")
    got = {r.id: r for r in model.assemble(df, lambda: lambda text: len(text.replace("-", " - ").split()), build, budgets).collect()}
    fits = lambda row, n: count(build(row, row["paragraphs"][:n])[1]) <= budgets[0] and count(build(row, row["paragraphs"][:n])[0]) <= budgets[1]
    assert len(got) == len(rows)
    for k, note, some in rows:
        row, r = {"note": note, "paragraphs": some or []}, got[k]
        if not fits(row, 0):
            assert r.source is None and "over a budget" in r.error
            continue
        # Neither budget is exceeded, and with one more paragraph one would be.
        assert fits(row, r.n_paragraphs) and (r.n_paragraphs == len(row["paragraphs"]) or not fits(row, r.n_paragraphs + 1))
        assert (r.source, r.source_tokens, r.chat_tokens) == (build(row, row["paragraphs"][: r.n_paragraphs])[0], count(r.source), count(build(row, row["paragraphs"][: r.n_paragraphs])[1])) and r.error is None
    assert got[100].error is None or min(budgets) < 300


def test_medians_over_ranges_and_fingerprints_of_two_levels(spark):
    rnd = random.Random(9)
    for n in (0, 1, 2, 7, 500):
        values = [rnd.choice([0.0, 1.0, 0.5, 0.8, rnd.random(), rnd.randrange(9) / 9]) for _ in range(n)]
        row = corpus.nearest_summary(spark.createDataFrame([(v,) for v in values], "similarity double")).first()
        assert tuple(row[:4]) == (n, max(values, default=None), sum(v >= 0.5 for v in values), sum(v >= 0.8 for v in values))
        assert row.median == (sorted(values)[n // 2] if n else None)
    files = spark.createDataFrame([(f"f{k}", f"{k:064x}") for k in range(300)], "file string, sha256 string")
    one = provenance.tree_fingerprint(files).first()
    assert one.n_files == 300 and one == provenance.tree_fingerprint(files.repartition(7)).first()
    assert provenance.tree_fingerprint(files.where("file <> 'f7'")).first().fingerprint != one.fingerprint
    assert provenance.tree_fingerprint(files.limit(0)).first().n_files == 0
    assert prompts.json_text is synthetic.json_text


def test_passages_of_any_length_against_a_scan(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 4)))
    texts = [(k, "".join(word() + rnd.choice([" ", "  ", "\n", " "]) for _ in range(rnd.randint(0, 12)))) for k in range(80)] + [(80, None), (81, ""), (82, "   ")]
    passages = [" ", "\n", "  ", "", "a", "é", "ab", " a", "a ", "a b", "b\na", "a  b", " ab ", "abab", "zz", "zz a", "a b a", "ba é ab a"]
    for _ in range(40):
        t = rnd.choice(texts[:80])[1]
        at = rnd.randrange(max(1, len(t)))
        passages.append(t[at : at + rnd.randint(1, 12)])
    df = spark.createDataFrame(texts, "id int, text string")
    got = {(r.text_id, r.passage_id) for r in corpus.contained(df, spark.createDataFrame(list(enumerate(passages)), "id int, text string")).collect()}
    assert got == {(k, n) for k, t in texts for n, p in enumerate(passages) if t and p and p in t}
    with pytest.raises(ValueError, match="white space"):
        corpus.contained(df, spark.createDataFrame([(1, " "), (2, "  ")], "id int, text string"), blank=1)

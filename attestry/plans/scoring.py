"""Queries that score outputs of runs. The tables hold none, so each row of a whole table is made into one by a rule that the SQL states too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import lexicon as L
from attestry.functions import prompts
from attestry.operators import contracts, intervals, raw, saved, segment
from attestry.plans.drafts import _CASES, _GROUPS, _TURNS, _id, _inspected, _notes, _turns
from attestry.plans.registry import query, table


def _record(situation: Column, action: Column, basis: Column | None) -> Column:
    """A raw text of the main model: a fact of two quotes, one of one, and perhaps a suggestion."""
    fact = lambda q: F.array(F.struct(F.lit("Said.").alias("text"), q.alias("evidence")))
    none = F.expr("cast(array() as array<struct<text:string,evidence:array<string>>>)")
    tips = F.array(F.struct(F.lit("plan").alias("section"), F.lit("Consider it.").alias("text"), F.array(basis).alias("basis"), F.lit("When?").alias("confirm"))) if basis is not None else F.expr("cast(array() as array<string>)")
    sections = F.struct(*[(fact(situation) if s == "situation" else fact(action) if s == "action" else none).alias(s) for s in L.SECTIONS])
    return F.to_json(F.struct(F.lit("other").alias("event_type"), sections.alias("sections"), tips.alias("suggestions")))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raw outputs for each turn with one before it, the second cut for every third, and helper outputs of four kinds."""
    start = lambda c, n: F.left(F.col(c), F.lit(n))
    one = _record(F.array(start("text", 8), F.lit("zz zz")), F.array(start("text", 2)), None)
    two = _record(F.array(start("text", 4)), F.array(start("before", 5)), start("text", 3))
    tip = F.struct(F.lit("plan").alias("section"), F.lit("Consider it.").alias("text"), F.array(start("before", 4)).alias("basis"), F.lit("When?").alias("confirm"))
    helper = F.to_json(F.struct(F.array(tip).alias("suggestions")))
    kind = F.col("turn") % 4
    result = F.when(kind == 0, '{"coaching_outputs": {"a": 1}}').when(kind == 1, F.to_json(F.struct(F.array(helper).alias("coaching_outputs")))).when(kind == 2, '{"coaching_outputs": [5]}').otherwise("{}")
    cut = F.when(F.col("turn") % 3 == 2, F.left(two, F.lit(20))).otherwise(two)
    return _turns(spark, sf_dir).where("before is not null").select(_id(), F.col("text").alias("cleaned"), F.array(one, cut).alias("raw_outputs"), result.alias("result"))


_RUNS = f"""{_TURNS}, c AS (SELECT conv_id, turn, text, before, text <> '' AS one, text <> '' AND before <> '' AND turn % 3 <> 2 AS two, turn % 4 AS kind, contains(text, 'zz zz')::INT AS zz, contains(text, left(before, 5))::INT AS five, contains(text, left(before, 4))::INT AS four FROM t WHERE before IS NOT NULL),
s AS (SELECT *, CASE WHEN one THEN 3 ELSE 0 END + CASE WHEN two THEN 2 ELSE 0 END AS facts, CASE WHEN one THEN 2 + zz ELSE 0 END + CASE WHEN two THEN 1 + five ELSE 0 END AS supported, two::INT AS basis, (kind = 1 AND before <> '')::INT AS helped, (kind IN (1, 2))::INT AS emitted FROM c)"""
_RAW = {
    "raw_outputs_valid": ("sum(one::INT + two::INT)", "2 * count(*)"), "raw_outputs_excluded": ("sum(2 - one::INT - two::INT)", "2 * count(*)"), "raw_fact_quotes_in_source": ("sum(supported)", "sum(facts)"), "raw_suggestion_quotes_in_source": ("sum(basis)", "sum(basis)"),
    "cases_with_unsupported_raw_facts": ("count(*) FILTER (supported < facts)", "count(*)"), "cases_with_unsupported_raw_basis": ("0", "count(*)"), "helper_outputs_valid": ("sum(helped)", "sum(emitted)"), "helper_outputs_excluded": ("sum(emitted - helped)", "sum(emitted)"),
    "helper_quotes_in_source": ("sum(helped * four)", "sum(helped)"), "cases_with_helper_outputs": ("sum(emitted)", "count(*)"), "cases_with_invalid_helper_outputs": ("sum(emitted - helped)", "count(*)"), "cases_with_unsupported_helper_basis": ("sum(helped * (1 - four))", "count(*)"), "cases_with_bad_helper_lists": ("count(*) FILTER (kind = 0)", "count(*)"),
}
_RAW_ROWS = " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({n} AS BIGINT) AS numerator, CAST({d} AS BIGINT) AS denominator FROM s" for m, (n, d) in _RAW.items())


@query(f"WITH {_RUNS}, m AS ({_RAW_ROWS}) SELECT metric, numerator, denominator, CASE WHEN denominator > 0 THEN numerator / denominator END AS share FROM m")
def raw_output_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _runs(spark, sf_dir)
    return raw.summarise(raw.score_outputs(cases), cases)


@query(f"""WITH {_RUNS} SELECT conv_id, turn, 'chunk' AS kind, 2 AS emitted, CAST(one::INT + two::INT AS BIGINT) AS valid, facts AS facts_checked, CAST(facts - supported AS BIGINT) AS facts_unsupported, basis AS basis_checked, 0 AS basis_unsupported FROM s
UNION ALL SELECT conv_id, turn, 'helper', 1, helped, 0, 0, helped, helped * (1 - four) FROM s WHERE emitted = 1""")
def raw_outputs_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.by_case(raw.score_outputs(_runs(spark, sf_dir))).select("id.conv_id", "id.turn", "kind", "emitted", "valid", "facts_checked", "facts_unsupported", "basis_checked", "basis_unsupported")


@query(f"""WITH {_CASES}, k AS (SELECT count(*) AS attempted, count(*) FILTER (valid) AS cases_screened, count(*) FILTER (valid) AS phrases_screened, count(*) FILTER (hit) AS cases_with_hits,
CAST(coalesce(sum(CASE WHEN hit THEN 2 ELSE 0 END), 0) AS BIGINT) AS phrase_section_hits, count(*) FILTER (bad = 1) AS incomplete_cases, count(*) FILTER (failed) AS pipeline_errors FROM r)
SELECT (SELECT count(*) FROM conversations) AS selected, *, (SELECT count(*) FROM conversations) - attempted AS remaining FROM k""")
def lexical_screen_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.lexical_counts(_inspected(spark, sf_dir), _turns(spark, sf_dir).select(_id()))


@query(f"""WITH {_GROUPS}, s AS (SELECT conv_id, role, turn, begin, n, text, begin - sum(n + 1) OVER (PARTITION BY conv_id, role ORDER BY turn) + n + 1 AS shift FROM g),
u AS (SELECT conv_id, role, count(*) AS parts, string_agg(left(text || chr(10), n::INT), chr(10) ORDER BY turn) AS body FROM s GROUP BY 1, 2),
o AS (SELECT conv_id, role, unnest(list_filter(range(0, length(body)), lambda i: substr(body, (i + 1)::INT, 1) = chr(10))) AS at FROM u),
p AS (SELECT o.conv_id, o.role, o.at, s.shift + o.at AS place FROM o JOIN s ON o.conv_id = s.conv_id AND o.role = s.role AND o.at >= s.begin - s.shift AND o.at < s.begin - s.shift + s.n)
SELECT conv_id, 'event-' || k AS event_id, count(place) AS n_places, count(place) > 1 AS ambiguous, CAST(min(place) AS BIGINT) AS first_at, CAST(max(place) AS BIGINT) AS last_at, CAST(sum(place) AS BIGINT) AS total FROM k LEFT JOIN p USING (conv_id, role) GROUP BY conv_id, k""")
def revisited_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line feed of each role's joined turns, in offsets of the whole conversation: those that only join turns have no place."""
    groups = segment.event_groups(_notes(spark, sf_dir))
    found = intervals.locate(groups, groups.select("id", "event_id", F.lit("\n").alias("quote")))
    places = F.transform("candidates", lambda c: F.get(c.segments, F.lit(0)).start.cast("long"))
    return found.select(F.col("id").alias("conv_id"), "event_id", F.size("candidates").cast("long").alias("n_places"), "ambiguous", F.array_min(places).alias("first_at"), F.array_max(places).alias("last_at"),
                        F.when(F.size(places) > 0, F.aggregate(places, F.lit(0).cast("long"), lambda a, b: a + b)).alias("total"))


_NOBODY = "struct<text:string,evidence:array<string>>"


def _result(text: Column) -> Column:
    """A sound record with one fact, whose quote no note has."""
    none = F.expr(f"cast(array() as array<{_NOBODY}>)")
    sections = F.struct(*[(F.array(F.struct(text.alias("text"), F.array(F.lit("zz zz")).alias("evidence"))) if s == "situation" else none).alias(s) for s in L.SECTIONS])
    empty = F.expr("cast(array() as array<string>)")
    return F.struct(F.lit("other").alias("event_type"), sections.alias("sections"), empty.alias("suggestions"), F.array(*[F.lit(s) for s in L.SECTIONS[1:]]).alias("missing_fields"), F.lit("needs_confirmation").alias("status"),
                    empty.alias("issues"), none.alias("review_excerpts"), F.lit(True).alias("human_approval_required"))


def _saved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Outputs of two variants for each conversation: a record for each role, of every third with a wrong label, of the next with a wrong count; and a flat one."""
    cases = _notes(spark, sf_dir).withColumnRenamed("text", "source_text")
    note = F.concat(F.col("label"), F.lit(" note"))
    quoted = F.struct(F.lit("zz zz").alias("quote"), F.array().alias("candidates"), F.lit(False).alias("ambiguous"))
    entry = F.struct(F.lit("fact").alias("kind"), F.lit("situation").alias("section"), F.lit(0).alias("index"), note.alias("text"), F.array(quoted).alias("quotes"))
    number = F.substring_index("event_id", "-", -1).cast("int")
    label = F.when((F.col("id") % 3 == 0) & (number == 1), "x").otherwise(F.col("label"))
    event = F.struct(number.alias("n"), "event_id", label.alias("label"), "grouping", "source_text", "source_segments", _result(note).alias("result"), F.array(entry).alias("source_evidence"))
    events = segment.event_groups(_notes(spark, sf_dir)).groupBy("id").agg(F.array_sort(F.collect_list(event)).alias("event_results"))
    count = F.when(F.col("id") % 3 == 1, 9).otherwise(F.size("event_results"))
    flat = _result(F.lit("user note"))
    whole = F.to_json(F.struct(*[flat[c].alias(c) for c in ("event_type", "sections", "suggestions", "missing_fields", "status", "issues", "review_excerpts", "human_approval_required")], count.alias("event_count"), "event_results"))
    done = lambda variant, result: F.struct(F.lit(variant).alias("variant"), result.alias("result"), F.lit(None).cast("string").alias("error"), F.lit(1.0).alias("seconds"))
    outputs = events.select("id", F.inline(F.array(done("events", whole), done("flat", F.to_json(flat)))))
    check = F.struct(F.lit("Assistant").alias("event_label"), F.lit("situation").alias("section"), F.array(F.lit("USER note")).alias("required_fragments"), F.array(F.lit("assistant")).alias("forbidden_fragments"), F.lit("").alias("review_note"))
    wanted = F.struct(F.lit(2).alias("event_count"), F.array(F.lit("User"), F.lit("assistant")).alias("expected_event_labels"), F.array(check).alias("checks"))
    return outputs, cases.withColumn("expectations", wanted)


_SAVED = f"""{_GROUPS}, c AS (SELECT conv_id, list(role ORDER BY k) AS roles FROM k GROUP BY 1),
e AS (SELECT conv_id, roles, CASE WHEN conv_id % 3 = 0 THEN list_concat(['x'], roles[2:]) ELSE roles END AS shown FROM c),
i AS (SELECT conv_id, 'events' AS variant, false AS complete, shown = ['user', 'assistant'] AS labels_match, len(roles) = 2 AS count_match, CASE WHEN conv_id % 3 = 0 THEN 'event_results[0].label changed' WHEN conv_id % 3 = 1 THEN '$.event_count value' ELSE '' END AS errors,
 CAST(len(roles) AS BIGINT) AS n_issues, 1 AS n_missing, list_contains(shown, 'assistant')::INT AS n_hits, 1 - list_contains(roles, 'user')::INT AS n_global FROM e
 UNION ALL SELECT conv_id, 'flat', true, NULL, NULL, '', 0, NULL, NULL, 0 FROM e)"""


@query(f"WITH {_SAVED} SELECT * FROM i")
def event_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs, cases = _saved(spark, sf_dir)
    found = saved.inspect(outputs, cases, ["events"])
    check = F.get("checks", F.lit(0))
    size = lambda c: F.when(c.isNotNull(), F.size(c)).cast("long")
    return found.select(F.col("id").alias("conv_id"), "variant", "complete", "labels_match", "count_match", F.array_join("structure_errors", "|").alias("errors"), F.size("quote_issues").cast("long").alias("n_issues"),
                        size(check.missing).alias("n_missing"), size(check.hits).alias("n_hits"), size(check.global_missing).alias("n_global"))


@query(f"""WITH {_SAVED} SELECT variant, count(*) AS attempted, count(*) FILTER (complete) AS complete_structured_outputs, count(*) FILTER (NOT labels_match) AS explicit_label_mismatches, count(*) FILTER (n_issues > 0) AS cases_with_event_quote_issues,
count(*) FILTER (n_global > 0) AS cases_with_missing_global_fragments, count(*) FILTER (n_missing > 0 OR n_hits > 0) AS cases_with_missing_or_forbidden_scoped_fragments, CAST(count(*) AS DOUBLE) AS seconds FROM i GROUP BY 1""")
def scores_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs, cases = _saved(spark, sf_dir)
    return saved.summarise(saved.inspect(outputs, cases, ["events"]))


@query(f"""WITH {_SAVED} SELECT conv_id, k AS position, role AS expected, CASE WHEN conv_id % 3 = 0 AND k = 1 THEN 'x' ELSE role END AS actual, CASE WHEN conv_id % 3 = 0 AND k = 1 THEN 'malformed' ELSE 'matched' END AS outcome FROM k""")
def event_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs, cases = _saved(spark, sf_dir)
    found = saved.group_outcomes(outputs.where("variant = 'events'"), cases)
    return found.select(F.col("id").alias("conv_id"), "position", "expected", "actual", "outcome")


@query("""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN turn = 6 THEN 'schema' END, CASE WHEN turn = 3 THEN 'target differs from expected' END, CASE WHEN turn = 7 THEN 'helper source' END,
 CASE WHEN turn IN (2, 4, 7) THEN 'prompt contract' END, CASE WHEN turn = 5 THEN 'outside the focus' END], lambda x: x IS NOT NULL), '|') AS errors FROM conversations""")
def prompt_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats of a main row for each even turn and a helper row for each odd one; those of turns 2 to 7 are changed in a way each."""
    turn, source = F.col("turn"), F.col("text")
    result = _result(F.lit("Said."))
    whole = F.to_json(F.struct(*[result[c].alias(c) for c in ("event_type", "sections", "suggestions")]))
    tip = F.struct(F.lit("plan").alias("section"), F.lit("Consider it.").alias("text"), F.array(F.lit("a")).alias("basis"), F.lit("When?").alias("confirm"))
    expected = F.when(turn == 6, "{}").when(turn % 2 == 0, whole).otherwise(F.to_json(F.struct(F.array(tip).alias("suggestions"))))
    facts = F.array(F.struct(F.lit("action").alias("section"), source.alias("text")))
    main = prompts.messages("Other words.", F.lit("draft"), source), prompts.messages("Sort it.", F.lit("draft"), source)
    focus = F.when(turn == 5, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("plan")))
    helper = prompts.helper_messages("Suggest.", F.when(turn == 7, F.concat(source, F.lit("."))).otherwise(source), focus, prompts.facts_by_section(facts))
    chat = F.when(turn == 2, main[0]).when(turn % 2 == 0, main[1]).otherwise(helper)
    answer = F.struct(F.lit("assistant").alias("role"), F.when(turn == 3, '{"a": 1}').otherwise(expected).alias("content"))
    rows = table(spark, sf_dir, "conversations").select(
        _id(), F.when(turn % 2 == 0, "main").otherwise("helper").alias("task"), F.when(turn == 4, "review").otherwise("draft").alias("mode"), source.alias("source"), expected.alias("expected"), F.array_append(chat, answer).alias("messages"))
    return contracts.chat_errors(rows, "Sort it.", "Suggest.").select("id.conv_id", "id.turn", F.array_join("errors", "|").alias("errors"))

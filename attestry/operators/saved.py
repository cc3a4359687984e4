"""Saved results of runs scored against what their sources give: structure, places of evidence, screens that may not apply.

A variant's results are either flat (one record for a note) or event-aware (a record for each event of the note). Nothing that
a result says of its source is believed: events, offsets, lines and ambiguity are computed anew and compared path by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import lexicon as L
from attestry.functions import text as T
from attestry.operators import evaluate, intervals, schema, segment
from attestry.operators import variants as V

#: Statuses of a result, and what an event says of its source.
STATUSES = ("needs_confirmation", "ready_for_human_review", "incomplete_draft")
IDENTITY = ("event_id", "label", "grouping", "source_text", "source_segments")

CHECK = "struct<event_label:string,section:string,required_fragments:array<string>,forbidden_fragments:array<string>,review_note:string>"
EXPECTATIONS = f"struct<event_count:int,expected_event_labels:array<string>,checks:array<{CHECK}>>"


def _texts(*parts: Column) -> Column:
    return F.concat(F.expr("cast(array() as array<string>)"), *parts)


def _when(bad: Column, text: Column | str) -> Column:
    """A text where ``bad`` holds or can't be told."""
    return F.when(F.coalesce(bad, F.lit(True)), F.array(F.lit(text) if isinstance(text, str) else text)).otherwise(_texts())


def _said(found: Column) -> Column:
    """Breaches as texts."""
    return F.transform(found, lambda b: F.concat(b.path, F.lit(" "), b.rule))


def _string(v: Column) -> Column:
    """A variant's text, null if it is none."""
    return F.when(F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)), F.try_variant_get(v, "$", "string"))


def _listed(v: Column) -> Column:
    return F.coalesce(V.items(v), F.expr("cast(array() as array<variant>)"))


def result_errors(v: Column) -> Column:
    """Breaches of an assembled result, as an array of texts: its type, sections and their facts, suggestions, status, issues, missing fields."""
    sections = V.at(v, "sections")
    named = F.array(*[F.struct(F.lit(s).alias("name"), V.at(sections, s).alias("value")) for s in L.SECTIONS])
    facts = F.flatten(F.transform(named, lambda x: _said(schema.breaches(x.value, {"list": schema.FACT}, F.concat(F.lit("$.sections."), x["name"])))))
    keyed = F.array_sort(F.map_keys(V.fields(sections))) == F.array(*[F.lit(s) for s in sorted(L.SECTIONS)])
    empty = F.array_sort(F.transform(F.filter(named, lambda x: F.size(V.items(x.value)) == 0), lambda x: x["name"]))
    stated = V.items(V.at(v, "missing_fields"))
    told = F.array_sort(F.array_distinct(F.transform(stated, _string)))
    all_lists = F.forall(named, lambda x: V.items(x.value).isNotNull())
    approved = F.when(F.coalesce(F.schema_of_variant(V.at(v, "human_approval_required")) == "BOOLEAN", F.lit(False)), F.try_variant_get(v, "$.human_approval_required", "boolean"))
    checks = _texts(
        _when(~_string(V.at(v, "event_type")).isin(*L.EVENT_TYPES), "$.event_type value"),
        F.when(F.coalesce(keyed, F.lit(False)), facts).otherwise(F.array(F.lit("$.sections keys"))),
        _said(schema.breaches(V.at(v, "suggestions"), {"list": schema.SUGGESTION}, F.lit("$.suggestions"))),
        _when(~_string(V.at(v, "status")).isin(*STATUSES), "$.status value"),
        _when(~approved, "$.human_approval_required value"),
        _when(V.items(V.at(v, "issues")).isNull(), "$.issues type"),
        F.when(all_lists, _when(~told.eqNullSafe(empty), "$.missing_fields value")).otherwise(_texts()))
    return F.when(V.fields(v).isNull(), F.array(F.lit("$ type"))).otherwise(checks)


def _facts(nested: Column) -> Column:
    """(section, text) of the facts of a result that have a text, which is case folded."""
    named = F.array(*[F.struct(F.lit(s).alias("section"), V.at(V.at(nested, "sections"), s).alias("value")) for s in L.SECTIONS])
    facts = F.flatten(F.transform(named, lambda s: F.transform(_listed(s.value), lambda x: F.struct(s.section.alias("section"), T.casefold(_string(V.at(x, "text"))).alias("text")))))
    return F.filter(facts, lambda x: x.text.isNotNull())


def _entries(nested: Column) -> Column:
    """All that cites the source in a result: (kind, section, index, key, item), in order."""
    item = lambda kind, section, key: lambda x, k: F.struct(F.lit(kind).alias("kind"), section(x).alias("section"), k.alias("index"), V.at(x, key).alias("quotes"), V.at(x, "text").alias("text"))
    name = lambda s: lambda x: F.parse_json(F.lit(f'"{s}"'))
    own = lambda x: F.coalesce(V.at(x, "section"), name("invalid")(x))
    facts = [F.transform(_listed(V.at(V.at(nested, "sections"), s)), item("fact", name(s), "evidence")) for s in L.SECTIONS]
    return F.concat(*facts, F.transform(_listed(V.at(nested, "suggestions")), item("suggestion", own, "basis")), F.transform(_listed(V.at(nested, "review_excerpts")), item("review_excerpt", name("unassigned"), "evidence")))


def _located(group: Column, starts: Column, quote: Column) -> Column:
    """A quote with its places in an event, by offset and line of the note."""
    line = lambda at: T.first_index(F.size(starts), lambda k: F.get(starts, k) > at)
    span = lambda s: F.struct(s.start, s.end, line(s.start).alias("line_start"), line(F.greatest(s.start, s.end - 1)).alias("line_end"))
    places = F.transform(intervals.candidates(group.source_text, group.source_segments, quote), lambda c: F.struct(F.transform(c.segments, span).alias("segments")))
    return T.let(places, lambda p: F.struct(quote.alias("quote"), p.alias("candidates"), (F.size(p) > 1).alias("ambiguous")))


def _whole(value: Column) -> Column:
    """A struct as a variant, with its null fields."""
    return F.parse_json(F.to_json(value, {"ignoreNullFields": "false"}))


def source_groups(cases: DataFrame) -> DataFrame:
    """id, groups, group_error, starts of ``cases`` (id, source_text): the events that the source gives, and where its lines begin."""
    notes = cases.select("id", F.col("source_text").alias("text"))
    number = F.substring_index("event_id", "-", -1).cast("int")
    group = F.when(F.col("error").isNull(), F.struct(number.alias("number"), *IDENTITY))
    found = segment.event_groups(notes).groupBy("id").agg(F.array_sort(F.collect_list(group)).alias("groups"), F.max("error").alias("group_error"))
    lengths = F.transform(T.lines(F.coalesce("text", F.lit(""))), F.length)
    starts = notes.select("id", T.let(T.running(lengths), lambda r: F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(1)))).alias("starts"))
    return found.join(starts, "id")


def event_rows(outputs: DataFrame, cases: DataFrame) -> DataFrame:
    """id, variant, k, label, grouping, status, errors, quote_issues, facts, n_excerpts, n_suggestions of each event of event-aware results.

    ``outputs``: id, variant, result (JSON); ``cases``: id, source_text. errors name every path at which an event differs from what its source
    gives: its identity and segments, the structure of its record, the places of its evidence (all occurrences, in order).
    A result without a list of events has no rows.
    """
    parsed = outputs.select("id", "variant", F.try_parse_json("result").alias("v")).join(source_groups(cases), "id")
    each = parsed.select("id", "variant", "groups", "starts", F.posexplode(V.items(V.at(F.col("v"), "event_results"))).alias("k", "event"))
    each = each.select("id", "variant", "k", "event", F.get("groups", F.col("k")).alias("group"), "starts", V.at(F.col("event"), "result").alias("nested"))
    event, group, nested = F.col("event"), F.col("group"), F.col("nested")
    entries = F.transform(_entries(nested), lambda e: F.struct(e.kind, e.section, e.index, e.text, F.transform(V.items(e.quotes), _string).alias("quotes")))
    each = each.withColumn("entries", entries)
    usable = lambda e: F.coalesce((F.size(e.quotes) > 0) & F.forall(e.quotes, lambda q: q.isNotNull() & (q != "")), F.lit(False))
    null = F.parse_json(F.lit("null"))
    wanted = F.transform(F.filter("entries", usable), lambda e: F.struct(
        e.kind, e.section, e.index, F.coalesce(e.text, null).alias("text"), F.transform(e.quotes, lambda q: _located(group, F.col("starts"), q)).alias("quotes")))
    each = each.withColumn("wanted", F.when(group.isNotNull(), wanted))
    prefix = F.concat(F.lit("event_results["), F.col("k").cast("string"), F.lit("]"))
    differing = lambda name, found: F.transform(found, lambda d: F.concat(prefix, F.lit(f".{name}"), F.substring(d.path, 2, 1 << 30), F.lit(" "), d.change))
    true = _whole(F.struct(*[group[c].alias(c) for c in IDENTITY]))
    identity = [differing(c, V.differences(V.at(event, c), V.at(true, c), 2 if c == "source_segments" else 0)) for c in IDENTITY]
    evidence = differing("source_evidence", V.differences(V.at(event, "source_evidence"), _whole(F.col("wanted")), 9))
    excerpts = _said(schema.breaches(V.at(nested, "review_excerpts"), {"list": schema.FACT}, F.lit("$.review_excerpts")))
    own = F.transform(_texts(result_errors(nested), excerpts), lambda e: F.concat(prefix, F.lit(".result"), F.substring(e, 2, 1 << 30)))
    errors = F.when(V.fields(event).isNull(), F.array(F.concat(prefix, F.lit(" type")))).otherwise(_texts(own, F.when(group.isNotNull(), F.concat(*identity, evidence)).otherwise(_texts())))
    section = lambda e: F.coalesce(_string(e.section), F.to_json(e.section))
    lost = F.flatten(F.transform("wanted", lambda e: F.transform(F.filter(e.quotes, lambda q: F.size(q.candidates) == 0), lambda q: F.concat(section(e), F.lit(": quote absent from that event")))))
    broken = F.transform(F.filter("entries", lambda e: ~usable(e)), lambda e: F.concat(section(e), F.lit(": invalid quotes")))
    issues = F.when(group.isNotNull(), F.transform(_texts(broken, lost), lambda x: F.concat(group.label, F.lit(": "), x))).otherwise(_texts())
    return each.select(
        "id", "variant", "k", _string(V.at(event, "label")).alias("label"), _string(V.at(event, "grouping")).alias("grouping"), _string(V.at(nested, "status")).alias("status"), errors.alias("errors"),
        issues.alias("quote_issues"), _facts(nested).alias("facts"), F.size(_listed(V.at(nested, "review_excerpts"))).alias("n_excerpts"), F.size(_listed(V.at(nested, "suggestions"))).alias("n_suggestions"))


def inspect(outputs: DataFrame, cases: DataFrame, aware: list[str]) -> DataFrame:
    """A score of each output: id, variant, complete, structure_errors, labels_match, count_match, checks, quote_issues, unassigned, suggestions, seconds.

    ``outputs``: id, variant, result (JSON), error, seconds; ``cases``: id, source_text, expectations (``EXPECTATIONS``); ``aware``: the event-aware
    variants. labels_match (explicit labels in order) and count_match are null where they don't apply: for flat results, and the
    count where none is expected. In ``checks``, missing and hits of a check about one event are null for flat results, which
    are never scored for placement, and an event that isn't there exactly once has no text; global_missing looks at all
    facts. An output without a case or expectations can't be scored: it keeps a row that counts as attempted, with an error and no scores.
    """
    is_aware = F.col("variant").isin(*aware) if aware else F.lit(False)
    events = event_rows(outputs.where(is_aware), cases)
    events = events.groupBy("id", "variant").agg(F.array_sort(F.collect_list(F.struct("k", "label", "grouping", "status", "errors", "quote_issues", "facts", "n_excerpts", "n_suggestions"))).alias("events"))
    known = cases.select("id", F.col("expectations").alias("wanted"))
    groups = source_groups(cases.join(outputs.where(is_aware).select("id").distinct(), "id", "left_semi")).select("id", F.size("groups").alias("n_groups"), "group_error")
    rows = outputs.select("id", "variant", "result", "error", "seconds").join(known, "id", "left").join(events, ["id", "variant"], "left").join(groups, "id", "left")
    v, none = F.col("v"), F.expr(f"cast(array() as {events.schema['events'].dataType.simpleString()})")
    rows = rows.withColumns({"aware": is_aware, "v": F.try_parse_json("result"), "events": F.when(F.col("group_error").isNull(), F.coalesce("events", none)).otherwise(none)})

    listed = V.items(V.at(v, "event_results"))
    count = F.when(V.kind(V.at(v, "event_count")) == "number", F.try_variant_get(v, "$.event_count", "double"))
    whole = F.when(F.col("group_error").isNotNull(), F.array(F.concat(F.lit("source: "), F.col("group_error")))).when(F.coalesce(F.size(listed) > 0, F.lit(False)), _texts(
        _when(F.size(listed) != F.col("n_groups"), "$.event_results count"), _when(count != F.col("n_groups"), "$.event_count value"),
        F.flatten(F.transform("events", lambda e: e.errors)))).otherwise(F.array(F.lit("$.event_results type")))
    unscored = F.col("wanted").isNull()
    structure = F.when(unscored, F.array(F.lit("scoring failed: no expectations"))).otherwise(_texts(result_errors(v), F.when(F.col("aware"), whole).otherwise(_texts())))

    explicit = F.filter("events", lambda e: F.coalesce((e.grouping == "explicit") & e.label.isNotNull(), F.lit(False)))
    own = F.when(F.col("aware"), F.flatten(F.transform("events", lambda e: e.facts))).otherwise(_facts(v))
    rows = rows.withColumns({"structure_errors": structure, "explicit": F.transform(explicit, lambda e: F.struct(T.normalize(e.label).alias("key"), e.facts)), "facts": own})
    joined = lambda facts, section=None: F.array_join(F.transform(facts if section is None else F.filter(facts, lambda f: f.section == section), lambda f: f.text), "\n")
    rows = rows.withColumn("all_text", joined(F.col("facts")))
    lacks = lambda text, fragments: F.filter(fragments, lambda f: ~F.contains(text, T.casefold(f)))

    def check(c: Column) -> Column:
        mine = F.filter("explicit", lambda e: e.key == T.normalize(c.event_label))
        scoped = F.when(c.event_label.isNull(), joined(F.col("facts"), c.section)).when(F.size(mine) == 1, joined(F.get(mine, F.lit(0)).facts, c.section)).otherwise("")
        applies = c.event_label.isNull() | F.col("aware")
        required, forbidden = (F.coalesce(x, F.expr("cast(array() as array<string>)")) for x in (c.required_fragments, c.forbidden_fragments))
        return T.let(scoped, lambda text: F.struct(
            c.event_label.alias("event_label"), c.section.alias("section"), applies.alias("applicable"), required.alias("required"), F.when(applies, lacks(text, required)).alias("missing"),
            F.when(applies, F.filter(forbidden, lambda f: F.contains(text, T.casefold(f)))).alias("hits"), lacks(F.col("all_text"), required).alias("global_missing"), F.coalesce(c.review_note, F.lit("")).alias("review_note")))

    checks = F.transform(F.col("wanted.checks"), check)
    asked = F.transform(F.coalesce("wanted.expected_event_labels", F.expr("cast(array() as array<string>)")), T.normalize)
    scored = F.col("aware") & ~unscored
    issues = F.flatten(F.transform("events", lambda e: e.quote_issues))
    partial = F.exists("events", lambda e: F.coalesce(e.status == "incomplete_draft", F.lit(False)))
    complete = F.col("error").isNull() & (F.size("structure_errors") == 0) & (F.size(issues) == 0) & ~partial & ~F.coalesce(_string(V.at(v, "status")) == "incomplete_draft", F.lit(False))
    total = lambda of, flat: F.when(unscored, 0).when(F.col("aware"), F.aggregate("events", F.lit(0), lambda n, e: n + of(e))).otherwise(F.size(_listed(V.at(v, flat))))
    return rows.select(
        "id", "variant", complete.alias("complete"), "structure_errors", F.when(scored, F.transform("explicit", lambda e: e.key) == asked).alias("labels_match"),
        F.when(scored, F.size("explicit") == F.col("wanted.event_count")).alias("count_match"), F.coalesce(checks, F.transform(F.expr(f"cast(array() as array<{CHECK}>)"), check)).alias("checks"),
        F.when(unscored, _texts()).otherwise(issues).alias("quote_issues"), total(lambda e: e.n_excerpts, "review_excerpts").alias("unassigned"), total(lambda e: e.n_suggestions, "suggestions").alias("suggestions"), "seconds")


def summarise(inspected: DataFrame) -> DataFrame:
    """Counts for each variant of what ``inspect`` gives; what doesn't apply counts for nothing, which isn't the same as false."""
    some = lambda test: F.count_if(F.exists("checks", lambda c: F.coalesce(test(c), F.lit(False))))
    return inspected.groupBy("variant").agg(
        F.count("*").alias("attempted"), F.count_if("complete").alias("complete_structured_outputs"), F.count_if(~F.col("labels_match")).alias("explicit_label_mismatches"),
        F.count_if(F.size("quote_issues") > 0).alias("cases_with_event_quote_issues"), some(lambda c: F.size(c.global_missing) > 0).alias("cases_with_missing_global_fragments"),
        some(lambda c: c.applicable & ((F.size(c.missing) > 0) | (F.size(c.hits) > 0))).alias("cases_with_missing_or_forbidden_scoped_fragments"), T.round_half_even(F.sum("seconds"), 2).alias("seconds"))


def group_outcomes(outputs: DataFrame, cases: DataFrame) -> DataFrame:
    """id, variant, position, expected, actual, outcome, reasons: each event of the source against that of the result in its place.

    outcome: 'matched'; 'incomplete' for a sound event that says it is; 'malformed' with its errors in reasons; 'missing' where the result has
    no event there, 'unexpected' where the source has none.
    """
    found = event_rows(outputs, cases).withColumn("position", F.col("k") + 1)
    wanted = outputs.select("id", "variant").join(source_groups(cases).select("id", F.posexplode("groups").alias("k", "group")), "id")
    both = evaluate.match_groups(wanted.select("id", "variant", (F.col("k") + 1).alias("position"), F.col("group.label").alias("label")), found, ["id", "variant", "position"], "label")
    both = both.join(found.select("id", "variant", "position", "errors", "status"), ["id", "variant", "position"], "left")
    outcome = F.when(F.col("outcome").isin("missing", "unexpected"), F.col("outcome")).when(F.size("errors") > 0, "malformed").when(F.col("status") == "incomplete_draft", "incomplete").otherwise("matched")
    return both.select("id", "variant", "position", "expected", "actual", outcome.alias("outcome"), F.coalesce("errors", _texts()).alias("reasons"))

"""Evaluation: cases against variants, expected against actual groups, screens, roll-ups with explicit denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import lexicon as L
from attestry.functions import text as T


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where there is nothing to divide by."""
    return numerator.cast("double") / F.nullif(denominator, F.lit(0).cast("long"))


def grid(cases: DataFrame, variants: list[str], name: str = "variant") -> DataFrame:
    """Every case with every variant. The variants are a short fixed list, so no join is needed."""
    return cases.withColumn(name, F.explode(F.array(*[F.lit(v) for v in variants])))


def pending(planned: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Planned rows without a result."""
    return planned.join(done.select(*key), key, "left_anti")


def match_groups(expected: DataFrame, actual: DataFrame, key: list[str], label: str) -> DataFrame:
    """key, expected, actual, outcome by position: 'matched', 'mismatched', 'missing' or 'unexpected'."""
    e, a = expected.select(*key, F.col(label).alias("expected")), actual.select(*key, F.col(label).alias("actual"))
    both = e.withColumn("has_e", F.lit(True)).join(a.withColumn("has_a", F.lit(True)), key, "full_outer")
    outcome = F.when(F.col("has_a").isNull(), "missing").when(F.col("has_e").isNull(), "unexpected").when(F.col("expected").eqNullSafe(F.col("actual")), "matched").otherwise("mismatched")
    return both.select(*key, "expected", "actual", outcome.alias("outcome"))


def reconcile(saved: DataFrame, source: DataFrame) -> DataFrame:
    """Rows, with their counts, that one side has more often than the other; side is 'saved' or 'source'."""
    only = lambda a, b, side: a.exceptAll(b).withColumn("side", F.lit(side))
    return only(saved, source, "saved").unionByName(only(source, saved, "source"))


def out_of_place(saved: DataFrame, planned: DataFrame, run: list[str], key: str, order: str) -> DataFrame:
    """run, position, expected, actual, outcome of each place of a run where the saved results don't stand in the order of the plan.

    Both sides: run, key and order. ``reconcile`` knows what one side has more often; this, what came in another place.
    """
    place = F.row_number().over(Window.partitionBy(*run).orderBy(order, key)).alias("position")
    side = lambda rows: rows.select(*run, key, place)
    return match_groups(side(planned), side(saved), [*run, "position"], key).where("outcome <> 'matched'")


def screen(checks: DataFrame, events: DataFrame) -> DataFrame:
    """Fragment screens of ``checks`` against the text of the event each is about.

    ``checks``: id, label, section, required, forbidden (arrays); ``events``: id, label, section, text. A check with a
    label needs exactly one event of that label, by case-folded key, else its text is empty; one without is about
    all events of its case. missing, hits and the whole-case missing_anywhere come back.
    """
    key = lambda c: T.normalize(F.col(c))
    texts = events.groupBy("id", key("label").alias("label_key"), "section").agg(F.count_distinct("event_id").alias("n"), F.concat_ws("\n", F.array_sort(F.collect_list("text"))).alias("text"))
    labels = events.groupBy("id", key("label").alias("label_key")).agg(F.count_distinct("event_id").alias("events"))
    whole = events.groupBy("id", "section").agg(F.concat_ws("\n", F.array_sort(F.collect_list("text"))).alias("all_text"))
    joined = checks.withColumn("label_key", key("label")).join(texts.drop("n"), ["id", "label_key", "section"], "left").join(labels, ["id", "label_key"], "left").join(whole, ["id", "section"], "left")
    scoped = F.when(F.col("label").isNull(), F.col("all_text")).when(F.col("events") == 1, F.col("text"))
    scoped, anywhere = F.coalesce(scoped, F.lit("")), F.coalesce("all_text", F.lit(""))
    gone = lambda text: F.filter("required", lambda f: ~F.contains(T.casefold(text), T.casefold(f)))
    hits = F.filter("forbidden", lambda f: F.contains(T.casefold(scoped), T.casefold(f)))
    return joined.select("id", "label", "section", gone(scoped).alias("missing"), hits.alias("hits"), gone(anywhere).alias("missing_anywhere"))


def quote_support(quotes: Column, source: Column) -> Column:
    """checked, supported, unsupported of an array of quotes: case-sensitive stretches of a source; empty ones support nothing."""
    fine = lambda q: F.coalesce((q != "") & F.contains(source, q), F.lit(False))
    return F.struct(F.size(quotes).alias("checked"), F.size(F.filter(quotes, fine)).alias("supported"), F.filter(quotes, lambda q: ~fine(q)).alias("unsupported"))


#: Codes of failed screens, in order.
FAILURES = (
    "pipeline_error invalid_result_structure_or_status literal_retention_strings_missing expected_absent_fact_section_nonempty desired_suggestion_sections_missing "
    "forbidden_factual_claim_lexical_screen_hit retained_quote_not_in_cleaned_source incomplete_draft incomplete_chunk_status_mismatch"
).split()


def inspect(cases: DataFrame, across: bool = True) -> DataFrame:
    """Screens of one result for each case, by literal strings, and the codes of those that fail.

    ``cases``: id; the expectations must_retain, absent_sections, suggestion_sections, forbidden (arrays); cleaned (source
    text); the result's valid (its structure), facts (section, text, evidence), suggestions (section, text, basis),
    status, issues, error; and raw_emitted, raw_valid (outputs of the model, and those of a valid structure). An invalid
    result has no facts and no suggestions. Strings are compared in lower case, quotes as they are. A string to retain may
    run ``across`` facts and sections, joined by line ends; if not, one fact must hold it whole.
    """
    valid = F.coalesce("valid", F.lit(False))
    none = lambda c: F.when(valid, F.coalesce(c, F.array().cast(cases.schema[c].dataType))).otherwise(F.array().cast(cases.schema[c].dataType))
    rows = cases.withColumns({"valid": valid, "facts": none("facts"), "suggestions": none("suggestions")})
    texts = lambda s: F.array_join(F.transform(F.filter("facts", lambda f: f.section == s), lambda f: f.text), "\n")
    sections = F.array(*[F.struct(F.lit(s).alias("section"), texts(s).alias("text")) for s in L.SECTIONS])
    rows = rows.withColumn("by_section", sections)
    rows = rows.withColumn("whole", F.lower(F.array_join(F.transform("by_section", lambda x: x.text), "\n")))
    if across:
        kept = lambda s: F.contains(F.col("whole"), F.lower(s))
    else:
        kept = lambda s: F.exists("facts", lambda f: F.coalesce(F.contains(F.lower(f.text), F.lower(s)), F.lit(False)))
    filled = lambda s: F.exists("facts", lambda f: f.section == s)
    tipped = lambda s: F.exists("suggestions", lambda t: t.section == s)
    at = lambda text, phrase: T.find(F.lower(phrase), F.lower(text))
    hit = lambda x, p: F.struct(p.alias("phrase"), x.section.alias("section"), T.context(x.text, at(x.text, p), F.length(p)).alias("context"))
    hits = F.flatten(F.transform("forbidden", lambda p: F.transform(F.filter("by_section", lambda x: at(x.text, p) >= 0), lambda x: hit(x, p))))
    cited = lambda c, key: F.flatten(F.transform(c, lambda e: e[key]))
    rows = rows.withColumns({
        "retained": F.filter("must_retain", kept), "missing": F.filter("must_retain", lambda s: ~kept(s)),
        "empty": F.when(F.col("valid"), F.filter("absent_sections", lambda s: ~filled(s))).otherwise(F.array().cast("array<string>")), "nonempty": F.filter("absent_sections", filled),
        "covered": F.filter("suggestion_sections", tipped), "uncovered": F.filter("suggestion_sections", lambda s: ~tipped(s)), "hits": F.when(F.col("valid"), hits),
        "fact_evidence": quote_support(cited("facts", "evidence"), F.col("cleaned")), "suggestion_basis": quote_support(cited("suggestions", "basis"), F.col("cleaned")),
        "partial": (F.col("raw_emitted") > F.col("raw_valid")) | F.exists(F.coalesce("issues", F.array().cast("array<string>")), lambda i: F.startswith(i, F.lit("INCOMPLETE DRAFT:"))),
        "incomplete": F.coalesce(F.col("status") == "incomplete_draft", F.lit(False))})
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    tests = [
        F.col("error").isNotNull(), ~F.col("valid"), some("missing"), some("nonempty"), some("uncovered"), some("hits"), some("fact_evidence.unsupported") | some("suggestion_basis.unsupported"),
        F.col("partial") | F.col("incomplete"), F.col("valid") & (F.col("partial") != F.col("incomplete")),
    ]
    rows = rows.withColumn("failures", F.array_compact(F.array(*[F.when(bad, name) for bad, name in zip(tests, FAILURES)])))
    return rows.select("id", "valid", "retained", "missing", "empty", "nonempty", "covered", "uncovered", "hits", "fact_evidence", "suggestion_basis", "partial", "incomplete",
                       F.col("error").isNotNull().alias("failed"), "raw_emitted", "raw_valid", "failures", "must_retain", "absent_sections", "suggestion_sections", "forbidden")


def summarise(inspected: DataFrame) -> DataFrame:
    """metric, numerator, denominator, share of the screens of all cases; share is null where there is nothing to divide by."""
    n = lambda c: F.sum(F.size(c)).cast("long")
    total = lambda c: F.sum(c).cast("long")
    count = lambda test: F.count_if(test)
    complete = F.col("valid") & ~F.col("incomplete") & ~F.col("partial") & ~F.col("failed")
    fractions = {
        "valid_results": (count(F.col("valid")), F.count("*")),
        "complete_valid_results": (count(complete), F.count("*")),
        "strings_retained": (n("retained"), n("must_retain")),
        "cases_with_all_strings": (count(F.size("missing") == 0), F.count("*")),
        "absent_sections_empty": (n("empty"), n("absent_sections")),
        "suggestion_sections_covered": (n("covered"), n("suggestion_sections")),
        "cases_with_forbidden_hits": (count(F.coalesce(F.size("hits") > 0, F.lit(False))), count(F.col("valid"))),
        "raw_outputs_valid": (total("raw_valid"), total("raw_emitted")),
        "incomplete_cases": (count(F.col("incomplete") | F.col("partial")), F.count("*")),
        "status_consistent": (count(F.col("valid") & (F.col("partial") == F.col("incomplete"))), count(F.col("valid"))),
        "pipeline_errors": (count(F.col("failed")), F.count("*")),
        "fact_quotes_in_source": (total("fact_evidence.supported"), total("fact_evidence.checked")),
        "suggestion_quotes_in_source": (total("suggestion_basis.supported"), total("suggestion_basis.checked")),
        "cases_without_failure": (count(F.size("failures") == 0), F.count("*")),
    }
    sums = inspected.agg(*[x.alias(f"{name}_{side}") for name, (a, b) in fractions.items() for side, x in (("n", a), ("d", b))])
    rows = F.array(*[F.struct(F.lit(name).alias("metric"), F.coalesce(f"{name}_n", F.lit(0).cast("long")).alias("numerator"), F.coalesce(f"{name}_d", F.lit(0).cast("long")).alias("denominator")) for name in fractions])
    return sums.select(F.inline(rows)).withColumn("share", ratio(F.col("numerator"), F.col("denominator")))


def retention(items: Column, factual: Column, unassigned: Column, rendered: Column) -> Column:
    """Where each required item is found, by literal strings in lower case: struct of arrays."""
    within = lambda text: (lambda i: F.contains(F.lower(text), F.lower(i)))
    fact, loose, shown = within(factual), within(unassigned), within(rendered)
    return F.struct(
        F.filter(items, fact).alias("factual"), F.filter(items, loose).alias("unassigned"), F.filter(items, lambda i: loose(i) & ~fact(i)).alias("unassigned_only"),
        F.filter(items, lambda i: ~fact(i) & ~loose(i)).alias("missing"), F.filter(items, shown).alias("rendered"), F.filter(items, lambda i: ~shown(i)).alias("missing_from_rendered"))


def complete_run(selected: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: n_selected, n_predicted, n_missing, n_unknown, n_repeated, complete of the ids (column id) of a run.

    Complete: each selected id has exactly one prediction, and no other has any.
    """
    done = predictions.groupBy("id").agg(F.count("*").alias("times"))
    both = selected.select("id").distinct().withColumn("wanted", F.lit(True)).join(done, "id", "full_outer")
    counts = both.agg(
        F.count_if(F.col("wanted").isNotNull()).alias("n_selected"), F.coalesce(F.sum("times"), F.lit(0)).cast("long").alias("n_predicted"), F.count_if(F.col("times").isNull()).alias("n_missing"),
        F.count_if(F.col("wanted").isNull()).alias("n_unknown"), F.count_if(F.col("times") > 1).alias("n_repeated"))
    return counts.withColumn("complete", (F.col("n_selected") > 0) & (F.col("n_missing") + F.col("n_unknown") + F.col("n_repeated") == 0))


def roll_up(outcomes: DataFrame, variant: str) -> DataFrame:
    """Per variant: cases, complete, failed, seconds, the share complete, how many failures, and all of them in order of the cases.

    Cases are dealt by variant and id, so each task sums up and orders a stretch of a variant; what is left to one row is to
    append the stretches. ``failures`` gives them as rows.
    """
    dealt = outcomes.repartitionByRange(variant, "id").withColumn("part", F.spark_partition_id())
    told = lambda c: F.flatten(F.transform(F.array_sort(c), lambda x: x.failures))
    parts = dealt.groupBy(variant, "part").agg(
        F.count("*").alias("cases"), F.count_if(F.col("complete")).alias("n_complete"), F.sum("seconds").alias("seconds"), F.count_if(~F.col("complete")).alias("n_failed"), F.bool_or(~F.col("complete")).alias("any_failed"),
        told(F.collect_list(F.when(F.size("failures") > 0, F.struct("id", "failures")))).alias("failures"))
    cases, done, failures = F.sum("cases"), F.sum("n_complete"), told(F.collect_list(F.struct("part", "failures")))
    return parts.groupBy(variant).agg(
        cases.alias("cases"), done.alias("n_complete"), F.sum("n_failed").alias("n_failed"), T.round_half_even(F.sum("seconds"), 3).alias("seconds"),
        ratio(done, cases).alias("share_complete"), F.bool_or("any_failed").alias("any_failed"), F.size(failures).cast("long").alias("n_failures"), failures.alias("failures"))


def failures(outcomes: DataFrame, variant: str) -> DataFrame:
    """variant, id, place (from 1), failure: the failures of each case in order."""
    return outcomes.select(variant, "id", F.posexplode("failures").alias("k", "failure")).select(variant, "id", (F.col("k") + 1).alias("place"), "failure")

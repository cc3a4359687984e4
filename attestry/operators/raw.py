"""Raw outputs of a model scored before anything is filtered: each by its own schema, its quotes against the whole cleaned source.

An output that breaks its schema counts as emitted and invalid, and none of its quotes is counted: they are neither supported nor
unsupported. Outputs of the helper that only suggests are scored beside those of the main model, never among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import lexicon as L
from attestry.operators import evaluate, schema
from attestry.operators import variants as V

_QUOTES = "array<struct<section:string,item:int,place:int,quote:string>>"


def _quotes(listed: Column, section, key: str) -> Column:
    """(section, item, place, quote) of the quotes of a list of facts or suggestions."""
    return F.flatten(F.transform(V.items(listed), lambda x, k: F.transform(V.items(V.at(x, key)), lambda q, n: F.struct(
        section(x).alias("section"), k.alias("item"), n.alias("place"), F.try_variant_get(q, "$", "string").alias("quote")))))


def _score(raw: Column, cleaned: Column, shape: dict) -> Column:
    """valid, breach, facts and basis (checked, supported, unsupported) of one raw text."""
    v = F.try_parse_json(F.trim(raw))
    found = schema.errors(raw, shape)
    none = F.expr(f"cast(array() as {_QUOTES})")
    named = F.array(*[F.struct(F.lit(s).alias("section"), V.at(V.at(v, "sections"), s).alias("value")) for s in L.SECTIONS])
    facts = F.flatten(F.transform(named, lambda s: F.coalesce(_quotes(s.value, lambda _: s.section, "evidence"), none))) if shape is schema.RECORD else none
    basis = F.coalesce(_quotes(V.at(v, "suggestions"), lambda x: F.try_variant_get(x, "$.section", "string"), "basis"), none)
    fine = lambda q: F.coalesce((q.quote != "") & F.contains(cleaned, q.quote), F.lit(False))
    count = lambda q: F.struct(F.size(q).alias("checked"), F.size(F.filter(q, fine)).alias("supported"), F.filter(q, lambda x: ~fine(x)).alias("unsupported"))
    sound = F.size(found) == 0
    return F.struct(sound.alias("valid"), F.get(found, F.lit(0)).alias("breach"), count(F.when(sound, facts).otherwise(none)).alias("facts"), count(F.when(sound, basis).otherwise(none)).alias("basis"))


def score_outputs(cases: DataFrame) -> DataFrame:
    """id, kind, ord (from 1), valid, breach, facts, basis of every raw output of ``cases``.

    ``cases``: id, cleaned (the source after cleaning), raw_outputs (texts of the main model), result (JSON; its ``coaching_outputs`` are the helper's). kind
    is 'chunk' or 'helper'. facts and basis count the quotes: checked, supported (in the cleaned source as they stand) and unsupported, with
    section, item and place. A helper output that is no text is invalid; a case without outputs has no rows.
    """
    cleaned = F.coalesce("cleaned", F.lit(""))
    helper = V.items(V.at(F.try_parse_json("result"), "coaching_outputs"))
    texts = F.transform(helper, lambda h: F.when(F.schema_of_variant(h) == "STRING", F.try_variant_get(h, "$", "string")))
    each = lambda raws, kind, shape: F.transform(F.coalesce(raws, F.expr("cast(array() as array<string>)")), lambda raw, k: F.struct(F.lit(kind).alias("kind"), (k + 1).alias("ord"), _score(raw, cleaned, shape).alias("s")))
    rows = cases.select("id", F.explode(F.concat(each(F.col("raw_outputs"), "chunk", schema.RECORD), each(texts, "helper", schema.HELPER))).alias("o"))
    return rows.select("id", "o.kind", "o.ord", "o.s.*")


def bad_collections(cases: DataFrame) -> DataFrame:
    """id of ``cases`` whose result has ``coaching_outputs`` that are no list."""
    stated = V.at(F.try_parse_json("result"), "coaching_outputs")
    return cases.where(stated.isNotNull() & V.items(stated).isNull()).select("id")


def by_case(scored: DataFrame) -> DataFrame:
    """id, kind, emitted, valid, and the counts of facts and basis of each case's outputs."""
    total = lambda part, name: F.sum(f"{part}.{name}").alias(f"{part}_{name}")
    lost = lambda part: F.sum(F.size(f"{part}.unsupported")).alias(f"{part}_unsupported")
    return scored.groupBy("id", "kind").agg(F.count("*").alias("emitted"), F.count_if("valid").alias("valid"), *[f(part, *a) for part in ("facts", "basis") for f, a in ((total, ("checked",)), (total, ("supported",)), (lambda p: lost(p), ()))])


def summarise(scored: DataFrame, cases: DataFrame) -> DataFrame:
    """metric, numerator, denominator, share of all raw outputs; case counts are out of ``cases``. share is null where nothing is counted."""
    rolled = by_case(scored)
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0)).cast("long")
    some = lambda kind, test: F.count_if((F.col("kind") == kind) & test)
    metrics = {
        "raw_outputs_valid": (of("chunk", "valid"), of("chunk", "emitted")), "raw_outputs_excluded": (of("chunk", "emitted") - of("chunk", "valid"), of("chunk", "emitted")),
        "raw_fact_quotes_in_source": (of("chunk", "facts_supported"), of("chunk", "facts_checked")), "raw_suggestion_quotes_in_source": (of("chunk", "basis_supported"), of("chunk", "basis_checked")),
        "cases_with_unsupported_raw_facts": (some("chunk", F.col("facts_unsupported") > 0), None), "cases_with_unsupported_raw_basis": (some("chunk", F.col("basis_unsupported") > 0), None),
        "helper_outputs_valid": (of("helper", "valid"), of("helper", "emitted")), "helper_outputs_excluded": (of("helper", "emitted") - of("helper", "valid"), of("helper", "emitted")), "helper_quotes_in_source": (of("helper", "basis_supported"), of("helper", "basis_checked")),
        "cases_with_helper_outputs": (some("helper", F.col("emitted") > 0), None), "cases_with_invalid_helper_outputs": (some("helper", F.col("valid") < F.col("emitted")), None), "cases_with_unsupported_helper_basis": (some("helper", F.col("basis_unsupported") > 0), None),
    }
    sums = rolled.agg(*[x.alias(f"{name}_{side}") for name, (n, d) in metrics.items() for side, x in (("n", n), ("d", d)) if x is not None])
    bad = bad_collections(cases).agg(F.count("*").alias("cases_with_bad_helper_lists_n"))
    names = [*metrics, "cases_with_bad_helper_lists"]
    row = sums.join(bad).join(cases.agg(F.count("*").alias("n_cases")))  # three rows of one each
    whole = lambda name: F.col(f"{name}_d") if name in metrics and metrics[name][1] is not None else F.col("n_cases")
    rows = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"{name}_n").alias("numerator"), whole(name).alias("denominator")) for name in names])
    return row.select(F.inline(rows)).withColumn("share", evaluate.ratio(F.col("numerator"), F.col("denominator")))


def lexical_counts(inspected: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: how many cases were selected (``selected``: id), attempted and remain, and the counts of the screen for forbidden phrases.

    ``inspected`` as of ``evaluate.inspect``. Phrases are screened only in results of a valid structure; a phrase found in two sections is two hits.
    """
    hits = F.coalesce(F.size(F.when(F.col("valid"), F.col("hits"))), F.lit(0))
    seen = inspected.agg(
        F.count("*").alias("attempted"), F.count_if("valid").alias("cases_screened"), F.coalesce(F.sum(F.when(F.col("valid"), F.size("forbidden"))), F.lit(0)).cast("long").alias("phrases_screened"),
        F.count_if(hits > 0).alias("cases_with_hits"), F.coalesce(F.sum(hits), F.lit(0)).cast("long").alias("phrase_section_hits"), F.count_if(F.col("incomplete") | F.col("partial")).alias("incomplete_cases"), F.count_if("failed").alias("pipeline_errors"))
    return selected.agg(F.count("*").alias("selected")).join(seen).withColumn("remaining", F.col("selected") - F.col("attempted"))

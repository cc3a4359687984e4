"""Semi-structured model output against closed schemas: nothing is repaired, every breach is named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import lexicon as L

MAX_QUOTES = 64
FACT = "struct<text:string,evidence:array<string>>"
RECORD = f"struct<event_type:string,sections:struct<{','.join(f'{s}:array<{FACT}>' for s in L.SECTIONS)}>,suggestions:array<struct<section:string,text:string,basis:array<string>,confirm:string>>>"


def keys_are(variant: Column, path: str, wanted: list[str]) -> Column:
    """The object at a path has these keys and no others."""
    text = F.try_variant_get(variant, path, "string")
    return F.coalesce(F.array_sort(F.json_object_keys(text)) == F.array(*[F.lit(k) for k in sorted(wanted)]), F.lit(False))


def is_object(variant: Column) -> Column:
    return F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))


def _text_ok(text: Column, most: int) -> Column:
    return F.coalesce(F.length(text).between(1, most), F.lit(False))


def _quotes_ok(quotes: Column) -> Column:
    return F.coalesce(F.size(quotes).between(1, MAX_QUOTES) & F.forall(quotes, lambda q: _text_ok(q, 1600)), F.lit(False))


def schema_errors(raw: Column) -> Column:
    """Breaches of the record contract in a raw model text, as an array of names; empty if there are none.

    Malformed JSON and repeated keys, unknown or missing keys at any level, values of another type, values
    outside their enumerations and lengths. The text is parsed twice: as a variant, which keeps what a typed
    parse would drop or coerce, and by type.
    """
    v = F.try_parse_json(raw)
    record = F.from_json(raw, RECORD, {"mode": "PERMISSIVE"})
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    array = lambda path: F.coalesce(kind(path).startswith("ARRAY"), F.lit(False))
    items = lambda path: F.try_variant_get(v, path, "array<variant>")

    def closed(path: str, keys: list[str], strings: list[str], lists: list[str]) -> Column:
        shape = lambda x: keys_are(x, "$", keys) & F.array_sort(F.json_object_keys(F.to_json(x))).isNotNull()
        typed = lambda x: F.forall(F.array(*[F.schema_of_variant(F.try_variant_get(x, f"$.{s}", "variant")) for s in strings]), lambda t: t == "STRING") & F.forall(F.array(*[F.schema_of_variant(F.try_variant_get(x, f"$.{s}", "variant")) for s in lists]), lambda t: t.isin("ARRAY<STRING>"))
        return F.forall(items(path), lambda x: F.coalesce(is_object(x) & shape(x) & typed(x), F.lit(False)))

    checks: list[tuple[Column, str]] = [(~keys_are(v, "$", ["event_type", "sections", "suggestions"]), "keys"), (~F.coalesce(record.event_type.isin(L.EVENT_TYPES) & (kind("$.event_type") == "STRING"), F.lit(False)), "event_type"), (~keys_are(v, "$.sections", L.SECTIONS), "sections")]
    for s in L.SECTIONS:
        facts = record.sections[s]
        fine = array(f"$.sections.{s}") & (F.size(facts) <= 12) & closed(f"$.sections.{s}", ["text", "evidence"], ["text"], ["evidence"])
        checks.append((~F.coalesce(fine & F.forall(facts, lambda f: _text_ok(f.text, 1200) & _quotes_ok(f.evidence)), F.lit(False)), s))
    tips = record.suggestions
    fine = array("$.suggestions") & (F.size(tips) <= 6) & closed("$.suggestions", ["section", "text", "basis", "confirm"], ["section", "text", "confirm"], ["basis"])
    checks.append((~F.coalesce(fine & F.forall(tips, lambda t: t.section.isin("impact", "action", "plan") & _text_ok(t.text, 1200) & _quotes_ok(t.basis) & _text_ok(t.confirm, 300)), F.lit(False)), "suggestions"))
    named = F.array_compact(F.array(*[F.when(bad, name) for bad, name in checks]))
    return F.when(v.isNull() | ~is_object(v), F.array(F.lit("json"))).otherwise(named)


def parse_records(outputs: DataFrame, raw: str = "raw_output") -> DataFrame:
    """``outputs`` with ``schema_errors`` and ``record``, which is null where there are errors."""
    checked = outputs.withColumn("schema_errors", schema_errors(F.trim(F.col(raw))))
    return checked.withColumn("record", F.when(F.size("schema_errors") == 0, F.from_json(F.trim(F.col(raw)), RECORD)))

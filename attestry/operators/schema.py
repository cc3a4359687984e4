"""Closed schemas of JSON values, declared as plain values and compiled to expressions that name every breach.

A schema is a dict: {"object": {key: schema}} has these keys and no others; {"list": schema, "least": n, "most": n}; {"text": (least, most)}
counts characters; {"one of": [...]} are texts; {"is": true or false}; {"whole": least} a number without a fraction; {"any": None} takes what there is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions import lexicon as L
from attestry.operators import variants as V

#: The shapes that a model has to answer in, with their limits.
QUOTE = {"text": (1, 1600)}
FACT = {"object": {"text": {"text": (1, 1200)}, "evidence": {"list": QUOTE, "least": 1, "most": 64}}}
SUGGESTION = {"object": {"section": {"one of": ["impact", "action", "plan"]}, "text": {"text": (1, 1200)}, "basis": {"list": QUOTE, "least": 1, "most": 64}, "confirm": {"text": (1, 300)}}}
RECORD = {"object": {"event_type": {"one of": list(L.EVENT_TYPES)}, "sections": {"object": {s: {"list": FACT, "most": 12} for s in L.SECTIONS}}, "suggestions": {"list": SUGGESTION, "most": 6}}}
HELPER = {"object": {"suggestions": {"list": SUGGESTION, "most": 3}}}

_BREACH = "array<struct<path:string,rule:string>>"


def _none() -> Column:
    return F.expr(f"cast(array() as {_BREACH})")


def breaches(v: Column, schema: dict, path: Column | None = None) -> Column:
    """Every way in which a variant breaks a schema, as an array of (path, rule), outermost first; empty if it keeps it.

    rule: 'type', 'missing', 'unknown', 'least', 'most' or 'value'. SQL null, which stands for text that is no JSON, breaks 'type'. Of a
    value of another type nothing below is looked at.
    """
    path = F.lit("$") if path is None else path
    (what, part), *_ = schema.items()
    one = lambda bad, rule, at=path: F.when(bad, F.array(F.struct(at.alias("path"), F.lit(rule).alias("rule")))).otherwise(_none())
    sure = lambda test: F.coalesce(test, F.lit(False))
    text = F.when(sure(F.schema_of_variant(v) == "STRING"), F.try_variant_get(v, "$", "string"))

    def checked(right: Column, *rules: Column) -> Column:
        return F.when(~sure(right), one(F.lit(True), "type")).otherwise(F.concat(_none(), *rules))

    if what == "any":
        return one(v.isNull(), "type")
    if what == "object":
        keys = F.array(*[F.lit(k) for k in part])
        below = lambda name: F.concat(path, F.lit(f".{name}"))
        unknown = F.transform(F.array_except(F.map_keys(V.fields(v)), keys), lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit("unknown").alias("rule")))
        own = [F.when(V.at(v, k).isNull(), one(F.lit(True), "missing", below(k))).otherwise(breaches(V.at(v, k), s, below(k))) for k, s in part.items()]
        return checked(V.fields(v).isNotNull(), F.coalesce(unknown, _none()), *own)
    if what == "list":
        size = F.size(V.items(v))
        each = F.flatten(F.transform(V.items(v), lambda x, k: breaches(x, part, F.concat(path, F.lit("["), k.cast("string"), F.lit("]")))))
        return checked(V.items(v).isNotNull(), one(sure(size < schema.get("least", 0)), "least"), one(sure(size > schema.get("most", 1 << 30)), "most"), F.coalesce(each, _none()))
    if what == "text":
        return checked(text.isNotNull(), one(sure(F.length(text) < part[0]), "least"), one(sure(F.length(text) > part[1]), "most"))
    if what == "one of":
        return checked(text.isNotNull(), one(~sure(text.isin(*part)), "value"))
    if what == "is":
        return checked(F.schema_of_variant(v) == "BOOLEAN", one(F.try_variant_get(v, "$", "boolean") != part, "value"))
    if what == "whole":
        number = F.try_variant_get(v, "$", "double")
        return checked((V.kind(v) == "number") & (number == F.floor(number)), one(sure(number < part), "least"))
    raise ValueError(f"unknown schema: {schema}")


def errors(raw: Column, schema: dict) -> Column:
    """Breaches of a JSON text, white space around it aside, as texts like ``$.sections.plan[0].text least``."""
    return F.transform(breaches(F.try_parse_json(F.trim(raw)), schema), lambda b: F.concat(b.path, F.lit(" "), b.rule))

"""JSON values node by node: a walk over a variant, and the paths at which two variants differ.

Both are one expression for each row, unrolled to ``DEPTH`` levels of nesting; a value below that is compared or shown as a
whole, so nothing is lost, only named at a shorter path. No rows are exploded and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions import text as T

DEPTH = 12


def fields(v: Column) -> Column:
    """The fields of an object, as a map; null for other values."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def items(v: Column) -> Column:
    """The elements of an array; null for other values."""
    return F.try_variant_get(v, "$", "array<variant>")


def at(v: Column, key: str) -> Column:
    """A field of an object, null where there is none or the value is no object."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def _steps(v: Column, dotted: bool = False) -> Column:
    """What a value holds: array of (step, key, value), none for a plain value."""
    left, right = (".", "") if dotted else ("[", "]")
    named = F.transform(F.map_entries(fields(v)), lambda e: F.struct(F.concat(F.lit("."), e.key).alias("step"), e.key.alias("key"), e.value.alias("value")))
    listed = F.transform(items(v), lambda x, k: F.struct(F.concat(F.lit(left), k.cast("string"), F.lit(right)).alias("step"), F.lit(None).cast("string").alias("key"), x.alias("value")))
    return F.coalesce(named, listed, F.expr("cast(array() as array<struct<step:string,key:string,value:variant>>)"))


def nodes(v: Column, depth: int = DEPTH, dotted: bool = False) -> Column:
    """Every value inside a variant, itself first: array of (path, key, value, open).

    key is null but for fields of objects; ``open`` marks a value at the last level that holds more. Elements are ``[0]`` in a path, or ``.0`` if ``dotted``.
    """

    def below(path: Column, key: Column, value: Column, left: int) -> Column:
        own = lambda open_: F.array(F.struct(path.alias("path"), key.alias("key"), value.alias("value"), open_.alias("open")))
        if not left:
            return own(F.size(_steps(value, dotted)) > 0)
        return F.concat(own(F.lit(False)), F.flatten(F.transform(_steps(value, dotted), lambda s: below(F.concat(path, s.step), s.key, s.value, left - 1))))

    return below(F.lit("$"), F.lit(None).cast("string"), v, depth)


def kind(v: Column) -> Column:
    """object, array, or the name of a plain value's type; numbers are one type, null is 'null', an absent value 'absent'."""
    plain = F.lower(F.schema_of_variant(v))
    plain = F.when(plain.rlike("^(bigint|double|float|decimal)"), "number").when(plain == "void", "null").otherwise(plain)
    return F.when(v.isNull(), "absent").when(fields(v).isNotNull(), "object").when(items(v).isNotNull(), "array").otherwise(plain)


def differences(saved: Column, wanted: Column, depth: int = DEPTH) -> Column:
    """Where two variants differ: array of (path, change, saved, wanted), with the values as JSON; empty if they are alike.

    change: 'dropped' if only ``wanted`` has the value, 'added' if only ``saved`` has, 'retyped' for another kind of value, 'changed'
    for another value of the same kind. Of a dropped, added or retyped value its own path is named, not those below. Elements
    of arrays are compared by their place. A number is the same however it is written (1 and 1.0). SQL null is an absent value.
    """
    same = lambda a, b: F.to_json(a).eqNullSafe(F.to_json(b))
    number = lambda v: F.try_variant_get(v, "$", "double")
    none = F.expr("cast(array() as array<struct<path:string,change:string,saved:string,wanted:string>>)")

    def pairs(a: Column, b: Column) -> Column:
        keys = F.array_sort(F.array_union(F.map_keys(fields(a)), F.map_keys(fields(b))))
        named = F.transform(keys, lambda k: F.struct(F.concat(F.lit("."), k).alias("step"), F.try_element_at(fields(a), k).alias("a"), F.try_element_at(fields(b), k).alias("b")))
        size = F.greatest(F.size(items(a)), F.size(items(b)))
        listed = F.transform(F.slice(F.sequence(F.lit(0), size), F.lit(1), size), lambda k: F.struct(F.concat(F.lit("["), k.cast("string"), F.lit("]")).alias("step"), F.get(items(a), k).alias("a"), F.get(items(b), k).alias("b")))
        return F.when(fields(a).isNotNull(), named).otherwise(listed)

    def below(path: Column, a: Column, b: Column, left: int) -> Column:
        one = lambda change: F.array(F.struct(path.alias("path"), F.lit(change).alias("change"), F.to_json(a).alias("saved"), F.to_json(b).alias("wanted")))
        of = lambda kinds: F.when(kinds.a == kinds.b, F.when(kinds.a.isin("object", "array"), inner(path, a, b, left)).when((kinds.a == "number") & (number(a) == number(b)), none).otherwise(one("changed"))).when(kinds.a == "absent", one("dropped")).when(kinds.b == "absent", one("added")).otherwise(one("retyped"))
        return F.when(same(a, b), none).otherwise(T.let(F.struct(kind(a).alias("a"), kind(b).alias("b")), of))

    def inner(path: Column, a: Column, b: Column, left: int) -> Column:
        if not left:
            return F.array(F.struct(path.alias("path"), F.lit("changed").alias("change"), F.to_json(a).alias("saved"), F.to_json(b).alias("wanted")))
        return F.flatten(F.transform(pairs(a, b), lambda p: below(F.concat(path, p.step), p.a, p.b, left - 1)))

    return below(F.lit("$"), saved, wanted, depth)

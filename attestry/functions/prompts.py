"""Chat messages that ask a model for a record or for suggestions: notes stand in them as JSON, so that none of it is read as an order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions import lexicon as L


def json_text(value: Column) -> Column:
    """A string as JSON writes it."""
    whole = F.to_json(F.array(value))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def messages(system: str, mode: Column, source: Column) -> Column:
    """The chat messages that ask for a record: roles and contents, the note as JSON, so that none of it is read as an order."""
    user = F.concat(F.lit('{"mode": '), json_text(mode), F.lit(', "source_text": '), json_text(source), F.lit("}"))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def facts_by_section(facts: Column) -> Column:
    """The texts of facts (section, text) as a map by section, each section there."""
    return F.map_from_entries(F.array(*[F.struct(F.lit(s), F.transform(F.filter(facts, lambda f: f.section == s), lambda f: f.text)) for s in L.SECTIONS]))


def helper_messages(system: str, source: Column, focus: Column, known: Column) -> Column:
    """The chat messages that ask for suggestions: the note, the sections asked for, each once, and the texts of known facts by section (a map)."""
    user = F.concat(F.lit('{"source_text": '), json_text(source), F.lit(', "focus_sections": '), F.to_json(F.array_distinct(focus)), F.lit(', "existing_log_facts_context": '), F.to_json(known), F.lit("}"))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))

"""Untrusted text out of notes: instruction lines, quoted command blocks, author requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import lexicon as L
from attestry.functions import text as T


#: A control sign that marks finds while a text is cut; one that a text has itself is doubled as its own letter.
_MARK = "\x01"


def _pieces(text: Column, pattern: str) -> Column:
    """A text as what matches a pattern and what stands between, in order: structs of (piece, hit)."""
    safe = F.replace(text, F.lit(_MARK), F.lit(_MARK + "M"))
    marked = F.regexp_replace(safe, pattern, f"{_MARK}B$0{_MARK}E")
    plain = lambda p: F.replace(p, F.lit(_MARK + "M"), F.lit(_MARK))
    parts = F.transform(F.split(marked, f"{_MARK}[BE]", -1), lambda p, i: F.struct(plain(p).alias("piece"), (i % 2 == 1).alias("hit")))
    return F.filter(parts, lambda p: p.piece != "")


def drop_instruction_lines(notes: DataFrame) -> DataFrame:
    """id, text, removed of ``notes`` (id, text): without the lines that open as pasted instructions. A null note is empty."""
    instruction = lambda x: x.rlike(L.INSTRUCTION_LINE)
    lines = notes.select("id", T.lines(F.coalesce("text", F.lit(""))).alias("lines"))
    return lines.select("id", F.array_join(F.filter("lines", lambda x: ~instruction(x)), "").alias("text"), F.filter("lines", instruction).alias("removed"))


def drop_command_blocks(notes: DataFrame) -> DataFrame:
    """The same for quoted blocks with command words, with the clause that introduces them; ``notes``: id, text, removed."""
    control = lambda p: p.hit & p.piece.rlike("(?i)" + L.CONTROL)
    cut = notes.select("id", "removed", _pieces(F.col("text"), L.QUOTED_BLOCK).alias("p"))
    text = F.array_join(F.transform(F.filter("p", lambda p: ~control(p)), lambda p: p.piece), "")
    return cut.select("id", text.alias("text"), F.concat("removed", F.transform(F.filter("p", control), lambda p: p.piece)).alias("removed"))


def drop_requests(notes: DataFrame) -> DataFrame:
    """The same for sentences that are a request or a command: their clauses that are neither stay; ``notes``: id, text, removed."""
    asks = lambda t: T.author_request(t) | T.direct_control(t)
    cut = notes.select("id", "removed", _pieces(F.col("text"), L.SENTENCE).alias("p"))
    clauses = lambda p: F.transform(F.split(p.piece, "(?<=;)"), lambda c: F.struct(c.alias("piece"), asks(c).alias("hit")))
    whole = lambda p: F.array(F.struct(p.piece.alias("piece"), F.lit(False).alias("hit")))
    parts = cut.select("id", "removed", F.flatten(F.transform("p", lambda p: F.when(p.hit & asks(p.piece), clauses(p)).otherwise(whole(p)))).alias("p"))
    piece = lambda hit: F.transform(F.filter("p", lambda p: p.hit == hit), lambda p: p.piece)
    return parts.select("id", F.array_join(piece(F.lit(False)), "").alias("text"), F.concat("removed", piece(F.lit(True))).alias("removed"))


def clean(notes: DataFrame) -> DataFrame:
    """id, cleaned, removed of ``notes`` (id, text): what is left, and what went, in the order of the three screens.

    Lines that open as pasted instructions go; quoted blocks with command words go with the clause that introduces
    them; of a sentence that is a request or a command, the clauses that are neither stay. A null note is empty.
    """
    return drop_requests(drop_command_blocks(drop_instruction_lines(notes))).withColumnRenamed("text", "cleaned")

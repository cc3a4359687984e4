"""Segmentation of notes: lines with offsets, labelled event groups, chunks, budgets, greedy cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import lexicon as L
from attestry.functions import text as T

MAX_GROUPS = 8
MAX_LABEL = 100
MAX_EXCERPT = 1200


def line_table(notes: DataFrame) -> DataFrame:
    """id, line_no (from 1), start (zero-based offset), line (with its end) of every line of ``notes`` (id, text).

    Offsets are prefix sums over the lines of a note, by a window that spills however long a note is.
    """
    split = notes.select("id", F.posexplode(T.lines(F.coalesce("text", F.lit("")))).alias("n", "line"))
    before = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return split.select("id", (F.col("n") + 1).alias("line_no"), F.coalesce(F.sum(F.length("line")).over(before), F.lit(0)).cast("int").alias("start"), "line")


def line_number(starts: Column, position: Column) -> Column:
    """Number of the line that holds a position: how many lines start at or before it."""
    return F.size(F.filter(starts, lambda s: s <= position))


def islands(rows: DataFrame, key: list[str], order: list[str], opens: Column) -> DataFrame:
    """``rows`` with ``island``: how many rows up to and with this one open an island; 0 before the first."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("island", F.sum(opens.cast("int")).over(w))


def event_groups(notes: DataFrame) -> DataFrame:
    """id, event_id, label, grouping, source_text, source_segments of every event group of ``notes`` (id, text).

    A line "EVENT: label" opens a group; bodies under labels that are equal but for case and blanks are joined by
    one newline that has no place in the source. Text before the first heading is a group of its own; without
    any heading the whole note is one. A note that breaks the contract (blank, no label, a label over 100
    characters, no body, more than 8 groups) has one row with ``error`` and no group.
    """
    bare = F.regexp_replace("line", f"[{L.LINE_END}]+$", "")
    lines = islands(line_table(notes).withColumn("heading", bare.rlike(L.EVENT_HEADING)), ["id"], ["line_no"], F.col("heading"))
    end = F.col("start") + F.length("line")
    named = lambda c: F.max(F.when(F.col("heading"), c))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("line_no", "line")))), lambda x: x.line), "")
    found = lines.groupBy("id", "island").agg(
        named(T.strip(F.regexp_extract(bare, L.EVENT_HEADING, 1))).alias("label"), F.coalesce(named(F.col("line_no")), F.lit(0)).alias("line_no"),
        F.coalesce(named(end), F.lit(0)).alias("start"), F.max(end).alias("end"), body.alias("body"))
    # Inside one note: its parts fit in one row's array as the note does in one text, whatever other notes hold.
    packed = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("island", "label", "line_no", "start", "end", "body"))).alias("p"))
    notes = notes.select("id").join(packed.withColumnRenamed("id", "id_"), F.col("id").eqNullSafe(F.col("id_")), "left").drop("id_")
    none = F.coalesce(F.element_at("p", -1).island, F.lit(0)) == 0
    kept = F.filter("p", lambda x: none | (x.island > 0) | (T.strip(x.body) != ""))
    parts = F.transform(kept, lambda x: F.struct(
        F.when(x.island > 0, x.label).when(none, "Supplied notes").otherwise("Unassigned context").alias("label"),
        F.when(x.island > 0, "explicit").when(none, "unseparated").otherwise("unassigned_context").alias("grouping"),
        T.normalize(x.label).alias("key"), x.start.alias("start"), x.end.alias("end"), x.line_no.alias("line_no"), x.body.alias("body")))
    keys = F.array_distinct(F.transform("parts", lambda p: F.coalesce(p.key, p.grouping)))
    bad = lambda test: F.get(F.filter("parts", lambda p: (p.grouping == "explicit") & test(p)), F.lit(0)).line_no.cast("string")
    checked = notes.withColumn("parts", parts).withColumn("keys", keys)
    empty, oversized, bodiless = bad(lambda p: p.label == ""), bad(lambda p: F.length(p.label) > MAX_LABEL), bad(lambda p: T.strip(p.body) == "")
    error = (
        F.when(F.col("parts").isNull() | F.forall("parts", lambda p: (T.strip(p.body) == "") & (p.grouping == "unseparated")), "blank note")
        .when(empty.isNotNull(), F.concat(F.lit("no label on line "), empty))
        .when(oversized.isNotNull(), F.concat(F.lit("label too long on line "), oversized))
        .when(bodiless.isNotNull(), F.concat(F.lit("no body under the heading on line "), bodiless))
        .when(F.size("keys") > MAX_GROUPS, "too many groups")
    )
    checked = checked.withColumn("error", error)
    groups = checked.where("error is null").select("id", "parts", F.posexplode("keys").alias("k", "key"))
    mine = F.filter("parts", lambda p: F.coalesce(p.key, p.grouping) == F.col("key"))
    groups = groups.select("id", "k", mine.alias("mine"))
    # Each part begins where the parts before it, and their joins, end.
    upto = T.running(F.transform("mine", lambda p: p.end - p.start + 1))
    placed = T.let(upto, lambda r: F.transform("mine", lambda p, k: F.struct(F.get(r, k).alias("local_start"), (F.get(r, k) + p.end - p.start).alias("local_end"), p.start.alias("start"), p.end.alias("end"))))
    one = F.get("mine", F.lit(0))
    rows = groups.select(
        "id", F.concat(F.lit("event-"), (F.col("k") + 1).cast("string")).alias("event_id"), one.label.alias("label"), one.grouping.alias("grouping"),
        F.array_join(F.transform("mine", lambda p: p.body), "\n").alias("source_text"), placed.alias("source_segments"), F.lit(None).cast("string").alias("error"))
    failed = checked.where("error is not null").select("id", "error")
    return rows.unionByName(failed, allowMissingColumns=True)


def chunk_bounds(n: Column, size: int, overlap: int) -> Column:
    """Array of (chunk, start, end) over ``n`` tokens: windows of ``size`` that share ``overlap``, the last one short."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - overlap) / step).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("chunk"), (k * step).alias("start"), F.least(k * step + size, n).alias("end")))


def within_budget(rows: DataFrame, key: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """The rows of each key before the first at which the running cost goes over the budget."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spent = rows.withColumn("spent", F.sum(cost).over(w))
    over = F.max((F.col("spent") > budget).cast("int")).over(w)
    return spent.withColumn("over", over).where("over = 0").drop("over")


def cut_pieces(text: Column, most: int = MAX_EXCERPT) -> Column:
    """Pieces of at most ``most`` characters, each cut at the last blank before the limit if there is one.

    The regex takes, from a sign on: the rest if it fits, else as much as a blank follows, else ``most`` characters.
    """
    rest = rf"\S[\s\S]{{0,{most - 1}}}\z|\S[\s\S]{{0,{most - 2}}}(?= )|\S[\s\S]{{0,{most - 1}}}"
    return F.transform(T.found(T.strip(text), rest), lambda p: T.strip(p))


def split_long(rows: DataFrame, most: int = MAX_EXCERPT) -> DataFrame:
    """id, piece_no (from 1), piece of every text of ``rows`` (id, text) with a sign other than white space."""
    pieces = rows.select("id", F.posexplode(cut_pieces(F.coalesce("text", F.lit("")), most)).alias("n", "piece"))
    return pieces.select("id", (F.col("n") + 1).cast("int").alias("piece_no"), "piece")


def first_of_each(rows: DataFrame, key: list[str], order: list, k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key, with ``place``; ranks are cut before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("place") <= k)

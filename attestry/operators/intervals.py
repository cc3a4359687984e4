"""Intervals and places: overlap joins, unions, gaps, as-of, quotes located in event groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import lexicon as L
from attestry.functions import text as T


def overlap_join(left: DataFrame, right: DataFrame, key: list[str], width: int) -> DataFrame:
    """Pairs of half-open intervals of one key that overlap, with the clipped interval.

    ``left``: key, left_id, l_start, l_end; ``right``: key, right_id, r_start, r_end. Both sides are dealt to time
    cells of ``width``, so the join is an equi-join on key and cell; a pair is taken in the first cell that both
    touch alone. Choose ``width`` near a typical interval. Empty intervals overlap nothing.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width))).alias("cell")
    a = left.where("l_start < l_end").select(*key, "left_id", "l_start", "l_end", cells("l_start", "l_end"))
    b = right.where("r_start < r_end").select(*key, "right_id", "r_start", "r_end", cells("r_start", "r_end"))
    met = a.join(b, [*key, "cell"]).where("l_start < r_end and r_start < l_end")
    start = F.greatest("l_start", "r_start")
    return met.where(F.floor(start / width) == F.col("cell")).select(*key, "left_id", "right_id", start.alias("start"), F.least("l_end", "r_end").alias("end"))


def union_intervals(rows: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """key, start, end: the intervals of each key merged where they touch or overlap."""
    before = Window.partitionBy(*key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(end).over(before)
    opened = rows.select(*key, F.col(start).alias("start"), F.col(end).alias("end"), (reach.isNull() | (F.col(start) > reach)).cast("int").alias("opens"))
    upto = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    return opened.withColumn("island", F.sum("opens").over(upto)).groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def merged(spans: Column) -> Column:
    """An array of (start, end) structs, sorted and merged where they touch or overlap.

    A span opens an island where all spans before it end earlier; the island reaches as far as any span before the next.
    """
    furthest = lambda s: T.running(F.transform(s, lambda x: x.end), -1, lambda a, b: F.greatest(a, b))
    opening = lambda s, reach: F.filter(F.transform(s, lambda x, k: F.struct(x.start.alias("start"), k.alias("k"), (F.get(reach, k) < x.start).alias("opens"))), lambda x: x.opens)
    closed = lambda o, reach: F.transform(o, lambda x, i: F.struct(x.start.alias("start"), F.coalesce(F.get(reach, F.get(o, i + 1).k), F.element_at(reach, -1)).alias("end")))
    return T.let(F.array_sort(spans), lambda s: T.let(furthest(s), lambda reach: T.let(opening(s, reach), lambda o: closed(o, reach))))


def coverage(facts: DataFrame) -> DataFrame:
    """id, source_characters, covered, unquoted: literal coverage of each ``source`` by its ``quotes``.

    ``facts``: id, source, quotes (array). Occurrences that don't overlap count, from the left; unquoted holds the
    other stretches, line by line, without section headings and without lines that have no word sign. With ``spans``
    (array of start, end) in place of quotes, these places alone are covered.
    """
    source = F.col("source")
    spans = F.col("spans") if "spans" in facts.columns else F.flatten(F.transform(F.filter(F.array_distinct("quotes"), lambda q: q != ""), lambda q: F.transform(T.separate_occurrences(source, q), lambda s: F.struct(s.alias("start"), (s + F.length(q)).alias("end")))))
    rows = facts.select("id", "source", merged(spans).alias("spans"))
    edges = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), F.col("spans"), F.array(F.struct(F.length(source).alias("start"), F.length(source).alias("end"))))
    gaps = F.transform(F.slice("edges", 2, F.size("edges")), lambda e, i: T.strip(F.substring(source, F.get("edges", i).end + 1, e.start - F.get("edges", i).end)))
    parts = F.transform(F.flatten(F.transform(gaps, lambda g: T.lines(g, keep_ends=False))), lambda p: T.strip(p))
    kept = F.filter(parts, lambda p: ~p.rlike(L.SECTION_HEADING) & p.rlike(r"[\p{L}\p{N}_]"))
    covered = F.aggregate("spans", F.lit(0), lambda acc, s: acc + s.end - s.start)
    return rows.withColumn("edges", edges).select("id", F.length(source).alias("source_characters"), covered.alias("covered"), kept.alias("unquoted"))


def candidates(source: Column, segments: Column, quote: Column) -> Column:
    """Every place of a quote in the joined text of an event group, as segments in offsets of the note.

    Overlapping occurrences count. One that crosses a join has two segments; one that is nothing but the join's
    newline has no place. An absent, empty or null quote has none. ``segments`` are in order, so the first and last that an
    occurrence touches are found by halves: the work grows with the occurrences, times the logarithm of the segments.
    """
    size = F.length(quote)

    def inside(all_: Column, start: Column) -> Column:
        first = T.first_index(F.size(all_), lambda k: F.get(all_, k).local_end > start)
        behind = T.first_index(F.size(all_), lambda k: F.get(all_, k).local_start >= start + size)
        touched = T.let(first, lambda lo: F.slice(all_, lo + 1, F.greatest(behind - lo, F.lit(0))))
        clipped = F.transform(touched, lambda s: F.struct(
            (s.start + F.greatest(start, s.local_start) - s.local_start).alias("start"),
            (s.start + F.least(start + size, s.local_end) - s.local_start).alias("end")))
        return F.filter(clipped, lambda s: s.start < s.end)

    places = T.let(segments, lambda all_: F.transform(T.occurrences(source, quote), lambda i: F.struct(inside(all_, i).alias("segments"))))
    real = F.filter(places, lambda c: F.size(c.segments) > 0)
    # Two occurrences have the same places only if they begin before and behind one join, so next to each other.
    return T.let(real, lambda r: F.filter(r, lambda c, k: (k == 0) | (c.segments != F.get(r, k - 1).segments)))


def locate(groups: DataFrame, quotes: DataFrame) -> DataFrame:
    """id, event_id, quote, candidates, ambiguous: every place of a quote in its event group, in source offsets.

    ``groups`` as of ``segment.event_groups``; ``quotes``: id, event_id, quote. See ``candidates``. A quote is
    located once for each group, however many claims cite it.
    """
    asked = quotes.select("id", "event_id", "quote").distinct().join(groups.select("id", "event_id", "source_text", "source_segments"), ["id", "event_id"])
    found = candidates(F.col("source_text"), F.col("source_segments"), F.col("quote"))
    return asked.select("id", "event_id", "quote", found.alias("candidates")).withColumn("ambiguous", F.size("candidates") > 1)


def with_lines(located: DataFrame, notes: DataFrame) -> DataFrame:
    """``located`` with line_start and line_end, from 1, in each segment: the lines of ``notes`` (id, text) that it touches."""
    lengths = F.transform(T.lines(F.coalesce("text", F.lit(""))), F.length)
    starts = notes.select("id", T.let(T.running(lengths), lambda r: F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(1)))).alias("starts"))
    line = lambda at: T.first_index(F.size("starts"), lambda k: F.get("starts", k) > at)
    placed = F.transform("candidates", lambda c: F.struct(F.transform(c.segments, lambda s: F.struct(s.start, s.end, line(s.start).alias("line_start"), line(F.greatest(s.start, s.end - 1)).alias("line_end"))).alias("segments")))
    return located.join(starts, "id").withColumn("candidates", placed).drop("starts")


def lineage_errors(saved: DataFrame, groups: DataFrame, notes: DataFrame) -> DataFrame:
    """id, event_id, quote, error of ``saved`` evidence (as of ``with_lines``) that isn't what the source gives.

    Places are located anew from ``notes`` and ``groups`` and compared null-safe: 'absent' for a quote without any place,
    'shifted' where candidates, lines or ambiguity differ, 'unknown event' for an event that the note hasn't.
    """
    found = with_lines(locate(groups, saved), notes).select("id", "event_id", "quote", F.col("candidates").alias("want"), F.col("ambiguous").alias("several"), F.lit(True).alias("known"))
    both = saved.select("id", "event_id", "quote", "candidates", "ambiguous").join(found, ["id", "event_id", "quote"], "left")
    same = F.col("candidates").eqNullSafe(F.col("want")) & F.col("ambiguous").eqNullSafe(F.col("several"))
    error = F.when(F.col("known").isNull(), "unknown event").when(F.size("want") == 0, "absent").when(~same, "shifted")
    return both.select("id", "event_id", "quote", error.alias("error")).where("error is not null")


def latest_before(rows: DataFrame, key: list[str], order: list[str], source: Column, value: Column) -> DataFrame:
    """``rows`` with ``as_of``: ``value`` of the last earlier row of the key for which ``source`` holds."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("as_of", F.last(F.when(source, value), ignorenulls=True).over(w))

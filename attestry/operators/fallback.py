"""Where a draft can't be trusted, the source's own words: nothing that a note says is lost to a failed check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import lexicon as L
from attestry.functions import text as T
from attestry.operators import clean as K
from attestry.operators import intervals as I
from attestry.operators.assemble import QUESTIONS
from attestry.operators.segment import MAX_EXCERPT, cut_pieces


def source_wording(claims: DataFrame) -> DataFrame:
    """id, ord, text of ``claims`` (id, quotes): their distinct quotes as excerpts, for claims whose own wording was rejected.

    A quote is cleaned of untrusted text and cut into sentences; a sentence that isn't a stretch of the quote goes, as
    cleaning has joined what didn't stand together; long ones are cut. ``ord`` counts from 0. A claim without usable
    quotes has no row.
    """
    quotes = claims.select("id", F.posexplode(F.array_distinct("quotes")).alias("q", "quote"))
    cleaned = K.clean(quotes.select(F.struct("id", "q", "quote").alias("id"), F.col("quote").alias("text"))).select("id.*", "cleaned")
    segments = F.filter(F.transform(T.sentences(F.col("cleaned")), lambda s: T.strip(s)), lambda s: (s != "") & F.contains(F.col("quote"), s))
    rows = cleaned.select("id", "q", F.flatten(F.transform(segments, lambda s: cut_pieces(s))).alias("pieces"))
    gathered = rows.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("q", "pieces"))), lambda x: x.pieces)).alias("pieces"))
    return gathered.select("id", F.posexplode("pieces").alias("ord", "text"))


def passages(source: Column) -> Column:
    """The lines of a source as excerpts: stripped, cut, each once, none of them empty."""
    return F.array_distinct(F.flatten(F.transform(T.lines(F.coalesce(source, F.lit("")), keep_ends=False), lambda x: cut_pieces(x))))


def incomplete_drafts(failures: DataFrame) -> DataFrame:
    """The draft of a note or event that failed: all lines of its source as excerpts, no fact, every section missing.

    ``failures``: id, source, error (text), and the issues, chunks and tokens of whatever was done before, which may be
    null. One row each: id, sections (empty map), excerpts, missing_fields, questions, issues, status, chunks, tokens.
    """
    none = F.expr("cast(map() as map<string,array<string>>)")
    issues = F.concat(F.array(F.coalesce(F.col("error"), F.lit(""))), F.coalesce("issues", F.array().cast("array<string>")))
    return failures.select(
        "id", none.alias("sections"), passages(F.col("source")).alias("excerpts"), F.array(*[F.lit(s) for s in L.SECTIONS]).alias("missing_fields"),
        F.array(F.lit("Review these source passages and retry this event.")).alias("questions"), issues.alias("issues"), F.lit("incomplete_draft").alias("status"),
        F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def add_uncovered(drafts: DataFrame, most: int = MAX_EXCERPT, again: bool = False) -> DataFrame:
    """``drafts`` with the source text outside accepted evidence among their excerpts.

    ``drafts``: id, source, quotes (of accepted facts; or spans, see ``intervals.coverage``), excerpts (texts), issues, status.
    A stretch that an excerpt shows already is only added ``again`` on demand; others come whole or cut at blanks. ``added`` tells how many; if any, an issue says so
    and a draft that was ready needs confirmation. Coverage figures come along: source_characters, covered.
    """
    found = I.coverage(drafts).select("id", "source_characters", "covered", "unquoted")
    rows = drafts.join(found, "id").withColumn("pieces", F.transform("unquoted", lambda u: cut_pieces(u, most)))
    shown = F.array_join("excerpts", "\n")
    earlier = lambda k: F.flatten(F.slice("pieces", F.lit(1), k))
    fresh = F.transform("unquoted", lambda u, k: F.when(F.contains(shown, u) | F.exists(earlier(k), lambda e: F.contains(e, u)), F.array().cast("array<string>")).otherwise(F.get("pieces", k)))
    rows = rows.withColumn("new", F.flatten("pieces" if again else fresh)).withColumn("added", F.size("new"))
    issue = F.concat(F.col("added").cast("string"), F.lit(" source passage(s) were not covered by accepted factual evidence. They are preserved below for review, including details without dates or reference numbers."))
    some = F.col("added") > 0
    status = F.when(some & (F.col("status") != "incomplete_draft"), "needs_confirmation").otherwise(F.col("status"))
    return rows.select(
        "id", F.concat("excerpts", "new").alias("excerpts"), F.when(some, F.array_append("issues", issue)).otherwise(F.col("issues")).alias("issues"), status.alias("status"),
        "added", "source_characters", "covered", "unquoted")


def withhold_unlocatable(events: DataFrame) -> DataFrame:
    """``events`` without entries whose quotes have no place in the event's source, and with its passages instead.

    ``events``: id, event_id, source_text, source_segments (as of ``segment.event_groups``), facts and suggestions
    (arrays of section, text, quotes), excerpts (text, quotes), missing_fields, questions, issues, status. An entry stays
    if each of its quotes has a candidate place. For every other one an issue is added; if there was any, the source's
    lines that no excerpt shows are appended. missing_fields and questions follow the facts that stay; an issue tells of quotes
    with several places. Any issue means that the event needs confirmation.
    """
    places = lambda q: I.candidates(F.col("source_text"), F.col("source_segments"), q)
    # Each distinct quote is located once, whatever cites it.
    cited = F.array_distinct(F.flatten(F.concat(*[F.transform(c, lambda e: e.quotes) for c in ("facts", "suggestions", "excerpts")])))
    rows = events.withColumn("cited", F.transform(cited, lambda q: F.struct(q.alias("quote"), F.size(places(q)).alias("n"))))
    known = F.map_from_entries(F.transform("cited", lambda c: F.struct(c.quote, c.n)))
    rows = rows.withColumn("known", known)
    held = lambda e: F.forall(e.quotes, lambda q: F.coalesce(F.try_element_at("known", q), F.lit(0)) > 0)
    stay, go = (lambda c: F.filter(c, held)), (lambda c: F.filter(c, lambda e: ~held(e)))
    lost = lambda c, kind: F.transform(go(c), lambda e: F.concat(F.upper(e.section), F.lit(f": a {kind} could not be linked to the original source and was withheld. Compare the original event notes.")))
    replaced = F.transform(go("excerpts"), lambda e: F.lit("An unassigned excerpt could not be linked to the original source and was replaced with original event passages for review."))
    rows = rows.withColumns({"facts_": stay("facts"), "suggestions_": stay("suggestions"), "excerpts_": stay("excerpts"), "lost": F.concat(lost("facts", "fact"), lost("suggestions", "suggestion"), replaced)})
    shown = F.transform("excerpts_", lambda e: e.text)
    own = F.transform(F.array_except(passages(F.col("source_text")), shown), lambda t: F.struct(t.alias("text"), F.array(t).alias("quotes")))
    rows = rows.withColumn("excerpts_", F.when(F.size("lost") > 0, F.concat("excerpts_", own)).otherwise(F.col("excerpts_")))
    kept = F.flatten(F.transform(F.concat(F.transform("facts_", lambda e: e.quotes), F.transform("suggestions_", lambda e: e.quotes), F.transform("excerpts_", lambda e: e.quotes)), lambda q: q))
    several = F.exists(kept, lambda q: F.coalesce(F.try_element_at("known", q), F.size(places(q))) > 1)
    told = F.when(several, F.array(F.lit("Some quoted wording occurs more than once within this event. All matching source locations are shown; confirm the intended speaker and update."))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("issues_", F.concat("issues", "lost", told))
    missing = F.filter(F.array(*[F.lit(s) for s in L.SECTIONS]), lambda s: ~F.exists("facts_", lambda e: e.section == s))
    ask = F.create_map(*[F.lit(x) for pair in QUESTIONS.items() for x in pair])
    rows = rows.withColumn("missing_", missing)
    asked = F.array_distinct(F.concat("questions", F.transform(F.array_except("missing_", "missing_fields"), lambda s: F.element_at(ask, s))))
    status = F.when((F.size("issues_") > 0) & (F.col("status") != "incomplete_draft"), "needs_confirmation").otherwise(F.col("status"))
    return rows.select(
        "id", "event_id", F.col("facts_").alias("facts"), F.col("suggestions_").alias("suggestions"), F.col("excerpts_").alias("excerpts"),
        F.col("missing_").alias("missing_fields"), asked.alias("questions"), F.col("issues_").alias("issues"), status.alias("status"))

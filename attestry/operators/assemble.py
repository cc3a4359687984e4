"""Records of all chunks of a note as one draft: union, keep-first, order, topics, top suggestions, questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import lexicon as L
from attestry.functions import text as T
from attestry.operators import grounding as G


def position(quotes: Column, source: Column) -> Column:
    """Earliest place of any of a claim's quotes in its source."""
    return F.array_min(F.transform(quotes, lambda q: T.find(q, source)))


def merge_facts(facts: DataFrame) -> DataFrame:
    """Distinct facts of each note and section in the order of their earliest evidence.

    ``facts``: id, section, ord, text, evidence, source. Equal: text and sorted quotes but for case and outer blanks.
    The first by ``ord`` stays; the same quote under another text stays too. ``place`` counts from 1.
    """
    low = lambda c: T.strip(F.lower(c))
    key = F.struct(low(F.col("text")), F.array_sort(F.transform("evidence", low)))
    first = facts.withColumn("n", F.row_number().over(Window.partitionBy("id", "section", key).orderBy("ord"))).where("n = 1").drop("n")
    placed = first.withColumn("at", position(F.col("evidence"), F.col("source")))
    return placed.withColumn("place", F.row_number().over(Window.partitionBy("id", "section").orderBy("at", "ord")))


def topic(starts: Column, at: Column) -> Column:
    """Number of the last situation that starts at or before a place; 0 before the first and without any."""
    before = F.filter(F.transform(starts, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: x.s <= at)
    return F.coalesce(F.try_element_at(before, F.lit(-1)).i, F.lit(0))


def keep_suggestions(suggestions: DataFrame, facts: DataFrame, most: int = 2) -> DataFrame:
    """Suggestions that no fact of their topic makes needless, at most ``most`` a section, in order.

    ``suggestions``: id, ord, section, text, basis, confirm, source; ``facts`` as of ``merge_facts``. In this order: a
    possible impact against a reported one goes, then one where the impact is known, then an action or plan where
    no further one is stated, then repeats of a text; the rest is cut to the first ``most``.
    """
    of = lambda s: F.filter("facts", lambda f: f.section == s)
    struct = F.struct("section", "at", "place", "text")
    held = facts.groupBy("id").agg(F.array_sort(F.collect_list(struct)).alias("facts"))
    rows = suggestions.join(held, "id", "left").withColumn("facts", F.coalesce("facts", F.array().cast(held.schema["facts"].dataType)))
    rows = rows.withColumn("starts", F.transform(F.array_sort(of("situation"), lambda a, b: F.when(a.place < b.place, -1).otherwise(1)), lambda f: f.at))
    rows = rows.withColumn("topic", topic(F.col("starts"), position(F.col("basis"), F.col("source"))))
    related = F.filter("facts", lambda f: (f.section == F.col("section")) & ((F.size("starts") <= 1) | (topic(F.col("starts"), f.at) == F.col("topic"))))
    known = F.array_join(F.transform(related, lambda f: f.text), " ")
    against = (F.col("section") == "impact") & G.contradicts_impact(F.col("text"), F.transform(of("impact"), lambda f: f.text))
    needless = ((F.col("section") == "impact") & (known != "") & ~known.rlike(L.UNCERTAIN)) | (F.col("section").isin("action", "plan") & known.rlike(L.NO_FURTHER))
    kept = rows.where(~against & ~needless)
    fresh = kept.withColumn("n", F.row_number().over(Window.partitionBy("id", "section", T.strip(F.lower("text"))).orderBy("ord"))).where("n = 1")
    ranked = fresh.withColumn("place", F.row_number().over(Window.partitionBy("id", "section").orderBy("ord"))).where(F.col("place") <= most)
    return ranked.select("id", "section", "place", "text", "basis", "confirm")


#: What to ask where a section is empty.
QUESTIONS = {
    "situation": "What happened, with the date, time zone, and times of each particular event?",
    "impact": "What impact was observed? Explicitly state no impact or not yet assessed when appropriate.",
    "agencies_contacted": "Which agencies were contacted, with contact initials? Explicitly state none contacted if applicable.",
    "action": "What action was actually taken? Explicitly state no action taken if applicable.",
    "plan": "What is the next step, with an owner and due time if known? Explicitly state no further action if applicable.",
}
#: What to ask about what a draft says.
ASK_TIMES = "What were the times of the individual events?"
ASK_YEAR = "What year applies to the supplied event date?"
ASK_DATE = "What date applies to these events?"
ASK_ZONE = "What time zone applies to the event times?"
ASK_INITIALS = "What initials belong with each contacted agency?"
ASK_OPEN = {s: f"What remains to be confirmed in {s.replace('_', ' ').upper()}? Preserve the stated uncertainty until confirmed." for s in L.SECTIONS}


def questions(drafts: DataFrame) -> DataFrame:
    """id, missing_fields, questions, status of ``drafts``: id, sections (map of section to fact texts), confirms, issues.

    ``confirms``: map of section to the confirmation of its first kept suggestion. Questions come in the order of their
    rules, each once.
    """
    facts = lambda s: F.coalesce(F.try_element_at("sections", F.lit(s)), F.array().cast("array<string>"))
    missing = F.filter(F.array(*[F.lit(s) for s in L.SECTIONS]), lambda s: F.size(F.coalesce(F.try_element_at("sections", s), F.array().cast("array<string>"))) == 0)
    ask = F.create_map(*[F.lit(x) for pair in QUESTIONS.items() for x in pair])
    default = F.transform(missing, lambda s: F.coalesce(F.try_element_at("confirms", s), F.try_element_at(ask, s)))
    situation, contacts = F.array_join(facts("situation"), " "), facts("agencies_contacted")
    stated = situation != ""
    joined = F.array_join(contacts, "; ")
    rules = [
        F.when(stated & ~situation.rlike(L.TIME), ASK_TIMES),
        F.when(stated & ~situation.rlike(L.DATE), F.when(situation.rlike(L.PARTIAL_DATE), ASK_YEAR).otherwise(ASK_DATE)),
        F.when(stated & ~situation.rlike(L.ZONE), ASK_ZONE),
        F.when((joined != "") & ~joined.rlike(L.NO_CONTACT) & F.exists(contacts, lambda c: ~c.rlike(L.INITIALS)), ASK_INITIALS),
        *[F.when(F.exists(facts(s), lambda t: t.rlike(L.UNCERTAIN)), ASK_OPEN[s]) for s in L.SECTIONS],
    ]
    asked = F.array_distinct(F.concat(default, F.map_values("confirms"), F.array_compact(F.array(*rules))))
    rows = drafts.select("id", missing.alias("missing_fields"), asked.alias("questions"), "issues", "confirms")
    open_ = (F.size("questions") > 0) | (F.size("issues") > 0) | (F.size("confirms") > 0)
    return rows.select("id", "missing_fields", "questions", F.when(open_, "needs_confirmation").otherwise("ready_for_human_review").alias("status"))


def first_confirms(suggestions: DataFrame) -> DataFrame:
    """id, confirms: a map of section to the confirmation of its first kept suggestion (id, section, place, confirm)."""
    first = suggestions.groupBy("id", "section").agg(F.min_by("confirm", "place").alias("confirm"))
    return first.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "confirm")))).alias("confirms"))


def chunk_facts(records: DataFrame) -> DataFrame:
    """id, section, ord, text, evidence: the facts of all chunks of a note in one table, in the order of chunk, section and place.

    ``records``: id, chunk, facts (array of section, text, evidence). Chunks whose output failed have null facts and no rows.
    """
    order = {s: n for n, s in enumerate(L.SECTIONS)}
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    rows = records.select("id", "chunk", F.posexplode("facts").alias("n", "f"))
    w = Window.partitionBy("id").orderBy("chunk", F.try_element_at(place, F.col("f.section")), "n")
    return rows.select("id", "f.section", F.row_number().over(w).alias("ord"), "f.text", "f.evidence")


def omitted_times(source: Column, retained: Column) -> Column:
    """Times of a source, in upper case and sorted, that the facts lack."""
    upper = lambda t: F.transform(T.times(t), F.upper)
    return F.array_sort(F.array_except(upper(source), upper(retained)))


def focus(covered: Column, sections: Column, source: Column) -> Column:
    """Which of impact, action and plan still need a suggestion: not covered, and empty or uncertain."""

    def needs(s: str) -> Column:
        facts = F.array_join(F.coalesce(F.try_element_at(sections, F.lit(s)), F.array().cast("array<string>")), " ")
        open_ = (facts == "") | facts.rlike(L.UNCERTAIN)
        return F.when(~F.array_contains(covered, s) & (open_ | source.rlike(L.UNCERTAIN) if s == "impact" else open_), s)

    return F.array_compact(F.array(*[needs(s) for s in ("impact", "action", "plan")]))


def note_status(events: DataFrame) -> DataFrame:
    """id, status, chunks: a note is incomplete if any of its events is; otherwise its author has to confirm."""
    worst = F.when(F.bool_or(F.col("status") == "incomplete_draft"), "incomplete_draft").otherwise("needs_confirmation")
    return events.groupBy("id").agg(worst.alias("status"), F.sum("chunks").alias("chunks"))

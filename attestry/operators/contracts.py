"""Contracts of curated rows: completeness of a reviewed record, targets of training rows, expectations of test cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import lexicon as L
from attestry.functions import prompts
from attestry.functions import text as T
from attestry.operators import schema
from attestry.operators import variants as V

#: Patterns of the first review contract, which has its own.
PLAIN_TIME = r"\b(?:[01]?\d|2[0-3]):[0-5]\d\b|\b(?:[01]\d|2[0-3])[0-5]\dZ\b"
PLAIN_ZONE = r"\b(?:UTC|GMT|EDT|EST|CDT|CST|MDT|MST|PDT|PST)\b|\d{4}Z\b|\d{2}:\d{2}Z\b"
OPEN_SITUATION = r"(?i)\b(unconfirmed|unknown|uncertain)\b"
OPEN_IMPACT = r"(?i)\b(not yet assessed|not assessed|unconfirmed|unknown|pending assessment)\b"
OPEN_PLAN = r"(?i)\b(not yet|not assigned|unknown|unconfirmed|not established)\b"
NO_AGENCY = r"(?i)^(?:none(?: contacted)?|no agencies contacted|not applicable)[.!]?$"
#: The issues of a review, in the order of their rules.
REVIEW_ISSUES = [
    "SITUATION: supply the times of the particular events.",
    "SITUATION: confirm the event date (the POC checker expects YYYY-MM-DD).",
    "SITUATION: confirm the time zone; none is explicit in a recognized format.",
    "SITUATION contains unresolved uncertainty; preserve it and seek clarification.",
    "IMPACT: assessment is unresolved. Preserve the stated uncertainty and confirm how it will be assessed.",
    "PLAN: clarify the pending next step, owner, and due time; do not invent them.",
    "AGENCIES CONTACTED: confirm initials for each agency (POC format: Agency (AB); Agency (CD)).",
    "Some times in the source were not retained; compare the complete chronology manually.",
    "Confirm the event category with the author.",
]
#: How a proposal among facts begins, and how a suggestion has to read.
PROPOSAL_STARTS = ("Possible impact:", "Consider ", "Proposed follow-up:")
IMPACT_MARKERS = ("may", "could", "unconfirmed", "unknown")
STEP_MARKERS = ("Consider ", "Proposed follow-up:")


def review(records: DataFrame) -> DataFrame:
    """id, checked, missing_fields, issues, status of ``records``: id, event_type, source, and a text for each section.

    A section that isn't an exact stretch of the source becomes null, with an issue; every null section is missing. Then
    the rules of ``REVIEW_ISSUES`` follow. Without missing sections and issues a record is ready for review by a person.
    """
    source = F.coalesce("source", F.lit(""))
    exact = lambda s: F.col(s).isNotNull() & F.contains(source, F.col(s))
    base = records.select("id", "event_type", source.alias("source"), *[F.when(exact(s), F.col(s)).alias(s) for s in L.SECTIONS],
                          F.array_compact(F.array(*[F.when(F.col(s).isNotNull() & ~exact(s), F.concat(F.lit("Unsupported source quote rejected: "), F.lit(s))) for s in L.SECTIONS])).alias("rejected"))
    situation, contacts = F.coalesce("situation", F.lit("")), F.coalesce("agencies_contacted", F.lit(""))
    named = F.filter(F.split(contacts, ";|\n"), lambda c: T.strip(c) != "")
    kept = F.concat_ws("\n", *[F.coalesce(s, F.lit("")) for s in L.SECTIONS])
    rules = [
        (situation != "") & ~situation.rlike(PLAIN_TIME),
        (situation != "") & ~situation.rlike(L.ISO_DATE),
        (situation != "") & ~situation.rlike(PLAIN_ZONE),
        situation.rlike(OPEN_SITUATION),
        F.coalesce(F.col("impact").rlike(OPEN_IMPACT), F.lit(False)),
        F.coalesce(F.col("plan").rlike(OPEN_PLAN), F.lit(False)),
        (contacts != "") & ~T.strip(contacts).rlike(NO_AGENCY) & F.exists(named, lambda c: ~c.rlike(r"\([A-Z]{2,4}\)")),
        F.exists(T.found(F.col("source"), PLAIN_TIME), lambda t: ~F.contains(kept, t)),
        F.col("event_type") == "other",
    ]
    issues = F.concat("rejected", F.array_compact(F.array(*[F.when(bad, text) for bad, text in zip(rules, REVIEW_ISSUES)])))
    missing = F.array_compact(F.array(*[F.when(F.col(s).isNull(), s) for s in L.SECTIONS]))
    rows = base.select("id", F.struct("event_type", *L.SECTIONS).alias("checked"), missing.alias("missing_fields"), issues.alias("issues"))
    open_ = (F.size("missing_fields") > 0) | (F.size("issues") > 0)
    return rows.withColumn("status", F.when(open_, "needs_details").otherwise("ready_for_human_review"))


def _named(checks: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for bad, name in checks]))


def target_errors(rows: DataFrame) -> DataFrame:
    """id, errors of training targets: the rules of the third curriculum, each breach by name, in order; empty if sound.

    ``rows``: id, task ('main' or 'helper'), source, facts (section, text, evidence), suggestions (section, text, basis,
    confirm), focus (sections asked of a helper), expected and target (JSON texts that must be
    the same value). The chat around them is ``chat_errors``' matter. Facts: every quote in the source, at most 4, no proposal. Suggestions: every quote in the source,
    at most 420 characters, 2 quotes of 500, a question of 240, worded as a proposal; a helper's inside its focus, one a section.
    """
    source, main = F.col("source"), F.col("task") == "main"
    foreign = lambda quotes: F.exists(quotes, lambda q: ~F.contains(source, q))
    starts = lambda text: F.exists(F.array(*[F.lit(p) for p in PROPOSAL_STARTS]), lambda p: F.startswith(text, p))
    holds = lambda text, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
    long_ = lambda s: (F.length(s.text) > 420) | (F.size(s.basis) > 2) | F.exists(s.basis, lambda q: F.length(q) > 500) | (F.length(s.confirm) > 240)
    framed = lambda s: F.when(s.section == "impact", holds(s.text, IMPACT_MARKERS)).otherwise(holds(s.text, STEP_MARKERS))
    sections = F.transform("suggestions", lambda s: s.section)
    same = F.coalesce(F.to_json(F.try_parse_json("expected")) == F.to_json(F.try_parse_json("target")), F.lit(False))
    return rows.select("id", _named([
        (~same, "target differs from expected"),
        (main & F.exists("facts", lambda f: foreign(f.evidence)), "evidence absent"),
        (main & F.exists("facts", lambda f: F.size(f.evidence) > 4), "too many quotes"),
        (main & F.exists("facts", lambda f: starts(f.text)), "proposal among facts"),
        (~main & F.exists(sections, lambda s: ~F.array_contains("focus", s)), "outside the focus"),
        (~main & (F.size(F.array_distinct(sections)) != F.size(sections)), "section repeated"),
        (F.exists("suggestions", lambda s: foreign(s.basis)), "basis absent"),
        (F.exists("suggestions", long_), "suggestion too long"),
        (F.exists("suggestions", lambda s: ~framed(s)), "no proposal wording"),
    ]).alias("errors"))


def chat_errors(rows: DataFrame, main: str, helper: str, shapes: dict[str, dict] | None = None) -> DataFrame:
    """id, errors of the chats of training rows, in order; empty if they are those that a run would send and answer.

    ``rows``: id, task ('main' or 'helper'), mode, source, messages (role, content), expected (JSON). ``main`` and ``helper`` are the system prompts. The
    last message has to be the assistant's and the same JSON value as expected, the ones before it those that are made
    anew from the row: for a helper from the sections asked for and the known facts that its own message names, which
    has to hold the row's source. ``shapes``: by task, the closed schema of expected (``schema.RECORD`` and ``HELPER`` unless given).
    """
    shapes = shapes or {"main": schema.RECORD, "helper": schema.HELPER}
    is_main, n = F.col("task") == "main", F.size("messages")
    last, asked = F.element_at("messages", -1), F.try_parse_json(F.get("messages", F.lit(1)).content)
    payload = F.from_json(F.get("messages", F.lit(1)).content, "struct<source_text:string,focus_sections:array<string>,existing_log_facts_context:map<string,array<string>>>")
    known = F.map_from_entries(F.array(*[F.struct(F.lit(s), F.try_element_at(payload.existing_log_facts_context, F.lit(s))) for s in L.SECTIONS]))
    anew = F.when(is_main, prompts.messages(main, F.col("mode"), F.col("source"))).otherwise(prompts.helper_messages(helper, F.col("source"), payload.focus_sections, known))
    sent = F.transform(F.slice("messages", F.lit(1), F.greatest(n - 1, F.lit(0))), lambda m: F.struct(m.role.alias("role"), m.content.alias("content")))
    answered = (last.role == "assistant") & (F.size(V.differences(F.try_parse_json(last.content), F.try_parse_json("expected"))) == 0) & F.try_parse_json("expected").isNotNull()
    shape = F.when(is_main, F.size(schema.errors(F.col("expected"), shapes["main"])) > 0).otherwise(F.size(schema.errors(F.col("expected"), shapes["helper"])) > 0)
    tips = F.from_json("expected", "struct<suggestions:array<struct<section:string>>>").suggestions
    outside = F.exists(tips, lambda t: ~F.array_contains(payload.focus_sections, t.section))
    return rows.select("id", _named([
        (shape, "schema"),
        (~F.coalesce((n > 0) & answered, F.lit(False)), "target differs from expected"),
        (~is_main & ~F.coalesce(payload.source_text == F.col("source"), F.lit(False)), "helper source"),
        (~F.coalesce(sent == anew, F.lit(False)), "prompt contract"),
        (~is_main & (outside | asked.isNull()), "outside the focus"),
    ]).alias("errors"))


def early_target_errors(rows: DataFrame) -> DataFrame:
    """id, errors of training targets by the rules of the second curriculum; columns as of ``target_errors``, and event_type.

    Facts have a text and evidence, every quote is non-empty and in the source, confirmations end in a question mark.
    """
    source = F.col("source")
    foreign = lambda quotes: F.exists(quotes, lambda q: (q == "") | ~F.contains(source, q))
    return rows.select("id", _named([
        (~F.coalesce(F.col("event_type").isin(L.EVENT_TYPES), F.lit(False)), "event_type"),
        (F.exists("facts", lambda f: T.strip(f.text) == ""), "empty fact"),
        (F.exists("facts", lambda f: F.size(f.evidence) == 0), "no evidence"),
        (F.exists("facts", lambda f: foreign(f.evidence)), "evidence absent"),
        (F.exists("suggestions", lambda s: foreign(s.basis)), "basis absent"),
        (F.exists("suggestions", lambda s: ~F.endswith(s.confirm, F.lit("?"))), "confirmation is no question"),
    ]).alias("errors"))


def conflicting_checks(checks: DataFrame) -> DataFrame:
    """``checks`` (required and forbidden: arrays of fragments) whose normalised fragments are asked for and ruled out at once."""
    low = lambda c: F.transform(c, T.normalize)
    return checks.where(F.arrays_overlap(low("required"), low("forbidden")))


def unsupported_checks(checks: DataFrame, groups: DataFrame) -> DataFrame:
    """id, ord, error of expectations that no output could meet or that say nothing.

    ``checks``: id, ord, label, required, forbidden; ``groups`` (id, label, source_text and, as of ``segment.event_groups``, grouping) are the case's own
    events. In a note without labelled events a check has no label and is about the whole note, which is the one group of it, without a
    label or 'unseparated'. 'label' for an event that the case hasn't and for a check without label in a case that has events,
    'empty' without fragments, 'conflict', 'absent' for a required fragment that the text lacks.
    """
    grouping = F.col("grouping") if "grouping" in groups.columns else F.when(F.col("label").isNotNull(), "explicit").otherwise("unseparated")
    texts = groups.where(grouping.isin("explicit", "unseparated")).select(
        F.col("id").alias("case"), F.when(grouping == "explicit", T.normalize(F.col("label"))).alias("event"), T.normalize(F.col("source_text")).alias("own"))
    joined = checks.withColumn("key", T.normalize(F.col("label"))).join(texts, (F.col("id") == F.col("case")) & F.col("key").eqNullSafe(F.col("event")), "left")
    low = lambda c: F.transform(c, T.normalize)
    error = (
        F.when(F.col("own").isNull(), "label").when((F.size("required") == 0) & (F.size("forbidden") == 0), "empty")
        .when(F.arrays_overlap(low("required"), low("forbidden")), "conflict").when(F.exists(low("required"), lambda f: ~F.contains("own", f)), "absent")
    )
    return joined.select("id", "ord", error.alias("error")).where("error is not null")


def thresholds(cases: DataFrame, long_words: int = 1_700, n_long: int = 2, n_unlabelled: int = 1, n_revisited: int = 1) -> DataFrame:
    """check, found, least, met: whether ``cases`` (text, labels, headings: numbers) hold enough long, unlabelled and revisited ones."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    counts = cases.agg(F.count_if(words >= long_words).alias("long"), F.count_if(F.col("labels") == 0).alias("unlabelled"), F.count_if(F.col("headings") > F.col("labels")).alias("revisited"))
    least = {"long": n_long, "unlabelled": n_unlabelled, "revisited": n_revisited}
    rows = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("found"), F.lit(n).cast("long").alias("least")) for c, n in least.items()])
    return counts.select(F.inline(rows)).withColumn("met", F.col("found") >= F.col("least"))

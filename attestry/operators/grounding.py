"""Claims against their evidence: quotes, numbers, initials, proposals, risky paraphrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import lexicon as L
from attestry.functions import text as T

#: The reasons, in the order of the rules; the first that holds is the result.
REASONS = [
    "a calendar date absent from its evidence",
    "a reference identifier absent from its evidence",
    "a blanket no-action claim absent from its evidence",
    "a confirmed absence of impact from an absence of impact reports",
    "an omission of contact initials stated in its evidence",
    "a loss of uncertainty stated in its evidence",
    "a change in negation compared with its evidence",
    "requested or planned work presented as completed",
]


def quotes_exist(quotes: Column, source: Column) -> Column:
    """Every quote is a substring of the source, case and all."""
    return F.forall(quotes, lambda q: F.contains(source, q))


def evidence_text(quotes: Column) -> Column:
    return F.array_join(quotes, "\n")


def unsupported_numbers(text: Column, evidence: Column) -> Column:
    """Numbers and times of a text that its evidence lacks."""
    return F.array_except(T.numbers(text), T.numbers(evidence))


def has_word(text: Column, word: Column) -> Column:
    """A word, as one of its own and in any case, in a text; the word has no signs of its own."""
    return F.regexp(text, F.concat(F.lit(r"(?i)\b\Q"), word, F.lit(r"\E\b")))


def unsupported_detail(text: Column, quotes: Column) -> Column:
    """Why a text has a detail that its quotes lack, or null."""
    evidence = evidence_text(quotes)
    return F.when(F.size(unsupported_numbers(text, evidence)) > 0, "a number or time absent from its evidence").when(
        F.exists(T.found(text, L.INITIALS, 1), lambda i: ~has_word(evidence, i)), "contact initials absent from its evidence")


def omitted_initials(text: Column, quotes: Column) -> Column:
    """Initials that the quotes state as such and the text lacks."""
    return F.filter(T.found(evidence_text(quotes), L.STATED_INITIALS, 1), lambda i: ~has_word(text, i))


def unrecorded_proposal(section: Column, text: Column, quotes: Column) -> Column:
    """A proposal among facts: labelled as one, or an order that the evidence doesn't give."""
    text, evidence = T.strip(text), evidence_text(quotes)
    verb = F.regexp_extract(text, L.IMPERATIVE_FACT, 1)
    ordered = (verb != "") & ((section == "action") | ((section == "plan") & ~has_word(evidence, verb)))
    return ~F.contains(evidence, text) & (text.rlike(L.PROPOSAL_LABEL) | ordered)


def assumed_deadline(text: Column, confirm: Column, basis: Column) -> Column:
    return F.concat_ws(" ", text, confirm).rlike(L.ASSUMED_DEADLINE) & ~evidence_text(basis).rlike(r"(?i)\bdeadline\b")


def contradicts_impact(proposal: Column, facts: Column) -> Column:
    """A proposed effect that a stated fact rules out: no impact, or no delay, on what both name."""

    def content(text: Column) -> Column:
        kept = F.filter(T.found(F.lower(text), "[a-z]+"), lambda w: ~w.isin(L.IMPACT_STOP_WORDS))
        return F.array_distinct(F.transform(kept, lambda w: F.when(w.isin("delayed", "delays", "delaying"), "delay").otherwise(w)))

    def against(fact: Column) -> Column:
        common = F.array_intersect(content(proposal), content(fact))
        none = fact.rlike(L.UNAFFECTED) & (F.size(common) > 0)
        prompt = fact.rlike(L.NOT_DELAYED) & F.array_contains(common, "delay") & (F.size(common) >= 2)
        return ~fact.rlike(L.UNCERTAIN) & (none | prompt)

    return F.exists(facts, against)


def _with_stems(clauses: Column) -> Column:
    """Clauses with their stems, each worked out once."""
    return F.transform(clauses, lambda c: F.struct(c.alias("clause"), T.stems(c).alias("stems")))


def _score(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of stems."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def _nearest(mine: Column, theirs: Column) -> Column:
    """Of the related clauses of the evidence those of the highest score, ties included: structs of clause, stems, score."""
    related = F.filter(theirs, lambda o: T.related(mine.stems, o.stems))
    scored = F.transform(related, lambda o: F.struct(o.clause.alias("clause"), o.stems.alias("stems"), _score(mine.stems, o.stems).alias("score")))
    return T.let(scored, lambda found: T.let(F.array_max(F.transform(found, lambda o: o.score)), lambda best: F.filter(found, lambda o: o.score == best)))


def _clause_rule(mine: Column, theirs: Column, initials: Column) -> Column:
    """The first clause rule (5 to 8) that a clause breaks against the nearest clauses of its evidence, or null."""
    clause = mine.clause
    stated = lambda other: F.filter(F.array_intersect(T.found(other, r"\(([a-z]{2,4})\)", 1), initials), lambda i: ~has_word(clause, i))
    verbs = F.transform(T.found(clause, L.COMPLETED), T.stems)
    claimed = lambda stems: F.exists(verbs, lambda v: F.arrays_overlap(v, stems))
    firm = ~clause.rlike(L.PROSPECTIVE) & ~clause.rlike(L.QUALIFIER) & ~clause.rlike(L.IMPERATIVE)

    def rule(near: Column) -> Column:
        return (
            F.when(clause.rlike(L.CONTACT) & F.exists(near, lambda o: F.size(stated(o.clause)) > 0), 5)
            .when(~clause.rlike(L.QUALIFIER) & F.exists(near, lambda o: o.clause.rlike(L.QUALIFIER)), 6)
            .when(F.exists(near, lambda o: T.negative(o.clause) != T.negative(clause)), 7)
            .when(firm & F.exists(near, lambda o: o.clause.rlike(L.PROSPECTIVE)) & F.exists(near, lambda o: claimed(o.stems)), 8)
        )

    # A clause that a related clause of the evidence repeats breaks none.
    same = F.exists(theirs, lambda o: (o.clause == clause) & T.related(mine.stems, o.stems))
    return F.when(~same, T.let(_nearest(mine, theirs), rule))


def risk(claims: DataFrame) -> DataFrame:
    """id, reason of ``claims`` (id, text, quotes): the first rule that a paraphrase breaks, null if none does.

    Whole-quote wording passes. Clauses of a claim are compared with the related clauses of its quotes that are
    lexically nearest, ties included. A claim without quotes breaks no clause rule. Everything that a claim is compared
    with stands in its own row, so nothing is shuffled.
    """
    quotes = F.transform("quotes", T.expand_contractions)
    base = claims.select("id", "text", "quotes", T.expand_contractions(F.col("text")).alias("claim"), quotes.alias("evidence"))
    lower = lambda a: F.transform(a, T.casefold)
    dates = F.size(F.array_except(T.found(F.col("claim"), L.ISO_DATE), F.flatten(F.transform("evidence", lambda q: T.found(q, L.ISO_DATE))))) > 0
    ids = F.size(F.array_except(lower(T.references(F.col("text"))), lower(F.flatten(F.transform("quotes", T.references))))) > 0
    blanket = F.col("claim").rlike(L.BLANKET_ACTION) & ~F.exists("evidence", lambda q: q.rlike(L.BLANKET_ACTION))
    no_impact = F.col("claim").rlike(r"\bno impact\b") & ~F.col("claim").rlike(L.QUALIFIER) & F.exists("evidence", lambda q: q.rlike(r"\bno impact (?:was )?reported\b"))
    whole = F.when(dates, 1).when(ids, 2).when(blanket, 3).when(no_impact, 4)
    initials = lower(F.flatten(F.transform("quotes", lambda q: T.found(q, L.INITIALS, 1))))
    mine, theirs = _with_stems(T.clauses(F.col("claim"))), _with_stems(F.flatten(F.transform("evidence", T.clauses)))
    # Each clause of a claim in turn, until one breaks a rule: its rules come in the order of the clauses.
    rules = T.let(theirs, lambda t: T.let(initials, lambda i: F.transform(mine, lambda m: _clause_rule(m, t, i))))
    clause = F.get(F.array_compact(rules), F.lit(0))
    rule = F.when(F.array_contains("evidence", F.col("claim")), F.lit(None).cast("int")).otherwise(F.coalesce(whole, clause))
    reasons = F.array(*[F.lit(r) for r in REASONS])
    return base.select("id", F.try_element_at(reasons, rule).alias("reason"))


def nearest_clauses(claims: DataFrame) -> DataFrame:
    """id, n, clause, other, score: for each clause of a claim the related evidence clauses of the highest Jaccard."""
    mine = _with_stems(T.clauses(T.expand_contractions(F.col("text"))))
    theirs = _with_stems(F.flatten(F.transform("quotes", lambda q: T.clauses(T.expand_contractions(q)))))
    near = T.let(theirs, lambda t: F.transform(mine, lambda m: F.struct(m.clause.alias("clause"), _nearest(m, t).alias("near"))))
    rows = claims.select("id", F.posexplode(near).alias("n", "m")).select("id", "n", "m.clause", F.explode("m.near").alias("o"))
    return rows.select("id", "n", "clause", F.col("o.clause").alias("other"), F.col("o.score").alias("score"))


def missing_anchor_sentences(sources: DataFrame) -> DataFrame:
    """id, sentence of ``sources`` (id, source, visible): sentences with a time, date or reference that ``visible`` lacks."""
    gone = F.filter(T.anchors(F.col("source")), lambda a: ~F.contains(T.casefold(F.col("visible")), T.casefold(a)))
    rows = sources.select("id", gone.alias("gone"), F.transform(T.sentences(F.col("source")), lambda s: T.strip(s)).alias("s"))
    return rows.select("id", F.explode(F.filter("s", lambda s: F.exists("gone", lambda a: F.contains(T.casefold(s), T.casefold(a))))).alias("sentence"))

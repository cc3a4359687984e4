"""Records as text: logs, evidence tables, status lines, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import lexicon as L


def render_log(sections: Column) -> Column:
    """A map of section to fact texts as headed lines, in the order of the contract; empty sections say so."""
    def part(s: str) -> Column:
        facts = F.coalesce(F.try_element_at(sections, F.lit(s)), F.array().cast("array<string>"))
        body = F.when(F.size(facts) == 0, "- Not provided").otherwise(F.array_join(F.transform(facts, lambda t: F.concat(F.lit("- "), t)), "\n"))
        return F.concat(F.lit(s.replace("_", " ").upper() + ":\n"), body)

    return F.concat_ws("\n\n", *[part(s) for s in L.SECTIONS])


def evidence_table(located: DataFrame) -> DataFrame:
    """One display row for each claim's quote: event_id, section, text, quote, places ('start-end', by semicolons)."""
    span = lambda s: F.concat_ws("-", s.start.cast("string"), s.end.cast("string"))
    places = F.array_join(F.transform("candidates", lambda c: F.array_join(F.transform(c.segments, span), "+")), "; ")
    return located.select("event_id", "section", "text", "quote", places.alias("places"))


def draft_status(events: DataFrame) -> DataFrame:
    """id, line: how many events of a note are drafted and how many are not."""
    failed = F.count_if(F.col("status") == "incomplete_draft")
    counted = events.groupBy("id").agg(F.count("*").alias("n"), failed.alias("failed"))
    line = F.when(F.col("failed") > 0, F.format_string("%d of %d event drafts are incomplete", "failed", "n")).otherwise(F.format_string("%d event drafts are ready for review", "n"))
    return counted.select("id", line.alias("line"))


def short_error(message: Column, most: int = 180) -> Column:
    """The first line of an error, cut to ``most`` characters."""
    return F.left(F.split(message, r"\r\n|\n|\r")[0], F.lit(most))


def markdown_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as a line of a Markdown table, as column ``line``; the caller writes the head."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("n/a")) for c in columns]), F.lit(" |")).alias("line"))


def metrics_report(metrics: DataFrame, flagged: DataFrame, title: str) -> DataFrame:
    """ord, line of a Markdown report: a table of ``metrics`` (label, numerator, denominator) and the flagged cases.

    ``flagged``: id, failures (array). Metrics without anything to count say so; the order is that of label and id.
    """
    head = metrics.sparkSession.createDataFrame([(0, "", f"# {title}"), (1, "", ""), (2, "", "| Check | Result |"), (3, "", "|---|---:|"), (5, "", ""), (6, "", "## Cases flagged for review"), (7, "", "")], "part int, key string, line string")
    result = F.when(F.col("denominator") > 0, F.concat_ws("/", F.col("numerator").cast("string"), F.col("denominator").cast("string"))).otherwise("No scored items")
    table = metrics.select(F.lit(4).alias("part"), F.col("label").alias("key"), F.concat(F.lit("| "), "label", F.lit(" | "), result, F.lit(" |")).alias("line"))
    cases = flagged.where(F.size("failures") > 0).select(F.lit(8).alias("part"), F.col("id").cast("string").alias("key"), F.concat(F.lit("- `"), F.col("id").cast("string"), F.lit("`: "), F.array_join("failures", ", "), F.lit(".")).alias("line"))
    note = cases.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(8).alias("part"), F.lit("").alias("key"), F.lit("No cases were flagged by the recorded automated checks. Human review is still required.").alias("line"))
    return head.unionByName(table).unionByName(cases).unionByName(note).select(F.struct("part", "key").alias("ord"), "line")


def dataset_card(rows: DataFrame, title: str) -> DataFrame:
    """ord, line of a Markdown card of ``rows`` (split, family, task, mode): counts of each split, and of its families and modes."""
    counts = rows.groupBy("split").agg(
        F.count("*").alias("n"), F.count_distinct("family").alias("families"), F.count_if(F.col("mode") == "draft").alias("drafts"), F.count_if(F.col("mode") == "review").alias("reviews"), F.count_if(F.col("task") == "helper").alias("helpers"))
    head = rows.sparkSession.createDataFrame([(0, "", f"# {title}"), (1, "", ""), (2, "", "| Split | Rows | Families | Drafts | Reviews | Helper rows |"), (3, "", "|---|---:|---:|---:|---:|---:|")], "part int, key string, line string")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "split", *[F.col(c).cast("string") for c in ("n", "families", "drafts", "reviews", "helpers")]), F.lit(" |"))
    return head.unionByName(counts.select(F.lit(4).alias("part"), F.col("split").alias("key"), line.alias("line"))).select(F.struct("part", "key").alias("ord"), "line")

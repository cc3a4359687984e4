"""Queries over parts of notes: facts and suggestions of chunks, what is still to be asked, statuses, places and lines to show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import assemble as A
from attestry.operators import intervals as I
from attestry.operators import render as R
from attestry.operators import segment as S
from attestry.plans.drafts import _GROUPS, _notes
from attestry.plans.registry import query, table
from attestry.sources import tables


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as an event of its conversation; every fifth is incomplete."""
    status = F.when(F.col("turn") % 5 == 4, "incomplete_draft").otherwise("needs_confirmation")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), status.alias("status"), (F.col("turn") + 1).alias("chunks"))


@query("""SELECT conv_id, CASE WHEN bool_or(turn % 5 = 4) THEN 'incomplete_draft' ELSE 'needs_confirmation' END AS status, CAST(sum(turn + 1) AS BIGINT) AS chunks FROM conversations GROUP BY 1""")
def note_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.note_status(_events(spark, sf_dir)).withColumnRenamed("id", "conv_id")


@query("""WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (turn % 5 = 4) AS failed FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN failed > 0 THEN failed || ' of ' || n || ' event drafts are incomplete' ELSE n || ' event drafts are ready for review' END AS line FROM c""")
def draft_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.draft_status(_events(spark, sf_dir)).withColumnRenamed("id", "conv_id")


@query("""SELECT conv_id, CASE WHEN turn % 2 = 0 THEN 'impact' ELSE 'plan' END AS section, arg_max(left(text, 9), turn) AS confirm FROM conversations GROUP BY 1, 2""")
def first_confirms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later a turn, the earlier its suggestion's place."""
    section = F.when(F.col("turn") % 2 == 0, "impact").otherwise("plan")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), section.alias("section"), (-F.col("turn")).alias("place"), F.left("text", F.lit(9)).alias("confirm"))
    return A.first_confirms(rows).select(F.col("id").alias("conv_id"), F.explode("confirms").alias("section", "confirm"))


@query("""WITH f AS (SELECT conv_id, turn, 4 AS s, 0 AS n, 'plan' AS section, text FROM conversations WHERE turn % 4 <> 3 UNION ALL SELECT conv_id, turn, 0, 1, 'situation', left(text, 3) FROM conversations WHERE turn % 4 <> 3
UNION ALL SELECT conv_id, turn, 4, 2, 'plan', role FROM conversations WHERE turn % 4 <> 3)
SELECT conv_id, section, row_number() OVER (PARTITION BY conv_id ORDER BY turn, s, n) AS ord, text FROM f""")
def chunk_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three facts of each turn's record, out of the order of their sections; every fourth output failed."""
    fact = lambda s, text: F.struct(F.lit(s).alias("section"), text.alias("text"), F.array(text).alias("evidence"))
    facts = F.array(fact("plan", F.col("text")), fact("situation", F.left("text", F.lit(3))), fact("plan", F.col("role")))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("chunk"), F.when(F.col("turn") % 4 != 3, facts).alias("facts"))
    return A.chunk_facts(rows).select(F.col("id").alias("conv_id"), "section", "ord", "text")


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '08:05Z,09:30' ELSE '08:05Z' END AS omitted FROM conversations""")
def omitted_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times added to a turn's text that what is kept of it lacks."""
    source = F.concat("text", F.lit(" At 09:30 it came, at 08:05z it went, at 10:15 it was back."))
    kept = F.when(F.col("turn") % 2 == 0, "10:15").otherwise("At 09:30 and 10:15.")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(A.omitted_times(source, kept), ",").alias("omitted"))


@query("""SELECT conv_id, turn, concat_ws(',', CASE WHEN turn % 3 <> 2 AND role <> 'user' THEN 'impact' END, CASE WHEN turn % 2 = 0 THEN 'action' END, 'plan') AS focus FROM conversations""")
def open_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact is unknown, absent or known, action covered by every other turn's suggestion, plan never stated."""
    turn = F.col("turn")
    impact = F.when(turn % 3 == 0, F.array(F.lit("Impact unknown."))).when(turn % 3 == 2, F.array(F.lit("Two people waited."))).otherwise(F.array().cast("array<string>"))
    sections = F.map_from_arrays(F.array(F.lit("impact")), F.array(impact))
    covered = F.concat(F.when(F.col("role") == "user", F.array(F.lit("impact"))).otherwise(F.array().cast("array<string>")), F.when(turn % 2 == 1, F.array(F.lit("action"))).otherwise(F.array().cast("array<string>")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(A.focus(covered, sections, F.lit("All was said.")), ",").alias("focus"))


@query(f"""WITH {_GROUPS}, s AS (SELECT conv_id, role, turn, begin, n, text, begin - sum(n + 1) OVER (PARTITION BY conv_id, role ORDER BY turn) + n + 1 AS shift FROM g),
u AS (SELECT conv_id, role, string_agg(left(text || chr(10), n::INT), chr(10) ORDER BY turn) AS body FROM s GROUP BY 1, 2),
o AS (SELECT conv_id, role, unnest(list_filter(range(0, length(body)), lambda i: substr(body, (i + 1)::INT, 1) = chr(10))) AS pos FROM u),
p AS (SELECT o.conv_id, o.role, o.pos, CAST(s.shift + o.pos AS BIGINT) AS place FROM o JOIN s ON o.conv_id = s.conv_id AND o.role = s.role AND o.pos >= s.begin - s.shift AND o.pos < s.begin - s.shift + s.n)
SELECT conv_id, 'event-' || k AS event_id, 'plan' AS section, role || ' said so.' AS text, coalesce(string_agg(place || '-' || (place + 1), '; ' ORDER BY pos), '') AS places FROM k LEFT JOIN p USING (conv_id, role) GROUP BY conv_id, k, role""")
def evidence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = S.event_groups(_notes(spark, sf_dir))
    located = I.locate(groups, groups.select("id", "event_id", F.lit("\n").alias("quote")))
    claims = groups.select("id", "event_id", F.lit("plan").alias("section"), F.concat("label", F.lit(" said so.")).alias("text"))
    shown = R.evidence_table(located.join(claims, ["id", "event_id"]).withColumn("event_id", F.concat_ws("/", "id", "event_id")))
    return shown.select(F.split_part("event_id", F.lit("/"), F.lit(1)).cast("long").alias("conv_id"), F.split_part("event_id", F.lit("/"), F.lit(2)).alias("event_id"), "section", "text", "places")


@query("""SELECT '| ' || doc_id || ' | ' || coalesce(quality::VARCHAR, 'n/a') || ' | ' || coalesce(CASE WHEN quality = 1 THEN toxic END::VARCHAR, 'n/a') || ' |' AS line FROM labels""")
def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumn("toxic", F.when(F.col("quality") == 1, F.col("toxic")))
    return R.markdown_table(rows, ["doc_id", "quality", "toxic"])


@query("""SELECT conv_id, turn, role, 'out: ' || text AS raw_output FROM conversations""")
def replayed_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the output that was recorded for its text."""
    cases = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    outputs = cases.select("conv_id", "turn", "text", F.concat(F.lit("out: "), "text").alias("raw_output"))
    return tables.replay(cases, outputs, ["conv_id", "turn"], ["text"]).drop("text")

"""Queries over intervals, as-of joins and places of quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import corpus as C
from attestry.operators import grounding as G
from attestry.operators import intervals as I
from attestry.plans.registry import query, table


def _seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", ts.alias("at"))


_SPANS_SQL = """WITH e AS (SELECT user_id, event_id, event_type, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec FROM events),
v AS (SELECT user_id, event_id AS left_id, sec AS l_start, sec + 21600 AS l_end FROM e WHERE event_type = 'view'),
p AS (SELECT user_id, event_id AS right_id, sec AS r_start, sec + 21600 AS r_end FROM e WHERE event_type = 'purchase')
"""


@query(_SPANS_SQL + """SELECT user_id, left_id, right_id, greatest(l_start, r_start) AS start, least(l_end, r_end) AS "end" FROM v JOIN p USING (user_id) WHERE l_start < r_end AND r_start < l_end""")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, long_ = _seconds(spark, sf_dir), 21_600
    side = lambda kind, id_, a, b: events.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(id_), F.col("at").alias(a), (F.col("at") + long_).alias(b))
    return I.overlap_join(side("view", "left_id", "l_start", "l_end"), side("purchase", "right_id", "r_start", "r_end"), ["user_id"], long_)


@query("""WITH e AS (SELECT user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS start, CAST(epoch(date_trunc('second', ts)) AS BIGINT) + 21600 AS "end" FROM events),
m AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m),
u AS (SELECT user_id, island, min(start) AS start, max("end") AS "end" FROM g GROUP BY 1, 2)
SELECT user_id, count(*) AS n_spans, CAST(sum("end" - start) AS BIGINT) AS covered, CAST(max("end") - min(start) - sum("end" - start) AS BIGINT) AS uncovered FROM u GROUP BY 1""")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _seconds(spark, sf_dir).select("user_id", F.col("at").alias("start"), (F.col("at") + 21_600).alias("end"))
    united = I.union_intervals(spans, ["user_id"], "start", "end")
    covered = F.sum(F.col("end") - F.col("start"))
    return united.groupBy("user_id").agg(F.count("*").alias("n_spans"), covered.alias("covered"), (F.max("end") - F.min("start") - covered).alias("uncovered"))


@query("""SELECT e.event_id, e.user_id, s.event_id AS signup_id FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s
ON e.user_id = s.user_id AND e.ts > s.ts WHERE e.event_type = 'error'""")
def asof_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("event_type in ('signup', 'error')").select("event_id", "user_id", "ts", "event_type")
    found = I.latest_before(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_id"))
    return found.where("event_type = 'error'").select("event_id", "user_id", F.col("as_of").alias("signup_id"))


@query("""SELECT doc_id, CAST(len(p) AS BIGINT) AS n_overlapping, p[1] AS first_at, p[len(p)] AS last_at,
CAST((length(text) - length(replace(text, 'ene', ''))) // 3 AS BIGINT) AS n_separate
FROM (SELECT doc_id, text, list_filter(range(0, length(text) - 2), lambda i: substr(text, i + 1, 3) = 'ene') AS p FROM documents WHERE contains(text, 'ene'))""")
def overlapping_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("ene")))
    quote, text = F.lit("ene"), F.col("text")
    rows = docs.select("doc_id", T.occurrences(text, quote).alias("p"), F.size(T.separate_occurrences(text, quote)).cast("long").alias("n_separate"))
    return rows.select("doc_id", F.size("p").cast("long").alias("n_overlapping"), F.get("p", F.lit(0)).cast("long").alias("first_at"), F.try_element_at("p", F.lit(-1)).cast("long").alias("last_at"), "n_separate")


@query("""SELECT d.doc_id, b.item_id, strpos(d.text, b.text) - 1 AS at, CAST(length(b.text) AS BIGINT) AS n_chars, true AS supported, upper(b.text) = b.text OR contains(d.text, upper(b.text)) AS upper_supported
FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def quote_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    held = C.contained(docs, items)
    both = held.join(docs.toDF("text_id", "text"), "text_id").join(items.toDF("passage_id", "quote"), "passage_id")
    return both.select(F.col("text_id").alias("doc_id"), F.col("passage_id").alias("item_id"), T.find(F.col("quote"), F.col("text")).cast("long").alias("at"), F.length("quote").cast("long").alias("n_chars"),
                       G.quotes_exist(F.array("quote"), F.col("text")).alias("supported"), G.quotes_exist(F.array("quote", F.upper("quote")), F.col("text")).alias("upper_supported"))


@query()
def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("text <> ''")
    quotes = F.array(F.split_part("text", F.lit(" "), F.lit(1)), F.regexp_extract("text", "[^ ]+$", 0))
    found = I.coverage(turns.select(F.struct("conv_id", "turn").alias("id"), F.col("text").alias("source"), quotes.alias("quotes")))
    return found.select("id.conv_id", "id.turn", "source_characters", "covered", F.size("unquoted").alias("n_unquoted"))

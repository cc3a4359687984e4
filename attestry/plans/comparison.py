"""Queries that compare runs, cases and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import evaluate as E
from attestry.operators import provenance as P
from attestry.plans.registry import query, table

VARIANTS = ["base", "second", "third"]


@query("SELECT doc_id, variant FROM labels, (VALUES ('base'), ('second'), ('third')) v(variant)")
def case_variant_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.grid(table(spark, sf_dir, "labels").select("doc_id"), VARIANTS)


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_pairs_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""WITH e AS (SELECT doc_id, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS label FROM documents), a AS (SELECT doc_id, quality AS label FROM labels UNION ALL SELECT -1 - item_id, 1 FROM benchmark)
SELECT coalesce(e.doc_id, a.doc_id) AS doc_id, e.label AS expected, a.label AS actual,
CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN e.doc_id IS NULL THEN 'unexpected' WHEN e.label IS NOT DISTINCT FROM a.label THEN 'matched' ELSE 'mismatched' END AS outcome
FROM e FULL OUTER JOIN a ON e.doc_id = a.doc_id""")
def expected_actual_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every document is expected, and labels of other things are not: documents without a label are missing, those unexpected.
    expected = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 1000).cast("int").alias("label"))
    actual = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).unionAll(table(spark, sf_dir, "benchmark").select(-1 - F.col("item_id"), F.lit(1)))
    return E.match_groups(expected, actual, ["doc_id"], "label")


@query("""WITH saved AS (SELECT o_custkey AS key, o_orderstatus AS status FROM orders), source AS (SELECT c_custkey AS key, 'O' AS status FROM customer)
SELECT key, status, 'saved' AS side FROM (SELECT * FROM saved EXCEPT ALL SELECT * FROM source) UNION ALL SELECT key, status, 'source' FROM (SELECT * FROM source EXCEPT ALL SELECT * FROM saved)""")
def reconcile_exceptall(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status"))
    source = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("O").alias("status"))
    return E.reconcile(saved, source)


_OUTCOMES = """WITH o AS (SELECT d.lang AS variant, d.doc_id AS id, l.quality = 1 AS complete, list_filter([CASE WHEN l.toxic = 1 THEN 'toxic:' || d.doc_id END, CASE WHEN l.quality = 0 THEN 'poor' END], lambda x: x IS NOT NULL) AS failures FROM documents d JOIN labels l USING (doc_id))"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    failures = F.array_compact(F.array(F.when(F.col("toxic") == 1, F.concat(F.lit("toxic:"), F.col("doc_id").cast("string"))), F.when(F.col("quality") == 0, "poor")))
    return both.select(F.col("lang").alias("variant"), F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("complete"), (F.col("n_chars") / 1000).alias("seconds"), failures.alias("failures"))


@query(f"""{_OUTCOMES} SELECT variant, count(*) AS cases, count(*) FILTER (complete) AS n_complete, count(*) FILTER (NOT complete) AS n_failed, count(*) FILTER (complete) / count(*) AS share_complete,
bool_or(NOT complete) AS any_failed, CAST(sum(len(failures)) AS BIGINT) AS n_failures, coalesce(string_agg(array_to_string(failures, ','), ',' ORDER BY id, failures) FILTER (len(failures) > 0), '') AS failures FROM o GROUP BY 1""")
def variant_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.roll_up(_outcomes(spark, sf_dir), "variant").withColumn("failures", F.array_join("failures", ",")).drop("seconds")


@query(f"""{_OUTCOMES} SELECT variant, id, i AS place, failures[i] AS failure FROM o, unnest(range(1, len(failures) + 1)) u(i)""")
def variant_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.failures(_outcomes(spark, sf_dir), "variant")


@query("""WITH m AS (SELECT doc_id AS file, n_chars AS bytes, sha256(text) AS sha256 FROM documents UNION ALL SELECT -1 - item_id, length(text), sha256(text) FROM benchmark),
f AS (SELECT doc_id AS file, n_chars + (lang = 'fr')::INT AS bytes, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END) AS sha256 FROM documents UNION ALL SELECT -1000000 - page_id, length(url), sha256(url) FROM pages)
SELECT CAST(coalesce(m.file, f.file) AS VARCHAR) AS file, CASE WHEN f.file IS NULL THEN 'missing' WHEN m.file IS NULL THEN 'unlisted' WHEN f.bytes <> m.bytes THEN 'size' WHEN f.sha256 <> m.sha256 THEN 'digest' ELSE 'verified' END AS outcome
FROM m FULL OUTER JOIN f ON m.file = f.file""")
def manifest_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "doc_id", F.col("n_chars").alias("bytes"), "text", "lang")
    # A manifest and a folder that differ in every way the outcome names: every document is on both sides, some with another
    # size or text; benchmark items are listed only, pages only there.
    more = lambda name, id_, text: table(spark, sf_dir, name).select(id_.cast("string").alias("file"), F.length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256"))
    listed = docs.select("file", "bytes", F.sha2("text", 256).alias("sha256")).unionAll(more("benchmark", -1 - F.col("item_id"), "text"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    size = F.col("bytes") + (F.col("lang") == "fr").cast("int")
    present = docs.select("file", size.alias("bytes"), F.sha2(changed, 256).alias("sha256")).unionAll(more("pages", -1_000_000 - F.col("page_id"), "url"))
    return P.verify(listed, present)


@query("""SELECT CAST(o_orderkey AS BIGINT) AS id, 'status' AS key, 'O' AS saved, o_orderstatus AS wanted FROM orders WHERE o_orderstatus <> 'O'
UNION ALL SELECT o_orderkey, 'priority', NULL, o_orderpriority FROM orders""")
def config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("id", F.col("o_orderkey"))
    wanted = orders.select("id", F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("config"))
    saved = orders.select("id", F.create_map(F.lit("status"), F.lit("O")).alias("config"))
    return P.config_differences(saved, wanted)


@query("""WITH e AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders),
a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM orders WHERE o_orderstatus <> 'P')
SELECT coalesce(e.o_custkey, a.o_custkey) AS o_custkey, coalesce(e.position, a.position) AS position, e.o_orderkey AS expected, a.o_orderkey AS actual, CASE WHEN a.o_orderkey IS NULL THEN 'missing' ELSE 'mismatched' END AS outcome
FROM e FULL OUTER JOIN a ON e.o_custkey = a.o_custkey AND e.position = a.position WHERE e.o_orderkey IS DISTINCT FROM a.o_orderkey""")
def results_out_of_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer as planned by their key, saved by their date, without those in part."""
    orders = table(spark, sf_dir, "orders")
    planned = orders.select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("at"))
    saved = orders.where("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("at"))
    return E.out_of_place(saved, planned, ["o_custkey"], "o_orderkey", "at")

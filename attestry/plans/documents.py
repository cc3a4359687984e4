"""Queries over the inside of documents and conversations: lines, islands, chunks, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import segment as S
from attestry.plans.registry import query, table


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


#: Lines with their ends; the driver's texts end lines by LF, for which a split is the same.
_LINES_SQL = r"""WITH l AS (SELECT doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l FROM documents),
u AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM l),
o AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line, CAST(coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start FROM u)
"""


@query(_LINES_SQL + "SELECT doc_id, line_no, start, CAST(length(line) AS INTEGER) AS n_chars FROM o")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.line_table(_notes(spark, sf_dir)).select(F.col("id").alias("doc_id"), "line_no", "start", F.length("line").alias("n_chars"))


@query(_LINES_SQL + r""", h AS (SELECT *, len(regexp_extract_all(line, '[\p{L}\p{N}_]+')) <= 3 AS heading FROM o),
g AS (SELECT *, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM h)
SELECT doc_id, CAST(island AS BIGINT) AS island, min(start) AS start, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM g GROUP BY 1, 2""")
def segment_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.line_table(_notes(spark, sf_dir))
    found = S.islands(lines, ["id"], ["line_no"], F.size(T.words(F.col("line"))) <= 3)
    return found.groupBy(F.col("id").alias("doc_id"), "island").agg(F.min("start").alias("start"), F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query(_LINES_SQL + """, p AS (SELECT doc_id, length(text) AS n, unnest([0, length(text) // 2, greatest(length(text) - 1, 0)]) AS place FROM documents),
q AS (SELECT DISTINCT doc_id, place FROM p)
SELECT q.doc_id, CAST(q.place AS INTEGER) AS place, CAST(count(*) AS INTEGER) AS line_no FROM q JOIN o ON o.doc_id = q.doc_id AND o.start <= q.place GROUP BY 1, 2""")
def line_number_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.line_table(_notes(spark, sf_dir)).groupBy("id").agg(F.collect_list("start").alias("starts"), F.max(F.col("start") + F.length("line")).alias("n"))
    at = F.array_distinct(F.array(F.lit(0), F.floor(F.col("n") / 2).cast("int"), F.greatest(F.col("n") - 1, F.lit(0))))
    return lines.select(F.col("id").alias("doc_id"), "starts", F.explode(at).alias("place")).select("doc_id", "place", S.line_number(F.col("starts"), F.col("place")).alias("line_no"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 220 THEN 1 ELSE CAST(ceil((len(w) - 16) / 204.0) AS INTEGER) END)) AS chunk FROM w)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(chunk * 204 AS INTEGER) AS start, CAST(least(chunk * 204 + 220, len(w)) AS INTEGER) AS "end",
sha256(array_to_string(w[chunk * 204 + 1 : least(chunk * 204 + 220, len(w))], ' ')) AS words_sha256 FROM k""")
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _notes(spark, sf_dir).select("id", T.words(F.col("text")).alias("w"))
    chunks = w.select("id", "w", F.explode(S.chunk_bounds(F.size("w"), 220, 16)).alias("c"))
    part = F.slice("w", F.col("c.start") + 1, F.col("c.end") - F.col("c.start"))
    return chunks.select(F.col("id").alias("doc_id"), "c.*", F.sha2(F.array_join(part, " "), 256).alias("words_sha256"))


@query(r"""WITH w AS (SELECT conv_id, turn, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS n FROM conversations),
s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS spent FROM w),
o AS (SELECT *, max(CASE WHEN spent > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS over FROM s)
SELECT conv_id, turn, CAST(spent AS BIGINT) AS spent FROM o WHERE over = 0""")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.words(F.col("text"))).alias("n"))
    return S.within_budget(turns, ["conv_id"], ["turn"], "n", 150).select("conv_id", "turn", "spent")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1")
def longest_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(1)


@query("""SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1""")
def conversation_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(line)).alias("l"))
    return grouped.select("conv_id", "n_turns", F.array_join(F.transform("l", lambda x: x.line), "\n").alias("transcript"))


@query(r"""WITH p AS (SELECT conv_id, turn, role, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS n, lag(len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations)
SELECT conv_id, turn, CAST(before AS BIGINT) AS n_masked, CAST(n AS BIGINT) AS n_learnt, array_to_string(list_transform(range(0, before), lambda i: '-100') || list_transform(range(0, n), lambda i: CAST(i AS VARCHAR)), ' ') AS labels
FROM p WHERE role = 'assistant' AND asked = 'user'""")
def completion_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.size(T.words(F.col("text"))).alias("n"))
    turns = turns.withColumns({"before": F.lag("n").over(w), "asked": F.lag("role").over(w)}).where("role = 'assistant' and asked = 'user'")
    learnt = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    labels = F.concat(F.array_repeat(F.lit(-100), F.col("before")), learnt)
    return turns.select("conv_id", "turn", F.col("before").cast("long").alias("n_masked"), F.col("n").cast("long").alias("n_learnt"), F.array_join(labels.cast("array<string>"), " ").alias("labels"))


_KEY_SQL = r"trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))"


@query(f"WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY sha256({_KEY_SQL}), source ORDER BY doc_id) AS place FROM documents) SELECT doc_id, source FROM r WHERE place = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(T.normalize(F.col("text")), 256).alias("key"))
    return S.first_of_each(docs, ["key", "source"], ["doc_id"]).select("doc_id", "source")


@query("""WITH r AS (SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place
FROM orders WHERE o_orderstatus = 'O') SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(place AS INTEGER) AS place FROM r WHERE place <= 2""")
def top2_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return S.first_of_each(orders, ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"], 2)


@query("""WITH r AS (SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents WHERE n_chars >= 500)
SELECT source, doc_id, lang FROM r WHERE place = 1""")
def first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("n_chars >= 500").select("source", "doc_id", "lang")
    return S.first_of_each(docs, ["source"], ["doc_id"]).drop("place")


@query(r"""WITH RECURSIVE cut(doc_id, piece_no, piece, rest) AS (
  SELECT doc_id, 0, '', regexp_replace(text, '^\s+|\s+$', '', 'g') FROM documents
  UNION ALL
  SELECT doc_id, piece_no + 1, regexp_replace(left(rest, cut_at), '^\s+|\s+$', '', 'g'), regexp_replace(substr(rest, cut_at + 1), '^\s+|\s+$', '', 'g')
  FROM (SELECT *, CASE WHEN length(rest) <= 1200 THEN length(rest) WHEN strpos(reverse(left(rest, 1200)), ' ') BETWEEN 1 AND 1199 THEN 1200 - strpos(reverse(left(rest, 1200)), ' ') ELSE 1200 END AS cut_at FROM cut) WHERE rest <> '')
SELECT doc_id, CAST(piece_no AS INTEGER) AS piece_no, piece FROM cut WHERE piece_no > 0 AND piece <> ''""")
def split_long_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_long(_notes(spark, sf_dir)).withColumnRenamed("id", "doc_id")

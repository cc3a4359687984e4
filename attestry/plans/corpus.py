"""Queries over whole corpora: duplicates, overlap, counts, ratios, balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import corpus as C
from attestry.plans.registry import query, table

NORMAL_SQL = r"trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))"
_MONTH_SQL = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
#: RE2 has no look-around: a reference id's neighbours are left to the boundaries of its words.
#: Its \\b knows ASCII words only, so names are bounded by classes; other signs are doubled first, since a match takes
#: its bounds along and the next name needs one too.
_NAME_SQL = r"'(^|[^\p{L}\p{N}_])[A-Z][a-z]+  [A-Z][a-z]+($|[^\p{L}\p{N}_])', '\1PERSON\2', 'g')"
_TWICE_SQL = r"'([^\p{L}\p{N}_])', '\1\1', 'g')"
_STRIP_SQL = rf"""regexp_extract_all(lower(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '(?i)\b(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\s+{_MONTH_SQL}\s+\d{{4}}|{_MONTH_SQL}\s+\d{{1,2}},?\s+\d{{4}})\b', 'VALUE', 'g'),
    '(?i)\b(?:[01]?\d|2[0-3]):[0-5]\dZ?\b|\b(?:[01]\d|2[0-3])[0-5]\dZ\b', 'VALUE', 'g'),
    '\b[A-Z][A-Z0-9]{{0,24}}(?:[-_][A-Z0-9]{{1,24}})+\b', 'RECORD', 'g'),
    '\(([A-Z]{{2,4}})\)', 'CONTACT', 'g'), {_TWICE_SQL}, {_NAME_SQL}), '[\p{{L}}\p{{N}}_]+')"""
_GRAMS_SQL = "list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]))"


@query("SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicates(table(spark, sf_dir, "documents"), F.sha2("text", 256), "doc_id").withColumnRenamed("key", "sha256")


@query(f"SELECT sha256({NORMAL_SQL}) AS normal_sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def normalized_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.sha2(T.normalize(F.col("text")), 256)
    return C.duplicates(table(spark, sf_dir, "documents"), key, "doc_id").withColumnRenamed("key", "normal_sha256")


@query("SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents")
def content_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    unix = F.replace("text", F.lit("\r\n"), F.lit("\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(unix, 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(f"SELECT sha256({NORMAL_SQL}) AS key FROM documents WHERE doc_id % 5 = 0 INTERSECT SELECT sha256({NORMAL_SQL}) FROM documents WHERE doc_id % 5 <> 0")
def cross_split_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return C.shared_keys(docs.where("doc_id % 5 = 0"), docs.where("doc_id % 5 <> 0"), F.sha2(T.normalize(F.col("text")), 256))


@query(f"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents) SELECT doc_id, CAST(greatest(len(w) - 2, 0) AS BIGINT) AS n_trigrams, CAST(CASE WHEN len(w) < 3 THEN 0 ELSE len({_GRAMS_SQL}) END AS BIGINT) AS n_distinct FROM t")
def trigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = T.ngrams(T.words(F.lower("text")), 3)
    docs = table(spark, sf_dir, "documents").select("doc_id", grams.alias("g"))
    return docs.select("doc_id", F.size("g").cast("long").alias("n_trigrams"), F.size(F.array_distinct("g")).cast("long").alias("n_distinct"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS BIGINT) AS n_words, CAST(len(string_split_regex(trim(text), '\s+')) AS BIGINT) AS n_blank_separated FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n_words"), F.size(F.split(F.trim("text"), r"\s+")).cast("long").alias("n_blank_separated"))


@query(r"""WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+(?:[.!?]+|$)') AS s FROM documents)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS longest FROM s""")
def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    longest = F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), longest.cast("long").alias("longest"))


@query(f"""WITH a0 AS (SELECT item_id, {_STRIP_SQL} AS w FROM benchmark), a AS (SELECT item_id, CASE WHEN len(w) < 3 THEN [] ELSE {_GRAMS_SQL} END AS g FROM a0),
b0 AS (SELECT doc_id, {_STRIP_SQL} AS w FROM documents), b AS (SELECT doc_id, CASE WHEN len(w) < 3 THEN [] ELSE {_GRAMS_SQL} END AS g FROM b0),
met AS (SELECT a.item_id, b.doc_id, count(*) AS common FROM (SELECT item_id, unnest(g) AS x FROM a) a JOIN (SELECT doc_id, unnest(g) AS x FROM b) b ON a.x = b.x GROUP BY 1, 2),
scored AS (SELECT m.item_id, m.doc_id, m.common / (len(a.g) + len(b.g) - m.common) AS similarity FROM met m JOIN a ON a.item_id = m.item_id JOIN b ON b.doc_id = m.doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS place FROM scored)
SELECT i.item_id, best.doc_id, coalesce(best.similarity, 0.0) AS similarity FROM benchmark i LEFT JOIN best ON best.item_id = i.item_id AND best.place = 1""")
def jaccard_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return C.nearest_by_trigrams(items, docs).toDF("item_id", "doc_id", "similarity")


@query("SELECT item_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def benchmark_contained_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contained(spark, sf_dir).groupBy(F.col("passage_id").alias("item_id")).agg(F.count("*").alias("n_docs"), F.min("text_id").alias("first_doc"))


@query("SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))")
def benchmark_uncontained_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _contained(spark, sf_dir).select(F.col("passage_id").alias("item_id"))
    return table(spark, sf_dir, "benchmark").select("item_id").join(held, "item_id", "left_anti")


def _contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return C.contained(docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query(f"WITH t AS (SELECT doc_id, {_STRIP_SQL} AS w FROM documents) SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_filter(w, lambda x: x = 'person')) AS BIGINT) AS n_persons, sha256(array_to_string(w, ' ')) AS stripped_sha256 FROM t")
def identity_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", T.identity_stripped(F.col("text")).alias("w"))
    persons = F.size(F.filter("w", lambda x: x == "person"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), persons.cast("long").alias("n_persons"), F.sha2(F.array_join("w", " "), 256).alias("stripped_sha256"))


@query("SELECT source, lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS chars, count(DISTINCT text) AS n_distinct FROM documents GROUP BY 1, 2")
def counts_by_source_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "lang", "n_chars", "text")
    # Distinct texts by digest: a digest is shuffled, not a text.
    return docs.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"), F.count_distinct(F.sha2("text", 256)).alias("n_distinct"))


@query("""SELECT d.lang, l.quality, count(*) FILTER (l.toxic = 0) AS clean, count(*) FILTER (l.toxic = 1) AS toxic
FROM documents d JOIN labels l USING (doc_id) GROUP BY 1, 2""")
def nested_counts_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    counted = both.groupBy("lang", "quality").pivot("toxic", [0, 1]).agg(F.count("doc_id"))
    return counted.select("lang", "quality", F.coalesce("0", F.lit(0)).alias("clean"), F.coalesce("1", F.lit(0)).alias("toxic"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS high, count(*) FILTER (user_id % 2 = 0) AS even_users,
bool_or(value > 99) AS any_extreme, bool_and(value >= 0) AS all_positive FROM events GROUP BY 1""")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("user_id") % 2 == 0).alias("even_users"),
        F.bool_or(F.col("value") > 99).alias("any_extreme"), F.bool_and(F.col("value") >= 0).alias("all_positive"))


@query("""SELECT d.source, count(*) AS denominator, count(*) FILTER (l.toxic = 1) AS numerator,
count(*) FILTER (l.toxic = 1) / nullif(count(*), 0) AS rate, count(*) FILTER (l.quality = 0) / nullif(count(*) FILTER (l.toxic = 1), 0) AS low_to_toxic
FROM documents d JOIN labels l USING (doc_id) GROUP BY 1""")
def ratio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    toxic, low = F.count_if(F.col("toxic") == 1), F.count_if(F.col("quality") == 0)
    ratio = lambda a, b: a / F.nullif(b, F.lit(0).cast("long"))
    return both.groupBy("source").agg(F.count("*").alias("denominator"), toxic.alias("numerator"), ratio(toxic, F.count("*")).alias("rate"), ratio(low, toxic).alias("low_to_toxic"))


@query("""WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, n, max(n_chars) FILTER (place = 1) AS least, max(n_chars) FILTER (place = n // 2 + 1) AS median,
max(n_chars) FILTER (place = CAST(floor(0.95::DOUBLE * (n - 1)) AS BIGINT) + 1) AS p95, max(n_chars) FILTER (place = n) AS greatest FROM r GROUP BY 1, 2""")
def order_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.order_statistics(table(spark, sf_dir, "documents"), ["lang"], "n_chars")


@query("""WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS place, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, n, max(n_chars) FILTER (place = 1) AS least, max(n_chars) FILTER (place = n // 2 + 1) AS median,
max(n_chars) FILTER (place = CAST(floor(0.95::DOUBLE * n) AS BIGINT) + 1) AS p95, max(n_chars) FILTER (place = n) AS greatest FROM r GROUP BY 1, 2""")
def order_stats_of_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.order_statistics(table(spark, sf_dir, "documents"), ["source"], "n_chars", p95_of_count=True)


@query("""SELECT conv_id, count(*) FILTER (role = 'user') AS n_first, count(*) FILTER (role = 'assistant') AS n_second FROM conversations
GROUP BY 1 HAVING count(*) FILTER (role = 'user') <> count(*) FILTER (role = 'assistant')""")
def role_balance_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.role_balance(table(spark, sf_dir, "conversations"), ["conv_id"], "role", "user", "assistant")


@query("""WITH h AS (SELECT d.source, list_distinct(list(l.quality || '/' || l.toxic)) AS held FROM documents d JOIN labels l USING (doc_id) GROUP BY 1)
SELECT source, CAST(len(list_filter(['0/0', '0/1', '1/0', '1/1'], lambda c: list_contains(held, c))) AS INTEGER) AS n_present,
array_to_string(list_filter(['0/0', '0/1', '1/0', '1/1'], lambda c: NOT list_contains(held, c)), ',') AS missing FROM h""")
def combo_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return C.combinations_covered(both, "source", F.concat_ws("/", F.col("quality").cast("string"), F.col("toxic").cast("string")), ["0/0", "0/1", "1/0", "1/1"])


@query("SELECT doc_id, sha256('seed-3' || doc_id) AS shuffle_key FROM documents ORDER BY 2 LIMIT 50")
def seeded_shuffle_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.seeded_order(table(spark, sf_dir, "documents").select("doc_id"), "seed-3", "doc_id", 50)

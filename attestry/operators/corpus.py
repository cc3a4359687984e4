"""Corpus hygiene: duplicates, overlap between splits, nearest neighbours by trigram Jaccard, balance of roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import text as T


def duplicates(df: DataFrame, key: Column, id_: str) -> DataFrame:
    """key, copies, first_id of every key that more than one row has. Partial counts combine before the shuffle."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("copies"), F.min(id_).alias("first_id")).where("copies > 1")


def shared_keys(left: DataFrame, right: DataFrame, key: Column) -> DataFrame:
    """Keys that both splits have."""
    return left.select(key.alias("key")).intersect(right.select(key.alias("key")))


def _trigrams(df: DataFrame, side: str) -> DataFrame:
    """side_id, grams (hashes of the distinct identity-stripped trigrams), side_n of each row of ``df`` (id, text)."""
    words = T.identity_stripped(F.coalesce("text", F.lit("")))
    of = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    grams = T.let(words, lambda w: F.when(F.size(w) >= 3, F.array_distinct(of(w))).otherwise(F.array().cast("array<bigint>")))
    return df.select(F.col("id").alias(f"{side}_id"), grams.alias("grams")).withColumn(f"{side}_n", F.size("grams"))


def nearest_by_trigrams(left: DataFrame, right: DataFrame, empty: float = 0.0) -> DataFrame:
    """left_id, right_id, similarity: each left row's nearest right row by Jaccard of identity-stripped trigrams.

    ``left`` and ``right``: id, text. Ties go to the smaller right id; without a common trigram the similarity
    is 0 and right_id null. Two rows without any trigram have the similarity ``empty``: nothing over nothing, which an audit
    may count as 1. An inverted index on trigrams, as 64-bit hashes, joins the two, and trigrams that the left side lacks
    never leave the scan of the right side. Cost: one row for each trigram that a left and a right row share.
    """
    a, b = _trigrams(left, "left"), _trigrams(right, "right")
    # Few enough left trigrams, by count, stop the right side's others before any shuffle.
    wanted = a.select(F.explode("grams").alias("gram")).distinct()
    theirs = b.select("right_id", "right_n", F.explode("grams").alias("gram"))
    if wanted.count() <= 500_000:
        theirs = theirs.join(F.broadcast(wanted), "gram", "left_semi")
    # Sizes go with the trigrams, so that the texts of the right side are read once.
    met = a.select("left_id", "left_n", F.explode("grams").alias("gram")).join(theirs, "gram").groupBy("left_id", "left_n", "right_id", "right_n").agg(F.count("*").alias("common"))
    scored = met.withColumn("similarity", F.col("common") / (F.col("left_n") + F.col("right_n") - F.col("common")))
    best = scored.groupBy("left_id").agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "right_id")).alias("best")).select("left_id", "best.right_id", (-F.col("best.minus")).alias("similarity"))
    found = a.select("left_id", "left_n").join(best, "left_id", "left")
    if empty:
        bare = b.where("right_n = 0").agg(F.min("right_id").alias("bare"))
        found = found.crossJoin(F.broadcast(bare))  # one row
        nothing = (F.col("left_n") == 0) & F.col("bare").isNotNull()
        found = found.withColumns({"right_id": F.when(nothing, F.col("bare")).otherwise(F.col("right_id")), "similarity": F.when(nothing, F.lit(empty)).otherwise(F.col("similarity"))})
    return found.select("left_id", "right_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def nearest_summary(nearest: DataFrame) -> DataFrame:
    """One row: rows, greatest, median (upper), at_least_half, at_least_four_fifths of the similarities (0 to 1) of ``nearest``.

    Rows are counted by similarity once. The running counts that the median needs are taken inside 4,096 ranges, on top of those
    of the ranges before, so only a row for each range meets in one task.
    """
    s, n = F.col("similarity"), F.col("n")
    counted = nearest.groupBy("similarity").agg(F.count("*").alias("n")).withColumn("range", F.floor(s * 4096).cast("int"))
    ranges = counted.groupBy("range").agg(F.sum("n").alias("here"))
    ranges = ranges.select(F.col("range").alias("of"), (F.sum("here").over(Window.orderBy("range")) - F.col("here")).alias("before"), F.sum("here").over(Window.partitionBy()).alias("all"))
    placed = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("range").orderBy("similarity"))).join(F.broadcast(ranges), F.col("range") == F.col("of"))  # at most 4,097 rows
    last = F.col("before") + F.col("upto")
    middle = F.floor(F.col("all") / 2) + 1
    return placed.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), F.max(s).alias("greatest"), F.coalesce(F.sum(F.when(s >= 0.5, n)), F.lit(0)).cast("long").alias("at_least_half"),
        F.coalesce(F.sum(F.when(s >= 0.8, n)), F.lit(0)).cast("long").alias("at_least_four_fifths"), F.max(F.when((last >= middle) & (last - n < middle), s)).alias("median"))


def shared_families(splits: DataFrame) -> DataFrame:
    """family, splits (sorted) of every family (split, family) that more than one split has."""
    held = splits.groupBy("family").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return held.where(F.size("splits") > 1)


def _tokens(text: Column) -> Column:
    """Words by blanks, as they stand: the first and last of a passage may be parts of words in the text."""
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")


def _contained_short(texts: DataFrame, short: DataFrame, blank: int) -> DataFrame:
    """text_id, passage_id for passages (passage_id, passage) of one or two words, which have no whole word inside.

    Some word of a text holds the longer one of theirs. Which words do is found over the distinct words alone: each is listed by its
    stretches of up to three signs, and a passage's word is looked up by its first ones. Passages of nothing but white space are compared
    with the texts themselves; more than ``blank`` of them are an error.
    """
    part = F.reduce(_tokens(F.col("passage")), F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    short = short.withColumn("part", part)
    bare = short.where("part = ''").select("passage_id", "passage")
    if bare.limit(blank + 1).count() > blank:
        raise ValueError(f"more than {blank} passages of white space")
    keyed = short.where("part <> ''").withColumn("gram", F.left("part", F.lit(3)))
    stretch = lambda n: F.transform(F.slice(F.sequence(F.lit(0), F.length("word")), F.lit(1), F.greatest(F.length("word") - (n - 1), F.lit(0))), lambda i: F.substring("word", i + 1, F.lit(n)))
    words = texts.select(F.col("id").alias("text_id"), F.explode(F.array_distinct(_tokens(F.col("text")))).alias("word"))
    grams = words.select("word").distinct().select("word", F.explode(F.array_distinct(F.concat(*[stretch(n) for n in (1, 2, 3)]))).alias("gram"))
    holding = grams.join(keyed.select("gram", "part").distinct(), "gram").where(F.contains("word", "part")).select("word", "part")
    met = words.join(holding, "word").select("text_id", "part").distinct().join(keyed.select("part", "passage_id", "passage"), "part")
    found = met.join(texts.select(F.col("id").alias("text_id"), "text"), "text_id").where(F.contains("text", "passage")).select("text_id", "passage_id")
    if bare.isEmpty():
        return found
    return found.union(texts.select(F.col("id").alias("text_id"), "text").join(F.broadcast(bare), F.contains("text", "passage")).select("text_id", "passage_id"))  # at most ``blank`` rows


def contained(texts: DataFrame, passages: DataFrame, blank: int = 100) -> DataFrame:
    """text_id, passage_id of every passage that occurs verbatim in a text.

    ``texts``, ``passages``: id, text. A passage's inner words stand in any text that holds it, so the pairs come from an
    equi-join on one run of its inner words, three of them or as many as there are, and are verified by containment. Of its
    runs each passage takes the one that the fewest texts have. A passage of one or two words has no inner word: see ``_contained_short``.
    """
    hashed = lambda words, n: T.let(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.lit(n), *[F.get(w, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>")))
    words = passages.where("text <> ''").select(F.col("id").alias("passage_id"), F.col("text").alias("passage"), _tokens(F.col("text")).alias("w"))
    inner = words.withColumn("inner", F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0))))
    short = inner.where("size(inner) = 0").select("passage_id", "passage")
    of_inner = F.when(F.size("inner") >= 3, hashed(F.col("inner"), 3)).when(F.size("inner") == 2, hashed(F.col("inner"), 2)).otherwise(hashed(F.col("inner"), 1))
    runs = inner.where("size(inner) > 0").select("passage_id", "passage", F.size("inner").alias("n"), F.explode(F.array_distinct(of_inner)).alias("run"))
    wanted = runs.select("run").distinct()
    small = wanted.count() <= 500_000
    sizes = [n for n in (1, 2, 3) if not runs.where(F.least("n", F.lit(3)) == n).isEmpty()]
    all_runs = F.flatten(F.array(*[hashed(_tokens(F.col("text")), n) for n in sizes])) if sizes else F.array().cast("array<bigint>")
    held = texts.select(F.col("id").alias("text_id"), F.explode(F.array_distinct(all_runs)).alias("run"))
    held = held.join(F.broadcast(wanted) if small else wanted, "run", "left_semi")
    frequent = held.groupBy("run").agg(F.count("*").alias("texts"))
    chosen = runs.join(frequent, "run").groupBy("passage_id").agg(F.count("*").alias("seen"), F.min(F.struct("texts", "run")).alias("rarest"))
    # A run that no text has rules its passage out.
    asked = runs.groupBy("passage_id").agg(F.count("*").alias("asked"))
    keyed = chosen.join(asked, "passage_id").where("seen = asked").select("passage_id", F.col("rarest.run").alias("run"))
    # Only the runs meet; the texts are joined to the few pairs that came together.
    pairs = held.join(keyed, "run").select("text_id", "passage_id").distinct()
    met = pairs.join(texts.select(F.col("id").alias("text_id"), "text"), "text_id").join(words.select("passage_id", "passage"), "passage_id")
    found = met.where(F.contains("text", "passage")).select("text_id", "passage_id")
    return (found if short.isEmpty() else found.union(_contained_short(texts, short, blank))).distinct()


def role_balance(df: DataFrame, group: list[str], role: str, first: str, second: str) -> DataFrame:
    """Groups in which two roles are not equally frequent, with both counts."""
    counted = df.groupBy(*group).agg(F.count_if(F.col(role) == first).alias("n_first"), F.count_if(F.col(role) == second).alias("n_second"))
    return counted.where("n_first <> n_second")


def combinations_covered(df: DataFrame, group: str, combo: Column, required: list[str]) -> DataFrame:
    """group, n_present, missing (sorted, comma-separated): which required combinations each group lacks."""
    held = df.groupBy(group).agg(F.collect_set(combo).alias("held"))
    needed = F.array(*[F.lit(r) for r in required])
    return held.select(group, F.size(F.array_intersect(needed, "held")).alias("n_present"), F.array_join(F.array_sort(F.array_except(needed, "held")), ",").alias("missing"))


def seeded_order(df: DataFrame, seed: str, id_: str, n: int) -> DataFrame:
    """The first ``n`` rows of a fixed shuffle: order by a digest of seed and id."""
    key = F.sha2(F.concat(F.lit(seed), F.col(id_).cast("string")), 256)
    return df.withColumn("shuffle_key", key).orderBy("shuffle_key").limit(n)


def order_statistics(df: DataFrame, group: list[str], value: str, p95_of_count: bool = False) -> DataFrame:
    """least, median (upper), p95 and greatest by position, not by interpolation; n rows.

    p95 stands at 0.95 * (n - 1) from 0, rounded down, or, ``p95_of_count``, at 0.95 * n.

    Equal values are counted first, with partial counts before the shuffle, so what a window orders is distinct values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("copies"))
    upto = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumns({"last": F.sum("copies").over(upto), "n": F.sum("copies").over(Window.partitionBy(*group))})
    at = lambda place: F.min(F.when(F.col("last") >= place, F.col(value)))
    return ranked.groupBy(*group, "n").agg(at(F.lit(1)).alias("least"), at(F.floor(F.col("n") / 2) + 1).alias("median"), at(F.floor(F.lit(0.95) * (F.col("n") - (0 if p95_of_count else 1))) + 1).alias("p95"), at(F.col("n")).alias("greatest"))

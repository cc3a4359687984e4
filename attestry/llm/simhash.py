"""Operator 3: SimHash near-duplicates through a byte-position inverted index with count filtering.

Two fingerprints of 8 bytes that differ in at most 2 bits share at least 6 of the 8 positional bytes. A posting
list of one positional byte would hold a 256th of the corpus, and its pairs would grow with the square; so a posting
is four positional bytes, and the 14 sets of four positions are those whose numbers have the exclusive or 0. Any
6 positions hold exactly 3 of these sets, any 5 at most 1: for each pair the shared postings are tallied, pairs
with 3 or more, the guaranteed minimum, are those that share 6 positional bytes, and these are verified bit by bit.

Work is on distinct fingerprints, so copies never meet as pairs. Lists longer than ``LONG_LIST`` give no
pairs: their members write down every one-bit change of themselves, and members with a change in common are at most two
bits apart and, reversely, two bits apart have one in common. At most 65 members share a change, so links from each
to the smallest of them stay in proportion to the members. A pair within 2 bits either shares a long list, or all
of its shared postings are tallied.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import shingle_sets
from attestry.llm.common import batch, id_and_text, joined, slices, table, written
from attestry.llm.graph import components

LONG_LIST = 64
def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: The sets of four byte positions that make a posting.
POSTINGS = [p for p in combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]
#: Postings that fingerprints with 6 equal positional bytes share at least.
LEAST_SHARED = 3
_MASKS = [_signed(sum(0xFF << 8 * k for k in p)) for p in POSTINGS]


def fingerprint(text: str, shingle: int = 3) -> int:
    """SimHash of the word shingles of a text; words are separated by ASCII white space, A-Z lower-cased."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.append(0, ends[:-1] + 1)[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        parts = [joined[a:b] for a, b in zip(begins[at : at + (1 << 16)], ends[at : at + (1 << 16)])]
        counts += shingle_sets.votes(np.fromiter(map(xxh64_intdigest, parts, repeat(42)), np.uint64, len(parts)))
    return int(shingle_sets.bits_of(counts, n))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, th (hash of the text), fp (the fingerprint's 64 bits). Null texts count as empty: fingerprint zero."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield batch(schema, doc_id=b.column("doc_id"), th=b.column("th"), fp=[_signed(fingerprint(t, shingle)) for t in b.column("text").to_pylist()])

    return id_and_text(docs).withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id long, th long, fp long")


def postings(fps: DataFrame) -> DataFrame:
    """n, key, fp: each of the distinct ``fp`` values once in each of its 14 lists."""
    keys = F.array(*[F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for n, m in enumerate(_MASKS)])
    return fps.select("fp", F.explode(keys).alias("k")).select("k.*", "fp")


def tallied(lists: DataFrame) -> DataFrame:
    """a, b, shared: how many of the ``lists`` (n, key, fp) each pair that meets has in common."""
    pairs = lists.withColumnRenamed("fp", "a").join(lists.withColumnRenamed("fp", "b"), ["n", "key"]).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def links(fps: DataFrame, long_list: int = LONG_LIST, most: int = 2) -> DataFrame:
    """a, b: links that connect exactly those of the distinct ``fp`` values that are within 2 bits.

    Every pair within 2 bits is linked, directly or, in long lists, through common neighbours of both. With a higher
    ``most``, pairs within as many bits of two bytes are linked too, but in long lists.
    """
    posted = postings(fps)
    sizes = posted.groupBy("n", "key").agg(F.count("*").alias("size")).where("size > 1")
    lists = written(posted.join(sizes, ["n", "key"]), "simhash-lists")

    pairs = tallied(lists.where(F.col("size") <= long_list).select("n", "key", "fp")).where(F.col("shared") >= LEAST_SHARED)
    near = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most).select("a", "b")

    bits = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << k)) for k in range(64)])
    changed = lists.where(F.col("size") > long_list).select("fp").distinct().select("fp", F.explode(bits).alias("bit"))
    changed = changed.select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("change"))
    smallest = changed.groupBy("change").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z")
    stars = changed.join(smallest.drop("z"), "change").where("a <> fp").select("a", F.col("fp").alias("b"))
    return near.union(stars.distinct())


def _rooted(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Stored fingerprints of every row, and fp, first, copies, root of every distinct fingerprint."""
    found = written(fingerprints(docs, shingle), "simhash")
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "simhash-distinct")
    root = components(links(distinct.select("fp")), "simhash-links")
    return found, distinct.join(root, distinct.fp == root.node, "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach (null only if all in reach are null).

    Rows stay as they are: a repeated doc_id has a row for each of its texts, a null doc_id keeps its row.
    """
    found, rooted = _rooted(docs, shingle)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return joined(found, rooted.select("fp", "copies", "root").join(least, "root").drop("root"), ["fp"]).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, small: int = 1_000_000, similarity: float | None = None) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest doc_id (nulls last), with all its columns.

    Groups are those within 2 bits. With a ``similarity`` they are those of the shingle sets of that Jaccard similarity: the
    index gives the SimHashes that differ in two bytes at most, the sets verify them and find the rest.

    Rows with the same doc_id and text are one document; of them one row stays. Tables of at most ``small``
    kept documents are broadcast, others joined by shuffle.
    """
    found, rooted = _rooted(docs, shingle) if similarity is None else shingle_sets.rooted(docs, shingle, similarity, lambda fps: links(fps, most=16))
    last = F.lit((1 << 63) - 1)
    rows = found.select(F.coalesce("doc_id", last).alias("id"), "th", "fp")
    kept = joined(rows, rooted.select("fp", "copies", "root"), ["fp"]).groupBy("root").agg(F.min(F.struct("id", "th")).alias("row")).select("row.*")
    kept = written(kept, "simhash-kept")
    id_, th = F.coalesce(F.col("doc_id").cast("long"), last), F.xxhash64(F.coalesce("text", F.lit("")))
    named = docs.select(F.struct(*docs.columns).alias("row"), id_.alias("id"), th.alias("th"))
    stay = named.join(F.broadcast(kept) if kept.count() <= small else kept, ["id", "th"], "left_semi")
    if not rows.groupBy("id", "th").count().where("count > 1").isEmpty():
        stay = stay.dropDuplicates(["id", "th"])
    return stay.select("row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see ``groups`` for its cases."""
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

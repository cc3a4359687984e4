"""Near-duplicates by SimHash and the Jaccard similarity of the documents' sets of word shingles, without loss.

Candidates come from operator 3's index of SimHashes, here of the same shingles as the sets, and are verified by the sets.
A SimHash of 64 bits turns some ten bits between sets of similarity 0.8, so the index can't find all: documents that it
has connected are one from there on, and an exact search looks for the links that are left, as follows.

A set's elements are 64-bit hashes in one order for the whole table. Two sets of similarity s or more share their
first few common elements within the first (1 - s) part of each, so only these prefixes are joined, and a pair must
share some of them before the whole sets are compared. Any order is right; shingles that a sample shows often come
last, so that common passages stay out of the prefixes of documents that have more than the passage.

Work is on distinct sets. In crowded lists each set meets the one with the most copies first; the full search
then leaves out pairs that are already connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import batch, id_and_text, slices, written
from attestry.llm.graph import components

#: So many common elements must be in both prefixes, or as many as the sets must share.
SHARED = 4
#: Lists longer than this meet their most copied set first.
CROWD = 16


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """Hashes of the word shingles, repeats included; words as in ``simhash.fingerprint``."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    return np.fromiter((xxh64_intdigest(b" ".join(words[k : k + shingle]), 42) for k in range(n)), np.uint64, n)


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Distinct hashes of the word shingles, ascending."""
    return np.unique(shingle_hashes(text, shingle).view(np.int64))


def votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, lowest first."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def bits_of(counts: np.ndarray, n: int) -> np.uint64:
    """The SimHash of ``n`` hashes: a bit is 1 if over half of them have it."""
    return np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]


def least_shared(k: int, similarity: float) -> int:
    """Elements that a set of ``k`` shares at least with any other of the similarity."""
    return int(np.ceil(similarity * k - 1e-9))


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """doc_id, th and the whole set of each row of doc_id, th, text."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("elements", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            yield batch(schema, doc_id=b.column("doc_id"), th=b.column("th"), elements=[shingle_set(t, shingle) for t in b.column("text").to_pylist()])

    return rows.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, elements array<long>")


def _named(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).withColumn("th", F.xxhash64("text"))


def often(docs: DataFrame, shingle: int, share: int = 16, least: int = 4, most: int = 200_000) -> np.ndarray:
    """Shingles seen in ``least`` documents or more of every ``share``-th, ascending. Only the order depends on them."""
    some = _sets(_named(docs).where(F.pmod(F.xxhash64("th"), F.lit(share)) == 0), shingle)
    counts = some.select(F.explode("elements").alias("e")).groupBy("e").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r.e for r in counts.orderBy(F.desc("n"), "e").limit(most).collect()], np.int64))


def prefixes(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, th, fp (names the set), k (its size), prefix and bits (the SimHash) of each row. Null texts count as empty."""
    common = often(docs, shingle)
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64()), ("k", pa.int32()), ("prefix", pa.list_(pa.int64())), ("bits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in slices(batches):
            names, sizes, firsts, bits = [], [], [], []
            for t in b.column("text").to_pylist():
                h = shingle_hashes(t, shingle)
                bits.append(bits_of(votes(h), len(h)))
                s = np.unique(h.view(np.int64))
                names.append(xxh64_intdigest(s.tobytes(), 7))
                sizes.append(len(s))
                if len(common):
                    last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
                    s = np.concatenate([s[~last], s[last]])
                need = least_shared(len(s), similarity)
                firsts.append(s[: len(s) - need + min(SHARED, need)])
            fp = np.array(names, np.uint64).view(np.int64)
            yield batch(schema, doc_id=b.column("doc_id"), th=b.column("th"), fp=fp, k=sizes, prefix=firsts, bits=np.array(bits, np.uint64).view(np.int64))

    return _named(docs).select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, fp long, k int, prefix array<long>, bits long")


def _verified(docs: DataFrame, distinct: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the stored pairs a, b of sets that have the similarity; the sets come from a document of each."""
    needed = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    places = distinct.join(needed, "fp", "left_semi").select("fp", "rep.*")
    last = F.lit((1 << 63) - 1)
    rows = _named(docs).withColumn("doc_id", F.coalesce("doc_id", last)).join(places.select("doc_id", "th"), ["doc_id", "th"], "left_semi")
    sets = _sets(rows, shingle).join(places, ["doc_id", "th"]).select("fp", "elements").dropDuplicates(["fp"])
    sets = written(sets, "sets-needed")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")


def _sizes_fit(a: Column, b: Column, similarity: float) -> Column:
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-9


def by_simhash(distinct: DataFrame, index: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """a, b: sets to compare first. ``index`` gives links a, b of SimHashes (fp); sets of one SimHash meet the most copied of them,
    which stands for them in these links.
    """
    heads = written(distinct.groupBy("bits").agg(F.max(F.struct("copies", "fp", "k")).alias("head")), "sets-bits")
    side = lambda c: heads.select(F.col("bits").alias(c), F.col("head").alias(f"{c}_set"))
    linked = index(heads.select(F.col("bits").alias("fp"))).join(side("a"), "a").join(side("b"), "b").select("a_set", "b_set")
    same = distinct.join(heads, "bits").where("fp <> head.fp").select(F.col("head").alias("a_set"), F.struct("copies", "fp", "k").alias("b_set"))
    near = linked.union(same).where(_sizes_fit(F.col("a_set.k"), F.col("b_set.k"), similarity))
    return near.select(F.col("a_set.fp").alias("a"), F.col("b_set.fp").alias("b"))


def links(docs: DataFrame, distinct: DataFrame, shingle: int, similarity: float, index: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """a, b: links whose connected groups are those of all pairs of sets with the similarity.

    ``distinct``: fp, k, prefix, bits, copies, rep (an occurrence: doc_id, nulls last, and th) of each distinct set.
    """
    listed = distinct.select("fp", "k", "copies", F.explode("prefix").alias("e"))
    listed = listed.withColumn("size", F.count("*").over(Window.partitionBy("e"))).where("size > 1")
    listed = written(listed, "sets-lists")

    crowded = listed.where(F.col("size") > CROWD)
    head = crowded.groupBy("e").agg(F.max(F.struct("copies", "fp", "k")).alias("head"))
    met = crowded.join(head, "e").where(F.col("fp") != F.col("head.fp")).where(_sizes_fit(F.col("k"), F.col("head.k"), similarity))
    met = met.select(F.col("head.fp").alias("a"), F.col("fp").alias("b")).union(by_simhash(distinct, index, similarity))
    met = written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "sets-heads")
    started = written(_verified(docs, distinct, met, shingle, similarity), "sets-started")
    known = components(started, "sets-known")
    member = written(known.union(known.select("root", "root").distinct()).toDF("fp", "part"), "sets-parts")

    parted = listed.join(member, "fp", "left").withColumn("part", F.coalesce("part", "fp"))
    # A list of one part has no pair left.
    open_ = parted.groupBy("e").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("e")
    parted = written(parted.join(open_, "e", "left_semi").select("e", "fp", "k", "part"), "sets-open")
    side = lambda c: parted.select("e", *[F.col(n).alias(f"{c}_{n}") for n in ("fp", "k", "part")])
    pairs = side("a").join(side("b"), "e").where("a_fp < b_fp and a_part <> b_part").where(_sizes_fit(F.col("a_k"), F.col("b_k"), similarity))
    pairs = pairs.groupBy("a_fp", "b_fp").agg(F.count("*").alias("n"), F.min(F.least("a_k", "b_k")).alias("k"))
    need = F.least(F.lit(SHARED), F.ceil(F.lit(similarity) * F.col("k") - 1e-9))
    near = written(pairs.where(F.col("n") >= need).select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")), "sets-near")
    return started.union(_verified(docs, distinct, near, shingle, similarity))


def rooted(docs: DataFrame, shingle: int, similarity: float, index: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Stored doc_id, th, fp of every row, and fp, copies, root of every distinct set. ``index``: see ``by_simhash``."""
    found = written(prefixes(docs, shingle, similarity), "sets")
    rep = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "th")
    distinct = found.groupBy("fp").agg(F.any_value("k").alias("k"), F.any_value("prefix").alias("prefix"), F.min("bits").alias("bits"), F.count("*").alias("copies"), F.min(rep).alias("rep"))
    distinct = written(distinct, "sets-distinct")
    root = components(links(docs, distinct, shingle, similarity, index), "sets-links")
    return found.select("doc_id", "th", "fp"), distinct.join(root, distinct.fp == root.node, "left").select("fp", "copies", F.coalesce("root", "fp").alias("root"))

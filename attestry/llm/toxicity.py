"""Operator 6: toxicity by a bag of subword embeddings, averaged into a linear softmax.

A word's vector is the mean of the vectors of itself and its character n-grams, all hashed to a fixed number
of buckets, so a misspelling that training never saw shares most of its vectors with the word. A document's
vector is the mean over its words. Vectors and softmax are trained jointly in numpy with Adagrad on a bounded
sample of labelled documents; scoring covers every whole text, and each task scores a distinct word once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.bpe import gather
from attestry.llm.common import batch, id_and_text, slices, table

_TOKEN = re.compile(r"[^\W_]+(?:[*@$!'’][^\W_]+)*")
#: Averages over hundreds of words are small; the softmax sees them times this fixed number.
_SCALE = 20.0
#: A document's mean counts this many words that say nothing, so that a few odd words decide no short text.
_SILENT = 10


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def buckets(words: list[str], size: int, shortest: int = 3, longest: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its character n-grams, with marks at both ends, word after word, and how many each has.

    All words lie in one array of code points: an n-gram's hash is a sum of its signs times fixed odd numbers, the word's
    own one over all its signs. ``size`` is a power of two.
    """
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    signs = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lens)
    place = np.arange(len(signs)) - np.repeat(ends - lens, lens)
    left = np.repeat(lens, lens) - place
    odd = np.cumprod(np.full(max(longest, int(lens.max(initial=1))), 0x9E3779B97F4A7C15, np.uint64)) | np.uint64(1)

    def bucket(h: np.ndarray) -> np.ndarray:
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int32)

    widths = [w for w in range(shortest, longest + 1)]
    # A word as short as an n-gram is that n-gram.
    many = [np.maximum(0, lens - w + 1) - (lens == w) for w in widths]
    counts = 1 + sum(many)
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.int32)
    out[at] = bucket(np.add.reduceat(signs * odd[place], ends - lens)) if len(words) else 0
    at = at + 1
    owner = np.repeat(np.arange(len(words)), lens)
    for w, n in zip(widths, many):
        starts = np.flatnonzero((left >= w) & (np.repeat(lens, lens) != w))
        h = np.full(len(starts), w, np.uint64)
        for j in range(w):
            h += signs[starts + j] * odd[j]
        out[at[owner[starts]] + place[starts]] = bucket(h)
        at = at + n
    return out, counts


@dataclass
class Model:
    """``vectors`` by bucket, ``weights`` from vector to the two classes, ``bias``."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    known: dict[str, float] = field(default_factory=dict, repr=False)
    per_bucket: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.vectors, self.weights, self.bias

    def __setstate__(self, state):
        self.vectors, self.weights, self.bias = state
        self.known, self.per_bucket = {}, None

    def word_logits(self, words: list[str]) -> list[float]:
        """What each word adds to the log-odds of class 1, before the mean over words."""
        if not words:
            return []
        slots, counts = buckets(words, len(self.vectors))
        if self.per_bucket is None:
            self.per_bucket = self.vectors @ (self.weights[:, 1] - self.weights[:, 0])
        return (np.add.reduceat(self.per_bucket[slots], np.cumsum(counts) - counts) / counts * _SCALE).tolist()

    def scores(self, texts: list[str], remembered: int = 150_000, at_once: int = 256) -> list[float]:
        """Probability of class 1; a text without words has that of the bias alone."""
        base, out = float(self.bias[1] - self.bias[0]), []
        for at in range(0, len(texts), at_once):
            split = [tokens(t) for t in texts[at : at + at_once]]
            if len(self.known) > remembered:
                self.known = {}
            if new := sorted(set().union(*split).difference(self.known)):
                self.known.update(zip(new, self.word_logits(new)))
            logits = [sum(map(self.known.__getitem__, words)) / (len(words) + _SILENT) + base for words in split]
            out += (1 / (1 + np.exp(-np.clip(logits, -30, 30)))).tolist()
        return out


@dataclass
class Counts:
    """Documents as distinct words with counts: ``words`` has every word once, the others lie flat by document."""

    words: list[str]
    index: np.ndarray
    counts: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(documents: list[Counter]) -> Counts:
        known: dict[str, int] = {}
        index = np.fromiter((known.setdefault(w, len(known)) for d in documents for w in d), np.int32)
        return Counts(list(known), index, np.fromiter((n for d in documents for n in d.values()), np.float32), np.array([len(d) for d in documents], np.int64))


def train(documents: Counts, labels: list[int], size: int = 1 << 16, dim: int = 8, steps: int = 1_500, rate: float = 0.3, seed: int = 1, group: int = 32, damping: float = 1e-3, least_docs: int = 20) -> Model:
    """Fit to counted documents in ``steps`` gradient steps of ``group`` documents, whatever their number. One class or no rows: the prior alone."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.int64)
    vectors = rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32)
    weights = rng.uniform(-1, 1, (dim, 2)).astype(np.float32)
    prior = (np.bincount(y, minlength=2) + 1) / (len(y) + 2)
    bias = np.log(prior).astype(np.float32)
    if len(set(labels)) < 2:
        return Model(vectors * 0, weights, bias)
    n_docs, ends = len(documents.sizes), np.cumsum(documents.sizes)
    doc = [slice(int(e - n), int(e)) for e, n in zip(ends, documents.sizes)]
    share = documents.counts / np.repeat(np.add.reduceat(np.append(documents.counts, 0), np.minimum(ends - documents.sizes, len(documents.counts))) + _SILENT, documents.sizes)
    parts = [buckets(documents.words[at : at + 20_000], size) for at in range(0, len(documents.words), 20_000)]
    flat, lens = (np.concatenate(x) for x in zip(*parts))
    del parts
    begin = np.cumsum(lens) - lens
    # A bucket of few documents would only learn those by heart: it stays zero.
    in_docs = np.zeros(size, np.int64)
    for some in doc:
        words = documents.index[some]
        in_docs[np.unique(flat[gather(begin[words], lens[words])])] += 1
    live = in_docs >= least_docs
    vectors[~live] = 0
    vectors = np.ascontiguousarray(vectors.T)  # a row for each dimension
    seen, seen_w, seen_b = np.full(size, damping, np.float32), np.full(weights.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    full = np.flatnonzero(documents.sizes)
    order, at = full[:0], 0
    for number in range(steps if len(full) else 0):
        step = np.float32(rate * (1 - number / steps))
        if at >= len(order):
            order, at = rng.permutation(full), 0
        some = order[at : at + group].tolist()
        at += group
        words, inverse = np.unique(np.concatenate([documents.index[doc[k]] for k in some]), return_inverse=True)
        part = np.concatenate([share[doc[k]] for k in some])
        first = np.cumsum(documents.sizes[some]) - documents.sizes[some]
        owner = np.repeat(np.arange(len(some)), documents.sizes[some])
        n = lens[words]
        starts = np.cumsum(n) - n
        slots = flat[gather(begin[words], n)]
        mean = np.stack([np.add.reduceat((np.add.reduceat(v[slots], starts) / n)[inverse] * part, first) for v in vectors], 1) * _SCALE
        logits = mean @ weights + bias
        error = np.exp(logits - logits.max(axis=1, keepdims=True))
        error /= error.sum(axis=1, keepdims=True)
        error[np.arange(len(some)), y[some]] -= 1
        grad_mean = (error @ weights.T) * _SCALE
        grad_w, grad_b = mean.T @ error / len(some), error.mean(axis=0)
        # Over all buckets: that is less work than to find the distinct ones of a step.
        grad = np.stack([np.bincount(slots, np.repeat(np.bincount(inverse, part * g[owner], len(words)) / n, n), size) for g in grad_mean.T]).astype(np.float32)
        grad *= live
        seen += (grad * grad).mean(axis=0)
        vectors -= step * grad / np.sqrt(seen)
        seen_w += grad_w * grad_w
        weights -= step * grad_w / np.sqrt(seen_w)
        seen_b += grad_b * grad_b
        bias -= step * grad_b / np.sqrt(seen_b)
    return Model(np.ascontiguousarray(vectors.T), weights, bias)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 6_000) -> Model:
    """Fit to at most ``rows`` labelled documents of ``docs`` (doc_id, text), taken by a hash of their doc_id.

    ``labels``: doc_id, toxic (0 or 1). Only rows whose crc32(doc_id as text) mod 3 is not 1 are learnt from;
    rows with a null in either column are no labels; of a doc_id with both labels, 1 holds. Executors count the
    words, so the driver gets distinct words and counts of that bounded sample alone.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    learnt = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = learnt.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # its size is bounded by rows
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [Counter(tokens(t)) for t in b.column("text").to_pylist()]
            yield batch(schema, doc_id=b.column("doc_id"), toxic=b.column("toxic"), words=[list(c) for c in found], counts=[list(c.values()) for c in found])

    counted = id_and_text(docs).join(F.broadcast(sample), "doc_id").mapInArrow(count, "doc_id long, toxic int, words array<string>, counts array<int>").toArrow()
    counted = counted.sort_by("doc_id").combine_chunks()
    words = counted["words"].combine_chunks()
    coded = words.flatten().dictionary_encode()
    sizes = np.diff(words.offsets.to_numpy())
    documents = Counts(coded.dictionary.to_pylist(), coded.indices.to_numpy(), counted["counts"].combine_chunks().flatten().to_numpy().astype(np.float32), sizes.astype(np.int64))
    labels_ = counted["toxic"].to_pylist()
    del counted, words, coded
    return train(documents, labels_)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, row (all columns of ``docs`` as a struct) and score of every whole text; null texts count as empty. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(texts.tolist()), dtype="float64")
        shared.value.known = {}  # the worker lives on for other tasks

    return docs.select("doc_id", F.struct(*docs.columns).alias("row"), of(F.coalesce("text", F.lit(""))).alias("score"))


def op6_toxicity(spark: SparkSession, sf_dir: str, reject: float = 0.7) -> DataFrame:
    """Score and decision of every document; see ``fit`` and ``score`` for their cases."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return scored.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= reject).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, reject: float = 0.7) -> DataFrame:
    """``docs`` without those that score ``reject`` or more; all of their columns stay."""
    return score(docs, fit(docs, labels)).where(F.col("score") < reject).select("row.*")

"""Operator 2: lexical retrieval packing of whole documents into windows of a fixed number of tokens.

A document that opens a window is its seed. A BM25 index over the token ids of the seed's shard returns
the nearest documents that no window has used; they fill the window in order of score. The last one is cut
where the window ends, and its rest opens the next window. When nothing related is left, the next unused
document goes on. The counts behind the scores (documents with a term, documents, mean length) cover the
whole corpus; only the postings are per shard, so a task holds the index of one shard at a time.

A seed sees its own shard alone, so documents are dealt to shards by content: in the order of the rare ids that
they hold (``kinship``), copies and documents that share such ids are neighbours.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.bpe import gather
from attestry.llm.common import batch, id_and_text, slices, table, written
from attestry.llm.tokens import rank_encoder, vocabulary

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECE = pa.schema([(c.split()[0], pa.int64()) for c in PIECE.split(", ")])


class ShardIndex:
    """BM25 postings of one shard; ``documents`` are arrays of term ids, ``idf`` is by term id."""

    def __init__(self, documents: list[np.ndarray], idf: np.ndarray, mean_length: float, k1: float = 1.2, b: float = 0.75):
        self.docs = len(documents)
        lens = np.fromiter(map(len, documents), np.int64, len(documents))
        found = [np.unique(d, return_counts=True) for d in documents]
        sizes = np.fromiter((len(t) for t, _ in found), np.int64, len(found))
        # A document's own terms, for its turn as a seed.
        self.own = np.concatenate([[0], np.cumsum(sizes)])
        self.terms = np.concatenate([t for t, _ in found]).astype(np.int32)
        doc = np.repeat(np.arange(len(documents), dtype=np.int32), sizes)
        tf = np.concatenate([c for _, c in found]).astype(np.float32)
        weight = (idf[self.terms] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens[doc] / mean_length))).astype(np.float32)
        order = np.argsort(self.terms, kind="stable")
        self._post(self.terms[order], doc[order], weight[order])

    def _post(self, term: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> None:
        self.term, self.doc, self.weight, self.left = term, doc, weight, self.docs
        # Postings of the n-th distinct term of the shard; a term's number is found by binary search.
        self.known, begin = np.unique(term, return_index=True)
        self.begin = np.append(begin, len(term))

    def ranked(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, by the BM25 of all its terms, best first, ties by position.

        ``used`` only ever grows: once a quarter of the documents in the postings is used, they leave them.
        """
        unused = self.docs - int(np.count_nonzero(used))
        if 4 * unused < 3 * self.left:
            stay = ~used[self.doc]
            self._post(self.term[stay], self.doc[stay], self.weight[stay])
            self.left = unused
        terms = self.terms[self.own[seed] : self.own[seed + 1]]
        k = np.minimum(np.searchsorted(self.known, terms), len(self.known) - 1)
        k = k[self.known[k] == terms] if len(self.known) else k[:0]
        at = gather(self.begin[k], self.begin[k + 1] - self.begin[k])
        score = np.bincount(self.doc[at], self.weight[at], self.docs)
        score[used] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def fill_order(documents: list[np.ndarray], index: ShardIndex, window: int, filled: int) -> list[int]:
    """The order in which a shard's documents go into windows, the first of which holds ``filled`` tokens."""
    used, order, cursor, n = np.zeros(len(documents), bool), [], 0, len(documents)
    seed: int | None = None

    def put(k: int) -> None:
        nonlocal filled, seed
        used[k] = True
        order.append(k)
        now = filled + len(documents[k])
        if now >= window or seed is None:
            seed = k  # it opens the window that is now open
        filled = now % window
        if filled == 0:
            seed = None

    while len(order) < n:
        if seed is not None:
            at = seed
            for k in index.ranked(seed, used).tolist():
                put(k)
                if seed != at:
                    break
            if seed != at:
                continue
        while cursor < n and used[cursor]:
            cursor += 1
        if cursor < n:
            seed = None
            put(cursor)
    return order


def cuts(total: int, window: int) -> np.ndarray:
    """Ends of the sequences of a stream: whole windows, then powers of two, which need no padding."""
    ends = list(range(window, total + 1, window))
    at = ends[-1] if ends else 0
    while at < total:
        at += 1 << (total - at).bit_length() - 1
        ends.append(at)
    return np.array(ends, np.int64)


def kinship(ids: np.ndarray, cost: np.ndarray) -> int:
    """The three ids of least ``cost`` in a document, as one number: documents that share rare ids have them in common."""
    own = np.unique(ids)
    low = np.argpartition(cost[own], min(3, len(own) - 1))[:3] if len(own) else own
    low = low[np.argsort(cost[own[low]])]
    key = 0
    for k in range(3):
        key = key << 20 | (int(own[low[k]]) + 1 if k < len(low) else 0)
    return key


def width(vocabulary_size: int) -> str:
    """Little-endian unsigned integers that hold the ids of a vocabulary."""
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def costs(vocabulary_size: int) -> np.ndarray:
    """A fixed random cost of each id, lower for ids late in the vocabulary, which merges made of rarer strings."""
    return np.random.default_rng(2).exponential(1.0, vocabulary_size) / np.linspace(1e-3, 1.0, vocabulary_size) ** 2


def encode(docs: DataFrame, vocabulary_path: str, end_id: int, vocabulary_size: int) -> DataFrame:
    """doc_id, kin (see ``kinship``), ids of each text and ``end_id``, by the byte-level rank file; ids as ``width`` says."""
    schema = pa.schema([("doc_id", pa.int64()), ("kin", pa.int64()), ("ids", pa.binary())])
    cost = costs(vocabulary_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(vocabulary_path)
        for b in slices(batches):
            ids = [np.append(x, np.uint32(end_id)).astype(width(vocabulary_size)) for x in encoder.encode(b.column("text").to_pylist())]
            yield batch(schema, doc_id=b.column("doc_id"), kin=[kinship(x, cost) for x in ids], ids=[x.tobytes() for x in ids])

    return id_and_text(docs).mapInArrow(run, "doc_id long, kin long, ids binary")


def pack(encoded: DataFrame, vocabulary_size: int, window: int = 2048, shard_docs: int = 512, shard_tokens: int = 1 << 19) -> DataFrame:
    """Pieces of the documents of ``encoded`` (doc_id, kin, ids with their end id, as ``encode`` gives them): see ``PIECE``.

    Every token of every row lies in one piece; repeated and null doc_ids are packed like others. Rows
    without ids give no piece; no rows, no pieces. Rows are put in order of ``kin`` by ranges, where rows of
    one kin may lie in several tasks; a shard is the next rows of a task, up to ``shard_docs`` of them or the first
    beyond ``shard_tokens`` tokens, so that its index is bounded whatever the texts. The last window of a task ends as
    sequences of powers of two. ``encoded`` must be stored, since its rows are read more than once.
    """
    counted = pa.schema([("term", pa.int32()), ("docs", pa.int64()), ("rows", pa.int64()), ("tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, rows, tokens = np.zeros(vocabulary_size, np.int64), 0, 0
        for b in slices(batches):
            for x in b.column("ids"):
                ids = np.frombuffer(x.as_buffer(), width(vocabulary_size))
                docs[np.unique(ids)] += 1
                rows, tokens = rows + 1, tokens + len(ids)
        seen = np.flatnonzero(docs)
        n = len(seen)
        yield batch(counted, term=np.append(seen, -1), docs=np.append(docs[seen], 0), rows=[0] * n + [rows], tokens=[0] * n + [tokens])

    sums = encoded.select("ids").mapInArrow(count, "term int, docs long, rows long, tokens long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"))
    # At most one row for each id of the vocabulary.
    stats = sums.toPandas()
    rows, tokens = int(stats.rows.sum()), int(stats.tokens.sum())
    if not tokens:
        return encoded.sparkSession.createDataFrame([], PIECE)
    with_term = np.zeros(vocabulary_size)
    known = stats[stats.term >= 0]
    with_term[known.term.to_numpy()] = known.docs.to_numpy()
    idf = np.log1p((rows - with_term + 0.5) / (with_term + 0.5)).astype(np.float32)
    mean_length = tokens / rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        rest: list[tuple] = []  # of documents in the window that is still open
        filled = 0

        def shard(doc_ids: list, documents: list[np.ndarray], last: bool) -> pa.RecordBatch:
            nonlocal sequence, rest, filled
            order = fill_order(documents, ShardIndex(documents, idf, mean_length), window, filled) if documents else []
            held = rest + [(doc_ids[k], documents[k], 0) for k in order]
            lens = np.array([len(ids) - start for _, ids, start in held], np.int64)
            ends = np.cumsum(lens)
            total = int(ends[-1]) if len(ends) else 0
            stop = cuts(total, window) if last else np.arange(window, total + 1, window)
            closed = int(stop[-1]) if len(stop) else 0
            points = np.unique(np.concatenate([stop, ends[ends < closed]]))
            begins = np.concatenate([[0], points[:-1]])[: len(points)]
            owner, seq = np.searchsorted(ends, begins, side="right"), np.searchsorted(stop, begins, side="right")
            opens = np.concatenate([[0], stop])[seq]
            out: dict[str, list] = {f.name: [] for f in _PIECE}
            for k, a, b, s, o in zip(owner.tolist(), begins.tolist(), points.tolist(), seq.tolist(), opens.tolist()):
                doc_id, ids, start = held[k]
                start += a - int(ends[k] - lens[k])
                values = doc_id, start, b - a, zlib.crc32(ids[start : start + b - a].astype("<u4")), len(ids), sequence + s, a - o
                for c, v in zip(out.values(), values):
                    c.append(v)
            first = int(np.searchsorted(ends, closed, side="right"))
            rest = [(d, ids, start + max(0, closed - int(e - n))) for (d, ids, start), e, n in zip(held[first:], ends[first:], lens[first:])]
            sequence, filled = sequence + len(stop), total - closed
            return batch(_PIECE, **out)

        doc_ids: list = []
        documents: list[np.ndarray] = []
        tokens_ = 0
        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                # A copy: what is kept of a batch must not keep the batch.
                ids = np.frombuffer(x.as_buffer(), width(vocabulary_size)).copy()
                if len(ids):
                    doc_ids.append(d)
                    documents.append(ids)
                    tokens_ += len(ids)
                if len(documents) >= shard_docs or tokens_ >= shard_tokens:
                    yield shard(doc_ids, documents, False)
                    doc_ids, documents, tokens_ = [], [], 0
        yield shard(doc_ids, documents, True)

    near = encoded.withColumn("at", F.xxhash64("doc_id", F.length("ids"))).repartitionByRange("kin", "at").sortWithinPartitions("kin", "at")
    return near.select("doc_id", "ids").mapInArrow(run, PIECE)


def pack_documents(docs: DataFrame) -> DataFrame:
    """All of ``docs`` (doc_id, text; null text: empty) as the contract of operator 2 asks."""
    size = 50_257
    return pack(written(encode(docs, vocabulary("byte_bpe_50k.tiktoken"), 1, size), "packing"), size)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens; see ``pack`` for its cases."""
    return pack_documents(table(spark, sf_dir, "documents"))

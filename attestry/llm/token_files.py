"""Operator 9: token ids of a corpus in files of directly addressable codes (see ``dac``), and back.

The documents are dealt to shards by ranges of doc_id, whose bounds come from one pass over that column
alone. Only encoded ids are shuffled. A task writes its shard in segments of bounded size through Spark's
own writer, so the files can lie in any store that Spark reaches; small files of segment heads stand beside
them, and the first position of every shard follows from those, without a look into the files of codes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.llm.common import batch, id_and_text, slices, table, work_dir
from attestry.llm.dac import Segment, encode_segment, segments
from attestry.llm.tokens import library_encoder, vocabulary

_HEAD = "<qqqq"


def write(docs: DataFrame, path: str, vocabulary_path: str, end_id: int, vocabulary_size: int, docs_per_shard: int = 8_192, segment_ids: int = 1_000_000) -> None:
    """Write the ids of ``docs`` (doc_id, text), each document's followed by ``end_id``, below ``path``.

    Order: ascending doc_id, null doc_ids first; rows of one doc_id follow each other by their ids. Null and
    empty texts have the end id alone. No rows: no file of codes. Other columns are not read.

    Spark's text writer carries the segments: their bytes are cast to strings, valid UTF-8 or not, and written as
    they are, each with a line feed behind it. A segment knows its size, so line feeds inside it do no harm.
    Bounds of shards are quantiles of doc_id within an error of 1e-5 of the rows at the least, so that what the
    driver holds doesn't grow with the shards; segments stay bounded whatever a shard's size.
    """
    spark, rows = docs.sparkSession, id_and_text(docs)
    shards = max(1, -(-rows.count() // docs_per_shard))
    cuts = rows.stat.approxQuantile("doc_id", [k / shards for k in range(1, shards)], max(0.1 / shards, 1e-5)) if shards > 1 else []
    bounds = np.unique(np.array(cuts, np.int64))
    encoded = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    width = "<u2" if vocabulary_size <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary_path)
        for b in slices(batches):
            ids, out = b.column("doc_id").to_pylist(), []
            for x in encoder.encode(b.column("text").to_pylist()):
                out.append(np.append(x, np.uint32(end_id)).astype(width).tobytes())
            shard = np.searchsorted(bounds, [-(1 << 63) if i is None else i for i in ids], side="right")
            yield batch(encoded, shard=shard, doc_id=ids, ids=out)

    codes = pa.schema([("kind", pa.string()), ("value", pa.binary())])

    def to_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, before, doc_ids, held, size = None, 0, 0, [], [], 0

        def flush():
            code = encode_segment(shard, number, before, doc_ids, held)
            yield batch(codes, kind=["codes", "heads"], value=[code, struct.pack(_HEAD, shard, number, before, size)])

        for b in batches:
            for s, d, ids in zip(*(b.column(c) for c in ("shard", "doc_id", "ids"))):
                if held and (s.as_py() != shard or size >= segment_ids):
                    yield from flush()
                    number, before = number + 1, before + size
                    doc_ids, held, size = [], [], 0
                if s.as_py() != shard:
                    shard, number, before = s.as_py(), 0, 0
                x = np.frombuffer(ids.as_buffer(), width)
                doc_ids.append(d.as_py())
                held.append(x)
                size += len(x)
        if held:
            yield from flush()

    dealt = rows.mapInArrow(encode, "shard int, doc_id long, ids binary").repartitionById(len(bounds) + 1, F.col("shard"))
    files = dealt.sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "ids").mapInArrow(to_files, "kind string, value binary")
    files.select("kind", F.col("value").cast("string")).write.option("maxRecordsPerFile", 16).partitionBy("kind").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids of every document in the files below ``path``."""
    schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def rows(seg: Segment) -> pa.RecordBatch:
        n = len(seg.doc_ids)
        return batch(schema, shard=[seg.shard] * n, doc_id=seg.doc_ids, at=seg.before + seg.begin[:-1], ids=[seg.document(k).astype(np.int64) for k in range(n)])

    return _read(spark, path, rows, "shard long, doc_id long, at long, ids array<long>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files below ``path``, each fetched by its place."""
    schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def rows(seg: Segment) -> pa.RecordBatch:
        crc = [zlib.crc32(seg.document(k).astype("<u4").tobytes()) for k in range(len(seg.doc_ids))]
        return batch(schema, shard=[seg.shard] * len(crc), doc_id=seg.doc_ids, at=seg.before + seg.begin[:-1], n_tokens=np.diff(seg.begin), ids_crc32=crc)

    return _read(spark, path, rows, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")


def _read(spark: SparkSession, path: str, rows, schema: str) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                for seg in segments(content.as_buffer()):
                    yield rows(seg)

    head = pa.schema([("shard", pa.int64()), ("n", pa.int64())])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content").to_pylist():
                found = [struct.unpack_from(_HEAD, content, at) for at in range(0, len(content), struct.calcsize(_HEAD) + 1)]
                yield batch(head, shard=[h[0] for h in found], n=[h[3] for h in found])

    make = spark._jvm.org.apache.hadoop.fs.Path
    if not make(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(make(f"{path}/kind=codes")):
        # An empty table leaves no files.
        return spark.createDataFrame([], schema.replace("shard long, ", "").replace("at long", "start long"))
    binary = "path string, modificationTime timestamp, length long, content binary"
    files = spark.read.format("binaryFile").schema(binary).option("recursiveFileLookup", True)
    # One row a shard: the running sum over shards is small at any size of the corpus.
    sums = files.load(f"{path}/kind=heads").select("content").mapInArrow(heads, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    found = files.load(f"{path}/kind=codes").select("content").mapInArrow(parse, schema)
    rest = [c for c in found.columns if c not in ("shard", "doc_id", "at")]
    return found.join(base, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), *rest)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document to files and back."""
    path = work_dir(spark, "token-files")
    write(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=2, vocabulary_size=49_408)
    return digests(spark, path)

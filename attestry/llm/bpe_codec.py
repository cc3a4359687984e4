"""Operator 10: BPE encoding and decoding of whole texts (see ``bpe`` for the merge rounds)."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from attestry.llm.bpe import byte_bpe
from attestry.llm.common import batch, id_and_text, slices, table
from attestry.llm.tokens import numpy_encoder, vocabulary


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids (array of int) of each text.

    Null and empty texts have no ids; repeated and null doc_ids keep one row each; other columns of
    ``docs`` are not read. No shuffle: each task encodes the rows that it reads.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = numpy_encoder(vocabulary_path)
        for b in slices(batches):
            yield batch(schema, doc_id=b.column("doc_id"), ids=[x.astype("int32") for x in encoder.encode(b.column("text").to_pylist())])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, text of each row's ids; bytes that are no UTF-8 become U+FFFD. Null ids: empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(vocabulary_path)
        for b in batches:
            yield batch(schema, doc_id=b.column("doc_id"), text=[model.decode(ids or ()) for ids in b.column("ids").to_pylist()])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Encode, decode the ids again, and digest both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The same cases as ``encode`` and ``decode``, in one pass, so that no ids leave a task.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, model = numpy_encoder(vocabulary_path), byte_bpe(vocabulary_path)
        decimal = [str(i) for i in range(model.size)]
        for b in slices(batches):
            rows: list[tuple[int, str, str]] = []
            for x in encoder.encode(b.column("text").to_pylist()):
                ids = x.tolist()
                rows.append((len(ids), sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest(), sha256(model.decode(ids).encode()).hexdigest()))
            n, a, d = zip(*rows) if rows else ((), (), ())
            yield batch(schema, doc_id=b.column("doc_id"), n_tokens=n, ids_sha256=a, decoded_sha256=d)

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round trip of every whole document."""
    return round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))

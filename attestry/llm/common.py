"""Shared plumbing of the training-data operators: tables, work folders, written cuts of the lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Where that setting is absent, a temporary folder takes its place, but only on one machine (a local master):
    elsewhere every executor would write to a disk of its own, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.attestry.work.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="attestry-")
            spark.conf.set("spark.attestry.work.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str, codec: str = "zstd", repeats: bool = True) -> DataFrame:
    """Write ``df`` as Parquet to the shared work folder and read it back: lineage ends there.

    ``repeats``: false for tables, such as of hashes, whose values hardly repeat, so that no dictionary of them is tried.
    """
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    df.write.option("compression", codec).option("parquet.enable.dictionary", str(repeats).lower()).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Delete the files of a table from ``written`` that nothing will read again."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df``, stored and of rows of a fixed size of some 40 bytes, with a broadcast hint if it has at most ``rows``."""
    return F.broadcast(df) if df.count() <= rows else df


def joined(rows: DataFrame, named: DataFrame, keys: list[str], hot: int = 100_000) -> DataFrame:
    """``rows`` joined with ``named``, which has one row a key and in ``copies`` how many of ``rows`` have it.

    Keys of more than ``hot`` copies are broadcast, at most one for ``hot`` rows, so none of them fills a task; the others
    meet by shuffle.
    """
    often = named.where(F.col("copies") > hot).drop("copies")
    rest = named.where(F.col("copies") <= hot).drop("copies")
    return rows.join(F.broadcast(often), keys).unionByName(rows.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(rest, keys))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows``, so that a task holds few rows as Python values at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()  # the worker lives on for other tasks


def id_and_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and text alone; null texts become empty, so that every row keeps a result."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """An Arrow batch of ``schema`` from columns by name."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)

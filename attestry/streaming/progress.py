"""Results as they come: finished cases from a folder of JSON lines, kept as a table of the latest of each case.

``follow`` writes each micro-batch's latest rows to a folder of the batch's number, and now and then merges all of them into a
base folder that is named by the last batch in it. ``latest`` reads the base and what came behind it, one row a case. So a batch
costs what is in it, a merge is rare, a reader sees a state that was whole, and a batch done again after a failure replaces itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_results(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of results from a folder to which finished cases are added as JSON lines."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def _newest(rest: list[str], order: str) -> Column:
    """What rows of a key are compared by: their order, then their content, so that ties don't depend on who comes first."""
    return F.struct(F.col(order), F.to_json(F.struct(*rest)))


def latest_of_each(batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """The latest row of each key; of rows as late, the one whose JSON text is the greatest. Combines before the shuffle."""
    rest = [c for c in batch.columns if c not in key]
    return batch.groupBy(*key).agg(F.max_by(F.struct(*rest), _newest(rest, order)).alias("row")).select(*key, "row.*")


def _folders(spark: SparkSession, target: str) -> tuple[int, list[int]]:
    """The last batch of the newest whole base (-1 without one), and the whole batches behind it."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = make(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(make(target))] if fs.exists(make(target)) else []
    whole = lambda kind: sorted(int(n.split("=")[1]) for n in names if re.fullmatch(rf"{kind}=\d+", n) and fs.exists(make(f"{target}/{n}/_SUCCESS")))
    base = max(whole("base"), default=-1)
    return base, [b for b in whole("batch") if b > base]


def latest(spark: SparkSession, target: str, key: list[str], order: str, schema: str) -> DataFrame:
    """The latest row of each case that ``follow`` has written to ``target``; none if it wrote nothing yet."""
    target = target.rstrip("/")
    base, batches = _folders(spark, target)
    paths = [f"{target}/base={base}"] * (base >= 0) + [f"{target}/batch={b}" for b in batches]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return latest_of_each(rows, key, order) if batches else rows


def compact(spark: SparkSession, target: str, key: list[str], order: str, schema: str) -> None:
    """Merge what stands in ``target`` into one base. The folders it was made of stay for readers that know them, until ``tidy``."""
    _, batches = _folders(spark, target.rstrip("/"))
    if batches:
        latest(spark, target, key, order, schema).write.mode("overwrite").parquet(f"{target.rstrip('/')}/base={batches[-1]}")


def tidy(spark: SparkSession, target: str) -> None:
    """Delete the folders that the newest base has taken in; for when no reader has them open."""
    target = target.rstrip("/")
    base, _ = _folders(spark, target)
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = make(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(make(target)):
        kind, _, number = status.getPath().getName().partition("=")
        if number.isdigit() and (kind == "batch" and int(number) <= base or kind == "base" and int(number) < base):
            fs.delete(status.getPath(), True)


def follow(results: DataFrame, target: str, checkpoint: str, key: list[str], order: str, every: int = 20) -> StreamingQuery:
    """Keep ``target`` up to date with a stream of results; a restarted query goes on where the checkpoint stands.

    Each micro-batch's latest rows go to a folder of its number; a batch that is done again writes to the same one. Every ``every``
    batches they are merged (``compact``). ``latest`` reads the table.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in latest_of_each(results, key, order).schema)

    def write(batch: DataFrame, number: int) -> None:
        latest_of_each(batch, key, order).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")
        if number % every == every - 1:
            compact(batch.sparkSession, target, key, order, schema)

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

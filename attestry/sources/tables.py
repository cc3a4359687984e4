"""Sources and sinks: JSON lines, JSON documents, append logs, create-only, staged and replaced outputs, replay."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, blank_lines: bool = True) -> DataFrame:
    """One JSON object a line, failing on the first malformed one; blank lines are skipped or, if not allowed, malformed."""
    lines = spark.read.text(path)
    if blank_lines:
        lines = lines.where(F.trim("value") != "")
    parsed = F.from_json("value", schema if isinstance(schema, str) else schema.simpleString(), {"mode": "FAILFAST"})
    checked = F.when(F.try_parse_json("value").isNull(), F.raise_error(F.concat(F.lit("malformed line: "), F.left("value", F.lit(80))))).otherwise(parsed)
    return lines.select(checked.alias("row")).select("row.*")


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as one object each: file, document (variant); what is no object is an error."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("document"))
    bad = F.col("document").isNull() | ~F.coalesce(F.schema_of_variant("document").startswith("OBJECT"), F.lit(False))
    return files.select("file", F.when(bad, F.raise_error(F.concat(F.lit("no JSON object: "), "file"))).otherwise(F.col("document")).alias("document"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with null fields written out; an existing output is an error."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a log of JSON lines; every call commits on its own."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def _store(spark: SparkSession, path: str):
    """The store of a path, and a function from text to its path."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def publish(df: DataFrame, path: str, check) -> None:
    """Write beside the target, verify what was written, then rename: a reader sees all of it or nothing.

    ``check`` takes the rows as read back and returns a DataFrame of errors, which must be empty. Each writer stages under
    a name of its own; an existing target is an error, before and after.
    """
    spark, staging = df.sparkSession, f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    fs, make = _store(spark, path)
    if fs.exists(make(path)):
        raise FileExistsError(path)
    try:
        df.write.parquet(staging)
        if not check(spark.read.parquet(staging)).isEmpty():
            raise ValueError(f"verification failed, nothing published to {path}")
        # A rename onto a folder that came up meanwhile would move into it.
        if fs.exists(make(path)):
            raise FileExistsError(path)
        if not fs.rename(make(staging), make(path)):
            raise OSError(f"could not rename {staging}")
    finally:
        fs.delete(make(staging), True)


def checkpoint(df: DataFrame, path: str) -> None:
    """Write beside the target and put it in the place of the earlier checkpoint, which stays until then.

    Should the last step fail, the earlier one is put back.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    staging, old = f"{path.rstrip('/')}.next-{mark}", f"{path.rstrip('/')}.last-{mark}"
    fs, make = _store(spark, path)
    df.write.parquet(staging)
    before = fs.exists(make(path))
    if before and not fs.rename(make(path), make(old)):
        fs.delete(make(staging), True)
        raise OSError(f"could not set {path} aside")
    if not fs.rename(make(staging), make(path)):
        if before:
            fs.rename(make(old), make(path))
        raise OSError(f"could not rename {staging}")
    fs.delete(make(old), True)


#: Fixed value: names of runs and cases.
RUN_NAME = r"[A-Za-z0-9][A-Za-z0-9._-]*"


def reserve(spark: SparkSession, folder: str, name: str, suffixes: list[str]) -> list[str]:
    """Create the empty files of a run's outputs, all or none; the name is of letters, digits, dots, dashes and underscores.

    A file is created only if there is none, so of two runs of one name one fails, and leaves nothing behind.
    """
    if not re.fullmatch(RUN_NAME, name):
        raise ValueError(f"unsafe run name: {name!r}")
    paths, made = [f"{folder.rstrip('/')}/{name}{s}" for s in suffixes], []
    fs, make = _store(spark, folder)
    for p in paths:
        try:
            created = fs.createNewFile(make(p))
        except Exception:
            created = False
        if not created:
            for q in made:
                fs.delete(make(q), False)
            raise FileExistsError(p)
        made.append(p)
    return paths


def run_name(base: bool = False) -> str:
    """A fresh name for a run, by time and chance."""
    return f"{'base' if base else 'adapter'}-{datetime.now(timezone.utc):%Y%m%dT%H%M%S%fZ}-{uuid.uuid4().hex[:8]}"


def select_cases(cases: DataFrame, ids: list[str] | None = None, limit: int | None = None, reserved: bool = False, acknowledged: bool = False) -> DataFrame:
    """Cases by id, in the order of the data (``ord``), then the first ``limit``; unknown ids are an error.

    A reserved split is refused unless acknowledged, and is never taken in part.
    """
    if reserved and not acknowledged:
        raise PermissionError("the reserved split needs an acknowledgement")
    if reserved and (ids or limit):
        raise PermissionError("the reserved split is evaluated whole")
    if ids:
        wanted = cases.sparkSession.createDataFrame([(i,) for i in ids], "id string")
        unknown = wanted.join(cases, "id", "left_anti").limit(5).toPandas()["id"].tolist()
        if unknown:
            raise ValueError(f"unknown ids: {unknown}")
        cases = cases.where(F.col("id").isin(ids))
    return cases.orderBy("ord").limit(limit) if limit else cases.orderBy("ord")


def replay(cases: DataFrame, outputs: DataFrame, key: list[str], inputs: list[str] = []) -> DataFrame:
    """Cases with the recorded ``raw_output`` of the model, which stands in for it everywhere.

    The record must fit: a case without an output, an output without a case, two for one case, or a column of ``inputs`` that
    reads otherwise than when the output was recorded is an error as soon as the rows are read.
    """
    recorded = outputs.groupBy(*key).agg(F.count("*").alias("times_"), F.first(F.struct("raw_output", *inputs)).alias("out_"))
    marked = cases.withColumn("case_", F.lit(True))
    both = marked.join(recorded, key, "full_outer")
    name = F.to_json(F.struct(*key))
    wrong = F.when(F.col("times_").isNull(), "no recorded output for ").when(F.col("case_").isNull(), "recorded output without a case: ").when(F.col("times_") > 1, "several recorded outputs for ")
    for c in inputs:
        wrong = wrong.when(~F.col(c).eqNullSafe(F.col(f"out_.{c}")), f"{c} has changed since the output was recorded for ")
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, name)).cast("string")).otherwise(F.col("out_.raw_output"))
    return both.select(*cases.columns, checked.alias("raw_output"))

"""A run of cases under several variants that commits as it goes and goes on where it was stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import evaluate
from attestry.sources.tables import _store

VARIANT = "variant"


def plan_digest(planned: DataFrame) -> str:
    """Number and digest of the planned rows, whatever their order: what a run must not change between its beginning and its end."""
    hashes = planned.select(F.sha2(F.to_json(F.struct(*sorted(planned.columns))), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", k, 8), 16, 10).cast("decimal(38,0)")) for k in (1, 9, 17, 25)]
    row = hashes.agg(F.count("*"), *parts).first()
    return "-".join(str(x or 0) for x in row)


def _committed(spark: SparkSession, folder: str) -> list[int]:
    fs, make = _store(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(make(folder))] if fs.exists(make(folder)) else []
    return sorted(int(n[5:]) for n in names if n.startswith("part=") and n[5:].isdigit())


def results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What a run has committed so far."""
    paths = [f"{folder.rstrip('/')}/part={n}" for n in _committed(spark, folder.rstrip("/"))]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _same_plan(planned: DataFrame, folder: str) -> None:
    spark, path, digest = planned.sparkSession, f"{folder}/plan", plan_digest(planned)
    fs, make = _store(spark, folder)
    if not fs.exists(make(path)):
        staging = f"{path}.new"
        fs.delete(make(staging), True)
        spark.createDataFrame([(digest,)], "digest string").coalesce(1).write.parquet(staging)
        fs.rename(make(staging), make(path))
    elif (was := spark.read.parquet(path).first().digest) != digest:
        raise ValueError(f"{folder} holds a run of other cases or variants: {was}, now {digest}")


def run(cases: DataFrame, variants: list[str], generate: Callable[[DataFrame], DataFrame], folder: str, schema: str, size: int = 1) -> DataFrame:
    """Results of every case (id, ord and more) under every variant, committed ``size`` pairs at a time; returns ``results``.

    ``generate`` takes pairs (the columns of ``cases`` and ``variant``) and returns a row of ``schema``, with id and variant, for each: a failure is a row
    with an error, not an exception. Pairs go in the order of the cases and, inside one, of the variants. Each commit is written
    beside the others and renamed; a run that was stopped anywhere is started again by the same call, which takes the pairs that no
    commit holds. Other cases or variants than the folder's run are refused, as is a ``generate`` that leaves out, repeats or invents a pair.
    """
    spark, folder = cases.sparkSession, folder.rstrip("/")
    fs, make = _store(spark, folder)
    planned = evaluate.grid(cases, variants, VARIANT)
    _same_plan(planned, folder)
    place = F.array_position(F.array(*[F.lit(v) for v in variants]), F.col(VARIANT))
    while True:
        left = evaluate.pending(planned, results(spark, folder, schema), ["id", VARIANT])
        chosen = left.orderBy("ord", "id", place).limit(size)
        if chosen.isEmpty():
            return results(spark, folder, schema)
        staging, number = f"{folder}/next", len(_committed(spark, folder))
        fs.delete(make(staging), True)
        generate(chosen).write.parquet(staging)
        made = spark.read.schema(schema).parquet(staging).select("id", VARIANT)
        if not evaluate.reconcile(made, chosen.select("id", VARIANT)).isEmpty():
            raise ValueError("generate must return each of its pairs once, and no other")
        if not fs.rename(make(staging), make(f"{folder}/part={number}")):
            raise OSError(f"could not commit {folder}/part={number}")

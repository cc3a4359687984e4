"""What both vector searches share: usable rows, classes of equal vectors, Arrow columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(embeddings: DataFrame, nonzero: bool) -> DataFrame:
    """vec_id, embedding of the rows that take part, and c1, c2, a key of the vector's content.

    A null vec_id, a null or empty vector, and a null or non-finite component keep a row out; zero vectors too
    where ``nonzero`` asks so. Other columns are left behind.
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), e).where("vec_id is not null and size(embedding) > 0").where(finite)
    if nonzero:
        rows = rows.where(F.exists(e, lambda x: x != 0))
    return rows.select("vec_id", "embedding", F.xxhash64(e).alias("c1"), F.xxhash64(F.lit(7), e).alias("c2"))


def classes(rows: DataFrame, members: int) -> DataFrame:
    """c1, c2, embedding, first, members: each distinct vector once, with its ``members`` smallest vec_ids.

    No result of a search for fewer than that many can hold more of one class. Ranks are cut before the
    shuffle, so a vector that a third of the rows share brings a few rows from each task.
    """
    order = Window.partitionBy("c1", "c2").orderBy("vec_id")
    kept = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= members).drop("place")
    return kept.groupBy("c1", "c2").agg(F.first("embedding").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("members")).select("c1", "c2", "embedding", F.col("members")[0].alias("first"), "members")


def best(found: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each ``by`` in ``order``, with rank from 1; cut before the shuffle too."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def expand(tops: DataFrame, queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best rows but itself, from its class's best classes.

    ``tops``: q1, q2, c1, c2, score; ``queries``: vec_id, c1, c2; ``index``: classes with members.
    """
    hits = tops.join(index.select("c1", "c2", "members"), ["c1", "c2"]).select("q1", "q2", "score", F.explode("members").alias("vec_id"))
    own = queries.select(F.col("vec_id").alias("query_id"), F.col("c1").alias("q1"), F.col("c2").alias("q2"))
    # Of a class's k + 1 best rows, a query may be one itself.
    hits = best(hits, ["q1", "q2"], k + 1, F.desc("score"), F.col("vec_id")).drop("rank")
    return best(own.join(hits, ["q1", "q2"]).where("vec_id <> query_id"), ["query_id"], k, F.desc("score"), F.col("vec_id")).select("query_id", "rank", "vec_id", "score")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)

"""Operator 1: approximate nearest neighbours by cross-polytope hashing.

Each table turns unit vectors by pseudo-rotations (three rounds of random signs and a fast Hadamard transform); a rotation's
hash is the signed axis nearest to the vector. A table's cell joins the hashes of as many rotations as make cells of a
few rows each, the last one over fewer axes, so their number grows with the logarithm of the rows. A query looks into the
cells of every table whose axes have the highest sum of products with it (multiprobe); how many grows with the root of
the number of cells, so the share of the rows that it meets shrinks as they grow. The rows of a cell meet
the queries that look into it in one group, where exact cosines rank them: candidate pairs exist inside a task only.
Groups are cut to a bounded size on both sides. Equal vectors are one class. Queries that met too few rows
search all of them exactly, in blocks, as do all queries among few rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.bpe import gather
from attestry.llm.common import slices, small, table, written
from attestry.llm.vectors import best, classes, expand, matrix, usable


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    half = 1
    while half < d:
        x = x.reshape(n, -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        half *= 2
    return x.reshape(n, d) / np.sqrt(d)


@lru_cache(maxsize=4096)
def signs(number: int, size: int, seed: int = 20) -> np.ndarray:
    """The random signs of the three rounds of a pseudo-rotation."""
    return np.random.default_rng([seed, number, size]).choice([-1.0, 1.0], (3, size))


def rotated(vectors: np.ndarray, number: int) -> np.ndarray:
    """The rows after pseudo-rotation ``number``, as wide as the next power of two."""
    n, d = vectors.shape
    size = 1 << max(0, d - 1).bit_length()
    x = np.zeros((n, size))
    x[:, :d] = vectors
    for s in signs(number, size):
        x = hadamard(x * s)
    return x


def layout(rows: int, dim: int, fill: int = 4) -> list[int]:
    """Axes that each rotation of a table takes part with, so that some ``rows / fill`` cells come of them, a power of two."""
    size, bits = 1 << max(0, dim - 1).bit_length(), round(np.log2(max(1, rows / fill)))
    whole = size.bit_length()  # bits of a hash: one of twice as many signed axes
    full, rest = divmod(max(1, bits), whole)
    return [size] * full + ([1 << rest - 1] if rest else [])


def cells(vectors: np.ndarray, table_number: int, axes: list[int], probes: int) -> np.ndarray:
    """The ``probes`` cells of a table with the highest sum of products for each row, in no order."""
    number = np.zeros((len(vectors), 1), np.int64)
    score = np.zeros((len(vectors), 1))
    for k, width in enumerate(axes):
        x = rotated(vectors, 64 * table_number + k)[:, :width]
        both = np.concatenate([x, -x], axis=1)
        # The best sums are made of the best of both sides.
        near = np.argmax(both, axis=1)[:, None] if probes == 1 else np.argpartition(-both, min(probes, 2 * width) - 1, axis=1)[:, :probes]
        score = (score[:, :, None] + np.take_along_axis(both, near, 1)[:, None, :]).reshape(len(x), -1)
        number = (number[:, :, None] * (2 * width) + near[:, None, :]).reshape(len(x), -1)
        best_ = np.argpartition(-score, probes - 1, axis=1)[:, :probes] if probes < score.shape[1] else np.arange(score.shape[1])[None, :].repeat(len(score), 0)
        score, number = np.take_along_axis(score, best_, 1), np.take_along_axis(number, best_, 1)
    return number


def search(embeddings: DataFrame, every: int = 50, k: int = 5, tables: int = 18, width: float = 0.5, group: int = 32_768, few: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose vec_id ``every`` divides.

    See ``vectors.usable`` for rows without part. Ties go to the smaller vec_id; a vec_id that repeats takes
    part with each of its rows, but is no candidate of a query of its own number. Vectors of different lengths
    never meet. ``width``: probes of a table as a multiple of the root of its cells. At most ``few`` distinct vectors of
    a length are searched exactly, as are queries that find fewer than ``k`` others. Recall is in the README and the tests.
    """
    rows = usable(embeddings, nonzero=True)
    index = written(classes(rows, k + 1), "ann-classes")
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "c1", "c2")
    asked = written(index.join(queries.select("c1", "c2").distinct(), ["c1", "c2"], "left_semi"), "ann-queries")
    # One row a length of vectors.
    sizes = {r.dim: r.n for r in index.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()}
    axes = {dim: [] if n <= few else layout(n, dim) for dim, n in sizes.items()}
    found = _met(index, asked, k, group, axes, tables, width)
    found = written(found, "ann-found")
    # A class's own row is found too, so a query is short of rows if its k + 1 best classes hold too few of them.
    held = found.join(index.select("c1", "c2", F.size("members").alias("rows")), ["c1", "c2"]).groupBy("q1", "q2").agg(F.sum("rows").alias("rows"))
    short = asked.join(held.where(F.col("rows") > k).select(F.col("q1").alias("c1"), F.col("q2").alias("c2")), ["c1", "c2"], "left_anti")
    hashed = [dim for dim, a in axes.items() if a]
    short = written(short.where(F.size("embedding").isin(hashed)), "ann-short") if hashed else short.limit(0)
    if hashed and not short.isEmpty():
        found = found.join(short.select(F.col("c1").alias("q1"), F.col("c2").alias("q2")), ["q1", "q2"], "left_anti").unionByName(_met(index, short, k, group, {dim: [] for dim in axes}, 1, width))
    tops = best(found, ["q1", "q2"], k + 1, F.desc("score"), F.col("first")).drop("rank")
    return expand(tops, queries, index, k)


def _met(index: DataFrame, asked: DataFrame, k: int, group: int, axes: dict[int, list[int]], tables: int, width: float) -> DataFrame:
    """q1, q2, c1, c2, first, score: the ``k`` + 1 best of the rows that each asked class meets.

    ``axes``: of each length of vectors; none of them: one cell, in which all meet.
    """

    rows = index.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    rows = {r.dim: r.n for r in rows.collect()}  # one row a length of vectors
    count = {dim: int(np.prod([2 * a for a in axes[dim]])) for dim in rows}
    # Neighbouring cells of a table share a part, which a task searches: so many rows of it that a task is worth its start.
    per = {dim: count[dim] // min(count[dim], 1 << max(0, n // (group // 4)).bit_length()) for dim, n in rows.items()}
    kind = index.schema["embedding"].dataType.simpleString()
    of = pa.float32() if kind == "array<float>" else pa.float64()
    schema = pa.schema([("dim", pa.int32()), ("t", pa.int32()), ("part", pa.int64()), ("cells", pa.list_(pa.int64())), ("c1", pa.int64()), ("c2", pa.int64()), ("first", pa.int64()), ("embedding", pa.list_(of))])

    def placed(df: DataFrame, probing: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 256):
                dims = np.diff(b.column("embedding").offsets.to_numpy())
                for dim in np.unique(dims).tolist():
                    some = b.filter(pa.array(dims == dim))
                    x = matrix(some.column("embedding"))
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    probes = min(count[dim], int(np.ceil(width * np.sqrt(count[dim])))) if probing else 1
                    for t in range(tables if axes[dim] else 1):
                        cell = np.sort(cells(x, t, axes[dim], probes), axis=1)
                        row, cell = np.repeat(np.arange(len(x)), cell.shape[1]), cell.ravel()
                        part = cell // per[dim]
                        begin = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])))
                        again = some.take(pa.array(row[begin]))
                        lists = pa.ListArray.from_arrays(np.append(begin, len(cell)).astype(np.int32), cell)
                        own = {c: again.column(c) for c in ("c1", "c2", "first")}
                        columns = {"dim": np.full(len(again), dim), "t": np.full(len(again), t), "part": part[begin], "embedding": again.column("embedding").cast(pa.list_(of)), **own}
                        arrays = [lists if f.name == "cells" else columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema]
                        yield pa.RecordBatch.from_arrays(arrays, schema=schema)

        return df.select("c1", "c2", "first", "embedding").mapInArrow(run, f"dim int, t int, part long, cells array<long>, c1 long, c2 long, first long, embedding {kind}")

    stored, looks = placed(index, False), placed(asked, True)
    # Parts beyond the bound are cut by a hash; each cut of one side meets each cut of the other.
    size = lambda df, name: df.groupBy("dim", "t", "part").agg(F.ceil(F.count("*") / group).cast("int").alias(name))
    cuts = small(written(size(stored, "m").join(size(looks, "n"), ["dim", "t", "part"]), "ann-parts"))
    stored = stored.join(cuts, ["dim", "t", "part"]).withColumn("i", F.pmod(F.xxhash64("c1"), "m")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    looks = looks.join(cuts, ["dim", "t", "part"]).withColumn("j", F.pmod(F.xxhash64("c1"), "n").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("m") - 1).cast("long"))))
    out = pa.schema([("q1", pa.int64()), ("q2", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("first", pa.int64()), ("score", pa.float64())])

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return out.empty_table()
        first = left["first"].to_numpy()
        qs, xs, scores = nearest(matrix(left["embedding"]), left["cells"].combine_chunks().flatten().to_numpy(), first, matrix(right["embedding"]), right["cells"].to_pylist(), k + 1)
        qs, xs = pa.array(qs), pa.array(xs)
        return pa.table([right["c1"].take(qs), right["c2"].take(qs), left["c1"].take(xs), left["c2"].take(xs), left["first"].take(xs), pa.array(scores)], schema=out)

    keys = ["dim", "t", "part", "i", "j"]
    met = stored.drop("m", "n").groupBy(*keys).cogroup(looks.drop("m", "n").groupBy(*keys)).applyInArrow(verify, "q1 long, q2 long, c1 long, c2 long, first long, score double")
    return best(met.distinct(), ["q1", "q2"], k + 1, F.desc("score"), F.col("first")).drop("rank")


def nearest(x: np.ndarray, cell: np.ndarray, first: np.ndarray, q: np.ndarray, looks: list[list[int]], k: int, at_once: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the ``k`` nearest rows of ``x`` in the cells that each query looks into; ties to smaller ``first``."""
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    # A query whose cells hold a row each pays for pairs; where all look into one cell, one product of matrices is less.
    whole = cell[0] == cell[-1]
    if not whole:
        flat = np.array([c for cells_ in looks for c in cells_], np.int64)
        owner = np.repeat(np.arange(len(looks)), [len(c) for c in looks])
        begin, end = np.searchsorted(cell, flat), np.searchsorted(cell, flat, side="right")
    met = np.bincount(owner, end - begin, len(q)).astype(np.int64) if not whole else np.full(len(q), len(x))
    starts, stop = [0], 0
    while stop < len(q):  # queries whose pairs fit in memory together, at the least one
        stop = max(stop + 1, int(np.searchsorted(np.cumsum(met), at_once + (np.cumsum(met)[stop - 1] if stop else 0), side="right")))
        starts.append(min(stop, len(q)))
    out = []
    q_length, x_length = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (q, x))
    unit = x / x_length[:, None] if whole else None
    for lo, hi in zip(starts, starts[1:]):
        if whole:
            rough = q[lo:hi] @ unit.T
            keep = min(len(x), k + 3)
            near = np.argpartition(-rough, keep - 1, axis=1)[:, :keep]
            # Whatever is as near as the last of them, up to rounding, is a candidate too.
            low = np.take_along_axis(rough, near, 1).min(axis=1) - 1e-9 * q_length[lo:hi]
            a, b = np.nonzero(rough >= low[:, None])
            a = a + lo
        else:
            some = slice(*np.searchsorted(owner, [lo, hi]))
            a, b = np.repeat(owner[some], end[some] - begin[some]), order[gather(begin[some], end[some] - begin[some])]
        exact = np.einsum("ij,ij->i", q[a], x[b]) / (q_length[a] * x_length[b])
        by = np.lexsort((first[b], -exact, a))
        a, b, exact = a[by], b[by], exact[by]
        few = np.arange(len(a)) - np.searchsorted(a, a) < k
        out.append((a[few], b[few], exact[few]))
    return tuple(np.concatenate(c) for c in zip(*out))


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth row; see ``search`` for its cases."""
    return search(table(spark, sf_dir, "embeddings"))

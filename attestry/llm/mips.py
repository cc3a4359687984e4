"""Operator 4: exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length, in steps of a fixed ratio from the longest down. A bounded part of the longest
gives each query a score that its k-th result reaches at least; queries are put in blocks by the length that this score
asks of a vector, and of the other groups and blocks only those pairs meet whose greatest length reaches the least
asked. Inside a pair, a query's score against the group's longest vector is a local cosine threshold. It bounds
the values that a result's coordinates may have where the query's are largest; from the number of vectors inside
these bounds and the number long enough, the cheaper of coordinate and length pruning is chosen for each query. What
is left is verified by exact integer products. Parts of groups and blocks of queries have bounded sizes.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.llm.common import small, table, written
from attestry.llm.vectors import best, classes, expand, matrix, usable

_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def quantised(vectors: np.ndarray) -> np.ndarray:
    return np.floor(64.0 * vectors)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integers held as doubles: one matrix product while every partial sum fits."""
    if np.sqrt((q * q).sum(axis=1).max()) * np.sqrt((x * x).sum(axis=1).max()) < _EXACT / 2:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape)
    exact = whole(q) @ whole(x).T
    return np.array([[max(-_LONG, min(_LONG, v)) for v in row] for row in exact], np.int64).reshape(len(q), len(x))


class Group:
    """One group of vectors, longest first, with its coordinates sorted for look-ups."""

    def __init__(self, vectors: np.ndarray):
        self.lengths = np.sqrt((vectors * vectors).sum(axis=1))
        self.order = np.argsort(-self.lengths, kind="stable")
        self.vectors, self.lengths = vectors[self.order], self.lengths[self.order]
        self.unit = self.vectors / np.maximum(self.lengths, 1e-300)[:, None]
        self.low, self.high = self.unit.min(axis=0), self.unit.max(axis=0)
        self.by_coordinate: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_length(self, need: np.ndarray) -> np.ndarray:
        """How many vectors, from the longest, are at least ``need`` long."""
        return np.searchsorted(-self.lengths, -need, side="right")

    def _sorted(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        if c not in self.by_coordinate:
            order = np.argsort(self.unit[:, c], kind="stable")
            self.by_coordinate[c] = order, self.unit[order, c]
        return self.by_coordinate[c]

    def spans(self, units: np.ndarray, cosines: np.ndarray, focus: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each unit query its ``focus`` largest coordinates, and the begin and end, in the order of that
        coordinate, of the vectors whose value there allows the cosine."""
        at = np.argsort(-np.abs(units), axis=1, kind="stable")[:, :focus]
        value = np.take_along_axis(units, at, 1)
        middle, reach = value * cosines[:, None], np.sqrt(np.maximum(0, 1 - value**2) * np.maximum(0, 1 - cosines[:, None] ** 2))
        # Where the bound passes the end of the axis the sphere is cut on one side only.
        low = np.where((middle - reach > -1) & (cosines[:, None] > -value), middle - reach - 1e-9, -2.0)
        high = np.where((middle + reach < 1) & (cosines[:, None] > value), middle + reach + 1e-9, 2.0)
        begin, end = np.zeros(at.shape, np.int64), np.full(at.shape, len(self.unit))
        tight = (low > self.low[at]) | (high < self.high[at])
        for c in np.unique(at[tight]).tolist():
            values = self._sorted(c)[1]
            some = tight & (at == c)
            begin[some], end[some] = np.searchsorted(values, low[some]), np.searchsorted(values, high[some], side="right")
        return at, begin, end

    def feasible(self, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Vectors inside all spans of one query, looked for from the shortest on."""
        left: np.ndarray | None = None
        for k in np.argsort(end - begin, kind="stable").tolist():
            if end[k] - begin[k] < len(self.unit):
                values = self._sorted(int(at[k]))[1]
                if left is None:
                    left = self._sorted(int(at[k]))[0][begin[k] : end[k]]
                elif len(left):
                    own = self.unit[left, at[k]]
                    left = left[(own >= (values[begin[k]] if begin[k] < len(values) else 2.0)) & (own <= (values[end[k] - 1] if end[k] else -2.0))]
        return np.arange(len(self.unit)) if left is None else left


def group_top(group: Group, queries: np.ndarray, floors: np.ndarray, first: np.ndarray, k: int, focus: int = 4, tally: dict | None = None):
    """(query, vector, score) of each query's ``k`` best in a group among those that reach its floor.

    ``floors`` may be -inf. Ties go to the smaller ``first``. ``tally`` counts products by the pruning that left them.
    """
    lengths = np.sqrt((queries * queries).sum(axis=1))
    longest = float(group.lengths[0])
    asks = (floors > 0) & (lengths > 0)
    local = np.where(asks, floors / np.maximum(lengths * longest, 1e-300), -1.0)
    out = []
    rank_first = first[group.order]

    def keep(rows: np.ndarray, columns: np.ndarray | slice, scores: np.ndarray) -> None:
        columns = np.arange(scores.shape[1]) if isinstance(columns, slice) else columns
        n = scores.shape[1]
        low = np.full(len(rows), np.iinfo(np.int64).min) if n <= k else np.partition(scores, n - k, axis=1)[:, n - k]
        low = np.maximum(low, np.where(np.isfinite(floors[rows]), floors[rows], -float(_LONG)).astype(np.int64))
        a, b = np.nonzero(scores >= low[:, None])
        score = scores[a, b]
        order = np.lexsort((rank_first[columns[b]], -score, a))
        a, b, score = a[order], b[order], score[order]
        few = np.arange(len(a)) - np.searchsorted(a, a) < k
        out.append((rows[a[few]], group.order[columns[b[few]]], score[few]))

    def counted(kind: str, n: int) -> None:
        if tally is not None:
            tally[kind] = tally.get(kind, 0) + n

    reach = np.where(asks, group.by_length(np.where(asks, floors / np.maximum(lengths, 1e-300), 0.0) * (1 - 1e-12)), len(group.lengths))
    reach[local > 1 + 1e-9] = 0
    steep = np.flatnonzero((local > 0) & (reach > 0))
    if len(steep):
        at, begin, end = group.spans(queries[steep] / lengths[steep, None], np.minimum(1.0, local[steep]) - 1e-9, focus)
        # A look-up costs as much as a few products; products of gathered vectors cost four times those of a block.
        inside = (end - begin).min(axis=1)
        cheaper = inside * (focus + 4 * queries.shape[1]) + 2_000 < reach[steep] * queries.shape[1]
        for r, a, b, e in zip(steep[cheaper].tolist(), at[cheaper], begin[cheaper], end[cheaper]):
            columns = group.feasible(a, b, e)
            columns = columns[columns < reach[r]]
            counted("coordinate", len(columns))
            if len(columns):
                keep(np.array([r]), columns, products(queries[r : r + 1], group.vectors[columns]))
        reach[steep[cheaper]] = 0
    # The others in order of how many vectors their lengths leave, so that a block shares one cut.
    wide = np.flatnonzero(reach)
    wide = wide[np.argsort(reach[wide], kind="stable")]
    step = max(1, 2_000_000 // len(group.lengths))
    for lo in range(0, len(wide), step):
        rows = wide[lo : lo + step]
        n = int(reach[rows[-1]])
        counted("length", n * len(rows))
        keep(rows, slice(0, n), products(queries[rows], group.vectors[:n]))
    parts = list(zip(*out)) if out else [[np.zeros(0, np.int64)]] * 3
    return tuple(np.concatenate(p) for p in parts)


def search(embeddings: DataFrame, every: int = 20, k: int = 20, group: int = 8_192, block: int = 4_096, ratio: float = 0.95, opening: int = 1_024) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of each row whose vec_id ``every`` divides.

    See ``vectors.usable`` for rows without part; zero vectors take part. Ties go to the smaller vec_id; a
    vec_id that repeats takes part with each of its rows, but is no candidate of a query of its own number.
    Vectors of different lengths never meet. Scores beyond a long are its limits. ``ratio``: of the shortest to the
    longest vector of a group; ``opening``: at least so many of the longest vectors, if there are, give the first scores.
    """
    rows = usable(embeddings, nonzero=False)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + F.pow(F.floor(F.lit(64.0) * x.cast("double")).cast("double"), F.lit(2.0)))
    index = written(classes(rows, k + 1).withColumn("dim", F.size("embedding")).withColumn("length", F.sqrt(total)), "mips-classes")
    longest = index.groupBy("dim").agg(F.max("length").alias("top"))  # one row a length of vectors
    # A group's number follows from the length alone; those of length under a 10^9th of the longest share the last.
    last = int(np.ceil(np.log(1e9) / -np.log(ratio)))
    steps = F.floor(F.log(F.col("top") / F.greatest(F.col("length"), F.col("top") * 1e-9)) / float(-np.log(ratio)))
    number = F.when(F.col("length") > 0, F.least(F.lit(last), steps)).otherwise(F.lit(last)).cast("int")
    grouped = index.join(F.broadcast(longest), "dim").withColumn("g", number)
    # Some 400 rows a length of vectors. Equal lengths share a group however many they are, so a hash cuts it into parts.
    sizes = grouped.groupBy("dim", "g").agg(F.count("*").alias("n"), F.ceil(F.count("*") / group).cast("int").alias("m"), F.max("length").alias("longest"))
    before = F.sum("n").over(Window.partitionBy("dim").orderBy("g").rowsBetween(Window.unboundedPreceding, -1))
    sizes = written(sizes.withColumn("opens", F.coalesce(before, F.lit(0)) < opening).drop("n"), "mips-groups")
    placed = grouped.join(F.broadcast(sizes), ["dim", "g"]).withColumn("i", F.pmod(F.xxhash64("c1", F.lit(2)), "m").cast("int"))
    placed = placed.select("dim", "g", "i", (F.col("opens") & (F.col("i") == 0)).alias("opens"), "c1", "c2", "first", "embedding")

    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "c1", "c2")
    asked = index.join(queries.select("c1", "c2").distinct(), ["c1", "c2"], "left_semi")
    asked = written(asked.select(F.col("c1").alias("q1"), F.col("c2").alias("q2"), "dim", "length", "embedding"), "mips-queries")
    out = pa.schema([("q1", pa.int64()), ("q2", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("first", pa.int64()), ("score", pa.int64())])

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return out.empty_table()
        first = left["first"].to_numpy()
        q, x, score = group_top(Group(quantised(matrix(left["embedding"]))), quantised(matrix(right["embedding"])), right["floor"].to_numpy().astype(np.float64), first, k + 1)
        q, x = pa.array(q), pa.array(x)
        return pa.table([right["q1"].take(q), right["q2"].take(q), left["c1"].take(x), left["c2"].take(x), left["first"].take(x), pa.array(score)], schema=out)

    def blocks(asked_: DataFrame) -> DataFrame:
        """q1, q2, dim, floor, need (the length that the floor asks of a vector), embedding, r, j: queries of like need in blocks."""
        need = F.when((F.col("floor") > 0) & (F.col("length") > 0), F.col("floor") / F.col("length") * (1 - 1e-9)).otherwise(F.lit(0.0))
        rated = asked_.withColumn("need", need).join(F.broadcast(longest), "dim")
        rated = written(rated.withColumn("r", F.floor(F.least(F.lit(1.0), F.col("need") / F.greatest("top", F.lit(1e-300))) * 64).cast("int")).drop("top", "length"), "mips-asked")
        cuts = rated.groupBy("dim", "r").agg(F.ceil(F.count("*") / block).cast("int").alias("cuts"))  # at most 65 rows a length of vectors
        return rated.join(F.broadcast(cuts), ["dim", "r"]).withColumn("j", F.pmod(F.xxhash64("q1", F.lit(1)), "cuts").cast("int")).drop("cuts")

    def meet(parts: DataFrame, asked_: DataFrame) -> DataFrame:
        """Parts and blocks whose bounds allow a result: the pairs are chosen before any vector is copied."""
        held = blocks(asked_)
        least = held.groupBy("dim", "r", "j").agg(F.min("need").alias("need"))
        found_ = parts.select("dim", "g", "i").distinct().join(F.broadcast(sizes.select("dim", "g", "longest")), ["dim", "g"])
        pairs = small(written(found_.join(least, "dim").where(F.col("longest") >= F.col("need")).select("dim", "g", "i", "r", "j"), "mips-pairs"))
        keys = ["dim", "g", "i", "r", "j"]
        left = parts.drop("opens").join(pairs, ["dim", "g", "i"]).groupBy(*keys)
        right = held.select("dim", "r", "j", "q1", "q2", "embedding", "floor").join(pairs, ["dim", "r", "j"]).groupBy(*keys)
        return left.cogroup(right).applyInArrow(verify, "q1 long, q2 long, c1 long, c2 long, first long, score long")

    first_ = written(meet(placed.where("opens"), asked.withColumn("floor", F.lit(float("-inf")))), "mips-opening")
    # The k-th other result scores at least what the (k + 1)-th class of the opening does.
    floor = best(first_, ["q1", "q2"], k + 1, F.desc("score"), F.col("first")).groupBy("q1", "q2").agg(F.when(F.count("*") > k, F.min("score")).cast("double").alias("floor"))
    later = asked.join(floor, ["q1", "q2"], "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    tops = best(first_.union(meet(placed.where("not opens"), later)), ["q1", "q2"], k + 1, F.desc("score"), F.col("first")).drop("rank")
    return expand(tops, queries, index, k)


def op4_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty highest products of every twentieth row; see ``search`` for its cases."""
    return search(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

"""Operator 11: a manifest of a dataset as Merkle trees, one for each source under one root, with a proof for each row.

Nodes of a tree are numbered by a range partitioning. Blocks of a power of three of consecutive nodes are one array each, which
higher-order SQL functions collapse level by level; the roots of the blocks are the nodes of the next round, until a tree
has one block. Then the paths of the upper blocks are handed down to the blocks below. So a source with a third of all
rows is as many blocks as its rows ask for, and a task holds a block at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.llm.common import removed, table, written

FANOUT = 3
#: Levels that one block collapses: 729 nodes.
LEVELS = 6


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one behind the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its UTF-8 byte count before it, so that no two rows read alike; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, changed: the digest of each row, and that of the row as tampered with, null where nobody tampered.

    Tampering deletes line feeds from the text where the CRC-32 of the decimal doc_id is even; a null doc_id has no such number.
    """
    of = lambda text: digest(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text))
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return docs.select("doc_id", "source", of(F.col("text")).alias("leaf"), F.when(hit, of(F.replace("text", F.lit("\n"), F.lit("")))).alias("changed"))


def ranked(nodes: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``nodes`` with ``rank``, from 0 in its tree by ``order``, and ``n``, the number of nodes of the tree.

    A range partitioning splits a large tree over tasks; how many nodes of a tree the partitions before hold is summed over a
    row for each tree and partition.
    """
    placed = written(nodes.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("at", 33).alias("part")
    runs = placed.groupBy(tree, part).agg(F.min("at").alias("first"), F.count("*").alias("n_here"))
    before = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col(tree).alias("tree_"), F.col("part").alias("part_"), "first", F.coalesce(F.sum("n_here").over(before), F.lit(0)).alias("base"), F.sum("n_here").over(Window.partitionBy(tree)).alias("n"))
    met = placed.withColumn("part", part).join(runs, (F.col("part") == F.col("part_")) & F.col(tree).eqNullSafe(F.col("tree_")))
    return met.select(*nodes.columns, (F.col("base") + F.col("at") - F.col("first")).alias("rank"), "n")


def _collapsed(nodes: Column, levels: Column) -> Column:
    """The levels of a block from its nodes up, the last of one node: an array of arrays."""

    def runs(level: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(level), F.lit(FANOUT))
        return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(level, i, F.lit(FANOUT)), ""), 256))

    rounds = F.slice(F.sequence(F.lit(1), F.lit(64)), F.lit(1), levels)  # slice, as a sequence from 1 to 0 counts down
    return F.aggregate(rounds, F.array(nodes), lambda done, _: F.concat(done, F.array(runs(F.element_at(done, -1)))))


def _path(collapsed: Column, at: Column, levels: Column) -> Column:
    """Siblings of node ``at`` (from 0) on its way up through a block: for each level those before it and those behind it."""
    powers = F.array(*[F.lit(FANOUT**k) for k in range(LEVELS)])
    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(LEVELS - 1)), F.lit(1), levels), lambda k: T.let(
        F.struct(F.get(collapsed, k).alias("level"), F.floor(at / F.get(powers, k)).cast("int").alias("node")), lambda x: F.struct(
            F.array_join(F.slice(x.level, x.node - x.node % FANOUT + 1, x.node % FANOUT), "").alias("before"),
            F.array_join(F.slice(x.level, x.node + 2, FANOUT - 1 - x.node % FANOUT), "").alias("after"))))


def _blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """tree, block, n, levels, items, collapsed: blocks of nodes (tree, rank, n, node and ``payload``)."""
    size = FANOUT**LEVELS
    items = F.array_sort(F.collect_list(F.struct("rank", "node", *payload)))
    blocks = nodes.groupBy("tree", F.floor(F.col("rank") / size).alias("block")).agg(F.first("n").alias("n"), items.alias("items"))
    grown = F.greatest(*[F.when(F.col("n") > FANOUT**k, k + 1).otherwise(0) for k in range(LEVELS)])
    return blocks.withColumn("levels", grown).withColumn("collapsed", _collapsed(F.transform("items", lambda x: x.node), F.col("levels")))


def prove(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """tree, node, ``payload``, top (the tree's root) and path for each of ``nodes`` (tree, rank, n, node and ``payload``).

    While a tree has several nodes, every three consecutive ones, at the end fewer, become the digest of their hex texts. A
    path lists the siblings, level by level up to the root, as structs of what stands before and behind; the root of a single
    node is itself, with an empty path. ``node`` is a hex digest, ``rank`` runs from 0 to n - 1.
    """
    blocks = written(_blocks(nodes, payload), "merkle-blocks")
    root = F.element_at(F.element_at("collapsed", -1), 1)
    above = blocks.select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / FANOUT**LEVELS).alias("n"), root.alias("node"))
    if above.where("n > 1").isEmpty():
        upper = above.select("tree", F.col("rank").alias("block"), F.col("node").alias("top"), F.expr("cast(array() as array<struct<before:string,after:string>>)").alias("upper"))
    else:
        upper = prove(above.withColumn("block", F.col("rank")), ["block"]).select("tree", "block", "top", F.col("path").alias("upper"))
    upper = upper.select(F.col("tree").alias("tree_"), F.col("block").alias("block_"), "top", "upper")
    met = blocks.join(upper, (F.col("block") == F.col("block_")) & F.col("tree").eqNullSafe(F.col("tree_")))
    rows = met.select("tree", "top", "upper", "levels", "collapsed", F.posexplode("items").alias("at", "item"))
    path = F.concat(_path(F.col("collapsed"), F.col("at"), F.col("levels")), F.col("upper"))
    return rows.select("tree", F.col("item.node").alias("node"), *[F.col(f"item.{c}").alias(c) for c in payload], "top", path.alias("path"))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.before, s.after)), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s.before, node, s.after))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs`` (doc_id, source, lang, n_chars, text).

    Leaves of a source, null being one too, ascend by doc_id (null first, ties by leaf), and sources by their UTF-8 bytes, null first. folded_root
    comes from the leaf of the tampered row (``leaves``) and the true siblings. Repeated rows are leaves each; other columns are left
    behind; an empty table has no rows.
    """
    own = written(leaves(docs), "merkle-leaves")
    known = ranked(own, "source", ["doc_id", "leaf"]).select(F.col("source").alias("tree"), "rank", "n", F.col("leaf").alias("node"), "doc_id", "changed")
    proved = written(prove(known, ["doc_id", "changed"]).withColumnsRenamed({"tree": "source", "top": "subroot"}), "merkle-proofs")
    removed(own)
    subroots = written(proved.groupBy("source").agg(F.first("subroot").alias("node")).withColumn("all", F.lit(0)), "merkle-subroots")
    sources = prove(ranked(subroots, "all", ["source"]).withColumnRenamed("all", "tree"), ["source"])
    sources = written(sources.select(F.col("source").alias("source_"), F.col("top").alias("root"), F.col("path").alias("upper")), "merkle-sources")
    met = proved.join(sources, F.col("source").eqNullSafe(F.col("source_"))).withColumn("whole", F.concat("path", "upper"))
    found = met.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof_digest(F.col("whole")).alias("proof_sha256"), folded(F.coalesce("changed", "node"), F.col("whole")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all ``documents``."""
    return manifest(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text, 
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda acc, b:
      list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))) AS crc
  FROM documents
), leaf AS (
  SELECT *, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, replace(text, chr(10), '') AS cut FROM fields
), placed AS (
  SELECT doc_id, source, leaf, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS rank,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || coalesce(octet_length(encode(cut)) || ':' || cut, '-')) ELSE leaf END AS shown
  FROM leaf
), trees AS (
  SELECT source, 0 AS level, list(leaf ORDER BY rank) AS nodes FROM placed GROUP BY source
  UNION ALL
  SELECT source, level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1 : i + 3], ''))) FROM trees WHERE len(nodes) > 1
), subroots AS (
  SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank FROM trees WHERE len(nodes) = 1
), top AS (
  SELECT 0 AS level, list(subroot ORDER BY rank) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1 : i + 3], ''))) FROM top WHERE len(nodes) > 1
), steps AS (
  SELECT p.doc_id, t.level, t.nodes, p.rank // CAST(pow(3, t.level) AS BIGINT) AS place FROM placed p JOIN trees t ON p.source IS NOT DISTINCT FROM t.source WHERE len(t.nodes) > 1
  UNION ALL
  SELECT p.doc_id, 1000 + t.level, t.nodes, s.rank // CAST(pow(3, t.level) AS BIGINT) FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source CROSS JOIN top t WHERE len(t.nodes) > 1
), sides AS (
  SELECT doc_id, array_to_string(nodes[place - place % 3 + 1 : place], '') AS before, array_to_string(nodes[place + 2 : place - place % 3 + 3], '') AS after,
    row_number() OVER (PARTITION BY doc_id ORDER BY level) AS step
  FROM steps
), folds AS (
  SELECT doc_id, 0 AS step, shown AS node FROM placed
  UNION ALL
  SELECT f.doc_id, s.step, sha256(s.before || f.node || s.after) FROM folds f JOIN sides s ON s.doc_id = f.doc_id AND s.step = f.step + 1
), ends AS (
  SELECT doc_id, arg_max(node, step) AS folded_root FROM folds GROUP BY doc_id
), proofs AS (
  SELECT doc_id, string_agg(before || after, '' ORDER BY step) AS siblings FROM sides GROUP BY doc_id
)
SELECT p.doc_id, p.leaf, s.subroot, r.nodes[1] AS root, sha256(coalesce(q.siblings, '')) AS proof_sha256, e.folded_root, e.folded_root = r.nodes[1] AS verified
FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source JOIN top r ON len(r.nodes) = 1 JOIN ends e ON e.doc_id = p.doc_id LEFT JOIN proofs q ON q.doc_id = p.doc_id
"""

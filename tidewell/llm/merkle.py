"""Merkle manifest of a dataset: leaves, subroots by language, one root, and a proof for every row.

Every row is a leaf. The leaves of a language lie in fixed-size ordered arrays, whose
levels collapse with sequence, transform, slice and aggregate; the roots of these blocks
are the leaves of the next, smaller table, until a language has one block. Its root is
the subroot, and the subroots are the leaves of the same kind of tree. Then the paths
come down again, block by block, to the leaves. No array holds more than BLOCK nodes.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, mark, release, table

#: Nodes that one parent joins.
FAN = 8
#: Levels that a block collapses, and the nodes it holds.
DEPTH = 3
BLOCK = FAN**DEPTH
#: Values by which equal rows are spread over tasks.
SALT = 4096
STEP = "struct<before:string,after:string>"


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    """Byte count, colon and value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """tree ('' for a null language, else '=' and the language), doc_id, leaf and the leaf of the tampered row, null where there is none."""
    row = lambda text: _digest(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _field(text))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, row(lowered))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    return docs.select(tree.alias("tree"), "doc_id", row(F.col("text")).alias("leaf"), tampered.alias("tampered"))


def numbered(nodes: DataFrame, tree: str, *order: str) -> DataFrame:
    """nodes with pos (0, 1, ... within each tree in the given order) and total (nodes of the tree).

    nodes is a written table. Rows are dealt out by ranges, so a tree of any share of the
    rows is spread evenly; rows that are equal in all order columns are spread by a salt.
    """
    keys = [tree, *order, "_salt"]
    salted = nodes.withColumn("_salt", F.monotonically_increasing_id() % SALT)
    placed = cut(salted.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).drop("_salt"))
    part = F.shiftrightunsigned("_at", 33)
    runs = placed.groupBy(tree, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(tree, "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(Window.partitionBy(tree)).alias("total"))
    joined = placed.withColumn("_part", part).join(runs, [tree, "_part"])
    return joined.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """Arrays of at most BLOCK consecutive nodes: tree, block, total, nodes (structs of node and more columns) and levels, the arrays of digests bottom up."""
    held = F.struct((F.col("pos") % BLOCK).alias("at"), "node", *more)
    blocks = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(held)).alias("nodes"))
    # A tree of several blocks has them all collapsed; a tree of one only until one node remains.
    steps = sum((F.col("total") > FAN**k).cast("int") for k in range(DEPTH))
    parents = lambda level: F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(level) / FAN).cast("int") - 1), lambda run: F.sha2(F.array_join(F.slice(level, run * FAN + 1, F.lit(FAN)), ""), 256)
    )
    bottom = F.array(F.transform("nodes", lambda x: x["node"]))
    rise = F.slice(F.array(*[F.lit(k) for k in range(DEPTH)]), F.lit(1), steps)
    return blocks.withColumn("levels", F.aggregate(rise, bottom, lambda found, _: F.concat(found, F.array(parents(F.element_at(found, -1))))))


def _steps_up(at: Column, levels: Column) -> Column:
    """The siblings before and after a node on each level of its block, bottom up."""

    def step(level: Column, k: Column) -> Column:
        size = F.pow(F.lit(FAN), k).cast("int")
        own = F.floor(at / size).cast("int")
        run = F.slice(level, own - own % FAN + 1, F.lit(FAN))
        return F.struct(F.array_join(F.slice(run, F.lit(1), own % FAN), "").alias("before"), F.array_join(F.slice(run, own % FAN + 2, F.lit(FAN)), "").alias("after"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)


def _rise(nodes: DataFrame, *more: str) -> list[DataFrame]:
    """Written tables of blocks, from those of the nodes (tree, pos, total, node) up to one block for each tree."""
    found = []
    while True:
        found.append(cut(_blocks(nodes, *more)))
        nodes = found[-1].where(F.col("total") > BLOCK).select("tree", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"), F.element_at(F.element_at("levels", -1), 1).alias("node"))
        more = ()
        if not nodes.head(1):
            return found


def _tops(tables: list[DataFrame], name: str) -> DataFrame:
    """tree and the last node of each tree, under the given name."""
    tops = [t.where(F.col("total") <= BLOCK).select("tree", F.element_at(F.element_at("levels", -1), 1).alias(name)) for t in tables]
    return functools.reduce(DataFrame.unionByName, tops)


def _descend(tables: list[DataFrame], above: DataFrame, each: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows of each(node, path) for the nodes of the lowest table, as a column `row` beside what comes down.

    above: tree, path (of its top node) and more columns, which come down as they are.
    Each table's blocks take the path of their root from the table above or, where a
    tree has one block, from `above`.
    """
    more = [c for c in above.columns if c not in ("tree", "path")]
    path = lambda x: F.concat(_steps_up(x["at"], F.col("levels")), F.col("path"))
    paths, blocks = None, None
    for held in reversed(tables):
        blocks = held.where(F.col("total") <= BLOCK).join(above, "tree")
        if paths is not None:
            blocks = blocks.unionByName(held.where(F.col("total") > BLOCK).join(paths, ["tree", "block"]))
        if held is not tables[0]:
            up = blocks.select("tree", "block", *more, F.explode(F.transform("nodes", lambda x: F.struct(x["at"].alias("at"), path(x).alias("path")))).alias("x"))
            paths = cut(up.select("tree", (F.col("block") * BLOCK + F.col("x.at")).alias("block"), F.col("x.path").alias("path"), *more))
    return blocks.select(*more, F.explode(F.transform("nodes", lambda x: each(x, path(x)))).alias("row"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    docs needs doc_id, source, lang, n_chars and text; any may be null, which hashes unlike
    every value. A null language is a tree of its own and the first one. Rows of one doc_id
    come in the order of their leaves, null doc_ids first; equal rows are leaves each, with
    proofs of their own places, dealt out arbitrarily. Rows with a null doc_id are not
    tampered with, nor does tampering change a text without A-Z. A single leaf is its
    subroot, and a single subroot the root; its proof is the digest of nothing. An empty
    table gives an empty result.
    """
    since = mark()
    nodes = numbered(cut(leaves(docs)), "tree", "doc_id", "leaf").select("tree", "pos", "total", "doc_id", F.col("leaf").alias("node"), "tampered")
    tables = _rise(nodes, "doc_id", "tampered")
    subroots = cut(_tops(tables, "node").select(F.lit("").alias("all"), F.col("tree").alias("name"), "node"))
    forest = _rise(numbered(subroots, "all", "name").select(F.col("all").alias("tree"), "pos", "total", "node", "name"), "name")
    start = _tops(forest, "root").withColumn("path", F.array().cast(f"array<{STEP}>"))
    above = _descend(forest, start, lambda x, path: F.struct(x["name"].alias("tree"), path.alias("path"), x["node"].alias("subroot")))
    above = cut(above.select("row.*", "root"))

    def proven(x: Column, path: Column) -> Column:
        siblings = F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")
        folded = F.aggregate(path, F.coalesce(x["tampered"], x["node"]), lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))
        return F.struct(x["doc_id"].alias("doc_id"), x["node"].alias("leaf"), F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))

    rows = cut(_descend(tables, above, proven).select("row.*", "subroot", "root"))
    release(docs.sparkSession, since, keep=1)
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


#: Trees and paths row by row: recursive levels of eight, and each path folded step by step.
OP13_SQL = r"""
WITH RECURSIVE field AS (
  SELECT *, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS body,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    4294967295 - list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda acc, b: CASE WHEN b >= 0 THEN xor(acc, b) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END) AS crc
  FROM documents),
leaf AS (
  SELECT *, row_number() OVER (ORDER BY doc_id) AS rid, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, sha256(head || body) AS leaf, CASE WHEN crc % 3 = 0 THEN sha256(head || CASE WHEN low IS NULL THEN '-' ELSE strlen(low) || ':' || low END) END AS other FROM field)),
up AS (
  SELECT lang, 0 AS lv, pos, leaf AS node, n FROM leaf
  UNION ALL SELECT lang, any_value(lv) + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM up WHERE n > 1 GROUP BY lang, pos // 8),
sub AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lv, pos, subroot AS node, n FROM sub
  UNION ALL SELECT any_value(lv) + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY pos // 8),
step AS (
  SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY k) - 1 AS k, coalesce(before, '') AS before, coalesce(after, '') AS after FROM (
    SELECT l.rid, u.lv AS k, string_agg(u.node, '' ORDER BY u.pos) FILTER (u.pos < l.pos >> (3 * u.lv)) AS before, string_agg(u.node, '' ORDER BY u.pos) FILTER (u.pos > l.pos >> (3 * u.lv)) AS after
    FROM leaf l JOIN up u ON l.lang IS NOT DISTINCT FROM u.lang AND u.n > 1 AND u.pos >> 3 = l.pos >> (3 * u.lv + 3) GROUP BY l.rid, u.lv
    UNION ALL
    SELECT l.rid, 1000 + t.lv, string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < s.pos >> (3 * t.lv)), string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > s.pos >> (3 * t.lv))
    FROM leaf l JOIN sub s ON l.lang IS NOT DISTINCT FROM s.lang JOIN top t ON t.n > 1 AND t.pos >> 3 = s.pos >> (3 * t.lv + 3) GROUP BY l.rid, t.lv)),
fold AS (
  SELECT rid, 0 AS k, coalesce(other, leaf) AS node FROM leaf
  UNION ALL SELECT f.rid, f.k + 1, sha256(s.before || f.node || s.after) FROM fold f JOIN step s ON s.rid = f.rid AND s.k = f.k),
folded AS (SELECT rid, arg_max(node, k) AS folded_root FROM fold GROUP BY rid),
proof AS (SELECT rid, string_agg(before || after, '' ORDER BY k) AS siblings FROM step GROUP BY rid)
SELECT l.doc_id, l.leaf, s.subroot, r.node AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.folded_root, f.folded_root = r.node AS verified
FROM leaf l JOIN sub s ON l.lang IS NOT DISTINCT FROM s.lang JOIN (SELECT node FROM top WHERE n = 1) r ON true JOIN folded f USING (rid) LEFT JOIN proof p USING (rid)
"""

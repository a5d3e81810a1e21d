"""Property graphs as node and edge tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, mark, release

c = F.col


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected use: every edge in both directions, once."""
    return edges.select("src", "dst").union(edges.select(c("dst").alias("src"), c("src").alias("dst"))).distinct()


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent upsert: keys once, new rows only where no old one has the key."""
    return old.dropDuplicates(keys).unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def related(nodes: DataFrame, rivals: DataFrame, supplies: DataFrame, sectors: DataFrame) -> DataFrame:
    """node, other, relation: rivals both ways, suppliers, customers and peers of the sector."""
    peers = sectors.alias("a").join(sectors.alias("b"), "sector").where("a.node <> b.node").select(c("a.node").alias("node"), c("b.node").alias("other"))
    parts = {
        "rival": both_ways(rivals).select(c("src").alias("node"), c("dst").alias("other")), "supplier": supplies.select(c("dst").alias("node"), c("src").alias("other")),
        "customer": supplies.select(c("src").alias("node"), c("dst").alias("other")), "peer": peers,
    }
    all_ = None
    for relation, part in parts.items():
        one = part.withColumn("relation", F.lit(relation))
        all_ = one if all_ is None else all_.unionByName(one)
    return all_.join(nodes.select("node"), "node", "left_semi").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes in edges (a, b): component is the smallest reachable node.

    Alternating large and small stars; every round is a few shuffles and a written
    table, and the number of rounds grows with the logarithm of the longest path.
    """
    since = mark()
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    before = state(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", "m")).where("a > b").distinct()
        after = cut(small)
        now = state(after)
        if now == before:
            break
        release(edges.sparkSession, since, keep=1)
        edges, before = after, now
    pairs = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return pairs.union(edges.select("b", "b").distinct()).groupBy("node").agg(F.min("component").alias("component"))


def shortest_paths(edges: DataFrame, starts: DataFrame, most: int = 4) -> DataFrame:
    """node, target, hops and path (nodes in order) of shortest directed paths of 1 to `most` hops.

    Breadth first, one join a hop. Of the paths that reach a target with equal hops only
    the smallest goes on, so a frontier holds a row for each start and target. The edges
    and what each hop finds are written, so a hop's plan does not repeat those before it.
    """
    edges = cut(edges.select(c("src").alias("target"), "dst"))
    found = [cut(starts.select("node", c("node").alias("target"), F.array("node").alias("path"), F.lit(0).alias("hops")))]
    for hops in range(1, most + 1):
        step = found[-1].join(edges, "target").select("node", c("dst").alias("target"), F.concat("path", F.array("dst")).alias("path"))
        seen = functools.reduce(DataFrame.union, [f.select("node", "target") for f in found])
        fresh = step.join(seen, ["node", "target"], "left_anti").groupBy("node", "target").agg(F.min("path").alias("path"))
        found.append(cut(fresh.withColumn("hops", F.lit(hops))))
    return functools.reduce(DataFrame.unionByName, found[1:]).select("node", "target", "path", "hops")

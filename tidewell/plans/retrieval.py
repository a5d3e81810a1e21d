"""VS, GR, TX30: vector and graph retrieval; JON15."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.catalog import query
from tidewell.operators import graph as G
from tidewell.operators import vectors as V
from tidewell.sources.views import EDGES, edges, table

c = F.col
SIM = "list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) + 1e-12)"


def _search_sql(k: int, where: str = "true") -> str:
    return f"WITH s AS (SELECT q.vec_id AS query, a.vec_id, {SIM} AS sim FROM embeddings a, embeddings q WHERE q.vec_id % 100 = 0 AND {where}), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, vec_id)::INT AS place FROM s) SELECT query, vec_id, round(sim, 6) AS sim, place FROM r WHERE place <= {k}"


def _queries(spark, d):
    """The stated query set: every vector whose id is divisible by 100."""
    return table(spark, d, "embeddings").where("vec_id % 100 = 0")


def _searched(spark, d, k, where=None):
    return V.search(table(spark, d, "embeddings"), _queries(spark, d), k, where=where).select("query", "vec_id", F.round("sim", 6).alias("sim"), "place")


@query("vs01_top_k", _search_sql(8))
def vs01(spark, d):
    return _searched(spark, d, 8)


@query("tk06_cosine_top_k", _search_sql(3))
def tk06(spark, d):
    return _searched(spark, d, 3)


@query("vs02_filtered_search", _search_sql(5, "a.label IN (1, 2, 3) AND a.vec_id % 7 <> 0"))
def vs02(spark, d):
    return _searched(spark, d, 5, c("label").isin(1, 2, 3) & (c("vec_id") % 7 != 0))


@query("vs03_company_search", _search_sql(5, "a.label = 4"))
def vs03(spark, d):
    return _searched(spark, d, 5, c("label") == 4)


@query("vs03_company_list", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def vs03b(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query("vs04_visible_search", _search_sql(4, "(a.label = 0 OR a.label = 5)"))
def vs04(spark, d):
    owner = F.when(c("label") != 0, c("label"))
    return _searched(spark, d, 4, owner.isNull() | (owner == 5))


@query("vs05_delete_by_source", "SELECT vec_id FROM embeddings WHERE label NOT IN (2, 3)")
def vs05(spark, d):
    gone = spark.createDataFrame([(2,), (3,)], "label int")
    return table(spark, d, "embeddings").join(F.broadcast(gone), "label", "left_anti").select("vec_id")


@query("vs07_language_search", _search_sql(4, "a.label % 2 = 1"))
def vs07(spark, d):
    return _searched(spark, d, 4, c("label") % 2 == 1)


@query("tx30_max_cosine", f"WITH s AS (SELECT q.vec_id AS query, a.label, {SIM} AS sim FROM embeddings a, embeddings q WHERE q.vec_id % 100 = 0) SELECT query, label, round(max(sim), 6) AS best FROM s GROUP BY 1, 2")
def tx30(spark, d):
    return V.best_by(table(spark, d, "embeddings"), _queries(spark, d), "label").select("query", "label", F.round("sim", 6).alias("best"))


@query("vs06_graph_context", f"WITH {EDGES}, h AS ({_search_sql(3)}), n AS (SELECT DISTINCT query, label AS node FROM h JOIN embeddings USING (vec_id)), t AS (SELECT DISTINCT query, node || ' supplies ' || dst AS line FROM n JOIN edges ON src = node) SELECT query, string_agg(line, '; ' ORDER BY line) AS context FROM t GROUP BY 1")
def vs06(spark, d):
    """Hits' groups as nodes, and what those supply: context lines by query."""
    hits = _searched(spark, d, 3).join(table(spark, d, "embeddings").select("vec_id", c("label").alias("node")), "vec_id")
    near = hits.select("query", "node").distinct().join(edges(spark, d).select(c("src").alias("node"), "dst"), "node")
    line = F.format_string("%d supplies %d", "node", "dst")
    return near.groupBy("query").agg(F.array_join(F.array_sort(F.collect_set(line)), "; ").alias("context"))


@query("gr01_merge", f"WITH {EDGES} SELECT src, dst, weight FROM edges UNION ALL SELECT src, 99, 0 FROM (SELECT DISTINCT src FROM edges)")
def gr01(spark, d):
    e = edges(spark, d)
    new = e.select("src", F.lit(99).alias("dst"), F.lit(0).cast("long").alias("weight")).unionByName(e.withColumn("weight", F.lit(-1).cast("long")))
    return G.merge(e.unionByName(e), new, ["src", "dst"])


_REL = f"""{EDGES}, riv AS (SELECT n_nationkey AS src, (n_nationkey + 1) % 25 AS dst FROM nation),
rel AS (SELECT src AS node, dst AS other, 'rival' AS relation FROM riv UNION SELECT dst, src, 'rival' FROM riv UNION SELECT dst, src, 'supplier' FROM edges UNION SELECT src, dst, 'customer' FROM edges
  UNION SELECT a.n_nationkey, b.n_nationkey, 'peer' FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)"""


def _related(spark, d):
    n = table(spark, d, "nation")
    nodes = n.select(c("n_nationkey").alias("node"))
    rivals = n.select(c("n_nationkey").alias("src"), ((c("n_nationkey") + 1) % 25).alias("dst"))
    return G.related(nodes, rivals, edges(spark, d), n.select(c("n_nationkey").alias("node"), c("n_regionkey").alias("sector")))


@query("gr02_related", f"WITH {_REL} SELECT * FROM rel")
def gr02(spark, d):
    return _related(spark, d)


@query("jon15_graph_patterns", f"WITH {_REL} SELECT relation, count(*) AS n FROM rel GROUP BY 1")
def jon15(spark, d):
    return _related(spark, d).groupBy("relation").agg(F.count("*").alias("n"))


@query("gr03_sector_search", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(r_name, 'A') ORDER BY n_name")
def gr03(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region").where(c("r_name").contains("A"))
    return n.join(r, c("n_regionkey") == c("r_regionkey")).select("n_name", "r_name").orderBy("n_name")


def _layers(most: int, edges_: str) -> str:
    """Breadth first in SQL: each layer's smallest paths to targets that no layer before reached."""
    text, seen = "l0 AS (SELECT n_nationkey AS node, n_nationkey AS target, [n_nationkey::BIGINT] AS path FROM nation)", "SELECT node, target FROM l0"
    for k in range(1, most + 1):
        text += f", l{k} AS (SELECT p.node, e.dst AS target, min(list_append(p.path, e.dst::BIGINT)) AS path FROM l{k - 1} p JOIN {edges_} e ON e.src = p.target WHERE NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.node = p.node AND s.target = e.dst) GROUP BY 1, 2)"
        seen += f" UNION ALL SELECT node, target FROM l{k}"
    return text


def _paths_sql(edges_: str) -> str:
    return f"{_layers(4, edges_)} " + " UNION ALL ".join(f"SELECT node, target, {k}::INT AS hops, array_to_string(path, '>') AS path FROM l{k}" for k in range(1, 5))


def _shortest(spark, d, e):
    found = G.shortest_paths(e, table(spark, d, "nation").select(c("n_nationkey").alias("node")))
    return found.select("node", "target", "hops", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("gr04_shortest_paths", f"WITH {EDGES}, {_paths_sql('edges')}")
def gr04(spark, d):
    return _shortest(spark, d, edges(spark, d))


@query("gr04_strong_paths", f"WITH {EDGES}, strong AS (SELECT src, dst FROM (SELECT *, avg(weight) OVER (PARTITION BY src) AS usual FROM edges) WHERE weight > 1.2 * usual), {_paths_sql('strong')}")
def gr04b(spark, d):
    """Paths along edges well above their source's mean weight, which take more hops."""
    e = edges(spark, d).withColumn("usual", F.avg("weight").over(Window.partitionBy("src"))).where(c("weight") > 1.2 * c("usual"))
    return _shortest(spark, d, e.select("src", "dst"))


@query("gr05_document_links", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20")
def gr05(spark, d):
    """The first 20 documents of each node."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, d, "documents").select("source", "doc_id", place.alias("place")).where("place <= 20").drop("place")

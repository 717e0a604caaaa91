"""Queries of traversal over the sparse trade graph, and of differences between states of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.catalog import query
from lattica.model import Graph
from lattica.operators import delta, traverse

from .graph import BASE, trade_graph
from .trade import table

LEVELS = f"""WITH RECURSIVE {BASE}, hops AS (SELECT source AS a, target AS b FROM sparse UNION SELECT target, source FROM sparse),
walk(id, depth) AS (SELECT '0', 0 UNION SELECT b, depth + 1 FROM walk JOIN hops ON a = id WHERE depth < {{most}})"""


@query("bfs_levels", LEVELS.format(most=6) + " SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY id")
def bfs_levels(spark, sf_dir):
    return traverse.bfs(trade_graph(spark, sf_dir, True), "0", 6).select("id", "depth")


@query("neighbors_depth2", LEVELS.format(most=2) + " SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM walk WHERE id <> '0' GROUP BY id")
def neighbors_depth2(spark, sf_dir):
    return traverse.neighbours(trade_graph(spark, sf_dir, True), "0", 2)


@query("neighbors_edge_filter", LEVELS.format(most=1) + " SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM walk WHERE id <> '0' GROUP BY id")
def neighbors_edge_filter(spark, sf_dir):
    return traverse.neighbours(trade_graph(spark, sf_dir, True), "0", 1, False, "trades")


@query("reachable_directed", f"WITH RECURSIVE {BASE}, walk(id) AS (SELECT '0' UNION SELECT target FROM walk JOIN sparse ON sparse.source = walk.id) SELECT id FROM walk")
def reachable_directed(spark, sf_dir):
    return traverse.reached(trade_graph(spark, sf_dir, True), ["0"], None, True).select("id")


@query("shortest_path_len", LEVELS.format(most=25) + " SELECT CAST(min(depth) AS BIGINT) AS steps FROM walk WHERE id = '24'")
def shortest_path_len(spark, sf_dir):
    out = traverse.shortest_path(trade_graph(spark, sf_dir, True), "0", "24")
    return out.agg(F.when(F.count("*") > 0, F.count("*") - 1).alias("steps"))


@query(
    "shortest_path_nodes",
    f"""WITH RECURSIVE {BASE}, hops AS (SELECT source AS a, target AS b, ord FROM sparse UNION ALL SELECT target, source, ord FROM sparse),
walk(id, n, path, route) AS (SELECT '0', 0, CAST([] AS BIGINT[]), ['0'] UNION ALL SELECT b, n + 1, list_append(path, ord), list_append(route, b) FROM walk JOIN hops ON a = id WHERE n < 3 AND id <> '24'),
best AS (SELECT route FROM walk WHERE id = '24' ORDER BY n, path LIMIT 1)
SELECT CAST(i - 1 AS INTEGER) AS step, route[i] AS id FROM best, (SELECT unnest(generate_series(1, 4)) AS i) g WHERE i <= len(route)""",
)
def shortest_path_nodes(spark, sf_dir):
    return traverse.shortest_path(trade_graph(spark, sf_dir, True), "0", "24")


@query("induced_subgraph", f"WITH {BASE} SELECT id, source, target, weight FROM edges WHERE CAST(source AS INTEGER) < 8 AND CAST(target AS INTEGER) < 8")
def induced_subgraph(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    return traverse.subgraph(g, g.nodes.filter(F.col("id").cast("int") < 8)).edges.select("id", "source", "target", "weight")


def orders_graph(spark, sf_dir, late: bool) -> Graph:
    """Customers as nodes and their orders of one half of the dates as edges."""
    o = table(spark, sf_dir, "orders").filter((F.year("o_orderdate") >= 1995) if late else (F.year("o_orderdate") <= 1995))
    n = o.groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.max("o_orderstatus").alias("label"), F.min("o_orderkey").alias("ord")).withColumn("type", F.lit("customer"))
    e = o.select(F.col("o_custkey").cast("string").alias("source"), F.col("o_orderpriority").alias("target"), F.col("o_orderkey").alias("ord"))
    return Graph(n, e)


HALVES = """o AS (SELECT CAST(o_custkey AS VARCHAR) AS id, max(o_orderstatus) AS label FROM orders WHERE year(o_orderdate) <= 1995 GROUP BY 1),
n AS (SELECT CAST(o_custkey AS VARCHAR) AS id, max(o_orderstatus) AS label FROM orders WHERE year(o_orderdate) >= 1995 GROUP BY 1)"""


@query("node_delta", f"WITH {HALVES} SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.label = n.label THEN 'unchanged' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.id = n.id")
def node_delta(spark, sf_dir):
    return delta.node_delta(orders_graph(spark, sf_dir, False).nodes, orders_graph(spark, sf_dir, True).nodes)


PAIRS = """o AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS source, o_orderpriority AS target FROM orders WHERE year(o_orderdate) <= 1995),
n AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS source, o_orderpriority AS target FROM orders WHERE year(o_orderdate) >= 1995)"""


@query("edge_delta", f"WITH {PAIRS} SELECT *, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) a UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n) b")
def edge_delta(spark, sf_dir):
    return delta.edge_delta(orders_graph(spark, sf_dir, False).edges, orders_graph(spark, sf_dir, True).edges)


@query(
    "delta_summary",
    f"""WITH {PAIRS}, {HALVES.replace("o AS", "a AS").replace("n AS", "b AS")}, e AS (SELECT 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) x UNION ALL SELECT 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n) x),
v AS (SELECT CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.label = b.label THEN 'unchanged' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.id = b.id)
SELECT 'edge' AS entity, change, count(*) AS n FROM e GROUP BY change UNION ALL SELECT 'node', change, count(*) FROM v GROUP BY change""",
)
def delta_summary(spark, sf_dir):
    a, b = orders_graph(spark, sf_dir, False), orders_graph(spark, sf_dir, True)
    return delta.delta_summary(delta.node_delta(a.nodes, b.nodes), delta.edge_delta(a.edges, b.edges))


def _communities(spark, sf_dir, late: bool):
    return orders_graph(spark, sf_dir, late).nodes.select("id", F.when(F.col("label") == "O", 1).when(F.col("label") == "P", 2).otherwise(3).alias("community"))


@query("community_drift", f"WITH {HALVES}, m(label, c) AS (VALUES ('O', 1), ('P', 2), ('F', 3)) SELECT o.id, a.c AS was, b.c AS now FROM o JOIN n ON o.id = n.id JOIN m a ON o.label = a.label JOIN m b ON n.label = b.label WHERE a.c <> b.c")
def community_drift(spark, sf_dir):
    return delta.drifted(_communities(spark, sf_dir, False), _communities(spark, sf_dir, True))


@query("drift_affected", f"WITH {HALVES} SELECT coalesce(o.id, n.id) AS id FROM o FULL JOIN n ON o.id = n.id WHERE o.label IS DISTINCT FROM n.label AND CAST(coalesce(o.id, n.id) AS BIGINT) % 2 = 0")
def drift_affected(spark, sf_dir):
    even = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("id"))
    return delta.drift_of(_communities(spark, sf_dir, False), _communities(spark, sf_dir, True), even)


@query("changed_files", "SELECT CAST(doc_id AS VARCHAR) AS file, substr(sha256(text), 1, 16) AS hash FROM documents WHERE lang <> 'en' OR doc_id % 2 = 1")
def changed_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    files = d.select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content"))
    known = d.filter((F.col("lang") == "en")).select(F.col("doc_id").cast("string").alias("file"), F.when(F.col("doc_id") % 2 == 0, F.substring(F.sha2("text", 256), 1, 16)).otherwise("old").alias("hash"))
    return delta.changed_files(known, files)


@query("incremental_merge", f"WITH {BASE} SELECT id, label FROM nodes WHERE community <> 1 UNION ALL SELECT id, 'new ' || label FROM nodes WHERE community = 1 AND CAST(id AS INTEGER) % 2 = 0")
def incremental_merge(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    old = Graph(g.nodes.withColumn("source_file", F.col("community").cast("string")), g.edges)
    new = Graph(old.nodes.filter("community = 1 AND CAST(id AS INT) % 2 = 0").withColumn("label", F.concat(F.lit("new "), "label")), g.edges.limit(0))
    return delta.replaced(old, new, spark.createDataFrame([("1",)], "file string")).nodes.select("id", "label")


@query("rollback_first_wins", f"WITH {BASE} SELECT id, CASE WHEN community >= 2 THEN label ELSE 'old ' || label END AS label FROM nodes")
def rollback_first_wins(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    now = Graph(g.nodes.filter("community >= 2"), g.edges)
    return delta.rolled_back(now, g.nodes.withColumn("label", F.concat(F.lit("old "), "label")), g.edges).nodes.select("id", "label")

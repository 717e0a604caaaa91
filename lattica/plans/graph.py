"""Queries of statistics, merging, communities and lint over the trade graph (communities are regions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.catalog import query
from lattica.model import Graph
from lattica.operators import build, cluster, stats

from .trade import TRADE_SQL, table, trade_edges


def trade_graph(spark: SparkSession, sf_dir: str, sparse: bool = False) -> Graph:
    """Nations and the trade between them; ``sparse`` keeps pairs of over 1.3 times the mean weight."""
    n = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("label"), F.lit("nation").alias("type"), F.col("n_regionkey").cast("int").alias("community"),
        F.array(F.concat(F.lit("region"), F.col("n_regionkey").cast("string"))).alias("provenance"), F.col("n_nationkey").cast("bigint").alias("ord"),
    )
    e = trade_edges(spark, sf_dir)
    if sparse:
        mean = e.agg(F.sum("w").alias("total"), F.count("*").alias("pairs"))
        e = e.crossJoin(F.broadcast(mean)).filter(F.col("w") * F.col("pairs") * 10 > F.col("total") * 13)
    sure = F.when(F.col("w") % 3 == 0, "INFERRED").otherwise("EXTRACTED")
    e = e.select(
        F.concat_ws("-", F.col("s").cast("string"), F.col("t").cast("string")).alias("id"), F.col("s").cast("string").alias("source"), F.col("t").cast("string").alias("target"),
        F.col("w").cast("double").alias("weight"), F.lit("trades").alias("label"), sure.alias("confidence"), (F.col("s") * 100 + F.col("t")).cast("bigint").alias("ord"),
    )
    return Graph(n, e)


BASE = f"""{TRADE_SQL},
edges AS (SELECT s || '-' || t AS id, CAST(s AS VARCHAR) AS source, CAST(t AS VARCHAR) AS target, CAST(w AS DOUBLE) AS weight,
  CASE WHEN w % 3 = 0 THEN 'INFERRED' ELSE 'EXTRACTED' END AS confidence, s * 100 + t AS ord FROM e),
sparse AS (SELECT edges.* FROM edges, (SELECT sum(w) AS total, count(*) AS pairs FROM e) m WHERE weight * pairs * 10 > total * 13),
nodes AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS label, n_regionkey AS community, n_nationkey AS ord FROM nation)"""


@query("graph_status", f"WITH {BASE} SELECT n AS nodes, m AS edges, c AS communities, round(m / (n * (n - 1)), 4) AS density FROM (SELECT count(*) AS n, count(DISTINCT community) AS c FROM nodes) a, (SELECT count(*) AS m FROM edges) b")
def graph_status(spark, sf_dir):
    return stats.status(trade_graph(spark, sf_dir))


@query("count_by_type", "SELECT 'nation' AS type, count(*) AS n FROM nation")
def count_by_type(spark, sf_dir):
    return stats.count_by_type(trade_graph(spark, sf_dir).nodes)


DEG = "d AS (SELECT id, count(*) AS degree, sum(weight) AS wdegree FROM (SELECT source AS id, weight FROM sparse UNION ALL SELECT target, weight FROM sparse) x GROUP BY id)"


@query("hub_degree_min", f"WITH {BASE}, {DEG} SELECT d.id, label, degree FROM d JOIN nodes USING (id) WHERE degree >= 3 ORDER BY degree DESC, d.id LIMIT 20")
def hub_degree_min(spark, sf_dir):
    return stats.hubs_above(trade_graph(spark, sf_dir, True), 3, 20)


@query("degree_all", f"WITH {BASE}, {DEG} SELECT nodes.id, label, coalesce(wdegree, 0.0) AS degree FROM nodes LEFT JOIN d USING (id) ORDER BY coalesce(wdegree, 0.0) DESC, ord LIMIT 10")
def degree_all(spark, sf_dir):
    return stats.hubs_all(trade_graph(spark, sf_dir, True))


@query("degree_selfloop_once", f"WITH {BASE} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges WHERE source <> target) x GROUP BY id")
def degree_selfloop_once(spark, sf_dir):
    return stats.degree_of(trade_graph(spark, sf_dir).edges)


@query("average_degree", f"WITH {BASE} SELECT 2.0 * (SELECT count(*) FROM edges) / count(*) AS average_degree FROM nodes")
def average_degree(spark, sf_dir):
    return stats.average_degree(trade_graph(spark, sf_dir)).select(F.col("average_degree").cast("double"))


@query("merge_edges_undirected", f"WITH {BASE} SELECT min_by(source, ord) AS source, min_by(target, ord) AS target, sum(weight) AS weight, min_by(id, ord) AS id FROM edges GROUP BY least(source, target), greatest(source, target)")
def merge_edges_undirected(spark, sf_dir):
    return build.merge_edges(trade_graph(spark, sf_dir).edges).select("source", "target", "weight", "id")


@query("merge_edges_directed", f"WITH {BASE}, r AS (SELECT source, target, weight, ord FROM edges UNION ALL SELECT target, source, weight, ord + 100000 FROM edges) SELECT source, target, sum(weight) AS weight, CAST(min(ord) AS BIGINT) AS ord FROM r GROUP BY source, target")
def merge_edges_directed(spark, sf_dir):
    e = trade_graph(spark, sf_dir).edges
    turned = e.withColumns({"source": F.col("target"), "target": F.col("source"), "ord": F.col("ord") + 100000})
    return build.merge_edges(e.unionByName(turned), True).select("source", "target", "weight", "ord")


@query("combine_edges", f"WITH {BASE} SELECT source, target, sum(weight) AS weight FROM (SELECT * FROM edges UNION ALL SELECT * FROM edges) x GROUP BY source, target")
def combine_edges(spark, sf_dir):
    e = trade_graph(spark, sf_dir).edges
    return build.combine_edges(e.unionByName(e)).select("source", "target", "weight")


@query(
    "merge_nodes",
    """WITH r AS (SELECT source AS id, lang AS label, doc_id AS ord FROM documents)
SELECT id, max_by(label, ord) AS label, min(ord) AS ord, string_agg(DISTINCT label, ',' ORDER BY label) AS provenance FROM r GROUP BY id""",
)
def merge_nodes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("id"), F.col("lang").alias("label"), F.lit("document").alias("type"), F.array("lang").alias("provenance"), F.col("doc_id").alias("ord"))
    g = Graph(d, d.select("id").limit(0).select("id"))
    return build.merge_nodes(g.nodes).select("id", "label", "ord", F.array_join(F.array_sort("provenance"), ",").alias("provenance"))


@query("completeness", "SELECT avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END) AS completeness FROM documents")
def completeness(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.when(F.col("lang") == "en", F.array("source")).otherwise(F.array().cast("array<string>")).alias("provenance"))
    return build.completeness(d)


@query("node_ids", "SELECT page_id, substr(sha256(url || '::' || CAST(page_id AS VARCHAR)), 1, 16) AS node_id FROM pages")
def node_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", build.node_id(F.col("url"), F.col("page_id").cast("string")).alias("node_id"))


@query("community_list", f"WITH {BASE} SELECT community, count(*) AS size, min_by(label, ord) AS label FROM nodes GROUP BY community HAVING count(*) >= 2")
def community_list(spark, sf_dir):
    return stats.communities(trade_graph(spark, sf_dir).nodes)


@query("community_members", f"WITH {BASE} SELECT community, string_agg(id, ',' ORDER BY ord) AS ids FROM nodes GROUP BY community")
def community_members(spark, sf_dir):
    return stats.by_community(trade_graph(spark, sf_dir).nodes).select("community", F.array_join("ids", ",").alias("ids"))


ENDS = "x AS (SELECT g.*, a.community AS ca, b.community AS cb FROM sparse g JOIN nodes a ON g.source = a.id JOIN nodes b ON g.target = b.id)"


@query(
    "community_summary",
    f"""WITH {BASE}, {ENDS}, i AS (SELECT ca AS community, count(*) AS inner_edges FROM x WHERE ca = cb GROUP BY ca)
SELECT community, members, coalesce(inner_edges, 0) AS inner_edges, round(coalesce(inner_edges, 0) / (members * (members - 1)), 4) AS density
FROM (SELECT community, count(*) AS members FROM nodes GROUP BY community) m LEFT JOIN i USING (community)""",
)
def community_summary(spark, sf_dir):
    return stats.community_summary(trade_graph(spark, sf_dir, True))


@query("adjacent_communities", f"WITH {BASE}, {ENDS} SELECT DISTINCT ca AS community, cb AS neighbour FROM (SELECT ca, cb FROM x UNION ALL SELECT cb, ca FROM x) y WHERE ca <> cb")
def adjacent_communities(spark, sf_dir):
    return stats.adjacent_communities(trade_graph(spark, sf_dir, True))


@query(
    "community_confidence",
    f"""WITH {BASE}, {ENDS}, i AS (SELECT ca AS community, bool_and(confidence = 'EXTRACTED') AS sure, avg(CASE WHEN confidence <> 'EXTRACTED' THEN 1.0 ELSE 0.0 END) AS unsure FROM x WHERE ca = cb GROUP BY ca)
SELECT community, CASE WHEN sure THEN 'high' WHEN unsure > 0.5 THEN 'low' ELSE 'medium' END AS confidence FROM (SELECT DISTINCT community FROM nodes) n LEFT JOIN i USING (community)""",
)
def community_confidence(spark, sf_dir):
    return stats.community_confidence(trade_graph(spark, sf_dir, True))


@query("community_facets", f"WITH {BASE} SELECT community, 'nation' AS types, count(*) AS n FROM nodes GROUP BY community")
def community_facets(spark, sf_dir):
    return stats.community_facets(trade_graph(spark, sf_dir).nodes).select("community", F.array_join("types", ",").alias("types"), "n")


@query(
    "surprises_hub",
    """WITH e AS (SELECT l_partkey AS p, l_suppkey AS s FROM lineitem), d AS (SELECT id, count(*) AS degree FROM (SELECT 'p' || p AS id FROM e UNION ALL SELECT 's' || s FROM e) x GROUP BY id),
m AS (SELECT (SELECT count(*) FROM e) / count(*) AS mean FROM d)
SELECT id, degree, CASE WHEN degree > 6 * mean THEN 'high' ELSE 'medium' END AS severity FROM d, m WHERE degree > 3 * mean AND degree > 5""",
)
def surprises_hub(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"))
    n = e.select("source").union(e.select("target")).distinct().toDF("id").withColumn("label", F.col("id"))
    return stats.surprising_hubs(Graph(n, e)).select("id", "degree", "severity")


@query("surprises_isolated", f"WITH {BASE}, {ENDS} SELECT community, count(*) AS members, 'low' AS severity FROM nodes WHERE community NOT IN (SELECT ca FROM x WHERE ca = cb) GROUP BY community HAVING count(*) > 1")
def surprises_isolated(spark, sf_dir):
    return stats.isolated_communities(trade_graph(spark, sf_dir, True))


@query(
    "surprises_anomaly",
    f"""WITH {BASE}, {DEG}, r AS (SELECT *, row_number() OVER (ORDER BY wdegree DESC, id) AS n FROM d)
SELECT a.id, a.degree FROM r a LEFT JOIN r b ON b.n = 2 WHERE a.n = 1 AND a.degree > 10 AND a.degree > 5 * b.degree""",
)
def surprises_anomaly(spark, sf_dir):
    return stats.anomalous_hub(trade_graph(spark, sf_dir, True))


@query(
    "lint_issues",
    f"""WITH {BASE}, many AS (SELECT * FROM sparse UNION ALL SELECT id, source, target, weight, confidence, ord + 100000 FROM sparse WHERE CAST(source AS INTEGER) < 5)
SELECT 'orphan' AS issue, 'warning' AS severity, id AS subject FROM nodes WHERE id NOT IN (SELECT source FROM many) AND id NOT IN (SELECT target FROM many)
UNION ALL SELECT 'duplicate_edge', 'warning', source || ':' || target FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY ord) AS n FROM many) x WHERE n > 1""",
)
def lint_issues(spark, sf_dir):
    g = trade_graph(spark, sf_dir, True)
    more = g.edges.filter(F.col("source").cast("int") < 5).withColumn("ord", F.col("ord") + 100000)
    return stats.lint(Graph(g.nodes, g.edges.unionByName(more)))


@query("communities")
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.clusters(trade_graph(spark, sf_dir, True))


@query("modularity_gain", f"WITH {BASE} SELECT (sum(weight) FILTER (target IN (SELECT id FROM nodes WHERE community = 1)) - power(sum(weight) FILTER (source = '0' OR target = '0'), 2)) / (4 * power(sum(weight) / 2, 2)) AS gain FROM edges")
def modularity_gain(spark, sf_dir):
    return cluster.modularity_gain(trade_graph(spark, sf_dir), "0", 1)

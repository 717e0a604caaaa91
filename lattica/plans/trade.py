"""Queries over the trade graph: nations joined by what customers of one order from suppliers of another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.catalog import query
from lattica.model import Graph
from lattica.operators import stats

TRADE_SQL = """
e AS (SELECT c_nationkey AS s, s_nationkey AS t, count(*) AS w FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, t, w): ordered pairs of nations and the number of line items between them."""
    get = lambda name, *cols: table(spark, sf_dir, name).select(*cols)
    lines = get("lineitem", "l_orderkey", "l_suppkey")
    lines = lines.join(get("supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    lines = lines.join(get("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(get("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return lines.groupBy(F.col("c_nationkey").alias("s"), F.col("s_nationkey").alias("t")).agg(F.count("*").alias("w"))


@query(
    "hub_weighted_degree",
    f"""WITH {TRADE_SQL}, d AS (SELECT n, sum(w) AS deg FROM (SELECT s AS n, w FROM e UNION ALL SELECT t AS n, w FROM e) x GROUP BY 1)
SELECT n_name AS label, CAST(deg AS BIGINT) AS weighted_degree FROM d JOIN nation ON n = n_nationkey ORDER BY deg DESC, n LIMIT 10""",
)
def hub_weighted_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = trade_edges(spark, sf_dir).select(F.col("s").cast("string").alias("source"), F.col("t").cast("string").alias("target"), F.col("w").cast("double").alias("weight"))
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("label"))
    return stats.hubs(Graph(nodes, edges), 10).select("label", F.col("degree").cast("bigint").alias("weighted_degree"))

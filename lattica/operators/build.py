"""Building and merging graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.model import Graph


def node_id(source_file: Column, label: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of file and label."""
    return F.substring(F.sha2(F.concat_ws("::", F.coalesce(source_file, F.lit("")), F.coalesce(label, F.lit(""))), 256), 1, 16)


def _union_in_order(values: str, order: str = "ord") -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(order, values)))
    return F.array_distinct(F.flatten(F.transform(ordered, lambda x: F.coalesce(x[values], F.array().cast("array<string>")))))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One node for each id: the latest non-null scalars, provenance united in order of first sight, properties folded key by key
    with the latest value. Nodes without an id get theirs from file and label."""
    rows = nodes.withColumn("id", F.coalesce("id", node_id(F.col("source_file"), F.col("label"))))
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in ("label", "type", "source_file", "community")]
    entries = F.array_sort(F.collect_list(F.struct("ord", F.map_entries("properties").alias("p"))))
    folded = F.aggregate(
        entries,
        F.create_map().cast("map<string,string>"),
        lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: ~F.coalesce(F.array_contains(F.transform(x["p"], lambda e: e["key"]), k), F.lit(False))), F.map_from_entries(F.coalesce(x["p"], F.array().cast("array<struct<key:string,value:string>>")))),
    )
    return rows.groupBy("id").agg(*latest, folded.alias("properties"), _union_in_order("provenance").alias("provenance"), F.min("ord").alias("ord"))


def merge_edges(edges: DataFrame, directed: bool = False) -> DataFrame:
    """One edge for each pair of ends (unordered unless ``directed``): weights add up, the first edge gives id, label, orientation
    and confidence, provenance is united."""
    keys = [F.col("source"), F.col("target")] if directed else [F.least("source", "target"), F.greatest("source", "target")]
    kept = [F.min_by(c, "ord").alias(c) for c in ("id", "source", "target", "label", "confidence")]
    out = edges.groupBy(*[k.alias(n) for k, n in zip(keys, ("_a", "_b"), strict=True)]).agg(
        F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"), *kept, _union_in_order("provenance").alias("provenance"), F.min("ord").alias("ord")
    )
    return out.drop("_a", "_b")


def combine_edges(edges: DataFrame) -> DataFrame:
    """Ordered pairs with weights added up; the first edge keeps everything else."""
    kept = [F.min_by(c, "ord").alias(c) for c in ("id", "label", "provenance", "confidence")]
    return edges.groupBy("source", "target").agg(F.sum("weight").alias("weight"), *kept, F.min("ord").alias("ord"))


def completeness(nodes: DataFrame) -> DataFrame:
    """Share of nodes with a provenance; 0 without nodes."""
    has = (F.coalesce(F.size("provenance"), F.lit(0)) > 0).cast("double")
    return nodes.agg(F.coalesce(F.avg(has), F.lit(0.0)).alias("completeness"))


def first_wins(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first row for each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def add_pending(graph: Graph, nodes: DataFrame, edges: DataFrame) -> Graph:
    """Agent results appended, first id wins."""
    late = 1 << 40
    more = [x.withColumn("ord", F.col("ord") + late) for x in (nodes, edges)]
    return Graph(first_wins(graph.nodes.unionByName(more[0]), ["id"]), first_wins(graph.edges.unionByName(more[1]), ["id"]), graph.directed, graph.meta)


def without_files(graph: Graph, patterns: list[str]) -> Graph:
    """Drop nodes whose file matches an ignore pattern, and edges that touch them."""
    from lattica.functions.files import ignored

    gone = graph.nodes.filter(ignored(F.col("source_file"), patterns)).select("id")
    edges = graph.edges
    for end in ("source", "target"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return Graph(graph.nodes.join(gone, "id", "left_anti"), edges, graph.directed, graph.meta)

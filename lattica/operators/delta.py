"""Differences between two states of a graph, and merging them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.model import Graph

from .build import first_wins


def node_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change): added, removed, modified or unchanged by label, type and properties."""
    own = F.struct("label", "type", F.to_json(F.array_sort(F.map_entries("properties"))).alias("p"))
    a, b = (x.groupBy("id").agg(F.min_by(own, "ord").alias(n)) for x, n in ((old, "o"), (new, "n")))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o").eqNullSafe(F.col("n")), "unchanged").otherwise("modified")
    return a.join(b, "id", "full_outer").select("id", change.alias("change"))


def edge_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, target, change): ordered pairs added or removed; labels and weights do not count."""
    key = ["source", "target"]
    added = new.select(*key).distinct().join(old.select(*key), key, "left_anti").withColumn("change", F.lit("added"))
    removed = old.select(*key).distinct().join(new.select(*key), key, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def delta_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of ``node_delta`` and ``edge_delta``."""
    a = nodes.groupBy("change").agg(F.count("*").alias("n")).select(F.lit("node").alias("entity"), "change", "n")
    return a.unionByName(edges.groupBy("change").agg(F.count("*").alias("n")).select(F.lit("edge").alias("entity"), "change", "n"))


def drifted(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids in both assignments (id, community) whose community differs."""
    b = after.select("id", F.col("community").alias("now"))
    return before.join(b, "id").filter("community <> now").select("id", F.col("community").alias("was"), "now")


def drift_of(before: DataFrame, after: DataFrame, affected: DataFrame) -> DataFrame:
    """Affected ids whose community differs; one that is missing on either side differs."""
    b = after.select("id", F.col("community").alias("now"))
    return before.join(b, "id", "full_outer").filter(~F.col("community").eqNullSafe(F.col("now"))).join(affected.select("id"), "id", "left_semi").select("id")


def changed_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files (file, content) whose hash (first 16 digits of SHA-256) is not the one in the manifest (file, hash)."""
    now = files.select("file", F.substring(F.sha2("content", 256), 1, 16).alias("hash"))
    was = manifest.select(F.col("file").alias("f"), F.col("hash").alias("h"))
    return now.join(was, F.col("file") == F.col("f"), "left").filter(~F.col("hash").eqNullSafe(F.col("h"))).select("file", "hash")


def replaced(old: Graph, new: Graph, files: DataFrame) -> Graph:
    """``old`` without the nodes of ``files`` (file) and the edges that start at one, and with ``new``; first id wins."""
    gone = old.nodes.join(files.select(F.col("file").alias("source_file")), "source_file", "left_semi").select("id")
    kept = old.nodes.join(gone, "id", "left_anti")
    edges = old.edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti")
    late = 1 << 40
    nodes = first_wins(kept.unionByName(new.nodes.withColumn("ord", F.col("ord") + late), allowMissingColumns=True), ["id"])
    edges = first_wins(edges.unionByName(new.edges.withColumn("ord", F.col("ord") + late), allowMissingColumns=True), ["id"])
    return Graph(nodes, edges, old.directed, old.meta)


def watch_merged(old: Graph, new: Graph, removed: DataFrame) -> Graph:
    """``old`` without the nodes of removed files (file), all its edges kept, and ``new`` appended; first id wins."""
    kept = old.nodes.join(removed.select(F.col("file").alias("source_file")), "source_file", "left_anti")
    late = 1 << 40
    nodes = first_wins(kept.unionByName(new.nodes.withColumn("ord", F.col("ord") + late), allowMissingColumns=True), ["id"])
    edges = first_wins(old.edges.unionByName(new.edges.withColumn("ord", F.col("ord") + late), allowMissingColumns=True), ["id"])
    return Graph(nodes, edges, old.directed, old.meta)


def rolled_back(now: Graph, removed_nodes: DataFrame, removed_edges: DataFrame) -> Graph:
    """Removed nodes and edges put back; what is there wins, and what was added stays."""
    late = 1 << 40
    nodes = first_wins(now.nodes.unionByName(removed_nodes.withColumn("ord", F.col("ord") + late), allowMissingColumns=True), ["id"])
    edges = first_wins(now.edges.unionByName(removed_edges.withColumn("ord", F.col("ord") + late), allowMissingColumns=True), ["id"])
    return Graph(nodes, edges, now.directed, now.meta)


def history_until(history: DataFrame, version: str) -> DataFrame:
    """Rows (version, ord, ...) up to the first one of ``version``."""
    at = history.filter(F.col("version") == version).agg(F.min("ord").alias("last"))
    return history.crossJoin(F.broadcast(at)).filter("ord <= last").drop("last")


def persist(delta: DataFrame, path: str, stamp: str) -> None:
    """The delta as JSON in a folder for its build."""
    delta.write.mode("overwrite").json(f"{path}/build={stamp.replace(':', '-').replace('.', '-')}")

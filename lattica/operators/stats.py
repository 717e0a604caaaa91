"""Statistics of a graph: counts, hubs, communities, surprises, lint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.model import Graph, ends


def status(g: Graph) -> DataFrame:
    """Counts of nodes, edges and communities, and density E / (N (N - 1)) to four places."""
    n = g.nodes.agg(F.count("*").alias("nodes"), F.countDistinct("community").alias("communities"))
    e = g.edges.agg(F.count("*").alias("edges"))
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    return n.crossJoin(e).select("nodes", "edges", "communities", F.when(F.col("nodes") < 2, 0.0).otherwise(F.round(F.col("edges") / pairs, 4)).alias("density"))


def count_by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def degrees(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """(id, degree); a loop counts twice."""
    return ends(edges, "weight").groupBy("id").agg((F.sum("weight") if weighted else F.count("*")).alias("degree"))


def degree_of(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """(id, degree) where a loop counts once."""
    once = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"), "weight")
    return once.groupBy("id").agg((F.sum("weight") if weighted else F.count("*")).alias("degree"))


def hubs(g: Graph, top: int = 10) -> DataFrame:
    """Ends of highest weighted degree; ends without a node compete for the cut and then vanish."""
    best = degrees(g.edges, True).orderBy(F.desc("degree"), "id").limit(top)
    return best.join(g.nodes.select("id", "label"), "id")


def hubs_all(g: Graph, top: int = 10) -> DataFrame:
    """Nodes of highest weighted degree, those without an edge at 0."""
    every = g.nodes.select("id", "label", "ord").join(degrees(g.edges, True), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0.0)))
    return every.orderBy(F.desc("degree"), "ord").limit(top).select("id", "label", "degree")


def hubs_above(g: Graph, least: int = 10, top: int = 20) -> DataFrame:
    """Ends of unweighted degree ``least`` or more; one without a node keeps its id as label."""
    best = degrees(g.edges).filter(F.col("degree") >= least).orderBy(F.desc("degree"), "id").limit(top)
    return best.join(g.nodes.select("id", "label"), "id", "left").select("id", F.coalesce("label", "id").alias("label"), "degree")


def average_degree(g: Graph) -> DataFrame:
    n, e = g.nodes.agg(F.count("*").alias("n")), g.edges.agg(F.count("*").alias("e"))
    return n.crossJoin(e).select(F.when(F.col("n") > 0, 2 * F.col("e") / F.col("n")).otherwise(0.0).alias("average_degree"))


def by_community(nodes: DataFrame) -> DataFrame:
    """Members of each community in order; nodes without one are in community -1."""
    return nodes.groupBy(F.coalesce("community", F.lit(-1)).alias("community")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("ids"))


def communities(nodes: DataFrame, least: int = 2) -> DataFrame:
    """Communities of ``least`` nodes or more, labelled by their first node."""
    out = nodes.filter("community IS NOT NULL AND community <> -1").groupBy("community").agg(F.count("*").alias("size"), F.min_by("label", "ord").alias("label"))
    return out.filter(F.col("size") >= least)


def _of_ends(g: Graph) -> DataFrame:
    known = g.nodes.select("id", F.coalesce("community", F.lit(-1)).alias("c"))
    out = g.edges
    for end in ("source", "target"):
        out = out.join(known.select(F.col("id").alias(end), F.col("c").alias(f"{end}_community")), end, "left")
    return out


def community_summary(g: Graph) -> DataFrame:
    """Members, inner edges and density of each community."""
    size = g.nodes.groupBy(F.coalesce("community", F.lit(-1)).alias("community")).agg(F.count("*").alias("members"))
    inner = _of_ends(g).filter("source_community = target_community").groupBy(F.col("source_community").alias("community")).agg(F.count("*").alias("inner_edges"))
    out = size.join(inner, "community", "left").withColumn("inner_edges", F.coalesce("inner_edges", F.lit(0)))
    pairs = F.col("members") * (F.col("members") - 1)
    return out.withColumn("density", F.when(F.col("members") < 2, 0.0).otherwise(F.round(F.col("inner_edges") / pairs, 4)))


def adjacent_communities(g: Graph) -> DataFrame:
    """(community, neighbour): communities joined by an edge with exactly one end in each."""
    e = _of_ends(g).filter("source_community <> target_community")
    out = e.select(F.explode(F.array(F.struct(F.col("source_community").alias("community"), F.col("target_community").alias("neighbour")), F.struct(F.col("target_community").alias("community"), F.col("source_community").alias("neighbour")))).alias("p"))
    return out.select("p.*").distinct()


def community_confidence(g: Graph) -> DataFrame:
    """high if all inner edges are EXTRACTED, low if over half are INFERRED or AMBIGUOUS, else (or without edges) medium."""
    inner = _of_ends(g).filter("source_community = target_community").groupBy(F.col("source_community").alias("community"))
    inner = inner.agg(F.bool_and(F.col("confidence") == "EXTRACTED").alias("sure"), F.avg(F.col("confidence").isin("INFERRED", "AMBIGUOUS").cast("double")).alias("unsure"))
    every = g.nodes.select(F.coalesce("community", F.lit(-1)).alias("community")).distinct()
    grade = F.when(F.col("sure"), "high").when(F.col("unsure") > 0.5, "low").otherwise("medium")
    return every.join(inner, "community", "left").select("community", grade.alias("confidence"))


def community_facets(nodes: DataFrame) -> DataFrame:
    """Distinct files, types and number of nodes of each community, files and types in order of first sight."""
    seen = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("ord", c)))), lambda x: x[c]))
    return nodes.groupBy(F.coalesce("community", F.lit(-1)).alias("community")).agg(seen("source_file").alias("files"), seen("type").alias("types"), F.count("*").alias("n"))


def surprising_hubs(g: Graph) -> DataFrame:
    """Nodes of degree over 3 E / N and over 5; high over 6 E / N, else medium."""
    mean = g.nodes.agg(F.count("*").alias("n")).crossJoin(g.edges.agg(F.count("*").alias("e"))).select((F.col("e") / F.col("n")).alias("mean"))
    out = degrees(g.edges).join(g.nodes.select("id", "label"), "id").crossJoin(F.broadcast(mean)).filter((F.col("degree") > 3 * F.col("mean")) & (F.col("degree") > 5))
    return out.select("id", "label", "degree", F.when(F.col("degree") > 6 * F.col("mean"), "high").otherwise("medium").alias("severity"))


def isolated_communities(g: Graph) -> DataFrame:
    """Communities of more than one node without an inner edge."""
    return community_summary(g).filter("members > 1 AND inner_edges = 0").select("community", "members", F.lit("low").alias("severity"))


def anomalous_hub(g: Graph) -> DataFrame:
    """The node of highest weighted degree, if its unweighted degree is over 10 and over 5 times the runner-up's."""
    both = degrees(g.edges, True).withColumnRenamed("degree", "w").join(degrees(g.edges), "id")
    top = both.orderBy(F.desc("w"), "id").limit(2).withColumn("r", F.row_number().over(Window.orderBy(F.desc("w"), "id")))
    wide = top.agg(F.max(F.when(F.col("r") == 1, F.col("id"))).alias("id"), F.max(F.when(F.col("r") == 1, F.col("degree"))).alias("degree"), F.max(F.when(F.col("r") == 2, F.col("degree"))).alias("next"))
    return wide.filter("degree > 10 AND degree > 5 * next").select("id", "degree")


def repeated_edges(edges: DataFrame) -> DataFrame:
    """Second and later edges of an ordered pair."""
    return edges.withColumn("nth", F.row_number().over(Window.partitionBy("source", "target").orderBy("ord"))).filter("nth > 1")


def lint(g: Graph) -> DataFrame:
    """(issue, severity, subject): nodes without an edge (if there is more than one node), missing labels, repeated edges."""
    lonely = g.nodes.join(ends(g.edges).distinct(), "id", "left_anti").select("id")
    several = g.nodes.agg((F.count("*") > 1).alias("several"))
    parts = [
        lonely.crossJoin(F.broadcast(several)).filter("several").select(F.lit("orphan").alias("issue"), F.lit("warning").alias("severity"), F.col("id").alias("subject")),
        g.nodes.filter("label IS NULL OR label = ''").select(F.lit("missing_label").alias("issue"), F.lit("error").alias("severity"), F.col("id").alias("subject")),
        repeated_edges(g.edges).select(F.lit("duplicate_edge").alias("issue"), F.lit("warning").alias("severity"), F.concat_ws(":", "source", "target").alias("subject")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

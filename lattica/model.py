"""The property graph as two DataFrames, and what every operator over it shares."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types of nodes and edges that model extraction is asked for; other values are allowed in a graph.
NODE_TYPES = ("function", "class", "module", "interface", "type", "concept", "entity", "rationale", "document", "comparison", "decision")
EDGE_TYPES = (
    "calls", "imports", "uses", "defines", "implements", "extends", "overrides", "instantiates", "semantically_similar_to",
    "related_to", "contradicts", "supersedes", "depends_on", "rationale_for", "alternative_to",
)

NODES = "id string, label string, type string, properties map<string,string>, provenance array<string>, source_file string, community int, ord bigint"
EDGES = "id string, source string, target string, weight double, label string, provenance array<string>, confidence string, ord bigint"


@dataclass
class Graph:
    """``nodes`` and ``edges`` with the columns of NODES and EDGES (missing ones are added as nulls); ``ord`` is array order."""

    nodes: DataFrame
    edges: DataFrame
    directed: bool = False
    meta: dict = field(default_factory=dict)

    def __post_init__(self):
        self.nodes, self.edges = _shaped(self.nodes, NODES), _shaped(self.edges, EDGES)


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    fields = T.StructType.fromDDL(schema).fields
    own = set(df.columns)
    rest = [c for c in df.columns if c not in {f.name for f in fields}]
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in own else F.lit(None).cast(f.dataType).alias(f.name) for f in fields], *rest)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder of spark.checkpoint.dir (a temporary one in local sessions without it)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = getattr(spark, "_lattica_scratch", None) or tempfile.mkdtemp(prefix="lattica-")
        spark._lattica_scratch = path
    return f"{path}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``df`` with its rows numbered from 0 in ``order``, without bringing them together: ranges are dealt out and sorted, and each
    begins where those before it end. Only the ranges' sizes (one row for each partition) are broadcast."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(ranges.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranges")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def ends(edges: DataFrame, *more: str) -> DataFrame:
    """One row (id, ...) for each end of each edge; a loop gives two."""
    return edges.select(F.explode(F.array("source", "target")).alias("id"), *more)


def both_ways(edges: DataFrame, directed: bool = False) -> DataFrame:
    """(a, b, back, ord): hops of each edge; an undirected edge can be taken from either end."""
    out = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit(False).alias("back"), "ord", "label")
    return out if directed else out.unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"), F.lit(True).alias("back"), "ord", "label"))


def first_by(value: str | Column, order: str | Column = "ord") -> Column:
    return F.min_by(value, order)

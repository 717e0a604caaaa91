"""Reading graphs, corpora, pages, history and held-out questions."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.files import ignored
from lattica.model import Graph, numbered

#: Folders that a scan always leaves out.
SKIPPED = ("node_modules/", "dist/", ".git/")


def config(spark: SparkSession, path: str, defaults: dict[str, dict]) -> dict[str, dict]:
    """Each part of ``defaults`` with what the JSON file at ``path`` gives over it; the defaults alone if it is missing or no JSON."""
    import json

    try:
        given = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).limit(1).collect()))
    except (AnalysisException, ValueError):
        given = {}
    return {part: own | (given.get(part) or {}) for part, own in defaults.items()}


def files(spark: SparkSession, root: str, patterns: list[str] = SKIPPED, most: int = 1 << 20, raw: str | None = None, parts: bool = False) -> DataFrame:
    """(file, size, modified, text) of files below ``root`` of up to ``most`` bytes that match no ignore pattern. ``raw`` is a second folder whose
    files come in below ``raw/``, whatever the patterns. ``parts``: a folder's ``part-*`` files are one file of the folder's name, in the order of their names."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = lambda base: F.regexp_replace("path", r"^.*?" + re.escape(re.sub("^[a-z]+:/*", "/", base).rstrip("/")) + "/", "")
    out = found.withColumn("file", below(root)).filter(~ignored(F.col("file"), list(patterns)))
    if raw is not None:
        more = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(raw)
        out = out.unionByName(more.withColumn("file", F.concat(F.lit("raw/"), below(raw))))
    if parts:
        out = out.withColumn("file", F.regexp_replace("file", "/part-[^/]*$", ""))
        whole = out.groupBy("file").agg(F.sum("length").alias("size"), F.max("modificationTime").alias("modified")).filter(F.col("size") <= most)
        texts = out.filter(F.col("length") <= most).join(whole.select("file"), "file", "left_semi").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("path", "content"))).alias("parts"))
        text = F.decode(F.aggregate("parts", F.expr("X''"), lambda a, x: F.concat(a, x["content"])), "UTF-8")
        return whole.join(texts.select("file", text.alias("text")), "file", "left")
    return out.filter(F.col("length") <= most).select("file", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))


def graph_json(spark: SparkSession, path: str) -> Graph:
    """A graph document; one that is missing or has no nodes and edges gives an empty graph."""
    from lattica.model import EDGES, NODES

    schema = f"nodes array<struct<{_fields(NODES)}>>, edges array<struct<{_fields(EDGES)}>>, metadata struct<directed:boolean>"
    try:
        doc = spark.read.schema(schema).option("multiLine", True).json(path)
        meta = doc.select("metadata").first()
    except AnalysisException:
        meta, doc = None, spark.createDataFrame([], schema)
    part = lambda c: doc.select(F.posexplode(c).alias("ord", "x")).select("x.*", F.col("ord").cast("bigint").alias("o")).drop("ord").withColumnRenamed("o", "ord")
    return Graph(part("nodes"), part("edges"), bool(meta and meta[0] and meta[0]["directed"]))


def _fields(ddl: str) -> str:
    return ", ".join(p.replace(" ", ":", 1) for p in ddl.split(", "))


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of text, in any file system that Spark reaches."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def save_graph(g: Graph, path: str) -> None:
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), directed)


def wiki(spark: SparkSession, root: str) -> DataFrame:
    """(path, title, content, front) of markdown pages below ``root``; those without front matter are left out."""
    from lattica.operators.extract import front_matter, front_values

    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True).withColumn("path", F.input_file_name())
    block, body = front_matter(F.col("value"))
    rows = raw.filter(block != "").select("path", front_values(block).alias("front"), body.alias("content"))
    return rows.select("path", F.coalesce(F.try_element_at("front", F.lit("title")), F.try_element_at("front", F.lit("label"))).alias("title"), "content", "front")


def history(spark: SparkSession, path: str) -> DataFrame:
    """Refinement history: JSON lines, numbered in order of time."""
    rows = spark.read.json(path)
    return numbered(rows, "ord", "timestamp")


def held_out(spark: SparkSession, path: str) -> DataFrame:
    """Held-out questions: an array, or an object with the array under ``queries``; a missing file gives none."""
    item = "struct<query:string, category:string, expectedTier:int>"
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "query string, category string, expectedTier int")
    one = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{item}>")).otherwise(F.from_json("value", f"struct<queries:array<{item}>>")["queries"])
    return raw.select(F.explode(one).alias("q")).select("q.*")


def pending(spark: SparkSession, root: str) -> DataFrame:
    """Agent results (``*.result.json`` with nodes and edges) below ``root``."""
    return spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.result.json").json(root)


def corpus(files_: DataFrame) -> DataFrame:
    """(n_files, bytes, language) of a corpus; the language of its first file."""
    from lattica.functions.files import language

    return files_.agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"), F.min_by(language(F.col("file")), "file").alias("language"))

"""Graphs as text: GraphML, Cypher, SVG, HTML, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import community_colour, cypher_escaped, file_name, xml_escaped
from lattica.model import Graph, numbered


#: Fixed value: the document's head with the keys that node and edge data refer to.
GRAPHML_HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns"
  xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"
  xsi:schemaLocation="http://graphml.graphdrawing.org/xmlns
  http://graphml.graphdrawing.org/xmlns/1.0/graphml.xsd">
  <key id="label" for="node" attr.name="label" attr.type="string"/>
  <key id="type" for="node" attr.name="type" attr.type="string"/>
  <key id="community" for="node" attr.name="community" attr.type="int"/>
  <key id="source_file" for="node" attr.name="source_file" attr.type="string"/>
  <key id="provenance" for="node" attr.name="provenance" attr.type="string"/>
  <key id="weight" for="edge" attr.name="weight" attr.type="double"/>
  <key id="edge_label" for="edge" attr.name="label" attr.type="string"/>
  <key id="edge_provenance" for="edge" attr.name="provenance" attr.type="string"/>"""

#: Statements after the nodes and relations.
CYPHER_INDEXES = tuple(f"CREATE INDEX node_{c}_index IF NOT EXISTS FOR (n:GraphNode) ON (n.{c});" for c in ("id", "type", "community", "label"))

HTML_DRAWING = """const at={},ns="http://www.w3.org/2000/svg",svg=document.getElementById("picture");
const put=(kind,values)=>{const x=document.createElementNS(ns,kind);for(const k in values)x.setAttribute(k,values[k]);return svg.appendChild(x)};
nodes.forEach((n,i)=>{const a=2*Math.PI*i/nodes.length;at[n.id]=[500+350*Math.cos(a),400+350*Math.sin(a)]});
edges.forEach(e=>{const a=at[e.source],b=at[e.target];if(a&&b)put("line",{x1:a[0],y1:a[1],x2:b[0],y2:b[1],stroke:"#999"})});
nodes.forEach(n=>{const c=put("circle",{cx:at[n.id][0],cy:at[n.id][1],r:6});c.appendChild(document.createElementNS(ns,"title")).textContent=n.label});"""


def _number(c: str) -> Column:
    """A number without a fraction that is zero."""
    return F.when(F.col(c) == F.floor(c), F.floor(c).cast("string")).otherwise(F.col(c).cast("string"))


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _filled(c: str, by: Column) -> Column:
    return F.when(_or_empty(c) == "", by).otherwise(F.col(c))


def _provenance() -> Column:
    return F.to_json(F.coalesce("provenance", F.array().cast("array<string>")))


def _data(key: str, value: Column) -> Column:
    return F.concat(F.lit(f'\n      <data key="{key}">'), value, F.lit("</data>"))


def _if(value: Column, text: Column) -> Column:
    return F.coalesce(F.when(value.isNotNull() & (value.cast("string") != ""), text), F.lit(""))


def _attribute(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'{name}="'), value, F.lit('"'))


def graphml(g: Graph) -> DataFrame:
    """(place, line): the document, an element with its data to a row; ``place`` orders them."""
    spark = g.nodes.sparkSession
    fixed = spark.createDataFrame([(0, i, x) for i, x in enumerate(GRAPHML_HEAD.split("\n"))] + [(3, 0, "  </graph>"), (3, 1, "</graphml>")], "part int, ord long, line string")
    counts = g.nodes.agg(F.count("*").alias("n")).crossJoin(g.edges.agg(F.count("*").alias("m")))
    opened = counts.select(F.lit(0).alias("part"), F.lit(99).cast("long").alias("ord"), F.format_string('  <graph id="G" edgedefault="directed" nodes="%d" edges="%d">', "n", "m").alias("line"))
    xml = xml_escaped
    node = F.concat(
        F.lit("    <node "), _attribute("id", xml(F.col("id"))), F.lit(">"), _data("label", xml(_filled("label", F.col("id")))), _data("type", xml(_filled("type", F.lit("unknown")))),
        _if(F.col("community"), _data("community", F.col("community").cast("string"))), _if(F.col("source_file"), _data("source_file", xml(_or_empty("source_file")))),
        _data("provenance", xml(_provenance())), F.lit("\n    </node>"),
    )
    edge = F.concat(
        F.lit("    <edge "), _attribute("id", xml(_or_empty("id"))), F.lit(" "), _attribute("source", xml(F.col("source"))), F.lit(" "), _attribute("target", xml(F.col("target"))), F.lit(">"),
        _data("weight", F.coalesce(_number("weight"), F.lit(""))), _if(F.col("label"), _data("edge_label", xml(_or_empty("label")))), _data("edge_provenance", xml(_provenance())), F.lit("\n    </edge>"),
    )
    n = g.nodes.select(F.lit(1).alias("part"), "ord", node.alias("line"))
    e = g.edges.select(F.lit(2).alias("part"), "ord", edge.alias("line"))
    return fixed.unionByName(opened).unionByName(n).unionByName(e).select(F.format_string("%d-%015d", "part", "ord").alias("place"), "line")


def _text(value: Column) -> Column:
    return F.concat(F.lit("'"), cypher_escaped(value), F.lit("'"))


def _name(value: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(value, F.lit("`"), F.lit("``")), F.lit("`"))


def _json(value: Column) -> Column:
    inside = F.to_json(F.array(value))
    return inside.substr(F.lit(2), F.length(inside) - 2)


def _listed(*parts: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.filter(F.flatten(F.array(*parts)), lambda x: x.isNotNull()), ", "), F.lit("}"))


def _prop(name: str, value: Column, given: Column | None = None) -> Column:
    text = F.concat(F.lit(f"{name}: "), value)
    return F.array(F.when(given, text) if given is not None else text)


def cypher(g: Graph) -> DataFrame:
    """(place, line): statements that create nodes, relations and indexes, with all properties. Types, relations and names of properties
    stand in back-quotes; a relation is in capitals with underscores for blanks."""
    spark, have = g.nodes.sparkSession, lambda c: _or_empty(c) != ""
    empty = F.array().cast("array<string>")
    sources = F.size(F.coalesce("provenance", empty)) > 0
    more = F.coalesce(F.transform(F.array_sort(F.map_entries("properties")), lambda kv: F.concat(_name(kv["key"]), F.lit(": "), F.coalesce(_json(kv["value"]), F.lit("null")))), empty)
    props = _listed(
        _prop("id", _text(F.col("id"))), _prop("label", _text(_filled("label", F.col("id")))), _prop("type", _text(F.col("type")), have("type")),
        _prop("community", F.col("community").cast("string"), F.col("community").isNotNull()), _prop("source_file", _text(F.col("source_file")), have("source_file")),
        _prop("provenance", _provenance(), sources), more,
    )
    n = g.nodes.select(F.lit(1).alias("part"), "ord", F.concat(F.lit("CREATE (n:"), _name(_filled("type", F.lit("GraphNode"))), F.lit(" "), props, F.lit(");")).alias("line"))
    own = _listed(_prop("id", _text(F.col("id")), F.col("id").isNotNull()), _prop("weight", _number("weight"), F.col("weight").isNotNull()), _prop("provenance", _provenance(), sources))
    kind = F.regexp_replace(F.upper(_filled("label", F.lit("RELATES_TO"))), r"\s+", "_")
    made = F.concat(F.lit("MATCH (a {id: "), _text(F.col("source")), F.lit("}), (b {id: "), _text(F.col("target")), F.lit("}) CREATE (a)-[r:"), _name(kind), F.lit(" "), own, F.lit("]->(b);"))
    e = g.edges.select(F.lit(2).alias("part"), "ord", made.alias("line"))
    last = spark.createDataFrame([(3, i, x) for i, x in enumerate(CYPHER_INDEXES)], "part int, ord long, line string")
    return n.unionByName(e).unionByName(last).select(F.format_string("%d-%015d", "part", "ord").alias("place"), "line")


def push(g: Graph, connect, batch: int = 500) -> None:
    """Send nodes and edges to a graph store: ``connect()`` gives an object with ``merge(kind, rows)`` on each executor."""

    def send(kind):
        def run(rows):
            store, held = connect(), []
            for r in rows:
                held.append(r.asDict())
                if len(held) >= batch:
                    store.merge(kind, held)
                    held = []
            if held:
                store.merge(kind, held)

        return run

    g.nodes.foreachPartition(send("node"))
    g.edges.foreachPartition(send("edge"))


def push_complete(sent: int, stored: int, tolerance: float = 0.05) -> bool:
    return abs(sent - stored) <= tolerance * max(1, sent)


def layout(g: Graph, rounds: int = 100, width: float = 1000, height: float = 800) -> DataFrame:
    """(id, x, y): positions by repulsion 8000 / d^2 between all nodes, attraction 0.005 d along edges and damping 0.85. Forces need
    all nodes at once: one task, for graphs that a picture can show."""
    rows = g.nodes.select("id", "ord", F.lit(None).cast("string").alias("o")).unionByName(g.edges.select(F.col("source").alias("id"), F.lit(-1).cast("bigint").alias("ord"), F.col("target").alias("o")))

    def settle(pdf):
        import numpy as np
        import pandas as pd

        own = pdf[pdf.o.isna()].sort_values("ord").id.tolist()
        at = {n: i for i, n in enumerate(own)}
        links = [(at[e.id], at[e.o]) for e in pdf[pdf.o.notna()].itertuples() if e.id in at and e.o in at]
        angle = 2 * np.pi * np.arange(len(own)) / max(1, len(own))
        p = np.stack([width / 2 + np.cos(angle) * width / 3, height / 2 + np.sin(angle) * height / 3], axis=1)
        v = np.zeros_like(p)
        for _ in range(rounds):
            d = p[:, None] - p[None, :]
            r2 = np.maximum((d**2).sum(axis=2), 1.0)
            f = (8000 / r2 / np.sqrt(r2))[:, :, None] * d
            force = f.sum(axis=1)
            for a, b in links:
                pull = 0.005 * (p[b] - p[a])
                force[a] += pull
                force[b] -= pull
            v = (v + force) * 0.85
            p = np.clip(p + v, [20, 20], [width - 20, height - 20])
        return pd.DataFrame({"id": own, "x": p[:, 0], "y": p[:, 1]})

    return rows.withColumn("k", F.lit(1)).groupBy("k").applyInPandas(settle, "id string, x double, y double")


def svg(g: Graph, places: DataFrame) -> DataFrame:
    """(place, line): circles and lines of an SVG picture."""
    a = places.select(F.col("id").alias("source"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = places.select(F.col("id").alias("target"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    lines = g.edges.join(a, "source").join(b, "target").select(F.lit(1).alias("part"), "ord", F.format_string('<line x1="%.1f" y1="%.1f" x2="%.1f" y2="%.1f" stroke="#999"/>', "xa", "ya", "xb", "yb").alias("line"))
    dots = g.nodes.join(places, "id").select(F.lit(2).alias("part"), "ord", F.format_string('<circle cx="%.1f" cy="%.1f" r="6" fill="%s"><title>%s</title></circle>', "x", "y", community_colour(F.col("community")), xml_escaped(F.coalesce("label", F.lit("")))).alias("line"))
    return lines.unionByName(dots).select(F.format_string("%d-%015d", "part", "ord").alias("place"), "line")


def html(g: Graph) -> DataFrame:
    """(place, line): a page that holds the graph as JSON, a node or an edge to a line. No text of the graph can end the script."""
    spark = g.nodes.sparkSession
    head = ["<!doctype html><meta charset=utf-8><title>Graph</title><svg id=picture width=1000 height=800></svg><script>", "const nodes=["]
    fixed = [(0, i, x) for i, x in enumerate(head)] + [(2, 0, "],edges=["), (4, 0, "];"), (4, 1, HTML_DRAWING), (4, 2, "</script>")]
    safe = lambda c: F.concat(F.replace(c, F.lit("<"), F.lit("\\u003c")), F.lit(","))
    n = g.nodes.select(F.lit(1).alias("part"), "ord", safe(F.to_json(F.struct("id", "label", "type", "community"))).alias("line"))
    e = g.edges.select(F.lit(3).alias("part"), "ord", safe(F.to_json(F.struct("source", "target", "weight"))).alias("line"))
    rows = spark.createDataFrame(fixed, "part int, ord long, line string").unionByName(n).unionByName(e)
    return rows.select(F.format_string("%d-%015d", "part", "ord").alias("place"), "line")


def _joined(order: str, text: Column, most: int | None = None) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(order, text.alias("t"))))
    return F.array_join(F.transform(F.slice(rows, 1, most) if most else rows, lambda x: x["t"]), "\n")


def _link(name: str) -> Column:
    return F.concat(F.lit("- [["), name, F.lit("]]"))


def notes(g: Graph, mates: int = 10) -> DataFrame:
    """(file, content): a note for each node: its data, what it refers to, what refers to it, its properties and file, and the first members of its
    community. Of a community only the first ``mates`` + 1 nodes meet its notes."""
    nodes = g.nodes.withColumn("name", _filled("label", F.col("id")))
    names = nodes.select("id", "name")
    said = F.concat(_link("name"), _if(F.col("label"), F.concat(F.lit(" ("), "label", F.lit(")"))))
    out = g.edges.select(F.col("source").alias("own"), F.col("target").alias("id"), "label", "ord").join(names, "id").groupBy("own").agg(_joined("ord", said).alias("calls"))
    into = g.edges.select(F.col("target").alias("own"), F.col("source").alias("id"), "ord").join(names, "id").groupBy("own").agg(_joined("ord", _link("name")).alias("callers"))
    first = nodes.filter("community IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy("ord"))).filter(F.col("r") <= mates + 1)
    few = first.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("id").alias("mate"), F.col("name").alias("mate_name")))).alias("few"))
    rows = nodes.join(out.withColumnRenamed("own", "id"), "id", "left").join(into.withColumnRenamed("own", "id"), "id", "left").join(few, "community", "left")
    others = F.slice(F.filter("few", lambda x: x["mate"] != F.col("id")), 1, mates)
    known = F.filter(F.coalesce("provenance", F.array().cast("array<string>")), lambda p: p.isNotNull())
    props = F.transform(F.array_sort(F.map_entries("properties")), lambda kv: F.concat(F.lit("- **"), kv["key"], F.lit("**: "), F.coalesce(_json(kv["value"]), F.lit("null"))))
    part = lambda title, body: F.when(F.coalesce(F.length(body), F.lit(0)) > 0, F.concat(F.lit(f"## {title}\n"), body, F.lit("\n")))
    lines = F.array(
        F.lit("---"), F.concat(F.lit("id: "), "id"), F.concat(F.lit("type: "), _filled("type", F.lit("unknown"))), F.concat(F.lit("label: "), "name"),
        F.concat(F.lit("community: "), F.col("community").cast("string")),
        F.when(F.size(known) > 0, F.concat(F.lit("provenance:\n"), F.array_join(F.transform(known, lambda p: F.concat(F.lit("  - "), p)), "\n"))),
        F.lit("---\n"), F.concat(F.lit("# "), "name", F.lit("\n")), F.concat(F.lit("![["), _filled("type", F.lit("unknown")), F.lit("]]\n")),
        part("Calls / References", F.col("calls")), part("Called By / Referenced By", F.col("callers")), part("Properties", F.array_join(props, "\n")),
        part("Source", _if(F.col("source_file"), F.concat(F.lit("Source: `"), _or_empty("source_file"), F.lit("`")))),
        part("Community", F.array_join(F.transform(others, lambda x: F.concat(F.lit("- [["), x["mate_name"], F.lit("]]"))), "\n")),
    )
    content = F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")
    return rows.select(F.concat(F.lit("nodes/"), file_name(F.col("name")), F.lit(".md")).alias("file"), content.alias("content"))


def note_canvas(g: Graph) -> DataFrame:
    """(kind, place, item): nodes and edges of the vault's canvas as JSON, nodes in rows of five."""
    placed = numbered(g.nodes.withColumn("name", file_name(_filled("label", F.col("id")))), "i", "ord").select("id", "name", "i", (100 + F.pmod("i", F.lit(5)) * 200).alias("x"), (100 + F.floor(F.col("i") / 5) * 150).alias("y"))
    node = F.to_json(F.struct("id", F.lit("file").alias("type"), F.concat(F.lit("nodes/"), "name", F.lit(".md")).alias("file"), "x", "y", F.lit(200).alias("width"), F.lit(50).alias("height")))
    a, b = placed.select(F.col("id").alias("source"), (F.col("x") + 100).alias("fromX"), (F.col("y") + 25).alias("fromY")), placed.select(F.col("id").alias("target"), (F.col("x") + 100).alias("toX"), (F.col("y") + 25).alias("toY"))
    edge = F.to_json(F.struct("id", F.lit("line").alias("type"), "fromX", "fromY", "toX", "toY", F.lit("#0f3460").alias("color")))
    edges = g.edges.join(a, "source").join(b, "target").select(F.lit("edge").alias("kind"), F.col("ord").alias("place"), edge.alias("item"))
    return placed.select(F.lit("node").alias("kind"), F.col("i").alias("place"), node.alias("item")).unionByName(edges)


def note_index(g: Graph, of_type: int = 20, of_community: int = 10) -> DataFrame:
    """(section, name, n, links): the vault's index: how many nodes each type and each community has, and links to the first of them."""
    nodes = g.nodes.withColumn("name", file_name(_filled("label", F.col("id"))))
    out = None
    for section, key, most in (("type", _filled("type", F.lit("unknown")), of_type), ("community", F.col("community").cast("string"), of_community)):
        rows = nodes.withColumn("key", key).filter("key IS NOT NULL")
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
        first = rows.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("ord"))).filter(F.col("r") <= most)
        links = first.groupBy("key").agg(_joined("ord", _link("name")).alias("links"))
        part = sizes.join(links, "key").select(F.lit(section).alias("section"), F.col("key").alias("name"), "n", "links")
        out = part if out is None else out.unionByName(part)
    return out


def written(lines: DataFrame, path: str) -> None:
    """Lines in order of ``place`` as text files whose names keep the order."""
    lines.repartitionByRange("place").sortWithinPartitions("place").select("line").write.mode("overwrite").text(path)


__all__ = ["cypher", "graphml", "html", "layout", "note_canvas", "note_index", "notes", "push", "push_complete", "svg", "written"]

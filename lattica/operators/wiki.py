"""Pages compiled from a graph, their index, and links between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import section_header
from lattica.model import Graph, numbered

from . import stats
from .substrings import contained


def _joined(order: str, text: Column, by: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("t")))), lambda x: x["t"]), by)


def _page_slug(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"\s+", "-"))


def _named(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.coalesce("community", F.lit(-1)).alias("community"), F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("label", "id").alias("label"), "properties", "source_file", "ord")


def _inner_edges(g: Graph) -> DataFrame:
    """Edges whose ends are in one community, with it."""
    known = g.nodes.select("id", F.coalesce("community", F.lit(-1)).alias("c"))
    a, b = known.select(F.col("id").alias("source"), F.col("c").alias("community")), known.select(F.col("id").alias("target"), F.col("c").alias("other"))
    return g.edges.join(a, "source").join(b, "target").filter("community = other").drop("other")


def sections(g: Graph) -> DataFrame:
    """(community, type, header, place, body, n): a section for each type of node in a community, in order of first sight. Each node
    has an entry: its label, the first 200 characters of its content (or its label again), and the community's edges at it."""
    nodes = _named(g.nodes)
    line = F.concat(F.lit("  - "), "source", F.lit(" --"), F.coalesce(F.nullif("label", F.lit("")), F.lit("related")), F.lit("--> "), "target")
    near = _inner_edges(g).select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"), "ord", line.alias("line"))
    near = near.groupBy("id").agg(_joined("ord", F.col("line")).alias("relations"))
    text = F.coalesce(F.substring(F.try_element_at("properties", F.lit("content")), 1, 200), F.col("label"))
    entry = F.concat(F.lit("### "), "label", F.lit("\n\n"), text, F.coalesce(F.concat(F.lit("\n\nRelationships:\n"), "relations"), F.lit("")))
    rows = nodes.join(near, "id", "left").withColumn("entry", entry)
    out = rows.groupBy("community", "type").agg(F.min("ord").alias("place"), _joined("ord", F.col("entry"), "\n\n").alias("body"), F.count("*").alias("n"))
    return out.withColumn("header", section_header(F.col("type")))


def pages(g: Graph) -> DataFrame:
    """A page for each community: community, title, path, confidence, n_nodes, outline, sources, related, tags, content.

    The content has the outline, a section for each type (``sections``) and links to all its nodes. ``related`` are the
    communities next to it, ``sources`` the files of its nodes, ``tags`` its types and its number."""
    nodes = _named(g.nodes)
    body = sections(g).groupBy("community").agg(_joined("place", F.concat(F.lit("## "), "header", F.lit("\n\n"), "body"), "\n\n").alias("text"), _joined("place", F.col("type"), ",").alias("types"))
    seen = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("source_file", F.lit("")) != "", F.struct("ord", "source_file")))), lambda x: x["source_file"]))
    whole = nodes.groupBy("community").agg(
        F.min_by("label", "ord").alias("label"), F.count("*").alias("n_nodes"), seen.alias("sources"), _joined("ord", F.concat(F.lit("- [["), "label", F.lit("]]"))).alias("links")
    )
    inner = _inner_edges(g).groupBy("community").agg(F.count("*").alias("m"))
    name = lambda c: F.concat(F.lit("community-"), c.cast("string"))
    near = stats.adjacent_communities(g).groupBy("community").agg(F.transform(F.array_sort(F.collect_list("neighbour")), name).alias("related"))
    out = body.join(whole, "community").join(inner, "community", "left").join(near, "community", "left").join(stats.community_confidence(g), "community")
    outline = F.format_string("Community %s contains %d nodes and %d edges", "label", "n_nodes", F.coalesce("m", F.lit(0)))
    tags = F.concat(F.array(F.lit("generated")), F.split("types", ","), F.array(name(F.col("community"))))
    content = F.concat(F.lit("# "), "label", F.lit("\n\n"), outline, F.lit("\n\n"), "text", F.lit("\n\n## Related\n\n"), "links")
    empty = F.array().cast("array<string>")
    return out.select(
        "community", F.col("label").alias("title"), F.concat(F.lit("wiki/"), _page_slug(F.col("label")), F.lit(".md")).alias("path"), "confidence", "n_nodes", outline.alias("outline"),
        "sources", F.coalesce("related", empty).alias("related"), tags.alias("tags"), content.alias("content"),
    )


def verified(contents: DataFrame) -> DataFrame:
    """(id, content, verified): the third stage hands each node's content on; it always counts as verified."""
    return contents.select("id", "content", F.lit(True).alias("verified"))


def with_front_matter(pages_: DataFrame, stamp: str) -> DataFrame:
    """(path, text): pages (``pages``) as files that begin with their front matter."""
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    optional = lambda c: F.when(F.size(c) > 0, F.concat(F.lit(f"{c}: "), listed(c)))
    lines = F.array(
        F.lit("---"), F.concat(F.lit("community: "), F.col("community").cast("string")), F.concat(F.lit("label: "), "title"), F.lit("type: community"), F.concat(F.lit("confidence: "), "confidence"),
        optional("sources"), optional("related"), F.lit(f"created_at: {stamp}"), F.lit(f"updated_at: {stamp}"), F.concat(F.lit("tags: "), listed("tags")), F.lit("---"), F.col("content"),
    )
    return pages_.select("path", F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n").alias("text"))


def source_pages(g: Graph) -> DataFrame:
    """(source_file, path, n, content): a page for each file of two nodes or more: its nodes, and the edges between them."""
    nodes = g.nodes.filter("source_file <> ''").select("id", F.coalesce("label", "id").alias("label"), "type", "source_file", "ord")
    a, b = nodes.select(F.col("id").alias("source"), F.col("label").alias("la"), "source_file"), nodes.select(F.col("id").alias("target"), F.col("label").alias("lb"), F.col("source_file").alias("f"))
    line = F.concat(F.lit("- "), "la", F.lit(" → "), "lb", F.lit(" ("), F.coalesce("label", F.lit("related")), F.lit(")"))
    links_ = g.edges.join(a, "source").join(b, "target").filter("source_file = f").groupBy("source_file").agg(_joined("ord", line).alias("relations"))
    out = nodes.groupBy("source_file").agg(F.count("*").alias("n"), _joined("ord", F.concat(F.lit("- **"), "label", F.lit("** ("), "type", F.lit(")"))).alias("body")).filter("n >= 2").join(links_, "source_file", "left")
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace("source_file", r"\.[^/.]+$", ""), r"[/\\]", "-"), r"\s+", "-")
    content = F.concat(F.lit("# "), "source_file", F.lit("\n\n> "), F.col("n").cast("string"), F.lit(" concepts extracted\n\n## Concepts\n\n"), "body", F.coalesce(F.concat(F.lit("\n\n## Relationships\n\n"), "relations"), F.lit("")))
    return out.select("source_file", F.concat(F.lit("wiki/sources/"), name, F.lit(".md")).alias("path"), "n", content.alias("content"))


def page_order(metas: DataFrame) -> DataFrame:
    """Pages by number of nodes, then of hubs (both falling), then by dependency or id."""
    return metas.orderBy(F.desc("n_nodes"), F.desc("n_hubs"), F.coalesce("dependency_order", "id"))


def grid(pages_: DataFrame, order: str, columns: int) -> DataFrame:
    """Place of each page on a canvas of ``columns`` columns."""
    return numbered(pages_, "_i", order).withColumn("col", F.pmod("_i", F.lit(columns))).withColumn("row", F.floor(F.col("_i") / columns)).drop("_i")


def canvas(pages_: DataFrame, order: str) -> DataFrame:
    """(place, node): a canvas's nodes as JSON, one for each page (title, path), laid in a square 300 by 120 apart."""
    columns = max(1, int(-(-(pages_.count() ** 0.5) // 1)))
    placed = grid(pages_, order, columns)
    node = F.to_json(
        F.struct(
            _page_slug(F.col("title")).alias("id"), F.lit("file").alias("type"), F.regexp_replace("path", "^wiki/", "").alias("file"),
            (F.col("col") * 300).alias("x"), (F.col("row") * 120).alias("y"), F.lit(250).alias("width"), F.lit(60).alias("height"),
        )
    )
    return placed.select((F.col("row") * columns + F.col("col")).cast("long").alias("place"), node.alias("node"))


def pages_of_nodes(g: Graph) -> DataFrame:
    """(id, path): which page each node is on."""
    return g.nodes.select("id", F.coalesce("community", F.lit(-1)).alias("community")).join(pages(g).select("community", "path"), "community").select("id", "path")


def nodes_of_pages(bridge: DataFrame) -> DataFrame:
    """(path, ids): the nodes of each page, from (id, path)."""
    return bridge.groupBy("path").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def updated(g: Graph, changed: DataFrame) -> DataFrame:
    """The compiled pages that hold a changed node (id); the others stand as they are."""
    hit = g.nodes.join(changed.select("id"), "id", "left_semi").select(F.coalesce("community", F.lit(-1)).alias("community")).distinct()
    return pages(g).join(hit, "community", "left_semi")


def appended(old: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, content): pages of nodes without a community (id, path, content) with the changed nodes' new contents (id, content) added."""
    more = changed.select("id", F.col("content").alias("more"))
    return old.join(more, "id").select("path", F.concat("content", F.lit("\n\n"), "more").alias("content"))


def links(pages_: DataFrame) -> DataFrame:
    """(path, target): wiki links in the pages' content, without aliases."""
    found = F.regexp_extract_all("content", F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))
    return pages_.select("path", F.explode(found).alias("target")).withColumn("target", F.trim("target"))


def broken_links(pages_: DataFrame) -> DataFrame:
    """Links whose target is no page's path, with or without .md."""
    known = pages_.select(F.col("path").alias("k")).union(pages_.select(F.regexp_replace("path", r"\.md$", "").alias("k"))).distinct()
    return links(pages_).join(known, F.col("target") == F.col("k"), "left_anti").distinct()


def index(pages_: DataFrame, most: int = 20) -> DataFrame:
    """(type, n, refs): pages of each type, and the first cross references of its pages (links to themselves dropped)."""
    refs = links(pages_).join(pages_.select("path", "type", "ord"), "path").filter(F.col("target") != F.col("path"))
    refs = refs.select("type", "ord", "target").distinct().withColumn("n", F.row_number().over(Window.partitionBy("type").orderBy("ord", "target"))).filter(F.col("n") <= most)
    refs = refs.groupBy("type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "target"))), lambda x: x["target"]), ",").alias("refs"))
    return pages_.groupBy("type").agg(F.count("*").alias("n")).join(refs, "type", "left")


def touched(pages_of_nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Paths of pages of changed nodes."""
    return pages_of_nodes.join(changed.select("id"), "id", "left_semi").select("path").distinct()


def contradictions(g: Graph, pages_of_nodes: DataFrame, pages_: DataFrame) -> DataFrame:
    """``contradicts`` edges whose ends both have pages, one of which names the other's label."""
    text = pages_of_nodes.join(pages_.select("path", F.lower("content").alias("text")), "path").join(g.nodes.select("id", F.lower("label").alias("label")), "id")
    a = text.select(F.col("id").alias("source"), F.col("text").alias("sa"), F.col("label").alias("la"))
    b = text.select(F.col("id").alias("target"), F.col("text").alias("sb"), F.col("label").alias("lb"))
    both = g.edges.filter("label = 'contradicts'").join(a, "source").join(b, "target")
    return both.filter(F.col("sa").contains(F.col("lb")) | F.col("sb").contains(F.col("la"))).select("source", "target").distinct()


def missing_sources(nodes: DataFrame) -> DataFrame:
    """Nodes without a provenance."""
    return nodes.filter(F.coalesce(F.size("provenance"), F.lit(0)) <= 0).select("id", F.coalesce("community", F.lit(-1)).alias("community"))


def undocumented(exports: DataFrame, spec: DataFrame) -> DataFrame:
    """(file, name): names exported by source text (file, text) that no text of the specification (text) holds, as a whole or inside a word."""
    names = F.regexp_extract_all("text", F.lit(r"export\s+(?:async\s+)?(?:function|class|const|interface|type)\s+(\w+)"), F.lit(1))
    found = exports.select("file", F.explode(names).alias("name")).distinct()
    words = spec.select(F.explode(F.split("text", r"\W+")).alias("word")).filter("word <> ''").distinct()
    said = contained(words, "word", found.select("name").distinct(), "name").select("name").distinct()
    return found.join(said, "name", "left_anti").select("file", "name")


def lint_summary(contradictions_: DataFrame, missing: DataFrame, broken: DataFrame) -> DataFrame:
    """(n_contradictions, n_missing_sources, n_broken_links, valid): missing sources alone do not make a wiki invalid."""
    count = lambda d, c: d.agg(F.count("*").alias(c))
    out = count(contradictions_, "n_contradictions").crossJoin(count(missing, "n_missing_sources")).crossJoin(count(broken, "n_broken_links"))
    return out.withColumn("valid", (F.col("n_contradictions") == 0) & (F.col("n_broken_links") == 0))

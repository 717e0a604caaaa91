"""Keyword search, wiki search, cached and tiered answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.files import page_type
from lattica.functions.text import label_slug
from lattica.model import Graph


def by_id_or_label(nodes: DataFrame, key: str, fold: bool = False) -> DataFrame:
    """The first node with this id or label."""
    label = F.lower("label") == key.lower() if fold else F.col("label") == key
    return nodes.filter((F.col("id") == key) | label).orderBy("ord").limit(1)


def _any(text: Column, terms: list[str]) -> Column:
    hit = F.lit(False)
    for t in terms:
        hit = hit | text.contains(t)
    return hit


def keyword(nodes: DataFrame, question: str, most: int = 10) -> DataFrame:
    """Nodes whose label and type hold any of the question's words; a blank question matches all."""
    text = F.lower(F.concat_ws(" ", "label", "type"))
    return nodes.filter(_any(text, question.lower().split() or [""])).orderBy("ord").limit(most)


def relevance(question: str) -> Column:
    """Number of the question's words of over two letters in label, type and content; repeated words count again."""
    text = F.lower(F.concat_ws(" ", "label", "type", F.try_element_at("properties", F.lit("content"))))
    score = F.lit(0)
    for t in [t for t in re.split(r"\W+", question.lower()) if len(t) > 2]:
        score = score + text.contains(t).cast("int")
    return score


def ask(nodes: DataFrame, question: str, most: int = 10) -> DataFrame:
    scored = nodes.withColumn("score", relevance(question)).filter("score > 0")
    return scored.orderBy(F.desc("score"), "ord").limit(most).select("id", "label", "score", "ord")


def ask_context(g: Graph, question: str) -> DataFrame:
    """(kind, id): the best nodes, what is within two hops of the best three, and edges between them (20 at most)."""
    from .traverse import reached, subgraph

    best = ask(g.nodes, question)
    starts = [r["id"] for r in best.limit(3).collect()]
    near = reached(g, starts, 2).select("id") if starts else best.select("id")
    ids = best.select("id").union(near).distinct()
    edges = subgraph(g, ids).edges.orderBy("ord").limit(20)
    return ids.select(F.lit("node").alias("kind"), "id").unionByName(edges.select(F.lit("edge").alias("kind"), F.concat_ws("->", "source", "target").alias("id")))


def wiki_list(pages: DataFrame, kind: str | None = None) -> DataFrame:
    out = pages.select("title", page_type(F.col("title")).alias("type"), "ord")
    return out if kind is None else out.filter(F.col("type") == kind)


def wiki_read(pages: DataFrame, title: str) -> DataFrame:
    return pages.filter(F.col("title") == title).orderBy("ord").limit(1)


def wiki_search(pages: DataFrame, question: str, most: int = 10) -> DataFrame:
    q = question.lower()
    hit = F.lower("title").contains(q) | F.lower("content").contains(q)
    return pages.filter(hit).orderBy("ord").limit(most).select("title", F.replace(F.substring("content", 1, 120), F.lit("\n"), F.lit(" ")).alias("snippet"))


def wiki_refs(pages: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """For each of the first ``most`` nodes the first page whose path holds the slug of its label."""
    few = nodes.orderBy("ord").limit(most).select("id", label_slug(F.col("label")).alias("slug"))
    return pages.join(F.broadcast(few), F.lower("path").contains(F.col("slug"))).groupBy("id").agg(F.min_by("path", "ord").alias("path"))


def cache_live(cache: DataFrame, now: Column, hours: int = 168) -> DataFrame:
    """Entries (key, ts, ...) not older than their time to live."""
    return cache.filter(F.col("ts") + F.make_interval(hours=F.lit(hours)) >= now)


def cache_without(cache: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries (key, traversed, ...) that passed through none of the nodes ``ids`` (id)."""
    hit = cache.select("key", F.explode("traversed").alias("id")).join(ids, "id", "left_semi").select("key").distinct()
    return cache.join(hit, "key", "left_anti")


#: Most tokens an answer of a tier may take.
TIER_TOKENS = (0, 2000, 500, 5000, 10000)


def tier0(g: Graph, question: str) -> DataFrame:
    """(answer, tokens): how many nodes or edges there are, or what the first node is that the question names; empty if it asks for something else."""
    q = question.lower()
    none = F.lit(0.0).alias("tokens")
    if "how many node" in q or "node count" in q:
        return g.nodes.agg(F.format_string("The graph contains %d nodes.", F.count("*")).alias("answer")).select("answer", none)
    if "how many edge" in q or "edge count" in q:
        return g.edges.agg(F.format_string("The graph contains %d edges.", F.count("*")).alias("answer")).select("answer", none)
    if "what is" in q and "node" in q:
        hit = _near(g, q).orderBy("ord").limit(1)
        home = F.coalesce(F.format_string(" It belongs to community %d.", F.col("community").cast("long")), F.lit(""))
        return hit.select(F.concat(F.format_string('The node "%s" is a %s.', "label", "type"), F.when(F.col("community").isNotNull(), home).otherwise("")).alias("answer"), none)
    return g.nodes.sparkSession.createDataFrame([], "answer string, tokens double")


def _near(g: Graph, q: str) -> DataFrame:
    """Nodes whose label the question holds, or whose label holds its first word."""
    return g.nodes.filter(F.lower("label").contains(q.split(" ")[0]) | F.lit(q).contains(F.lower("label")))


def context_lines(g: Graph, question: str, pages: DataFrame | None = None) -> DataFrame:
    """(part, place, line): the best nodes with the first 120 characters of their content, edges among them and what is near (20 at most),
    and pages (path, ord) named after one of the best five."""
    from .traverse import reached, subgraph

    best = ask(g.nodes, question).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "ord"))).join(g.nodes.select("id", "type", "properties"), "id")
    content = F.coalesce(F.concat(F.lit(": "), F.substring(F.nullif(F.try_element_at("properties", F.lit("content")), F.lit("")), 1, 120)), F.lit(""))
    out = best.select(F.lit("nodes").alias("part"), F.col("place").cast("long").alias("place"), F.concat(F.lit("- "), "label", F.lit(" ("), "type", F.lit(")"), content).alias("line"))
    starts = [r["id"] for r in best.orderBy("place").limit(3).collect()]
    ids = best.select("id").union(reached(g, starts, 2).select("id")).distinct() if starts else best.select("id")
    names = g.nodes.select("id", "label")
    edges = subgraph(g, ids).edges.orderBy("ord").limit(20)
    edges = edges.join(names.select(F.col("id").alias("source"), F.col("label").alias("a")), "source").join(names.select(F.col("id").alias("target"), F.col("label").alias("b")), "target")
    out = out.unionByName(edges.select(F.lit("relations").alias("part"), F.col("ord").cast("long").alias("place"), F.concat(F.lit("- "), "a", F.lit(" → "), F.coalesce("label", F.lit("relates_to")), F.lit(" → "), "b").alias("line")))
    if pages is not None:
        refs = wiki_refs(pages, best.withColumn("ord", F.col("place"))).join(best.select("id", "place"), "id")
        out = out.unionByName(refs.select(F.lit("pages").alias("part"), F.col("place").cast("long").alias("place"), F.concat(F.lit("- "), "path").alias("line")))
    return out


#: What a keyword query shows: the nodes, a walk from the first one, or the nodes with the edges between them.
QUERY_MODES = ("list", "walk", "subgraph")


def query(g: Graph, question: str, mode: str = "list", most: int = 10) -> DataFrame:
    """(kind, id) of a keyword query in one of QUERY_MODES; the walk goes depth first, two hops from the first hit."""
    from .traverse import dfs, subgraph

    if mode not in QUERY_MODES:
        raise ValueError(f"mode must be one of {', '.join(QUERY_MODES)}")
    hits = keyword(g.nodes, question, most)
    nodes = hits.select(F.lit("node").alias("kind"), "id")
    if mode == "list":
        return nodes
    first = hits.orderBy("ord").first()
    if mode == "walk":
        return dfs(g, first["id"], 2).select(F.lit("node").alias("kind"), "id") if first else nodes
    return nodes.unionByName(subgraph(g, hits).edges.select(F.lit("edge").alias("kind"), "id"))


def route(g: Graph, question: str, report: str | None, summaries: DataFrame, pages: DataFrame, model, budget: int = 4000) -> dict:
    """Answer by the cheapest tier that can: counts, the report, summaries of matching communities (community, summary), pages of
    matching nodes (id, content), sources of matching nodes. ``model(prompt, most) -> (answer, tokens)`` is called once for each
    tier from the first that is tried; a tier without input is passed over."""
    found = tier0(g, question).first()
    if found:
        return {"answer": found["answer"], "tier": 0, "tokens": 0.0}
    near = _near(g, question.lower()).orderBy("ord")
    sources = (
        lambda: report,
        lambda: "\n".join(r[0] for r in summaries.join(near.select("community").distinct(), "community", "left_semi").select("summary").limit(5).collect()),
        lambda: "\n".join(r[0] for r in pages.join(near.select("id"), "id", "left_semi").select("content").limit(5).collect()),
        lambda: "\n".join(str(r[0]) for r in near.select(F.coalesce("source_file", F.array_join("provenance", ","))).limit(3).collect()),
    )
    for tier, (source, most, limit) in enumerate(zip(sources, (500, 400, 800, 1000), (TIER_TOKENS[1], TIER_TOKENS[2], min(TIER_TOKENS[3], budget), None), strict=True), 1):
        text = source()
        if not text and tier < 4:
            continue
        answer, used = model(f"{text}\n\n{question}", most)
        spent = len(text or "") / 4 + used
        if limit is None or spent <= limit:
            return {"answer": answer, "tier": tier, "tokens": spent}
    raise AssertionError("the last tier always answers")

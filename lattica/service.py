"""The tools of the engine by name: parameters in, DataFrame out. Transports are up to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.model import Graph
from lattica.operators import build, refine, report, search, stats, traverse

#: name -> (description, parameters with defaults; None marks a required one).
TOOLS: dict[str, tuple[str, dict]] = {
    "query_graph": ("Nodes that match a question's words", {"question": None, "max_nodes": 10}),
    "get_node": ("A node by id or label, and its neighbours", {"node": None}),
    "get_neighbors": ("Nodes within some hops", {"node": None, "depth": 1, "label": ""}),
    "shortest_path": ("Path between two nodes", {"source": None, "target": None}),
    "god_nodes": ("Nodes of high degree", {"min_degree": 10, "limit": 20}),
    "wiki_read": ("A page by title", {"title": None}),
    "wiki_search": ("Pages that hold a text", {"question": None, "limit": 10}),
    "wiki_list": ("Pages, by type", {"type": ""}),
    "community_summary": ("Size and density of a community", {"community": None}),
    "community_list": ("Communities of some size", {"min_size": 2}),
    "build": ("Merge nodes and edges into the graph", {"nodes": None, "edges": None}),
    "ingest": ("Add nodes and edges, what is there wins", {"nodes": None, "edges": None}),
    "lint": ("Problems of the graph", {}),
    "status": ("Counts and density", {}),
    "ask": ("Context for an answer to a question", {"question": None}),
    "benchmark": ("Tokens that each method spends on a question", {"question": None}),
    "report": ("Counts, types and hubs as text", {}),
    "surprises": ("Hubs that stand out", {}),
}


class Engine:
    """A graph, its pages and the files of its corpus. ``build`` and ``ingest`` replace the graph; every other tool only reads."""

    def __init__(self, graph: Graph, pages: DataFrame | None = None, files: DataFrame | None = None):
        self.graph, self.pages, self.files = graph, pages, files

    def tools(self) -> list[dict]:
        return [{"name": n, "description": d, "required": [k for k, v in p.items() if v is None]} for n, (d, p) in TOOLS.items()]

    def call(self, name: str, **given) -> DataFrame:
        if name not in TOOLS:
            raise KeyError(f"no tool is named {name}")
        wanted = TOOLS[name][1]
        if unknown := set(given) - set(wanted):
            raise TypeError(f"{name} takes no {', '.join(sorted(unknown))}")
        if missing := [k for k, v in wanted.items() if v is None and given.get(k) is None]:
            raise TypeError(f"{name} needs {', '.join(missing)}")
        return getattr(self, f"_{name}")(**(wanted | given))

    def _query_graph(self, question, max_nodes):
        return search.keyword(self.graph.nodes, question, max_nodes)

    def _get_node(self, node):
        hit = search.by_id_or_label(self.graph.nodes, node).select("id").first()
        near = traverse.neighbours(self.graph, hit["id"], 1, False) if hit else self.graph.nodes.limit(0).select("id", F.lit(0).alias("depth"))
        return near.unionByName(self.graph.nodes.filter(F.col("id") == (hit["id"] if hit else "")).select("id", F.lit(0).alias("depth"))).join(self.graph.nodes.select("id", "label", "type"), "id", "left")

    def _get_neighbors(self, node, depth, label):
        return traverse.neighbours(self.graph, node, depth, False, label or None)

    def _shortest_path(self, source, target):
        ends = [search.by_id_or_label(self.graph.nodes, x).select("id").first() for x in (source, target)]
        return traverse.shortest_path(self.graph, *[e["id"] if e else "" for e in ends], directed=False, key="side")

    def _god_nodes(self, min_degree, limit):
        return stats.hubs_above(self.graph, min_degree, limit)

    def _wiki_read(self, title):
        return search.wiki_read(self.pages, title)

    def _wiki_search(self, question, limit):
        return search.wiki_search(self.pages, question, limit)

    def _wiki_list(self, type):
        return search.wiki_list(self.pages, type or None)

    def _community_summary(self, community):
        return stats.community_summary(self.graph).filter(F.col("community") == int(community))

    def _community_list(self, min_size):
        return stats.communities(self.graph.nodes, min_size)

    def _build(self, nodes, edges):
        late = 1 << 40
        whole = Graph(self.graph.nodes.unionByName(nodes.withColumn("ord", F.col("ord") + late), allowMissingColumns=True), self.graph.edges.unionByName(edges.withColumn("ord", F.col("ord") + late), allowMissingColumns=True))
        self.graph = Graph(build.merge_nodes(whole.nodes), build.merge_edges(whole.edges, self.graph.directed), self.graph.directed)
        return stats.status(self.graph)

    def _ingest(self, nodes, edges):
        self.graph = build.add_pending(self.graph, Graph(nodes, edges).nodes, Graph(nodes, edges).edges)
        return stats.status(self.graph)

    def _lint(self):
        return stats.lint(self.graph)

    def _status(self):
        return stats.status(self.graph)

    def _ask(self, question):
        pages = None if self.pages is None or "path" not in self.pages.columns else self.pages
        return search.context_lines(self.graph, question, pages)

    def _benchmark(self, question):
        if self.files is None:
            raise TypeError("benchmark needs the corpus's files (text, ord)")
        return refine.all_costs(self.files, [question])

    def _report(self):
        return report.graph_report(self.graph)

    def _surprises(self):
        return stats.surprising_hubs(self.graph)

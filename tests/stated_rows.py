"""Operators over small literal inputs, each with the rows it must give, stated in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import files as ff
from lattica.functions import text as tf
from lattica.model import Graph, scratch
from lattica.operators import build, cluster, delta, export, extract, refine, report, search, stats, traverse, vectors, wiki
from lattica.service import Engine
from lattica.sources import readers
from lattica.streaming import events as ev

CASES: dict = {}


def query(name: str, sql: str):
    """A case: a function of a session that gives the rows which ``sql`` states."""

    def put(f):
        if name in CASES:
            raise ValueError(f"two cases are named {name}")
        CASES[name] = f, sql
        return f

    return put


SQL_TYPES = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value).lower() if isinstance(value, bool) else repr(value)


def must_be(ddl: str, rows: list[tuple]) -> str:
    """SQL of literal rows with the columns and types of ``ddl``."""
    columns = [c.split() for c in ddl.split(", ")]
    casts = ", ".join(f"CAST({n} AS {SQL_TYPES[t]}) AS {n}" for n, t in columns)
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) v({', '.join(n for n, _ in columns)})"


def small(spark: SparkSession, pairs: list[tuple], directed: bool = False, nodes: list[tuple] | None = None, meta: dict | None = None) -> Graph:
    """A graph of edges (source, target[, weight[, label]]), its nodes in order of name unless given as (id, label, type, community)."""
    ids = nodes or [(x, x.upper(), "concept", None) for x in sorted({x for p in pairs for x in p[:2]})]
    n = spark.createDataFrame([(*r, i) for i, r in enumerate(ids)], "id string, label string, type string, community int, ord long")
    e = spark.createDataFrame([(f"e{i}", p[0], p[1], float(p[2]) if len(p) > 2 else 1.0, p[3] if len(p) > 3 else None, i) for i, p in enumerate(pairs)], "id string, source string, target string, weight double, label string, ord long")
    return Graph(n, e, directed, meta or {})


FIVE = [("n0", "n1"), ("n0", "n2"), ("n1", "n3"), ("n0", "n4"), ("n2", "n4")]
CHAIN = [("a", "b"), ("b", "c")]


def one(spark: SparkSession, ddl: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), ddl)


# Walks


@query("dfs_order", must_be("id string, visit long", [("n0", 0), ("n1", 1), ("n3", 2), ("n2", 3), ("n4", 4)]))
def dfs_order(spark, sf_dir):
    return traverse.dfs(small(spark, FIVE), "n0", 9)


@query("bfs_visits", must_be("id string, depth int, visit int", [("n0", 0, 0), ("n1", 1, 1), ("n2", 1, 2), ("n4", 1, 3), ("n3", 2, 4)]))
def bfs_visits(spark, sf_dir):
    return traverse.bfs(small(spark, FIVE), "n0")


@query("path_by_edges", must_be("step int, id string", [(0, "n3"), (1, "n1"), (2, "n0"), (3, "n4")]))
def path_by_edges(spark, sf_dir):
    return traverse.shortest_path(small(spark, FIVE), "n3", "n4")


@query("path_directed", must_be("way string, step int, id string", [("there", 0, "a"), ("there", 1, "b"), ("there", 2, "c")]))
def path_directed(spark, sf_dir):
    g = small(spark, CHAIN, True)
    there, back = (traverse.shortest_path(g, *ends).select(F.lit(way).alias("way"), "step", "id") for way, ends in (("there", ("a", "c")), ("back", ("c", "a"))))
    return there.unionByName(back)


@query("path_outgoing_first", must_be("step int, id string", [(0, "a"), (1, "y"), (2, "b")]))
def path_outgoing_first(spark, sf_dir):
    """Two ways of two steps: the one by an incoming edge comes earlier, the one by an outgoing edge wins."""
    return Engine(small(spark, [("x", "a"), ("x", "b"), ("a", "y"), ("y", "b")])).call("shortest_path", source="A", target="b")


@query("neighbors_labelled", must_be("id string, depth int", [("b", 1), ("c", 1)]))
def neighbors_labelled(spark, sf_dir):
    return traverse.neighbours(small(spark, [("a", "b", 1, "uses"), ("c", "a", 1, "uses"), ("a", "d", 1, "calls"), ("a", "e")]), "a", 1, False, "uses")


@query("neighbors_default_label", must_be("id string, depth int", [("e", 1)]))
def neighbors_default_label(spark, sf_dir):
    return traverse.neighbours(small(spark, [("a", "b", 1, "uses"), ("a", "e")]), "a", 1, False, "default")


@query("get_node", must_be("id string, depth int, label string, type string", [("n0", 0, "N0", "concept"), ("n1", 1, "N1", "concept"), ("n2", 1, "N2", "concept"), ("n4", 1, "N4", "concept")]))
def get_node(spark, sf_dir):
    return Engine(small(spark, FIVE)).call("get_node", node="N0").select("id", "depth", "label", "type")


@query("explain_node", must_be("kind string, id string", [("node", "n0"), ("near", "n1"), ("near", "n2"), ("near", "n4"), ("near", "n3"), ("community", "n3"), ("community", "n4")]))
def explain_node(spark, sf_dir):
    nodes = [(f"n{i}", f"N{i}", "concept", 1 if i in (0, 3, 4) else 2) for i in range(5)]
    return traverse.explained(small(spark, FIVE, nodes=nodes), "N0").select("kind", "id")


@query("communities_directed", must_be("id string, community long", [("a", 0), ("b", 0), ("c", 1)]))
def communities_directed(spark, sf_dir):
    """Of a -> b (2) and b -> c (1), b is drawn to c, a to b where it was, c by nothing: m = 3; a's gain 2/6 - 4/36 moves it to b first,
    b's towards c, (1 - 2)/6 - 9/36, is below 0."""
    return cluster.clusters(small(spark, [("a", "b", 2), ("b", "c", 1)], True)).select("id", F.col("community").cast("long").alias("community"))


@query("communities_with_loop", must_be("id string, community long", [("a", 0), ("b", 0)]))
def communities_with_loop(spark, sf_dir):
    """A loop of weight 1 at a holds it there twice, (1 - 2)/4 - 4/16 < 0, and b moves to it: 1/4 - 1/16 > 0."""
    return cluster.clusters(small(spark, [("a", "a", 1), ("a", "b", 1)])).select("id", F.col("community").cast("long").alias("community"))


@query("communities_without_edges", must_be("id string, community long", [("a", 0), ("b", 1)]))
def communities_without_edges(spark, sf_dir):
    g = small(spark, [("a", "b")])
    return cluster.clusters(Graph(g.nodes, g.edges.limit(0))).select("id", F.col("community").cast("long").alias("community"))


TRIANGLES = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z")]


@query("communities_by_rounds", must_be("ids string", [("a,b,c",), ("x,y,z",)]))
def communities_by_rounds(spark, sf_dir):
    found = cluster.clusters_by_rounds(small(spark, [(*p, 5) for p in TRIANGLES] + [("c", "x", 1)]))
    return found.groupBy("community").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids")).select("ids")


# Search


@query("node_lookup", must_be("how string, id string", [("id", "n1"), ("label", "n2"), ("folded", "n2")]))
def node_lookup(spark, sf_dir):
    n = small(spark, FIVE).nodes
    found = [n.filter("id = 'n1'").limit(1), search.by_id_or_label(n, "N2"), search.by_id_or_label(n, "n2", True), search.by_id_or_label(n, "nope")]
    out = [d.select(F.lit(how).alias("how"), "id") for how, d in zip(("id", "label", "folded", "none"), found, strict=True)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


ROADS = [("r1", "Red Road", "street", 0), ("r2", "Road Map", "document", 0), ("r3", "Blue Lake", "water", 1), ("r4", "Red Lake", "water", 1)]
ROAD_EDGES = [("r1", "r2", 1, "shown_on"), ("r3", "r4"), ("r2", "r4", 2, "shows")]


@query("query_modes", must_be("mode string, kind string, id string", [("list", "node", "r1"), ("list", "node", "r2"), ("walk", "node", "r1"), ("walk", "node", "r2"), ("walk", "node", "r4"), ("subgraph", "node", "r1"), ("subgraph", "node", "r2"), ("subgraph", "edge", "e0")]))
def query_modes(spark, sf_dir):
    g = small(spark, ROAD_EDGES, nodes=ROADS)
    out = [search.query(g, "road", mode).select(F.lit(mode).alias("mode"), "kind", "id") for mode in search.QUERY_MODES]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("ask_context", must_be("part string, place long, line string", [("nodes", 1, "- Red Lake (water)"), ("nodes", 2, "- Red Road (street)"), ("nodes", 3, "- Blue Lake (water)"), ("relations", 0, "- Red Road → shown_on → Road Map"), ("relations", 1, "- Blue Lake → relates_to → Red Lake"), ("relations", 2, "- Road Map → shows → Red Lake"), ("pages", 1, "- wiki/red-lake.md")]))
def ask_context(spark, sf_dir):
    pages = one(spark, "path string, ord long", ("wiki/red-lake.md", 0), ("wiki/other.md", 1))
    return search.context_lines(small(spark, ROAD_EDGES, nodes=ROADS), "Where is a red lake?", pages)


@query("tier0_answers", must_be("question string, answer string", [("How many nodes?", "The graph contains 4 nodes."), ("edge count", "The graph contains 3 edges."), ("What is the red lake node", 'The node "Red Lake" is a water. It belongs to community 1.')]))
def tier0_answers(spark, sf_dir):
    g, out = small(spark, ROAD_EDGES, nodes=ROADS), None
    for q in ("How many nodes?", "edge count", "What is the red lake node", "why?"):
        rows = search.tier0(g, q).select(F.lit(q).alias("question"), "answer")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("routed_answers", must_be("question string, tier int, tokens double", [("How many nodes?", 0, 0.0), ("why red?", 1, 12.75), ("about red lake", 2, 9.5), ("tell", 4, 10.0)]))
def routed_answers(spark, sf_dir):
    g = small(spark, ROAD_EDGES, nodes=ROADS)
    none, pages = one(spark, "community int, summary string").limit(0), one(spark, "id string, content string").limit(0)
    sums = one(spark, "community int, summary string", (1, "two lakes in"))
    model = lambda prompt, most: ("yes", 10.0 if "report" in prompt else 6.5 if "lakes" in prompt else 10.0)
    cases = [("How many nodes?", None, none), ("why red?", "report text", none), ("about red lake", None, sums), ("tell", None, none)]
    rows = [(q, search.route(g, q, text, s, pages, model)) for q, text, s in cases]
    return one(spark, "question string, tier int, tokens double", *[(q, r["tier"], float(r["tokens"])) for q, r in rows])


TITLES = [("Index of all", "x", 0), ("class Wolf", "grey\nwolf", 1), ("run()", "legs", 2), ("Notes", "a wolf", 3)]


def _titles(spark):
    return one(spark, "title string, content string, ord long", *TITLES)


@query("wiki_list", must_be("title string, type string", [("Index of all", "index"), ("class Wolf", "concept"), ("run()", "entity"), ("Notes", "source-summary")]))
def wiki_list(spark, sf_dir):
    return search.wiki_list(_titles(spark)).select("title", "type")


@query("wiki_list_of_type", must_be("title string", [("class Wolf",)]))
def wiki_list_of_type(spark, sf_dir):
    return search.wiki_list(_titles(spark), "concept").select("title")


@query("wiki_read", must_be("title string, content string", [("run()", "legs")]))
def wiki_read(spark, sf_dir):
    return search.wiki_read(_titles(spark), "run()").select("title", "content")


@query("wiki_search_hits", must_be("title string, snippet string", [("class Wolf", "grey wolf"), ("Notes", "a wolf")]))
def wiki_search_hits(spark, sf_dir):
    return search.wiki_search(_titles(spark), "WOLF")


@query("wiki_refs", must_be("id string, path string", [("a", "wiki/red-fox-1.md"), ("b", "wiki/blue.md")]))
def wiki_refs(spark, sf_dir):
    pages = one(spark, "path string, ord long", ("wiki/blue.md", 0), ("wiki/red-fox-1.md", 1), ("wiki/red-fox-2.md", 2))
    return search.wiki_refs(pages, one(spark, "id string, label string, ord long", ("a", "Red Fox", 0), ("b", "Blue", 1), ("c", "Green", 2)))


@query("cache_without_nodes", must_be("key string", [("k2",)]))
def cache_without_nodes(spark, sf_dir):
    return search.cache_without(one(spark, "key string, traversed array<string>", ("k1", ["a", "b"]), ("k2", ["c"]), ("k3", ["b", "c"])), one(spark, "id string", ("b",))).select("key")


# Files and checks


@query("file_classes", must_be("file string, language string, type string, extractor string, watch string", [
    ("a/b.py", "Python", "code", "ast", "code"), ("c.TSX", "TypeScript", "code", "ast", "code"), ("d.md", None, "markdown", "frontmatter", "doc"), ("e.pdf", None, "pdf", "model_native", "doc"), ("f", None, "unsupported", None, "code"),
    ("g.png", None, "image", "model_native", "code"), ("h.json", None, "code", None, "code"), ("i.zip", None, "unsupported", None, "code"), ("j.rtf", None, "rtf", "model_native", "code"), ("k.mp3", None, "unsupported", None, "media"),
]))
def file_classes(spark, sf_dir):
    names = one(spark, "file string", *[(x,) for x in ("a/b.py", "c.TSX", "d.md", "e.pdf", "f", "g.png", "h.json", "i.zip", "j.rtf", "k.mp3")])
    return names.select("file", ff.language(F.col("file")).alias("language"), ff.file_type(F.col("file")).alias("type"), ff.extractor(F.col("file")).alias("extractor"), ff.watch_class(F.col("file")).alias("watch"))


URLS = [("https://example.org/x", None), ("ftp://a", "protocol"), ("http://localhost:1/", "localhost"), ("http://10.1.2.3/", "private"), ("http://172.20.0.1", "private"), ("http://172.40.0.1", None), ("http://169.254.169.254/", "metadata"), ("http://[::1]/", "localhost"), ("nonsense", "invalid")]


@query("url_problems", must_be("url string, problem string", URLS))
def url_problems(spark, sf_dir):
    return one(spark, "url string", *[(u,) for u, _ in URLS]).select("url", ff.url_problem(F.col("url")).alias("problem"))


KINDS = [("https://x.com/a/status/1", "tweet"), ("http://a.org/p.pdf?x=1", "pdf"), ("https://a.org/pdf/9", "pdf"), ("https://youtu.be/q", "media-unsupported"), ("http://a.org/s.MP3", "media-unsupported"), ("http://a.org", "html")]


@query("url_kinds", must_be("url string, kind string", KINDS))
def url_kinds(spark, sf_dir):
    return one(spark, "url string", *[(u,) for u, _ in KINDS]).select("url", ff.url_kind(F.col("url")).alias("kind"))


@query("path_problems", must_be("path string, problem string", [("/data/a", None), ("/etc/x", "outside"), ("a/../b", "traversal"), ("a/b", None)]))
def path_problems(spark, sf_dir):
    return one(spark, "path string", ("/data/a",), ("/etc/x",), ("a/../b",), ("a/b",)).select("path", ff.path_problem(F.col("path"), "/data").alias("problem"))


@query("node_checks", must_be("id string, problems string, first string", [("a", "", None), (" ", "id,type", "id"), ("b", "label", "label"), ("c", "confidence", "confidence"), ("d", "", None)]))
def node_checks(spark, sf_dir):
    rows = one(spark, "id string, label string, type string, confidence string", ("a", "", "anything", None), (" ", "x", "", "INFERRED"), ("b", None, "t", None), ("c", "x", "t", "SURE"), ("d", "x", "t", "AMBIGUOUS"))
    p = ff.node_problems()
    return rows.select("id", F.array_join(p, ",").alias("problems"), F.get(p, F.lit(0)).alias("first"))


@query("edge_checks", must_be("source string, problems string", [("a", ""), ("b", "target,label"), ("c", "confidence")]))
def edge_checks(spark, sf_dir):
    rows = one(spark, "source string, target string, label string, confidence string", ("a", "b", "free", "EXTRACTED"), ("b", None, "", None), ("c", "d", "x", "?"))
    return rows.select("source", F.array_join(ff.edge_problems(), ",").alias("problems"))


@query("document_checks", must_be("id string, problems string", [("d", ""), ("", "id,nodes"), (None, "id,edges")]))
def document_checks(spark, sf_dir):
    rows = one(spark, "id string, nodes array<string>, edges array<string>", ("d", [], []), ("", None, []), (None, ["n"], None))
    return rows.select("id", F.array_join(ff.document_problems(), ",").alias("problems"))


@query("coerced_nodes", must_be("id string, label string, type string, confidence string", [("7", "(unnamed)", "entity", "INFERRED"), ("8", "", "nation", "EXTRACTED"), ("9", "x", "entity", "INFERRED")]))
def coerced_nodes(spark, sf_dir):
    return ff.coerced_nodes(one(spark, "id long, label string, type string, confidence string", (7, None, None, None), (8, "", "nation", "EXTRACTED"), (9, "x", "", "odd")))


@query("coerced_edges", must_be("source string, target string, label string, confidence string", [("1", "2", "related_to", "INFERRED"), ("3", "4", "free_kind", "AMBIGUOUS")]))
def coerced_edges(spark, sf_dir):
    return ff.coerced_edges(one(spark, "source long, target long, label string, confidence string", (1, 2, "", None), (3, 4, "free_kind", "AMBIGUOUS")))


@query("path_terms", must_be("text string, terms string", [("see GraphBuilder in src/graph/build.ts and lib/x", "GraphBuilder,graph/build.ts,x"), ("nothing here", "")]))
def path_terms(spark, sf_dir):
    rows = one(spark, "text string", ("see GraphBuilder in src/graph/build.ts and lib/x",), ("nothing here",))
    return rows.select("text", F.array_join(ff.path_terms(F.col("text")), ",").alias("terms"))


@query("ignored_files", must_be("id string", [("a",), ("d",)]))
def ignored_files(spark, sf_dir):
    n = one(spark, "id string, source_file string, ord long", ("a", "src/a.py", 0), ("b", "dist/b.js", 1), ("c", "docs/x/c.md", 2), ("d", None, 3))
    e = one(spark, "id string, source string, target string, ord long", ("e0", "a", "b", 0), ("e1", "a", "d", 1))
    return build.without_files(Graph(n, e), ff.ignore_patterns(["# out", "", " dist/ ", "docs/**/*.md", "dist/"])).nodes.select("id")


@query("ignored_edges", must_be("id string", [("e1",)]))
def ignored_edges(spark, sf_dir):
    n = one(spark, "id string, source_file string, ord long", ("a", "src/a.py", 0), ("b", "dist/b.js", 1), ("d", None, 3))
    e = one(spark, "id string, source string, target string, ord long", ("e0", "a", "b", 0), ("e1", "a", "d", 1))
    return build.without_files(Graph(n, e), ["dist/"]).edges.select("id")


# Text functions


@query("text_escapes", must_be("t string, js string, file string", [("a'b\"c\nd\\", "a\\'b\\\"c\\nd\\\\", "a'b-c d-"), ("x  <y>: z", "x  <y>: z", "x -y-- z")]))
def text_escapes(spark, sf_dir):
    return one(spark, "t string", ("a'b\"c\nd\\",), ("x  <y>: z",)).select("t", tf.js_escaped(F.col("t")).alias("js"), tf.file_name(F.col("t")).alias("file"))


@query("question_slugs", must_be("q string, slug string, memory string", [("How does X work??", "how-does-x-work", "how-does-x-work"), ("a " * 30 + "!", ("a-" * 20), ("a-" * 20)[:-1])]))
def question_slugs(spark, sf_dir):
    return one(spark, "q string", ("How does X work??",), ("a " * 30 + "!",)).select("q", tf.question_slug(F.col("q")).alias("slug"), report.memory_slug(F.col("q")).alias("memory"))


@query("section_headers", must_be("type string, header string, back string", [("concept", "Concepts", "concept"), ("class", "Class", "clas"), ("entity", "Entitys", "entity")]))
def section_headers(spark, sf_dir):
    h = tf.section_header(F.col("type"))
    return one(spark, "type string", ("concept",), ("class",), ("entity",)).select("type", h.alias("header"), tf.header_type(h).alias("back"))


@query("hash_values", must_be("t string, xx string, sha string", [("", "ef46db3751d8e999", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"), ("a", "d24ec4f1a98c6e5b", "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"), ("abc", "44bc2cf5ad770999", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")]))
def hash_values(spark, sf_dir):
    return one(spark, "t string", ("",), ("a",), ("abc",)).select("t", tf.xxhash_hex(F.col("t")).alias("xx"), tf.content_hash(F.col("t")).alias("sha"))


@query("cache_key", must_be("q string, key string", [("a", "q_2p"), (" A ", "q_2p"), ("ab", "q_2e9"), ("", "q_0")]))
def cache_key(spark, sf_dir):
    """'a' is 97, 2p in base 36; 'ab' is 97 * 31 + 98 = 3105, 2e9."""
    return one(spark, "q string", ("a",), (" A ",), ("ab",), ("",)).select("q", tf.cache_key(F.col("q")).alias("key"))


@query("class_tokens", must_be("t string, tokens long", [("hello world", 7), ("", 0), ("{}()", 7), ("中文字", 3), ("éé", 4)]))
def class_tokens(spark, sf_dir):
    """ASCII words ceil(5 / 4) each, 3 more; symbols one each, 3 more; CJK its characters; other letters by halves, 3 more."""
    return one(spark, "t string", ("hello world",), ("",), ("{}()",), ("中文字",), ("éé",)).select("t", tf.class_tokens(F.col("t")).cast("long").alias("tokens"))


@query("class_message_tokens", must_be("c long, tokens long", [(1, 30), (2, 10)]))
def class_message_tokens(spark, sf_dir):
    """(4 + 7 + 4 + 1) + (4 + 4) + 6, and 4 + 0 + 6: the name of four letters counts 1 + 3, and 1 more."""
    m = one(spark, "c long, text string, name string", (1, "hello world", "anna"), (1, "ok", None), (2, "", None))
    return refine.class_message_tokens(m, "c", "text", "name")


@query("token_hooks", must_be("t string, estimate long, counted long", [("four words in here", 5, 4), ("", 0, 0)]))
def token_hooks(spark, sf_dir):
    return one(spark, "t string", ("four words in here",), ("",)).select("t", tf.bpe_tokens(F.col("t")).alias("estimate"), tf.bpe_tokens(F.col("t"), str.split).alias("counted"))


@query("fixed_decimals", must_be("x double, two string, none string", [(1.005, "1.01", "1"), (2.0, "2.00", "2"), (0.5, "0.50", "1"), (1234.567, "1234.57", "1235")]))
def fixed_decimals(spark, sf_dir):
    return one(spark, "x double", (1.005,), (2.0,), (0.5,), (1234.567,)).select("x", tf.fixed(F.col("x"), 2).alias("two"), tf.fixed(F.col("x"), 0).alias("none"))


@query("stamps", must_be("s string", [("2024-03-05T07-08-09-000Z",)]))
def stamps(spark, sf_dir):
    return one(spark, "t string", ("2024-03-05 07:08:09",)).select(tf.stamp(F.to_timestamp_ntz("t")).alias("s"))


@query("versions", must_be("v string, next string", [("v9", "v10"), ("v0", "v1")]))
def versions(spark, sf_dir):
    return one(spark, "v string", ("v9",), ("v0",)).select("v", tf.next_version(F.col("v")).alias("next"))


@query("prompt_differences", must_be("a string, b string, n int", [("abcd", "abxy", 2), ("", "abc", 3), ("abc", "abcde", 2), ("", "x" * 300, 201)]))
def prompt_differences(spark, sf_dir):
    return one(spark, "a string, b string", ("abcd", "abxy"), ("", "abc"), ("abc", "abcde"), ("", "x" * 300)).select("a", "b", tf.substring_difference(F.col("a"), F.col("b")).alias("n"))


ANSWERS = [("say\n```md\nnew text\n```\nx", "new text"), ("REVISED PROMPT: do this\nnow\n\nrest", "do this\nnow"), ("one line\n\nsecond line", "one line second line"), ("short", "old")]


@query("prompts_in_answers", must_be("answer string, prompt string", ANSWERS))
def prompts_in_answers(spark, sf_dir):
    return one(spark, "answer string", *[(a,) for a, _ in ANSWERS]).select("answer", tf.revised_prompt(F.col("answer"), F.lit("old")).alias("prompt"))


@query("revised_prompts", must_be("version string, prompt string, accepted boolean", [("v2", "Extract all names.", True), ("v5", "Keep", False)]))
def revised_prompts(spark, sf_dir):
    rows = one(spark, "version string, prompt string, answer string", ("v1", "Extract names.", "```\nExtract all names.\n```"), ("v5", "Keep", "```\n" + "y" * 400 + "\n```"))
    return refine.revised(rows)


@query("pauses", must_be("n int, ms double, near boolean", [(1, 1000.0, True), (4, 8000.0, True), (20, 60000.0, True)]))
def pauses(spark, sf_dir):
    ms, drawn = tf.backoff_ms(F.col("n")), tf.backoff_ms(F.col("n"), jitter=0.1, seed=3)
    return one(spark, "n int", (1,), (4,), (20,)).select("n", ms.alias("ms"), (F.abs(drawn - ms) <= 0.1 * ms).alias("near"))


@query("rate_limits", must_be("m string, hit boolean", [("429 sent", True), ("Rate limit reached", True), ("Too Many Requests", True), ("timeout", False)]))
def rate_limits(spark, sf_dir):
    return one(spark, "m string", ("429 sent",), ("Rate limit reached",), ("Too Many Requests",), ("timeout",)).select("m", tf.rate_limited(F.col("m")).alias("hit"))


@query("prices", must_be("p string, m string, cost double", [("one", "big", 15.0), ("one", "other", 5.0), ("two", "small", 0.25)]))
def prices(spark, sf_dir):
    return one(spark, "p string, m string", ("one", "big"), ("one", "other"), ("two", "small")).select("p", "m", tf.cost_per_million(F.col("p"), F.col("m"), {"one": {"big": 15}, "two": {"small": 0.25}}).alias("cost"))


@query("page_meta", must_be("title string, description string, author string, tweet string", [("A page", "About it", "Ann", "42"), (None, None, None, "bcbae1c65f28f1eb")]))
def page_meta(spark, sf_dir):
    html = '<html><head><TITLE lang="x"> A page </title><meta property="og:description" content="About it"><meta name="author" content="Ann"></head>'
    rows = one(spark, "url string, html string", ("https://x.com/a/status/42", html), ("https://example.org/none", "<p>x</p>"))
    return rows.select(tf.html_title(F.col("html")).alias("title"), tf.og(F.col("html"), "og:description").alias("description"), tf.og(F.col("html"), "author").alias("author"), tf.tweet_id(F.col("url")).alias("tweet"))


@query("import_names", must_be("t string, names string", [("import os, sys", "os,sys"), ("import { A, B } from './x/y'", "A,B,y"), ('use "net/http";', "http")]))
def import_names(spark, sf_dir):
    return one(spark, "t string", ("import os, sys",), ("import { A, B } from './x/y'",), ('use "net/http";',)).select("t", F.array_join(extract.import_names(F.col("t")), ",").alias("names"))


# Extraction

PYTHON = "import os\nclass A(B):\n    def go(self):\n        return run()\ndef run():\n    return 1\n"


@query("code_nodes", must_be("file string, id string, label string, type string", [
    ("m.py", "m_py-n0", "m.py", "module"), ("m.py", "m_py-n1", "A", "class"), ("m.py", "m_py-n2", "go", "function"), ("m.py", "m_py-n3", "run", "function"),
    ("bad.py", "bad.py-module", "bad.py", "module"), ("x.go", "x_go-n0", "x.go", "module"), ("x.go", "x_go-n1", "Main", "function"),
]))
def code_nodes(spark, sf_dir):
    return extract.code(one(spark, "file string, text string", ("m.py", PYTHON), ("bad.py", "def ("), ("x.go", "func Main() {}\n"), ("t.txt", "no code"))).filter("kind = 'node'").select("file", "id", "label", "type")


@query("code_edges", must_be("source string, target string, relation string, weight double", [
    ("m_py-n0", "os", "imports", 1.0), ("m_py-n0", "m_py-n1", "defines", 1.0), ("m_py-n1", "B", "extends", 1.0), ("m_py-n1", "m_py-n2", "defines", 1.0), ("m_py-n2", "m_py-n3", "calls", 1.0), ("m_py-n0", "m_py-n3", "defines", 1.0),
]))
def code_edges(spark, sf_dir):
    return extract.code(one(spark, "file string, text string", ("m.py", PYTHON))).filter("kind = 'edge'").select("source", "target", "relation", "weight")


MARKDOWN = "---\ntitle: 'My Doc'\nlang: en\n---\n# One\n\n### Two \n[[other page|x]] [l](local/f.md) [w](http://x) [](y)\n"


@query("markdown_nodes", must_be("id string, label string, type string, properties string", [
    ("docs_a_md", "My Doc", "document", "content,lang,title"), ("docs_a_md-h0", "One", "concept", "level,source"), ("docs_a_md-h1", "Two", "concept", "level,source"), ("b_md", "b.md", "document", "content"),
]))
def markdown_nodes(spark, sf_dir):
    rows = extract.markdown(one(spark, "file string, text string", ("docs/a.md", MARKDOWN), ("b.md", "plain")))
    return rows.filter("kind = 'node'").select("id", "label", "type", F.array_join(F.array_sort(F.map_keys("properties")), ",").alias("properties"))


@query("markdown_properties", must_be("id string, content string, level string, lang string", [("docs_a_md", MARKDOWN.split("---\n")[2], None, "en"), ("docs_a_md-h0", None, "1", None), ("docs_a_md-h1", None, "3", None)]))
def markdown_properties(spark, sf_dir):
    rows = extract.markdown(one(spark, "file string, text string", ("docs/a.md", MARKDOWN))).filter("kind = 'node'")
    return rows.select("id", *[F.try_element_at("properties", F.lit(c)).alias(c) for c in ("content", "level", "lang")])


@query("markdown_edges", must_be("id string, source string, target string, relation string, weight double", [
    ("docs_a_md-defines-docs_a_md-h0", "docs_a_md", "docs_a_md-h0", "defines", 1.0), ("docs_a_md-defines-docs_a_md-h1", "docs_a_md", "docs_a_md-h1", "defines", 1.0),
    ("docs_a_md-references-other_page", "docs_a_md", "other_page", "references", 0.8), ("docs_a_md-references-local_f_md", "docs_a_md", "local_f_md", "references", 0.6),
]))
def markdown_edges(spark, sf_dir):
    return extract.markdown(one(spark, "file string, text string", ("docs/a.md", MARKDOWN))).filter("kind = 'edge'").select("id", "source", "target", "relation", "weight")


@query("corpus_graph_nodes", must_be("id string, source_file string, type string", [("m_py-n0", "m.py", "module"), ("m_py-n1", "m.py", "class"), ("m_py-n2", "m.py", "function"), ("m_py-n3", "m.py", "function"), ("b_md", "b.md", "document")]))
def corpus_graph_nodes(spark, sf_dir):
    return extract.corpus_graph(one(spark, "file string, text string", ("m.py", PYTHON), ("b.md", "plain"), ("c.zip", "?"))).nodes.select("id", "source_file", "type")


@query("front_matter_round_trip", must_be("file string, text string", [("a.md", "---\nlang: en\ntitle: My Doc\n---\n# One"), ("b.md", "---\n\n---\nbare")]))
def front_matter_round_trip(spark, sf_dir):
    rows = one(spark, "file string, text string", ("a.md", "---\ntitle: \"My Doc\"\nlang: en\nlang: fr\n---\n# One"), ("b.md", "bare"))
    block, body = extract.front_matter(F.col("text"))
    return rows.select("file", extract.with_front(extract.front_values(block), body).alias("text"))


@query("model_answers", must_be("text string, answer string, cached boolean, error string", [("known", "old", True, None), ("new", '{"x": 1}', False, None), ("bad", None, False, "no answer")]))
def model_answers(spark, sf_dir):
    def complete(prompt):
        if prompt == "bad":
            raise ValueError("no answer")
        return '```json\n{"x": 1}\n```'

    docs = one(spark, "text string", ("known",), ("new",), ("bad",), ("new",))
    cache = one(spark, "text string, answer string", ("known", "old")).select(F.sha2("text", 256).alias("hash"), "answer")
    names = docs.distinct().withColumn("hash", F.sha2("text", 256))
    return extract.model_answers(docs, cache, complete).join(names, "hash").select("text", "answer", "cached", "error")


@query("answer_checks", must_be("hash string, problem string", [("a", None), ("b", "json"), ("c", "id"), ("d", "nodes"), ("e", "edges")]))
def answer_checks(spark, sf_dir):
    node = '{"id":"n","type":"t","label":""}'
    rows = [("a", f'{{"id":"d","nodes":[{node}],"edges":[]}}'), ("b", None), ("c", '{"nodes":[],"edges":[]}'), ("d", '{"id":"d","nodes":[{"id":"n","type":""}],"edges":[]}'), ("e", f'{{"id":"d","nodes":[{node}]}}')]
    return extract.answer_rows(one(spark, "hash string, answer string", *rows)).select("hash", "problem")


@query("extraction_prompts", must_be("file string, path string, n int", [("in/A b.pdf", "pending/A_b.pdf.prompt.md", 417), ("p.png", "pending/p.png.prompt.md", 403)]))
def extraction_prompts(spark, sf_dir):
    return extract.prompts(one(spark, "file string", ("in/A b.pdf",), ("c.py",), ("p.png",)), "pending").select("file", "path", F.length("prompt").alias("n"))


@query("skill_sections", must_be("heading string, body string", [("One", "text\n```\n# no heading\n```"), ("Two", "more"), ("Four", "#### five\nx")]))
def skill_sections(spark, sf_dir):
    text = "---\nname: s\n---\nlead\n# One\ntext\n```\n# no heading\n```\n## Two\n\nmore\n\n### Four\n#### five\nx\n"
    return extract.skill_sections(one(spark, "file string, text string", ("s.md", text))).select("heading", "body")


@query("transcripts", must_be("file string, transcript string, cached boolean", [("a.mp3", "known words", True), ("b.mp4", "said in b.mp4", False)]))
def transcripts(spark, sf_dir):
    media = one(spark, "file string, hash string", ("a.mp3", "h1"), ("b.mp4", "h2"))
    return extract.transcripts(media, one(spark, "hash string, transcript string", ("h1", "known words")), lambda f: f"said in {f}")


# Sources


def _folder(spark, files: dict[str, str]) -> str:
    base = scratch(spark, "files")
    for name, text in files.items():
        readers.put_text(spark, f"{base}/{name}", text)
    return base


@query("file_scan", must_be("file string, size long", [("a.py", 3), ("src/b.md", 2), ("raw/c.txt", 1)]))
def file_scan(spark, sf_dir):
    base = _folder(spark, {"a.py": "x=1", "src/b.md": "# ", "node_modules/m.js": "1", "dist/d.js": "1", "big.txt": "y" * 40})
    return readers.files(spark, base, most=20, raw=_folder(spark, {"c.txt": "z"})).select("file", "size")


@query("corpus_spec", must_be("n_files long, bytes long, language string", [(2, 5, "Python")]))
def corpus_spec(spark, sf_dir):
    return readers.corpus(readers.files(spark, _folder(spark, {"a.py": "x=1", "b.md": "# "})))


GRAPH_JSON = '{"nodes":[{"id":"a","label":"A","community":1},{"id":"b","label":"B"}],"edges":[{"id":"e","source":"a","target":"b","weight":2.5}],"metadata":{"directed":true}}'


@query("graph_documents", must_be("which string, nodes long, edges long, directed boolean", [("file", 2, 1, True), ("missing", 0, 0, False)]))
def graph_documents(spark, sf_dir):
    base, out = _folder(spark, {"g.json": GRAPH_JSON}), None
    for which, name in (("file", "g.json"), ("missing", "none.json")):
        g = readers.graph_json(spark, f"{base}/{name}")
        rows = g.nodes.agg(F.lit(which).alias("which"), F.count("*").alias("nodes")).crossJoin(g.edges.agg(F.count("*").alias("edges"))).withColumn("directed", F.lit(g.directed))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("graph_saved", must_be("id string, label string, ord long", [("a", "A", 0), ("b", "B", 1)]))
def graph_saved(spark, sf_dir):
    base = _folder(spark, {"g.json": GRAPH_JSON})
    readers.save_graph(readers.graph_json(spark, f"{base}/g.json"), f"{base}/saved")
    return readers.load_graph(spark, f"{base}/saved", True).nodes.select("id", "label", "ord")


@query("wiki_files", must_be("title string, content string", [("Fox", "text"), ("By label", "more")]))
def wiki_files(spark, sf_dir):
    base = _folder(spark, {"a.md": "---\ntitle: Fox\n---\ntext", "s/b.md": "---\nlabel: By label\n---\nmore", "c.md": "no front matter", "d.txt": "---\ntitle: x\n---\n"})
    return readers.wiki(spark, base).select("title", "content")


@query("refinement_history", must_be("version string, ord long", [("v1", 0), ("v2", 1)]))
def refinement_history(spark, sf_dir):
    base = _folder(spark, {"h.jsonl": '{"version":"v1","timestamp":"2024-01-01"}\n{"version":"v2","timestamp":"2024-01-02"}\n'})
    return readers.history(spark, f"{base}/h.jsonl").select("version", F.col("ord").cast("long").alias("ord"))


@query("held_out_questions", must_be("which string, query string, category string", [("array", "q1", "c"), ("object", "q2", None)]))
def held_out_questions(spark, sf_dir):
    base, out = _folder(spark, {"a.json": '[{"query":"q1","category":"c"}]', "b.json": '{"queries":[{"query":"q2"}]}'}), None
    for which, name in (("array", "a.json"), ("object", "b.json"), ("missing", "c.json")):
        rows = readers.held_out(spark, f"{base}/{name}").select(F.lit(which).alias("which"), "query", "category")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("pending_results", must_be("id string, label string", [("a", "first"), ("b", "new")]))
def pending_results(spark, sf_dir):
    base = _folder(spark, {"x.result.json": '{"nodes":[{"id":"a","label":"second"},{"id":"b","label":"new"}],"edges":[{"id":"e","source":"a","target":"b"}]}', "other.json": "{}"})
    found = readers.pending(spark, base)
    part = lambda c: found.select(F.posexplode(c).alias("ord", "x")).select("x.*", F.col("ord").cast("bigint").alias("ord"))
    g = Graph(one(spark, "id string, label string, ord long", ("a", "first", 0)), one(spark, "id string, source string, target string, ord long").limit(0))
    new = Graph(part("nodes"), part("edges"))
    return build.add_pending(g, new.nodes, new.edges).nodes.select("id", "label")


@query("configuration", must_be("which string, part string, key string, value string", [("file", "paths", "graph", "g.json"), ("file", "paths", "wiki", "other"), ("file", "wiki", "mode", "deep"), ("missing", "paths", "graph", "g.json"), ("missing", "paths", "wiki", "w"), ("missing", "wiki", "mode", "deep")]))
def configuration(spark, sf_dir):
    base, defaults = _folder(spark, {"c.json": '{"paths":{"wiki":"other"}}'}), {"paths": {"graph": "g.json", "wiki": "w"}, "wiki": {"mode": "deep"}}
    rows = [(which, p, k, v) for which, f in (("file", "c.json"), ("missing", "x.json")) for p, own in readers.config(spark, f"{base}/{f}", defaults).items() for k, v in own.items()]
    return one(spark, "which string, part string, key string, value string", *rows)


# Merging, differences, vectors


@query("merged_properties", must_be("id string, label string, provenance string, a string, b string", [("x", "new", "p,q", "2", "1"), ("y", "only", "", None, None)]))
def merged_properties(spark, sf_dir):
    n = one(spark, "id string, label string, provenance array<string>, properties map<string,string>, ord long", ("x", "old", ["p"], {"a": "1", "b": "1"}, 0), ("x", "new", ["q", "p"], {"a": "2"}, 1), ("y", "only", None, None, 2))
    out = build.merge_nodes(Graph(n, n.select("id").limit(0)).nodes)
    return out.select("id", "label", F.array_join("provenance", ",").alias("provenance"), *[F.try_element_at("properties", F.lit(k)).alias(k) for k in ("a", "b")])


@query("watch_merge", must_be("kind string, id string", [("node", "a"), ("node", "c"), ("edge", "e0"), ("edge", "e1")]))
def watch_merge(spark, sf_dir):
    """A removed file's node goes, its edges stay."""
    nodes = one(spark, "id string, source_file string, ord long", ("a", "f1", 0), ("b", "f2", 1))
    old = Graph(nodes, one(spark, "id string, source string, target string, ord long", ("e0", "a", "b", 0)))
    new = Graph(one(spark, "id string, source_file string, ord long", ("c", "f3", 0)), one(spark, "id string, source string, target string, ord long", ("e1", "c", "a", 0)))
    out = delta.watch_merged(old, new, one(spark, "file string", ("f2",)))
    return out.nodes.select(F.lit("node").alias("kind"), "id").unionByName(out.edges.select(F.lit("edge").alias("kind"), "id"))


@query("incremental_edges", must_be("id string", [("e1",), ("e2",)]))
def incremental_edges(spark, sf_dir):
    """Edges that start at a node of a changed file go; those that end there stay."""
    old = Graph(one(spark, "id string, source_file string, ord long", ("a", "f1", 0), ("b", "f2", 1)), one(spark, "id string, source string, target string, ord long", ("e0", "b", "a", 0), ("e1", "a", "b", 1)))
    new = Graph(one(spark, "id string, source_file string, ord long", ("b", "f2", 0)), one(spark, "id string, source string, target string, ord long", ("e2", "b", "a", 0)))
    return delta.replaced(old, new, one(spark, "file string", ("f2",))).edges.select("id")


@query("rolled_back_edges", must_be("id string, source string", [("e0", "new"), ("e1", "b"), ("e2", "c")]))
def rolled_back_edges(spark, sf_dir):
    e = "id string, source string, target string, ord long"
    now = Graph(one(spark, "id string, ord long", ("a", 0)), one(spark, e, ("e0", "new", "x", 0), ("e2", "c", "x", 1)))
    return delta.rolled_back(now, now.nodes.limit(0), one(spark, e, ("e0", "old", "x", 0), ("e1", "b", "x", 1))).edges.select("id", "source")


@query("saved_delta", must_be("id string, change string, build string", [("a", "added", "2024-01-01T00-00-00-000Z")]))
def saved_delta(spark, sf_dir):
    path = scratch(spark, "deltas")
    delta.persist(one(spark, "id string, change string", ("a", "added")), path, "2024-01-01T00:00:00.000Z")
    return spark.read.schema("id string, change string, build string").json(path)


@query("embedding_texts", must_be("id string, text string", [("n0", "N0 [concept]"), ("n1", "N1 [concept]")]))
def embedding_texts(spark, sf_dir):
    return small(spark, [("n0", "n1")]).nodes.select("id", vectors.embedding_text().alias("text"))


@query("embedded_texts", must_be("t string, x double, y double", [("abc", 0.6, 0.8), ("", 0.0, 0.0)]))
def embedded_texts(spark, sf_dir):
    out = vectors.embedded(one(spark, "t string", ("abc",), ("",)), "t", lambda texts: [[3.0, 4.0] if t else [0.0, 0.0] for t in texts], 2)
    return out.select("t", *[F.element_at("embedding", i).alias(c) for i, c in ((1, "x"), (2, "y"))])


NEAR = [("a", 0, [1.0, 0.0], 1), ("b", 1, [0.99, 0.1], 3), ("c", 2, [0.98, 0.2], 1), ("d", 3, [0.0, 1.0], 1)]


def _near(spark):
    rows = one(spark, "id string, ord long, embedding array<double>, n int", *NEAR)
    return rows.withColumns({"type": F.lit("concept"), "provenance": F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat("id", i.cast("string")))})


@query("candidate_pairs", must_be("a string, b string", [("a", "b"), ("b", "c")]))
def candidate_pairs(spark, sf_dir):
    """One partner for each node: a takes b, b takes a, c takes b; a and c, as near as 0.98, are in neither's first."""
    return vectors.candidates(_near(spark), 0.85, 1).select("a", "b")


@query("dedup_merges", must_be("merged_id string, absorbed_id string", [("b", "a"), ("b", "c")]))
def dedup_merges(spark, sf_dir):
    """b has three provenances and absorbs a; then c; a and c are skipped as a is gone."""
    n = _near(spark)
    return vectors.merges(vectors.candidates(n, 0.85), n).select("merged_id", "absorbed_id").orderBy("merged_id")


def _merged(spark):
    n = _near(spark)
    g = Graph(n.withColumn("label", F.col("id")), one(spark, "id string, source string, target string, weight double, ord long", ("e0", "a", "d", 1.0, 0), ("e1", "b", "d", 2.0, 1), ("e2", "c", "c", 1.0, 2)))
    return g, vectors.merges(vectors.candidates(n, 0.85), n)


@query("merged_nodes", must_be("id string, provenance string, merged_from string", [("b", "b1,b2,b3,a1,c1", "a,c"), ("d", "d1", None)]))
def merged_nodes(spark, sf_dir):
    return vectors.applied(*_merged(spark)).nodes.select("id", F.array_join("provenance", ",").alias("provenance"), F.array_join("merged_from", ",").alias("merged_from"))


@query("merged_edges", must_be("how string, source string, target string, weight double", [("redirected", "b", "d", 3.0), ("redirected", "b", "b", 1.0), ("dropped", "b", "d", 2.0)]))
def merged_edges(spark, sf_dir):
    g, m = _merged(spark)
    rows = [vectors.applied(g, m, compat).edges.select(F.lit(how).alias("how"), "source", "target", "weight") for how, compat in (("redirected", False), ("dropped", True))]
    return rows[0].unionByName(rows[1])


@query("edge_redirects", must_be("absorbed_id string, edge_redirects long", [("a", 1), ("c", 1)]))
def edge_redirects(spark, sf_dir):
    g, m = _merged(spark)
    return vectors.redirects(m, g.edges).select("absorbed_id", "edge_redirects")


@query("boosted_pairs", must_be("a string, b string, overlap double, boosted double", [("a", "b", 1.0, 1.0), ("a", "c", 0.0, 0.5)]))
def boosted_pairs(spark, sf_dir):
    """a and b share both neighbours: 0.8 (1 + 0.2 * 1 / 0.5) = 1.12, at most 1."""
    pairs = one(spark, "a string, b string, similarity double", ("a", "b", 0.8), ("a", "c", 0.5))
    edges = small(spark, [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "z")]).edges
    return vectors.boosted(pairs, edges).select("a", "b", "overlap", "boosted")


# Statistics, pages, exports


@query("hubs_by_weight", must_be("id string, label string, degree double", [("a", "A", 7.0)]))
def hubs_by_weight(spark, sf_dir):
    """The end z has no node: it takes a place among the two best and then goes."""
    g = small(spark, [("a", "z", 5), ("a", "b", 2), ("z", "c", 3)], nodes=[("a", "A", "t", None), ("b", "B", "t", None), ("c", "C", "t", None)])
    return stats.hubs(g, 2)


@query("anomalous_hub", must_be("id string, degree long", [("h", 12)]))
def anomalous_hub(spark, sf_dir):
    return stats.anomalous_hub(small(spark, [("h", f"x{i}", 1) for i in range(11)] + [("h", "x0", 9)]))


@query("lint_findings", must_be("issue string, severity string, subject string", [("orphan", "warning", "c"), ("missing_label", "error", "b"), ("duplicate_edge", "warning", "a:b")]))
def lint_findings(spark, sf_dir):
    return stats.lint(small(spark, [("a", "b"), ("a", "b"), ("b", "a")], nodes=[("a", "A", "t", None), ("b", "", "t", None), ("c", "C", "t", None)]))


@query("weak_nodes_found", must_be("id string, reason string", [("n0", "low_confidence"), ("n1", "no_embedding"), ("n10", "isolated")]))
def weak_nodes_found(spark, sf_dir):
    n = one(spark, "id string, confidence double, embedding array<double>", *[(f"n{i}", 0.5 if i == 0 else 0.9, None if i == 1 else [1.0]) for i in range(11)])
    return refine.weak_nodes(n, one(spark, "source string, target string", *[(f"n{i}", f"n{i + 1}") for i in range(0, 9)]))


@query("page_index", must_be("type string, n long, refs string", [("concept", 2, "b,c,a"), ("entity", 1, None)]))
def page_index(spark, sf_dir):
    pages = one(spark, "path string, type string, content string, ord long", ("a", "concept", "[[b]] [[a]] [[c|x]]", 0), ("b", "concept", "[[a]]", 1), ("c", "entity", "none", 2))
    return wiki.index(pages)


@query("page_priority", must_be("place long, id int", [(0, 3), (1, 1), (2, 2), (3, 4)]))
def page_priority(spark, sf_dir):
    m = one(spark, "id int, n_nodes int, n_hubs int, dependency_order int", (1, 5, 2, 9), (2, 5, 1, 0), (3, 7, 0, None), (4, 5, 1, None))
    return wiki.page_order(m).select(F.monotonically_increasing_id().alias("place"), "id")


@query("pages_touched", must_be("path string", [("p1",)]))
def pages_touched(spark, sf_dir):
    return wiki.touched(one(spark, "id string, path string", ("a", "p1"), ("b", "p2"), ("c", "p1")), one(spark, "id string", ("a",), ("c",)))


def _contradicting(spark):
    g = small(spark, [("a", "b", 1, "contradicts"), ("a", "c", 1, "contradicts"), ("b", "c", 1, "uses")], nodes=[("a", "Cold", "t", None), ("b", "Warm", "t", None), ("c", "Wet", "t", None)])
    bridge = one(spark, "id string, path string", ("a", "pa"), ("b", "pb"), ("c", "pc"))
    return g, bridge, one(spark, "path string, content string", ("pa", "never warm"), ("pb", "x"), ("pc", "y [[pa]] [[gone]]"))


@query("contradictions", must_be("source string, target string", [("a", "b")]))
def contradictions(spark, sf_dir):
    return wiki.contradictions(*_contradicting(spark))


@query("wiki_lint", must_be("n_contradictions long, n_missing_sources long, n_broken_links long, valid boolean", [(1, 3, 1, False)]))
def wiki_lint(spark, sf_dir):
    g, bridge, pages = _contradicting(spark)
    return wiki.lint_summary(wiki.contradictions(g, bridge, pages), wiki.missing_sources(g.nodes), wiki.broken_links(pages))


@query("spec_drift", must_be("file string, name string", [("a.ts", "Lost"), ("b.ts", "gone")]))
def spec_drift(spark, sf_dir):
    code = one(spark, "file string, text string", ("a.ts", "export class Lost {}\nexport function build() {}"), ("b.ts", "export async function gone() {}\nexport const build = 1"))
    return wiki.undocumented(code, one(spark, "text string", ("The rebuilding of graphs",), ("nothing",)))


@query("log_lines", must_be("value string", [("- 2024-01-01 [ask] \"why\"",), ("- 2024-01-02 [build] 3 nodes",)]))
def log_lines(spark, sf_dir):
    path = scratch(spark, "log")
    for row in (("2024-01-01", "ask", '"why"'), ("2024-01-02", "build", "3 nodes")):
        report.log(one(spark, "stamp string, action string, detail string", row), path)
    return spark.read.text(path)


@query("memory_entries", must_be("file string, page string, content string", [("2024-01-01T10-20-30-400-why-is-it.md", "queries/why-is-it.md", '---\ntype: memory\nquestion: "Why is it?"\nanswer: "Say \\"so\\""\nmemory_type: insight\nnodes: [a, b]\ncreated_at: 2024-01-01T10:20:30.400Z\n---\n# Why is it?\nSay "so"\n## Referenced Nodes\n- a\n- b\n')]))
def memory_entries(spark, sf_dir):
    return report.memories(one(spark, "question string, answer string, type string, nodes array<string>, stamp string", ("Why is it?", 'Say "so"', "insight", ["a", "b"], "2024-01-01T10:20:30.400Z")))


@query("results_table", must_be("line string", [
    ("Method     | Tokens     | Files    | Duration     | Precision  | Recall    ",), ("-----------+------------+----------+--------------+------------+-----------".replace("+------------+----------+--------------+------------+-----------", "+-" + "-" * 10 + "-+-" + "-" * 8 + "-+-" + "-" * 12 + "-+-" + "-" * 10 + "-+-" + "-" * 10),),
    ("grep       | 100        | 3        | 7ms          | 0.50       | N/A       ",), ("tiered     | 40         | 1        | 2ms          | 0.95       | 0.90      ",), ("",), ("Total tokens: 140",), ("Avg tokens/query: 70.00",),
]))
def results_table(spark, sf_dir):
    runs = one(spark, "ord long, method string, tokens long, files long, ms long, precision double, recall double", (0, "grep", 100, 3, 7, 0.5, None), (1, "tiered", 40, 1, 2, 0.95, 0.9))
    return report.results_table(runs).select("line")


@query("cypher_quotes", must_be("line string", [
    ("CREATE (n:`a``b` {id: 'x\\'y', label: 'L', type: 'a`b', `k``1`: \"v\\\"w\"});",), ("MATCH (a {id: 'x\\'y'}), (b {id: 'z'}) CREATE (a)-[r:`IS_A``T` {id: 'e0', weight: 1.5}]->(b);",),
]))
def cypher_quotes(spark, sf_dir):
    n = one(spark, "id string, label string, type string, properties map<string,string>, ord long", ("x'y", "L", "a`b", {"k`1": 'v"w'}, 0))
    e = one(spark, "id string, source string, target string, weight double, label string, ord long", ("e0", "x'y", "z", 1.5, "is a`t", 0))
    return export.cypher(Graph(n, e)).filter("place < '3'").select("line")


@query("html_is_inert", must_be("line string", [('{"id":"\\u003c/script>","label":"l","type":"t"},',), ('{"source":"\\u003c/script>\\u003cscript>","target":"b","weight":1.0},',)]))
def html_is_inert(spark, sf_dir):
    n = one(spark, "id string, label string, type string, ord long", ("</script>", "l", "t", 0))
    e = one(spark, "id string, source string, target string, weight double, ord long", ("e", "</script><script>", "b", 1.0, 0))
    return export.html(Graph(n, e)).filter("place LIKE '1-%' OR place LIKE '3-%'").select("line")


@query("pushed_counts", must_be("sent long, stored long, complete boolean", [(100, 96, True), (100, 90, False)]))
def pushed_counts(spark, sf_dir):
    return one(spark, "sent long, stored long, complete boolean", *[(a, b, export.push_complete(a, b)) for a, b in ((100, 96), (100, 90))])


# Streams and calls


@query("file_changes", must_be("file string, event string", [("a", "change"), ("b", "unlink"), ("d", "add")]))
def file_changes(spark, sf_dir):
    return ev.file_events(one(spark, "file string, hash string", ("a", "1"), ("b", "2"), ("c", "3")), one(spark, "file string, hash string", ("a", "9"), ("c", "3"), ("d", "4")))


@query("retried_calls", must_be("attempts int, outcome string, calls int, waited double", [(3, "ok", 3, 3.0), (2, "failed", 2, 1.0)]))
def retried_calls(spark, sf_dir):
    rows = []
    for attempts in (3, 2):
        seen, waits = [], []

        def call(seen=seen):
            seen.append(1)
            if len(seen) < 3:
                raise OSError("busy")
            return "ok"

        try:
            outcome = ev.retried(call, attempts, sleep=waits.append)()
        except OSError:
            outcome = "failed"
        rows.append((attempts, outcome, len(seen), float(sum(waits))))
    return one(spark, "attempts int, outcome string, calls int, waited double", *rows)


@query("applied_changes", must_be("id string, label string", [("a", "2"), ("b", "1"), ("c", "1")]))
def applied_changes(spark, sf_dir):
    """Two files of changes as a stream; each batch is merged once, the later of an id wins."""
    base = scratch(spark, "changes")
    for k, rows in enumerate(([("a", "1"), ("b", "1")], [("a", "2"), ("c", "1")])):
        one(spark, "id string, label string, ord long", *[(*r, k) for r in rows]).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema("id string, label string, ord long").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    ev.apply_changes(spark, stream, lambda batch, i: batch.write.mode("overwrite").parquet(f"{base}/out/batch={i}"), f"{base}/state").awaitTermination()
    done = spark.read.schema("id string, label string, ord long").parquet(f"{base}/out")
    return done.groupBy("id").agg(F.max_by("label", "ord").alias("label"))


@query("tools_listed", must_be("name string, required string", [("get_node", "node"), ("shortest_path", "source,target"), ("status", ""), ("wiki_search", "question")]))
def tools_listed(spark, sf_dir):
    rows = [(t["name"], ",".join(t["required"])) for t in Engine(small(spark, FIVE)).tools()]
    return one(spark, "name string, required string", *rows).filter("name IN ('get_node', 'shortest_path', 'status', 'wiki_search')")


@query("tool_answers", must_be("tool string, rows long", [("query_graph", 5), ("get_neighbors", 3), ("god_nodes", 1), ("community_list", 0), ("lint", 0), ("build", 1), ("ingest", 1), ("ask", 10), ("benchmark", 4), ("report", 21)]))
def tool_answers(spark, sf_dir):
    files = one(spark, "text string, ord long", ("n0 and n1", 0))
    engine = Engine(small(spark, FIVE), files=files)
    more = small(spark, [("n4", "n5")])
    calls = [("query_graph", {"question": "concept"}), ("get_neighbors", {"node": "n0"}), ("god_nodes", {"min_degree": 3}), ("community_list", {}), ("lint", {}), ("ask", {"question": "all concept nodes"}), ("benchmark", {"question": "n0"}), ("report", {}), ("ingest", {"nodes": more.nodes, "edges": more.edges}), ("build", {"nodes": more.nodes, "edges": more.edges})]
    return one(spark, "tool string, rows long", *[(name, engine.call(name, **given).count()) for name, given in calls])

"""Operators over small literal graphs with exact results."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.model import Graph
from lattica.operators import build, cluster, delta, stats, traverse, vectors, wiki

PAIRS = [("n0", "n1"), ("n0", "n2"), ("n1", "n3"), ("n0", "n4"), ("n2", "n4")]


def graph(spark, pairs=PAIRS, nodes=None, directed=False, labels=None):
    ids = nodes if nodes is not None else sorted({x for p in pairs for x in p[:2]})
    n = spark.createDataFrame([(x, (labels or {}).get(x, x.upper()), "concept", i) for i, x in enumerate(ids)], "id string, label string, type string, ord long")
    e = spark.createDataFrame([(f"e{i}", p[0], p[1], float(p[2]) if len(p) > 2 else 1.0, i) for i, p in enumerate(pairs)], "id string, source string, target string, weight double, ord long")
    return Graph(n, e, directed)


def ids(df, *order):
    return [r["id"] for r in df.orderBy(*order).collect()]


def test_walks(spark):
    g = graph(spark)
    assert ids(traverse.bfs(g, "n0"), "visit") == ["n0", "n1", "n2", "n4", "n3"]
    assert ids(traverse.bfs(g, "n0", 1), "visit") == ["n0", "n1", "n2", "n4"]
    assert ids(traverse.bfs(g, "nope"), "visit") == []
    assert ids(traverse.dfs(g, "n0", 9), "visit") == ["n0", "n1", "n3", "n2", "n4"]
    assert ids(traverse.shortest_path(g, "n3", "n4"), "step") == ["n3", "n1", "n0", "n4"]
    assert ids(traverse.shortest_path(g, "n3", "zz"), "step") == []
    assert sorted(ids(traverse.neighbours(g, "n0"), "id")) == ["n1", "n2", "n4"]
    assert traverse.neighbours(g, "n0", 0).count() == 0
    assert [r["id"] for r in traverse.subgraph(g, spark.createDataFrame([("n0",), ("n1",), ("n4",)], "id string")).edges.orderBy("ord").collect()] == ["e0", "e3"]


def test_directed_walk(spark):
    g = graph(spark, [("a", "b"), ("b", "c")], directed=True)
    assert ids(traverse.bfs(g, "b"), "visit") == ["b", "c"]
    assert ids(traverse.bfs(g, "c"), "visit") == ["c"]


def test_breadth_first_order_matches_a_queue(spark):
    rnd = random.Random(1)
    for _ in range(3):
        pairs = [(f"v{rnd.randint(0, 9)}", f"v{rnd.randint(0, 9)}") for _ in range(14)]
        start, seen, queue = pairs[0][0], [pairs[0][0]], [pairs[0][0]]
        while queue:
            at = queue.pop(0)
            for a, b in pairs:
                o = b if a == at else a if b == at else None
                if o is not None and o not in seen:
                    seen.append(o)
                    queue.append(o)
        assert ids(traverse.bfs(graph(spark, pairs), start), "visit") == seen


def test_merging(spark):
    e = graph(spark, [("a", "b", 2), ("b", "a", 3), ("a", "a", 1)]).edges
    merged = {(r.source, r.target): (r.weight, r.id) for r in build.merge_edges(e).collect()}
    assert merged == {("a", "b"): (5.0, "e0"), ("a", "a"): (1.0, "e2")}
    assert build.merge_edges(e, True).count() == 3
    rows = [("x", "one", {"k": "1", "l": "2"}, ["p"], 0), ("x", "two", {"k": "3"}, ["q", "p"], 1), (None, "made", None, None, 2)]
    n = Graph(spark.createDataFrame(rows, "id string, label string, properties map<string,string>, provenance array<string>, ord long"), e)
    out = {r.id: r for r in build.merge_nodes(n.nodes).collect()}
    assert out["x"].label == "two" and out["x"].properties == {"k": "3", "l": "2"} and out["x"].provenance == ["p", "q"]
    assert len(out) == 2 and all(len(i) in (1, 16) for i in out)


def test_statistics(spark):
    g = graph(spark)
    assert stats.status(g).first()["density"] == 0.25
    top = {r.id: r.degree for r in stats.hubs(g).collect()}
    assert top == {"n0": 3.0, "n1": 2.0, "n2": 2.0, "n4": 2.0, "n3": 1.0}
    empty = graph(spark, [], nodes=[])
    assert stats.status(empty).first()["density"] == 0.0 and stats.hubs(empty).count() == 0
    loop = graph(spark, [("a", "a")])
    assert stats.degrees(loop.edges).first()["degree"] == 2 and stats.degree_of(loop.edges).first()["degree"] == 1
    issues = {r.issue for r in stats.lint(graph(spark, [("a", "b"), ("a", "b")], nodes=["a", "b", "c"])).collect()}
    assert issues == {"orphan", "duplicate_edge"}


def test_deltas(spark):
    a, b = graph(spark, [("a", "b"), ("b", "c")]), graph(spark, [("b", "a"), ("b", "c")], nodes=["b", "c", "d"], labels={"c": "new"})
    assert {r.id: r.change for r in delta.node_delta(a.nodes, b.nodes).collect()} == {"a": "removed", "b": "unchanged", "c": "modified", "d": "added"}
    assert {tuple(r) for r in delta.edge_delta(a.edges, b.edges).collect()} == {("b", "a", "added"), ("a", "b", "removed")}


def local_moving(order, edges, directed=False):
    """Nodes are drawn by where their edges lead (either end without direction, so a loop leads home twice); an edge counts once in a degree."""
    m = sum(w for *_, w in edges)
    degree, home, near = dict.fromkeys(order, 0.0), {n: i for i, n in enumerate(order)}, {n: [] for n in order}
    for a, b, w in edges:
        for n in {a, b}:
            degree[n] += w
        near[a].append((b, w))
        if not directed:
            near[b].append((a, w))
    for _ in range(100 if m else 0):
        moved = False
        for n in order:
            pull = {}
            for o, w in near[n]:
                pull[home[o]] = pull.get(home[o], 0) + w
            best, target, here = 0.0, home[n], pull.get(home[n], 0)
            for c, w in pull.items():
                gain = (w - here) / (2 * m) - degree[n] ** 2 / (4 * m * m)
                if c != home[n] and gain > best:
                    best, target = gain, c
            if target != home[n]:
                home[n], moved = target, True
        if not moved:
            break
    seen = {}
    return {n: seen.setdefault(home[n], len(seen)) for n in order}


@pytest.mark.parametrize("directed", [False, True])
def test_communities_match_the_sequential_rule(spark, directed):
    rnd = random.Random(2)
    for loops in (0, 3):
        nodes = [f"v{i}" for i in range(10)]
        pairs = [(f"v{rnd.randint(0, 9)}", f"v{rnd.randint(0, 9)}", rnd.randint(1, 4)) for _ in range(12)]
        pairs = [p for p in pairs if p[0] != p[1]] + [(f"v{k}", f"v{k}", 2) for k in range(loops)]
        got = {r.id: r.community for r in cluster.clusters(graph(spark, pairs, nodes, directed)).collect()}
        assert got == local_moving(nodes, pairs, directed)


def test_rounds_of_joins_never_lower_the_measure(spark):
    rnd = random.Random(4)
    nodes = [f"v{i}" for i in range(12)]
    pairs = [(f"v{a}", f"v{b}", 4 if a // 4 == b // 4 else 1) for a in range(12) for b in range(a) if a // 4 == b // 4 or rnd.random() < 0.05]
    got = {r.id: r.community for r in cluster.clusters_by_rounds(graph(spark, pairs, nodes)).collect()}
    assert sorted(got) == sorted(nodes) and all(len({got[f"v{4 * k + j}"] for j in range(4)}) == 1 for k in range(3))


def test_partners_of_either_node_count(spark):
    """80 nearly equal vectors: each node's 50 best are united, so more pairs than the 50 best of one end alone."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.ones((80, 8)) + rng.normal(size=(80, 8)) * 0.05
    n = spark.createDataFrame([(f"n{i:02d}", "t", v.tolist(), i) for i, v in enumerate(x)], "id string, type string, embedding array<double>, ord long")
    got = {(r.a, r.b) for r in vectors.candidates(n, 0.5, 50).select("a", "b").collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos, want = unit @ unit.T, set()
    for i in range(80):
        best = sorted((j for j in range(80) if j != i), key=lambda j: (-cos[i, j], j))[:50]
        want |= {(f"n{min(i, j):02d}", f"n{max(i, j):02d}") for j in best}
    assert got == want and len(want) > 80 * 50 / 2


def test_vectors(spark):
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = v.select(vectors.cosine(F.col("a"), F.col("b")).alias("s"), vectors.cosine(F.col("a"), F.col("z")).alias("z"), vectors.euclidean(F.col("a"), F.col("z")).alias("e"), vectors.manhattan(F.col("a"), F.col("z")).alias("m")).first()
    assert tuple(r) == (1.0, 0.0, 1.0, 1.0)
    with pytest.raises(Exception, match="length"):
        v.select(vectors.cosine(F.col("a"), F.array(F.lit(1.0)))).collect()


def test_merging_by_vectors(spark):
    rows = [("a", "concept", [1.0, 0.0], ["p"], 0), ("b", "concept", [0.99, 0.05], ["q", "r"], 1), ("c", "concept", [0.0, 1.0], ["s"], 2)]
    n = spark.createDataFrame(rows, "id string, type string, embedding array<double>, provenance array<string>, ord long").withColumn("label", F.col("id"))
    g = Graph(n, graph(spark, [("a", "c"), ("b", "c"), ("a", "b")]).edges)
    merged = vectors.merges(vectors.candidates(n, 0.85), n)
    assert [tuple(r)[:2] for r in merged.collect()] == [("b", "a")]
    out = vectors.applied(g, merged)
    assert {(r.source, r.target): r.weight for r in out.edges.collect()} == {("b", "c"): 2.0, ("b", "b"): 1.0}
    assert {r.id: sorted(r.provenance) for r in out.nodes.collect()} == {"b": ["p", "q", "r"], "c": ["s"]}


def test_pages_and_links(spark):
    p = spark.createDataFrame([("a.md", "see [[b]] and [[gone|x]]", "entity", 0), ("b.md", "[[b.md]] [[a]]", "entity", 1)], "path string, content string, type string, ord long")
    assert {tuple(r) for r in wiki.broken_links(p).collect()} == {("a.md", "gone")}
    assert wiki.index(p).first()["refs"] == "b,gone,a"

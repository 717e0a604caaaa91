"""Operators that work by rounds or blocks, against plain Python."""

from __future__ import annotations

import heapq
import random
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import catalog
from lattica.model import Graph
from lattica.operators import cluster, substrings, traverse, trigrams, vectors, versions


def graph(spark, pairs, directed=False, more=()):
    """A graph of edges (source, target[, weight]) and nodes without edges."""
    ids = sorted({x for p in pairs for x in p[:2]} | set(more))
    n = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, ord long")
    e = spark.createDataFrame([(p[0], p[1], float(p[2]) if len(p) > 2 else None, i) for i, p in enumerate(pairs)], "source string, target string, weight double, ord long")
    return Graph(n, e, directed)


# Parts of texts


@pytest.mark.parametrize("seed", range(3))
def test_contained_is_every_part_held(spark, seed):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choices("abé😀 ", k=rnd.randint(0, 300))) for _ in range(60)] + ["", "a" * 500, "ab" * 200, None]
    parts = ["", "a", "zz", "a" * 40, "ba" * 30, None, "not in any of the texts at all"]
    for t in rnd.sample(texts[:60], 40):
        for n in (1, 3, 7, 8, 12, 22, 23, 24, 60):
            if len(t) >= n:
                i = rnd.randrange(len(t) - n + 1)
                parts += [t[i : i + n], t[i : i + n - 1] + "#"]
    out = substrings.contained(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(p,) for p in parts], "p string"), "p")
    want = {(t, p) for t in texts for p in parts if t is not None and p is not None and p in t}
    rows = [tuple(r) for r in out.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_index_of_a_text_in_pieces(monkeypatch):
    text = "".join(random.Random(1).choices("abcd", k=700))
    whole = [list(map(int, np.concatenate(x))) for x in zip(*substrings._places(text, 8, 16), strict=True)]
    monkeypatch.setattr(substrings, "PIECE", 50)
    assert set(zip(*whole, strict=True)) == {(int(p), int(g)) for a, b in substrings._places(text, 8, 16) for p, g in zip(a, b, strict=True)}
    assert len(whole[0]) < len(text) / 4


# Similar vectors and merges


def test_similarity_pairs_of_large_groups(spark, tmp_path):
    """More than 50 copies of a vector: every pair is given."""
    rows = [(i, [1.0, 0.5], 1) for i in range(60)] + [(60, [0.9, 0.6], 1), (61, [-1.0, 0.0], 1), (62, [1.0, 0.5], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = [(r.a, r.b) for r in catalog.queries()["similarity_pairs"](spark, str(tmp_path)).collect()]
    assert sorted(out) == sorted(tuple(sorted((str(i), str(j)))) for i, j in combinations(range(61), 2))


def some_vectors(spark, rows):
    return spark.createDataFrame([(f"v{i:04}", k, x, i) for i, (k, x) in enumerate(rows)], "id string, kind string, x array<double>, ord long")


def brute(rows, threshold):
    out = set()
    for (i, (k, x)), (j, (m, y)) in combinations(enumerate(rows), 2):
        if k == m and k is not None and x is not None and y is not None:
            n = np.linalg.norm(x) * np.linalg.norm(y)
            if (np.dot(x, y) / n if n else 0.0) >= threshold:
                out.add((f"v{i:04}", f"v{j:04}"))
    return out


@pytest.mark.parametrize("threshold", [0.9, 0.3, 0.0, -0.5])
def test_similar_is_every_pair(spark, monkeypatch, threshold):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rnd = np.random.default_rng(4)
    middle = rnd.normal(size=(12, 6))
    rows = [("abc"[i % 3] if i % 7 else "a", (middle[i % 12] + rnd.normal(size=6) * 0.2).tolist()) for i in range(240)]
    rows += [("a", [0.0] * 6), ("a", None), (None, middle[0].tolist()), ("b", rows[4][1]), ("b", rows[4][1])]
    df = some_vectors(spark, rows)
    found = [(r.a, r.b) for r in vectors.similar(df, df, threshold).collect()]
    assert set(found) == brute(rows, threshold) and len(found) == len(set(found))


def test_blocks_far_apart_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rnd = np.random.default_rng(5)
    middle = rnd.normal(size=(16, 8))
    rows = [("a", (middle[i % 16] + rnd.normal(size=8) * 0.02).tolist()) for i in range(480)]
    seen, stored = [], vectors.stored
    monkeypatch.setattr(vectors, "stored", lambda df, what="": seen.append((what, out := stored(df, what))) or out)
    df = some_vectors(spark, rows)
    assert {(r.a, r.b) for r in vectors.similar(df, df, 0.95).collect()} == brute(rows, 0.95)
    met = next(t for what, t in seen if what == "meet").count()
    assert met * 32 * 32 < 480 * 480 / 5


def test_vectors_of_two_lengths_are_an_error(spark):
    df = some_vectors(spark, [("a", [1.0, 2.0]), ("a", [1.0])])
    with pytest.raises(Exception, match="differ in length"):
        vectors.similar(df, df, 0.5).collect()


def test_no_vectors(spark):
    df = some_vectors(spark, [])
    assert vectors.similar(df, df, 0.5).collect() == []


def greedy(pairs, n):
    gone, out = set(), []
    for a, b, _, ao, nth in sorted(pairs, key=lambda p: (p[3], p[4], p[0], p[1])):
        if a not in gone and b not in gone:
            keep, drop = (a, b) if n.get(a, 0) >= n.get(b, 0) else (b, a)
            gone.add(drop)
            out.append((keep, drop))
    return sorted(out)


def merged(spark, pairs, n, **more):
    p = spark.createDataFrame(pairs, "a string, b string, similarity double, ao long, nth int")
    ids = sorted({x for q in pairs for x in q[:2]})
    nodes = spark.createDataFrame([(i, ["p"] * n.get(i, 0)) for i in ids], "id string, provenance array<string>")
    return sorted((r.merged_id, r.absorbed_id) for r in vectors.merges(p, nodes, **more).collect())


@pytest.mark.parametrize(("seed", "settled"), [(1, 100_000), (2, 3), (3, 0)])
def test_merges_are_those_in_order(spark, seed, settled):
    rnd = random.Random(seed)
    names = [f"n{i:03}" for i in range(60)]
    pairs = [(*sorted(p), 0.9, rnd.randrange(20), rnd.randrange(5)) for p in rnd.sample(list(combinations(names, 2)), 90)]
    n = {x: rnd.randrange(3) for x in names}
    assert merged(spark, pairs, n, settled=settled) == greedy(pairs, n)


def test_a_chain_of_many_pairs(spark):
    pairs = [(f"n{i:05}", f"n{i + 1:05}", 0.9, i, 1) for i in range(10_000)]
    assert merged(spark, pairs, {}) == greedy(pairs, {})
    assert merged(spark, [], {}) == []


def test_one_node_absorbs_many_in_few_rounds(spark, monkeypatch):
    """Groups of copies, each of which one node absorbs pair by pair."""
    pairs = [(f"g{g:02}-{i:03}", f"g{g:02}-{j:03}", 1.0, g * 100 + i, j) for g in range(4) for i in range(40) for j in range(i + 1, 40)]
    steps, stored = [], vectors.stored
    monkeypatch.setattr(vectors, "stored", lambda df, what="": steps.append(what) or stored(df, what))
    assert merged(spark, pairs, {}, settled=0) == greedy(pairs, {})
    assert steps.count("firsts") <= 3


def test_equal_vectors_have_equal_cosines(spark):
    x, others = np.random.default_rng(7).normal(size=64).tolist(), np.random.default_rng(8).normal(size=(37, 64)).tolist()
    rows = [("a", v) for o in others for v in (o, x)]
    df = some_vectors(spark, rows)
    found = vectors.similar(df, df, -1.0).collect()
    by_other = {}
    for r in found:
        i, j = int(r.a[1:]), int(r.b[1:])
        if i % 2 != j % 2:
            by_other.setdefault(i if j % 2 else j, set()).add(r.similarity)
    assert len(by_other) == 37 and all(len(v) == 1 for v in by_other.values())


# Communities


def measure(pairs, home):
    """Modularity by the definition."""
    total, k = 2 * sum(w for *_, w in pairs), {}
    for a, b, w in pairs:
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
    inside = 2 * sum(w for a, b, w in pairs if home[a] == home[b])
    sums: dict = {}
    for x, d in k.items():
        sums[home[x]] = sums.get(home[x], 0) + d
    return inside / total - sum(s * s for s in sums.values()) / total**2


def test_ring_of_cliques(spark):
    pairs = [(f"c{c}n{a}", f"c{c}n{b}", 1) for c in range(12) for a, b in combinations(range(5), 2)] + [(f"c{c}n0", f"c{(c + 1) % 12}n1", 1) for c in range(12)]
    g = graph(spark, pairs, more=["alone"])
    found = cluster.multilevel(g)
    home = {r.id: r.community for r in found.collect()}
    assert len(home) == 61 and all(len({home[f"c{c}n{i}"] for i in range(5)}) == 1 for c in range(12))
    assert sorted(set(home.values())) == list(range(len(set(home.values())))) and list(home.values()).count(home["alone"]) == 1
    assert cluster.modularity(g, found) == pytest.approx(measure(pairs, home)) and measure(pairs, home) > 0.75


def test_levels_beat_local_moves_and_stay_connected(spark):
    rnd = random.Random(8)
    group = {f"n{i:03}": i % 8 for i in range(160)}
    pairs = [(a, b, 1 + rnd.random()) for a, b in combinations(group, 2) if rnd.random() < (0.25 if group[a] == group[b] else 0.02)] + [("n000", "n000", 2.0), ("n000", "n008", 1.0)]
    g = graph(spark, pairs)
    found = {r.id: r.community for r in cluster.multilevel(g).collect()}
    plain = {r.id: r.community for r in cluster.clusters(g).collect()}
    assert measure(pairs, found) >= max(measure(pairs, plain), 0.96 * measure(pairs, group))
    for c in set(found.values()):
        own = [x for x in found if found[x] == c]
        seen, open_ = {own[0]}, [own[0]]
        while open_:
            x = open_.pop()
            new = {b if a == x else a for a, b, _ in pairs if x in (a, b)} & set(own) - seen
            seen |= new
            open_ += new
        assert seen == set(own)


def test_communities_of_nothing(spark):
    g = graph(spark, [], more=["a", "b"])
    assert sorted(r.community for r in cluster.multilevel(g).collect()) == [0, 1] and cluster.multilevel(graph(spark, [])).collect() == []


def shuffled(spark):
    """Bytes that the session's tasks have written for shuffles."""
    time.sleep(1)
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_a_round_hands_on_homes_not_hops(spark):
    rnd = random.Random(9)
    pairs = [(f"a{a:03}", f"b{b:02}", 1) for a in range(400) for b in range(80) if rnd.random() < 0.6]
    g = graph(spark, pairs)
    for df in (g.nodes, g.edges):
        df.count()
    start = shuffled(spark)
    home = {r.id: r.community for r in cluster.multilevel(g, rounds=8, levels=1, cycles=1).collect()}
    assert len(home) == 480 and shuffled(spark) - start < 80 * len(pairs)


def test_odd_edges_count_as_stated(spark, monkeypatch):
    pairs = [("a", "b", 2.0), ("b", "a", 1.0), ("c", "d"), ("c", "c", 1.0), ("d", "gone", 9.0), ("b", "c", 0.25)]
    g = graph(spark, pairs, more=["x"])
    g = type(g)(g.nodes.filter("id <> 'gone'"), g.edges)
    monkeypatch.setattr(cluster, "BLOCK_HOPS", 1)
    home = {r.id: r.community for r in cluster.multilevel(g, cycles=1).collect()}
    assert sorted(home) == ["a", "b", "c", "d", "x"] and home["a"] == home["b"] != home["c"] == home["d"] and len(set(home.values())) == 3


# Walks


def near(pairs, start, most=None, directed=False):
    hops: dict = {}
    for a, b, *_ in pairs:
        hops.setdefault(a, set()).add(b)
        if not directed:
            hops.setdefault(b, set()).add(a)
    depth, front = {start: 0}, [start]
    while front and (most is None or depth[front[0]] < most):
        front = [b for b in dict.fromkeys(b for a in front for b in hops.get(a, ())) if b not in depth and not depth.update({b: depth[front[0]] + 1})]
    return depth


@pytest.mark.parametrize(("most", "directed"), [(None, False), (2, True)])
def test_depths_from_many_starts(spark, most, directed):
    rnd = random.Random(6)
    names = [f"n{i:03}" for i in range(140)]
    pairs = [tuple(rnd.choices(names, k=2)) for _ in range(170)]
    g = graph(spark, pairs, directed, names)
    out = {(r.start, r.id): r.depth for r in traverse.depths(g, g.nodes.select("id").unionByName(spark.createDataFrame([("unknown",)], "id string")), most).collect()}
    assert out == {(s, i): d for s in names for i, d in near(pairs, s, most, directed).items()}


def dijkstra(pairs, start, directed):
    hops: dict = {}
    for a, b, w in pairs:
        hops.setdefault(a, []).append((b, w))
        if not directed:
            hops.setdefault(b, []).append((a, w))
    best, queue = {}, [(0.0, start)]
    while queue:
        d, x = heapq.heappop(queue)
        if x not in best:
            best[x] = d
            for b, w in hops.get(x, []):
                heapq.heappush(queue, (d + w, b))
    return best


@pytest.mark.parametrize(("directed", "width"), [(False, None), (True, 0.5), (False, 100.0)])
def test_distances_are_the_least(spark, directed, width):
    rnd = random.Random(9)
    names = [f"n{i:02}" for i in range(40)]
    pairs = [(*rnd.choices(names, k=2), rnd.choice([0, 1, 2, 3, 9]) / 2) for _ in range(90)]
    out = {r.id: (r.distance, r.parent) for r in traverse.distances(graph(spark, pairs, directed, names), "n00", width).collect()}
    want = dijkstra(pairs, "n00", directed)
    assert {k: v[0] for k, v in out.items()} == want
    weights: dict = {}
    for a, b, w in pairs + ([] if directed else [(b, a, w) for a, b, w in pairs]):
        weights[a, b] = min(w, weights.get((a, b), w))
    for x, (d, p) in out.items():
        steps = 0
        while p is not None:
            assert out[p][0] + weights[p, x] == out[x][0]
            x, p, steps = p, out[p][1], steps + 1
            assert steps <= len(names)
        assert x == "n00"


def test_negative_weights_and_unknown_starts(spark):
    with pytest.raises(ValueError, match="negative"):
        traverse.distances(graph(spark, [("a", "b", -1)]), "a")
    assert traverse.distances(graph(spark, [("a", "b", 1)]), "x").collect() == []


def test_layers_by_peeling(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d"), ("d", "e"), ("x", "y"), ("y", "x"), ("y", "z"), ("a", "b")]
    out = {r.id: r.layer for r in traverse.layers(graph(spark, pairs, True, ["alone"])).collect()}
    assert out == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3, "alone": 0, "x": None, "y": None, "z": None}


# Versions


def test_any_version_is_its_replay(spark):
    rnd, store, state, kept = random.Random(3), versions.Versions(spark), {}, {}
    ddl = "id string, removed boolean, v long, w string"
    for k in range(1, 9):
        rows = [(f"k{i}", rnd.random() < 0.3, rnd.randrange(100), rnd.choice([None, "x"])) for i in rnd.sample(range(12), rnd.randint(0, 6))]
        if k == 4:  # a commit that fails before its log is written does not count
            log, versions.Versions._put = versions.Versions._put, lambda self, df, what, at, put=versions.Versions._put: put(self, df, what, at) if what != "log" else 1 / 0
            with pytest.raises(ZeroDivisionError):
                store.commit(spark.createDataFrame([("k1", False, -1, "lost")], ddl), 40)
            versions.Versions._put = log
        store.commit(spark.createDataFrame(rows, ddl), 10 * k, f"c{k}")
        for i, gone, v, w in rows:
            state.pop(i, None)
            if not gone:
                state[i] = (v, w)
        kept[10 * k] = dict(state)
    for k, want in kept.items():
        for at in (k, k + 5):
            assert {r.id: (r.v, r.w) for r in store.as_of(at).collect()} == want
    assert store.as_of(3).collect() == [] and store.latest() == 80 and store.log().count() == 8
    asked = [(i, f"k{i % 13}", rnd.randrange(0, 90)) for i in range(80)]
    got = {r.row: (r.v, r.w) for r in store.joined(spark.createDataFrame(asked, "row long, id string, version long")).collect()}
    assert got == {row: kept[v // 10 * 10][i] for row, i, v in asked if v >= 10 and i in kept[v // 10 * 10]}
    store.rolled_back(90, 30)
    assert {r.id: (r.v, r.w) for r in store.as_of(95).collect()} == kept[30] and {r.id: (r.v, r.w) for r in store.as_of(85).collect()} == kept[80]
    with pytest.raises(ValueError, match="not after"):
        store.rolled_back(90, 30)


# Text index


def test_index_finds_what_a_scan_finds(spark):
    rnd = random.Random(12)
    docs = [(i, "".join(rnd.choices("abC é", k=rnd.randint(0, 30)))) for i in range(200)] + [(900, None), (901, "")]
    index = trigrams.TextIndex(spark, parts=4)
    d = spark.createDataFrame(docs, "id long, text string")
    index.add(d.filter("id < 100"), "one")
    index.add(d.filter("id < 50"), "one")
    index.add(d.filter("id < 100"), "one")
    index.add(d.filter("id >= 100"), "two")
    for term in ("", "a", "bC", "ab", "abc", "É", "a b", "ccca", "abab", "zzz"):
        assert sorted(r.id for r in index.search(term).collect()) == [i for i, t in docs if t is not None and term.lower() in t.lower()], term
    scores = {r.id: r.score for r in index.scored(["ab", "abc", "ab"]).collect()}
    assert scores == {i: n for i, t in docs if t and (n := ("ab" in t.lower()) + ("abc" in t.lower()))}


def test_a_search_opens_the_folders_of_its_grams_only(spark):
    index = trigrams.TextIndex(spark, parts=8)
    index.add(spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "id long, text string"), "b")
    plan = index.candidates("numb")._jdf.queryExecution().toString()
    assert "PartitionFilters: [part" in plan and "gram" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_long_texts_are_indexed_in_linear_time(spark):
    rnd = random.Random(13)
    docs = [(i, "".join(rnd.choices("abcdefg", k=600_000))) for i in range(2)] + [(i, "abcdefg") for i in range(2, 500)]
    index, start = trigrams.TextIndex(spark, parts=4), time.perf_counter()
    index.add(spark.createDataFrame(docs, "id long, text string"), "b")
    assert time.perf_counter() - start < 60
    assert index.postings().count() < 5_000  # a row for each gram of a batch of texts, not for each of a text
    assert [r.id for r in index.search(docs[1][1][1000:1020]).collect()] == [1]


def test_starts_of_one_region_share_their_rows(spark, monkeypatch):
    """Forty regions of ten starts whose names alternate: a node is reached from one part, not from a word of each few starts."""
    pairs = [(f"s{i:02}-{r:02}", f"c{r:02}-{j}") for r in range(40) for i in range(10) for j in range(3)]
    g = graph(spark, pairs)
    tables, stored = [], traverse.stored
    monkeypatch.setattr(traverse, "stored", lambda df, what="": tables.append((what, out := stored(df, what))) or out)
    monkeypatch.setattr(traverse, "WORDS", 2, raising=False)
    out = {(r.start, r.id): r.depth for r in traverse.depths(g, g.nodes.filter("id LIKE 's%'").select("id"), 3).collect()}
    starts = sorted({a for a, _ in pairs})
    assert out == {(s, i): d for s in starts for i, d in near(pairs, s, 3, False).items()}
    assert sum(t.count() for what, t in tables if what == "front") <= 400 + 2 * (120 + 400)


def shuffled_rows(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark._jvm.scala.Array.emptyDoubleArray(), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_depths_shuffle_fewer_rows_than_there_are_hops(spark):
    """Neither the hops of a level nor the rows that come out are dealt out one by one, also where no table is small enough for a broadcast."""
    pairs = [(f"c{j:03}", f"s{i:03}") for i in range(150) for j in range(300)]
    g = graph(spark, pairs)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_rows(spark)
        rows = traverse.depths(g, g.nodes.filter("id LIKE 's%'").select("id"), 3).groupBy("depth").count().collect()
        moved = shuffled_rows(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["depth"]: r["count"] for r in rows} == {0: 150, 1: 45_000, 2: 150 * 149}
    assert moved < 45_000


@pytest.mark.parametrize("directed", [False, True])
def test_depths_over_many_blocks_and_parts(spark, monkeypatch, directed):
    """Blocks of seven hops cut nodes' hops apart, parts hold 64 starts, known bits are summed up again and again; ends are unknown, null or repeated."""
    for name, value in {"BLOCK_HOPS": 7, "PARTS": 1, "PAST": 2, "WORDS": 1}.items():
        monkeypatch.setattr(traverse, name, value, raising=False)
    rnd = random.Random(7)
    names = [f"n{i:03}" for i in range(130)]
    pairs = [tuple(rnd.choices(names, k=2)) for _ in range(120)] + [("n000", n) for n in names[:30]] + [("n000", "n001")] * 3
    g = graph(spark, pairs, directed, names)
    more = spark.createDataFrame([("n002", None), (None, "n003"), ("n004", "loose"), ("n005", "loose")], "source string, target string")
    g = Graph(g.nodes, g.edges.unionByName(more, allowMissingColumns=True), directed)
    out = [((r.start, r.id), r.depth) for r in traverse.depths(g, g.nodes.select("id"), 5).collect()]
    hops = pairs + [("n004", "loose"), ("n005", "loose")]
    want = {}
    for s in names:
        # an unknown end is reached, and leads no further
        inner = near(pairs, s, 5, directed)
        want |= {(s, i): d for i, d in inner.items()}
        loose = [inner[a] + 1 for a, b in hops if b == "loose" and inner.get(a, 5) < 5]
        if loose:
            want[s, "loose"] = min(loose)
    assert len(out) == len(want) and dict(out) == want


def test_layers_write_only_what_a_level_meets(spark, monkeypatch):
    pairs = [("a", f"m{i}") for i in range(5)] + [(f"m{i}", "z") for i in range(5)] + [("z", f"y{i}") for i in range(300)] + [("q", "a"), ("q", "q2"), ("q2", "a"), ("u", "v"), ("v", "u"), ("v", "w"), ("q", "w")]
    tables, stored = [], traverse.stored
    monkeypatch.setattr(traverse, "stored", lambda df, what="": tables.append((what, out := stored(df, what))) or out)
    g = graph(spark, pairs, True)
    out = {r.id: r.layer for r in traverse.layers(Graph(g.nodes.filter("id <> 'y7'"), g.edges, True)).collect()}
    want = {"q": 0, "q2": 1, "a": 2, "z": 4, "u": None, "v": None, "w": None} | {f"m{i}": 3 for i in range(5)} | {f"y{i}": 5 for i in range(300) if i != 7}
    assert out == want
    assert sum(t.count() for what, t in tables if what not in ("nodes", "hops", "need")) < 350

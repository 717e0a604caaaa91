"""Communities: local moving of nodes, by component or by rounds, and modularity by levels of contracted graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.model import Graph, numbered, stored

#: Hops that a block of nodes has on average, and that a task takes up at once (a single node's are never parted).
BLOCK_HOPS = 1 << 18
CHUNK_HOPS = 1 << 20


def component_of(g: Graph) -> DataFrame:
    """(id, component): least id reachable when edges are taken both ways; least-label propagation with pointer jumps."""
    ids = g.nodes.select("id").distinct()
    links = g.edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("o")), F.struct(F.col("target").alias("id"), F.col("source").alias("o")))).alias("e")).select("e.*").filter("id <> o").distinct()
    return _least(ids, links)


def _least(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) over ``links`` (id, o), which hold both ways of each."""
    links = stored(links, "links")
    now = stored(ids.withColumn("component", F.col("id")), "labels")
    while True:
        seen = links.join(now.select(F.col("id").alias("o"), "component"), "o").groupBy("id").agg(F.min("component").alias("best"))
        step = now.join(seen, "id", "left").select("id", "component", F.least("component", F.coalesce("best", "component")).alias("new"))
        jump = step.join(step.select(F.col("id").alias("new"), F.col("new").alias("far")), "new", "left")
        after = stored(jump.select("id", "component", F.least("new", F.coalesce("far", "new")).alias("new")), "labels")
        changed = not after.filter("component <> new").isEmpty()
        now = after.select("id", F.col("new").alias("component"))
        if not changed:
            return now


def clusters(g: Graph, resolution: float = 1.0, passes: int = 100) -> DataFrame:
    """(id, community): nodes move in order to the neighbour community of highest positive gain until nothing moves.

    A move's gain depends on the node's neighbours, its own degree and the weight of all edges only, so each connected component is
    settled on its own (one component is one task); communities are then numbered by first appearance. In a directed graph a node is drawn by
    the nodes its edges lead to only; its degree counts all its edges, a loop once, and a loop draws it to where it is. Edges with an end that is no node are dropped.
    """
    known, directed = g.nodes.select("id", "ord"), g.directed
    edges = g.edges.select("source", "target", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.col("ord").alias("place"))
    for end in ("source", "target"):
        edges = edges.join(known.select(F.col("id").alias(end)), end, "left_semi")
    edges = stored(edges, "edges")
    total = float(edges.agg(F.sum("weight")).first()[0] or 0.0)
    comp = component_of(Graph(g.nodes, edges.withColumnRenamed("place", "ord"), g.directed))
    rows = known.join(comp, "id").select("component", "id", "ord", F.lit(None).cast("string").alias("other"), F.lit(0.0).alias("weight"), F.lit(-1).cast("bigint").alias("place"))
    by_edge = edges.join(comp.withColumnRenamed("id", "source"), "source").select("component", F.col("source").alias("id"), F.lit(0).cast("bigint").alias("ord"), F.col("target").alias("other"), "weight", "place")

    def settle(pdf):
        import pandas as pd

        own = pdf[pdf.other.isna()].sort_values("ord")
        order = own.id.tolist()
        near: dict[str, list[tuple[str, float]]] = {n: [] for n in order}
        degree = dict.fromkeys(order, 0.0)
        for e in pdf[pdf.other.notna()].sort_values("place").itertuples():
            near[e.id].append((e.other, e.weight))
            degree[e.id] += e.weight
            if e.other != e.id:
                degree[e.other] += e.weight
            if not directed:
                near[e.other].append((e.id, e.weight))
        home = {n: i for i, n in enumerate(order)}
        for _ in range(passes if total > 0 else 0):
            moved = False
            for n in order:
                pull: dict[int, float] = {}
                for o, w in near[n]:
                    pull[home[o]] = pull.get(home[o], 0.0) + w
                here, best, target = pull.get(home[n], 0.0), 0.0, home[n]
                for c, w in pull.items():
                    gain = (w - here) / (2 * total) - resolution * degree[n] ** 2 / (4 * total * total)
                    if c != home[n] and gain > best:
                        best, target = gain, c
                if target != home[n]:
                    home[n], moved = target, True
            if not moved:
                break
        return pd.DataFrame({"component": pdf.component.iloc[0], "id": order, "ord": own.ord.tolist(), "local": [home[n] for n in order]})

    done = rows.unionByName(by_edge).groupBy("component").applyInPandas(settle, "component string, id string, ord bigint, local int")
    first = done.withColumn("first", F.min("ord").over(Window.partitionBy("component", "local")))
    heads = numbered(first.select("component", "local", "first").distinct(), "community", "first", "component").withColumn("community", F.col("community").cast("int"))
    return first.join(heads, ["component", "local"]).select("id", "community")


def clusters_by_rounds(g: Graph, resolution: float = 1.0, rounds: int = 30) -> DataFrame:
    """(id, community) by the same gain, for components too large for one task: in each round the nodes of one half, drawn by their id and the
    round, move at once to the neighbour community of highest positive gain (the least of equals). A round is two joins by node; no component is brought
    together. Not the communities that ``clusters`` finds, which depend on the order of moves, but a local optimum of the same measure."""
    known = g.nodes.select("id", "ord")
    edges = g.edges.select("source", "target", F.coalesce("weight", F.lit(1.0)).alias("w"))
    for end in ("source", "target"):
        edges = edges.join(known.select(F.col("id").alias(end)), end, "left_semi")
    ways = F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("o"), "w"), *([] if g.directed else [F.struct(F.col("target").alias("id"), F.col("source").alias("o"), "w")]))
    hops = stored(edges.select(F.explode(ways).alias("e")).select("e.*").groupBy("id", "o").agg(F.sum("w").alias("w")), "hops")
    total = float(edges.agg(F.sum("w")).first()[0] or 0.0)
    degree = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("k"))
    now = stored(known.join(degree, "id", "left").select("id", "ord", F.coalesce("k", F.lit(0.0)).alias("k"), F.col("id").alias("home")), "homes")
    still = 0
    for r in range(rounds if total > 0 else 0):
        pull = hops.join(now.select(F.col("id").alias("o"), F.col("home").alias("to")), "o").groupBy("id", "to").agg(F.sum("w").alias("w"))
        own = pull.join(now.filter(F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0), "id")
        here = own.groupBy("id").agg(F.coalesce(F.sum(F.when(F.col("to") == F.col("home"), F.col("w"))), F.lit(0.0)).alias("here"))
        gain = (F.col("w") - F.col("here")) / (2 * total) - resolution * F.col("k") * F.col("k") / (4 * total * total)
        best = own.join(here, "id").filter("to <> home").withColumn("gain", gain).filter("gain > 0").groupBy("id").agg(F.min(F.struct((-F.col("gain")).alias("g"), "to"))["to"].alias("new"))
        after = stored(now.join(best, "id", "left"), "homes")
        moved = after.filter("new IS NOT NULL").count()
        now = after.select("id", "ord", "k", F.coalesce("new", "home").alias("home"))
        still = 0 if moved else still + 1
        if still == 2:
            break
    heads = numbered(now.groupBy("home").agg(F.min("ord").alias("first")), "community", "first", "home")
    return now.join(heads, "home").select("id", F.col("community").cast("int").alias("community"))


def hops_of(g: Graph) -> DataFrame:
    """(id, o, w): both directions of each edge between known nodes, parallel edges summed; a loop counts twice. A null weight is 1."""
    known = g.nodes.select("id").distinct()
    edges = g.edges.select("source", "target", F.coalesce("weight", F.lit(1.0)).alias("w"))
    for end in ("source", "target"):
        edges = edges.join(known.withColumnRenamed("id", end), end, "left_semi")
    ways = F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("o"), "w"), F.struct(F.col("target").alias("id"), F.col("source").alias("o"), "w"))
    return edges.select(F.explode(ways).alias("e")).select("e.*").groupBy("id", "o").agg(F.sum("w").alias("w"))


def modularity(g: Graph, found: DataFrame, resolution: float = 1.0) -> float:
    """Of communities (id, community): the share of weight inside them less ``resolution`` times what chance would put there; edges are taken both ways."""
    hops = hops_of(g).join(found.select("id", F.col("community").alias("c")), "id").join(found.select(F.col("id").alias("o"), F.col("community").alias("d")), "o")
    return _measure(hops.groupBy("c", "d").agg(F.sum("w").alias("w")).select(F.col("c").alias("id"), F.col("d").alias("o"), "w"), resolution)


def _measure(hops: DataFrame, resolution: float) -> float:
    """Modularity of a contracted graph (id, o, w) with a node for each community."""
    return _quality(hops.groupBy("id").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("id") == F.col("o"), F.col("w"))).alias("inside")), resolution)


def _quality(own: DataFrame, resolution: float) -> float:
    """Modularity by each community's degree ``k`` and weight ``inside``."""
    row = own.agg(F.sum("k"), F.sum("inside"), F.sum(F.col("k") * F.col("k"))).first()
    return (row[1] or 0.0) / row[0] - resolution * row[2] / row[0] ** 2 if row[0] else 0.0


def multilevel(g: Graph, resolution: float = 1.0, rounds: int = 16, levels: int = 12, cycles: int = 3, least_gain: float = 1e-5) -> DataFrame:
    """(id, community): communities of high modularity, by levels, without bringing a component together.

    At each level nodes move by rounds: those of one half, drawn by a hash, each go to the neighbour community that raises modularity most, by the weight of
    hops into it and its summed degree. Nodes are numbered in the order of their ids and keep their hops in one row, as arrays; rows of neighbouring numbers are a
    block, and a round sends each node's home to the blocks it has hops to, not to each hop. Communities that moves have left in several pieces are split into these, so all are
    connected. Then each community becomes a node of a smaller weighted graph, and the next level moves those; a level that does not raise modularity by ``least_gain``
    is undone and ends the cycle. The next cycle moves single nodes again, from the communities found, and goes on from there, as long as that helps. Edges are taken both
    ways, also in a directed graph. Communities are numbered by the first of their nodes. Nodes without edges are communities of their own; an empty graph gives no rows.
    """
    names = numbered(g.nodes.select("id").dropna().distinct(), "n", "id").select("id", F.col("n").cast("int").alias("n"))
    base = _Level(_ends(g, names), names)
    total = base.total
    home = base.near.select("id", F.col("id").alias("home"))
    best = _quality(base.near, resolution) if total else 0.0
    for cycle in range(cycles if total else 0):
        before, at, own = best, base, home
        for level in range(levels):
            moved = _split(at, _moved(at, own, total, resolution, rounds, cycle * levels + level))
            smaller = _contracted(at, moved, names)
            now = _quality(smaller.near, resolution)
            if now < best + least_gain:
                break
            if level:
                moved = stored(home.join(moved.select(F.col("id").alias("home"), F.col("home").alias("to")), "home").select("id", F.col("to").alias("home")), "homes")
            home, at, best, own = moved, smaller, now, None
        if best < before + least_gain:
            break
    first = g.nodes.groupBy("id").agg(F.min("ord").alias("ord")).join(names, "id")
    rows = first.join(home.withColumnRenamed("id", "n"), "n", "left").withColumn("home", F.coalesce("home", "n"))
    heads = numbered(rows.groupBy("home").agg(F.min("ord").alias("first")), "community", "first", "home")
    return rows.join(heads, "home").select("id", F.col("community").cast("int").alias("community"))


def _ends(g: Graph, names: DataFrame) -> DataFrame:
    """(id, o, w): both directions of each edge between known nodes, by their numbers; a loop counts twice. A null weight is 1."""
    edges = g.edges.select("source", "target", F.coalesce("weight", F.lit(1.0)).alias("w"))
    edges = edges.join(names.toDF("source", "s"), "source").select("target", "s", "w").join(names.toDF("target", "t"), "target")
    ways = F.array(F.struct(F.col("s").alias("id"), F.col("t").alias("o"), "w"), F.struct(F.col("t").alias("id"), F.col("s").alias("o"), "w"))
    return edges.select(F.explode(ways).alias("e")).select("e.*").repartition("id")


class _Level:
    """A graph with a row for each node: ``near`` has (id, name, k, inside, o, w), its degree, the weight of its loops, and its hops as arrays;
    ``needs`` has (id, blocks), where its home is asked for. The rows of ``hops`` are dealt out by id."""

    def __init__(self, hops: DataFrame, names: DataFrame):
        by_node = hops.groupBy("id", "o").agg(F.sum("w").alias("w")).groupBy("id")
        by_node = by_node.agg(F.sum("w").alias("k"), F.sum(F.when(F.col("o") == F.col("id"), F.col("w"))).alias("inside"), F.sort_array(F.collect_list(F.struct("o", "w"))).alias("e"))
        by_node = by_node.join(names.select(F.col("n").alias("id"), F.col("id").alias("name")), "id")
        self.near = stored(by_node.select("id", "name", "k", "inside", F.col("e.o").alias("o"), F.col("e.w").alias("w")), "near")
        row = self.near.agg(F.count("*"), F.sum("k"), F.sum(F.size("o").cast("long")), F.max("id")).first()
        self.nodes, self.total = row[0], float(row[1] or 0.0)
        self.span = max(1, BLOCK_HOPS * ((row[3] or 0) + 1) // max(row[2] or 0, 1))
        asked = F.array_distinct(F.transform(F.concat("o", F.array("id")), self.block))
        self.needs = stored(self.near.select("id", asked.alias("blocks")), "needs")

    def block(self, id: Column) -> Column:
        return F.floor(id / self.span).cast("int")

    def met(self, rows: DataFrame, state: DataFrame, fn, schema: str) -> DataFrame:
        """``fn`` of each block's ``rows`` (of ``near``) and the ``state`` (id, ...) of all nodes these have hops to and of their own."""
        asked = self.needs.join(state, "id").withColumn("block", F.explode("blocks")).drop("blocks")
        return rows.withColumn("block", self.block(F.col("id"))).groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(fn, schema)


def _hops(rows: pa.Table, ids: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """By chunks: places in the sorted ``ids`` of the nodes, for each hop which of these nodes it leaves, the place it leads to, and its weight."""
    for batch in rows.to_batches():
        start, sizes = 0, batch.column("o").value_lengths().to_numpy(zero_copy_only=False)
        while start < len(sizes):
            stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), CHUNK_HOPS, "right")))
            part = batch.slice(start, stop - start)
            to, w = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in "ow")
            yield np.searchsorted(ids, part.column("id").to_numpy()), np.repeat(np.arange(stop - start), sizes[start:stop]), np.searchsorted(ids, to), w
            start = stop


def _sorted_state(state: pa.Table) -> list[np.ndarray]:
    """Columns id, home, ... of the nodes, by id."""
    columns = [state.column(c).to_numpy() for c in state.column_names if c != "block"]
    order = np.argsort(columns[0])
    return [c[order] for c in columns]


def _summed(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending, a place of each, and the sum of its weights."""
    order = np.argsort(key, kind="stable")
    firsts = np.flatnonzero(np.diff(key[order], prepend=-1)) if len(key) else np.zeros(0, np.int64)
    return key[order][firsts], order[firsts], np.add.reduceat(w[order], firsts) if len(key) else w


def _table(schema: str, parts: list[tuple], **types: pa.DataType) -> pa.Table:
    names = schema.split()
    return pa.table({n: pa.chunked_array([pa.array(p[i], types[n]) for p in parts], types[n]) for i, n in enumerate(names)})


def _contracted(at: _Level, home: DataFrame, names: DataFrame) -> _Level:
    """The graph with a node for each home."""

    def sums(rows: pa.Table, state: pa.Table) -> pa.Table:
        ids, homes = _sorted_state(state)
        parts = []
        for nodes, own, to, w in _hops(rows, ids):
            keys, _, w = _summed(homes[nodes][own].astype(np.int64) << 32 | homes[to], w)
            a = keys >> 32
            firsts = np.flatnonzero(np.diff(a, prepend=-1))
            offsets = pa.array(np.append(firsts, len(a)), pa.int32())
            parts.append((a[firsts], pa.ListArray.from_arrays(offsets, pa.array(keys & 0xFFFFFFFF, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(w))))
        return _table("id o w", parts, id=pa.int32(), o=pa.list_(pa.int32()), w=pa.list_(pa.float64()))

    packed = at.met(at.near.select("id", "o", "w"), home, sums, "id int, o array<int>, w array<double>")
    return _Level(packed.repartition("id").select("id", F.explode(F.arrays_zip("o", "w")).alias("e")).select("id", "e.o", "e.w"), names)


def _moved(at: _Level, start: DataFrame | None, total: float, resolution: float, rounds: int, level: int) -> DataFrame:
    """(id, home) of the nodes after moves by rounds, from the homes of ``start`` (without it, each by itself)."""
    now = at.near.select("id", "k")
    now = stored(now.withColumn("home", F.col("id")) if start is None else now.join(start, "id"), "homes")

    def goes(rows: pa.Table, state: pa.Table) -> pa.Table:
        ids, homes, degrees, tots, counts = _sorted_state(state)
        parts = []
        for nodes, own, to, w in _hops(rows, ids):
            hop = to != nodes[own]
            own, to, w = np.append(own[hop], np.arange(len(nodes))), np.append(to[hop], nodes), np.append(w[hop], np.zeros(len(nodes)))
            keys, places, w = _summed(own.astype(np.int64) << 32 | homes[to], w)
            own, to, there = keys >> 32, (keys & 0xFFFFFFFF).astype(np.int32), to[places]
            stays, k = to == homes[nodes][own], degrees[nodes][own]
            gain = w - resolution * k * (tots[there] - np.where(stays, k, 0.0)) / total
            best = np.lexsort((to, gain, own))
            best = best[np.append(np.flatnonzero(np.diff(own[best])), len(best) - 1)]  # a node's last; its own home is always there
            here, alone = gain[stays], counts[nodes]
            swap = (alone == 1) & (counts[there[best]] == 1) & (to[best] > homes[nodes])  # two single nodes would change places
            gone = (gain[best] > here + 1e-12) & ~swap
            parts.append((ids[nodes[gone]], to[best][gone]))
        return _table("id new", parts, id=pa.int32(), new=pa.int32())

    still = 0
    for r in range(rounds):
        sums = now.groupBy("home").agg(F.sum("k").alias("tot"), F.count("*").alias("members"))
        state = now.join(sums, "home").select("id", "home", "k", "tot", "members")
        drawn = at.near.filter(F.pmod(F.xxhash64("name", F.lit(level), F.lit(r // 2)), F.lit(2)) == r % 2)
        after = stored(now.join(at.met(drawn.select("id", "o", "w"), state, goes, "id int, new int"), "id", "left"), "homes")
        gone = after.filter("new IS NOT NULL").count()
        now = after.select("id", "k", F.coalesce("new", "home").alias("home"))
        still = 0 if gone * 1000 > at.nodes else still + 1
        if still == 2:
            break
    return now.select("id", "home")


def _split(at: _Level, moved: DataFrame) -> DataFrame:
    """(id, home) with each community's connected pieces apart, named by their least node. Of a block's hops inside communities only the least node
    that each reaches by them is handed on, which links the same nodes."""

    def reached(rows: pa.Table, state: pa.Table) -> pa.Table:
        ids, homes = _sorted_state(state)
        parts = []
        for nodes, own, to, _ in _hops(rows, ids):
            a = nodes[own]
            inside = (homes[a] == homes[to]) & (a != to)
            a, b, least = a[inside], to[inside], np.arange(len(ids))
            while True:
                low = np.minimum(least[a], least[b])
                new = least.copy()
                np.minimum.at(new, a, low)
                np.minimum.at(new, b, low)
                new = new[new]
                if (new == least).all():
                    break
                least = new
            other = np.flatnonzero(least != np.arange(len(ids)))
            parts.append((ids[other], ids[least[other]]))
        return _table("id o", parts, id=pa.int32(), o=pa.int32())

    links = at.met(at.near.select("id", "o", "w"), moved, reached, "id int, o int")
    links = links.select(F.explode(F.array(F.struct("id", "o"), F.struct(F.col("o").alias("id"), F.col("id").alias("o")))).alias("e")).select("e.*").distinct()
    return stored(_least(moved.select("id"), links).select("id", F.col("component").alias("home")), "homes")


def modularity_gain(g: Graph, node: str, community: int) -> DataFrame:
    """Gain of moving ``node`` into ``community``: (weight of edges with an end there - degree squared) / (4 (W / 2)^2); 0 if it is there."""
    inside = g.nodes.filter(F.col("community") == community).select("id")
    hit = F.col("source").isin(node) | F.col("target").isin(node)
    sums = g.edges.join(inside.select(F.col("id").alias("target")).withColumn("at", F.lit(1)), "target", "left")
    sums = sums.agg(F.sum("weight").alias("w"), F.sum(F.when(hit, F.col("weight"))).alias("k"), F.sum(F.when(F.col("at") == 1, F.col("weight"))).alias("s"))
    there = g.nodes.filter((F.col("id") == node) & (F.col("community") == community)).agg((F.count("*") > 0).alias("same"))
    half = F.col("w") / 2
    gain = (F.coalesce("s", F.lit(0.0)) - F.pow(F.coalesce("k", F.lit(0.0)), 2)) / (4 * half * half)
    return sums.crossJoin(there).select(F.when(F.col("same") | (F.coalesce("w", F.lit(0.0)) == 0), 0.0).otherwise(gain).alias("gain"))

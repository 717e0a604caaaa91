"""Vector similarity, and deduplication of nodes by their embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.model import Graph, stored


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0).cast("double"), lambda a, x: a + x)


def _checked(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length"))).otherwise(value)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 with a zero vector, an error for vectors of two lengths."""
    d = lambda x, y: x.cast("double") * y.cast("double")
    norm = F.sqrt(_sum(F.transform(a, lambda x: d(x, x)))) * F.sqrt(_sum(F.transform(b, lambda x: d(x, x))))
    return _checked(a, b, F.when(norm == 0, 0.0).otherwise(_sum(F.zip_with(a, b, d)) / norm))


def euclidean(a: Column, b: Column) -> Column:
    return _checked(a, b, F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))))


def manhattan(a: Column, b: Column) -> Column:
    return _checked(a, b, _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))))


def rough_embedding(text: Column, size: int = 384) -> Column:
    """Stand-in for a model: component i is 0.1 sin(0.1 (i + 1) length)."""
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: 0.1 * F.sin(F.length(text) * i * 0.1))


def rough_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.abs(F.length(a) - F.length(b)) / longest)


def embedding_text() -> Column:
    return F.concat("label", F.lit(" ["), "type", F.lit("]"))


#: Vectors of a block, pivots against which blocks are measured, and vectors from which the pivots are drawn.
BLOCK, PIVOTS, DRAWN = 1024, 16, 2048


def similar(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): pairs of ``left`` and ``right`` (id, kind, x, ord) of one kind, the left one before the right one by ord, whose cosine is ``threshold`` or more.

    An exact join by blocks. A few vectors are pivots; each vector goes to the cell of the pivot at the least angle, and cells are dealt into blocks of about BLOCK
    vectors, however many a kind or cell has. A block knows the range of its vectors' angles to every pivot. By the triangle inequality two vectors whose angles to one pivot differ by
    more than the threshold's angle are not similar, so two blocks meet only if their ranges come that near at all pivots; blocks that meet are multiplied as matrices,
    a pair of blocks at a time. Pairs of blocks are few (a row each); a vector is sent as often as its block meets another. Vectors of other lengths than their
    partner's are an error; zero vectors have a cosine of 0, null ones no partner.
    """
    import numpy as np

    spark = left.sparkSession
    sides = [left] if right is left else [left, right]  # one table joined with itself is measured once
    rows = [stored(side.select("id", "kind", F.col("x").cast("array<double>").alias("x"), "ord").filter("x IS NOT NULL"), "vectors") for side in sides]
    sample = rows[-1].select("x").orderBy(F.xxhash64("id")).limit(DRAWN).toPandas().x.tolist()  # DRAWN rows at most
    size = max(map(len, sample), default=1)
    pivots = spread(np.array([x for x in sample if len(x) == size], float).reshape(-1, size), PIVOTS)
    near = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6 if threshold > 0 else np.pi
    blocks = ([_celled(side, pivots) for side in rows] * 2)[:2]
    ranges = []
    for cells, end in zip(blocks, ("l", "r"), strict=True):
        angles = [F.struct(F.min(F.col("angles")[i]).alias("low"), F.max(F.col("angles")[i]).alias("high")) for i in range(len(pivots))]
        ranges.append(cells.groupBy("kind", "cell", "salt").agg(F.array(*angles).alias(f"{end}_range"), F.min("ord").alias(f"{end}_first"), F.max("ord").alias(f"{end}_last")).withColumnsRenamed({"cell": f"{end}_cell", "salt": f"{end}_salt"}))
    far = lambda p: (p["l_range"]["low"] > p["r_range"]["high"] + near) | (p["r_range"]["low"] > p["l_range"]["high"] + near)
    apart = F.exists(F.arrays_zip("l_range", "r_range"), far) if len(pivots) else F.lit(False)
    meet = ranges[0].join(ranges[1], "kind").filter((F.col("l_first") < F.col("r_last")) & ~apart)
    meet = stored(meet.select("kind", "l_cell", "l_salt", "r_cell", "r_salt", F.monotonically_increasing_id().alias("task")), "meet")
    sent = []
    for cells, end in zip(blocks, ("l", "r"), strict=True):
        to = meet.select("kind", F.col(f"{end}_cell").alias("cell"), F.col(f"{end}_salt").alias("salt"), "task")
        sent.append(cells.join(to, ["kind", "cell", "salt"]).select("task", F.lit(end == "l").alias("side"), "id", "ord", "x"))
    kind = left.schema["id"].dataType.simpleString()

    def compared(pdf):
        import pandas as pd

        a, b = pdf[pdf.side], pdf[~pdf.side]
        if pdf.x.map(len).nunique() > 1:
            raise ValueError("vectors differ in length")
        x, y, ao, bo = np.array(a.x.tolist(), float), np.array(b.x.tolist(), float), a.ord.to_numpy(), b.ord.to_numpy()
        norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
        i, j = np.nonzero((x @ y.T >= (threshold - 1e-9) * norm) & (ao[:, None] < bo[None, :]))
        cos = paired(x, y, i, j)
        i, j, cos = i[cos >= threshold], j[cos >= threshold], cos[cos >= threshold]
        return pd.DataFrame({"a": a.id.to_numpy()[i], "b": b.id.to_numpy()[j], "ao": ao[i], "bo": bo[j], "similarity": cos})

    return sent[0].unionByName(sent[1]).groupBy("task").applyInPandas(compared, f"a {kind}, b {kind}, ao long, bo long, similarity double")


def paired(x, y, i, j):
    """Cosines of the rows ``i`` of x with the rows ``j`` of y, 0 with a zero row. Sums run from the first component to the last, so equal vectors have equal cosines wherever they
    lie; a product of matrices may differ in the last digit, and ties would be broken by that."""
    import numpy as np

    one = lambda v: sum((v[:, d] * v[:, d] for d in range(v.shape[1])), np.zeros(len(v)))
    out, xx, yy = np.empty(len(i)), one(x), one(y)
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        dot = sum((x[p, d] * y[q, d] for d in range(x.shape[1])), np.zeros(len(p)))
        norm = np.sqrt(xx[p] * yy[q])
        out[at : at + (1 << 16)] = np.clip(np.where(norm == 0, 0.0, dot / np.where(norm == 0, 1, norm)), -1, 1)
    return out


def spread(sample, count: int):
    """``count`` of the vectors of ``sample``, each the one farthest by angle from those before it; zero vectors are none."""
    import numpy as np

    norm = np.linalg.norm(sample, axis=1)
    unit = sample[norm > 0] / norm[norm > 0][:, None]
    if not len(unit):
        return unit
    taken, most = [0], unit @ unit[0]
    while len(taken) < min(count, len(unit)):
        taken.append(int(most.argmin()))
        most = np.maximum(most, unit @ unit[taken[-1]])
    return unit[taken]


def _celled(rows: DataFrame, pivots) -> DataFrame:
    """``rows`` with the angles to all pivots, the cell (the nearest pivot) and salt, that deals each kind's cells into blocks."""
    import numpy as np
    import pyarrow as pa

    def measure(batches):
        for batch in batches:
            x = batch.column("x").to_pylist()
            angles = np.full((len(x), len(pivots)), np.pi / 2)
            for i, v in enumerate(x):
                n = np.linalg.norm(v)
                if len(pivots) and len(v) == pivots.shape[1] and n > 0:
                    angles[i] = np.arccos(np.clip(pivots @ np.array(v) / n, -1, 1))
            cell = angles.argmin(axis=1) if len(pivots) else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(angles), pa.list_(pa.float64())), pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "angles", "cell"])

    out = stored(rows.mapInArrow(measure, T.StructType([*rows.schema.fields, *T.StructType.fromDDL("angles array<double>, cell int").fields])), "cells")
    kinds = out.groupBy("kind").agg((F.count("*") <= BLOCK).alias("small"))  # a small kind is one block
    out = out.join(kinds, "kind").withColumn("cell", F.when(F.col("small"), 0).otherwise(F.col("cell"))).drop("small")
    sizes = out.groupBy("kind", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    return out.join(sizes, ["kind", "cell"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks")


def candidates(nodes: DataFrame, threshold: float = 0.85, most: int = 50, compatible: list[tuple[str, str]] = ()) -> DataFrame:
    """(a, b, similarity, ao, nth): pairs of nodes (id, type, embedding, ord) of equal or compatible type and a cosine of
    ``threshold`` or more that are among the best ``most`` of either node (ties by order). ``ao`` and ``nth`` say where the pair is first met: the
    order of the node and the pair's rank there. Pairs come from ``similar``, each measured once."""
    spark = nodes.sparkSession
    kinds = stored(spark.createDataFrame([p for a, b in compatible for p in ((a, b), (b, a))], "type string, kind string"), "kinds")
    keyed = nodes.select("id", F.col("embedding").alias("x"), "ord", F.col("type").alias("kind"))
    wide = keyed.unionByName(nodes.join(kinds, "type").select("id", F.col("embedding").alias("x"), "ord", "kind")) if compatible else keyed
    pairs = stored(similar(wide, keyed, threshold).distinct() if compatible else similar(wide, keyed, threshold), "similar")
    ways = F.array(F.struct("a", "b", "ao", "bo", "similarity"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("bo").alias("ao"), F.col("ao").alias("bo"), "similarity"))
    ways = pairs.select(F.explode(ways).alias("w")).select("w.*")
    best = ways.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "bo"))).filter(F.col("nth") <= most)
    met = best.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"), F.min(F.struct("ao", "nth")).alias("met"))
    return met.select("a", "b", "similarity", "met.ao", "met.nth")


def boosted(pairs: DataFrame, edges: DataFrame, above: float = 0.3) -> DataFrame:
    """``pairs`` with similarity raised by the overlap of their neighbours: min(1, s (1 + 0.4 overlap)) over ``above``."""
    near = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("o")), F.struct(F.col("target").alias("id"), F.col("source").alias("o")))).alias("e"))
    near = near.groupBy("e.id").agg(F.collect_set("e.o").alias("near"))
    out = pairs.join(near.select(F.col("id").alias("a"), F.col("near").alias("na")), "a", "left").join(near.select(F.col("id").alias("b"), F.col("near").alias("nb")), "b", "left")
    empty = F.array().cast("array<string>")
    na, nb = F.coalesce("na", empty), F.coalesce("nb", empty)
    union = F.size(F.array_union(na, nb))
    out = out.withColumn("overlap", F.when(union > 0, F.size(F.array_intersect(na, nb)) / union).otherwise(0.0))
    lifted = F.least(F.lit(1.0), F.col("similarity") * (1 + 0.2 * F.col("overlap") / 0.5))
    return out.withColumn("boosted", F.when(F.col("overlap") > above, lifted).otherwise(F.col("similarity"))).drop("na", "nb")


#: Undecided pairs up to which one task settles them.
SETTLED = 100_000


def merges(pairs: DataFrame, nodes: DataFrame, settled: int = SETTLED) -> DataFrame:
    """(merged_id, absorbed_id, similarity): pairs taken in candidate order, skipping nodes that were absorbed; the survivor has as
    many or more provenances, the smaller id on a tie.

    In order, a pair absorbs its lesser node unless one of the two has been absorbed before, so a node is absorbed by the first of its pairs whose survivor is still there.
    In rounds, all at once: a pair is sure if nothing that could absorb its survivor stands before it, and out if something sure does, or if a sure pair absorbs its lesser node before it.
    One node thus absorbs all that it can in a round. Up to ``settled`` undecided pairs are then settled in order in one task. Where more are left and rounds
    decide less than half of them, components of undecided pairs of up to ``settled`` are settled, each in one task, and larger ones go on by rounds; no larger one is brought together.
    """
    from .cluster import component_of

    n = nodes.select("id", F.coalesce(F.size("provenance"), F.lit(0)).alias("n"))
    rows = pairs.join(n.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    keeps = F.col("na") >= F.col("nb")
    keep, drop = F.when(keeps, F.col("a")).otherwise(F.col("b")), F.when(keeps, F.col("b")).otherwise(F.col("a"))
    left = stored(rows.select(keep.alias("keep"), drop.alias("drop"), "similarity", F.struct("ao", "nth", "a", "b").alias("place"), F.lit(False).alias("sure")), "undecided")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.schema.fields)
    before, patience, stalled = None, 1, 0
    while True:
        first = stored(left.groupBy(F.col("drop").alias("id")).agg(F.min("place").alias("low"), F.min(F.when(F.col("sure"), F.col("place"))).alias("high")), "firsts")
        marked = left.join(first.select(F.col("id").alias("drop"), F.col("high").alias("end")), "drop").join(first.withColumnRenamed("id", "keep"), "keep", "left")
        out = (F.col("end") < F.col("place")) | (~F.col("sure") & (F.col("high") < F.col("place")))
        sure = F.col("sure") | F.col("low").isNull() | (F.col("place") < F.col("low"))
        left = stored(marked.filter(~F.coalesce(out, F.lit(False))).select("keep", "drop", "similarity", "place", sure.alias("sure")), "undecided")
        undecided = left.filter("NOT sure").count()
        if not undecided:
            break
        stalled = 0 if before is None or undecided * 2 <= before else stalled + 1
        before = undecided
        if undecided > settled and stalled < patience:
            continue
        open_ = left.filter("NOT sure")
        at = open_.select(F.explode(F.array("keep", "drop")).alias("id")).distinct()
        if undecided <= settled:
            part = at.withColumn("component", F.lit("")).withColumn("small", F.lit(True))
        else:
            part = component_of(Graph(at, open_.select(F.col("keep").alias("source"), F.col("drop").alias("target"))))
            sizes = open_.join(part.select(F.col("id").alias("drop"), "component"), "drop").groupBy("component").agg((F.count("*") <= settled).alias("small"))
            part = part.join(sizes, "component")
        parted = stored(left.join(part.withColumnRenamed("id", "drop"), "drop", "left"), "parted")
        done = parted.filter("small").groupBy("component").applyInPandas(_in_order, kind)
        left = stored(parted.filter("small IS NULL OR NOT small").select("keep", "drop", "similarity", "place", "sure").unionByName(done), "undecided")
        if undecided <= settled:
            break
        before, patience, stalled = None, patience * 2, 0
    return left.groupBy("drop").agg(F.min_by(F.struct("keep", "similarity"), "place").alias("by")).select(F.col("by.keep").alias("merged_id"), F.col("drop").alias("absorbed_id"), "by.similarity")


def _in_order(pdf):
    """The pairs of one component that are taken, in order; sure ones that absorb a node are among them, whatever their survivor."""
    gone, out = set(), []
    keep, drop, sure = pdf.keep.tolist(), pdf["drop"].tolist(), pdf.sure.tolist()
    place = [tuple(p.values()) for p in pdf.place]
    for i in sorted(range(len(pdf)), key=place.__getitem__):
        if drop[i] not in gone and (sure[i] or keep[i] not in gone):
            gone.add(drop[i])
            out.append(i)
    return pdf.iloc[out][["keep", "drop", "similarity", "place", "sure"]].assign(sure=True)


def redirects(merged: DataFrame, edges: DataFrame) -> DataFrame:
    """``merged`` with edge_redirects, the number of edges at the absorbed node (a loop counts once)."""
    at = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("absorbed_id")).groupBy("absorbed_id").agg(F.count("*").alias("edge_redirects"))
    return merged.join(at, "absorbed_id", "left").withColumn("edge_redirects", F.coalesce("edge_redirects", F.lit(0)))


def embedded(texts: DataFrame, text: str, model, size: int) -> DataFrame:
    """``texts`` with ``embedding``: what ``model(list of str) -> array (n x size)`` gives, of length 1. Texts go to it in Arrow batches."""
    schema = T.StructType([*texts.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = np.asarray(model([v or "" for v in batch.column(text).to_pylist()]), float).reshape(batch.num_rows, size)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(norm > 0, norm, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(x), pa.list_(pa.float64()))], names=[*batch.schema.names, "embedding"])

    return texts.mapInArrow(run, schema)


def applied(g: Graph, merged: DataFrame, compat: bool = False) -> Graph:
    """The graph without absorbed nodes: survivors get their provenance and ``merged_from``; edges are redirected and combined
    (``compat``: edges at absorbed nodes are dropped)."""
    from .build import combine_edges

    gone = merged.select(F.col("absorbed_id").alias("id"), F.col("merged_id").alias("to"))
    prov = g.nodes.select("id", "provenance").join(gone, "id").groupBy("to").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("provenance", F.array().cast("array<string>"))))).alias("more"), F.array_sort(F.collect_list("id")).alias("merged_from"))
    nodes = g.nodes.join(gone, "id", "left_anti").join(prov.withColumnRenamed("to", "id"), "id", "left")
    empty = F.array().cast("array<string>")
    nodes = nodes.withColumn("provenance", F.array_union(F.coalesce("provenance", empty), F.coalesce("more", empty))).drop("more")
    edges = g.edges
    for end in ("source", "target"):
        move = gone.select(F.col("id").alias(end), "to")
        edges = edges.join(move, end, "left_anti") if compat else edges.join(move, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return Graph(nodes, combine_edges(edges), g.directed, g.meta)

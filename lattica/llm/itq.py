"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored
from .components import components

#: Rows of a bucket that meet in one task; rows that a key should have by chance, at most; least bits of a key; pairs at the threshold that may meet in no table.
BLOCK, CROWD, LEAST_BITS, MISSED = 512, 32, 12, 0.0078


def layout(n: int) -> tuple[int, int]:
    """(bits of a key, tables) for ``n`` vectors: keys grow with log2 n, so that buckets do not, and there are as many tables as leave out
    MISSED of the pairs of cosine 0.93, which agree in 88 % of the bits: 12 and 20 up to 131,072 vectors, 16 and 35 for two million."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, n) / CROWD)))
    return bits, math.ceil(math.log(MISSED) / math.log(1 - 0.88**bits))


def learned(vectors: np.ndarray, rounds: int = 40, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, rotation): the rotation under which the signs of centred unit vectors lose least (iterative quantisation)."""
    mean = vectors.mean(axis=0)
    x = vectors - mean
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1],) * 2))
    for _ in range(rounds):
        codes = np.where(x @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(x.T @ codes)
        rotation = left @ right
    return mean, rotation


def models(sample: list[list[float]], bits: int = 12, tables: int = 20, seed: int = 0) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """For each length of vector, as many rotations as ``tables`` keys need, each learned from another start."""
    by_size: dict[int, list] = {}
    for v in sample:
        by_size.setdefault(len(v), []).append(v)
    out = {}
    for size, rows in by_size.items():
        x = np.array(rows, float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        per = max(1, size // bits)
        out[size] = [learned(x, seed=seed + k) for k in range(-(-tables // per))]
    return out


def keys_of(bits: np.ndarray, width: int = 12, tables: int = 20) -> np.ndarray:
    """The keys of each code (rotations x size bits): disjoint groups of ``width`` bits of one rotation each."""
    per, width = max(1, bits.shape[2] // width), min(width, bits.shape[2])
    place = 1 << np.arange(width, dtype=np.int64)
    keys = [bits[:, r, c * width : (c + 1) * width] @ place for r in range(bits.shape[1]) for c in range(per)]
    return np.stack(keys[:tables], axis=1).astype(np.int32)


def _encode(vectors: np.ndarray, model: list, width: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    bits = np.stack([(x - mean) @ rotation >= 0 for mean, rotation in model], axis=1)
    return np.packbits(bits.reshape(len(x), -1), axis=1), keys_of(bits, width, tables)


def candidates(classes: DataFrame, sample: list[list[float]], share: float = 0.27) -> DataFrame:
    """Distinct pairs (u, v) of classes (cid, label, x) that share a table's key and differ in at most ``share`` of all bits.

    Two unit vectors of cosine 0.93 differ in about 12 % of the bits, so ``share`` is far above what a link needs. A pair is
    given by the first table it meets in only. The buckets are an equi-join that compares codes as it goes, so pairs that are too far
    apart are never rows. A bucket of more than BLOCK rows is salted: each part of its left side meets the whole right side on
    its own; nothing is left out.
    """
    width, tables = layout(classes.count())
    learned_ = models(sample, width, tables)
    words = max([-(-len(m) * size // 64) for size, m in learned_.items()], default=1)
    model = classes.sparkSession.sparkContext.broadcast(learned_)

    def encode(batches):
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("x").to_pylist()])
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(rows))
                own = model.value.get(int(size)) or models([list(np.eye(size)[i]) for i in range(size)], width, tables)[int(size)]
                codes, keys = _encode(np.array(part.column("x").to_pylist(), float), own, width, tables)
                at = pa.array(np.repeat(np.arange(len(rows)), keys.shape[1]))
                numbers = pa.array(np.tile(np.arange(keys.shape[1], dtype=np.int32), len(rows)))
                wide = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.int64)
                packed, all_keys = (pa.array(list(x), pa.list_(kind)).take(at) for x, kind in ((wide, pa.int64()), (keys, pa.int32())))
                columns = [part.column("cid").take(at), part.column("label").take(at), pa.array(np.full(len(at), size, np.int32)), numbers, pa.array(keys.reshape(-1)), packed, all_keys]
                yield pa.RecordBatch.from_arrays(columns, names=["cid", "label", "size", "t", "key", "code", "keys"])

    label = classes.schema["label"].dataType.simpleString()
    rows = mapped(classes.select("cid", "label", "x"), encode, f"cid long, label {label}, size int, t int, key int, code array<bigint>, keys array<int>")
    rows = stored(rows, "codes")
    bucket = ["label", "size", "t", "key"]
    counts = rows.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    met = rows.join(counts, bucket).select(*bucket, "cid", "code", "keys", "blocks")
    left = met.withColumn("salt", F.pmod(F.xxhash64("cid", "t"), F.col("blocks")).cast("int")).drop("blocks").withColumnsRenamed({"cid": "u", "code": "cu", "keys": "ku"})
    right = met.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").withColumnsRenamed({"cid": "v", "code": "cv", "keys": "kv"})
    apart = F.lit(0)
    for k in range(words):
        apart = apart + F.coalesce(F.bit_count(F.get("cu", F.lit(k)).bitwiseXOR(F.get("cv", F.lit(k)))), F.lit(0))
    near = left.join(right, [*bucket, "salt"]).filter((F.col("u") < F.col("v")) & (apart <= share * 64 * F.size("cu")))
    before = F.zip_with(F.slice("ku", 1, F.col("t")), F.slice("kv", 1, F.col("t")), lambda x, y: x == y)
    return near.filter(~F.exists(before, lambda x: x)).select("u", "v")


def linked(classes: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs whose cosine in double precision is ``least`` or more."""
    left = classes.select(F.col("cid").alias("u"), F.col("x").alias("xu"))
    right = classes.select(F.col("cid").alias("v"), F.col("x").alias("xv"))

    def rerank(batches):
        for batch in batches:
            us, vs = batch.column("xu"), batch.column("xv")
            for k in range(0, batch.num_rows, 4096):
                a, b = (np.array(c.slice(k, 4096).to_pylist(), float) for c in (us, vs)) if batch.num_rows else (np.zeros((0, 1)),) * 2
                cos = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
                yield batch.slice(k, 4096).filter(pa.array(cos >= least)).select(["u", "v"])

    same = F.size("xu") == F.size("xv")
    return mapped(pairs.join(left, "u").join(right, "v").filter(same).select("u", "v", "xu", "xv"), rerank, "u long, v long")


def near_duplicates(vectors: DataFrame, least: float = 0.93, sample_rows: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Rows are compared if their labels are equal and not null and their vectors are of one length. A vector that is null,
    empty, zero or holds a null or a non-finite component links with nothing. Equal vectors form a class and are handled
    once; its copies are linked to one another (a vector's cosine with itself is 1). Rotations are learned from at
    most ``sample_rows`` classes (documented bound); every class is indexed. Found links are exact; pairs that meet in no
    table are missed (about 1 in 100 at a cosine of 0.93, fewer above). Null ids come after all others. Repeated rows are copies; other columns take no
    part, whatever their names; an empty table gives an empty table.
    """
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    some = F.coalesce(F.exists("embedding", lambda c: c != 0), F.lit(False))
    fit = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)) & some
    good = vectors.filter(fit).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    classes = good.groupBy("label", "x").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    sample = [r["x"] for r in classes.orderBy(F.xxhash64("least", "label"), "cid").limit(sample_rows).select("x").collect()]
    pairs = stored(linked(classes, candidates(classes, sample), least), "links")
    weights = classes.select(F.col("cid").alias("v"), F.col("n").alias("m"))
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    links = both.join(weights, "v").groupBy(F.col("u").alias("cid")).agg(F.sum("m").alias("m"))
    parts = components(pairs).select(F.col("node").alias("cid"), "component")
    known = classes.join(links, "cid", "left").join(parts, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    known = stored(known.select("label", "x", "least", "component", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links")), "known")
    firsts = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = known.join(firsts, "component").select(F.col("label").alias("l"), F.col("x").alias("y"), "n_links", "component_id")
    rows = vectors.withColumn("x", F.when(fit, F.col("embedding").cast("array<double>")))
    out = rows.join(named, (F.col("label") == F.col("l")) & (F.xxhash64("x") == F.xxhash64("y")) & (F.col("x") == F.col("y")), "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

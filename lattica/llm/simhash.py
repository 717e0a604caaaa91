"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mapped, stored, with_columns_last
from .components import components

#: Distinct fingerprints of a bucket up to which its pairs are compared one by one.
PAIRED = 24


def fingerprints_of(texts: list[bytes], width: int = 3, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text: over the XXH64 of its shingles of ``width`` words (A-Z lower-cased,
    space-joined, repeats included; the whole sequence where there are fewer), a bit is set if it is in more than
    half. 0 without a word."""
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        n = max(1, len(words) - width + 1)
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 16):
            part = words[at : min(at + (1 << 16), n) + width - 1]
            line = b" ".join(part)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
            last = ends[width - 1 :] if len(part) >= width else ends[-1:]
            first = np.concatenate(([0], ends[: len(last) - 1] + 1))
            hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(last))
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprinted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, and ``fp``, the SimHash as a signed long. A null text has no words; a text of any length is hashed in
    pieces. A column named fp is replaced, all others pass, whatever their names."""
    kept = with_columns_last(docs.drop(text), ["fp"])
    columns = [f"c{i}" for i in range(len(kept.columns))]
    schema = kept.toDF(*columns).schema.add("fp", "long")
    source = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(kept.columns, columns, strict=True)], F.col(text).cast("binary").alias("_text"))

    def run(batches):
        for batch in batches:
            texts = batch.column("_text")
            for a, b in chunks(texts):
                part = batch.slice(a, b - a)
                fp = fingerprints_of([x or b"" for x in part.column("_text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(fp.view(np.int64))], names=[*columns, "fp"])

    return mapped(source, run, schema).toDF(*kept.columns, "fp")


def covering_masks(radius: int = 2, bits: int = 64, seed: int = 1) -> list[int]:
    """Masks of which every set of up to ``radius`` bits misses one entirely.

    Each bit position gets a non-zero vector of radius + 1 bits; for each non-zero vector v there is a mask, of the
    positions whose vector has an odd inner product with v. The vectors of ``radius`` positions leave a non-zero v
    orthogonal to all of them, so fingerprints that differ there agree on that v's mask. 2^(radius+1) - 1 masks. Where there are no more
    positions than vectors that begin with a one, each gets another of these, so that all masks are of equal size but one, which has all bits.
    """
    order = np.random.default_rng(seed).permutation(max(bits, 1 << radius))
    half = 1 << radius
    vectors = half + order[:bits] % half if bits <= half else 1 + order % (2 * half - 1)
    return [sum(1 << i for i in range(bits) if (int(vectors[i]) & v).bit_count() % 2) for v in range(1, 2 * half)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = 2, seed: int = 1) -> DataFrame:
    """Pairs (u, v) of distinct values of ``fp`` whose components are those of all pairs within ``radius`` bits.

    Every such pair meets in a bucket of one of the covering tables. In buckets of up to PAIRED fingerprints
    the pairs themselves are compared. In a larger one, whose fingerprints differ in unmasked bits only, each
    fingerprint is linked to the points within radius / 2 bits of it: those at one point are within ``radius`` of
    one another and are linked to the least of them, and any pair within the radius has a point in common. So no
    bucket is cut short or paired off, and no group ever meets in one task. Needs an even radius.
    """
    if radius % 2 or radius > 2:
        raise ValueError("points between fingerprints are formed for a radius of 2 (or 0)")
    masks = covering_masks(radius, seed=seed)
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])
    rows = prints.select("fp").distinct().select("fp", F.explode(tables).alias("b")).select("b.t", "b.key", "fp")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = stored(rows.join(sizes, ["t", "key"]), "buckets")
    few = met.filter(F.col("n") <= PAIRED).groupBy("t", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = few.select(F.explode("fps").alias("v"), "fps").select("v", F.explode(F.filter("fps", lambda x: (x > F.col("v")) & (F.bit_count(x.bitwiseXOR(F.col("v"))) <= radius))).alias("u"))
    free = F.array(*[F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << i)) for i in range(64) if radius and not m >> i & 1]) for m in masks])
    many = met.filter(F.col("n") > PAIRED).select("t", "key", "fp", F.explode(F.element_at(free, F.col("t") + 1)).alias("flip"))
    many = many.withColumn("point", F.col("fp").bitwiseXOR(F.col("flip")))
    least = many.groupBy("t", "point").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1").select("t", "point", "v")
    shared = many.join(least, ["t", "point"]).filter("fp <> v").select("v", F.col("fp").alias("u"))
    return pairs.select("u", "v").unionByName(shared.select("u", "v")).distinct()


def near_duplicates(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Rows of ``prints`` (doc_id, fp and others) with component_id, the smallest doc_id reachable by links, and component, a fingerprint of it.

    Equal fingerprints are linked, also those of documents without words. Null ids count after all others: a
    component of null ids only has component_id null. Copies are handled once: links and components are
    those of distinct fingerprints, each standing for its smallest id. Repeated rows stay rows of their own; columns named component or
    component_id are replaced, all others pass; an empty table gives an empty table.
    """
    prints = stored(with_columns_last(prints, ["component", "component_id"]), "prints")
    return with_components(prints, components(links(prints, radius)))


def with_components(prints: DataFrame, found: DataFrame) -> DataFrame:
    """``prints`` with component_id and component, from the (node, component) ``found`` of its linked values of ``fp``."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = found.select(F.col("node").alias("fp"), "component")
    joined = classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = joined.select("fp", "component").join(ids, "component")
    return prints.join(ids, "fp")


def deduplicated(docs: DataFrame, radius: int = 2) -> DataFrame:
    """One document of each component: the one with the smallest id (of equal ids, the least text digest; of equal rows, one).
    Columns of any name pass."""
    mark = F.xxhash64("text")
    prints = near_duplicates(fingerprinted(docs.select("doc_id", "text", mark.alias("mark"))), radius)
    heads = prints.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    heads = heads.groupBy("component").agg(F.min("mark").alias("kept_mark"), F.first("component_id").alias("component_id"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col("doc_id").alias("id"), mark.alias("mark"))
    kept = own.join(heads, F.col("id").eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("kept_mark")))
    return kept.dropDuplicates(["id", "mark"]).select("d.*")

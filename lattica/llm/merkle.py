"""Merkle manifest of a dataset: contiguous digest matrices of aligned blocks, hashed level by level."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, stored

#: A block holds the leaves below one node so many levels up: FANOUT ** LEVELS at most.
FANOUT, LEVELS = 3, 7
HEX = 64


def digest(*values: Column) -> Column:
    """SHA-256 (lower-case hex) of values, each `-` if null, else its number of UTF-8 bytes, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _hashed(rows: np.ndarray) -> np.ndarray:
    """Hex digest of each row of a byte matrix, as a matrix."""
    data, width = rows.tobytes(), rows.shape[1]
    out = b"".join(sha256(data[i : i + width]).hexdigest().encode() for i in range(0, len(data), width))
    return np.frombuffer(out, np.uint8).reshape(-1, HEX)


def levels(leaves: np.ndarray, full: bool, most: int, fanout: int = FANOUT) -> list[np.ndarray]:
    """Digest matrices of a block from its leaves up. A block of a longer row of nodes (``full``) goes ``most`` levels up, though its last run may
    be a single node; one that is its whole row stops at the one node left."""
    out = [leaves]
    while len(out) <= most and (full or len(out[-1]) > 1):
        rows = out[-1]
        whole = len(rows) // fanout * fanout
        parts = [_hashed(rows[:whole].reshape(-1, fanout * HEX))] if whole else []
        if whole < len(rows):
            parts.append(_hashed(rows[whole:].reshape(1, -1)))
        out.append(np.concatenate(parts))
    return out


def siblings(tree: list[np.ndarray], fanout: int = FANOUT):
    """For each level below the top: the members of every leaf's run as (leaves, fanout, HEX), which of them exist, and which is the leaf's own side."""
    n = len(tree[0])
    for k, rows in enumerate(tree[:-1]):
        at = np.arange(n) // fanout**k
        members = (at // fanout * fanout)[:, None] + np.arange(fanout)
        yield rows[np.minimum(members, len(rows) - 1)], members < len(rows), at % fanout


def _strings(column) -> np.ndarray:
    """A column of 64-byte digests as one matrix, without copying them one by one."""
    column = column.cast(pa.binary())
    start = column.offset
    ends = np.frombuffer(column.buffers()[1], np.int32)[start : start + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, HEX)


def _hex(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes().decode() for r in rows], pa.string())


def indexed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (with a column key) numbered from 0 within each key by ``order``, as i, with the key's number of rows as total.

    Ranges of (key, order) are dealt out, sorted and written with each row's place in its file. Where a key's rows begin in a range follows from the
    counts by range and key, which are the only rows that a window gathers, by key.
    """
    ranges = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    placed = stored(ranges.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranges")
    counts = placed.groupBy("key", "part").agg(F.count("*").alias("n"), F.min("at").alias("from"))
    by_key = Window.partitionBy("key")
    before = F.coalesce(F.sum("n").over(by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("key", "part", (before - F.col("from")).alias("shift"), F.sum("n").over(by_key).alias("total"))
    return placed.join(shifts, ["key", "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _blocks(nodes: DataFrame, most: int, *more: str) -> DataFrame:
    """A row for each aligned block of ``nodes`` (key, i, total, h): key, block, total, and the columns h and ``more`` as arrays in the order of i."""
    size = FANOUT**most
    rows = nodes.groupBy("key", F.floor(F.col("i") / size).alias("block")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("i", "h", *more))).alias("rows"))
    return rows.select("key", "block", "total", *[F.col(f"rows.{c}").alias(c) for c in ("h", *more)])


def _rooted(blocks: DataFrame, most: int) -> DataFrame:
    """The root of each block, a node of the next row of nodes."""

    def run(batches):
        for batch in batches:
            lists, roots = batch.column("h"), []
            for j, total in enumerate(batch.column("total").to_pylist()):
                own = lists.slice(j, 1).flatten()
                roots.append(levels(_strings(own), total > len(own), most)[-1][0].tobytes().decode())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), batch.column("total"), pa.array(roots, pa.string())], names=["key", "block", "total", "h"])

    nodes = mapped(blocks.select("key", "block", "total", "h"), run, "key string, block long, total long, h string")
    return nodes.select("key", F.col("block").alias("i"), F.ceil(F.col("total") / FANOUT**most).alias("total"), "h")


_PATH = "array<struct<before:string,after:string>>"


def _path_of(tree: list[np.ndarray]) -> list[list[tuple[bytes, bytes]]]:
    """For each leaf of a block, level by level, what stands left and right of its node in its run."""
    out: list[list[tuple[bytes, bytes]]] = [[] for _ in range(len(tree[0]))]
    for members, there, side in siblings(tree):
        for j, (row, ok, own) in enumerate(zip(members, there, side.tolist(), strict=True)):
            out[j].append((row[:own].tobytes(), row[own + 1 :][ok[own + 1 :]].tobytes()))
    return out


def _paths(blocks: DataFrame, most: int) -> DataFrame:
    """(key, i, path): for the nodes of ``blocks`` (with the path of each block) the siblings from the node up to its root."""

    def run(batches):
        for batch in batches:
            for j, (key, block, total, above) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("key", "block", "total", "path")], strict=True)):
                own = batch.column("h").slice(j, 1).flatten()
                tree, first = levels(_strings(own), total > len(own), most), block * FANOUT**most
                paths = [[{"before": a.decode(), "after": b.decode()} for a, b in p] + (above or []) for p in _path_of(tree)]
                kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(own)), pa.array(range(first, first + len(own)), pa.int64()), pa.array(paths, kind)], names=["key", "i", "path"])

    return mapped(blocks, run, f"key string, i long, path {_PATH}")


def _climbed(blocks: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Roots (key, root) above ``blocks``, and (key, block, path): the siblings from a block's root up to its key's."""
    rows = [blocks]
    nodes = stored(_rooted(blocks, most), "nodes")
    roots = nodes.filter("total = 1")
    while not (many := nodes.filter("total > 1")).isEmpty():
        rows.append(stored(_blocks(many, most), "blocks"))
        nodes = stored(_rooted(rows[-1], most), "nodes")
        roots = roots.unionByName(nodes.filter("total = 1"))
    above = None
    for level in reversed(rows[1:]):
        level = level.withColumn("path", F.lit(None).cast(_PATH)) if above is None else level.join(above, ["key", "block"], "left")
        above = stored(_paths(level, most), "paths").withColumnRenamed("i", "block")
    if above is None:
        above = blocks.sparkSession.createDataFrame([], f"key string, block long, path {_PATH}")
    return roots.select("key", F.col("h").alias("root")), above


def manifest(rows: DataFrame, keep_proofs: bool = False, most: int = LEVELS) -> DataFrame:
    """Every row of ``rows`` (doc_id, source, leaf, and claim: the leaf as it is found now) in the Merkle tree of the dataset.

    A source's leaves ascend by doc_id (null first; rows of one id by leaf); its subroot is what its tree of fanout 3 comes to, and the subroots, by source
    (null first, bytewise), come to the root in the same way. Returns doc_id, source, leaf, subroot, root, proof_sha256 (SHA-256 of the siblings, level by level
    up to the root, left to right), folded_root (what the claim and the leaf's own siblings come to) and verified (equals root; false for a null claim), and
    with ``keep_proofs`` proof: the siblings themselves, before and after the node at each level. Repeated rows are leaves of their own; a single row is its own root, with the
    proof of no siblings; an empty table gives an empty one. Other columns take no part.

    Leaves are brought together by aligned blocks of at most 3 ** ``most``, whatever their source, a block being one row; blocks' roots are nodes of the next row of
    nodes, and so on. Only digests are shuffled, and the siblings above a block are held once for each block.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    kept = stored(rows.select(key.alias("key"), "doc_id", "leaf", "claim"), "leaves")
    blocks = stored(_blocks(indexed(kept, "doc_id", "leaf").withColumnRenamed("leaf", "h"), most, "doc_id", "claim"), "blocks")
    subroots, above = _climbed(blocks, most)
    sources = subroots.select(F.lit("").alias("key"), F.col("key").alias("of"), F.col("root").alias("h"))
    tops = stored(_blocks(indexed(sources, "of"), most, "of"), "sources")
    root, over = _climbed(tops.select("key", "block", "total", "h"), most)
    top_paths = _paths(tops.select("key", "block", "total", "h").join(over, ["key", "block"], "left"), most).select(F.col("i"), F.col("path").alias("over"))
    names = tops.select(F.posexplode(F.arrays_zip("of", "h")).alias("j", "x"), "block")
    names = names.select((F.col("block") * FANOUT**most + F.col("j")).alias("i"), F.col("x.of").alias("key"), F.col("x.h").alias("subroot"))
    tops = stored(names.join(top_paths, "i").crossJoin(F.broadcast(root.select("root"))).drop("i"), "tops")  # root is one row
    full = blocks.join(above, ["key", "block"], "left").join(tops, "key")
    return _proved(full, keep_proofs, most)


def _proved(blocks: DataFrame, keep_proofs: bool, most: int) -> DataFrame:
    kind = blocks.schema["doc_id"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    path_type = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def run(batches):
        for batch in batches:
            for j in range(len(batch)):
                row = {c: batch.column(c)[j].as_py() for c in ("key", "total", "path", "over", "subroot", "root")}
                own, claims, ids = (batch.column(c).slice(j, 1).flatten() for c in ("h", "claim", "doc_id"))
                tree = levels(_strings(own), row["total"] > len(own), most)
                above = [(p["before"].encode(), p["after"].encode()) for p in (row["path"] or []) + (row["over"] or [])]
                proofs, folded = _folded(tree, claims.to_pylist(), above)
                n = len(own)
                columns = [ids, pa.array([row["key"][1:] if row["key"] else None] * n, pa.string()), own, pa.array([row["subroot"]] * n), pa.array([row["root"]] * n)]
                columns += [pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array([f == row["root"] for f in folded])]
                if keep_proofs:
                    columns.append(pa.array([[{"before": a.decode(), "after": b.decode()} for a, b in p + above] for p in _path_of(tree)], path_type))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [f.split()[0] for f in schema.split(", ")] + ["proof"] * keep_proofs
    return mapped(blocks, run, schema + f", proof {_PATH}" * keep_proofs)


def _folded(tree: list[np.ndarray], claims: list[str | None], above: list[tuple[bytes, bytes]]) -> tuple[list[str], list[str | None]]:
    """For each leaf of a block the digest of its siblings up to the root, and what its claim and they come to."""
    n = len(tree[0])
    proofs = [sha256() for _ in range(n)]
    nodes: list[bytes | None] = [c.encode() if c is not None else None for c in claims]
    for members, there, side in siblings(tree):
        for j, own in enumerate(side.tolist()):
            before, after = members[j, :own].tobytes(), members[j, own + 1 :][there[j, own + 1 :]].tobytes()
            proofs[j].update(before + after)
            if nodes[j] is not None:
                nodes[j] = sha256(before + nodes[j] + after).hexdigest().encode()
    for before, after in above:
        for j in range(n):
            proofs[j].update(before + after)
            if nodes[j] is not None:
                nodes[j] = sha256(before + nodes[j] + after).hexdigest().encode()
    return [p.hexdigest() for p in proofs], [x.decode() if x is not None else None for x in nodes]

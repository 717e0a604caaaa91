"""Language-model scores from a probabilistic suffix tree."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, mapped, remainder, stored, trimmed

#: Bytes of the longest context, and the symbol that ends a text (no word holds it).
DEPTH = 6
END = b"\n"

#: Text whose grams are sorted at once, which takes some 50 bytes for each of its bytes, and text of a block, whose distinct grams are looked up together.
CHUNK_BYTES = 1 << 20
BLOCK_BYTES = 12 << 20

#: Blocks whose grams of a shard meet in one task, and different words that a worker counts before it hands them on.
MOST_BLOCKS, MOST_WORDS = 4096, 50_000

#: Taken off each count for smoothing; nats that a context must gain over its suffix, over all its places, to be retained.
DISCOUNT, GAIN = 0.75, 4.0

_ODD = np.uint64(0x9E3779B97F4A7C15)
_TEXT = 256
_DOCS = pa.list_(pa.struct([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("size", pa.int64())]))
_BLOCKS = "block long, shard int, n int, data binary, counts binary, docs array<struct<rid:bigint,doc_id:bigint,held_out:boolean,size:bigint>>, word binary, pair int, times long"


def segments(text: bytes):
    """The symbols of a text in pieces: its lower-cased words, each followed by a space, then END. Each piece follows the DEPTH symbols
    before it (END where there are none). A piece ends at a word's end, as soon as it has CHUNK_BYTES."""
    words = text.lower().split()
    line, before, at = b" ".join(words) + (b" " if words else b"") + END, END * DEPTH, 0
    while at < len(line):
        stop = line.find(b" ", at + CHUNK_BYTES) + 1 if len(line) - at > CHUNK_BYTES else 0
        piece = before + line[at : stop or len(line)]
        yield piece
        before, at = piece[-DEPTH:], stop or len(line)


def packed(whole: bytes, sizes: list[int]) -> np.ndarray:
    """A number for each symbol of pieces that stand one after another (``sizes`` without the DEPTH symbols before each).

    From the highest byte: a digest of the last three symbols before it (its shard), the DEPTH symbols before it, the last one first,
    and the symbol. So numbers in order are grams in order of their reversed contexts, and all that follow one suffix stand together.
    """
    x = np.frombuffer(whole, np.uint8).astype(np.uint64)
    n = len(x)
    keys = x[DEPTH:].copy()
    for j in range(1, DEPTH + 1):
        keys |= x[DEPTH - j : n - j] << np.uint64(8 * (DEPTH + 1 - j))
    keys |= (keys >> np.uint64(32)) * _ODD >> np.uint64(56) << np.uint64(56)
    if len(sizes) > 1:
        own = np.ones(len(keys), bool)
        stops = np.cumsum(np.array(sizes) + DEPTH) - DEPTH
        own[(stops[:-1, None] + np.arange(DEPTH)).reshape(-1)] = False
        keys = keys[own]
    return keys


def _summed(held: list) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of (keys, counts) and the sums of their counts."""
    keys, sums = (np.concatenate(c) for c in zip(*held, strict=True))
    if not len(keys):
        return keys, sums
    order = np.argsort(keys, kind="stable")
    keys, sums = keys[order], sums[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(sums, first, dtype=sums.dtype)


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers, their first bytes first, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).tobytes(), codec="zstd", asbytes=True)


def _unplaned(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    whole = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(whole.reshape(size, n).T).view(kind).reshape(-1)


def _grams(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unplaned(data, n, np.uint64), dtype=np.uint64)


def _rounded(logs: np.ndarray) -> np.ndarray:
    """In 32 bits, of which 16 of the mantissa's are kept: to 1 part in 100,000."""
    return (logs.astype(np.float32).view(np.uint32) + np.uint32(64) & np.uint32(0xFFFFFF80)).view(np.float32)


def blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """The texts of ``docs`` (doc_id, text, held_out, rid) in blocks of BLOCK_BYTES, as rows of four kinds: (block, shard, n, data, counts), the
    block's n distinct grams of a shard and how often each occurs in rows that are not held out; (block, 256, n, data, docs), pieces
    of texts; (word, times) and (pair, times), counts of words and of a symbol after two, in rows that are not held out."""

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        kinds = {"block": pa.int64(), "shard": pa.int32(), "n": pa.int32(), "data": pa.binary(), "counts": pa.binary(), "docs": _DOCS, "word": pa.binary(), "pair": pa.int32(), "times": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], names=list(kinds))

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        words, grams, pieces, who, size, total = Counter(), [], [], [], 0, 0

        def chunk():
            whole = b"".join(pieces)
            for held in (False, True):
                some = [i for i, d in enumerate(who) if d["held_out"] is held]
                if some:
                    keys, n = _unique(packed(b"".join(pieces[i] for i in some), [who[i]["size"] for i in some]))
                    grams.append((keys, (n * (not held)).astype(np.int32)))
            if len(grams) > 2:
                grams[:] = [_summed(grams)]
            return rows(block=[block], shard=[_TEXT], n=[len(whole)], data=[pa.compress(whole, codec="zstd", asbytes=True)], docs=[list(who)])

        def closed():
            keys, n = _summed(grams)
            bounds = np.searchsorted(keys >> np.uint64(56), np.arange(257, dtype=np.uint64))
            some = [(s, a, b) for s, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if b > a]
            data = [_planes(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in some]
            yield rows(block=[block] * len(some), shard=[s for s, _, _ in some], n=[b - a for _, a, b in some], data=data, counts=[_planes(n[a:b]) for _, a, b in some])
            taught = n > 0
            pairs, sums = _summed([((keys[taught] >> np.uint64(32) & np.uint64(0xFFFF00)) | (keys[taught] & np.uint64(255)), n[taught])])
            yield rows(pair=pairs.astype(np.int32), times=sums)
            yield spoken()
            trimmed()

        def spoken():
            out = rows(word=list(words), times=list(words.values()))
            words.clear()
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                rid, doc_id, held = (batch.column(c)[i].as_py() for c in ("rid", "doc_id", "held_out"))
                for piece in segments(batch.column("_text")[i].as_py() or b""):
                    if not held:
                        words.update(piece[DEPTH:].split())
                        if len(words) > MOST_WORDS:
                            yield spoken()
                    pieces.append(piece)
                    who.append({"rid": rid, "doc_id": doc_id, "held_out": held, "size": len(piece) - DEPTH})
                    size += len(piece)
                    if size >= CHUNK_BYTES:
                        yield chunk()
                        total += size
                        pieces, who, size = [], [], 0
                    if total >= BLOCK_BYTES:
                        yield from closed()
                        block += 1
                        grams, total = [], 0
        if pieces:
            yield chunk()
            pieces.clear()
        if grams:
            yield from closed()

    return mapped(docs.select("rid", "doc_id", "held_out", F.col(text).cast("binary").alias("_text")), run, _BLOCKS)


@dataclass
class Root:
    """The states of contexts of at most two symbols, whose number the alphabet bounds: probabilities of each symbol after none,
    one and two (rows of ``p2``, found by ``row``), and which of the contexts are retained."""

    p0: np.ndarray
    p1: np.ndarray
    kept1: np.ndarray
    row: np.ndarray
    p2: np.ndarray
    kept2: np.ndarray

    @classmethod
    def grown(cls, pairs: np.ndarray, times: np.ndarray) -> Root:
        contexts, place = np.unique(pairs >> 8, return_inverse=True)
        c2 = np.zeros((len(contexts), 256))
        c2[place, pairs & 255] = times
        c1 = np.zeros((256, 256))
        np.add.at(c1, contexts >> 8, c2)
        c0 = c1.sum(axis=0)
        p0 = (c0 + 0.1) / (c0.sum() + 25.6)
        p1, kept1 = cls._below(c1, np.broadcast_to(p0, c1.shape))
        p2, kept2 = cls._below(c2, p1[contexts >> 8])
        row = np.full(1 << 16, -1, np.int32)
        row[contexts] = np.arange(len(contexts))
        return cls(p0, p1, kept1, row, p2.astype(np.float32), kept2)

    @staticmethod
    def _below(counts: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
        p = np.where(places > 0, (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * kinds * base) / np.maximum(places, 1), base)
        return p, (p * np.log(p / base)).sum(axis=1) * places[:, 0] >= GAIN

    def after(self, context: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each symbol after two others, and under the longest retained suffix of these."""
        one, row = context >> 8, self.row[context]
        first = self.p1[one, symbol]
        best = np.where(self.kept1[one], first, self.p0[symbol])
        if not len(self.p2):
            return first, best
        two = self.p2[row, symbol].astype(float)
        return np.where(row >= 0, two, first), np.where((row >= 0) & self.kept2[row], two, best)


def log_probabilities(keys: np.ndarray, counts: np.ndarray, root: Root) -> np.ndarray:
    """Log10 probability of the last symbol of each packed gram under the longest retained suffix of its context.

    ``keys`` are in order and hold every counted gram of their shards; a count of 0 is a gram to be scored only. A context s
    of c(s) places with t(s) different symbols after it gives
    P(x | s) = (max(c(sx) - DISCOUNT, 0) + DISCOUNT t(s) P(x | suffix)) / c(s), and is retained if this distribution diverges from its
    suffix's by GAIN nats over all its places, or if a longer retained context needs it. No count is too small to be seen by the test.
    """
    symbol = (keys & np.uint64(255)).astype(np.int64)
    p, best = root.after((keys >> np.uint64(40) & np.uint64(0xFFFF)).astype(np.int64), symbol)
    for d in range(3, DEPTH + 1):
        code = keys >> np.uint64(8 * (DEPTH - d) + 8) << np.uint64(8) | keys & np.uint64(255)
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        n = np.add.reduceat(counts[order], first, dtype=np.int64).astype(float)
        context = code[first] >> np.uint64(8)
        begin = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        state = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(first))))
        places, kinds = np.add.reduceat(n, begin), np.add.reduceat((n > 0).astype(float), begin)
        left = np.where(places > 0, DISCOUNT * kinds / np.maximum(places, 1), 1)  # the weight of the suffix
        base = p[order][first]
        own = np.maximum(n - DISCOUNT, 0) / np.maximum(places, 1)[state] + left[state] * base
        seen = n > 0
        divergence = np.add.reduceat(np.where(seen, own * np.log(own / base), 0), begin)
        unseen = np.maximum(0, 1 - np.add.reduceat(np.where(seen, base, 0), begin))
        divergence += unseen * left * np.log(left)
        spread = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code))))
        new, kept = np.empty(len(p)), np.empty(len(p), bool)
        new[order], kept[order] = own[spread], (divergence * places >= GAIN)[state][spread]
        p, best = new, np.where(kept, new, best)
    return np.log10(best)


def _by_shard(parts: DataFrame, keys: list[str], schema: str, finish, wide: bool = False) -> DataFrame:
    """A row ``finish(shard, grams, counts)`` for each of ``keys`` (which begin with shard), from its rows (shard, n, data, counts), merged as they stream by.
    Counts are of 32 bits in blocks, of 64 (``wide``) in sums of them."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        own, held = None, []

        def closed():
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in finish(own[0], *_summed(held))], names=names).cast(kinds)

        kinds = pa.schema([(n, {"int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for n, c in zip(names, schema.split(", "), strict=True)])
        for batch in batches:
            for i in range(batch.num_rows):
                n, data, counts = (batch.column(c)[i].as_py() for c in ("n", "data", "counts"))
                key = tuple(batch.column(c)[i].as_py() for c in keys)
                if key != own:
                    if held:
                        yield closed()
                    own, held = key, []
                held.append((_grams(data, n), _unplaned(counts, n, np.int64 if wide else np.int32).astype(np.int64)))
                if sum(len(k) for k, _ in held[1:]) > max(1 << 16, len(held[0][0])):
                    held[:] = [_summed(held)]
        if held:
            yield closed()

    return mapped(parts.repartition(*keys).sortWithinPartitions(*keys), run, schema)


def grown(parts: DataFrame, root: Root, salts: int = 1) -> DataFrame:
    """(shard, n, data, logs): the grams of each shard with their log probabilities, from the rows (block, shard, n, data, counts) of all blocks.

    A shard holds all grams whose contexts end in the same three symbols, so it has whole branches of the tree, and grows by itself. Of
    very many blocks, ``salts`` groups are summed first.
    """
    shared = parts.sparkSession.sparkContext.broadcast(root)
    steps = lambda keys: _planes(np.diff(keys, prepend=np.uint64(0)))
    if salts > 1:
        salted = parts.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)))
        parts = _by_shard(salted, ["shard", "salt"], "shard int, n int, data binary, counts binary", lambda shard, keys, counts: (shard, len(keys), steps(keys), _planes(counts)))
    return _by_shard(parts, ["shard"], "shard int, n int, data binary, logs binary", lambda shard, keys, counts: (shard, len(keys), steps(keys), _planes(_rounded(log_probabilities(keys, counts, shared.value)))), salts > 1)


def answered(parts: DataFrame, tree: DataFrame, salts: int = 1) -> DataFrame:
    """The rows (block, shard, n, data) with ``logs``, the log probabilities of their grams: each shard of the tree meets its rows, in ``salts`` groups."""
    rows = parts.select("block", "shard", "n", "data", F.lit(None).cast("binary").alias("logs"), F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"))
    both = rows.unionByName(tree.select(F.lit(-1).cast("long").alias("block"), "shard", "n", "data", "logs", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")))

    def run(batches):
        keys = logs = None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                block, n = batch.column("block")[i].as_py(), batch.column("n")[i].as_py()
                mine = _grams(batch.column("data")[i].as_py(), n)
                if block < 0:
                    keys, logs = mine, _unplaned(batch.column("logs")[i].as_py(), n, np.float32)
                else:
                    out.append((i, _planes(logs[np.searchsorted(keys, mine)])))
            if out:
                some = batch.take(pa.array([i for i, _ in out]))
                yield pa.RecordBatch.from_arrays([some.column(c) for c in ("block", "shard", "n", "data")] + [pa.array([x for _, x in out], pa.binary())], names=["block", "shard", "n", "data", "logs"])

    return mapped(both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "block"), run, "block long, shard int, n int, data binary, logs binary")


def _sums(whole: bytes, sizes: list[int], keys: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """The log probability of each piece, from those of all grams."""
    own = packed(whole, sizes)
    order = np.argsort(own)
    own = own[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    each = np.empty(len(own))
    each[order] = np.repeat(logs[np.searchsorted(keys, own[first])], np.diff(np.append(first, len(own))))
    return np.add.reduceat(each, np.cumsum(sizes) - sizes)


def scored(docs: DataFrame, head_share: float = 2e-6, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text, held_out).

    ``score`` is the log10 probability of a text's words and its end under a tree grown on the rows that are not held out;
    ``base_score`` that under smoothed counts of their words. The texts are laid in blocks, whose distinct grams meet the tree by
    shards, so neither the tree nor the counts ever stand in one place; only words that make up ``head_share`` or more of all
    tokens (1 / head_share at most) are broadcast with their counts, and contexts of at most two symbols.

    Null texts are empty: one token, the end. Null ids and repeated rows are rows like any other. A text of any length is scored
    in pieces; a word is never cut. No rows, or none that are not held out, give a uniform tree and base_score null; an empty table an empty table.
    Other columns take no part.
    """
    source = docs.select("doc_id", F.col(text), F.coalesce("held_out", F.lit(False)).alias("held_out"), F.monotonically_increasing_id().alias("rid"))
    laid = stored(blocks(source, text), "blocks")
    words = stored(laid.filter("word IS NOT NULL").groupBy("word").agg(F.sum("times").alias("n")), "words")
    ends = laid.filter(F.col("shard") == _TEXT).select(F.explode("docs").alias("d")).filter("NOT d.held_out").agg(F.countDistinct("d.rid")).first()[0]
    n_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, vocabulary = n_words + ends, distinct + (ends > 0)
    pairs = laid.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("times").alias("n")).toArrow()
    root = Root.grown(pairs.column("pair").to_numpy().astype(np.int64), pairs.column("n").to_numpy())
    parts = laid.filter(F.col("shard") < _TEXT).select("block", "shard", "n", "data", "counts")
    n_blocks = max(1, laid.select("block").filter("block IS NOT NULL").distinct().count())
    salts = -(-n_blocks // MOST_BLOCKS)
    tree = stored(grown(parts, root, salts), "tree")
    frequent = words.filter(F.col("n") >= max(1, head_share * tokens)).toArrow()
    head = dict(zip(frequent.column("word").to_pylist(), np.log10(frequent.column("n").to_numpy() + 0.1).tolist(), strict=True))
    shared = docs.sparkSession.sparkContext.broadcast(head)
    del head, frequent

    def run(batches):
        logs = shared.value
        block, held, keys, values = None, [], None, None
        for batch in batches:
            for i in range(batch.num_rows):
                shard, n, data = (batch.column(c)[i].as_py() for c in ("shard", "n", "data"))
                if batch.column("block")[i].as_py() != block:
                    block, held, keys = batch.column("block")[i].as_py(), [], None
                if shard < _TEXT:
                    held.append((_grams(data, n), _unplaned(batch.column("logs")[i].as_py(), n, np.float32)))
                    continue
                if keys is None:
                    trimmed()
                    keys, values = (np.concatenate(c) for c in zip(*held, strict=True))
                    held = []
                whole, who = pa.decompress(data, decompressed_size=n, codec="zstd", asbytes=True), batch.column("docs")[i].as_py()
                sizes = [d["size"] for d in who]
                sums, at = _sums(whole, sizes, keys, values), 0
                n_tokens, n_head, s_head, tail, times, ends = [], [], [], [], [], [0]
                for size in sizes:
                    body = whole[at + DEPTH : at + DEPTH + size]
                    at += DEPTH + size
                    each = body.split()
                    found = np.fromiter((logs.get(w, np.nan) for w in each), float, len(each))
                    missing = np.isnan(found)
                    rest = Counter(w for w, m in zip(each, missing.tolist(), strict=True) if m)
                    n_tokens.append(len(each) + body.endswith(END))
                    n_head.append(len(each) - int(missing.sum()))
                    s_head.append(float(np.nansum(found)))
                    tail += rest.keys()
                    times += rest.values()
                    ends.append(len(tail))
                pairs = pa.StructArray.from_arrays([pa.array(tail, pa.binary()), pa.array(times, pa.int64())], names=["word", "times"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d[c] for d in who], k) for c, k in (("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()))]
                    + [pa.array(n_tokens, pa.int64()), pa.array(n_head, pa.int64()), pa.array(s_head, pa.float64()), pa.array(sums), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)],
                    names=["rid", "doc_id", "held_out", "n_tokens", "n_head", "s_head", "score", "tail"],
                )

    texts = laid.filter(F.col("shard") == _TEXT).select("block", "shard", "n", "data", F.lit(None).cast("binary").alias("logs"), "docs")
    met = answered(parts, tree, salts).withColumn("docs", F.lit(None).cast(texts.schema["docs"].dataType)).unionByName(texts)
    schema = "rid long, doc_id long, held_out boolean, n_tokens long, n_head long, s_head double, score double, tail array<struct<word:binary,times:bigint>>"
    rows = stored(mapped(met.repartition(n_blocks, "block").sortWithinPartitions("block", "shard"), run, schema), "scored")
    tail = rows.select("rid", F.explode("tail").alias("t")).select("rid", "t.word", "t.times").join(words.filter(F.col("n") < max(1, head_share * tokens)), "word")
    known = tail.groupBy("rid").agg(F.sum("times").alias("n_head"), F.sum(F.col("times") * F.log10(F.col("n") + 0.1)).alias("s_head"))
    whole = rows.drop("tail").unionByName(known, allowMissingColumns=True).groupBy("rid")
    whole = whole.agg(F.max("doc_id").alias("doc_id"), F.bool_or("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_head", "s_head", "score")])
    for t in (laid, tree):
        dropped(t)
    missed = F.col("n_tokens") - 1 - F.col("n_head")
    per_token = math.log10(tokens + 0.1 * (vocabulary + 1)) if tokens else None
    base = F.col("s_head") + missed * F.lit(math.log10(0.1)) + F.lit(math.log10(ends + 0.1)) - F.col("n_tokens") * F.lit(per_token)
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.lit(int(ends > 0))).cast("bigint").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        base.cast("double").alias("base_score"),
        "score",
    )


def marked(docs: DataFrame, by: int = 10, held: int = 0) -> DataFrame:
    """doc_id, text, held_out: crc32 of the id's text modulo ``by`` is ``held``. A null id is not held out."""
    return docs.select("doc_id", "text", F.coalesce(remainder(F.col("doc_id"), by) == held, F.lit(False)).alias("held_out"))

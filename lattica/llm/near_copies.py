"""Near copies by SimHash: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates are texts whose SimHashes differ in RADIUS bits or fewer; a covering of masks makes every such pair meet, and each candidate is
verified by the exact similarity. The candidates' SimHash is one of two-word shingles: a changed word spoils two of them instead of five. Pairs of
that similarity may still differ in more bits, most of all where a whole passage was added, removed or replaced. They are found exactly: two sets
of a similarity of 0.8 share one of the first fifth of their shingles, in any order that is the same for all sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, dropped, mapped, stored
from .components import components
from .simhash import covering_masks, with_components
from .substring_index import _marked, _mixed, word_hashes

#: Words of a shingle for the similarity and for the SimHash; bits within which pairs are sure to meet, and parts of the SimHash.
WIDTH, SKETCH = 5, 2
RADIUS, PARTS = 7, 2

#: Rows of a bucket up to which its pairs are compared one by one at once, pairs for each of its rows up to which they are given, and rounds
#: of heads for buckets beyond either.
PAIRED, DENSE, ROUNDS = 128, 4, 2

#: Of RADIUS bits, one of the PARTS has its share or fewer, and is left whole by one of its masks.
_BITS = 64 // PARTS
MASKS = [(part, mask) for part in range(PARTS) for mask in covering_masks((RADIUS + 1) // PARTS - 1, bits=_BITS)]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words, from the words' hashes; the whole sequence where there are fewer."""
    width = min(width, len(words))
    if not width:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        out = _mixed(out * _BASE + words[j : len(words) - width + 1 + j])
    return np.unique(out)


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if it is in more than half of the hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _words(value: bytes | None) -> np.ndarray:
    return word_hashes((value or b"").lower())


def _text(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("_text"))


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, fp, n, sim): the digest and size of each text's shingle set, and its SimHash. A null text has no words."""

    def run(batches):
        for batch in batches:
            texts = batch.column("_text")
            for a, b in chunks(texts):
                rows = []
                for x in texts.slice(a, b - a):
                    words = _words(x.as_py())
                    own = shingles(words, WIDTH)
                    rows.append((xxhash.xxh64_intdigest(own.tobytes(), 42), len(own), simhash(shingles(words, SKETCH))))
                fp, n, sim = zip(*rows, strict=True)
                columns = [pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(sim, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in ("doc_id", "mark")] + columns, names=["doc_id", "mark", "fp", "n", "sim"])
            del texts, batch

    return mapped(_text(docs), run, "doc_id long, mark long, fp long, n long, sim long")


def keyed(classes: DataFrame) -> DataFrame:
    """(key, fp, sim): a row for each of MASKS, with the masked part of the SimHash and the mask's number as key."""

    def run(batches):
        masks = np.array([m for _, m in MASKS], np.uint64)
        parts = np.array([p * _BITS for p, _ in MASKS], np.uint64)
        tables = np.arange(len(MASKS), dtype=np.uint64) << np.uint64(_BITS)
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                fp, sim = (batch.column(c).slice(a, 2048).to_numpy() for c in ("fp", "sim"))
                keys = (sim.view(np.uint64)[:, None] >> parts & masks | tables).reshape(-1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(np.repeat(x, len(MASKS))) for x in (fp, sim)]], names=["key", "fp", "sim"])

    return mapped(classes.select("fp", "sim"), run, "key long, fp long, sim long")


def bucketed(rows: DataFrame) -> DataFrame:
    """Of rows (key, fp, sim) in buckets by key: (u, v) for each pair within RADIUS bits of a bucket of PAIRED rows or fewer that has no more
    than DENSE such pairs a row, and the rows (key, fp, sim) of all others (of a dense one, those in such a pair). So the output grows with the rows, whatever
    the groups. Buckets stream by in order; none larger than PAIRED is held."""

    def run(batches):
        names = ["u", "v", "key", "fp", "sim"]
        held, large = [np.zeros(0, np.int64)] * 3, None  # rows of the last bucket so far; the key of a bucket known to be large

        def paired(key, fp, sim):
            if not len(key):
                return
            bucket = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
            firsts, seconds, at = [], [], np.arange(len(key))
            for step in range(1, PAIRED):
                at = at[at + step < len(key)]
                at = at[key[at] == key[at + step]]
                if not len(at):
                    break
                near = at[np.bitwise_count((sim[at] ^ sim[at + step]).view(np.uint64)) <= RADIUS]
                firsts.append(near), seconds.append(near + step)
            if not firsts:
                return
            i, j = np.concatenate(firsts), np.concatenate(seconds)
            dense = np.bincount(bucket[i], minlength=bucket[-1] + 1) > DENSE * np.bincount(bucket)
            few = ~dense[bucket[i]]
            u, v = fp[i[few]], fp[j[few]]
            pairs = np.unique(np.stack((np.maximum(u, v), np.minimum(u, v)), axis=1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])] + [pa.nulls(len(pairs), pa.int64())] * 3, names=names)
            rows = np.zeros(len(key), bool)
            rows[i[~few]] = rows[j[~few]] = True
            if rows.any():
                yield from passed(key[rows], fp[rows], sim[rows])

        def passed(key, fp, sim):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.int64())] * 2 + [pa.array(x) for x in (key, fp, sim)], names=names)

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("key", "fp", "sim")]
            if large is not None:
                n = int(np.searchsorted(columns[0], large, side="right"))
                if n:
                    yield from passed(*[c[:n] for c in columns])
                    columns = [c[n:] for c in columns]
                if len(columns[0]):
                    large = None
            columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
            key = columns[0]
            if not len(key):
                continue
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.append(first, len(key)))
            many = np.repeat(sizes > PAIRED, sizes)
            if many.any():
                yield from passed(*[c[many] for c in columns])
                if sizes[-1] > PAIRED:
                    large = key[-1]
            open_ = np.zeros(len(key), bool)
            if sizes[-1] <= PAIRED:
                open_[first[-1] :] = True
            yield from paired(*[c[~many & ~open_] for c in columns])
            held = [c[open_] for c in columns]
        yield from paired(*held)

    return mapped(rows.repartition("key").sortWithinPartitions("key"), run, "u long, v long, key long, fp long, sim long")


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))


#: Bits of a shingle's hash by which it is counted.
SLOT_BITS = 18

#: Longs of the bitmap of a shingle set. Two sets differ in as many shingles as their bitmaps do in bits, or in more.
MAP_LONGS = 16
_MAPS = [f"m{k}" for k in range(MAP_LONGS)]


def parity_map(hashes: np.ndarray) -> np.ndarray:
    """Bit k is the parity of the number of hashes that fall on k."""
    at = np.bincount((_mixed(hashes) % np.uint64(64 * MAP_LONGS)).astype(np.int64), minlength=64 * MAP_LONGS)
    return np.packbits((at & 1).astype(bool), bitorder="little").view(np.int64)


def shingle_sets(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(fp, hashes, m0, m1, ...): the shingle sets of the documents in ``places`` (doc_id, mark, fp), and their bitmaps."""

    def run(batches):
        for batch in batches:
            texts = batch.column("_text")
            for a, b in chunks(texts):
                sets = [shingles(_words(x.as_py()), WIDTH) for x in texts.slice(a, b - a)]
                maps = np.stack([parity_map(x) for x in sets])
                yield pa.RecordBatch.from_arrays([batch.column("fp").slice(a, b - a), _lists([x.view(np.int64) for x in sets]), *[pa.array(maps[:, k]) for k in range(MAP_LONGS)]], names=["fp", "hashes", *_MAPS])

    source = _text(docs)
    return mapped(source.join(places, _same(source, places)).select("fp", "_text"), run, "fp long, hashes array<long>, " + ", ".join(f"{m} long" for m in _MAPS))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (u, v) whose sets have a similarity of 0.8 or more: 9 |both| >= 4 (|u| + |v|), in whole numbers."""
    a = sets.select(F.col("fp").alias("u"), F.col("hashes").alias("a"))
    b = sets.select(F.col("fp").alias("v"), F.col("hashes").alias("b"))
    n, m = F.size("a"), F.size("b")
    met = pairs.join(a, "u").join(b, "v").filter(5 * F.least(n, m) >= 4 * F.greatest(n, m))
    return met.filter(9 * F.size(F.array_intersect("a", "b")) >= 4 * (n + m)).select("u", "v")


def _pairs(met: DataFrame) -> DataFrame:
    """Pairs (u, v) of ``met`` (fp, c, v, d), of different components."""
    return met.filter(F.col("c") != F.col("d")).select(F.greatest("fp", "v").alias("u"), F.least("fp", "v").alias("v")).distinct()


def _other(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.col("fp").alias("v"), F.col("sim").alias("s"), F.col("c").alias("d"))


def _near() -> Column:
    return (F.col("c") != F.col("d")) & (F.bit_count(F.col("sim").bitwiseXOR(F.col("s"))) <= RADIUS)


def linked(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(node, component) of the distinct ``fp`` that are similar to another one.

    All pairs of small buckets are compared. A large or dense bucket is one of a group of near copies, or of very many texts. There every text, in the
    largest such bucket that it lies in, is compared with the text nearest to the bucket's majority of bits, which joins most of a group to
    what it was copied from; in the next round, with the one among those outside the bucket's largest component. What is similar to a text of another component
    then (``_prefix_pairs``) is found by shared rare shingles, which two sets of that similarity must have; nothing is left out, and no bucket is paired off.
    """
    classes = stored(prints.groupBy("fp").agg(F.min("sim").alias("sim"), F.min("n").alias("n"), F.min(F.struct("doc_id", "mark")).alias("p")), "classes")
    seen = stored(bucketed(keyed(classes.filter("n >= 4"))), "seen")
    pairs = stored(seen.filter("key IS NULL").select("u", "v").distinct(), "pairs")
    large = seen.filter("key IS NOT NULL").select("key", "fp", "sim")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("f")).unionByName(large.select(F.col("fp").alias("f")).distinct()).distinct()
    sets = _sets_of(docs, classes, wanted)
    links = stored(similar(pairs, sets), "similar")
    found = components(links)
    for k in range(ROUNDS if large.head(1) else 0):
        found = stored(found, "found")
        part = stored(_with_component(large, found), "part")
        sizes = part.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "c"))["c"].alias("main"), F.sum("m").alias("size"), F.count("*").alias("several")).filter("several > 1")
        open_ = stored(part.join(stored(sizes, "sizes"), "key"), "open")
        widest = open_.groupBy("fp").agg(F.max(F.struct("size", "key"))["key"].alias("key"))
        open_ = stored(open_.join(widest, ["fp", "key"]), "open")
        rest = open_.filter("c <> main") if k else open_
        tried = _pairs(open_.join(_other(_foremost(rest), "key"), "key").filter(_near()))
        links = links.unionByName(stored(similar(stored(tried, "tried"), sets), "similar"))
        found = components(links)
    last = _prefix_pairs(docs, prints, classes, stored(found, "found"))
    if last is not None:
        found = components(links.unionByName(last))
    for t in (classes, seen, pairs):
        dropped(t)
    return found


def _with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found.select(F.col("node").alias("fp"), F.col("component").alias("c")), "fp", "left").withColumn("c", F.coalesce("c", "fp"))


def _sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The shingle sets of the classes in ``wanted`` (f)."""
    places = stored(classes.join(wanted, F.col("fp") == F.col("f")).select("p.doc_id", "p.mark", "fp"), "places")
    return stored(shingle_sets(docs, places), "sets")


def _foremost(rows: DataFrame) -> DataFrame:
    """Of each bucket the row (key, fp, sim, c) nearest to the bucket's majority of bits."""
    bit = lambda i: F.shiftrightunsigned("sim", i).bitwiseAND(F.lit(1))
    sums = rows.groupBy("key").agg(F.count("*").alias("n"), *[F.sum(bit(i)).alias(f"b{i}") for i in range(64)])
    code = F.lit(0).cast("bigint")
    for i in range(64):
        code = code.bitwiseOR(F.when(2 * F.col(f"b{i}") > F.col("n"), F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    codes = stored(sums.select("key", code.alias("code")), "codes")
    away = F.bit_count(F.col("sim").bitwiseXOR(F.col("code")))
    return rows.join(codes, "key").groupBy("key").agg(F.min(F.struct(away.alias("away"), "fp", "sim", "c")).alias("h")).select("key", "h.fp", "h.sim", "h.c")


def _prefix_pairs(docs: DataFrame, prints: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame | None:
    """All similar pairs (u, v) of texts that no chain of ``found`` links yet, or pairs that link them so; None where no two may be similar.

    The shingles of a set are put in order of how often their slots (SLOT_BITS bits of the hash, so that the counts are of a bounded size) occur
    among all. Of a set of n the first n - 0.8 n + 1 are looked at: two sets whose similarity is 0.8 or more share at least 0.8 n of them, so the first
    that they share is among these of both. Only shingles seen in two components matter, only rows outside the largest component
    that holds the shingle meet all others, and only those are pairs that still can share enough if this is the first that they share, and whose bitmaps differ in no more bits than their sets may in
    shingles, a ninth of their sizes together. Exact copies are left out first.
    """
    copies = prints.join(classes.select("fp", "p"), "fp").filter(~(F.col("doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("mark") == F.col("p.mark")))).select("doc_id", "mark").distinct()
    copies, source = stored(copies, "copies"), _text(docs)
    own = source.join(copies, _same(source, copies), "left_anti").select("_text")

    def sets(batches):
        for batch in batches:
            texts = batch.column("_text")
            for a, b in chunks(texts):
                yield [shingles(_words(x.as_py()), WIDTH) for x in texts.slice(a, b - a)]

    def count(batches):
        table = np.zeros(1 << SLOT_BITS, np.int64)
        for some in sets(batches):
            for x in some:
                np.add.at(table, (x >> np.uint64(64 - SLOT_BITS)).astype(np.int64), 1)
        at = np.flatnonzero(table)
        for k in range(0, len(at), 1 << 16):
            slots = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(table[slots])], names=["slot", "n"])

    often = mapped(own, count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << SLOT_BITS, np.int64)
    table[often.column("slot").to_numpy()] = often.column("n").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def prefixes(batches):
        counts = shared.value
        for some in sets(batches):
            some = [x for x in some if len(x) >= 4]  # smaller sets are equal or not similar
            firsts = []
            for x in some:
                order = np.lexsort((x, counts[(x >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]))
                firsts.append(x[order[: len(x) + 1 - -(-4 * len(x) // 5)]])
            sizes = np.array([len(x) for x in firsts], np.int64)
            fps = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in some], np.uint64).view(np.int64)
            columns = [np.repeat(fps, sizes), np.repeat(np.array([len(x) for x in some], np.int64), sizes), np.concatenate([np.zeros(0, np.uint64), *firsts]).view(np.int64)]
            columns.append(np.concatenate([np.zeros(0, np.int32), *[np.arange(k, dtype=np.int32) for k in sizes]]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["fp", "n", "h", "at"])

    rows = stored(mapped(own, prefixes, "fp long, n long, h long, at int"), "prefix")
    several = rows.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h")
    few = _marked(rows.withColumnRenamed("h", "mark"), stored(several.withColumnRenamed("h", "m"), "several")).filter("_in")
    few = stored(_with_component(few.select("fp", "n", "at", F.col("mark").alias("h")), found), "shared")
    dropped(rows)
    mixed = few.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("h")
    open_ = stored(few.join(mixed, "h").select("h", "fp", "n", "at", "c").distinct(), "mixed")
    dropped(few)
    wanted = stored(open_.select(F.col("fp").alias("f")).distinct(), "wanted")
    if not wanted.head(1):
        return None
    whole = _sets_of(docs, classes, wanted)
    main = open_.groupBy("h", "c").agg(F.count("*").alias("m")).groupBy("h").agg(F.max(F.struct("m", "c"))["c"].alias("main"))
    full = stored(open_.join(whole.select("fp", *_MAPS), "fp"), "full")
    rest = full.join(stored(main, "main"), "h").filter("c <> main").drop("main")
    other = full.select("h", F.col("fp").alias("v"), F.col("c").alias("d"), F.col("n").alias("on"), F.col("at").alias("oat"), *[F.col(m).alias(f"o{m}") for m in _MAPS])
    apart = F.lit(0)
    for m in _MAPS:
        apart = apart + F.bit_count(F.col(m).bitwiseXOR(F.col(f"o{m}")))
    sizes = 5 * F.least("n", "on") >= 4 * F.greatest("n", "on")
    reach = 9 * F.least(F.col("n") - F.col("at"), F.col("on") - F.col("oat")) >= 4 * (F.col("n") + F.col("on"))  # if this is the first that they share
    met = rest.join(other, "h").filter((F.col("c") != F.col("d")) & sizes & reach & (9 * apart <= F.col("n") + F.col("on")))
    return stored(similar(stored(_pairs(met), "tried"), whole), "similar")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component of near copies: the one with the smallest id (of equal ids, the least text digest; of equal rows, one).

    Documents without a word (null, empty or blank texts) are copies of one another. Null ids come after all others. Columns of any name pass; an
    empty table gives an empty table. A text of any length is sketched in one task. The texts meet the list of those that go, which is short enough to broadcast
    where few do; they are shuffled once at most, but for equal rows.
    """
    prints = stored(sketched(docs), "sketches")
    part = stored(with_components(prints.select("doc_id", "mark", "fp"), linked(docs, prints)).select("doc_id", "mark", "component", "component_id"), "parts")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    marks = part.filter(first).groupBy("component").agg(F.min("mark").alias("kept_mark"))
    gone = stored(part.join(marks, "component").filter(~(first & (F.col("mark") == F.col("kept_mark")))).select("doc_id", "mark").distinct(), "gone")
    again = stored(part.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "mark"), "again")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), "doc_id", F.xxhash64("text").alias("mark"))
    kept = own.join(gone, _same(own, gone), "left_anti")
    if again.head(1):
        once = kept.join(again, _same(kept, again), "left_anti")
        kept = once.unionByName(kept.join(again, _same(kept, again), "left_semi").dropDuplicates(["doc_id", "mark"]))
    return kept.select("d.*")

"""Repeated passages through a log-structured index of window fingerprints."""

from __future__ import annotations

import hashlib
import re
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, chunks, dropped, mapped, new_path, stored, with_columns_last

GRAM = 6
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
PIECE = 1 << 20

#: Bits of the map of texts that have something to verify or to remove (8 MB at most, in rows of 4 kB, so what is broadcast is bounded). Texts that
#: the map leaves out are not shuffled; it lets few others pass up to some 20 million marked texts. Results never depend on it.
MAP_BITS, ROW_BITS = 26, 15
BLOCK = 1 << 16


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, 1)
        return out


_WORDS = _Words()
CACHES.append(_WORDS)


def pieces(text: bytes):
    """The text in parts of about PIECE bytes that end at white space."""
    at = 0
    while at < len(text):
        stop = at + PIECE
        found = _SPACE.search(text, stop) if stop < len(text) else None
        stop = found.start() if found else len(text)
        yield text[at:stop]
        at = stop


def word_hashes(text: bytes) -> np.ndarray:
    parts = [np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words)) for words in map(bytes.split, pieces(text))]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for base in _BASES:
        inverse = pow(base, -1, 1 << 64)
        up, down = (np.full(n, b, np.uint64) for b in (base, inverse))
        up[0] = down[0] = 1
        out.append((np.multiply.accumulate(up), np.multiply.accumulate(down)))
    return out


_POWERS: list = []


class Rolled:
    """Hashes of any stretch of a block of words, in constant time each: prefix sums of a polynomial modulo 2^64."""

    def __init__(self, hashes: np.ndarray):
        if not _POWERS or len(_POWERS[0][0]) < len(hashes):
            _POWERS[:] = _powers(max(len(hashes), BLOCK + 256))
        self.sums = []
        for k, (up, _) in enumerate(_POWERS):
            own = hashes if k == 0 else _mixed(hashes + np.uint64(_BASES[1]))
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * up[: len(own)], dtype=np.uint64))))

    def of(self, k: int, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[k][stop] - self.sums[k][first]) * _POWERS[k][1][first])


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, where its leftmost least value is."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        a, b = at[: len(at) - step], at[step:]
        at, size = np.where(values[a] <= values[b], a, b), size + step
    return at


def anchors(hashes: np.ndarray, window: int, gram: int = GRAM):
    """Winnowed fingerprints: (fp, span, first, count) of each stretch of windows whose least gram is the same one.

    ``fp`` is that gram's hash, ``span`` a hash of all words of the stretch and of the gram's place in it, ``first`` the
    first window's start and ``count`` the number of windows. Equal windows have equal fingerprints.
    """
    gram = min(gram, window)
    for start in range(0, max(0, len(hashes) - window + 1), BLOCK):
        own = hashes[start : start + BLOCK + window - 1]
        rolled = Rolled(own)
        starts = np.arange(len(own) - gram + 1)
        values = rolled.of(0, starts, starts + gram)
        least = _leftmost_least(values, window - gram + 1)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        count = np.diff(np.concatenate((first, [len(least)])))
        place = (least[first] - first).astype(np.uint64)
        stop = first + count - 1 + window
        span = _mixed(rolled.of(0, first, stop) ^ (rolled.of(1, first, stop) + place * _M1 + count.astype(np.uint64)))
        yield values[least[first]], span, first + start, count


def _text(docs: DataFrame, text: str) -> DataFrame:
    """Identity (doc_id, mark) and the text as bytes. Rows equal in both are handled as one row that occurs again."""
    return docs.select("doc_id", F.xxhash64(text).alias("mark"), F.col(text).cast("binary").alias("_text"))


def fingerprints(docs: DataFrame, window: int = 35, text: str = "text") -> DataFrame:
    """(doc_id, mark, fp, span, first, count) of the whole texts of ``docs``."""

    def run(batches):
        for batch in batches:
            for a, b in chunks(batch.column("_text")):
                part, rows, which = batch.slice(a, b - a), [], []
                for i, value in enumerate(part.column("_text")):
                    for found in anchors(word_hashes(value.as_py() or b""), window):
                        rows.append(found)
                        which.append((i, len(found[0])))
                if not rows:
                    continue
                at = pa.array(np.repeat([i for i, _ in which], [n for _, n in which]))
                fp, span, first, count = (np.concatenate(c) for c in zip(*rows, strict=True))
                columns = [part.column("doc_id").take(at), part.column("mark").take(at), pa.array(fp.view(np.int64)), pa.array(span.view(np.int64)), pa.array(first.astype(np.int64)), pa.array(count.astype(np.int32))]
                for k in range(0, len(fp), 1 << 18):
                    yield pa.RecordBatch.from_arrays([c.slice(k, 1 << 18) for c in columns], names=["doc_id", "mark", "fp", "span", "first", "count"])

    return mapped(_text(docs, text), run, "doc_id long, mark long, fp long, span long, first long, count int")


class Index:
    """A folder of sorted immutable runs (fp, n, lo, hi): how often a fingerprint was seen and the least and greatest of its spans. Beside each batch's run stand
    its fingerprints (doc_id, mark, fp, span, first, count). ``extend`` merge-joins a new batch with the runs there are; more than ``fan_in``
    runs are compacted into one. An index is reopened by its path."""

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = 4):
        self.spark, self.path, self.fan_in = spark, path or new_path(spark, "index"), fan_in

    def _tables(self, kind: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(f"{self.path}/{kind}/{x.getPath().getName()}" for x in fs.listStatus(where)) if fs.exists(where) else []

    def _read(self, path: str, schema: str) -> DataFrame:
        out = self.spark.read.schema(schema).parquet(path)
        out._lattica_path = path
        return out

    @property
    def runs(self) -> list[DataFrame]:
        return [self._read(p, "fp long, n long, lo long, hi long") for p in self._tables("runs")]

    @property
    def prints(self) -> list[DataFrame]:
        return [self._read(p, _PRINTS) for p in self._tables("prints")]

    def _number(self) -> str:
        return f"{1 + max([-1, *[int(p.rsplit('/', 1)[1]) for kind in ('runs', 'prints') for p in self._tables(kind)]]):08d}"

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("fp").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def extend(self, batch: DataFrame) -> DataFrame:
        """Add the fingerprints of a batch (as ``fingerprints`` gives them), and return (doc_id, mark, first, count, same): the stretches, of old and new
        texts, that share a fingerprint of the batch with another stretch. ``same`` if all stretches of the fingerprint have one span."""
        k, earlier = self._number(), self.runs
        batch.write.parquet(f"{self.path}/prints/{k}")
        own = self.prints[-1]
        fresh = self._merged(own.select("fp", F.lit(1).cast("bigint").alias("n"), F.col("span").alias("lo"), F.col("span").alias("hi")))
        fresh.sortWithinPartitions("fp").write.parquet(f"{self.path}/runs/{k}")
        run = self.runs[-1]
        counts = run
        for old in earlier:
            counts = counts.unionByName(old.join(run.select("fp"), "fp", "left_semi"))
        met = (self._merged(counts) if earlier else run).filter("n > 1").select("fp", (F.col("lo") == F.col("hi")).alias("same"))
        met = stored(met, "met")
        hits = stored(_union([p.join(met, "fp").select("doc_id", "mark", "first", "count", "same") for p in self.prints]), "hits")
        dropped(met)
        if len(earlier) + 1 > self.fan_in:
            self.compact()
        return hits

    def compact(self) -> None:
        """All runs as one."""
        old = self.runs
        if len(old) > 1:
            self._merged(_union(old)).sortWithinPartitions("fp").write.parquet(f"{self.path}/runs/{self._number()}")
            for run in old:
                dropped(run)

    def drop(self) -> None:
        for table in [*self.runs, *self.prints]:
            dropped(table)


_PRINTS = "doc_id long, mark long, fp long, span long, first long, count int"


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _marked(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``texts`` (mark, ...) with ``_in``: false only where no row of ``wanted`` (m) has that mark."""
    slot = lambda c: F.shiftrightunsigned(F.col(c), 64 - MAP_BITS)
    bits = wanted.select(F.shiftright(slot("m"), ROW_BITS).alias("_row"), slot("m").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_bit"))
    rows = F.broadcast(bits.groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_map")))
    at = slot("mark").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    byte = F.conv(F.hex(F.substr(F.col("_map"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.expr("shiftright(_byte, CAST(_at & 7 AS INT)) & 1") == 1
    joined = texts.withColumn("_row", F.shiftright(slot("mark"), ROW_BITS)).join(rows, "_row", "left")
    joined = joined.withColumns({"_byte": byte, "_at": at}).withColumn("_in", F.coalesce(there, F.lit(False)))
    return joined.drop("_row", "_map", "_byte", "_at")


def _windows(ranges: DataFrame, docs: DataFrame, window: int, text: str) -> DataFrame:
    """(a, b, doc_id, mark, first): 128-bit hashes of each window in the ranges (doc_id, mark, ranges)."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                hashes = word_hashes(batch.column("_text")[i].as_py())
                starts = np.concatenate([np.arange(r["first"], r["first"] + r["count"]) for r in batch.column("ranges")[i].as_py()])
                for k in range(0, len(hashes), BLOCK):
                    some = starts[(starts >= k) & (starts < k + BLOCK)] - k
                    if not len(some):
                        continue
                    rolled = Rolled(hashes[k : k + BLOCK + window - 1])
                    a, b = rolled.of(0, some, some + window), rolled.of(1, some, some + window)
                    who = pa.array(np.full(len(some), i))
                    columns = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), batch.column("doc_id").take(who), batch.column("mark").take(who), pa.array(some + k)]
                    yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "doc_id", "mark", "first"])

    wanted = ranges.withColumnRenamed("doc_id", "d").withColumnRenamed("mark", "m")
    some = _marked(_text(docs, text), wanted).filter("_in").drop("_in")
    both = some.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
    return mapped(both.select("doc_id", "mark", "_text", "ranges"), run, "a long, b long, doc_id long, mark long, first long")


def verified(hits: DataFrame, docs: DataFrame, window: int, text: str = "text") -> DataFrame:
    """(doc_id, mark, first, count): the stretches of ``Index.extend`` whose windows do occur again. A fingerprint whose spans are all
    the same settles its windows at once; for the others (edges of passages), each window is compared by a 128-bit hash of its words, those of all
    such stretches of the ``docs``. The windows that occur twice are a table, so the join with them can be split at a very frequent one."""
    sure = hits.filter("same").select("doc_id", "mark", "first", "count").distinct()
    open_ranges = stored(hits.filter("NOT same").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "count")).alias("ranges")), "open")
    checked = stored(_windows(open_ranges, docs, window, text), "windows")
    twice = stored(checked.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b"), "twice")
    return sure.unionByName(checked.join(twice, ["a", "b"]).select("doc_id", "mark", "first", F.lit(1).alias("count")))


def repeated_windows(docs: DataFrame, window: int = 35, batches: int = 2, text: str = "text") -> DataFrame:
    """(doc_id, mark, first, count): stretches of window starts whose ``window`` words also start anywhere else.

    Documents enter an index in ``batches``; each is merge-joined with the runs before it, so a stretch is found when the later
    of two copies comes in. What was found is verified once, over all documents.
    """
    index, hits = Index(docs.sparkSession), []
    for k in range(batches):
        part = docs.filter(F.coalesce(F.pmod(F.xxhash64(text), F.lit(batches)), F.lit(0)) == k)
        hits.append(index.extend(fingerprints(part, window, text)))
    index.drop()
    return verified(_union(hits), docs, window, text)


def without_repeats(docs: DataFrame, window: int = 35, text: str = "text", batches: int = 2, keep_text: bool = True) -> DataFrame:
    """``docs`` without its text, and n_words, n_removed, kept_sha256 and (if ``keep_text``) kept_text.

    Removed is every word of a window whose words also start elsewhere; kept words are joined by one space. A null text has
    no words. Rows of one id and text count as often as they occur: they repeat each other. Columns of the results' names are replaced, all others pass,
    whatever their names; an empty table gives an empty table. A text of any length is read in pieces.
    """
    found = repeated_windows(docs, window, batches, text)
    ranges = found.groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m")).agg(F.collect_list(F.struct("first", "count")).alias("ranges"))
    names = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text
    kept = with_columns_last(docs.drop(text), names)
    names_, columns = kept.columns, [f"c{i}" for i in range(len(kept.columns))]
    schema = kept.toDF(*columns).schema
    for n in names:
        schema = schema.add(n, "long" if n.startswith("n_") else "string")

    def run(batches):
        for batch in batches:
            texts, spans = batch.column("_text"), batch.column("ranges")
            for a, b in chunks(texts):
                rows = []
                for i in range(a, b):
                    value, gone, at, n, removed, digest, out = texts[i].as_py() or b"", None, 0, 0, 0, hashlib.sha256(), []
                    if spans[i].is_valid:
                        gone = _covered(spans[i].as_py(), window)
                    for words in map(bytes.split, pieces(value)):
                        left = words if gone is None or n >= len(gone) else [w for w, g in zip_longest(words, gone[n : n + len(words)].tolist(), fillvalue=False) if not g]
                        n += len(words)
                        removed += len(words) - len(left)
                        if left:
                            line = b" ".join(left)
                            digest.update(b" " + line if at else line)
                            at = 1
                            if keep_text:
                                out.append(line)
                    rows.append((n, removed, digest.hexdigest(), b" ".join(out).decode("utf-8", "replace")))
                cols = list(zip(*rows, strict=True))
                new = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())] + [pa.array(cols[3], pa.string())] * keep_text
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in columns] + new, names=[*columns, *names])

    ranges = stored(ranges, "ranges")
    source = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(names_, columns, strict=True)], F.col("doc_id").alias("_id"), F.xxhash64(text).alias("mark"), F.col(text).cast("binary").alias("_text"))
    both = _marked(source, ranges)
    near = both.filter("_in").join(ranges, F.col("_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left").select(*columns, "_text", "ranges")
    far = both.filter("NOT _in").select(*columns, "_text", F.lit(None).cast(ranges.schema["ranges"].dataType).alias("ranges"))
    return mapped(near.unionByName(far), run, schema).toDF(*names_, *names)


def _covered(spans: list[dict], window: int) -> np.ndarray:
    """True for each word in a stretch of windows; as long as needed, plus room for words after it."""
    edge = np.zeros(max(r["first"] + r["count"] for r in spans) + window + 1, np.int64)
    np.add.at(edge, [r["first"] for r in spans], 1)
    np.add.at(edge, [r["first"] + r["count"] - 1 + window for r in spans], -1)
    return np.cumsum(edge) > 0

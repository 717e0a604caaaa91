"""Line deduplication by winnowing over line hashes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, dropped, mapped, stored, with_columns_last
from .substring_index import _leftmost_least, _mixed

#: Lines of a run that is a passage, and words of a line that is one by itself.
WINDOW, PASSAGE = 2, 5

_LINE = re.compile(rb"[^\x20\x09-\x0D][^\n]*")
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def hashed(texts: list[bytes], passage: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines with a word: the text each is in, its number among the text's, its 128-bit hash, and whether it is a passage."""
    counts, long_, digests = [], [], []
    for text in texts:
        before = len(digests)
        for line in text.split(b"\n"):
            n = len(line.split(None, passage or 1))
            if n:
                digests.append(xxhash.xxh3_128_digest(line))
                long_.append(passage is not None and n >= passage)
        counts.append(len(digests) - before)
    n = np.array(counts, np.int64)
    hashes = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return np.repeat(np.arange(len(n)), n), np.arange(len(digests)) - np.repeat(np.cumsum(n) - n, n), hashes, np.array(long_, bool)


def winnowed(texts: list[bytes], window: int, passage: int | None) -> Iterator[tuple]:
    """(which, size, fp, first, windows, bounds) of the fingerprints of ``texts``: text, lines of a window, hash of the line, first window
    around it, and the 128-bit hashes (n x 2) of all windows around it, those of the k-th from bounds[k] to bounds[k + 1].

    In each window of ``window`` lines the leftmost one with the least hash is chosen, so equal windows choose equal lines. A line that
    is a passage is a window by itself.
    """
    which, line, hashes, alone = hashed(texts, passage)
    if window > 1 and alone.any():
        at = np.flatnonzero(alone)
        yield which[at], 1, hashes[at, 0], line[at], hashes[at], np.arange(len(at) + 1)
    starts = np.arange(len(line) - window + 1)
    starts = starts[which[starts] == which[starts + window - 1]] if len(starts) else starts
    if not len(starts):
        return
    least = _leftmost_least(hashes[:, 0], window)[starts]
    whole = np.zeros((len(starts), 2), np.uint64)
    for j in range(window):
        for side, base in enumerate(_BASES):
            whole[:, side] = _mixed(whole[:, side] * base + hashes[starts + j, side])
    begin = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    yield which[starts[begin]], window, hashes[least[begin], 0], line[starts[begin]], whole, np.append(begin, len(starts))


def fingerprints(docs: DataFrame, window: int = WINDOW, text: str = "text", passage: int | None = PASSAGE) -> DataFrame:
    """(doc_id, mark, size, fp, first, windows): the winnowed lines of each text and the windows around them (``winnowed``)."""

    def run(batches):
        for batch in batches:
            texts = batch.column("_text")
            for a, b in chunks(texts):
                for which, size, fp, first, windows, bounds in winnowed([x or b"" for x in texts.slice(a, b - a).to_pylist()], window, passage):
                    at = pa.array(which + a)
                    pairs = pa.StructArray.from_arrays([pa.array(windows[:, k].view(np.int64)) for k in (0, 1)], names=["a", "b"])
                    columns = [batch.column("doc_id").take(at), batch.column("mark").take(at), pa.array(np.full(len(fp), size, np.int32)), pa.array(fp.view(np.int64)), pa.array(first), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pairs)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "size", "fp", "first", "windows"])
            del texts, batch

    source = docs.select("doc_id", F.xxhash64(text).alias("mark"), F.col(text).cast("binary").alias("_text"))
    return mapped(source, run, "doc_id long, mark long, size int, fp long, first long, windows array<struct<a:long,b:long>>")


def repeated_runs(docs: DataFrame, window: int = WINDOW, text: str = "text", passage: int | None = PASSAGE) -> DataFrame:
    """(doc_id, mark, first, size, later): all places of windows that stand in two places or more; ``later`` is false at the earliest.

    Positions are ordered by doc_id (null first), text digest and line. Fingerprints that occur again are joined; their surroundings
    are compared as far as windows around them reach both ways. Each place meets its window's earliest only, found by a minimum
    that is combined before the shuffle, so a line in very many places makes no pairs; the tables of fingerprints and
    windows that occur again stand by themselves, so joins with them can be split at such a line.
    """
    prints = stored(fingerprints(docs, window, text, passage), "lines")
    again = stored(prints.groupBy("fp", "size").agg(F.count("*").alias("n")).filter("n > 1").select("fp", "size"), "again")
    spots = prints.join(again, ["fp", "size"]).select("doc_id", "mark", "size", "first", F.posexplode("windows").alias("k", "w")).select("doc_id", "mark", "size", (F.col("first") + F.col("k")).alias("first"), "w.a", "w.b")
    spots = stored(spots, "spots")
    dropped(prints)
    place = F.struct("doc_id", "mark", "first")
    heads = spots.groupBy("a", "b", "size").agg(F.min(place).alias("head"), F.count("*").alias("n")).filter("n > 1").select("a", "b", "size", "head")
    heads = stored(heads, "heads")
    return spots.join(heads, ["a", "b", "size"]).select("doc_id", "mark", "first", "size", (~place.eqNullSafe(F.col("head"))).alias("later"))


def removed(runs: list[dict], n: int) -> np.ndarray:
    """Which of a text's n lines go: passages that stand earlier, and lines of later windows that no window's earliest place covers."""
    gone, stays = np.zeros(n, bool), np.zeros(n, bool)
    alone = np.zeros(n, bool)
    for r in runs:
        mask = alone if r["size"] == 1 else gone if r["later"] else stays
        if r["later"] or r["size"] > 1:
            mask[r["first"] : r["first"] + r["size"]] = True
    return gone & ~stays | alone


def deduplicated(docs: DataFrame, window: int = WINDOW, text: str = "text", passage: int | None = PASSAGE) -> DataFrame:
    """``docs`` with ``text`` less its later repeated runs, and n_lines, n_removed_lines (lines with a word), kept_sha256.

    A run is ``window`` or more lines in a row that also stand in a row elsewhere, in another document or the same one, or (with
    ``passage``) one line of so many words. The earliest copy stays whole, also where a later one overlaps it, and of the others
    all lines outside it go: of one line four times in a row, two stay. The earliest of all places of a line
    always stays, so no line is lost. Lines are compared whole; lines without a word take no part and stay. Of equal windows in rows of one id
    the one with the lesser text digest is earlier; rows equal in id and text lose the same lines.

    A null text stays null, with no lines; kept lines are joined by line ends, so a text that loses nothing is unchanged. An empty table
    gives an empty table. Columns named n_lines, n_removed_lines or kept_sha256 are replaced; all others pass, whatever their names.
    A text is split in one task, line by line, whatever its length. Documents are joined to their runs by id and digest: one shuffle of the texts.
    """
    runs = repeated_runs(docs, window, text, passage)
    runs = runs.groupBy(F.col("doc_id").alias("_d"), F.col("mark").alias("_m")).agg(F.collect_set(F.struct("first", "size", "later")).alias("_runs"))
    runs = runs.filter(F.exists("_runs", lambda r: r["later"]))
    names = ["n_lines", "n_removed_lines", "kept_sha256"]
    kept = with_columns_last(docs, names)
    plain = [f"c{i}" for i in range(len(kept.columns))]
    columns = [c for c, name in zip(plain, kept.columns, strict=True) if name != text]

    def run(batches):
        for batch in batches:
            for a, b in chunks(batch.column("_text")):
                part = batch.slice(a, b - a)
                outs, n_lines, n_gone, digests = [], [], [], []
                for value, runs in zip(part.column("_text").to_pylist(), part.column("_runs").to_pylist(), strict=True):
                    out, gone = value or b"", 0
                    n = len(_LINE.findall(out))
                    if runs:
                        goes = iter(removed(runs, n).tolist())
                        lines = out.split(b"\n")
                        left = [x for x in lines if not x.split(None, 1) or not next(goes)]
                        gone, out = len(lines) - len(left), b"\n".join(left)
                    outs.append(None if value is None else out)
                    n_lines.append(n), n_gone.append(gone), digests.append(hashlib.sha256(out).hexdigest())
                new = [pa.array(outs, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in columns] + new, names=[*columns, "_text", *names])
                del part
            del batch

    schema = kept.toDF(*plain).select(*columns).schema.add("_text", "binary")
    for c in names:
        schema = schema.add(c, "string" if c == "kept_sha256" else "long")
    texts = dict(zip(kept.columns, plain, strict=True))
    source = kept.select(*[F.col(f"`{c}`").alias(p) for c, p in texts.items()])
    source = source.select(*columns, F.col(texts["doc_id"]).alias("_id"), F.xxhash64(texts[text]).alias("_mark"), F.col(texts[text]).cast("binary").alias("_text"))
    joined = source.join(runs, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_mark") == F.col("_m")), "left")
    out = mapped(joined.select(*columns, "_text", "_runs"), run, schema)
    return out.select(*[F.col("_text").cast("string").alias(c) if c == text else F.col(p).alias(c) for c, p in texts.items()], *names)

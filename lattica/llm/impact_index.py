"""Ranked lexical search, score at a time: postings grouped by exact impact are read from the highest impact down."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, dropped, mapped, stored

#: Postings that an index of one shard of documents holds, about; one document is never cut.
SHARD_POSTINGS = 1_000_000

#: Terms of the items that are answered in one pass over the documents, about; more items are answered in blocks.
BLOCK_TERMS = 200_000

#: One document in so many gives the first threshold of each item.
SCOUTS = 16

#: Part of the highest impact left down to which the groups of one step reach.
STEP = 0.75

#: Lower-cases A-Z, keeps a-z, 0-9 and all that is not ASCII, and turns the rest into spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
PIECE = 1 << 20


def term_counts(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """The distinct terms of a text and how often each occurs. A long text is folded in pieces that end where a term does."""
    counts: dict[bytes, int] = {}
    folded, at = memoryview(text), 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and _FOLD[text[end]] != 32:
            end += 1
        for term in bytes(folded[at:end]).translate(_FOLD).split():
            counts[term] = counts.get(term, 0) + 1
        at = end
    return list(counts), np.fromiter(counts.values(), np.int64, len(counts))


def _terms_of(batches):
    """Items with their distinct terms; those without a term go."""
    for batch in batches:
        found = [term_counts(t.as_py())[0] if t.is_valid else [] for t in batch.column("text")]
        out = pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])
        yield out.filter(pc.greater(pc.list_value_length(out.column("terms")), 0))


@dataclass
class Block:
    """A block of items: their numbers, and for each a run of ``terms`` (from ``starts``), terms being given by their ``places``."""

    places: dict[bytes, int]
    items: np.ndarray
    starts: np.ndarray
    terms: np.ndarray


def _block(rows: pa.Table) -> Block:
    lists = rows.column("terms").combine_chunks()
    flat = lists.flatten().to_pylist()
    places = {t: i for i, t in enumerate(sorted(set(flat)))}
    starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    return Block(places, rows.column("q").to_numpy(), starts, np.array([places[t] for t in flat], np.int32))


def _counted(docs: DataFrame, block: Block) -> DataFrame:
    """(doc_id, n, terms, tfs) for each document with a term at all: its length, and the terms of the block that it holds, with their frequencies."""
    shared = docs.sparkSession.sparkContext.broadcast(block.places)

    def run(batches):
        places = shared.value
        for batch in batches:
            for a, b in chunks(batch.column("text")):
                part = batch.slice(a, b - a)
                sizes, terms, tfs = [], [], []
                for text in part.column("text"):
                    own, counts = term_counts(text.as_py()) if text.is_valid else ([], np.zeros(0, np.int64))
                    sizes.append(int(counts.sum()))
                    at = np.fromiter((places.get(t, -1) for t in own), np.int32, len(own))
                    terms.append(at[at >= 0])
                    tfs.append(counts[at >= 0])
                columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
                out = pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])
                yield out.filter(pc.greater(out.column("n"), 0))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", F.col("text").cast("binary").alias("text")), run, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


def _frequencies(batches):
    """Documents of each term, summed over a batch."""
    for batch in batches:
        flat = batch.column("terms").flatten().to_numpy()
        if len(flat):
            at, n = np.unique(flat, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["term", "df"])


class Shard:
    """Impact-ordered postings of some documents: for each term its documents by falling impact, and beside it each document's own postings."""

    def __init__(self, batches: list[pa.RecordBatch], weights: np.ndarray, n_docs: int, length: int):
        rows = pa.Table.from_batches(batches).combine_chunks()
        self.ids = rows.column("doc_id").combine_chunks()
        lists = rows.column("terms").combine_chunks()
        term, tf = lists.flatten().to_numpy(), rows.column("tfs").combine_chunks().flatten().to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        m = 50 + 50 * rows.column("n").to_numpy() * n_docs // length
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.starts))
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        self.own_term, self.own_impact = term, impact
        order = np.lexsort((-impact, term))
        self.doc, self.falling = doc[order], -impact[order]
        self.first = np.searchsorted(term[order], np.arange(len(weights) + 1))
        order = pc.sort_indices(self.ids, null_placement="at_start").to_numpy()
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))

    def top(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` documents of highest score for an item, with their scores, of those that score ``least`` or more; equal scores by ascending id.

        Groups of one impact are added up from the highest down, over all terms at once. ``rest`` is the most that the groups left can add. Once
        a document not yet met can no longer reach the k-th best sum, and few of those met can, the sums of these are completed from their own postings.
        """
        at, end = self.first[terms].copy(), self.first[terms + 1]
        sums = np.zeros(len(self.ids), np.int64)
        while True:
            left = at < end
            heads = -self.falling[at[left]]
            rest, bar = int(heads.sum()), least
            if len(sums) > k:
                bar = max(bar, int(np.partition(sums, len(sums) - k)[len(sums) - k]))
            if rest < bar or not rest:
                found = np.flatnonzero((sums + rest >= bar) & (sums > 0))
                if not rest or len(found) <= 8 * k:
                    break
            down = -int(heads.max() * STEP)
            for t in np.flatnonzero(left):
                stop = at[t] + int(np.searchsorted(self.falling[at[t] : end[t]], down, "right"))
                sums[self.doc[at[t] : stop]] += -self.falling[at[t] : stop]  # a term stands once in a document
                at[t] = stop
        if rest:
            sums[found] = self._whole(found, terms)
        found = found[(sums[found] >= max(1, least))]
        best = found[np.lexsort((self.rank[found], -sums[found]))[:k]]
        return best, sums[best]

    def _whole(self, found: np.ndarray, terms: np.ndarray) -> np.ndarray:
        asked = np.zeros(len(self.first) - 1, bool)
        asked[terms] = True
        out = np.zeros(len(found), np.int64)
        for i, d in enumerate(found):
            own = slice(self.starts[d], self.starts[d + 1])
            out[i] = self.own_impact[own][asked[self.own_term[own]]].sum()
        return out


def _best(counted: DataFrame, block: Block, weights: np.ndarray, n_docs: int, length: int, k: int, least: np.ndarray, postings: int = SHARD_POSTINGS) -> DataFrame:
    """(q, doc_id, score): for each item the ``k`` best documents of each shard that reach the item's threshold."""
    shared = counted.sparkSession.sparkContext.broadcast((block.items, block.starts, block.terms, weights, least))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for a in range(0, len(batch), 64):
                part = batch.slice(a, 64)
                held.append(part)
                size += len(part.column("terms").flatten())
                if size >= postings:
                    yield from answers(held)
                    held, size = [], 0
        if size:
            yield from answers(held)

    def answers(held):
        items, starts, terms, own, bars = shared.value
        shard = Shard(held, own, n_docs, length)
        found = [shard.top(terms[starts[i] : starts[i + 1]], k, int(bars[i])) for i in range(len(items))]
        best, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(best):
            qs = np.repeat(items, [len(x[0]) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(qs), shard.ids.take(pa.array(best)), pa.array(scores)], names=["q", "doc_id", "score"])

    return mapped(counted, run, f"q long, doc_id {counted.schema['doc_id'].dataType.simpleString()}, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS, postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` documents of highest score above 0 for each row of ``items`` (item_id, text).

    Shards of documents (parts of a task's input of about ``postings`` postings) are indexed where they lie, so no term's postings ever come together. A
    first pass over one document in SCOUTS gives each item a threshold, its k-th best score so far, below which no shard answers or reads on; each shard then
    gives k documents an item at most. Items are broadcast in blocks of about ``block_terms`` terms (an item is not cut), each answered by its own pass.

    Each row of ``items`` is an item of its own, so repeated ids are ranked each; null texts and those without a term get no rows, nor do they count as
    documents. Null doc_ids come first among equal scores, and repeated documents are documents of their own. An empty table on either side gives an empty
    one. Other columns take no part. A text of any length is counted whole.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    asked = mapped(items.select("item_id", F.col("text").cast("binary").alias("text")), _terms_of, f"item_id {kind}, terms array<binary>")
    asked = stored(asked.withColumn("q", F.monotonically_increasing_id()), "items")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms)
    parts = []
    for b in range(blocks):
        block = _block(asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).select("q", "terms").toArrow())
        if not len(block.items):
            continue
        counted = stored(_counted(docs, block).withColumn("scout", F.pmod(F.xxhash64("doc_id", "n", "tfs"), F.lit(SCOUTS)) == 0), "counts")
        sizes = counted.agg(F.count("*"), F.sum("n")).first()
        if not sizes[0]:
            dropped(counted)
            continue
        known = mapped(counted.select("terms"), _frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df = np.zeros(len(block.places), np.int64)
        df[known.column("term").to_numpy()] = known.column("df").to_numpy()
        weights = np.floor(1000 * np.log((2 * sizes[0] + 2) / (2 * df + 1))).astype(np.int64)
        least = np.ones(len(block.items), np.int64)
        scouts = stored(_cut(_best(counted.filter("scout").drop("scout"), block, weights, *sizes, k, least.copy(), postings), k), "scouts")
        bars = scouts.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("bar")).filter(F.col("n") >= k).toArrow()
        number = {q: i for i, q in enumerate(block.items.tolist())}
        least[[number[q] for q in bars.column("q").to_pylist()]] = bars.column("bar").to_numpy()
        rest = _cut(_best(counted.filter("NOT scout").drop("scout"), block, weights, *sizes, k, least, postings), k)
        parts.append(_cut(scouts.unionByName(rest), k))
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first()))
    return out.withColumn("rank", place).join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def _cut(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")

"""Language identification with language bitmasks of n-grams in bit-sliced Bloom filters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, dropped, mapped, remainder, stored, with_columns_last

GRAM = 4
HASHES = 3
UNDETERMINED = "und"

#: Lower-cases A-Z and turns every other ASCII character that is not a letter into a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def grams(text: bytes) -> np.ndarray:
    """Distinct packed GRAM-byte n-grams of a folded text, that of only spaces left out; repeated passages count once."""
    folded = np.frombuffer(b" " + text.translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    if len(folded) < GRAM:
        return np.zeros(0, np.uint32)
    out = np.zeros(len(folded) - GRAM + 1, np.uint32)
    for k in range(GRAM):
        out = out << np.uint32(8) | folded[k : len(folded) - GRAM + 1 + k]
    out = np.unique(out)
    return out[out != 0x20202020]


def slots(packed: np.ndarray, log2_size: int) -> list[np.ndarray]:
    wide = packed.astype(np.uint64)
    return [(wide * np.uint64(m) >> np.uint64(64 - log2_size)).astype(np.int64) for m in _ODD[:HASHES]]


@dataclass
class Model:
    """``table``: a Bloom filter for each language, bit-sliced: a row for each slot, a bit for each language (64 to a word)."""

    languages: list[str]
    table: np.ndarray
    log2_size: int

    def __post_init__(self):
        self.false_rate = np.array([np.count_nonzero(self._bit(self.table, i)) / max(1, len(self.table)) for i in range(len(self.languages))]) ** HASHES

    @staticmethod
    def _bit(masks: np.ndarray, i: int) -> np.ndarray:
        return masks[:, i // 64] & np.uint64(1 << i % 64)

    def masks(self, packed: np.ndarray) -> np.ndarray:
        """For each n-gram the bits of all languages whose filters hold it."""
        first, *rest = slots(packed, self.log2_size)
        out = self.table[first]
        for s in rest:
            out &= self.table[s]
        return out

    def counts(self, packed: np.ndarray) -> np.ndarray:
        """For each language the n-grams its filter holds, less those expected by mistake."""
        masks = self.masks(packed)
        held = np.array([np.count_nonzero(self._bit(masks, i)) for i in range(len(self.languages))], float)
        return np.maximum(0, (held - self.false_rate * len(packed)) / (1 - np.minimum(self.false_rate, 0.5)))

    def predict(self, text: bytes | None) -> tuple[str, float, float]:
        """(language, its share of all languages' corrected counts, the share of the text's n-grams that it holds).

        ``und`` with zeros for a null text and one without a letter. A text with letters of which no filter knows an
        n-gram gets the first language (the one with most training rows) with zeros; a tie goes to
        the language with more training rows. A long text is read in pieces, each with its distinct n-grams.
        """
        if text is None or not self.languages or not _lettered(text):
            return UNDETERMINED, 0.0, 0.0
        total, n = np.zeros(len(self.languages)), 0
        for k in range(0, len(text), 1 << 20):
            packed = grams(text[max(0, k - GRAM + 1) : k + (1 << 20)])
            total += self.counts(packed)
            n += len(packed)
        best = int(total.argmax())
        return self.languages[best], float(total[best] / total.sum()) if total.sum() else 0.0, min(1.0, float(total[best] / max(1, n)))


def _lettered(text: bytes) -> bool:
    if text.translate(_FOLD).strip():  # ASCII letters, or bytes of other characters
        return any(map(str.isalpha, text.decode("utf-8", "replace")))
    return False


def labelled(docs: DataFrame) -> DataFrame:
    """The rows that may teach: non-null lang and text, crc32 of the id's text modulo 3 not 1."""
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(remainder(F.col("doc_id"), 3) != 1, F.lit(True)))


def fit(docs: DataFrame, sample_rows: int = 4_000, share: float = 0.25, least: int = 3) -> Model:
    """Fit on about ``sample_rows`` different labelled texts of each language (documented bound): all of a language that has fewer, else
    those whose hash of text and language falls below the share that gives so many. Copies teach once.

    An n-gram goes into a language's filter if it was seen in ``least`` texts there and its frequency there is at least ``share`` of
    its highest frequency in any language. Each language keeps its n-grams whatever the others have, and no language is left out. The filters
    have four slots or more for each n-gram kept, whose number the sample bounds. No labelled row: no language, and everything is ``und``. Of
    two languages with equally many texts the first by code points comes first.
    """
    taught = labelled(docs).select("lang", "text", F.xxhash64("lang", "text").alias("h"))
    known = taught.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts"), F.count("*").alias("rows")).collect()
    if not known:
        return Model([], np.zeros((1, 1), np.uint64), 0)
    known = sorted(known, key=lambda r: (-r["rows"], r["lang"]))
    languages = [r["lang"] for r in known]
    shares = [(r["lang"], k, min(1.0, sample_rows / max(1, r["texts"]))) for k, r in enumerate(known)]
    table = docs.sparkSession.createDataFrame(shares, "of string, k int, part double")
    drawn = taught.join(F.broadcast(table), F.col("lang") == F.col("of")).filter(F.pmod("h", F.lit(1 << 20)) < F.col("part") * (1 << 20))

    def count(batches):
        for batch in batches:
            sums: dict[int, list] = {}
            for k, text in zip(batch.column("k").to_pylist(), batch.column("text"), strict=True):
                sums.setdefault(k, []).append(grams(text.as_py()))
            for k, parts in sums.items():
                packed, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(packed), pa.int32()), pa.array(packed.astype(np.int64)), pa.array(n)], names=["k", "gram", "n"])

    texts = drawn.dropDuplicates(["k", "h"]).select("k", F.col("text").cast("binary").alias("text"))
    by_gram = mapped(texts, count, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    by_gram = stored(by_gram, "grams")
    totals = by_gram.groupBy("k").agg(F.sum("n").alias("total"))
    often = by_gram.join(F.broadcast(totals), "k").withColumn("f", F.col("n") / F.col("total"))
    most = often.groupBy("gram").agg(F.max("f").alias("most"), F.collect_list(F.struct("k", "n", "f")).alias("by"))
    kept = most.select("gram", F.transform(F.filter("by", lambda x: (x["n"] >= least) & (x["f"] >= share * F.col("most"))), lambda x: x["k"]).alias("ks")).filter(F.size("ks") > 0)
    found = kept.toArrow()
    dropped(by_gram)
    packed, ks = found.column("gram").to_numpy().astype(np.uint32), found.column("ks").combine_chunks()
    at, of = np.repeat(np.arange(len(packed)), ks.value_lengths().to_numpy(zero_copy_only=False)), ks.flatten().to_numpy()
    log2_size = max(16, (4 * len(packed)).bit_length())
    table = np.zeros((1 << log2_size, -(-len(languages) // 64)), np.uint64)
    for s in slots(packed, log2_size):
        np.bitwise_or.at(table, (s[at], of // 64), np.uint64(1) << (of % 64).astype(np.uint64))
    return Model(languages, table, log2_size)


def predicted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and known (``Model.predict``), from the text alone. Columns of those names give way; all others pass,
    whatever their names. Repeated rows, null ids and texts of any length are predicted like any other row; an empty table gives an empty table."""
    names = ["lang_pred", "score", "known"]
    kept = with_columns_last(docs, names)
    plain = kept.toDF(*["text" if c == text else f"c{i}" for i, c in enumerate(kept.columns)])
    columns = plain.columns
    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in names[1:]]])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            for a, b in chunks(batch.column("text")):
                part = batch.slice(a, b - a)
                done = [own.predict(x.as_py().encode() if x.is_valid else None) for x in part.column("text")]
                new = [pa.array([x[0] for x in done], pa.string()), *[pa.array([x[i] for x in done], pa.float64()) for i in (1, 2)]]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in columns] + new, names=[*columns, *names])

    return mapped(plain, run, schema).toDF(*kept.columns, *names)

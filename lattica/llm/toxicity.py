"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, dropped, mapped, remainder, stored, with_columns_last

#: Slots of the hashed features, as a power of two; one more holds the bias.
BITS = 20
BIAS = 1 << BITS

#: Labelled rows that may teach: the documented bound of the sample.
SAMPLE_ROWS = 40_000

#: Rows of the sample that learn in a row (parts of about so many learn side by side), and how often their states are brought together.
SHARD_ROWS, ROUNDS = 5_000, 6

#: Texts of the sample that must hold a feature for it to be learned: what a text or two hold passes no L1 bound.
LEAST = 3

#: A text is read in pieces of about so many characters, cut where a word ends.
PIECE = 1 << 18

#: Distances between the two words of a pair: neighbours, and skip-grams over one and two words.
GAPS = (1, 2, 3)

_WORD = re.compile(r"[^\W_]+")
_CUT = re.compile(r"[\W_]")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LEFT = np.uint64(0xC2B2AE3D27D4EB4F)


def _words(text: str) -> np.ndarray:
    found = _WORD.findall(text.lower())
    return np.fromiter(map(zlib.crc32, "\n".join(found).encode().split(b"\n")), np.uint64, len(found)) if found else np.zeros(0, np.uint64)


def slots(text: str):
    """Slots of a text's words, neighbouring words and skip-grams, an array for each piece of the text and kind of feature."""
    at, last = 0, np.zeros(0, np.uint64)
    while at < len(text):
        cut = _CUT.search(text, at + PIECE)
        end = cut.end() if cut else len(text)
        own = _words(text[at:end])
        line, at = np.concatenate([last, own]), end
        yield _slot(own)
        for gap in GAPS:
            first = max(0, len(last) - gap)
            left, right = line[first:-gap], line[first + gap :]
            yield _slot((left * _LEFT ^ right) + np.uint64(gap))
        last = line[-max(GAPS) :]


def _slot(h: np.ndarray) -> np.ndarray:
    h = h * _ODD
    return ((h ^ h >> np.uint64(29)) * _LEFT >> np.uint64(64 - BITS)).astype(np.int32)


def features(text: str) -> np.ndarray:
    """Distinct slots of a text, in order: a feature counts once, however often it stands there."""
    return np.unique(np.concatenate([np.zeros(0, np.int32), *slots(text)]))


@dataclass
class Ftrl:
    """State of FTRL-proximal: ``z`` and ``n`` for each feature, the bias last. The learning rate of a coordinate is alpha / (beta + sqrt(n)), and
    so its L1 bound grows as l1 * (beta + sqrt(n)): a weight is not zero only where its gradients lean one way by more than chance."""

    z: np.ndarray
    n: np.ndarray
    alpha: float = 8.0
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 0.01

    def weights(self, at) -> np.ndarray:
        """Weights of features; those whose ``z`` has not passed the bound are zero. The bias has none."""
        z, n = self.z[at], self.n[at]
        bound = np.where(at == len(self.z) - 1, 0.0, self.l1 * (self.beta + np.sqrt(n)))
        return np.where(np.abs(z) <= bound, 0.0, -(z - np.sign(z) * bound) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: float) -> None:
        """One step with a row whose features are ``at``."""
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = probability(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def probability(x: float) -> float:
    return float(1 / (1 + np.exp(-min(35.0, max(-35.0, x)))))


@dataclass
class Model:
    """The slots of non-zero weights, ascending, their weights, and the bias: small enough to be sent to every task."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.table = np.zeros(BIAS)
        self.table[self.slots] = self.weights

    def score(self, text: str | None) -> float:
        """Probability of label 1, from the text alone; a null or empty text has the bias only."""
        held = [np.zeros(0, np.int32)]
        for at in slots(text or ""):
            held.append(np.unique(at[self.table[at] != 0]))
        return probability(self.bias + float(self.table[np.unique(np.concatenate(held))].sum()))


def labelled(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, y) of the rows that may teach: a label of 0 or 1, a text, and crc32 of the id's text modulo 3 not 1; about ``sample_rows`` labels,
    drawn by a hash of their ids, all if there are fewer. An id under both labels teaches nothing; null ids and other values of the label neither.
    The labels drawn are broadcast (the bound holds them); no text is shuffled for them."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    known = known.filter(remainder(F.col("id"), 3) != 1).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").drop("most")
    part = min(1.0, sample_rows / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(part * (1 << 40)))
    return docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("id")).filter(F.col("text").isNotNull()).select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> Model:
    """Learn from ``labelled`` rows; equal texts of one label teach once.

    The sample is dealt to shards of about SHARD_ROWS by a hash of the text. In each round every shard starts from the common state and passes its rows in an order that
    a seed draws; what it adds to z and n is then averaged by coordinate. The same rows give the same model. Without a row to learn from
    every score is 0.5.
    """
    taught = labelled(docs, labels, label, sample_rows).select(F.xxhash64("text").alias("h"), "y", F.col("text").cast("binary").alias("text"))
    taught = stored(taught, "taught")
    shards = -(-taught.count() // SHARD_ROWS)
    often = np.zeros(BIAS, np.int64)
    for data in mapped(taught.select("text").coalesce(max(1, shards)), _counted, "data binary").toArrow().column("data"):  # as many as shards
        often += np.frombuffer(pa.decompress(data.as_buffer(), decompressed_size=2 * BIAS, codec="zstd"), np.uint16)
    often = np.where(often < LEAST, 0, often)
    known = np.flatnonzero(often)
    kept = docs.sparkSession.sparkContext.broadcast(np.packbits(often > 0))
    rows = mapped(taught, lambda batches: _read(batches, kept), "h long, y int, slots array<int>").withColumn("shard", F.pmod("h", F.lit(max(1, shards))).cast("int"))
    rows = stored(mapped(rows.repartition(max(1, shards), "shard").sortWithinPartitions("shard", "h", "y"), _packed, "shard int, y binary, ends binary, slots binary"), "shards")
    state = Ftrl(np.zeros(len(known) + 1), np.zeros(len(known) + 1))
    for k in range(rounds if shards else 0):
        shared = docs.sparkSession.sparkContext.broadcast((state.z, state.n, k))
        found = mapped(rows, lambda batches, s=shared: _passed(batches, s), "shard int, data binary").toArrow().sort_by("shard")
        shared.destroy()
        dz, dn, many = np.zeros(len(state.z)), np.zeros(len(state.z)), np.zeros(len(state.z))
        for data in found.column("data"):  # a row for each shard, of which the sample's bound allows few
            own = np.frombuffer(data.as_buffer(), np.float32).reshape(2, -1)
            dz, dn, many = dz + own[0], dn + own[1], many + (own[1] > 0)
        state.z += dz / np.maximum(many, 1)
        state.n += dn / np.maximum(many, 1)
    dropped(taught), dropped(rows)
    kept.destroy()
    weights = state.weights(np.arange(len(known) + 1))
    at = np.flatnonzero(weights[:-1])
    return Model(known[at], weights[at], float(weights[-1]))


def _texts(batches):
    """The batches in parts of a bounded size, each with the features of its texts."""
    for batch in batches:
        for a, b in chunks(batch.column("text")):
            part = batch.slice(a, b - a)
            yield part, [features(t.as_py().decode("utf-8", "replace")) for t in part.column("text")]


def _counted(batches):
    """How many texts hold each slot, in 16 bits, handed on once a task."""
    table = np.zeros(BIAS, np.int64)
    for _, found in _texts(batches):
        for x in found:
            table[x] += 1
    yield pa.RecordBatch.from_arrays([pa.array([pa.compress(np.minimum(table, 65_535).astype(np.uint16).tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["data"])


def _read(batches, kept):
    """Rows with those of their features that are frequent enough, numbered among these."""
    often = np.unpackbits(kept.value)[:BIAS].astype(bool)
    number = (np.cumsum(often) - 1).astype(np.int32)
    for part, found in _texts(batches):
        yield pa.RecordBatch.from_arrays([part.column("h"), part.column("y"), pa.array([number[x[often[x]]] for x in found], pa.list_(pa.int32()))], names=["h", "y", "slots"])


def _packed(batches):
    """The rows of each shard as one row: labels, where each row's slots end, and the slots. Of equal texts of one label only the first counts."""
    held, of, last = [], None, None

    def one():
        y, sizes, slots_ = (np.concatenate(x) for x in zip(*held, strict=True))
        values = [y.astype(np.int8).tobytes(), np.cumsum(sizes).astype(np.int64).tobytes(), slots_.astype(np.int32).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), *[pa.array([v], pa.binary()) for v in values]], names=["shard", "y", "ends", "slots"])

    for batch in batches:
        for i, (shard, *row) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("shard", "h", "y")], strict=True)):
            if row == last:
                continue
            if held and shard != of:
                yield one()
                held = []
            last = row
            of, own = shard, batch.column("slots")[i].values.to_numpy()
            held.append((np.array([batch.column("y")[i].as_py()]), np.array([len(own)]), own))
    if held:
        yield one()


def _passed(batches, shared):
    """What the rows of each shard add to the common state, z and then n; the order of the rows is drawn anew in each round."""
    for batch in batches:
        for i, shard in enumerate(batch.column("shard").to_pylist()):
            y, ends, flat = (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in (("y", np.int8), ("ends", np.int64), ("slots", np.int32)))
            z, n, k = shared.value
            own, starts = Ftrl(z.copy(), n.copy()), np.concatenate([[0], ends])
            for j in np.random.default_rng((k, shard)).permutation(len(y)):
                own.learn(flat[starts[j] : starts[j + 1]], float(y[j]))
            data = np.stack((own.z - z, own.n - n)).astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([data], pa.binary())], names=["shard", "data"])


def scored(docs: DataFrame, model: Model, text: str = "text", least: float = 0.7) -> DataFrame:
    """``docs`` with score and predicted (1 from a score of ``least``), from the text alone. Columns of those names give way; all others pass,
    whatever their names. Repeated rows, null ids, null texts and those of any length are scored like any other row; an empty table gives an empty one."""
    kept = with_columns_last(docs, ["score", "predicted"])
    plain = kept.toDF(*["text" if c == text else f"c{i}" for i, c in enumerate(kept.columns)])
    columns = plain.columns
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.slots, model.weights, model.bias))

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            for a, b in chunks(batch.column("text")):
                part = batch.slice(a, b - a)
                scores = np.array([own.score(x.as_py()) for x in part.column("text")])
                new = [pa.array(scores, pa.float64()), pa.array((scores >= least).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in columns] + new, names=[*columns, "score", "predicted"])

    return mapped(plain, run, schema).toDF(*kept.columns, "score", "predicted")

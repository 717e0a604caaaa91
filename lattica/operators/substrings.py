"""Which texts hold which parts: a positional index of grams, probed with the rarest gram of each part, and verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.model import stored

#: Characters of a gram, and neighbouring grams of which a text is indexed by the least one only.
GRAM, WINDOW = 8, 16

#: Characters that are hashed at once.
PIECE = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _grams(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each stretch of ``size`` characters."""
    out = np.full(len(codes) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out * _ODD) ^ (codes[k : len(codes) - size + 1 + k] * _MIX)
        out ^= out >> np.uint64(29)
    return out


def _least(values: np.ndarray, window: int) -> np.ndarray:
    """Places of the leftmost least value of each window of ``window`` values."""
    if len(values) < window:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(values, window)
    return np.unique(views.argmin(axis=1) + np.arange(len(views)))


def _places(text: str, size: int, window: int):
    """(place, gram) of a text's index, in pieces: every gram for a window of 1, else the least of each window of grams."""
    reach = size + window - 2
    for at in range(0, max(1, len(text) - reach), PIECE):
        codes = _codes(text[at : at + PIECE + reach])
        if len(codes) > reach:
            grams = _grams(codes, size)
            least = np.arange(len(grams)) if window == 1 else _least(grams, window)
            yield at + least, grams[least]


def _indexed(rows: DataFrame, size: int, window: int) -> DataFrame:
    """(id, place, gram) of ``rows`` (id, text)."""

    def run(batches):
        for batch in batches:
            held, n = [], 0
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                for place, gram in _places(text.as_py(), size, window):
                    held.append((np.full(len(place), key), place.astype(np.int64), gram.view(np.int64)))
                    n += len(place)
                    if n > PIECE:
                        yield _rows(held)
                        held, n = [], 0
            if held:
                yield _rows(held)

    return rows.select("id", "text").mapInArrow(run, "id long, place long, gram long")


def _rows(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=["id", "place", "gram"])


def contained(longer: DataFrame, text: str, shorter: DataFrame, part: str) -> DataFrame:
    """Distinct pairs (text, part): the values of ``longer`` and those of ``shorter`` that they hold, character by character.

    A part of GRAM + WINDOW - 1 characters or more fills a window of grams, and wherever it stands the text's index has that window's least gram at the same
    place; so texts are indexed by about one gram in eight. Shorter parts are looked up among all grams of GRAM characters, and those still shorter among
    all grams of their own length. Of a part's grams the one that the texts have least often is its probe; a part with a gram that no text has is
    in none. Where a probe is found the part is compared with the text. Rows grow with the texts' lengths and with the places found, not with the number of parts or their lengths. An
    empty part is in every text; nulls are in none and hold none.
    """
    texts = longer.select(F.col(text).alias("text")).filter("text IS NOT NULL").distinct().withColumn("id", F.xxhash64("text"))
    parts = shorter.select(F.col(part).alias("part")).filter("part IS NOT NULL").distinct().withColumns({"pid": F.xxhash64("part"), "n": F.length("part")})
    texts, parts = stored(texts, "texts"), stored(parts, "parts")
    lengths = [r[0] for r in parts.filter((F.col("n") > 0) & (F.col("n") < GRAM)).select("n").distinct().collect()]  # fewer than GRAM
    kinds = [(n, 1, F.col("n") == n) for n in sorted(lengths)]
    kinds += [(GRAM, 1, (F.col("n") >= GRAM) & (F.col("n") < GRAM + WINDOW - 1)), (GRAM, WINDOW, F.col("n") >= GRAM + WINDOW - 1)]
    out = texts.select("text", F.lit("").alias("part")) if parts.filter("n = 0").head(1) else None
    for size, window, which in kinds:
        own = parts.filter(which)
        if not own.head(1):
            continue
        probes = stored(_indexed(own.select(F.col("pid").alias("id"), F.col("part").alias("text")), size, window), "grams").select(F.col("id").alias("pid"), F.col("place").alias("ahead"), "gram")
        known = probes.select("gram").distinct()
        places = stored(_indexed(texts.filter(F.length("text") >= size), size, window).join(known, "gram", "left_semi"), "places")
        often = places.groupBy("gram").agg(F.count("*").alias("often"))
        rarest = probes.join(often, "gram", "left").withColumn("often", F.coalesce("often", F.lit(0)))
        rarest = rarest.groupBy("pid").agg(F.min(F.struct("often", "ahead", "gram")).alias("p")).filter("p.often > 0").select("pid", "p.ahead", "p.gram")
        spots = places.join(rarest, "gram").filter("place >= ahead").select("id", "pid", (F.col("place") - F.col("ahead")).alias("first"))
        met = spots.join(own.select("pid", "part", "n"), "pid").join(texts, "id")
        met = met.filter(F.substr("text", (F.col("first") + 1).cast("int"), F.col("n")) == F.col("part")).select("text", "part").distinct()
        out = met if out is None else out.unionByName(met)
    if out is None:
        out = texts.filter("false").select("text", F.lit("").alias("part"))
    return out.select(F.col("text").alias(text), F.col("part").alias(part))

"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, words_of

#: Positions on a source's seeded line are first told apart by this many hexadecimal digits.
COARSE_DIGITS = 3


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """Water-filling over a table (source, source_size) with one row for each source.

    Sources in code-point order, null last, get ``weights`` in turn. ``share`` of a source is its part of
    the sum of all sizes by weight, but at most ``epochs`` times its size; what is clamped away is shared
    again by weight. Closed form: in order of cap / weight, the first k sources are clamped, where k is
    the least for which the level of the rest, (total - caps so far) / (weights left), clears no cap.

    An empty table gives an empty table; a source of size 0 gets target 0. One row a source, so the
    ordering over all sources is the size of the list of sources, never of the data.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("bigint")).withColumn("cap", F.col("source_size") * epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    line = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("fits", F.col("left") * F.col("weight") <= F.col("cap") * F.col("weight_left"))
    )
    level = F.first(F.when(F.col("fits"), F.struct("left", "weight_left")), ignorenulls=True).over(everything)
    return line.withColumn("level", level).select(
        "source",
        "source_size",
        F.least(
            F.col("cap").cast("double"),
            F.coalesce(F.col("weight") * F.col("level.left") / F.col("level.weight_left"), F.col("cap").cast("double")),
        ).alias("target"),
    )


def mix(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), epochs: int = 3, seed: int = 7) -> DataFrame:
    """How often each document of ``sized`` (doc_id, source, size, key) is taken.

    Every document is taken ``whole`` times, the whole part of target / source_size. The rest of the
    target is a fractional repetition: the source's documents lie on a line in an order drawn by the seed
    (md5 of seed and key, then size, then id), and the first words of that line are taken once more, so that
    at most one document of a source is taken in part and the source's sum is its target, rounded.

    Returns doc_id, source, key, size, source_size, target, whole, extra, taken (words). Null ids and sources
    are ids and a source like any other; repeated rows are rows of their own, and which of two equal rows
    is cut makes no difference. Documents of size 0 are taken with 0 words; an empty table gives an empty table. Other columns take no
    part. No text is shuffled. The order needs no global sort: sums by the hash's
    first digits find the one stretch of each source where the line is cut, and only that stretch
    (1/4096 of a source) is ordered. Rows meet their source's figures by source and stretch, so a large source is dealt over many tasks.
    """
    spot = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("key")))
    rows = stored(sized.select("doc_id", "source", "key", "size", spot.alias("spot")).withColumn("coarse", F.substring("spot", 1, COARSE_DIGITS)), "mix")
    stretches = rows.groupBy("source", "coarse").agg(F.sum("size").alias("stretch"))
    aims = targets(stretches.groupBy("source").agg(F.sum("stretch").alias("source_size")), weights, epochs)
    goal = F.round("target").cast("bigint")
    aims = aims.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("bigint"))
    aims = aims.withColumn("rest", goal - F.col("whole") * F.col("source_size"))
    along = Window.partitionBy("source").orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    laid = stretches.withColumn("ahead", F.coalesce(F.sum("stretch").over(along), F.lit(0))).withColumnRenamed("source", "s")
    plan = laid.join(aims, F.col("s").eqNullSafe(F.col("source"))).select("s", F.col("coarse").alias("c"), "stretch", "ahead", "source_size", "target", "whole", "rest")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("coarse") == F.col("c")))
    inside = (F.col("ahead") < F.col("rest")) & (F.col("rest") < F.col("ahead") + F.col("stretch"))
    clear = joined.filter(~inside).withColumn("extra", F.when(F.col("ahead") + F.col("stretch") <= F.col("rest"), F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("source", "coarse").orderBy("spot", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.col("ahead") + F.coalesce(F.sum("size").over(order), F.lit(0))
    cut = joined.filter(inside).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - gone)))
    out = clear.unionByName(cut)
    return out.select("doc_id", "source", "key", "size", "source_size", "target", "whole", "extra", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size (number of words, 0 for a null text) and key, by which the seed draws: the id, or for a null id the text's md5."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(text), F.lit(""))
    return docs.select("doc_id", "source", F.size(words_of(F.col(text))).cast("bigint").alias("size"), key.alias("key"))


def repeated(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), epochs: int = 3, seed: int = 7) -> DataFrame:
    """The mix as documents: each row as often as it is taken, columns unchanged, whatever their names.

    The one document of a source that is taken in part stays whole if at least half of it is taken. Rows equal in key, source and size
    are taken equally often, the most of them.
    """
    plan = mix(sized(docs), weights, epochs, seed)
    times = F.max(F.col("whole") + (2 * F.col("extra") >= F.greatest(F.col("size"), F.lit(1))).cast("bigint")).alias("times")
    plan = plan.groupBy(F.col("key").alias("k"), F.col("source").alias("s"), F.col("size").alias("n")).agg(times).filter("times > 0")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    size, key = F.size(words_of(F.col("d.text"))).cast("bigint"), F.coalesce(F.col("d.doc_id").cast("string"), F.md5("d.text"), F.lit(""))
    own = own.select("d", size.alias("size"), key.alias("key"))
    same = (F.col("key") == F.col("k")) & F.col("d.source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("n"))
    return own.join(plan, same).select("d", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).select("d.*")

"""A versioned table: each state of a row with the versions for which it holds, extended by commits and read as of any version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.model import scratch


def intervals(changes: DataFrame, key: str = "id", version: str = "version", removed: str | None = None) -> DataFrame:
    """``changes`` (a row for each new state, the last one of a key and version counting by ``place`` if there) with since and until: the state holds from
    ``since`` up to, not including, ``until`` (null: still). A removed row ends the state before it and has none of its own."""
    by = Window.partitionBy(key, version).orderBy(*[F.col(c).desc() for c in ("place",) if c in changes.columns] or [F.lit(1)])
    last = changes.withColumn("_nth", F.row_number().over(by)).filter("_nth = 1").drop("_nth", "place")
    out = last.withColumn("until", F.lead(version).over(Window.partitionBy(key).orderBy(version))).withColumnRenamed(version, "since")
    return out.filter(~F.coalesce(F.col(removed), F.lit(False))).drop(removed) if removed else out


class Versions:
    """A table of states under ``path``: ``ended`` holds those that ended, in a folder for the version that ended them; ``open`` those that hold at a version, a
    folder for each commit; ``log`` a row for each commit, written last, which makes it count. A commit that failed before that is written over by the next try.

    A commit reads the open states and the changes only, whatever the length of the history. Reading as of a version skips all folders that ended before it.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "versions")

    def log(self) -> DataFrame | None:
        """(version, note) of all commits; None before the first."""
        try:
            return self.spark.read.parquet(f"{self.path}/log").select("version", "note")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def latest(self) -> int | None:
        log = self.log()
        return None if log is None else log.agg(F.max("version")).first()[0]

    def _put(self, df: DataFrame, what: str, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{what}/at={version}")

    def _open(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/open/at={version}")

    def commit(self, changes: DataFrame, version: int, note: str = "") -> None:
        """Take ``changes`` (id, removed, and the columns of a state; one row an id) as of ``version``, which must be later than all before."""
        now = self.latest()
        if now is not None and version <= now:
            raise ValueError(f"version {version} is not after {now}")
        new = changes.filter(~F.coalesce("removed", F.lit(False))).drop("removed").withColumn("since", F.lit(version).cast("long"))
        if now is None:
            ended = new.limit(0)
        else:
            head = self._open(now)
            ended = head.join(changes.select("id"), "id", "left_semi")
            new = head.join(changes.select("id"), "id", "left_anti").unionByName(new)
        self._put(ended.withColumn("until", F.lit(version).cast("long")), "ended", version)
        self._put(new, "open", version)
        self._put(self.spark.createDataFrame([(version, note)], "version long, note string"), "log", version)

    def as_of(self, version: int) -> DataFrame:
        """The states that hold at ``version`` (those of the last commit up to it)."""
        states = self.states()
        return states.filter((F.col("since") <= version) & (F.col("until").isNull() | (F.col("until") > version))).drop("until")

    def states(self) -> DataFrame:
        """All states, with since and until (null: still), in commits that count."""
        now = self.latest()
        if now is None:
            raise ValueError("nothing was committed")
        ended = self.spark.read.parquet(f"{self.path}/ended").filter(F.col("at") <= now).drop("at")
        return ended.unionByName(self._open(now).withColumn("until", F.lit(None).cast("long")))

    def joined(self, rows: DataFrame, version: str = "version") -> DataFrame:
        """``rows`` (id, a version, and others) with the state that held for the row's id at its version; rows without one go."""
        states = self.states()
        states = states.withColumnsRenamed({"since": "_since", "until": "_until"})
        met = rows.join(states, "id").filter((F.col("_since") <= F.col(version)) & (F.col("_until").isNull() | (F.col("_until") > F.col(version))))
        return met.drop("_since", "_until")

    def rolled_back(self, version: int, to: int, note: str = "rollback") -> None:
        """Commit, as ``version``, what held at ``to``: states since then are ended, and those they replaced hold again. The history stays whole."""
        then, head = self.as_of(to).drop("since"), self._open(self.latest())
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"h.{c}")) for c in then.columns]
        every = same[0]
        for c in same[1:]:
            every = every & c
        back = then.alias("n").join(head.drop("since").alias("h"), every, "left_anti").withColumn("removed", F.lit(False))
        gone = head.join(then.select("id"), "id", "left_anti").drop("since").withColumn("removed", F.lit(True))
        self.commit(back.unionByName(gone), version, note)

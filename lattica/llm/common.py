"""What the operators share: words, row identity, shared storage, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space and its complement, in the dialect that Java and RE2 share.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

#: Text handled at once inside a Python worker, in bytes. Bounds its memory whatever a batch holds.
CHUNK_BYTES = 2 << 20

#: Rows that Spark hands to a Python worker at once, in bytes.
BATCH_BYTES = 8 << 20


_WRITTEN: dict[str, list[str]] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null and blank texts."""
    bare = F.trim(text, F.lit(BLANKS))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id's decimal text modulo ``by``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % by


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or one of our own where that is unset (local sessions)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = getattr(spark.sparkContext, "_lattica_dir", None) or tempfile.mkdtemp(prefix="lattica-")
        spark.sparkContext._lattica_dir = path
    return path


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def sweep(spark: SparkSession) -> int:
    """Remove all tables that this session's operators have written to the shared folder; how many there were. To be called once
    their results are written elsewhere: results that are still to be computed read them."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _removed(spark, path)
    return len(paths)


def _removed(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a cut of its lineage that outlives executors."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Remove what ``stored`` wrote; only for tables that no later plan reads."""
    path = getattr(df, "_lattica_path", None)
    if path:
        _removed(df.sparkSession, path)


def with_columns_last(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns whose names an operator's own output takes (compared without case)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def mapped(df: DataFrame, fn, schema: str | T.StructType) -> DataFrame:
    """mapInArrow, with batches of BATCH_BYTES where the session leaves Spark's limit (64 MB, of which each worker holds several) as it is;
    a worker's memory is given back when its task ends."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, "64MB") in ("64MB", "67108864b"):
        conf.set(name, str(BATCH_BYTES))

    def run(batches):
        yield from fn(batches)
        trimmed()

    return df.mapInArrow(run, schema)


#: What modules remember between the texts of a task, emptied at its end.
CACHES: list[dict] = []


def trimmed() -> None:
    """Empty the caches and give freed memory back to the system, where the C library can: a worker lives on after its task."""
    for cache in CACHES:
        cache.clear()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return
    finally:
        pa.default_memory_pool().release_unused()


def chunks(column: pa.Array):
    """Slices (start, stop) of a binary column of about CHUNK_BYTES each; a longer value stands alone."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(column).to_pylist()):
        n = n or 0
        if size and size + n > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(column):
        yield start, len(column)

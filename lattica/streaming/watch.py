"""A stream of file changes: a data source whose offsets are the numbers of manifests, each a scan of what there is."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Folders that a manifest's files are dealt to by a hash of their names; two manifests are compared one folder at a time.
BUCKETS = 16

#: The marker that Spark's writer leaves when a manifest is whole.
_DONE = "_SUCCESS"


def snapshot(scan: DataFrame, root: str, number: int, buckets: int = BUCKETS) -> None:
    """Write ``scan`` (file, hash) as manifest ``number`` under ``root``. A file is in one bucket of any manifest; a manifest written again replaces itself."""
    rows = scan.select("file", "hash").withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(buckets)).cast("int"))
    rows.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/manifest={number}")


def _opened(root: str):
    from pyarrow import fs

    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), root
    return fs.FileSystem.from_uri(root)


def _bucket(root: str, number: int, bucket: int) -> dict[str, str | None]:
    """File and hash of a bucket of a manifest; nothing for a manifest or a bucket that is not there."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = _opened(root)
    found = store.get_file_info(fs.FileSelector(posixpath.join(path, f"manifest={number}", f"bucket={bucket}"), allow_not_found=True))
    out: dict[str, str | None] = {}
    for x in found:
        if x.path.endswith(".parquet"):
            own = pq.read_table(store.open_input_file(x.path), columns=["file", "hash"])
            out |= zip(own.column("file").to_pylist(), own.column("hash").to_pylist(), strict=True)
    return out


class _Step(InputPartition):
    """What a task compares: a bucket of a manifest with that of the one before."""

    def __init__(self, before: int, number: int, bucket: int):
        self.before, self.number, self.bucket = before, number, bucket


class WatchReader(DataSourceStreamReader):
    def __init__(self, root: str, buckets: int, start: int):
        self.root, self.buckets, self.start = root, buckets, start

    def _numbers(self) -> list[int]:
        from pyarrow import fs

        store, path = _opened(self.root)
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        names = [x.path for x in found if posixpath.basename(x.path).startswith("manifest=")]
        done = store.get_file_info([posixpath.join(n, _DONE) for n in names])
        return sorted(int(n.rsplit("=", 1)[1]) for n, d in zip(names, done, strict=True) if d.type == fs.FileType.File)

    def initialOffset(self) -> dict:
        return {"number": self.start}

    def latestOffset(self) -> dict:
        return {"number": max([self.start, *self._numbers()])}

    def partitions(self, start: dict, end: dict) -> list[_Step]:
        numbers = [n for n in self._numbers() if n <= end["number"]]
        before = dict(zip(numbers[1:], numbers, strict=False))
        return [_Step(before.get(n, -1), n, b) for n in numbers if n > start["number"] for b in range(self.buckets)]

    def read(self, partition: _Step):
        old, new = (_bucket(self.root, n, partition.bucket) if n >= 0 else {} for n in (partition.before, partition.number))
        for file in sorted(old.keys() | new.keys()):
            if file not in old:
                yield partition.number, file, "add", new[file]
            elif file not in new:
                yield partition.number, file, "unlink", None
            elif old[file] != new[file]:
                yield partition.number, file, "change", new[file]


class WatchSource(DataSource):
    """``spark.readStream.format("file_changes").load(root)``: (number, file, event, hash) of each manifest under ``root`` against the one before it (the first one
    against nothing; or, with the option ``after``, those after a number only, so that what is there at the start is passed over). The offset is a manifest's number, so a stream that is
    started again goes on with the next one, and each change is given once. Option ``buckets``: those the manifests are written with."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return "number int, file string, event string, hash string"

    def streamReader(self, schema) -> WatchReader:
        return WatchReader(self.options["path"], int(self.options.get("buckets", BUCKETS)), int(self.options.get("after", -1)))


def watched(spark: SparkSession, root: str, **options) -> DataFrame:
    """The changes between the manifests under ``root``, as a stream."""
    spark.dataSource.register(WatchSource)
    return spark.readStream.format("file_changes").options(**{k: str(v) for k, v in options.items()}).load(root)

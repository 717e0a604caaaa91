"""A text index that is kept and extended: postings of trigrams, by which `contains` is answered from few files and verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.model import scratch

SIZE = 3


def _postings(batches):
    """(gram, ids) of texts (id, text): their distinct stretches of SIZE characters (a shorter text is its own only one), each with all its ids in the batch, so that
    few rows are shuffled. Time is linear in a text's length."""
    import pyarrow as pa

    for batch in batches:
        ids, texts = batch.column("id"), batch.column("text").to_pylist()
        met: dict[str, list[int]] = {}
        for i, t in enumerate(texts):
            for g in set(map("".join, zip(*(t[k:] for k in range(SIZE)), strict=False))) or {t}:
                met.setdefault(g, []).append(i)
        ends, at = [0], []
        for rows in met.values():
            at += rows
            ends.append(len(at))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.take(pa.array(at, pa.int32())))
        yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.string()), lists], names=["gram", "ids"])


class TextIndex:
    """Postings (gram, ids: those of one Arrow batch of texts) and the lower-case texts (id, text) under ``path``. Each batch is a run of its own, dealt to ``parts``
    folders by a hash of the gram and sorted by it, so that a search opens only the folders of its grams, and in them only the row groups that may hold these.

    An id is given once; a batch that is added again under the same name replaces itself, so a failed one can be repeated.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, parts: int = 16):
        self.spark, self.path, self.parts = spark, path or scratch(spark, "index"), parts

    def _part(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.parts)).cast("int")

    def add(self, docs: DataFrame, batch: str) -> None:
        """Index ``docs`` (id, text); null texts are left out."""
        own = docs.filter(F.col("text").isNotNull()).select("id", F.lower("text").alias("text"))
        own.write.mode("overwrite").parquet(f"{self.path}/texts/batch={batch}")
        texts = self.spark.read.schema(own.schema).parquet(f"{self.path}/texts/batch={batch}")
        schema = T.StructType([T.StructField("gram", T.StringType()), T.StructField("ids", T.ArrayType(own.schema["id"].dataType))])
        rows = texts.mapInArrow(_postings, schema).withColumn("part", self._part(F.col("gram")))
        rows.repartition("part", F.pmod(F.xxhash64("gram", "part"), F.lit(4))).sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/grams/batch={batch}")

    def postings(self) -> DataFrame:
        """(gram, ids, part, batch); a gram has a row for each batch of texts that holds it, and an id one place among its rows."""
        return self.spark.read.parquet(f"{self.path}/grams")

    def candidates(self, term: str) -> DataFrame:
        """(id) of texts that hold all grams of ``term``; of a term shorter than a gram, those with a gram that holds it, which is exact."""
        term = term.lower()
        if len(term) < SIZE:
            return self.postings().filter(F.contains(F.col("gram"), F.lit(term))).select(F.explode("ids").alias("id")).distinct()
        own = sorted({term[i : i + SIZE] for i in range(len(term) - SIZE + 1)})
        at = self.spark.createDataFrame([(g,) for g in own], "gram string").select(self._part(F.col("gram")).alias("p")).distinct()
        parts = [r[0] for r in at.collect()]  # as many as the term has grams, at most
        met = self.postings().filter(F.col("part").isin(parts) & F.col("gram").isin(own))
        return met.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(own)).select("id")

    def search(self, term: str) -> DataFrame:
        """(id) of the texts that contain ``term``, without case: the candidates, verified. An empty term is in every text."""
        texts = self.spark.read.parquet(f"{self.path}/texts")
        if not term:
            return texts.select("id")
        return texts.join(self.candidates(term), "id", "left_semi").filter(F.contains(F.col("text"), F.lit(term.lower()))).select("id")

    def scored(self, terms: list[str]) -> DataFrame:
        """(id, score): how many of ``terms`` a text contains, where it contains any."""
        hits = None
        for term in dict.fromkeys(terms):
            own = self.search(term)
            hits = own if hits is None else hits.unionByName(own)
        return hits.groupBy("id").agg(F.count("*").alias("score"))

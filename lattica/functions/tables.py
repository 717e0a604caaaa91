"""Table functions for SQL: what a text holds, as rows beside the row that it stands in."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, Row, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@udtf
class Matches:
    """``matches(TABLE(t), text => 'html', pattern => '...')``: all columns of the row but the text, place (from 1), and a column for each group of the pattern
    (its name, or g1, g2, ... ; the whole match as g0 if it has no group). A null text has no match. The rows of the table may be partitioned and ordered by the caller;
    place then goes on through a partition."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument, pattern: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not isinstance(rows.dataType, StructType):
            raise ValueError("the first argument must be a table")
        if text.value not in rows.dataType.names:
            raise ValueError(f"the table has no column {text.value}")
        out = StructType([f for f in rows.dataType.fields if f.name != text.value]).add("place", IntegerType())
        for name in _groups(re.compile(pattern.value)):
            out = out.add(name, StringType())
        return AnalyzeResult(out)

    def __init__(self):
        self.place, self.known = 0, {}

    def eval(self, rows: Row, text: str, pattern: str):
        value = rows[text]
        if value is None:
            return
        found = self.known.get(pattern) or self.known.setdefault(pattern, re.compile(pattern))
        own = tuple(v for k, v in rows.asDict(recursive=False).items() if k != text)
        for m in found.finditer(value):
            self.place += 1
            yield (*own, self.place, *(m.groups() or (m[0],)))


def _groups(pattern: re.Pattern) -> list[str]:
    names = {i: n for n, i in pattern.groupindex.items()}
    return [names.get(i, f"g{i}") for i in range(1, pattern.groups + 1)] or ["g0"]


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    spark.udtf.register("matches", Matches)

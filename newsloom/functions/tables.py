"""Table functions in Python, for SQL that wants them; the column functions of ``text`` stay the fast way."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn


class TermCounts:
    """``term_counts(TABLE(rows), key => 'doc_id', tokens => 'tokens', n => 1)``: the bag of n-grams of every key.

    The result's schema follows the table's: its key column with its own type, ``term`` and ``count``. Rows are
    partitioned by the key, so those of one key are counted together. Null arrays and null words count nothing.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, tokens: AnalyzeArgument, n: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("term_counts wants a table first")
        names = {f.name: f.dataType for f in rows.dataType.fields}
        for arg in (key, tokens):
            if arg.value not in names:
                raise ValueError(f"the table has no column {arg.value}")
        if not isinstance(names[tokens.value], T.ArrayType):
            raise ValueError(f"{tokens.value} is no array")
        schema = T.StructType([T.StructField(key.value, names[key.value]), T.StructField("term", T.StringType()), T.StructField("count", T.LongType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(f"`{key.value}`")])

    def __init__(self) -> None:
        self.key, self.counts = None, Counter()

    def eval(self, rows: T.Row, key: str, tokens: str, n: int = 1) -> None:
        self.key = rows[key]
        words = [w for w in rows[tokens] or () if w is not None]
        self.counts.update("_".join(words[i : i + n]) for i in range(len(words) - n + 1))

    def terminate(self) -> Iterator[tuple]:
        for term, count in self.counts.items():
            yield self.key, term, count


def register(spark: SparkSession) -> None:
    """``term_counts`` for the session's SQL."""
    spark.udtf.register("term_counts", udtf(TermCounts))

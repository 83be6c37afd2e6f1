"""Summaries, deduplication, calendars and cross tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.operators.lineage import cut_lineage
from newsloom.operators.vocabulary import row_index


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """``(value, n, pct)`` of non-null values; pct of all rows that have one, to one place."""
    n = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    # one row for each distinct value: the window is over groups, not rows
    return n.withColumn("pct", F.round(F.col("n") / F.sum("n").over(W.partitionBy()) * 100, 1))


def null_census(df: DataFrame) -> DataFrame:
    """``(cells)``: null cells over all columns, in one pass."""
    return df.agg(reduce(lambda a, b: a + b, (F.count_if(F.col(c).isNull()) for c in df.columns)).alias("cells"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order.

    A minimum over (order, row) combines before the shuffle, so one key with very many rows is no single task's work.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("row")
    return df.groupBy(*keys).agg(best).select(*keys, "row.*").select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("row")
    return df.groupBy(*keys).agg(best).select(*keys, "row.*").select(*df.columns)


def union_priority(newer: DataFrame, older: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, of which the newer frame's win where keys meet."""
    both = newer.withColumn("__rank", F.lit(0)).unionByName(older.withColumn("__rank", F.lit(1)), allowMissingColumns=True)
    rest = [F.col(c) for c in newer.columns if c not in keys]
    return keep_first(both, keys, [F.col("__rank"), *rest]).drop("__rank")


def calendar(df: DataFrame, day: str) -> DataFrame:
    """Every date from the first to the last of a column: ``(date)``."""
    ends = df.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))


def missing_days(df: DataFrame, day: str) -> DataFrame:
    """Dates between the first and the last without a row."""
    seen = df.select(F.col(day).alias("date")).distinct()
    return calendar(df, day).join(seen, "date", "left_anti")


def look_ahead(periods: DataFrame, begins: Column, last_used: str) -> DataFrame:
    """``periods`` with ``clean``: whether the last date that a period's values were made from lies before it begins."""
    return periods.withColumn("clean", F.col(last_used) < begins)


def crosstab(df: DataFrame, row: str, col: str, values: list[str], total: str = "Total") -> DataFrame:
    """Counts of two keys with margins; rows with a null key are left out, totals told from values by the grouping id."""
    cells = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).cube(row, col).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    named = cells.select(
        F.when(F.shiftright("g", 1) == 1, total).otherwise(F.col(row)).alias(row), F.when(F.col("g").bitwiseAND(F.lit(1)) == 1, total).otherwise(F.col(col)).alias(col), "n"
    )
    return named.groupBy(row).pivot(col, [*values, total]).agg(F.sum("n")).fillna(0)


def crosstab_shares(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts of two keys as percent of their row, to one place."""
    n = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row).pivot(col, values).count().fillna(0)
    total = reduce(lambda a, b: a + b, (F.col(f"`{v}`") for v in values))
    return n.select(row, *(F.round(F.col(f"`{v}`") / total * 100, 1).alias(v) for v in values))


def quantiles(long: DataFrame, name: str, value: str, shares: list[float]) -> DataFrame:
    """``(name, q0, q1, ..)``: exact quantiles of each name's values, between two neighbours in proportion.

    Values are numbered over range partitions, so no task holds a name's values; two places a share are looked up.
    """
    numbered = row_index(long.select(name, value).where(F.col(value).isNotNull()), [name, value])
    sizes = numbered.groupBy(name).agg(F.min("row_idx").alias("first"), F.count("*").alias("n"))  # a row a name
    placed = numbered.join(F.broadcast(sizes), name).withColumn("at", F.col("row_idx") - F.col("first"))
    at = [F.lit(p) * (F.col("n") - 1) for p in shares]
    near = reduce(lambda x, y: x | y, (F.col("at").isin(F.floor(a), F.ceil(a)) for a in at))
    ends = [(F.max(F.when(F.col("at") == F.floor(a), F.col(value))), F.max(F.when(F.col("at") == F.ceil(a), F.col(value))), F.max(a - F.floor(a))) for a in at]
    return placed.where(near).groupBy(name).agg(*((lo + (hi - lo) * part).alias(f"q{i}") for i, (lo, hi, part) in enumerate(ends)))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(name, count, mean, std, min, p25, p50, p75, max)`` of numeric columns, quartiles exact."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols))).alias("x")).select("x.*")
    long = cut_lineage(long)  # read three times
    plain = long.groupBy("name").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    parts = quantiles(long, "name", "v", [0.25, 0.5, 0.75]).toDF("name", "p25", "p50", "p75")
    return plain.join(parts, "name", "left").select("name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def melt(df: DataFrame, ids: list[str], cols: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, cols, name, value)

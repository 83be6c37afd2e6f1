"""As-of joins: the last known value of several series at each row's time, without a window over a whole key.

Facts and rows are laid in one order of key and time over range partitions. A value is carried forward inside each
partition; what reaches a partition from those before it is one row a partition, as only the key that a partition ends
with can go on in the next. So a key may have any share of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.operators.lineage import cut_lineage


def as_of(rows: DataFrame, facts: DataFrame, at: str, series: dict[str, int], key: str | None = None) -> DataFrame:
    """``rows`` with a column for each of ``series``: its last value known at ``at``, null before the first.

    ``facts`` has ``(series, at, value)`` and ``key`` where one is given; ``series`` names those wanted with the days
    after which a value is published, so one of day d is known from the midnight of day d + lag on. Of values that are
    published at once the later counts, then the larger. Null values, times and keys of facts are passed over; rows
    with a null time or key know nothing. Names of ``rows`` and of series must differ; repeated rows stay.
    """
    names = list(series)
    key_of = (lambda df: F.col(key)) if key else (lambda df: F.lit(0))
    moment = F.col(at).cast("timestamp_ntz")
    known = None
    for name, lag in series.items():
        known = F.when(F.col("series") == name, F.date_trunc("day", moment) + F.make_dt_interval(F.lit(lag))) if known is None else known.when(F.col("series") == name, F.date_trunc("day", moment) + F.make_dt_interval(F.lit(lag)))
    said = facts.where(F.col("series").isin(names) & F.col("value").isNotNull() & moment.isNotNull() & key_of(facts).isNotNull())
    left = said.select(
        key_of(facts).alias("__key"), known.cast("timestamp_ntz").alias("__at"), F.lit(0).alias("__kind"), moment.alias("__order"), F.col("value").cast("double").alias("__value"),
        *(F.when(F.col("series") == n, F.col("value").cast("double")).alias(n) for n in names),
    )
    right = rows.select(key_of(rows).alias("__key"), moment.alias("__at"), F.lit(1).alias("__kind"), F.struct(*rows.columns).alias("__row"))
    order = ["__key", "__at", "__kind", "__order", "__value"]
    both = left.unionByName(right, allowMissingColumns=True)
    dealt = cut_lineage(both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    # inside a partition; a key that fills many partitions has a window in each
    inside = W.partitionBy("__p", "__key").orderBy(*order[1:]).rowsBetween(W.unboundedPreceding, 0)
    carried = dealt.select("__p", "__key", "__at", "__kind", "__row", *(F.last(n, ignorenulls=True).over(inside).alias(n) for n in names))
    # one row a partition: the key it ends with, and the last value of each series there
    ends = dealt.groupBy("__p").agg(F.max("__key").alias("__key"))
    place = F.struct(*order[1:])
    lasts = dealt.join(F.broadcast(ends), ["__p", "__key"], "left_semi").groupBy("__p", "__key").agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), place)).alias(n) for n in names))
    # two rows a partition: what it takes for the key it begins with, and what it gives for the key it ends with
    takes = dealt.groupBy("__p").agg(F.min("__key").alias("__key")).withColumn("__gives", F.lit(0))
    table = takes.unionByName(lasts.withColumn("__gives", F.lit(1)), allowMissingColumns=True)
    before = W.partitionBy("__key").orderBy("__p", "__gives").rowsBetween(W.unboundedPreceding, -1)
    entering = table.select("__p", "__key", "__gives", *(F.last(n, ignorenulls=True).over(before).alias(f"__{n}") for n in names)).where("__gives = 0").drop("__gives")
    met = carried.where("__kind = 1").join(F.broadcast(entering), ["__p", "__key"], "left")
    knows = F.col("__at").isNotNull() & F.col("__key").isNotNull()
    return met.select("__row.*", *(F.when(knows, F.coalesce(n, f"__{n}")).alias(n) for n in names))

"""The workload's views over the given tables: news, prices, topic weights, polarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import values
from newsloom.sources.readers import table


def news(spark: SparkSession, folder: str, days: int = 1035) -> DataFrame:
    """Documents as dated news: ``(doc_id, article_id, title, content, language, symbol_query, published_at)``.

    A fixed rule spreads them over ``days`` days from 2023-01-01; 90 puts several on each day.
    """
    first = F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")
    at = F.expr(f"make_dt_interval(cast(pmod(doc_id * 7919, {days}) as int), 0, cast(pmod(doc_id * 37, 1440) as int), 0)")
    return table(spark, folder, "documents").select(
        "doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("article_id"), F.split("text", "\n", 2)[0].alias("title"), F.col("text").alias("content"),
        F.col("lang").alias("language"), F.col("source").alias("symbol_query"), (first + at).alias("published_at"),
    )


def daily_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as prices: ``(symbol, date, adjusted_close, volume)``, a row for each priority and day."""
    orders = table(spark, folder, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(
        F.round(F.avg("o_totalprice"), 4).alias("adjusted_close"), F.count("*").alias("volume")
    )


def monthly_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as one monthly price series: ``(month_end, price)``."""
    orders = table(spark, folder, "orders")
    return orders.groupBy(F.last_day(F.to_date("o_orderdate")).alias("month_end")).agg(F.round(F.avg("o_totalprice"), 4).alias("price"))


def softmax_weights(embedding: Column, k: int, first: int = 0) -> list[Column]:
    return values.softmax([F.get(embedding, F.lit(first + i)).cast("double") for i in range(k)])


def theta(spark: SparkSession, folder: str, k: int = 3, first: int = 0) -> DataFrame:
    """Topic weights of documents: ``(doc_id, topic_000..)``, the softmax of k dimensions of their vectors from ``first`` on."""
    weights = softmax_weights(F.col("embedding"), k, first)
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), *(w.alias(f"topic_{i:03d}") for i, w in enumerate(weights)))


def polarity() -> Column:
    """An event's value as a polarity in [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 100) / 100))

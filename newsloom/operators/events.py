"""The event table: session, topics, novelty, sentiment, impact and flags of dated events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.functions import values as V
from newsloom.operators.lineage import cut_lineage
from newsloom.operators.vocabulary import row_index


def novelty(topic: str, order: list[str], by: str, rows: int = 20) -> Column:
    """1 - share of the same topic among the previous ``rows`` events of a symbol; 1 for its first ``rows`` events.

    Rows of a symbol are one window partition; ``novelty_in_blocks`` is for symbols of any size.
    """
    w = W.partitionBy(by).orderBy(*order)
    past = F.collect_list(topic).over(w.rowsBetween(-rows, -1))
    same = F.size(F.filter(past, lambda t: t == F.col(topic)))
    return F.when(F.row_number().over(w) <= rows, 1.0).otherwise(1 - same / F.lit(float(rows)))


def novelty_in_blocks(df: DataFrame, topic: str, order: list[str], by: str, rows: int = 20, block: int = 100_000) -> DataFrame:
    """``df`` with ``novelty_score`` as ``novelty`` has it, in tasks of about ``block`` events, however many a symbol has.

    Events are numbered over range partitions of (symbol, order). The last ``rows`` of every block stand at the head of
    the next one as well, which is all that its own events look back on.
    """
    numbered = row_index(df, [by, *order])
    firsts = numbered.groupBy(by).agg(F.min("row_idx").alias("__first")).withColumnRenamed(by, "__by")
    placed = numbered.join(F.broadcast(firsts), F.col(by).eqNullSafe(F.col("__by")))  # a row a symbol
    placed = placed.withColumn("__at", F.col("row_idx") - F.col("__first")).withColumn("__block", F.floor(F.col("__at") / block))
    again = F.when(F.col("__at") % block >= block - rows, F.array("__block", F.col("__block") + 1)).otherwise(F.array("__block"))
    spread = placed.withColumn("__in", F.explode(again))
    past = F.collect_list(topic).over(W.partitionBy(by, "__in").orderBy("__at").rowsBetween(-rows, -1))
    same = F.size(F.filter(past, lambda t: t == F.col(topic)))
    scored = spread.withColumn("novelty_score", F.when(F.col("__at") < rows, 1.0).otherwise(1 - same / F.lit(float(rows))))
    return scored.where("__in = __block").select(*df.columns, "novelty_score")


def standardised(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation (a constant column becomes zero)."""
    facts = df.agg(*(F.avg(c).alias(f"__m_{c}") for c in cols), *(F.stddev_pop(c).alias(f"__s_{c}") for c in cols))
    z = lambda c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0)
    joined = df.crossJoin(F.broadcast(facts))  # one row of two numbers a column
    return joined.withColumns({c: z(c) for c in cols}).select(*df.columns)


def topic_strength(cols: list[str]) -> Column:
    """Mean of the absolute standardised features."""
    return sum((F.abs(F.col(c)) for c in cols[1:]), F.abs(F.col(cols[0]))) / len(cols)


def impact(intensity: Column, confidence: Column, new: Column, period: Column) -> Column:
    return intensity * 0.3 + confidence * 0.2 + new * 0.3 + (period == "trading_hours").cast("double") * 0.2


def event_table(df: DataFrame, latent: list[str], by: str = "symbol") -> DataFrame:
    """Events in the papers' format.

    ``df`` has ``event_id, ts, title, content, topic, sentiment_score``, the latent features and the symbol.
    """
    body = F.concat(F.lower(F.coalesce("title", F.lit(""))), F.lit(" "), F.lower(F.coalesce("content", F.lit(""))))
    # what is read of the texts comes first, so that they take no part in the order below
    read = df.withColumn("all_topics", X.topic_tags(body)).withColumn("word_count", X.word_count(F.coalesce("content", F.lit("")))).drop("content")
    rows = standardised(cut_lineage(read), latent)
    rows = rows.withColumn("event_date", F.to_date("ts")).withColumn("event_time", F.date_format("ts", "HH:mm:ss")).withColumn("market_period", V.market_period(F.col("ts")))
    rows = rows.withColumn("topic_strength", topic_strength(latent)).withColumn("topic_confidence", V.logistic(F.col("topic_strength")))
    rows = rows.withColumn("sentiment_intensity", F.abs("sentiment_score")).withColumn("sentiment_direction", F.signum("sentiment_score"))
    rows = rows.withColumn("sentiment_category", V.sentiment_bin(F.col("sentiment_score")))
    rows = novelty_in_blocks(rows, "topic", ["ts", "event_id"], by)
    rows = rows.withColumn("impact_score", impact(F.col("sentiment_intensity"), F.col("topic_confidence"), F.col("novelty_score"), F.col("market_period")))
    flag = lambda topic: F.col("all_topics").contains(topic).cast("int")
    day = F.weekday("ts")
    return rows.select(
        "event_id", "event_date", "event_time", "market_period", F.col("topic").alias("primary_topic"), "topic_strength", "topic_confidence", "all_topics",
        flag("earnings").alias("is_earnings_news"), flag("product").alias("is_product_news"), flag("innovation").alias("is_innovation_news"),
        flag("regulation").alias("is_regulatory_news"), flag("macro").alias("is_macro_news"),
        "sentiment_direction", "sentiment_intensity", "sentiment_category", "novelty_score", "impact_score", V.impact_bin(F.col("impact_score")).alias("impact_category"),
        F.year("ts").alias("year"), F.quarter("ts").alias("quarter"), F.month("ts").alias("month"), day.alias("day_of_week"), day.isin(5, 6).cast("int").alias("is_weekend"),
        "title", "word_count",
    )


def daily_rollup(events: DataFrame) -> DataFrame:
    """Counts and means by day and topic, to four places."""
    mean = lambda c: F.bround(F.avg(c), 4)  # noqa: E731  halves to the even digit
    return events.groupBy("event_date", "primary_topic").agg(
        F.count("event_id").alias("news_count"), mean("sentiment_direction").alias("avg_sentiment"), mean("sentiment_intensity").alias("avg_intensity"),
        mean("impact_score").alias("avg_impact"), mean("novelty_score").alias("avg_novelty"),
    )

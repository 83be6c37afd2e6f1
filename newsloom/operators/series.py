"""Return series, attention series, panels, forecasts and trading evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.operators.relational import calendar


def returns(prices: DataFrame, key: str = "symbol", at: str = "date", price: str = "adjusted_close") -> DataFrame:
    """``prices`` with ``simple_return`` and ``log_return``; null on a symbol's first row."""
    before = F.lag(price).over(W.partitionBy(key).orderBy(at))
    return prices.withColumn("simple_return", F.try_divide(F.col(price), before) - 1).withColumn("log_return", F.ln(F.try_divide(F.col(price), before)))


def monthly_returns(daily: DataFrame, key: str = "symbol", at: str = "date") -> DataFrame:
    """``(month_end, key, log_return, simple_return)``: summed and compounded; a month without returns has zero."""
    return daily.groupBy(F.last_day(at).alias("month_end"), key).agg(
        F.coalesce(F.sum("log_return"), F.lit(0.0)).alias("log_return"), F.coalesce(F.product(F.col("simple_return") + 1) - 1, F.lit(0.0)).alias("simple_return")
    )


def rolling_volatility(daily: DataFrame, rows: int = 30, key: str = "symbol", at: str = "date") -> Column:
    """Sample deviation of the last ``rows`` returns; null until there are so many."""
    w = W.partitionBy(key).orderBy(at).rowsBetween(1 - rows, 0)
    return F.when(F.count("simple_return").over(w) == rows, F.stddev_samp("simple_return").over(w))


def attention(weights: DataFrame, topics: list[str], freq: str = "D", length: str | None = None) -> DataFrame:
    """Topic weights by day or month: mean, or mean weighted by ``length``; gaps are zero rows.

    ``weights`` has ``date`` and the topic columns. Days are filled between the first and the last; months are labelled by
    their end. The aggregation is partial before its shuffle; the calendar is a row a day.
    """
    day = F.to_date("date") if freq == "D" else F.last_day(F.to_date("date"))
    mean = (lambda t: F.try_divide(F.sum(F.col(t) * F.col(length)), F.sum(length))) if length else F.avg
    grouped = weights.groupBy(day.alias("date")).agg(*(mean(t).alias(t) for t in topics), F.count("*").alias("n_documents"))
    days = calendar(weights.select(F.to_date("date").alias("date")), "date")
    if freq != "D":
        days = days.select(F.last_day("date").alias("date")).distinct()
    return days.join(grouped, "date", "left").fillna(0, [*topics, "n_documents"])


def smoothed(series: DataFrame, topics: list[str], rows: int = 3, at: str = "date") -> DataFrame:
    """Centred moving averages; null where the window is not full. ``series`` has a row a period."""
    half = rows // 2
    w = W.orderBy(at).rowsBetween(-half, half)
    full = F.count(F.lit(1)).over(w) == rows
    return series.select("*", *(F.when(full, F.avg(t).over(w)).alias(f"{t}_smoothed") for t in topics))


def series_stats(long: DataFrame, name: str = "topic", at: str = "date", value: str = "attention", spike: float = 2.0) -> DataFrame:
    """``(name, mean, std, min, max, cv, autocorr_1, n_spikes)`` of series in long form."""
    before = F.lag(value).over(W.partitionBy(name).orderBy(at))
    of = W.partitionBy(name)
    rows = long.withColumn("b", before).withColumn("limit", F.avg(value).over(of) + spike * F.stddev_samp(value).over(of))
    return rows.groupBy(name).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.try_divide(F.stddev_samp(value), F.avg(value)).alias("cv"), F.corr(value, "b").alias("autocorr_1"), F.count_if(F.col(value) > F.col("limit")).alias("n_spikes"),
    )


def spikes(long: DataFrame, name: str = "topic", value: str = "attention", least: float = 2.0) -> DataFrame:
    """Rows of a series whose z-score is above ``least``, with it."""
    of = W.partitionBy(name)
    z = F.try_divide(F.col(value) - F.avg(value).over(of), F.stddev_samp(value).over(of))
    return long.withColumn("z_score", z).where(F.col("z_score") > least)


def panel(series: DataFrame, market: DataFrame, at: str = "date") -> DataFrame:
    """Series and returns of the periods that both have; the smaller side is broadcast where Spark measures it small."""
    return series.join(market, at)


def with_target(series: DataFrame, target: str, ahead: int = 1, at: str = "date") -> DataFrame:
    """``y``: the target ``ahead`` rows later; rows without one go."""
    return series.withColumn("y", F.lead(target, ahead).over(W.orderBy(at))).where(F.col("y").isNotNull())


def with_benchmark(predictions: DataFrame, at: str = "date") -> DataFrame:
    """Predictions with their squared errors and those of the mean of all earlier actuals."""
    past = W.orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    rows = predictions.withColumn("benchmark_pred", F.avg("actual").over(past))
    return rows.withColumn("squared_error", (F.col("actual") - F.col("predicted")) ** 2).withColumn("benchmark_squared_error", (F.col("actual") - F.col("benchmark_pred")) ** 2)


def oos_r2(predictions: DataFrame) -> DataFrame:
    """``(n, model_r2, benchmark_r2, corr_squared)`` against the mean of the tested actuals."""
    rows = predictions.withColumn("spread", (F.col("actual") - F.avg("actual").over(W.partitionBy())) ** 2)
    return rows.agg(
        F.count("*").alias("n"), (1 - F.try_divide(F.sum("squared_error"), F.sum("spread"))).alias("model_r2"),
        (1 - F.try_divide(F.sum("benchmark_squared_error"), F.sum("spread"))).alias("benchmark_r2"), (F.corr("actual", "predicted") ** 2).alias("corr_squared"),
    )


def trading_curve(predictions: DataFrame, cost_bps: float = 15.0, at: str = "date", cash: Column | None = None) -> DataFrame:
    """Long when the forecast is positive: signal, trades, costs, net returns, curves and drawdown.

    Out of the market the return is that of ``cash`` (bills), or nothing.

    The first row has no trade before it: its trade, cost and net return are null and the curves skip it.
    """
    w = W.orderBy(at)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    rows = predictions.withColumn("signal", F.when(F.col("predicted") > 0, 1).otherwise(0))
    rows = rows.withColumn("strategy_return", F.col("signal") * F.col("actual") + (0 if cash is None else (1 - F.col("signal")) * cash)).withColumn("trade", F.abs(F.col("signal") - F.lag("signal").over(w)))
    rows = rows.withColumn("transaction_cost", F.col("trade") * cost_bps / 10000).withColumn("net_return", F.col("strategy_return") - F.col("transaction_cost"))
    # a product, so a total loss leaves nothing for good
    curve = lambda c: F.when(F.col(c).isNotNull(), F.product(F.col(c) + 1).over(so_far))
    rows = rows.withColumn("cum_strategy", curve("net_return")).withColumn("cum_market", curve("actual"))
    top = F.max("cum_strategy").over(so_far)
    return rows.withColumn("drawdown", F.try_divide(F.col("cum_strategy") - top, top))


def trading_metrics(curve: DataFrame, periods: int = 12) -> DataFrame:
    """One row of annual returns, volatility and Sharpe ratios, hit rate, drawdown, trades and costs."""
    year = lambda c: F.avg(c) * periods
    vol = lambda c: F.stddev_samp(c) * F.sqrt(F.lit(float(periods)))
    sharpe = lambda c: F.when(vol(c) > 0, year(c) / vol(c)).otherwise(0.0)
    hit = ((F.col("predicted") > 0) == (F.col("actual") > 0)).cast("int")
    return curve.agg(
        year("net_return").alias("strategy_annual_return"), vol("net_return").alias("strategy_annual_vol"), sharpe("net_return").alias("strategy_sharpe"),
        year("actual").alias("market_annual_return"), vol("actual").alias("market_annual_vol"), sharpe("actual").alias("market_sharpe"),
        F.avg(hit).alias("hit_rate"), F.min("drawdown").alias("max_drawdown"), F.sum("trade").alias("n_trades"), F.sum("transaction_cost").alias("total_transaction_costs"),
    )


def top_variance(long: DataFrame, k: int = 5, name: str = "topic", value: str = "attention") -> DataFrame:
    """The k series of the largest sample variance (a report: k is the feature)."""
    return long.groupBy(name).agg(F.var_samp(value).alias("variance")).orderBy(F.desc("variance"), name).limit(k)


def event_study(events: DataFrame, daily: DataFrame, before: int = 3, after: int = 3, key: str = "symbol", at: str = "date") -> DataFrame:
    """``(offset, n, mean_abnormal)``: returns around event days less the symbol's own mean, by row offset.

    Prices are numbered within their symbol; an event takes the first price on or after its day.
    """
    numbered = daily.withColumn("i", F.row_number().over(W.partitionBy(key).orderBy(at))).withColumn("abnormal", F.col("simple_return") - F.avg("simple_return").over(W.partitionBy(key)))
    # an as-of step without a join by range: events, counted by day, and prices in one order, each event taking the next price
    counted = events.groupBy(key, at).agg(F.count("*").alias("events"))
    none = F.lit(None)
    line = counted.select(key, at, F.lit(0).alias("kind"), none.cast("int").alias("i"), "events").unionByName(numbered.select(key, at, F.lit(1).alias("kind"), "i", none.cast("long").alias("events")))
    ahead = W.partitionBy(key).orderBy(at, "kind").rowsBetween(0, W.unboundedFollowing)
    placed = line.withColumn("event_i", F.first("i", ignorenulls=True).over(ahead)).where("kind = 0 and event_i is not null")
    places = placed.groupBy(key, "event_i").agg(F.sum("events").alias("events"))
    around = places.withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("i", F.col("event_i") + F.col("offset"))
    met = around.join(numbered.select(key, "i", "abnormal"), [key, "i"]).where("abnormal is not null")
    return met.groupBy("offset").agg(F.sum("events").alias("n"), (F.sum(F.col("abnormal") * F.col("events")) / F.sum("events")).alias("mean_abnormal"))

"""Prices, returns, summaries, calendars and set operations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import relational as R
from newsloom.operators import series as S
from newsloom.operators.lineage import shared_path
from newsloom.plans.registry import MONTHLY, NEWS, PRICES, RETURNS, plan
from newsloom.sources import bindings as B
from newsloom.sources import vendor
from newsloom.sources.readers import long_quotes, paging_windows, table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@plan(f"select symbol, count(*) as n from {PRICES} group by symbol")
def records_per_symbol(spark: SparkSession, folder: str) -> DataFrame:
    return B.daily_prices(spark, folder).groupBy("symbol").agg(F.count("*").alias("n"))


@plan(f"""select symbol, min(adjusted_close) as low, max(adjusted_close) as high, round(avg(adjusted_close), 4) as mean, round(avg(volume), 4) as mean_volume,
    min(date) as first_date, max(date) as last_date from {PRICES} group by symbol""")
def price_summary(spark, folder):
    p = B.daily_prices(spark, folder)
    return p.groupBy("symbol").agg(
        F.min("adjusted_close").alias("low"), F.max("adjusted_close").alias("high"), F.round(F.avg("adjusted_close"), 4).alias("mean"),
        F.round(F.avg("volume"), 4).alias("mean_volume"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


@plan(f"""select count(*) as n, count(distinct article_id) as n_articles, count(distinct symbol_query) as n_symbols, cast(min(published_at) as date) as first_day,
    cast(max(published_at) as date) as last_day, count(*) filter (content is not null) as n_content, count(*) filter (coalesce(content, '') <> '') as n_filled from {NEWS}""")
def corpus_summary(spark, folder):
    return B.news(spark, folder).agg(
        F.count("*").alias("n"), F.countDistinct("article_id").alias("n_articles"), F.countDistinct("symbol_query").alias("n_symbols"),
        F.to_date(F.min("published_at")).alias("first_day"), F.to_date(F.max("published_at")).alias("last_day"), F.count("content").alias("n_content"),
        F.count_if(F.coalesce("content", F.lit("")) != "").alias("n_filled"),
    )


@plan(f"select year(published_at) as year, count(*) as n from {NEWS} group by 1")
def records_per_year(spark, folder):
    return B.news(spark, folder).groupBy(F.year("published_at").cast("long").alias("year")).agg(F.count("*").alias("n"))


@plan("select event_type as value, count(*) as n, round(count(*) / sum(count(*)) over () * 100, 1) as pct from events where event_type is not null group by event_type")
def value_counts_pct(spark, folder):
    return R.value_counts(table(spark, folder, "events"), "event_type")


@plan(f"select count(*) filter (simple_return is null) + count(*) filter (log_return is null) + count(*) filter (adjusted_close is null) as cells from {RETURNS}")
def null_census(spark, folder):
    return R.null_census(S.returns(B.daily_prices(spark, folder)))


@plan("select md5(text) as text_md5, count(*) as n from documents group by text having count(*) > 1")
def duplicate_keys(spark, folder):
    docs = table(spark, folder, "documents").select(F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return R.duplicate_keys(docs, ["text_md5"])


@plan(f"select text_md5, arg_min(doc_id, (published_at, doc_id)) as doc_id, min(published_at) as published_at from (select *, md5(content) as text_md5 from {NEWS}) group by 1")
def dedupe_keep_first(spark, folder):
    docs = B.news(spark, folder).select("doc_id", "published_at", F.md5(F.col("content").cast("binary")).alias("text_md5"))
    return R.keep_first(docs, ["text_md5"], [F.col("published_at"), F.col("doc_id")])


@plan(f"select symbol_query, arg_max(doc_id, (published_at, doc_id)) as doc_id, max(published_at) as published_at from {NEWS} group by 1")
def dedupe_keep_last(spark, folder):
    docs = B.news(spark, folder).select("doc_id", "published_at", "symbol_query")
    return R.keep_last(docs, ["symbol_query"], [F.col("published_at"), F.col("doc_id")])


@plan(f"""with newer as (select symbol, date, adjusted_close + 1000 as adjusted_close from {PRICES} where date >= date '1998-01-01'),
    older as (select symbol, date, adjusted_close from {PRICES})
    select * from newer union all select * from older where (symbol, date) not in (select (symbol, date) from newer)""")
def union_priority_dedupe(spark, folder):
    older = B.daily_prices(spark, folder).select("symbol", "date", "adjusted_close")
    newer = older.where(F.col("date") >= F.lit("1998-01-01").cast("date")).withColumn("adjusted_close", F.col("adjusted_close") + 1000)
    return R.union_priority(newer, older, ["symbol", "date"])


@plan(f"select symbol, date, round(simple_return, 8) as simple_return, round(log_return, 8) as log_return from {RETURNS}")
def daily_returns(spark, folder):
    r = S.returns(B.daily_prices(spark, folder))
    return r.select("symbol", "date", F.round("simple_return", 8).alias("simple_return"), F.round("log_return", 8).alias("log_return"))


@plan(f"""select last_day(date) as month_end, symbol, round(coalesce(sum(log_return), 0), 8) as log_return, round(coalesce(product(1 + simple_return) - 1, 0), 8) as simple_return
    from {RETURNS} group by 1, 2""")
def monthly_returns(spark, folder):
    m = S.monthly_returns(S.returns(B.daily_prices(spark, folder)))
    return m.select("month_end", "symbol", F.round("log_return", 8).alias("log_return"), F.round("simple_return", 8).alias("simple_return"))


@plan(f"""select symbol, date, round(case when count(simple_return) over w = 30 then stddev_samp(simple_return) over w end, 6) as volatility from {RETURNS}
    window w as (partition by symbol order by date rows between 29 preceding and current row)""")
def rolling_volatility_30(spark, folder):
    r = S.returns(B.daily_prices(spark, folder))
    return r.select("symbol", "date", F.round(S.rolling_volatility(r), 6).alias("volatility"))


@plan("select cast(ts as date) as day, " + ", ".join(f"count(*) filter (event_type = '{t}') as {t}" for t in EVENT_TYPES) + " from events group by 1")
def pivot_daily_counts(spark, folder):
    return table(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).pivot("event_type", EVENT_TYPES).count().fillna(0)


@plan(f"""select cast(d as date) as date from (select unnest(range(a, b + interval 1 day, interval 1 day)) as d
    from (select cast(min(published_at) as date) as a, cast(max(published_at) as date) as b from {NEWS})) where cast(d as date) not in (select cast(published_at as date) from {NEWS})""")
def coverage_gaps(spark, folder):
    return R.missing_days(B.news(spark, folder).select(F.to_date("published_at").alias("day")), "day")


@plan(f"select cast(published_at as date) as date, count(*) as n from {NEWS} group by 1")
def coverage_counts(spark, folder):
    return B.news(spark, folder).groupBy(F.to_date("published_at").alias("date")).agg(F.count("*").alias("n"))


@plan(f"""select cast(d as date) as window_from, least(cast(d as date) + 30, b) as window_to from (select unnest(range(a, b + interval 1 day, interval 31 day)) as d, b
    from (select cast(min(published_at) as date) as a, cast(max(published_at) as date) as b from {NEWS}))""")
def paging(spark, folder):
    ends = B.news(spark, folder).agg(F.to_date(F.min("published_at")).alias("a"), F.to_date(F.max("published_at")).alias("b"))
    return paging_windows(ends, F.col("a"), F.col("b"))


@plan(f"select date, symbol as ticker, adjusted_close as adj_close from {PRICES}")
def long_from_wide_quotes(spark, folder):
    wide = B.daily_prices(spark, folder).groupBy("date").pivot("symbol", PRIORITIES).agg(F.first("adjusted_close"))
    return long_quotes(wide.toDF("date", *(f"adj_close_{p}" for p in PRIORITIES)), PRIORITIES)


@plan(f"select symbol, date, adjusted_close from {PRICES} where symbol in ('1-URGENT', '5-LOW') and date between date '1997-01-01' and date '1998-12-31'")
def filter_symbols_and_dates(spark, folder):
    p = B.daily_prices(spark, folder)
    return p.where(F.col("symbol").isin("1-URGENT", "5-LOW") & F.col("date").between("1997-01-01", "1998-12-31")).select("symbol", "date", "adjusted_close")


@plan(f"select symbol, date, adjusted_close from {PRICES} order by date desc, adjusted_close desc, symbol limit 10")
def latest_prices(spark, folder):
    return B.daily_prices(spark, folder).select("symbol", "date", "adjusted_close").orderBy(F.desc("date"), F.desc("adjusted_close"), "symbol").limit(10)


@plan(f"""with r as {RETURNS}, n as (select *, row_number() over (partition by symbol order by date) as i, simple_return - avg(simple_return) over (partition by symbol) as abnormal,
      coalesce(lag(date) over (partition by symbol order by date), date '0001-01-01') as prev from r),
    e as (select o_orderpriority as symbol, cast(o_orderdate as date) as date from orders where o_orderstatus = 'P'),
    places as (select n.symbol, n.i as event_i, count(*) as events from e join n on e.symbol = n.symbol and e.date > n.prev and e.date <= n.date group by all),
    around as (select *, unnest(range(-3, 4)) as k from places)
    select cast(k as integer) as "offset", cast(sum(events) as bigint) as n, round(sum(abnormal * events) / sum(events), 6) as mean_abnormal
    from around join n on around.symbol = n.symbol and around.event_i + k = n.i where abnormal is not null group by k""")
def event_study(spark, folder):
    daily = S.returns(B.daily_prices(spark, folder))
    orders = table(spark, folder, "orders").where("o_orderstatus = 'P'")
    events = orders.select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date"))
    return S.event_study(events, daily).withColumn("mean_abnormal", F.round("mean_abnormal", 6))


RETURN_SERIES = f"(select month_end as date, price / lag(price) over (order by month_end) - 1 as r from {MONTHLY})"
PREDICTIONS = f"(select * from (select date, r as actual, lag(r) over (order by date) as predicted from {RETURN_SERIES}) where predicted is not null)"


def predictions(spark, folder) -> DataFrame:
    """A forecast that needs no fit: last month's return."""
    from pyspark.sql import Window as W

    w = W.orderBy("date")  # a row a month
    m = B.monthly_prices(spark, folder).withColumnRenamed("month_end", "date")
    r = m.select("date", (F.col("price") / F.lag("price").over(w) - 1).alias("actual"))
    return r.withColumn("predicted", F.lag("actual").over(w)).where("predicted is not null")


@plan(f"""select date, round(r, 8) as x, round(lead(r) over (order by date), 8) as y from {RETURN_SERIES} qualify lead(r) over (order by date) is not null""")
def lead_target(spark, folder):
    from pyspark.sql import Window as W

    m = B.monthly_prices(spark, folder).withColumnRenamed("month_end", "date")
    r = m.select("date", (F.col("price") / F.lag("price").over(W.orderBy("date")) - 1).alias("x"))
    return S.with_target(r, "x").select("date", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"))


BENCH = f"""(select *, pow(actual - predicted, 2) as se, pow(actual - b, 2) as be, pow(actual - avg(actual) over (), 2) as spread
    from (select *, avg(actual) over (order by date rows between unbounded preceding and 1 preceding) as b from {PREDICTIONS}))"""


@plan(f"""select count(*) as n, round(1 - sum(se) / sum(spread), 6) as model_r2, round(1 - sum(be) / sum(spread), 6) as benchmark_r2,
    round(pow(corr(actual, predicted), 2), 6) as corr_squared from {BENCH}""")
def oos_r2(spark, folder):
    out = S.oos_r2(S.with_benchmark(predictions(spark, folder)))
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("model_r2", "benchmark_r2", "corr_squared")))


CURVE = f"""(select *, (cum_strategy - max(cum_strategy) over (order by date)) / max(cum_strategy) over (order by date) as drawdown from
    (select *, case when net_return is not null then exp(sum(ln(1 + net_return)) over (order by date)) end as cum_strategy, exp(sum(ln(1 + actual)) over (order by date)) as cum_market from
    (select *, trade * 15.0e0 / 10000 as transaction_cost, signal * actual - trade * 15.0e0 / 10000 as net_return from
    (select *, abs(signal - lag(signal) over (order by date)) as trade from (select *, case when predicted > 0 then 1 else 0 end as signal from {PREDICTIONS})))))"""


@plan(f"""select date, cast(signal as integer) as signal, cast(trade as integer) as trade, round(net_return, 8) as net_return, round(cum_strategy, 8) as cum_strategy,
    round(cum_market, 8) as cum_market, round(drawdown, 8) as drawdown from {CURVE}""")
def trading_curve(spark, folder):
    c = S.trading_curve(predictions(spark, folder))
    return c.select("date", "signal", "trade", *(F.round(x, 8).alias(x) for x in ("net_return", "cum_strategy", "cum_market", "drawdown")))


_BILLS = "0.02e0 / 12 + 0.0001e0 * month(date)"


@plan(f"""select date, round(net_return, 8) as net_return, round(exp(sum(ln(1 + net_return)) over (order by date)), 8) as cum_strategy from
    (select date, signal * actual + (1 - signal) * ({_BILLS}) - abs(signal - lag(signal) over (order by date)) * 15.0e0 / 10000 as net_return from
    (select *, case when predicted > 0 then 1 else 0 end as signal from {PREDICTIONS})) where net_return is not null""")
def trading_curve_bills(spark, folder):
    """The strategy with bills while out of the market (a stated rate by month stands in for the series)."""
    bills = F.lit(0.02) / 12 + 0.0001 * F.month("date")
    c = S.trading_curve(predictions(spark, folder), cash=bills).where("net_return is not null")
    return c.select("date", F.round("net_return", 8).alias("net_return"), F.round("cum_strategy", 8).alias("cum_strategy"))


@plan(f"""select round(avg(net_return) * 12, 6) as strategy_annual_return, round(stddev_samp(net_return) * sqrt(12), 6) as strategy_annual_vol,
    round(avg(net_return) * 12 / (stddev_samp(net_return) * sqrt(12)), 6) as strategy_sharpe, round(avg(actual) * 12, 6) as market_annual_return,
    round(stddev_samp(actual) * sqrt(12), 6) as market_annual_vol, round(avg(actual) * 12 / (stddev_samp(actual) * sqrt(12)), 6) as market_sharpe,
    round(avg(case when (predicted > 0) = (actual > 0) then 1 else 0 end), 6) as hit_rate, round(min(drawdown), 6) as max_drawdown,
    cast(sum(trade) as bigint) as n_trades, round(sum(transaction_cost), 6) as total_transaction_costs from {CURVE}""")
def trading_metrics(spark, folder):
    m = S.trading_metrics(S.trading_curve(predictions(spark, folder)))
    return m.select(*(c if c == "n_trades" else F.round(c, 6).alias(c) for c in m.columns))


#: The first and last day of the news view, and of the prices.
_NEWS_DAYS, _PRICE_DAYS = (date(2023, 1, 1), date(2025, 10, 31)), (date(1995, 1, 1), date(2001, 12, 31))


def answered(spark, rows, days):
    """``rows`` written as vendor answers and opened again through the source."""
    path = shared_path(spark, "answers")
    vendor.write_answers(rows, path, days[0])
    vendor.register(spark)
    reader = spark.read.format("vendor_answers").schema(rows.schema).option("from", days[0].isoformat()).option("to", days[1].isoformat())
    return reader.load(path)


@plan(f"select cast(published_at as date) as day, symbol_query as symbol, doc_id, md5(content) as content_md5 from {NEWS} where cast(published_at as date) >= date '2024-02-10' and cast(published_at as date) < date '2025-03-01'")
def news_answers(spark, folder):
    """News of a period from vendor answers: windows outside it are never opened."""
    news = B.news(spark, folder).select(F.to_date("published_at").alias("day"), F.col("symbol_query").alias("symbol"), "doc_id", "content")
    rows = answered(spark, news, _NEWS_DAYS).where((F.col("day") >= date(2024, 2, 10)) & (F.col("day") < date(2025, 3, 1)))
    return rows.select("day", "symbol", "doc_id", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@plan(f"select date as day, symbol, adjusted_close, volume from {PRICES}")
def price_answers(spark, folder):
    """All prices from vendor answers."""
    prices = B.daily_prices(spark, folder).select(F.col("date").alias("day"), "symbol", "adjusted_close", "volume")
    return answered(spark, prices, _PRICE_DAYS)

"""Flags, names, parts, audits and panels beside the main plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import lexicon as L
from newsloom.functions import text as X
from newsloom.functions import values as V
from newsloom.operators import asof as J
from newsloom.operators import relational as R
from newsloom.plans.attention import K, LONG, MONTHLY, TOPICS, WEIGHTS, monthly, monthly_long
from newsloom.plans.corpus import CLEAN, cleaned
from newsloom.plans.registry import NEWS, plan
from newsloom.sources import bindings as B
from newsloom.sources.readers import table

_GUIDED = list(L.GUIDED_TOPICS)


@plan("select vec_id as doc_id, " + ", ".join(f"cast(label = {i} as integer) as is_{t}" for i, t in enumerate(_GUIDED)) + " from embeddings")
def topic_flags(spark, folder):
    """0/1 columns of a document's topic."""
    e = table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), *((F.col("label") == i).cast("int").alias(f"is_{t}") for i, t in enumerate(_GUIDED)))


@plan("select vec_id as doc_id, " + ", ".join(f"round(cast(embedding[{i + 1}] as double), 6) as latent_feature_{i}" for i in range(8)) + " from embeddings")
def array_to_columns(spark, folder):
    e = table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), *(F.round(F.get("embedding", F.lit(i)).cast("double"), 6).alias(f"latent_feature_{i}") for i in range(8)))


@plan("""select event_type, upper(event_type[1]) || event_type[2:] as shown, count(*) as n from events group by all""")
def display_names(spark, folder):
    return table(spark, folder, "events").groupBy("event_type", X.display_name(F.col("event_type")).alias("shown")).agg(F.count("*").alias("n"))


@plan(f"""select doc_id, cast(year(published_at) as integer) as year, cast(quarter(published_at) as integer) as quarter, cast(month(published_at) as integer) as month,
    cast(isodow(published_at) - 1 as integer) as day_of_week, cast(published_at as date) as date, strftime(published_at, '%H:%M:%S') as time, last_day(published_at) as month_end from {NEWS}""")
def date_parts(spark, folder):
    at = F.col("published_at")
    return B.news(spark, folder).select(
        "doc_id", F.year(at).alias("year"), F.quarter(at).alias("quarter"), F.month(at).alias("month"), F.weekday(at).alias("day_of_week"),
        F.to_date(at).alias("date"), F.date_format(at, "HH:mm:ss").alias("time"), F.last_day(F.to_date(at)).alias("month_end"),
    )


# the second Sunday of March and the first of November, at two o'clock of the exchange's winter and summer time
_SUNDAY = "m + to_days(cast((7 - isodow(m)) % 7 as integer))"
_SUMMER = f"""published_at >= (select {_SUNDAY} + interval 7 day + interval 7 hour from (select make_timestamp(year(published_at), 3, 1, 0, 0, 0) as m))
    and published_at < (select {_SUNDAY} + interval 6 hour from (select make_timestamp(year(published_at), 11, 1, 0, 0, 0) as m))"""


@plan(f"select doc_id, cast(published_at - (case when {_SUMMER} then interval 4 hour else interval 5 hour end) as date) as exchange_date from {NEWS}")
def exchange_dates(spark, folder):
    """Dates at the exchange, with daylight saving."""
    return B.news(spark, folder).select("doc_id", V.exchange_date(F.col("published_at").cast("timestamp")).alias("exchange_date"))


@plan(f"select doc_id, round(exp(p - m) / s, 6) as sent_pos, round(exp(n - m) / s, 6) as sent_neg, round((exp(p - m) - exp(n - m)) / s, 6) as sentiment from (select *, exp(p - m) + exp(n - m) as s from (select *, greatest(p, n) as m from (select vec_id as doc_id, cast(embedding[1] as double) as p, cast(embedding[2] as double) as n from embeddings)))")
def sentiment_index(spark, folder):
    """Probabilities from two scores, and their difference."""
    e = table(spark, folder, "embeddings")
    pos, neg = V.softmax([F.get("embedding", F.lit(i)).cast("double") for i in range(2)])
    return e.select(F.col("vec_id").alias("doc_id"), F.round(pos, 6).alias("sent_pos"), F.round(neg, 6).alias("sent_neg"), F.round(pos - neg, 6).alias("sentiment"))


_PAIRS = [(a, b) for i, a in enumerate(TOPICS) for b in TOPICS[i + 1 :]]


@plan(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r, abs(corr({a}, {b})) > 0.9 as flagged from {MONTHLY}" for a, b in _PAIRS))
def correlated_topics(spark, folder):
    """Correlations of topic series, flagged above 0.9 in size; one aggregation for all pairs."""
    facts = monthly(spark, folder).agg(*(F.corr(a, b).alias(f"{a}~{b}") for a, b in _PAIRS))
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}~{b}`").alias("r")) for a, b in _PAIRS))
    return facts.select(F.explode(pairs).alias("p")).select("p.a", "p.b", F.round("p.r", 6).alias("r"), (F.abs("p.r") > 0.9).alias("flagged"))


@plan(f"select topic, var_samp(attention) < 1e-8 as dropped from {LONG} group by topic")
def near_zero_variance(spark, folder):
    return monthly_long(spark, folder).groupBy("topic").agg((F.var_samp("attention") < 1e-8).alias("dropped"))


@plan(f"""with y as (select doc_id, cast(year(published_at) as integer) as year, published_at from {NEWS}), first as (select min(year) as year from y)
    select a.year as period, count(*) as n_used, max(cast(b.published_at as date)) as last_used, max(cast(b.published_at as date)) < make_date(a.year, 1, 1) as clean
    from (select distinct year from y) a join y b on b.year < a.year or (b.year = a.year and a.year = (select year from first)) group by a.year""")
def look_ahead_audit(spark, folder):
    """What the weights of each year's documents are made from (see ``tfidf_past_years``), and whether all of it is older.

    The first year has nothing older and uses itself: the audit finds that, as it must.
    """
    dated = B.news(spark, folder).select(F.year("published_at").alias("year"), F.to_date("published_at").alias("used"))
    years = dated.groupBy("year").agg(F.count("*").alias("n"), F.max("used").alias("last"))  # a row a year
    first = years.agg(F.min("year").alias("first"))
    later = years.select(F.col("year").alias("period")).crossJoin(F.broadcast(first))  # one row beside each
    uses = later.join(years, (F.col("year") < F.col("period")) | ((F.col("year") == F.col("period")) & (F.col("period") == F.col("first"))))
    totals = uses.groupBy("period").agg(F.sum("n").alias("n_used"), F.max("last").alias("last_used"))
    return R.look_ahead(totals, F.make_date("period", F.lit(1), F.lit(1)), "last_used")


@plan(f"select symbol_query as symbol, last_day(published_at) as month_end, {', '.join(f'round(avg(t.{t}), 6) as {t}' for t in TOPICS)}, count(*) as n from {NEWS} n join (select * from {WEIGHTS}) t on t.doc_id = n.doc_id group by 1, 2")
def firm_panel(spark, folder):
    """Topic weights by symbol and month."""
    news = B.news(spark, folder).select("doc_id", F.col("symbol_query").alias("symbol"), F.last_day(F.to_date("published_at")).alias("month_end"))
    rows = B.theta(spark, folder, K).join(news, "doc_id")
    return rows.groupBy("symbol", "month_end").agg(*(F.round(F.avg(t), 6).alias(t) for t in TOPICS), F.count("*").alias("n"))


@plan(f"""select 'no_title' as issue, count(*) as n from {NEWS} where title is null or title = '' union all select 'empty_clean', count(*) from {CLEAN} where clean = ''
    union all select 'copies', count(*) - count(distinct text) from documents""")
def quality_report(spark, folder):
    """Counts behind the data report."""
    news = B.news(spark, folder)
    counts = [
        news.where("title is null or title = ''").agg(F.lit("no_title").alias("issue"), F.count("*").alias("n")),
        cleaned(spark, folder).where("clean = ''").agg(F.lit("empty_clean").alias("issue"), F.count("*").alias("n")),
        table(spark, folder, "documents").agg(F.lit("copies").alias("issue"), (F.count("*") - F.count_distinct("text")).alias("n")),
    ]
    from newsloom.sources.readers import union_all

    return union_all(counts)


@plan("select vec_id as a, round(list_sum(list_transform(range(1, 65), lambda i: cast(e.embedding[i] as double) * f.embedding[i])) / (sqrt(list_sum(list_transform(e.embedding, lambda x: cast(x as double) * x))) * sqrt(list_sum(list_transform(f.embedding, lambda x: cast(x as double) * x)))), 6) as cosine from embeddings e, (select embedding from embeddings order by vec_id limit 1) f")
def cosine_to_first(spark, folder):
    """Cosine of every vector to a stated one."""
    e = table(spark, folder, "embeddings")
    first = F.broadcast(e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("f")))  # one row
    return e.crossJoin(first).select(F.col("vec_id").alias("a"), F.round(V.cosine(F.col("embedding"), F.col("f")), 6).alias("cosine"))


@plan("select lang, source, count(*) as n from documents group by grouping sets ((lang, source), (lang), ())")
def cube_counts(spark, folder):
    """Counts by language and source with sub-totals."""
    return table(spark, folder, "documents").rollup("lang", "source").agg(F.count("*").alias("n"))


@plan("select distinct lang from documents union select distinct lower(event_type) from events")
def set_union(spark, folder):
    a, b = table(spark, folder, "documents").select("lang"), table(spark, folder, "events").select(F.lower("event_type").alias("lang"))
    return a.union(b).distinct()


@plan(f"select symbol, month_end from (select o_orderpriority as symbol, last_day(cast(o_orderdate as date)) as month_end from orders except select o_orderpriority, last_day(cast(o_orderdate as date)) from orders where o_orderstatus = 'F')")
def set_difference(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("symbol"), F.last_day(F.to_date("o_orderdate")).alias("month_end"), "o_orderstatus")
    return o.select("symbol", "month_end").subtract(o.where("o_orderstatus = 'F'").select("symbol", "month_end"))


@plan(f"select date, topic as variable, round(attention, 6) as value from {LONG}")
def melted_series(spark, folder):
    """The wide series as rows, smoothed columns left out."""
    return R.melt(monthly(spark, folder).select("date", *TOPICS), ["date"], TOPICS).withColumn("value", F.round("value", 6))


@plan(f"select doc_id, strptime(strftime(published_at, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') as published_at, cast(published_at as date) as day from {NEWS}")
def parsed_dates(spark, folder):
    """Dates as vendors write them, of two kinds, read back."""
    at = F.col("published_at")
    said = F.when(F.col("doc_id") % 2 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    day = V.parsed_time(F.date_format(at, "yyyy-MM-dd")).cast("date")
    return B.news(spark, folder).select("doc_id", V.parsed_time(said).cast("timestamp_ntz").alias("published_at"), day.alias("day"))


@plan("select event_id, coalesce(json_extract_string(props, '$.k'), '0') as k, 'vendor' as source from events")
def merged_fields(spark, folder):
    """Defaults, overridden by what a record says."""
    said = F.from_json("props", "map<string,string>")
    fields = V.merged(F.create_map(F.lit("k"), F.lit("0"), F.lit("source"), F.lit("vendor")), F.coalesce(said, F.create_map().cast("map<string,string>")))
    rows = table(spark, folder, "events").select("event_id", fields.alias("f"))
    return rows.select("event_id", F.try_element_at("f", F.lit("k")).alias("k"), F.try_element_at("f", F.lit("source")).alias("source"))


#: Days after which each series is published.
_LAGS = {"month_price": 10, "quarter_discount": 30, "day_orders": 1}
_FACTS = """(select 'month_price' as series, last_day(cast(o_orderdate as date)) as moment, round(avg(o_totalprice), 4) as value from orders group by 2
    union all select 'quarter_discount', cast(date_trunc('quarter', l_shipdate) + interval 3 month - interval 1 day as date), round(avg(l_discount), 6) from lineitem group by 2
    union all select 'day_orders', cast(o_orderdate as date), count(*) from orders group by 2)"""


def macro_facts(spark, folder):
    """Series of three frequencies in long form, dated by their period's end: ``(series, at, value)``."""
    orders, items = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    day = F.to_date("o_orderdate")
    quarter = F.date_sub(F.add_months(F.date_trunc("quarter", "l_shipdate"), 3), 1)
    month = orders.groupBy(F.last_day(day).alias("at")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    quarters = items.groupBy(quarter.alias("at")).agg(F.round(F.avg("l_discount"), 6).alias("value"))
    days = orders.groupBy(day.alias("at")).agg(F.count("*").cast("double").alias("value"))
    named = [df.select(F.lit(name).alias("series"), "at", "value") for name, df in zip(_LAGS, (month, quarters, days))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def _known_sql(rows: str, columns: str) -> str:
    joins = " ".join(
        f"asof left join (select moment + interval {lag} day as known, arg_max(value, moment) as {name} from {_FACTS} where series = '{name}' group by 1) {name[0]} on r.moment >= {name[0]}.known" for name, lag in _LAGS.items()
    )
    return f"select {columns}, {', '.join(f'round({name}, 6) as {name}' for name in _LAGS)} from {rows} r {joins}"


@plan(_known_sql("(select distinct last_day(cast(o_orderdate as date)) as moment from orders)", "r.moment as month_end"))
def macro_panel(spark, folder):
    """Every month's end with each series' last published value."""
    ends = B.monthly_prices(spark, folder).select("month_end")
    rows = J.as_of(ends.withColumnRenamed("month_end", "at"), macro_facts(spark, folder), "at", _LAGS)
    return rows.select(F.col("at").alias("month_end"), *(F.round(n, 6).alias(n) for n in _LAGS))


@plan(_known_sql("(select o_orderkey, o_orderdate as moment from orders)", "o_orderkey"))
def orders_as_of(spark, folder):
    """Every order with what was known when it came."""
    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").alias("at"))
    return J.as_of(rows, macro_facts(spark, folder), "at", _LAGS).select("o_orderkey", *(F.round(n, 6).alias(n) for n in _LAGS))


@plan("""select l_orderkey, l_linenumber, round(price, 6) as price from lineitem join orders on l_orderkey = o_orderkey
    asof left join (select o_orderpriority as p, cast(o_orderdate as date) + interval 2 day as known, round(avg(o_totalprice), 4) as price from orders group by all) d on o_orderpriority = d.p and l_shipdate >= d.known""")
def items_as_of(spark, folder):
    """Every item with the last price published for its order's priority when it was shipped; five keys hold all rows."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("symbol"))
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("at")).join(orders, "l_orderkey")
    facts = B.daily_prices(spark, folder).select("symbol", F.lit("price").alias("series"), F.col("date").alias("at"), F.col("adjusted_close").alias("value"))
    return J.as_of(items, facts, "at", {"price": 2}, "symbol").select("l_orderkey", "l_linenumber", F.round("price", 6).alias("price"))

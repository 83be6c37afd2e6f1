"""Attention series of topics, their statistics, spikes and panels."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.operators import relational as R
from newsloom.operators import series as S
from newsloom.plans.registry import MONTHLY as PRICE_MONTHS
from newsloom.plans.registry import NEWS, plan, theta_sql
from newsloom.sources import bindings as B
from newsloom.sources.readers import columns_like, table, union_all

K = 5
TOPICS = [f"topic_{i:03d}" for i in range(K)]
WEIGHTS = f"(select t.*, n.published_at as date, length(n.content) as doc_length from {theta_sql(K)} t join {NEWS} n on t.doc_id = n.doc_id)"


def _means(weighted: bool) -> str:
    return ", ".join(f"sum({t} * doc_length) / sum(doc_length) as {t}" if weighted else f"avg({t}) as {t}" for t in TOPICS)


_DAYS = f"(select cast(unnest(range(a, b + interval 1 day, interval 1 day)) as date) as date from (select cast(min(date) as date) as a, cast(max(date) as date) as b from {WEIGHTS}))"
DAILY = f"""(select d.date, {", ".join(f"coalesce({t}, 0) as {t}" for t in TOPICS)}, coalesce(n_documents, 0) as n_documents from {_DAYS} d
    left join (select cast(date as date) as date, {_means(False)}, count(*) as n_documents from {WEIGHTS} group by 1) g on d.date = g.date)"""
MONTHLY = f"""(select d.date, {", ".join(f"coalesce({t}, 0) as {t}" for t in TOPICS)}, coalesce(n_documents, 0) as n_documents from (select distinct last_day(date) as date from {_DAYS}) d
    left join (select last_day(date) as date, {_means(True)}, count(*) as n_documents from {WEIGHTS} group by 1) g on d.date = g.date)"""
LONG = f"(unpivot {MONTHLY} on {', '.join(TOPICS)} into name topic value attention)"


def weights(spark, folder, k=K, first=0):
    """Topic weights from the documents' vectors, dated."""
    return dated(spark, folder, B.theta(spark, folder, k, first))


def dated(spark, folder, theta):
    """Topic weights with their documents' date (an inner join on the id) and length (a left join: null where unknown)."""
    dates = B.news(spark, folder).select("doc_id", F.col("published_at").alias("date"))
    lengths = table(spark, folder, "documents").where("text is not null").select("doc_id", F.length("text").alias("doc_length"))
    return theta.join(dates, "doc_id").join(lengths, "doc_id", "left")


def monthly(spark, folder):
    return S.attention(weights(spark, folder), TOPICS, "M", "doc_length")


def monthly_long(spark, folder):
    m = monthly(spark, folder)
    return R.melt(m.select("date", *columns_like(m)), ["date"], TOPICS, "topic", "attention")


def _rounded(df, cols, places=6):
    return df.select(*(F.round(c, places).alias(c) if c in cols else c for c in df.columns))


@plan(f"select date, {', '.join(f'round({t}, 6) as {t}' for t in TOPICS)}, n_documents from {DAILY}")
def attention_daily_mean(spark, folder):
    return _rounded(S.attention(weights(spark, folder), TOPICS, "D"), TOPICS)


@plan(f"select date, {', '.join(f'round({t}, 6) as {t}' for t in TOPICS)}, n_documents from {MONTHLY}")
def attention_monthly_weighted(spark, folder):
    return _rounded(monthly(spark, folder), TOPICS)


_W3 = "(order by date rows between 1 preceding and 1 following)"


@plan(f"select date, {', '.join(f'round(case when count(*) over {_W3} = 3 then avg({t}) over {_W3} end, 6) as {t}_smoothed' for t in TOPICS)} from {MONTHLY}")
def attention_smoothed(spark, folder):
    names = [f"{t}_smoothed" for t in TOPICS]
    return _rounded(S.smoothed(monthly(spark, folder), TOPICS).select("date", *names), names)


@plan(f"select date, topic, round(attention, 6) as attention from {LONG}")
def attention_long(spark, folder):
    return _rounded(monthly_long(spark, folder), ["attention"])


@plan(f"""select topic, round(avg(attention), 6) as mean, round(stddev_samp(attention), 6) as std, round(min(attention), 6) as min, round(max(attention), 6) as max,
    round(stddev_samp(attention) / avg(attention), 6) as cv, round(corr(attention, b), 6) as autocorr_1, count(*) filter (attention > m + 2 * s) as n_spikes
    from (select *, lag(attention) over (partition by topic order by date) as b, avg(attention) over (partition by topic) as m, stddev_samp(attention) over (partition by topic) as s from {LONG})
    group by topic""")
def attention_stats(spark, folder):
    return _rounded(S.series_stats(monthly_long(spark, folder)), ["mean", "std", "min", "max", "cv", "autocorr_1"])


@plan(f"""select date, topic, round(attention, 6) as attention, round((attention - m) / s, 6) as z_score
    from (select *, avg(attention) over (partition by topic) as m, stddev_samp(attention) over (partition by topic) as s from {LONG}) where (attention - m) / s > 1.5""")
def attention_spikes(spark, folder):
    return _rounded(S.spikes(monthly_long(spark, folder), least=1.5), ["attention", "z_score"])


_SHIFT = 28 * 12  # the given prices end in 2001 and the news begins in 2023: price months are read 28 years on


@plan(f"""select a.date, round(topic_000, 6) as topic_000, round(r.log_return, 8) as log_return from {MONTHLY} a join
    (select last_day(month_end + interval {_SHIFT} month) as date, ln(price / lag(price) over (order by month_end)) as log_return from {PRICE_MONTHS}) r on a.date = r.date where log_return is not null""")
def panel_join(spark, folder):
    """Topic series with the market's return of the month."""
    w = W.orderBy("date")  # a row a month
    prices = B.monthly_prices(spark, folder).select(F.last_day(F.add_months("month_end", _SHIFT)).alias("date"), "price")
    market = prices.select("date", F.ln(F.col("price") / F.lag("price").over(w)).alias("log_return")).where("log_return is not null")
    return S.panel(monthly(spark, folder), market).select("date", F.round("topic_000", 6).alias("topic_000"), F.round("log_return", 8).alias("log_return"))


def _grid_sql() -> str:
    cells = []
    for model, first in _MODELS.items():
        source = f"(select t.*, n.published_at as date, length(n.content) as doc_length from {theta_sql(K, first)} t join {NEWS} n on t.doc_id = n.doc_id)"
        for freq, label in (("D", "cast(date as date)"), ("M", "last_day(date)")):
            for weighting in ("mean", "length_weighted"):
                means = ", ".join(f"coalesce({t}, 0) as {t}" for t in TOPICS)
                cells.append(f"""select '{model}' as model, '{freq}' as freq, '{weighting}' as weighting, d.date, {means}, coalesce(n_documents, 0) as n_documents from (select distinct {label} as date from {_DAYS}) d
                    left join (select {label} as date, {_means(weighting != "mean")}, count(*) as n_documents from {source} group by 1) g on d.date = g.date""")
    return "(" + " union all ".join(cells) + ")"


#: Two sets of weights, from the first and the next dimensions of the vectors; ``attention_grid_lda`` has those of fitted models.
_MODELS = {"leading": 0, "following": K}


@plan(f"select model, freq, weighting, date, {', '.join(f'round({t}, 6) as {t}' for t in TOPICS)}, n_documents from {_grid_sql()}")
def attention_grid(spark, folder):
    """All eight series: by day and month, plain and weighted by length, of either set of weights."""
    cells = []
    for model, first in _MODELS.items():
        rows = weights(spark, folder, first=first)
        for freq in "DM":
            for weighting in ("mean", "length_weighted"):
                series = S.attention(rows, TOPICS, freq, None if weighting == "mean" else "doc_length")
                cells.append(series.select(F.lit(model).alias("model"), F.lit(freq).alias("freq"), F.lit(weighting).alias("weighting"), "date", *TOPICS, "n_documents"))
    return _rounded(union_all(cells), TOPICS)


@plan(f"select topic, round(var_samp(attention), 8) as variance from {LONG} group by topic order by var_samp(attention) desc, topic limit 5")
def topic_variance_top5(spark, folder):
    return _rounded(S.top_variance(monthly_long(spark, folder)), ["variance"], 8)


@plan(f"""select t.doc_id, arg_max(topic, (w, topic)) as topic, round(max(w), 6) as weight from (unpivot {theta_sql(K)} on {', '.join(TOPICS)} into name topic value w) t group by t.doc_id""")
def dominant_topic(spark, folder):
    long = R.melt(B.theta(spark, folder, K), ["doc_id"], TOPICS, "topic", "w")
    return long.groupBy("doc_id").agg(F.max_by("topic", F.struct("w", "topic")).alias("topic"), F.round(F.max("w"), 6).alias("weight"))


@plan(f"""select date, arg_max(article_id, (topic_000, article_id)) as article_id from
    (select last_day(w.date) as date, topic_000, article_id from {WEIGHTS} w join (select doc_id, article_id from {NEWS}) using (doc_id)) group by date""")
def narrative_retrieval(spark, folder):
    """The article of each month that a topic weighs most in."""
    w = weights(spark, folder).select("doc_id", "topic_000", F.last_day(F.to_date("date")).alias("date")).join(B.news(spark, folder).select("doc_id", "article_id"), "doc_id")
    return w.groupBy("date").agg(F.max_by("article_id", F.struct("topic_000", "article_id")).alias("article_id"))


_ARTICLES = f"(unpivot (select w.*, last_day(w.date) as month, article_id from {WEIGHTS} w join (select doc_id, article_id from {NEWS}) using (doc_id)) on {', '.join(TOPICS)} into name topic value weight)"


@plan(f"""select month as date, topic, cast(rank as integer) as rank, article_id, round(weight, 6) as weight from
    (select month, topic, article_id, weight, row_number() over (partition by month, topic order by weight desc, article_id) as rank from {_ARTICLES}) where rank <= 5""")
def narratives(spark, folder):
    """The five articles of each month and topic that the topic weighs most in (a report)."""
    w = weights(spark, folder).join(B.news(spark, folder).select("doc_id", "article_id"), "doc_id")
    long = R.melt(w.select(F.last_day(F.to_date("date")).alias("date"), "article_id", *TOPICS), ["date", "article_id"], TOPICS, "topic", "weight")
    rank = F.row_number().over(W.partitionBy("date", "topic").orderBy(F.desc("weight"), "article_id"))  # each task keeps its own first five
    return long.withColumn("rank", rank).where("rank <= 5").select("date", "topic", "rank", "article_id", F.round("weight", 6).alias("weight"))

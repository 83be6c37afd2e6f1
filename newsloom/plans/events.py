"""The event table, its cross tables and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import lexicon as L
from newsloom.functions import text as X
from newsloom.functions import values as V
from newsloom.operators import events as E
from newsloom.operators import relational as R
from newsloom.plans.corpus import _LEX, _TAGS
from newsloom.plans.registry import NEWS, plan
from newsloom.sources import bindings as B
from newsloom.sources.readers import table

LATENT = 4
LABELS = [f"topic_{i}" for i in range(10)]
BINS = ["negative", "neutral", "positive"]
LATENTS = [f"latent_feature_{i}" for i in range(LATENT)]


def source(spark, folder):
    """News with a vector: its label is the topic, its first numbers are the latent features."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("topic_"), F.col("label")).alias("topic"), *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(LATENTS)))
    news = B.news(spark, folder).select("doc_id", F.col("published_at").alias("ts"), "title", "content", F.col("symbol_query").alias("symbol"))
    rows = news.join(vectors, "doc_id").withColumn("sentiment_score", X.lexicon_sentiment(X.clean_basic(F.col("content"))))
    return rows.withColumnRenamed("doc_id", "event_id")


def events(spark, folder):
    return E.event_table(source(spark, folder), LATENTS)


_SRC = f"""(select n.doc_id as event_id, published_at as ts, title, content, symbol_query as symbol, 'topic_' || label as topic, {", ".join(f"cast(embedding[{i + 1}] as double) as l{i}" for i in range(LATENT))},
    cast(p - n_ as double) / greatest(1, p + n_) as score from {NEWS} n join embeddings on vec_id = n.doc_id join (select doc_id, p, n as n_ from {_LEX}) x on x.doc_id = n.doc_id)"""
_PERIOD = "case when h < 9.5 then 'pre_market' when h < 16 then 'trading_hours' when h < 20 then 'after_hours' else 'overnight' end"
_Z = " + ".join(f"abs((l{i} - avg(l{i}) over ()) / stddev_pop(l{i}) over ())" for i in range(LATENT))
_A = f"""(select *, {_PERIOD} as market_period, 1 / (1 + exp(-strength)) as confidence, case when rn <= 20 then 1.0 else 1 - len(list_filter(past, lambda t: t = topic)) / 20.0 end as novelty,
    case when len(tags) > 0 then array_to_string(tags, ',') else 'general' end as all_topics from
    (select *, ((hour(ts) - 5) + 24) % 24 as h, ({_Z}) / {LATENT} as strength, row_number() over (partition by symbol order by ts, event_id) as rn,
    coalesce(list(topic) over (partition by symbol order by ts, event_id rows between 20 preceding and 1 preceding), []) as past, list_filter([{_TAGS}], lambda t: t is not null) as tags
    from (select *, lower(coalesce(title, '')) || ' ' || lower(coalesce(content, '')) as low from {_SRC})))"""
_B = f"(select *, abs(score) * 0.3 + confidence * 0.2 + novelty * 0.3 + (case when market_period = 'trading_hours' then 0.2 else 0 end) as impact from {_A})"
_FLAGS = ", ".join(f"cast(contains(all_topics, '{t}') as integer) as {c}" for t, c in (("earnings", "is_earnings_news"), ("product", "is_product_news"), ("innovation", "is_innovation_news"), ("regulation", "is_regulatory_news"), ("macro", "is_macro_news")))
EVENTS = f"""(select event_id, cast(ts as date) as event_date, strftime(ts, '%H:%M:%S') as event_time, market_period, topic as primary_topic, strength as topic_strength, confidence as topic_confidence, all_topics,
    {_FLAGS}, cast(sign(score) as double) as sentiment_direction, abs(score) as sentiment_intensity,
    case when score <= -1 then null when score <= -0.1 then 'negative' when score <= 0.1 then 'neutral' when score <= 1 then 'positive' end as sentiment_category,
    cast(novelty as double) as novelty_score, impact as impact_score, case when impact <= 0 then null when impact <= 0.3 then 'low' when impact <= 0.6 then 'medium' when impact <= 1 then 'high' end as impact_category,
    cast(year(ts) as integer) as year, cast(quarter(ts) as integer) as quarter, cast(month(ts) as integer) as month, cast(isodow(ts) - 1 as integer) as day_of_week, cast(isodow(ts) >= 6 as integer) as is_weekend,
    title, cast(len(list_filter(string_split_regex(coalesce(content, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) as integer) as word_count from {_B})"""
_ROUND = ("topic_strength", "topic_confidence", "impact_score", "sentiment_intensity", "novelty_score")


@plan(f"select * replace ({', '.join(f'round({c}, 6) as {c}' for c in _ROUND)}) from {EVENTS}")
def event_table(spark, folder):
    e = events(spark, folder)
    return e.withColumns({c: F.round(c, 6) for c in _ROUND})


@plan("""select case when h < 9.5 then 'pre_market' when h < 16 then 'trading_hours' when h < 20 then 'after_hours' else 'overnight' end as period, count(*) as n
    from (select ((hour(ts) - 5) + 24) % 24 as h from events) group by 1""")
def market_period(spark, folder):
    return table(spark, folder, "events").groupBy(V.market_period(F.col("ts")).alias("period")).agg(F.count("*").alias("n"))


@plan("""select event_id, round(case when rn <= 20 then 1.0 else 1 - len(list_filter(past, lambda t: t = event_type)) / 20.0 end, 6) as novelty from
    (select event_id, event_type, row_number() over w as rn, list(event_type) over (partition by user_id order by ts, event_id rows between 20 preceding and 1 preceding) as past
    from events window w as (partition by user_id order by ts, event_id))""")
def novelty_score(spark, folder):
    e = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    return E.novelty_in_blocks(e, "event_type", ["ts", "event_id"], "user_id").select("event_id", F.round("novelty_score", 6).alias("novelty"))


@plan(f"""select event_date, primary_topic, count(event_id) as news_count, round_even(avg(sentiment_direction), 4) as avg_sentiment, round_even(avg(sentiment_intensity), 4) as avg_intensity,
    round_even(avg(impact_score), 4) as avg_impact, round_even(avg(novelty_score), 4) as avg_novelty from {EVENTS} group by all""")
def event_daily_rollup(spark, folder):
    return E.daily_rollup(events(spark, folder))


_CROSS = ", ".join(f"count(*) filter (sentiment_category = '{b}') as {b}" for b in BINS)


@plan(f"""select coalesce(primary_topic, 'Total') as primary_topic, {_CROSS}, count(*) as "Total" from (select * from {EVENTS} where sentiment_category is not null) group by rollup (primary_topic)""")
def crosstab_margins(spark, folder):
    return R.crosstab(events(spark, folder), "primary_topic", "sentiment_category", BINS)


@plan(f"""select primary_topic, {", ".join(f"round(count(*) filter (sentiment_category = '{b}') / count(*) * 100, 1) as {b}" for b in BINS)} from (select * from {EVENTS} where sentiment_category is not null) group by 1""")
def crosstab_row_pct(spark, folder):
    return R.crosstab_shares(events(spark, folder), "primary_topic", "sentiment_category", BINS)


_DESC = ("topic_strength", "impact_score", "novelty_score", "word_count")


@plan(f"""select name, count(v) as count, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, round(min(v), 6) as min, round(quantile_cont(v, 0.25), 6) as p25, round(quantile_cont(v, 0.5), 6) as p50,
    round(quantile_cont(v, 0.75), 6) as p75, round(max(v), 6) as max from (unpivot (select {", ".join(f"cast({c} as double) as {c}" for c in _DESC)} from {EVENTS}) on {", ".join(_DESC)} into name name value v) group by name""")
def describe_numeric(spark, folder):
    d = R.describe(events(spark, folder), list(_DESC))
    return d.select("name", "count", *(F.round(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")))


@plan(f"select cast(year(published_at) as integer) as year, {', '.join(f'''count(*) filter (label = {i}) as topic_{i}''' for i in range(10))} from {NEWS} n join embeddings on vec_id = n.doc_id group by 1")
def topic_by_year(spark, folder):
    rows = B.news(spark, folder).select("doc_id", F.year("published_at").alias("year")).join(table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("topic_"), F.col("label")).alias("topic")), "doc_id")
    return rows.groupBy("year").pivot("topic", LABELS).count().fillna(0)


@plan(f"""select impact_category as value, count(*) as n, round(count(*) / sum(count(*)) over () * 100, 1) as pct from {EVENTS} where impact_category is not null group by 1""")
def impact_distribution(spark, folder):
    return R.value_counts(events(spark, folder), "impact_category")


_SPLITS = " union all ".join(
    f"select '{name}' as split, count(*) filter (d >= timestamp '{a}' and d <= timestamp '{b}') as train, count(*) filter (d >= timestamp '{c}' and d <= timestamp '{e}') as test from (select published_at as d from {NEWS})"
    for name, (a, b, c, e) in L.TEMPORAL_SPLITS.items()
)


@plan(_SPLITS)
def temporal_split_counts(spark, folder):
    """Documents of each expanding split; a period ends with the first moment of its last day, as the workload's masks do."""
    days = B.news(spark, folder).select(F.col("published_at").alias("d"))
    moment = lambda day: F.lit(day).cast("timestamp_ntz")
    between = lambda a, b: F.count_if(F.col("d").between(moment(a), moment(b)))
    parts = F.array(*(F.struct(F.lit(name).alias("split"), F.lit(i).alias("i")) for i, name in enumerate(L.TEMPORAL_SPLITS)))
    counts = days.agg(*(between(a, b).alias(f"train_{i}") for i, (a, b, _, _) in enumerate(L.TEMPORAL_SPLITS.values())), *(between(c, e).alias(f"test_{i}") for i, (_, _, c, e) in enumerate(L.TEMPORAL_SPLITS.values())))
    n = len(L.TEMPORAL_SPLITS)
    rows = counts.withColumn("s", F.explode(parts))
    return rows.select("s.split", F.get(F.array(*(F.col(f"train_{i}") for i in range(n))), F.col("s.i")).alias("train"), F.get(F.array(*(F.col(f"test_{i}") for i in range(n))), F.col("s.i")).alias("test"))

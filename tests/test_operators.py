"""Small cases: edges, ties, gaps, orders."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.functions import values as V
from newsloom.operators import clusters
from newsloom.operators import events as E
from newsloom.operators import forecast as P
from newsloom.operators import guided as G
from newsloom.operators import models as M
from newsloom.operators import near_duplicates as N
from newsloom.operators import readout as O
from newsloom.operators import relational as R
from newsloom.operators import series as S
from newsloom.operators import vocabulary as T
from newsloom.sources import readers, sinks
from newsloom.streaming import events as ES


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()) if values else [F.lit(1).alias("x")])
    return row.select(column.alias("v")).first()["v"]


D = dt.date


def test_returns_of_single_rows_and_gaps(spark):
    prices = spark.createDataFrame([("a", D(2024, 1, 31), 10.0), ("a", D(2024, 3, 1), 11.0), ("a", D(2024, 3, 2), 0.0), ("a", D(2024, 3, 3), 5.0), ("b", D(2024, 1, 1), 5.0)], "symbol string, date date, adjusted_close double")
    got = {(r.symbol, r.date): r.simple_return for r in S.returns(prices).collect()}
    assert got["a", D(2024, 1, 31)] is None and got["b", D(2024, 1, 1)] is None
    assert math.isclose(got["a", D(2024, 3, 1)], 0.1) and got["a", D(2024, 3, 3)] is None
    monthly = {(r.symbol, r.month_end): (r.log_return, r.simple_return) for r in S.monthly_returns(S.returns(prices.where("adjusted_close > 0"))).collect()}
    assert monthly["b", D(2024, 1, 31)] == (0.0, 0.0) and (("a", D(2024, 2, 29)) not in monthly)


def test_calendar_gap_is_a_zero_row(spark):
    w = spark.createDataFrame([(D(2024, 1, 1), 0.25, 3), (D(2024, 1, 3), 0.75, 0)], "date date, topic_000 double, n int")
    got = [(r.date.day, r.topic_000, r.n_documents) for r in S.attention(w, ["topic_000"]).orderBy("date").collect()]
    assert got == [(1, 0.25, 1), (2, 0.0, 0), (3, 0.75, 1)]
    assert [r.topic_000 for r in S.attention(w, ["topic_000"], "M", "n").collect()] == [0.25]
    assert [r.date.day for r in R.missing_days(w, "date").collect()] == [2]
    assert R.calendar(w.where("n > 9"), "date").count() == 0


@pytest.mark.parametrize(("score", "label"), [(-1.0, None), (-0.5, "negative"), (-0.1, "negative"), (0.0, "neutral"), (0.1, "neutral"), (1.0, "positive"), (1.1, None)])
def test_sentiment_bins(spark, score, label):
    assert one(spark, V.sentiment_bin(F.lit(score))) == label


@pytest.mark.parametrize(("score", "label"), [(0.0, None), (0.3, "low"), (0.6, "medium"), (1.0, "high"), (1.1, None)])
def test_impact_bins(spark, score, label):
    assert one(spark, V.impact_bin(F.lit(score))) == label


@pytest.mark.parametrize(("hour", "period"), [(0, "after_hours"), (1, "overnight"), (5, "pre_market"), (14, "pre_market"), (15, "trading_hours"), (20, "trading_hours"), (21, "after_hours")])
def test_sessions(spark, hour, period):
    assert one(spark, V.market_period(F.lit(dt.datetime(2024, 1, 1, hour, 30)))) == period


def test_cleaning(spark):
    text = "<p>See https://x.com/a?b=1 or www.y.org, mail a.b@c.de: AAPL.US rose 5%\n\nÜber Café</p>"
    assert one(spark, X.clean_basic(F.lit(text))) == "see or mail aapl us rose ber caf"
    assert one(spark, X.clean_basic(F.lit(None).cast("string"))) == ""
    assert one(spark, X.clean_for_encoder(F.lit("Meta Platforms and NVDA: continue reading at a.co.uk, AAPL.US stock Motley Fool"))) == "company and company : at .uk,"
    assert one(spark, X.clean_for_encoder(F.lit("TSLA stock"), mask_domain=False)) == "TSLA stock"
    # letters beyond ASCII are no word characters, as in the SQL
    import duckdb
    from newsloom.plans.corpus import _encoder_sql

    odd = "sell\u00f3 \u00e9stock\u00f1 buy_ \u4e2dNVDA\u4e2d \u00e9AAPL.NY"
    assert one(spark, X.clean_for_encoder(F.lit(odd))) == duckdb.connect().execute(f"select {_encoder_sql(chr(39) + odd + chr(39), True)}").fetchone()[0]
    assert one(spark, X.clean_words(F.lit("The long-term Market http://x of AI"), ("the", "of"), keep_hyphen=True)) == "long-term market"


def test_tokens_and_ngrams(spark):
    assert one(spark, X.tokens(F.lit("the cat sat on mat mat"))) == ["cat", "sat", "mat", "mat"]
    for words, want in (([], []), (["a"], []), (["a", "b", "b"], ["a_b", "b_b"])):
        assert one(spark, X.ngrams(F.array(*map(F.lit, words)).cast("array<string>"))) == want
    assert one(spark, X.ngrams(F.array(*map(F.lit, "abcd")), 3)) == ["a_b_c", "b_c_d"]
    assert [one(spark, X.suffix_lemma(F.lit(w))) for w in ("stories", "boxes", "cats", "class", "rising", "moved")] == ["story", "box", "cat", "class", "ris", "mov"]


def test_terms_tags_and_labels(spark):
    garbage = lambda t, **k: one(spark, X.garbage_term(F.lit(t), **k))
    assert [garbage(t) for t in ("trump", "www x", "2024", "ab", "ai", "news", "zacks", "stock rally", "nvidia chip", "chip")] == [False, True, True, True, False, True, True, True, True, False]
    assert not garbage("stock rally", domain_rules=False)
    assert one(spark, X.topic_tags(F.lit("nothing here"))) == "general" and one(spark, X.topic_tags(F.lit("profit of the ipad"))) == "earnings,product"
    assert one(spark, X.category(F.lit("ipad profit"))) == "Finance/Earnings" and one(spark, X.category(F.lit("zzz"))) == "General News"
    label = lambda *t: one(spark, X.topic_label(F.array(*map(F.lit, t))))
    assert label("a b", "c", "d", "e", "f") == "c / d / e" and label("a b", "c", "d") == "a b / c / d"


def test_sentiment(spark):
    assert one(spark, X.lexicon_sentiment(F.lit("gain and loss and win"))) == pytest.approx(1 / 3)
    assert one(spark, X.lexicon_sentiment(F.lit("zzz"))) == 0
    assert one(spark, X.financial_sentiment(F.lit("profit gain"))) == 1 and one(spark, X.financial_sentiment(F.lit("not a profit"))) == -1


def test_ties_and_priorities(spark):
    rows = spark.createDataFrame([("k", 1, "b"), ("k", 1, "a"), ("j", 2, None)], "key string, at int, v string")
    assert sorted(tuple(r) for r in R.keep_first(rows, ["key"], [F.col("at"), F.col("v")]).collect()) == [("j", 2, None), ("k", 1, "a")]
    assert ("k", 1, "b") in [tuple(r) for r in R.keep_last(rows, ["key"], [F.col("at"), F.col("v")]).collect()]
    new, old = rows.where("v = 'b'"), rows.where("v = 'a' or v is null")
    assert sorted(r.v or "" for r in R.union_priority(new, old, ["key"]).collect()) == ["", "b"]


def test_crosstab_tells_null_from_total(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x"), ("a", None)], "r string, c string")
    got = {r.r: (r.x, r.y, r.Total) for r in R.crosstab(rows, "r", "c", ["x", "y"]).collect()}
    assert got == {"a": (1, 1, 2), "b": (1, 0, 1), "Total": (2, 1, 3)}
    assert {r.r: (r.x, r.y) for r in R.crosstab_shares(rows, "r", "c", ["x", "y"]).collect()} == {"a": (50.0, 50.0), "b": (100.0, 0.0)}


def test_novelty_of_first_and_later_events(spark):
    rows = spark.createDataFrame([(i, "s", "t" if i != 22 else "u") for i in range(25)], "i int, s string, topic string")
    got = [r.n for r in rows.withColumn("n", E.novelty("topic", ["i"], "s")).orderBy("i").collect()]
    assert got[:20] == [1.0] * 20 and got[20] == 0.0 and got[22] == 1.0 and got[23] == pytest.approx(0.05)


def test_near_duplicates_by_day(spark):
    words = [f"word{i}" for i in range(40)]
    a, b, c = words[:], words[:-1] + ["other"], words[:-2] + ["other", "third"]
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    docs = spark.createDataFrame([(1, at(1, 1), " ".join(a)), (2, at(1, 2), " ".join(b)), (3, at(2, 1), " ".join(a)), (4, at(2, 2), " ".join(c)), (5, at(1, 3), "quite different text here")], "doc_id long, published_at timestamp, cleaned_text string")
    pairs = N.near_pairs(docs, "doc_id", "cleaned_text", "published_at", threshold=0.5, max_df=1.0)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(1, 2), (3, 4)]
    left = sorted(r.doc_id for r in N.remove_duplicates(docs, threshold=0.5, max_df=1.0).collect())
    assert left == [1, 4, 5]  # 3 copies 1 exactly; 2 is near 1; 4 lost its partner of the day


def test_greedy_chain_keeps_both_ends(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (4, 6), (5, 6)], "a long, b long")
    assert sorted(r.doc for r in N.greedy_removed(pairs).collect()) == [2, 5, 6]


def test_term_weights(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["a", "b", "b"])], "doc int, terms array<string>")
    counts = T.term_counts(docs, "doc", "terms")
    totals = T.term_totals(counts)
    assert {r.term: (r["count"], r.df) for r in totals.collect()} == {"a": (3, 3), "b": (3, 2)}
    plain = {(r.doc, r.term): r.weight for r in T.tfidf_plain(counts, totals, 3, "doc").collect()}
    assert plain[1, "a"] == pytest.approx(0.5 * math.log(3 / 4))
    for r in T.tfidf_smooth(counts, totals, 3, "doc").groupBy("doc").agg(F.sum(F.col("weight") ** 2).alias("l")).collect():
        assert r.l == pytest.approx(1)
    assert [r.term for r in T.vocabulary(totals, 3, size=1).collect()] == ["a"]
    ranks = T.row_index(spark.range(100).repartition(7), ["id"]).collect()
    assert all(r.row_idx == r.id for r in ranks)


def test_one_to_one_assignment():
    means = [(0, "x", 0.9), (1, "x", 0.8), (1, "y", 0.1), (2, "x", 0.5)]
    assert G.assign_one_to_one(means) == {0: "x", 1: "y", 2: "x"}


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 6))
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(size=80) * 0.1
    kept = []
    for alpha in (0.001, 0.1, 1.0, 10.0):
        b, w = P.lasso(x, y, alpha)
        g = x.T @ (y - b - x @ w) / len(y) - x.mean(0) * (y - b - x @ w).mean()
        assert np.all(np.abs(g) <= alpha + 1e-6) and np.allclose(g[w != 0], alpha * np.sign(w[w != 0]), atol=1e-6)
        kept.append(int((w != 0).sum()))
    assert kept == sorted(kept, reverse=True) and kept[-1] == 0


def test_backtest_sees_no_later_row(spark):
    rng = np.random.default_rng(1)
    rows = [(D(2000 + i // 12, i % 12 + 1, 1), float(rng.normal()), float(rng.normal())) for i in range(80)]
    run = lambda r: {x.date: x.predicted for x in P.lasso_backtest(spark.createDataFrame(r, "date date, x double, y double"), ["x"], least=40).collect()}
    base = run(rows)
    assert len(base) == 24
    changed = run(rows[:-1] + [(rows[-1][0], 9.0, 9.0)])
    assert {k: v for k, v in base.items() if k != rows[-1][0]} == {k: v for k, v in changed.items() if k != rows[-1][0]}
    assert P.lasso_backtest(spark.createDataFrame(rows[:20], "date date, x double, y double"), ["x"], least=60).count() == 0


def test_vector_autoregression():
    rng = np.random.default_rng(2)
    a = np.array([[0.5, 0.3], [0.0, 0.4]])
    x = np.zeros((3000, 2))
    for t in range(1, 3000):
        x[t] = a @ x[t - 1] + rng.normal(size=2)
    _, c, e = P.fit_var(x, P.var_order(x, 3))
    assert np.allclose(c[0], a, atol=0.06)
    irf = P.impulse_responses(c, e, 4)
    assert irf.shape == (5, 2, 2) and np.allclose(P.variance_decomposition(irf).sum(2), 1)
    assert P.granger_p(x[:, 1], x[:, 0], 1) < 1e-6 < P.granger_p(x[:, 0], x[:, 1], 1)
    # known quantiles of the F distribution
    assert P.f_survival(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-4) and P.f_survival(2.7729, 4, 26) == pytest.approx(0.048, abs=2e-3)


def test_autoencoder_reads_every_row(spark):
    # rows past the first 10,000 by hash lie far away in one column, which is constant in the others
    hashed = spark.range(12_000).select(F.col("id").alias("doc"), F.row_number().over(W.orderBy(F.xxhash64("id"), "id")).alias("place"))
    value = F.when(F.col("place") > 10_000, F.pmod("doc", F.lit(7)) + 100.0).otherwise(0.0)
    rows = hashed.select("doc", F.array(F.sin(F.col("doc").cast("double")), F.cos(F.col("doc").cast("double")), value).alias("x"))
    got = M.autoencode(rows, "doc", "x", epochs=3)
    assert got.count() == 12_000 and got.agg(F.max("error")).first()[0] < 10  # unscaled, the far column alone has about 3,300
    again = {r.doc: r.error for r in M.autoencode(rows.repartition(5), "doc", "x", epochs=3).collect()}
    assert all(math.isclose(r.error, again[r.doc], rel_tol=1e-6, abs_tol=1e-9) for r in got.collect())


def test_vector_autoregression_takes_five_topics_and_the_return(spark, sf):
    from newsloom.plans import models as plans

    panel, chosen = plans.return_panel(spark, sf)
    assert len(chosen) == 5 and panel.where("log_return is not null").count() > 30
    rows = plans.var_irf(spark, sf).collect()
    assert {r.shock for r in rows} == {r.response for r in rows} == {*chosen, "log_return"} and len(rows) == 13 * 36
    assert all(math.isfinite(r.value) and -1e-9 <= r.share <= 1 + 1e-9 for r in rows)
    got = {r.cause: r.p_value for r in plans.granger(spark, sf).collect()}
    x = P._matrix(panel, [*chosen, "log_return"], "date")
    lags = P.var_order(x, 3)
    assert got == pytest.approx({c: P.granger_p(x[:, i], x[:, 5], lags) for i, c in enumerate(chosen)})


def test_granger_takes_the_order_by_aic(spark):
    rng = np.random.default_rng(6)
    cause, effect = rng.normal(size=400), np.zeros(400)
    effect[2:] = 0.9 * cause[:-2] + rng.normal(size=398) * 0.3
    rows = [(D(2000 + i // 12, i % 12 + 1, 1), float(a), float(b)) for i, (a, b) in enumerate(zip(cause, effect))]
    (got,) = P.granger(spark.createDataFrame(rows, "date date, c double, e double"), ["c"], "e").collect()
    assert got.p_value < 1e-6  # the effect comes after two periods; at one lag nothing is seen


def test_kmeans_keeps_the_cheapest_of_ten_starts(spark, monkeypatch):
    fits, lloyd = [], clusters.lloyd
    monkeypatch.setattr(clusters, "lloyd", lambda *a, **k: fits.extend(lloyd(*a, **k)) or fits)
    rows = spark.createDataFrame([(i, [float(i % 5), float(i % 3)]) for i in range(60)], "doc int, x array<double>")
    (best,) = clusters.fit(rows, "doc", "x", [4])
    assert len(fits) == 10 and best.cost == min(f.cost for f in fits)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "words.txt").write_text("# list\n\n alpha \nbeta\n#x\n")
    assert sorted(r.word for r in readers.word_list(spark, str(tmp_path / "words.txt")).collect()) == ["alpha", "beta"]
    (tmp_path / "list.json").write_text('[{"title": "a", "sentiment": {"polarity": 0.5}}]')
    (tmp_path / "held.json").write_text('{"news": [{"title": "b", "tags": ["x"]}]}')
    assert sorted(r.title for r in readers.news_payload(spark, str(tmp_path / "*.json")).collect()) == ["a", "b"]
    df = spark.createDataFrame([(1, 'say "hi",\nthere'), (2, None)], "id int, s string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, readers.csv_table(spark, str(tmp_path / "csv"), "id int, s string").collect())) == [(1, 'say "hi",\nthere'), (2, None)]
    for day in ("20240101", "20240301", "20240201"):
        sinks.write_parquet(spark.createDataFrame([(day,)], "d string"), str(tmp_path / f"news_raw_{day}.parquet"))
    assert readers.latest_file(spark, str(tmp_path / "news_raw_*.parquet")).first().d == "20240301"
    sinks.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    with pytest.raises(ValueError, match="b, c"):
        readers.require_columns(spark.range(1), ["id", "b", "c"])
    assert "| id |" in sinks.markdown_report("t", {"ids": spark.range(2)})
    assert readers.union_all([spark.range(1), spark.range(1).withColumn("x", F.lit(1))]).columns == ["id", "x"]


def test_stream_equals_batch_and_drops_repeats(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.limit(300).coalesce(1).write.parquet(str(tmp_path / "in"))
    events.limit(300).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = ES.drain(ES.daily_counts(ES.event_stream(spark, str(tmp_path / "in"), "*.parquet")), str(tmp_path), "complete")
    want = events.limit(300).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    assert sorted((r.day, r.event_type, r.n) for r in got.collect()) == sorted(map(tuple, want.collect()))


def test_settings(tmp_path):
    from newsloom.sources import config

    (tmp_path / "s.yaml").write_text("lda:\n  n_topics: 50\n  folds: 2\nsymbols: [A, B]\n")
    found = config.read_settings(f"{tmp_path}/s.yaml", {"lda": {"n_topics": 10, "seed": 42}, "name": "x"})
    assert found["lda.n_topics"] == 50 and found["lda.seed"] == 42 and found.get("lda.none", 7) == 7 and found["symbols"] == ["A", "B"] and set(found) == {"lda", "name", "symbols"}
    (tmp_path / "bad.yaml").write_text("- a\n")
    with pytest.raises(ValueError):
        config.read_settings(f"{tmp_path}/bad.yaml")


def test_unreadable_inputs_are_skipped(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a")
    (tmp_path / "b").write_text("no parquet")
    frames, skipped = readers.readable([f"{tmp_path}/{n}" for n in "abc"], spark.read.parquet)
    assert [f.count() for f in frames] == [3] and sorted(p[-1] for p in skipped) == ["b", "c"]


def test_triples_and_models_are_read_back(spark, tmp_path):
    from pyspark.ml.clustering import KMeans, KMeansModel

    rows = [(0, 1, 2), (0, 3, 1), (5, 0, 9)]
    sinks.write_triples(spark.createDataFrame(rows, "row_idx long, col_idx long, count long"), f"{tmp_path}/m")
    assert sorted(map(tuple, sinks.read_triples(spark, f"{tmp_path}/m").collect())) == rows
    features = M.dense_rows(spark.createDataFrame([(i, [float(i % 2), 0.5]) for i in range(8)], "doc_id long, embedding array<double>"), "doc_id", "embedding")
    model = KMeans(k=2, seed=42).fit(features)
    sinks.save_model(model, f"{tmp_path}/k")
    assert [list(c) for c in sinks.load_model(KMeansModel, f"{tmp_path}/k").clusterCenters()] == [list(c) for c in model.clusterCenters()]


def test_pipeline_report(spark):
    docs = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-03-01")], "doc_id long, day string")
    report = json.loads(sinks.pipeline_report({"read": None, "fit": "no data"}, docs, "day", {"lda": {"k": 5}}, {}))
    assert report["pipeline_run"] == {"steps_completed": ["read"], "errors": [{"step": "fit", "error": "no data"}]}
    assert report["data_summary"] == {"n_documents": 2, "date_range": "2024-01-01 to 2024-03-01"} and report["model_summary"]["lda"]["k"] == 5


def test_novelty_in_blocks_is_novelty(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(t), ["a", "b", None][rng.integers(0, 3)], f"t{rng.integers(0, 3)}") for i, t in enumerate(rng.integers(0, 500, 400))]
    df = spark.createDataFrame(rows, "event_id long, ts long, symbol string, topic string").repartition(5)
    want = {r.event_id: r.n for r in df.select("event_id", E.novelty("topic", ["ts", "event_id"], "symbol").alias("n")).collect()}
    for block in (20, 33, 1000):
        assert {r.event_id: r.novelty_score for r in E.novelty_in_blocks(df, "topic", ["ts", "event_id"], "symbol", block=block).collect()} == want


def test_terms_are_counted_in_their_row(spark):
    rows = [(1, ["b", "a", "b", None, "b"]), (2, []), (3, None), (4, ["x"]), (5, ["a", "a"])]
    got = sorted(tuple(r) for r in T.term_counts(spark.createDataFrame(rows, "doc_id long, terms array<string>"), "doc_id", "terms").collect())
    assert got == [(1, "a", 1), (1, "b", 3), (4, "x", 1), (5, "a", 2)]


def test_audit_finds_a_look_ahead(spark):
    uses = spark.createDataFrame([(2023, "2022-12-31"), (2024, "2024-01-01"), (2025, "2024-06-01")], "period int, used string").withColumn("used", F.to_date("used"))
    got = {r.period: r.clean for r in R.look_ahead(uses, F.make_date("period", F.lit(1), F.lit(1)), "used").collect()}
    assert got == {2023: True, 2024: False, 2025: True}


def test_best_number_of_topics(spark):
    scores = spark.createDataFrame([(50, -2.0), (80, -1.0), (120, -1.0)], "k int, mean_ll double")
    assert O.best(scores).first().k == 80


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=501), "b": rng.integers(0, 4, 40).astype(float), "c": np.array([7.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("d", None)]
    got = {r.name: r for r in R.quantiles(spark.createDataFrame(rows, "name string, v double").repartition(6), "name", "v", [0.25, 0.5, 0.9]).collect()}
    assert set(got) == {"a", "b", "c"}
    assert all(np.allclose([got[k].q0, got[k].q1, got[k].q2], np.quantile(v, [0.25, 0.5, 0.9])) for k, v in values.items())


def test_elastic_net_meets_its_conditions():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 5))
    y = x @ [1.0, 0, -0.5, 0, 0] + 0.1 * rng.normal(size=80)
    for mix in (1.0, 0.5, 0.2):
        b, w = P.lasso(x, y, 0.1, mix=mix)
        slope = x.T @ (y - b - x @ w) / 80 - 0.1 * (1 - mix) * w
        assert all(np.isclose(s, 0.1 * mix * np.sign(c)) if c else abs(s) <= 0.1 * mix + 1e-9 for s, c in zip(slope, w))


def test_sparse_var_drops_what_says_nothing():
    rng = np.random.default_rng(7)
    x = np.zeros((400, 3))
    for t in range(1, 400):
        x[t] = [0.5 * x[t - 1, 0] + 0.4 * x[t - 1, 1], 0.6 * x[t - 1, 1], -0.3 * x[t - 1, 2]] + rng.normal(size=3)
    _, c, e = P.sparse_var(x, 1)
    assert abs(c[0][0, 1] - 0.4) < 0.15 and c[0][1, 0] == c[0][2, 0] == 0 and e.shape == (399, 3)


def test_bands_of_impulse_responses(spark):
    rng = np.random.default_rng(8)
    x = np.cumsum(rng.normal(size=(60, 2)), axis=0) * 0.1 + rng.normal(size=(60, 2))
    panel = spark.createDataFrame([(D(2020, 1, 1) + dt.timedelta(days=i), float(a), float(b)) for i, (a, b) in enumerate(x)], "date date, a double, b double")
    rows = P.irf_bands(panel, ["a", "b"], steps=3, draws=60).collect()
    assert len(rows) == 16 and all(r.low <= r.high for r in rows)
    assert sum(r.low <= r.value <= r.high for r in rows) >= 12
    again = {(r.shock, r.response, r.h): r.low for r in P.irf_bands(panel, ["a", "b"], steps=3, draws=60).collect()}
    assert all(np.isclose(again[r.shock, r.response, r.h], r.low) for r in rows)

import datetime as dt
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from newsloom.functions import lexicon
from newsloom.operators import asof, lemmas
from newsloom.operators import vocabulary as T


def brute_lemma(term, base):
    for rules, irregular in ((lemmas.VERB_RULES, lemmas.IRREGULAR_VERBS), (lemmas.NOUN_RULES, lemmas.IRREGULAR_NOUNS)):
        if term in irregular:
            term = irregular[term]
            continue
        forms = [term] + [term[: len(term) - len(e)] + to for e, to in rules if term.endswith(e) and len(term) > len(e)]
        known = [f for f in forms if f in base]
        term = min(known, key=len) if known else term
    return term


def test_lemmas_follow_rules_exceptions_and_known_forms(spark):
    base = {"rise", "cut", "story", "box", "woman", "make", "trade", "bus", "class", "bank", "watch", "match", "rising", "loss", "glass", "shelf"}
    terms = "rises rising cuts stories boxes women making traded buses class banks watches matches rose fell unknowns loss losses glasses s ing shelves children xes made".split()
    df = spark.createDataFrame([(t,) for t in [*terms, *terms, None]], "term string").repartition(3)
    got = {r.term: r.lemma for r in lemmas.lemmas(df, spark.createDataFrame([(b,) for b in base], "term string")).collect()}
    assert got == {t: brute_lemma(t, base) for t in terms}
    assert got["stories"] == "story" and got["women"] == "woman" and got["rose"] == "rise" and got["unknowns"] == "unknowns" and got["making"] == "make" and got["shelves"] == "shelf"
    none = spark.createDataFrame([], "term string")
    assert {r.lemma for r in lemmas.lemmas(df, none).collect()} >= {"rise", "fall", "child", "boxes"} and lemmas.lemmas(none, df).count() == 0


def test_lemmas_of_documents_and_counts(spark):
    table = spark.createDataFrame([("cats", "cat"), ("cat", "cat"), ("ran", "run")], "term string, lemma string")
    docs = spark.createDataFrame([(1, ["cats", "ran", "cats", "other"]), (2, []), (3, None)], "doc long, tokens array<string>")
    assert {r.doc: r.tokens for r in lemmas.lemma_tokens(docs, table, "doc", "tokens").collect()} == {1: ["cat", "run", "cat", "other"], 2: [], 3: None}
    counts = spark.createDataFrame([(1, "cats", 2), (1, "cat", 1), (2, "ran", 4)], "doc long, term string, n long")
    assert sorted(map(tuple, lemmas.lemma_counts(counts, table, "doc").collect())) == [(1, "cat", 3), (2, "run", 4)]


def test_stop_list_has_the_stems_of_contractions():
    assert {"didn", "isn", "wasn", "weren", "couldn", "hasn", "ain", "ll", "ve"} <= set(lexicon.ALL_STOP_WORDS) and "also" not in lexicon.ALL_STOP_WORDS
    assert len(lexicon.STOP_WORDS) == len(set(lexicon.STOP_WORDS))


def test_mutual_information_with_absent_documents(spark):
    rng = np.random.default_rng(3)
    labels = {d: int(rng.integers(0, 3)) for d in range(90)}
    rows = [(d, t, float(w)) for d in labels for t, p in (("often", 0.9), ("rare", 0.1), (f"own{labels[d]}", 0.8)) for w in [rng.random()] if rng.random() < p]
    rows += [(0, "heavy", 7.5), (1, "zero", 0.0), (2, "edge", 0.1), (3, "edge", 0.2)]
    weights = spark.createDataFrame(rows, "doc long, term string, weight double").repartition(4)
    clusters = spark.createDataFrame(list(labels.items()), "doc long, label int")
    got = {r.term: r.score for r in T.mutual_information(weights, clusters, "doc", "label", 10).collect()}
    sizes = Counter(labels.values())
    for term in {t for _, t, w in rows if w > 0}:
        held = {d: min(10, math.ceil(w * 10)) for d, t, w in rows if t == term}
        cells = Counter((held.get(d, 0), c) for d, c in labels.items())
        bins = Counter(held.get(d, 0) for d in labels)
        want = sum(n / 90 * math.log(n * 90 / (bins[b] * sizes[c])) for (b, c), n in cells.items())
        assert got[term] == pytest.approx(want, abs=1e-10), term
    assert "zero" not in got and got["own1"] > got["rare"]


def loop_as_of(rows, facts, lags, keyed):
    out = []
    for name, key, at in rows:
        found = []
        for series, lag in lags.items():
            known = [] if at is None or key is None else [
                (dt.datetime.combine(t.date(), dt.time()) + dt.timedelta(days=lag), t, v) for s, k, t, v in facts if s == series and v is not None and t is not None and k is not None and (not keyed or k == key)
            ]
            past = [x for x in known if x[0] <= at] if known else []
            found.append(max(past)[2] if past else None)
        out.append((name, *found))
    return sorted(out, key=str)


@pytest.mark.parametrize("keyed", [True, False])
def test_as_of_against_loops_with_a_key_of_most_rows(spark, keyed):
    rng = np.random.default_rng(6)
    start = dt.datetime(2020, 1, 1)
    when = lambda: start + dt.timedelta(hours=int(rng.integers(0, 24 * 200)))
    key = lambda: "hot" if rng.random() < 0.7 else str(rng.choice(["a", "b", "c"]))
    rows = [(i, key(), when()) for i in range(900)] + [(1000, "hot", None), (1001, "none", start), (1002, "hot", start - dt.timedelta(days=9)), (1002, "hot", start - dt.timedelta(days=9))]
    if keyed:
        rows.append((1003, None, when()))
    facts = [(str(rng.choice(["fast", "slow"])), key(), when(), float(rng.random())) for _ in range(60)]
    facts += [("fast", "hot", None, 1.0), ("slow", "hot", when(), None), ("slow", None, when(), 3.0)][: 3 if keyed else 2] + [("fast", "hot", start, 5.0), ("fast", "hot", start, 6.0), ("fast", "hot", start + dt.timedelta(hours=3), 2.0), ("other", "hot", start, 9.0)]
    lags = {"fast": 1, "slow": 20}
    left = spark.createDataFrame(rows, "name long, key string, at timestamp_ntz").repartition(5)
    right = spark.createDataFrame(facts, "series string, key string, at timestamp_ntz, value double").repartition(3)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = asof.as_of(left, right, "at", lags, "key" if keyed else None)
        assert sorted(((r.name, r.fast, r.slow) for r in got.collect()), key=str) == loop_as_of(rows, facts, lags, keyed)
        assert asof.as_of(left.where("name = -1"), right, "at", lags, "key").count() == 0
        assert {(r.fast, r.slow) for r in asof.as_of(left, right.where("series = ''"), "at", lags, "key").collect()} == {(None, None)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_a_later_value_is_never_seen(spark):
    rows = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(60)], "name long, at timestamp_ntz")
    facts = spark.createDataFrame([("cpi", dt.datetime(2024, 1, 1) + dt.timedelta(days=10 * i), float(i)) for i in range(6)], "series string, at timestamp_ntz, value double")
    planted = facts.union(spark.createDataFrame([("cpi", dt.datetime(2024, 1, 31), -99.0)], facts.schema))
    got, again = ({r.name: r.cpi for r in asof.as_of(rows, f, "at", {"cpi": 5}).collect()} for f in (facts, planted))
    assert all(got[i] == again[i] for i in range(35)) and again[35] in (-99.0, 3.0) and got[35] == 3.0 and got[34] == 2.0
    seen = defaultdict(list)
    for i, v in got.items():
        seen[v].append(i)
    assert min(seen[1.0]) == 15 and seen[None] == list(range(5))

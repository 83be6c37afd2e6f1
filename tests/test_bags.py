"""Terms counted in Arrow batches, and weights that stay in their document's row."""

from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.operators import vocabulary as T
from newsloom.plans import topics
from newsloom.plans.corpus import smooth

ODD = [
    None, "", "a b", "Kelvin Kİ ẞ naïve space wide café", "<b>bold</b>TEXT < open www.x.com/Y?z http://a.b/c,d(e) me@home.org @ x@y@z",
    "tab\tline\nform\ffeed\x0bvert\rreturn end", "the The THE thethe market market_share rally-rally", "x" * 50 + " " + "Y" * 60, "<" * 30 + " mixed\U0001f600emoji words here",
]


def _docs(spark):
    long = [(f"{ODD[i % len(ODD)] or ''} " + "rising prices met falling demand across several markets ") * (i % 7) for i in range(40)]
    return spark.createDataFrame(list(enumerate([*ODD, *long])), "doc_id long, text string")


def test_counts_equal_those_of_expressions(spark):
    docs = _docs(spark)
    for chars, tokens in ((100, 30), (0, 1)):
        want = T.term_counts(T.bags(docs, "text", chars, tokens), "doc_id", "all_terms")
        found = T.long_counts(T.counted_bags(docs, "doc_id", "text", chars, tokens), "doc_id")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_cleaned_words_are_those_of_the_expression(spark):
    want = _docs(spark).select(X.clean_basic(F.col("text")).alias("c"), F.col("text").cast("binary").alias("raw")).collect()
    assert [" ".join(w.decode() for w in X.cleaned_words(r["raw"])) for r in want] == [r["c"] for r in want]


def test_weights_in_rows_equal_joined_ones(spark):
    bags = T.counted_bags(_docs(spark), "doc_id", "text", 0, 1).localCheckpoint()
    counts, n = T.long_counts(bags, "doc_id"), bags.count()
    totals = T.term_totals(counts)
    row = lambda r: (r["doc_id"], r["term"], round(r["weight"], 9))
    want = sorted(map(row, T.tfidf_smooth(counts, totals, n, "doc_id", 2, 0.9).collect()))
    found = T.weighted_bags(bags, totals, n, "doc_id", 2, 0.9)
    assert sorted(map(row, T.long_weights(found, "doc_id").collect())) == want
    assert T.weighted_bags(bags, totals, n, "doc_id", 2, 0.9, most_bytes=10) is None  # joins take over
    vocab = T.vocabulary(totals, n, 0, 0, 12)
    want = sorted(map(tuple, T.document_term_matrix(counts, vocab, "doc_id").collect()))
    rows = T.indexed_bags(bags, vocab, "doc_id").collect()
    assert sorted((r["doc_id"], t, int(c)) for r in rows for t, c in zip(r["terms"], r["counts"])) == want
    assert all(r["terms"] == sorted(r["terms"]) for r in rows)


def test_weights_and_clusters_move_no_terms(spark, sf):
    """Every weight was shuffled by document, and again to meet its cluster."""
    assert "Exchange" not in smooth(spark, sf)._jdf.queryExecution().executedPlan().toString()
    weights, _ = topics.described(spark, sf)
    assert "label" in weights.columns and "Exchange" not in weights._jdf.queryExecution().executedPlan().toString()

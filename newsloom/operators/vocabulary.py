"""Vocabulary, document-term tables and term weights, all in long form."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import lexicon as L
from newsloom.functions import text as X
from newsloom.operators.lineage import cut_lineage, written


def with_terms(docs: DataFrame, text_col: str, min_chars: int = 100, min_tokens: int = 30) -> DataFrame:
    """``cleaned_text``, ``tokens``, ``bigrams`` and ``all_terms`` of the documents that are long enough."""
    rows = docs.where(F.length(text_col) >= min_chars).withColumn("cleaned_text", X.clean_basic(F.col(text_col)))
    rows = rows.withColumn("tokens", X.tokens(F.col("cleaned_text"))).where(F.size("tokens") >= min_tokens)
    return rows.withColumn("bigrams", X.ngrams(F.col("tokens"))).withColumn("all_terms", F.concat("tokens", "bigrams"))


def bags(docs: DataFrame, text_col: str, min_chars: int = 100, min_tokens: int = 30) -> DataFrame:
    """``docs`` with ``all_terms`` as ``with_terms`` makes them, null where a document is too short.

    For what explodes the terms at once: a filter on the tokens would be pushed down and clean every text twice.
    """
    rows = docs.where(F.length(text_col) >= min_chars).withColumn("tokens", X.tokens(X.clean_basic(F.col(text_col))))
    return rows.withColumn("all_terms", F.when(F.size("tokens") >= min_tokens, F.concat("tokens", X.ngrams(F.col("tokens"))))).drop("tokens")


def english(docs: DataFrame, language_col: str = "language") -> DataFrame:
    """English rows, and those whose language is empty or unknown."""
    c = F.col(language_col)
    return docs.where(c.isNull() | c.isin("en", "english", "EN", ""))


def term_rows(docs: DataFrame, *keys: str, terms: str | Column) -> DataFrame:
    """``keys`` and ``term``, a row for each of a document's terms that is not null.

    A plain ``explode`` has the optimiser test the array's size beneath it, where the expressions behind the array are
    evaluated again for every mention (27 seconds instead of 6 on 10,000 documents, measured); the outer one has not.
    """
    return docs.select(*keys, F.explode_outer(terms).alias("term")).where(F.col("term").isNotNull())


def runs(terms: Column) -> Column:
    """Distinct terms of an array with their number, ``array<struct<term, n>>``: sorted, and cut where the term changes."""

    def starts(t: Column) -> Column:
        before = F.slice(F.concat(F.array(F.lit(None).cast("string")), t), 1, F.size(t))
        changed = F.zip_with(t, before, lambda a, b: F.struct(a.alias("term"), (b.isNull() | (a != b)).alias("new")))
        placed = F.transform(changed, lambda x, i: F.when(x["new"], F.struct(x["term"].alias("term"), i.alias("at"))))
        return F.struct(F.filter(placed, lambda p: p.isNotNull()).alias("at"), F.size(t).alias("end"))

    def sizes(s: Column) -> Column:
        behind = F.concat(F.slice(s["at"], 2, F.size(s["at"])), F.array(F.struct(F.lit("").alias("term"), s["end"].alias("at"))))
        # of an empty array nothing is behind, and the end is cut off
        return F.zip_with(s["at"], F.slice(behind, 1, F.size(s["at"])), lambda a, b: F.struct(a["term"].alias("term"), (b["at"] - a["at"]).cast("long").alias("n")))

    return X.once(X.once(F.sort_array(F.array_compact(terms)), starts), sizes)


def term_counts(docs: DataFrame, doc: str, terms: str) -> DataFrame:
    """``(doc, term, n)``: the bag of words of every document, counted in its row; a document id stands for one row."""
    bag = F.when(F.col(terms).isNotNull(), runs(F.col(terms)))
    return docs.select(doc, F.explode_outer(bag).alias("e")).where(F.col("e").isNotNull()).select(doc, "e.term", "e.n")


def counted_bags(docs: DataFrame, doc: str, text: str, min_chars: int = 100, min_tokens: int = 30, stop_words: Sequence[str] = L.ALL_STOP_WORDS) -> DataFrame:
    """``(doc, terms array<string>, counts array<int>)``: what ``bags`` and ``term_counts`` find, a row a document.

    The same cleaning, tokens and bigrams in one pass over Arrow batches: several times faster than array expressions.
    Documents that are too short have no row.
    """
    schema = docs.select(doc).schema.add("terms", T.ArrayType(T.StringType())).add("counts", T.ArrayType(T.IntegerType()))
    stop = frozenset(w.encode() for w in stop_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                kept, sizes, terms, counts = [], [0], [], []
                for i, value in enumerate(part.column(1).cast(pa.binary()).to_pylist()):
                    tokens = [w for w in X.cleaned_words(value) if len(w) >= 3 and w not in stop]
                    if len(tokens) >= min_tokens:
                        found = Counter(tokens)
                        found.update(map(b"_".join, zip(tokens, islice(tokens, 1, None))))
                        kept.append(i)
                        terms += found
                        counts += found.values()
                        sizes.append(len(terms))
                ends = pa.array(sizes, pa.int32())
                arrays = [pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept, pa.int64())), *arrays], names=schema.names)

    return docs.where(F.length(text) >= min_chars).select(doc, text).mapInArrow(run, schema)


def long_counts(bags: DataFrame, *keys: str) -> DataFrame:
    """``(keys, term, n)`` of ``counted_bags``."""
    return bags.select(*keys, F.explode(F.arrays_zip("terms", "counts")).alias("e")).select(*keys, F.col("e.terms").alias("term"), F.col("e.counts").cast("long").alias("n"))


def _lists(array: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The row of each item, and the items."""
    return np.repeat(np.arange(len(array)), np.diff(array.offsets.to_numpy())), array.flatten()


def _ends(rows: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), pa.int32())


def indexed_bags(bags: DataFrame, vocab: DataFrame, doc: str) -> DataFrame:
    """``(doc, terms array<int>, counts array<double>)``: the vocabulary's terms by their index, ascending; the vocabulary is capped.

    Documents without such a term have no row.
    """
    table = vocab.select("term", F.col("index").cast("int").alias("index")).toArrow().combine_chunks()
    sent = bags.sparkSession.sparkContext.broadcast(table)
    schema = bags.select(doc).schema.add("terms", T.ArrayType(T.IntegerType())).add("counts", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, index = sent.value["term"].combine_chunks(), sent.value["index"].to_numpy()
        for batch in batches:
            rows, terms = _lists(batch.column(1))
            at = pc.index_in(terms, value_set=known)
            some = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            rows, places = rows[some], index[at.take(pa.array(some)).to_numpy()] if len(some) else np.empty(0, np.int32)
            order = np.lexsort((places, rows))
            rows, places, counts = rows[order], places[order], batch.column(2).flatten().to_numpy()[some][order].astype(float)
            has, own = np.unique(rows, return_inverse=True)
            ends = _ends(own, len(has))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(has)), pa.ListArray.from_arrays(ends, pa.array(places, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(counts))], names=schema.names)

    return bags.select(doc, "terms", "counts").mapInArrow(run, schema)


def weighted_bags(bags: DataFrame, totals: DataFrame, n_docs: int, doc: str, min_df: int = 1, max_df: float = 1.0, most_bytes: int = 64 << 20) -> DataFrame | None:
    """``(doc, terms array<string>, weights array<double>)`` as ``tfidf_smooth`` weighs them, a row a document, nothing shuffled.

    The terms and their df are broadcast; None where they are larger than ``most_bytes`` (16 bytes a row and the terms' own).
    """
    kept = totals.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs)).select("term", F.col("df").cast("int").alias("df"))
    if (kept.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0) > most_bytes:
        return None
    sent = bags.sparkSession.sparkContext.broadcast(kept.toArrow().combine_chunks())
    schema = bags.select(doc).schema.add("terms", T.ArrayType(T.StringType())).add("weights", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf = sent.value["term"].combine_chunks(), np.log((1.0 + n_docs) / (1 + sent.value["df"].to_numpy())) + 1
        for batch in batches:
            rows, terms = _lists(batch.column(1))
            at = pc.index_in(terms, value_set=known)
            some = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            if not len(some):
                continue
            rows, terms = rows[some], terms.take(pa.array(some))
            w = batch.column(2).flatten().to_numpy()[some] * idf[at.take(pa.array(some)).to_numpy()]
            w /= np.sqrt(np.bincount(rows, w * w, batch.num_rows))[rows]
            has, own = np.unique(rows, return_inverse=True)
            ends = _ends(own, len(has))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(has)), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(w))], names=schema.names)

    return bags.select(doc, "terms", "counts").mapInArrow(run, schema)


def long_weights(weighted: DataFrame, *keys: str) -> DataFrame:
    """``(keys, term, weight)`` of ``weighted_bags``."""
    return weighted.select(*keys, F.explode(F.arrays_zip("terms", "weights")).alias("e")).select(*keys, F.col("e.terms").alias("term"), F.col("e.weights").alias("weight"))


def term_totals(counts: DataFrame) -> DataFrame:
    """``(term, count, df)`` from ``(doc, term, n)``: each document has a term once, so rows count documents."""
    return counts.groupBy("term").agg(F.sum("n").alias("count"), F.count("*").alias("df"))


def vocabulary(totals: DataFrame, n_docs: int, unigram_share: float = 0.001, bigram_share: float = 0.0005, size: int = 20_000, by: str = "count") -> DataFrame:
    """``(term, index, count)``: terms at or above ``int(share * n_docs)`` in ``by`` ("count" or "df"), the most frequent ones.

    The cap is the feature; the limit is a top-k, merged from the partitions' own.
    """
    least = F.when(F.col("term").contains("_"), math.floor(bigram_share * n_docs)).otherwise(math.floor(unigram_share * n_docs))
    top = totals.where(F.col(by) >= least).orderBy(F.desc("count"), "term").limit(size)
    return top.withColumn("index", F.row_number().over(W.orderBy(F.desc("count"), "term")) - 1).select("term", "index", "count")


def document_term_matrix(counts: DataFrame, vocab: DataFrame, doc: str) -> DataFrame:
    """``(doc, col_idx, count)`` of the vocabulary's terms; the vocabulary is capped, so it may be broadcast."""
    return counts.join(F.broadcast(vocab.select("term", F.col("index").alias("col_idx"))), "term").select(doc, "col_idx", F.col("n").alias("count"))


def row_index(docs: DataFrame, order: list[str]) -> DataFrame:
    """``docs`` with a dense ``row_idx`` from 0 in a total order.

    Range partitions are numbered each for itself and shifted by the sizes of those before, so no task sees all rows.
    """
    numbered = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    dealt = cut_lineage(numbered)  # it is read twice, and must be dealt out alike
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("n"))
    starts = sizes.select("__p", F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    mask = (1 << 33) - 1
    return dealt.join(F.broadcast(starts), "__p").withColumn("row_idx", F.col("before") + F.col("__i").bitwiseAND(F.lit(mask))).drop("__p", "__i", "before")


def matrix_stats(counts: DataFrame, n_docs: DataFrame, n_terms: DataFrame) -> DataFrame:
    """``(nnz, sparsity, terms_per_doc, docs_per_term)``; the frames have one row and column each."""
    facts = counts.agg(F.count("*").alias("nnz")).crossJoin(n_docs.toDF("d")).crossJoin(n_terms.toDF("t"))  # three single rows
    return facts.select(
        "nnz", (1 - F.try_divide(F.col("nnz"), F.col("d") * F.col("t"))).alias("sparsity"),
        F.try_divide("nnz", "d").alias("terms_per_doc"), F.try_divide("nnz", "t").alias("docs_per_term"),
    )


def small_terms(terms: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """``terms`` (read from a checkpoint), marked for broadcast if its measured size, 64 bytes a row and the terms' own, is small."""
    size = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    return F.broadcast(terms) if size <= most_bytes else terms


def tfidf_plain(counts: DataFrame, totals: DataFrame, n_docs: int, doc: str) -> DataFrame:
    """``(doc, term, weight)``: n / length * ln(N / (df + 1)), which is negative for a term of every document."""
    length = F.sum("n").over(W.partitionBy(doc))
    return counts.withColumn("length", length).join(small_terms(totals.select("term", "df")), "term").select(doc, "term", (F.col("n") / F.col("length") * F.ln(F.lit(float(n_docs)) / (F.col("df") + 1))).alias("weight"))


def df_range(totals: DataFrame, n_docs: int, low: float = 0.001, high: float = 0.95) -> DataFrame:
    """Terms with low <= df / N <= high."""
    share = F.col("df") / n_docs
    return totals.where((share >= low) & (share <= high))


def tfidf_smooth(counts: DataFrame, totals: DataFrame, n_docs: int, doc: str, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """``(doc, term, weight)``: n * (ln((1 + N) / (1 + df)) + 1), rows scaled to length one.

    Terms with ``min_df <= df <= max_df * N``; of these the ``max_features`` most frequent ones (a top-k).
    """
    kept = totals.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if max_features is not None:
        kept = F.broadcast(kept.orderBy(F.desc("count"), "term").limit(max_features))
    kept = kept.select("term", "df")
    raw = counts.join(kept if max_features is not None else small_terms(kept), "term").withColumn("w", F.col("n") * (F.ln((1.0 + n_docs) / (1 + F.col("df"))) + 1))
    return raw.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(doc)))).select(doc, "term", "weight")


def tfidf_past(counts: DataFrame, doc: str, year: str) -> DataFrame:
    """``(doc, term, weight)`` with document frequencies of earlier years only; the first year uses its own.

    ``counts`` has ``(doc, year, term, n)``. Frequencies per term and year are summed up over the years, so nothing is
    joined by range.
    """
    per_year = counts.groupBy("term", year).agg(F.count("*").alias("d"))
    docs_year = counts.select(doc, year).distinct().groupBy(year).agg(F.count("*").alias("n_docs"))
    raw = past_counts(counts, per_year, docs_year, year)
    return raw.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(doc)))).select(doc, year, "term", "weight")


def past_counts(counts: DataFrame, per_year: DataFrame, docs_year: DataFrame, year: str) -> DataFrame:
    """``counts`` with ``w``, the weights of ``tfidf_past`` before they are scaled; ``per_year(term, year, d)``, ``docs_year(year, n_docs)``."""
    before = W.orderBy(year).rowsBetween(W.unboundedPreceding, -1)
    sizes = docs_year.withColumn("past_docs", F.coalesce(F.sum("n_docs").over(before), F.col("n_docs")))
    first = docs_year.agg(F.min(year).alias("first_year"))
    years = F.broadcast(docs_year.select(F.col(year).alias("y")))  # a row a year
    spread = per_year.join(years, F.col("y") > F.col(year)).groupBy("term", "y").agg(F.sum("d").alias("past_df"))
    own = per_year.join(F.broadcast(first), F.col(year) == F.col("first_year")).select("term", F.col(year).alias("y"), F.col("d").alias("past_df"))
    table = spread.unionByName(own).withColumnRenamed("y", year)
    raw = counts.join(table, ["term", year]).join(F.broadcast(sizes.select(year, "past_docs")), year)
    return raw.withColumn("w", F.col("n") * (F.ln((1.0 + F.col("past_docs")) / (1 + F.col("past_df"))) + 1))


def top_terms(weights: DataFrame, group: str, n: int = 20, weight: str = "weight") -> DataFrame:
    """The n heaviest terms of each group with their rank, ties by term."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc(weight), "term"))
    return weights.withColumn("rank", rank).where(F.col("rank") <= n)


def _in_clusters(weights: DataFrame, clusters: DataFrame, doc: str, cluster: str) -> DataFrame:
    """``weights`` with their document's cluster, which they may have already."""
    return weights if cluster in weights.columns else weights.join(clusters, doc)


def cluster_means(weights: DataFrame, clusters: DataFrame, doc: str, cluster: str) -> DataFrame:
    """``(cluster, term, weight)``: the mean over all documents of a cluster, absent terms counting as zero."""
    sizes = clusters.groupBy(cluster).agg(F.count("*").alias("size"))
    sums = _in_clusters(weights, clusters, doc, cluster).groupBy(cluster, "term").agg(F.sum("weight").alias("s"))
    return sums.join(F.broadcast(sizes), cluster).select(cluster, "term", (F.col("s") / F.col("size")).alias("weight"))


def chi2(weights: DataFrame, clusters: DataFrame, doc: str, cluster: str) -> DataFrame:
    """``(term, score)``: sum over clusters of (observed - expected)^2 / expected for the terms' summed weights.

    A cluster without the term adds its expectation: the sums over present clusters are completed from the totals.
    """
    total = clusters.agg(F.count("*").alias("docs"))
    share = clusters.groupBy(cluster).agg(F.count("*").alias("size")).crossJoin(total).select(cluster, (F.col("size") / F.col("docs")).alias("p"))  # one row a cluster
    observed = _in_clusters(weights, clusters, doc, cluster).groupBy("term", cluster).agg(F.sum("weight").alias("o")).join(F.broadcast(share), cluster)
    sums = observed.groupBy("term").agg(F.sum("o").alias("s"), F.sum(F.col("o") * F.col("o") / F.col("p")).alias("q"))
    # sum (o - ps)^2 / (ps) = sum o^2 / (ps) - 2 s + s over all clusters, as their shares sum to one
    return sums.select("term", (F.col("q") / F.col("s") - F.col("s")).alias("score"))


def mutual_information(weights: DataFrame, clusters: DataFrame, doc: str, cluster: str, bins: int = 10) -> DataFrame:
    """``(term, score)``: mutual information, in nats, of a term's binned weight and the cluster, over all documents.

    A weight in (0, 1] is in the bin ``ceil(weight * bins)``, larger ones in the last; a document without the term, or
    with no positive weight of it, is in bin 0. Those are never made as rows: their numbers by cluster are what the
    present ones leave of the clusters' sizes. ``clusters`` has a row a document.
    """
    sizes = clusters.groupBy(cluster).agg(F.count("*").alias("size"))  # one row a cluster
    total = sizes.agg(F.sum("size").alias("docs"))  # one number
    bin_ = F.least(F.lit(bins), F.ceil(F.col("weight") * bins)).cast("int")
    # read several times below
    cells = written(_in_clusters(weights.where("weight > 0"), clusters, doc, cluster).groupBy("term", cluster, bin_.alias("bin")).agg(F.count("*").alias("n")), "cells")
    # by cluster: what is there, and by subtraction what is not
    there = cells.groupBy("term", cluster).agg(F.sum("n").alias("here"))
    p = lambda n: F.when(n > 0, n / F.col("docs") * F.ln(n / F.col("docs"))).otherwise(0.0)

    def entropy_sum(frame: DataFrame, n: Column, *keys: str) -> DataFrame:
        return frame.crossJoin(F.broadcast(total)).groupBy(*keys).agg(F.sum(p(n)).alias("h"))

    joint = entropy_sum(cells, F.col("n"), "term")
    by_bin = entropy_sum(cells.groupBy("term", "bin").agg(F.sum("n").alias("n")), F.col("n"), "term")
    # bin 0: clusters with the term lose what is there, others keep their size
    sized = there.join(F.broadcast(sizes), cluster).crossJoin(F.broadcast(total))
    absent = sized.groupBy("term").agg(F.sum(p(F.col("size") - F.col("here")) - p(F.col("size"))).alias("moved"), F.sum("here").alias("here"))
    all_sizes = entropy_sum(sizes, F.col("size")).select(F.col("h").alias("clusters"))
    rows = absent.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(all_sizes)).join(joint.withColumnRenamed("h", "joint"), "term").join(by_bin.withColumnRenamed("h", "bins"), "term")
    # sum p ln p of the cells, less that of the bins, less that of the clusters
    absent_cells, absent_bin = F.col("clusters") + F.col("moved"), p(F.col("docs") - F.col("here"))
    return rows.select("term", F.greatest(F.lit(0.0), F.col("joint") + absent_cells - F.col("bins") - absent_bin - F.col("clusters")).alias("score"))


def pmi_pairs(counts: DataFrame, top: DataFrame, doc: str, group: str, n_docs: int) -> DataFrame:
    """``(group, a, b, pmi)`` of top terms of one group that occur together; ``top`` is small before anything is paired."""
    named = top.select(group, "term")
    held = counts.join(F.broadcast(named.select("term").distinct()), "term").select(doc, "term")
    p = held.groupBy("term").agg((F.count("*") / n_docs).alias("p"))
    terms = held.groupBy(doc).agg(F.sort_array(F.collect_set("term")).alias("ts"))  # at most as many as there are top terms
    pairs = terms.select(F.explode("ts").alias("a"), "ts").select("a", F.explode("ts").alias("b")).where("a < b").groupBy("a", "b").agg((F.count("*") / n_docs).alias("pij"))
    a, b = named.withColumnRenamed("term", "a"), named.withColumnRenamed("term", "b")
    mine = a.join(b, group).where("a < b").join(pairs, ["a", "b"])
    rows = mine.join(p.toDF("a", "pa"), "a").join(p.toDF("b", "pb"), "b")
    return rows.select(group, "a", "b", F.ln(F.col("pij") / (F.col("pa") * F.col("pb") + 1e-10) + 1e-10).alias("pmi"))

"""Topic description, guided topics and coherence."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import lexicon as L
from newsloom.functions import text as X
from newsloom.operators import guided as G
from newsloom.operators import readout as O
from newsloom.operators import vocabulary as T
from newsloom.operators import words as D
from newsloom.operators.lineage import written
from newsloom.plans.corpus import COUNTS, GARBAGE, N_DOCS, SMOOTH, TOKENS, VOCAB, cleaned, texts, vocabulary_of, weighed
from newsloom.plans.registry import plan
from newsloom.sources.readers import table

CLUSTERS = "(select vec_id as doc_id, label from embeddings)"
W = f"(select w.doc_id, term, weight, label from {SMOOTH} w join {CLUSTERS} c on w.doc_id = c.doc_id)"


def clusters(spark, folder):
    """The vectors' labels as clusters of the processed documents that have one."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")


def labelled(spark, folder, found):
    """Words of the documents in a cluster, with its ``label``; documents meet their clusters as whole rows."""
    of = clusters(spark, folder)
    few = of.count() <= 1 << 21  # numbers alone, so 50 MB at most are broadcast
    return written(found.join(of.hint("broadcast" if few else "shuffle_hash"), "doc_id"), "words")


def described(spark, folder, found=None):
    """Weights of documents in a cluster with its ``label``, written once, and those clusters."""
    found = texts(spark, folder) if found is None else found
    weights = written(weighed(found, labelled(spark, folder, found), "label"), "weights")
    return weights, weights.select("doc_id", "label").distinct()


def summed(weights):
    """Weights of ``described`` as their sums by term and label: what chi-squared scores and means are taken from."""
    return written(weights.groupBy("term", "label").agg(F.sum("weight").alias("weight")), "sums")


_IN = f"(select distinct doc_id, label from {W})"
_CHI = f"""(select term, sum(o * o / p) / sum(o) - sum(o) as score from (select term, label, sum(weight) as o from {W} group by all)
    join (select label, count(*) / (select count(*) from {_IN}) as p from {_IN} group by label) using (label) group by term)"""


@plan(f"select term, round(score, 6) as score from {_CHI}")
def chi2_terms(spark, folder):
    weights, inside = described(spark, folder)
    return T.chi2(weights, inside, "doc_id", "label").select("term", F.round("score", 6).alias("score"))


_MI = f"""(with inside as (select doc_id, label from {_IN}), docs as (select count(*) as docs from inside), sizes as (select label, count(*) as size from inside group by label),
    cells as (select term, label, cast(least(10, ceil(weight * 10)) as integer) as bin, count(*) as n from {W} where weight > 0 group by all),
    filled as (select term, label, bin, n from cells union all select t.term, s.label, 0, size - coalesce(h.n, 0) from (select distinct term from cells) t cross join sizes s
        left join (select term, label, sum(n) as n from cells group by all) h on t.term = h.term and s.label = h.label),
    b as (select term, bin, sum(n) as nb from filled group by all)
    select term, sum(case when f.n > 0 then f.n / docs * ln(f.n * docs / (nb * size)) else 0 end) as score from filled f join b using (term, bin) join sizes using (label), docs group by term)"""


@plan(f"select term, round(score, 6) as score from {_MI}")
def mutual_information_terms(spark, folder):
    weights, inside = described(spark, folder)
    return T.mutual_information(weights, inside, "doc_id", "label").select("term", F.round("score", 6).alias("score"))


_MI_KEPT = f"(select term from {_MI} where not {GARBAGE} and round(score, 9) >= (select quantile_cont(round(score, 9), 0.5) from {_MI} where not {GARBAGE}))"


@plan(f"""select cast(label as integer) as label, cast(rank as integer) as rank, term, round(weight, 6) as weight from
    (select *, row_number() over (partition by label order by round(weight, 9) desc, term) as rank from
    (select label, term, sum(weight) / any_value(size) as weight from {W} join (select label, count(*) as size from {_IN} group by label) using (label) group by label, term) where term in (select term from {_MI_KEPT})) where rank <= 20""")
def cluster_top_terms_by_information(spark, folder):
    """The best terms of each cluster that are no garbage and say at least as much about the clusters as the median term."""
    weights, inside = described(spark, folder)
    scores = written(T.mutual_information(weights, inside, "doc_id", "label"), "scores")
    scores = written(scores.where(~X.garbage_term(F.col("term"))).withColumn("score", F.round("score", 9)), "scores")
    limit = scores.agg(F.percentile("score", F.lit(0.5)).alias("limit"))
    kept = scores.crossJoin(F.broadcast(limit)).where("score >= limit").select("term")  # the limit is one number
    means = T.cluster_means(weights, inside, "doc_id", "label").join(kept, "term", "left_semi").withColumn("weight", F.round("weight", 9))
    return T.top_terms(means, "label", 20).select("label", "rank", "term", F.round("weight", 6).alias("weight"))


_MEAN = f"(select label, term, sum(weight) / any_value(size) as weight from {W} join (select label, count(*) as size from {_IN} group by label) using (label) group by label, term)"
_KEPT = f"(select term from {_CHI} where not {GARBAGE} and score >= (select quantile_cont(score, 0.5) from {_CHI} where not {GARBAGE}))"
_RANKED = f"(select *, row_number() over (partition by label order by round(weight, 9) desc, term) as rank from {_MEAN} where term in (select term from {_KEPT}))"


def descriptors(spark, folder, n: int = 20, found=None):
    """The best terms of each cluster that are no garbage and pass the chi-squared median."""
    weights, inside = described(spark, folder, found)
    inside = written(inside, "inside")  # read for sizes twice
    weights = summed(weights)
    # written before terms are judged: the filter would be taken beneath the sums, for every cluster of a term, and for each reading
    scores = written(written(T.chi2(weights, inside, "doc_id", "label"), "scores").where(~X.garbage_term(F.col("term"))), "scores")
    limit = scores.agg(F.percentile("score", F.lit(0.5)).alias("limit"))
    kept = scores.crossJoin(F.broadcast(limit)).where("score >= limit").select("term")  # the limit is one number
    means = T.cluster_means(weights, inside, "doc_id", "label").join(kept, "term", "left_semi").withColumn("weight", F.round("weight", 9))
    return T.top_terms(means, "label", n)


@plan(f"select cast(label as integer) as label, cast(rank as integer) as rank, term, round(weight, 6) as weight from {_RANKED} where rank <= 20")
def cluster_top_terms(spark, folder):
    return descriptors(spark, folder).select("label", "rank", "term", F.round("weight", 6).alias("weight"))


@plan(f"""select cast(label as integer) as label, array_to_string(case when len(single) >= 3 then single[1:3] else terms[1:3] end, ' / ') as topic_label from
    (select label, list(term order by rank) as terms, list_filter(list(term order by rank), lambda t: not contains(t, ' ')) as single from {_RANKED} where rank <= 20 group by label)""")
def topic_labels(spark, folder):
    lists = descriptors(spark, folder).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    return lists.select("label", X.topic_label(F.col("terms")).alias("topic_label"))


def _named(i, topic, keys):
    hit = " or ".join(f"contains(term, '{k}')" for k in keys)
    return f"(sum(case when {hit} then 1 else 0 end), {-i}, '{topic}')"


@plan(f"""select cast(label as integer) as label, case when best[1] > 0 then best[3] else 'general' end as topic from
    (select label, greatest({", ".join(_named(i, t, k) for i, (t, k) in enumerate(L.CLUSTER_TOPICS.items()))}) as best from {_RANKED} where rank <= 10 group by label)""")
def cluster_names(spark, folder):
    return G.named_clusters(descriptors(spark, folder), "label")


def guided(spark, folder):
    """Guided scores: of the weights only those of terms that hold a part of a keyword are ever rows."""
    parts = sorted({part for _, words in L.GUIDED_TOPICS.values() for word in words for part in word.split()})
    weights = weighed(texts(spark, folder), parts=parts)
    return G.guided_scores(written(weights, "weights"), "doc_id")


_PARTS = ", ".join(f"('{t}', '{p}', {w}::double)" for t, (w, ks) in L.GUIDED_TOPICS.items() for p in sorted({p for k in ks for p in k.split()}))
_GUIDED = f"""(select doc_id, topic, s / sum(s) over (partition by doc_id) as score from (select doc_id, topic, sum(weight * boost) as s from {SMOOTH} w
    join (select distinct term, topic, boost from (select distinct term from {SMOOTH}) t join (values {_PARTS}) k(topic, part, boost) on contains(t.term, part)) m using (term) group by doc_id, topic))"""


@plan(f"select doc_id, topic, round(score, 6) as score from {_GUIDED}")
def guided_topic_scores(spark, folder):
    return guided(spark, folder).select("doc_id", "topic", F.round("score", 6).alias("score"))


_PMI = f"""with top as (select label, term from {_RANKED} where rank <= 10), held as (select distinct doc_id, term from {COUNTS} where term in (select term from top)),
    p as (select term, count(*) / {N_DOCS} as p from held group by term), j as (select a.term as a, b.term as b, count(*) / {N_DOCS} as pij from held a join held b on a.doc_id = b.doc_id and a.term < b.term group by all)
    select x.label, ln(pij / (pa.p * pb.p + 1e-10) + 1e-10) as pmi from top x join top y on x.label = y.label and x.term < y.term join j on j.a = x.term and j.b = y.term
    join p pa on pa.term = j.a join p pb on pb.term = j.b"""


@plan(f"select cast(label as integer) as label, count(*) as pairs, round(avg(pmi), 6) as coherence from ({_PMI}) group by label")
def pmi_coherence(spark, folder):
    found = texts(spark, folder)
    top = written(descriptors(spark, folder, 10, found).select("label", "term"), "top")  # ten terms a cluster
    held = written(D.held_terms(found, top, "doc_id"), "held")
    pairs = T.pmi_pairs(held, top, "doc_id", "label", found.count())
    return pairs.groupBy("label").agg(F.count("*").alias("pairs"), F.round(F.avg("pmi"), 6).alias("coherence"))


@plan(f"""select cast(label as integer) as label, arg_max(term, (n, term)) as term, max(n) as n from (select label, term, count(*) as n from
    (select doc_id, unnest(tokens) as term from {TOKENS}) join {CLUSTERS} using (doc_id) group by all) group by label""")
def commonest_word(spark, folder):
    t = T.term_rows(cleaned(spark, folder), "doc_id", terms=X.tokens(F.col("clean"))).join(clusters(spark, folder), "doc_id")
    n = t.groupBy("label", "term").agg(F.count("*").alias("n"))
    return n.groupBy("label").agg(F.max_by("term", F.struct("n", "term")).alias("term"), F.max("n").alias("n"))


@plan()
def guided_assignment(spark, folder):
    """Clusters to guided topics one to one, with every document's score at its topic (a clusters-by-topics table is fetched)."""
    scores = written(guided(spark, folder), "scores")
    found = clusters(spark, folder)
    means = scores.join(found, "doc_id").groupBy("label", "topic").agg(F.sum("score").alias("s"))
    sizes = found.groupBy("label").agg(F.count("*").alias("n"))
    table_ = [(r["label"], r["topic"], r["s"] / r["n"]) for r in means.join(sizes, "label").collect()]
    chosen = spark.createDataFrame(sorted(G.assign_one_to_one(table_).items()), "label int, topic string")
    docs = found.join(F.broadcast(chosen), "label")
    return docs.join(scores.select("doc_id", "topic", "score"), ["doc_id", "topic"], "left").select("doc_id", "label", "topic", F.coalesce("score", F.lit(0.0)).alias("topic_confidence"))


# a topic-word table that SQL can state as well: term counts of the given clusters over the vocabulary
PHI = f"(select cast(label as integer) as topic, term, cast(sum(n) as double) as weight from {COUNTS} join {CLUSTERS} using (doc_id) where term in (select term from {VOCAB}) group by all)"
_PROBS = f"(select topic, term, weight / sum(weight) over (partition by topic) as weight from {PHI})"
_WORDS = f"(select *, row_number() over (partition by topic order by weight desc, term) as rank from {PHI})"


def phi(spark, folder):
    """Terms' weights by topic, the words of the documents behind them and their number."""
    found, vocab, n = vocabulary_of(spark, folder)
    kept = D.held_terms(labelled(spark, folder, found), vocab, "label")  # the vocabulary is capped
    weights = kept.groupBy(F.col("label").alias("topic"), "term").agg(F.sum("n").cast("double").alias("weight"))
    return written(weights, "phi"), found, n


@plan(f"select topic, term, round(weight, 8) as weight from {_PROBS}")
def phi_probabilities(spark, folder):
    """The topic-word table with rows scaled to probabilities."""
    weights, _, _ = phi(spark, folder)
    return O.probabilities(weights).withColumn("weight", F.round("weight", 8))


@plan(f"select topic, cast(rank as integer) as rank, term from {_WORDS} where rank <= 15")
def phi_top_words(spark, folder):
    weights, _, _ = phi(spark, folder)
    return O.top_words(weights).select("topic", "rank", "term")


@plan(f"select topic, string_agg(term, '_' order by rank) as label from {_WORDS} where rank <= 3 group by topic")
def phi_labels(spark, folder):
    weights, _, _ = phi(spark, folder)
    return O.names(O.top_words(weights, 3))


_PHI_PMI = _PMI.replace(f"top as (select label, term from {_RANKED} where rank <= 10)", f"top as (select topic as label, term from {_WORDS} where rank <= 10)")


@plan(f"select topics, round(coherence, 6) as coherence from (select count(*) as topics, avg(c) as coherence from (select label, avg(pmi) as c from ({_PHI_PMI}) group by label))")
def phi_coherence(spark, folder):
    """Mean coherence of all topics, each by its ten heaviest words."""
    weights, found, n = phi(spark, folder)
    held = D.held_terms(found, O.top_words(weights, 10), "doc_id")
    return O.coherence(held, weights, "doc_id", n).agg(F.count("*").alias("topics"), F.round(F.avg("coherence"), 6).alias("coherence"))

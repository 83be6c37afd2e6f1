"""Keyword-guided topics, cluster naming and one-to-one assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import lexicon as L


def keyword_parts(spark: SparkSession, topics=L.GUIDED_TOPICS) -> DataFrame:
    """``(topic, ord, part, weight)``: the words of all keywords; a fixed, small table."""
    rows = {(topic, i, part, weight) for i, (topic, (weight, words)) in enumerate(topics.items()) for word in words for part in word.split()}
    return spark.createDataFrame(sorted(rows), "topic string, ord int, part string, weight double")


def guided_scores(weights: DataFrame, doc: str, topics=L.GUIDED_TOPICS) -> DataFrame:
    """``(doc, topic, ord, score)``: TF-IDF of terms that hold a part of a keyword, times the topic's weight, by shares.

    Terms are matched once each against the fixed keyword table, not once a document; a document without any match has
    no rows.
    """
    terms = weights.select("term").distinct()
    parts = F.broadcast(keyword_parts(weights.sparkSession, topics))
    matched = terms.join(parts, F.col("term").contains(F.col("part"))).select("term", "topic", "ord", F.col("weight").alias("boost")).distinct()
    raw = weights.join(matched, "term").groupBy(doc, "topic", "ord").agg(F.sum(F.col("weight") * F.col("boost")).alias("raw"))
    return raw.withColumn("score", F.col("raw") / F.sum("raw").over(W.partitionBy(doc))).drop("raw")


def named_clusters(top: DataFrame, cluster: str, topics=L.CLUSTER_TOPICS, words: int = 10) -> DataFrame:
    """``(cluster, topic)``: the topic with the most top words that hold one of its keywords; "general" for none, ties in order."""
    hits = []
    for i, (topic, keys) in enumerate(topics.items()):
        held = F.lit(False)
        for key in keys:
            held = held | F.col("term").contains(key)
        hits.append(F.struct(F.sum(held.cast("int")).alias("n"), F.lit(-i).alias("order"), F.lit(topic).alias("topic")))
    best = top.where(F.col("rank") <= words).groupBy(cluster).agg(F.greatest(*hits).alias("best"))
    return best.select(cluster, F.when(F.col("best.n") > 0, F.col("best.topic")).otherwise("general").alias("topic"))


def assign_one_to_one(means: list[tuple[int, str, float]]) -> dict[int, str]:
    """Greedy: the best remaining pair of a cluster and a topic first; clusters left over take their best topic.

    ``means`` is a table of clusters by topics, at most a hundred numbers.
    """
    out: dict[int, str] = {}
    used: set[str] = set()
    ranked = sorted(means, key=lambda m: (-m[2], m[0], m[1]))
    for cluster, topic, _ in ranked:
        if cluster not in out and topic not in used:
            out[cluster] = topic
            used.add(topic)
    for cluster, topic, _ in ranked:
        out.setdefault(cluster, topic)
    return out

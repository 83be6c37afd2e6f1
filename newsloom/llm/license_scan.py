"""License scans by diagonal voting.

Documents and licence templates (whole texts, their paragraphs, usual statements) are cut into words; every rolling
k-gram of words is hashed and joined to the places where templates have it. A match at document word p and template
word t, confirmed by its words, votes for diagonal p - t. From each diagonal, the votes of its neighbours up to a bounded
drift are merged, so inserted or lost words do not split a find. A merged span is verified by words: so many of the
template's words, and of its own, must stand in confirmed matches; of spans that compete the one with most is reported.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.license_texts import templates

# Phrases whose places count as the base scan, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

TEMPLATES = templates()

GRAM = 3
#: Every ASCII character that ends a word, and A-Z, with what they become.
_FROM = "".join(chr(c) for c in range(0x80) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A))
_TO = "".join(chr(c + 32) if 0x41 <= c <= 0x5A else " " for c in map(ord, _FROM))


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _FROM, _TO), " ", -1), "")


def phrase_places(w: Column, phrase: str) -> Column:
    """Places (words from 0) where the phrase's words stand consecutively."""
    first, *more = phrase.split(" ")
    starts = F.filter(F.transform(w, lambda x, i: F.when(x == first, i)), lambda i: i.isNotNull())
    found = F.filter(starts, lambda i: F.array_join(F.slice(w, i + 1, len(more) + 1), " ") == phrase)
    return F.when(F.array_contains(w, first), found).otherwise(F.array().cast("array<int>"))


def grams(w: Column, k: int = GRAM) -> Column:
    """All rolling k-grams by place: ``struct(gram, words)``, the hash and the words that it stands for."""
    n = F.size(w) - k
    at = lambda i: [F.get(w, i + j) for j in range(k)]
    rolled = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.struct(F.xxhash64(*at(i)).alias("gram"), F.concat_ws(" ", *at(i)).alias("words")))
    return F.when(n >= 0, rolled).otherwise(F.array().cast("array<struct<gram:bigint,words:string>>"))


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = GRAM) -> DataFrame:
    """``(template, label, size, t, gram, said)``: a fixed table, as large as the templates' words; ``size`` counts words."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    w = rows.select("template", "label", words(F.col("text")).alias("w"))
    placed = w.select("template", "label", F.size("w").alias("size"), F.posexplode(grams(F.col("w"), k)).alias("t", "g"))
    return placed.select("template", "label", "size", "t", "g.gram", F.col("g.words").alias("said"))


def _covered(places: Column, k: int = GRAM) -> Column:
    """How many words the k-grams at these places cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct(places), lambda t: F.array(*(t + j for j in range(k)))))))


def spans(keyed: DataFrame, templates: DataFrame, drift: int = 12, coverage: float = 0.7, stretch: float = 1.5) -> DataFrame:
    """``(id, h, first, last, label, score)`` from ``keyed(id, h, w)``.

    ``first`` and ``last`` are the words a span starts and ends with. The span from a diagonal merges those at most
    ``drift`` beyond it. It is reported if confirmed matches cover ``coverage`` of the template's words (its ``score``)
    and ``1 / stretch`` of its own, and no span of the template on diagonals within ``drift`` has more (ties: the
    first diagonal).
    """
    rolled = keyed.select("id", "h", F.posexplode(grams(F.col("w"))).alias("p", "g")).select("id", "h", "p", "g.gram", "g.words")
    votes = rolled.join(F.broadcast(templates), "gram").where(F.col("words") == F.col("said")).withColumn("diagonal", F.col("p") - F.col("t"))
    by_diagonal = votes.groupBy("id", "h", "template", "label", "size", "diagonal").agg(F.collect_set("t").alias("ts"), F.collect_set("p").alias("ps"))
    along = W.partitionBy("id", "h", "template").orderBy("diagonal")
    near = along.rangeBetween(0, drift)
    merged = by_diagonal.select("id", "h", "template", "label", "size", "diagonal", F.flatten(F.collect_list("ts").over(near)).alias("ts"), F.flatten(F.collect_list("ps").over(near)).alias("ps"))
    sized = merged.select(
        "id", "h", "template", "label", "size", "diagonal", _covered(F.col("ts")).alias("votes"), _covered(F.col("ps")).alias("own"), F.array_min("ps").alias("first"), (F.array_max("ps") + (GRAM - 1)).alias("last")
    )
    verified = sized.where((F.col("votes") >= coverage * F.col("size")) & (F.col("own") * stretch >= F.col("last") - F.col("first") + 1))
    rank = F.struct("votes", -F.col("diagonal"))
    best = verified.withColumn("best", F.max(rank).over(along.rangeBetween(-drift, drift)))
    return best.where(rank == F.col("best")).select("id", "h", "first", "last", "label", (F.col("votes") / F.col("size")).alias("score"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, places, spans)`` for every row of ``docs``.

    ``places`` are ``struct(word, label)`` of the base phrases, in order; ``spans`` are ``struct(first, last, label, score)``
    of the voted finds. A null text has no words. Finds belong to (id, text), so repeated rows have the same ones; null
    ids are matched as such; other columns are not read; an empty table gives an empty result.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), words(F.col(text_col)).alias("w"))
    found = spans(keyed, template_grams(docs.sparkSession))
    per_text = found.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct("first", "last", "label", "score"))).alias("spans"))
    def labelled(phrase: str, label: str) -> Column:
        return F.transform(phrase_places(F.col("w"), phrase), lambda i: F.struct(i.alias("word"), F.lit(label).alias("label")))

    places = F.array_sort(F.concat(*(labelled(p, label) for p, label in PHRASES)))
    base = keyed.select("id", "h", F.size("w").cast("long").alias("n_words"), places.alias("places"))
    same = per_text.withColumnsRenamed({"id": "id_", "h": "h_"})
    joined = base.join(same, F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left")
    empty = F.array().cast("array<struct<first:int,last:int,label:string,score:double>>")
    return joined.select(F.col("id").alias(id_col), "n_words", "places", F.coalesce("spans", empty).alias("spans"))

"""Groups of spelling variants by an even-partition pigeonhole join.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word is cut into two
segments whose sizes depend on its length only; one edit leaves one of them whole, so a word of equal length has it at
the same place and a word longer by one has it there or shifted by one. Words are indexed under both segments and probe
with the substrings that may be one.

What a segment leaves of a word is a word of its own that must differ by the one edit, so a bucket with too many words
is divided by the same rule over its rests, again and again. A rest of one code point ends it: there a bucket has no
more words than the alphabet has letters. No bucket is ever met with itself beyond a bound, whatever words share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import join_hot, staged

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: Words that a bucket may have before it is divided; the alphabet has 90 letters (26 and 64), so one left is enough.
BUCKET = 128
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(run: Column) -> Column:
    """A-Z in lower case; other letters stay. ``lower`` does so for text that is ASCII alone, and much faster."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, _UPPER, _LOWER))


def typed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97) -> DataFrame:
    """``(word)`` for every run of every text; where ``every`` divides the crc32 of ``id:run`` one code point is lost.

    A null text has no runs, a null id stands as nothing before the colon.
    """
    prefix = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("prefix")
    runs = docs.select(prefix, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("prefix", "run").cast("binary"))
    lost = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    kept = F.concat(F.substring(F.col("run"), F.lit(1), lost), F.substring(F.col("run"), lost + 2, F.char_length("run")))
    typed = runs.select("prefix", _lowered(F.col("run")).alias("run")).select("run", h.alias("h"))
    return typed.select(F.when(F.col("h") % every == 0, kept).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_size: int = 5, least_count: int = 3) -> DataFrame:
    """``(word, n)``: distinct words of ``least_size`` code points or more that occur ``least_count`` times or more."""
    typed = typed_words(docs, id_col, text_col).where(F.char_length("word") >= least_size)
    return typed.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _halves(rows: DataFrame) -> DataFrame:
    """``(key, word, n, rest, longer)`` one level deeper: the segments of ``rest`` under keys of their own.

    A row with ``longer`` 1 stands for a word that may be one code point longer than those indexed, as is its rest;
    rows with 0 are indexed and probe alike, since a word's own segments are what words of its length have.
    """
    size = F.char_length("rest") - F.col("longer")
    half = F.floor(size / 2).cast("int")

    def part(side: str, segment: Column, rest: Column) -> Column:
        return F.struct(F.concat("key", F.lit("|"), size.cast("string"), F.lit(side), segment).alias("key"), rest.alias("rest"))

    whole = F.char_length("rest")
    left = part("<", F.substring(F.col("rest"), F.lit(1), half), F.substring(F.col("rest"), half + 1, whole))
    right = part(">", F.substring(F.col("rest"), half + F.col("longer") + 1, whole), F.substring(F.col("rest"), F.lit(1), half + F.col("longer")))
    return rows.select("word", "n", "longer", F.explode(F.array(left, right)).alias("p")).select("p.key", "word", "n", "p.rest", "longer")


def one_edit(a: Column, b: Column) -> Column:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    return F.levenshtein(a, b, 1) == 1


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``words(word, n)`` distinct -> staged ``(a, n_a, b, n_b)``: every near pair once, ``a`` the shorter or lesser."""
    probes = F.explode(F.array(F.lit(0), F.lit(1))).alias("longer")
    rows = _halves(words.select("word", "n", F.lit("").alias("key"), F.col("word").alias("rest"), probes).where(F.char_length("rest") > 1 + F.col("longer")))
    found = []
    while True:
        rows = staged(rows, "segments")
        most = rows.count()
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("longer") == 0).alias("own")).where("own > 0 and n > 1")
        met = staged(join_hot(rows.withColumnRenamed("n", "n_word"), staged(sizes, "buckets"), "key", most), "met")
        index = met.where((F.col("longer") == 0) & (F.col("own") <= bucket)).select("key", "n", F.col("word").alias("a"), F.col("n_word").alias("n_a"))
        probe = met.where(F.col("own") <= bucket).select("key", F.col("word").alias("b"), F.col("n_word").alias("n_b"), "longer")
        # of keys that very many words probe, at most a thousand are broadcast with `bucket` words each
        candidates = join_hot(probe, index, "key", most).where((F.col("longer") == 1) | (F.col("a") < F.col("b"))).select("a", "n_a", "b", "n_b")
        found.append(staged(candidates.distinct().where(one_edit(F.col("a"), F.col("b"))), "near"))
        crowded = met.where(F.col("own") > bucket)
        if crowded.isEmpty():
            return staged(reduce(DataFrame.unionByName, found).distinct(), "pairs") if len(found) > 1 else found[0]
        rows = _halves(crowded.select("key", "word", F.col("n_word").alias("n"), "rest", "longer"))


def _roots(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``forms(word, form)`` -> ``(word, root)`` of the words that have a form: the end of the chain of forms.

    Every round doubles the steps taken; ``n`` at least doubles with each step, so chains are short and never rings.
    """
    state = staged(forms.select("word", F.col("form").alias("root")), "roots")
    rows = state.count()
    for _ in range(max_rounds):
        followed = state.groupBy("root").agg(F.count("*").alias("n"))
        onward = staged(followed.join(state.select(F.col("word").alias("root"), F.col("root").alias("next")), "root"), "steps")
        if onward.isEmpty():
            return state
        moved = join_hot(state, onward, "root", rows).select("word", F.col("next").alias("root"))
        state = staged(moved.unionByName(state.join(moved.select("word"), "word", "left_anti")), "roots")
    raise RuntimeError(f"forms did not settle in {max_rounds} rounds")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_size: int = 5, least_count: int = 3, ratio: int = 2, bucket: int = BUCKET) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``: a row for each word of the corpus, see ``vocabulary``.

    ``form`` is the near word with the largest ``n`` (ties: the first in code-point order) if that is at least ``ratio``
    times the word's own, else null; ``root`` is the last word reached by forms, the word itself if it has none;
    ``n_near`` counts its near words. A null or empty text has no words; repeated rows count each; null ids take part;
    an empty table, or one without such words, gives an empty result; other columns are not read. ``bucket`` only moves
    work: results are the same.
    """
    if bucket < 90:
        raise ValueError("a bucket must hold the alphabet's 90 letters")
    words = staged(vocabulary(docs, id_col, text_col, least_size, least_count), "words")
    pairs = near_pairs(words, bucket)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    near = words.join(best, "word", "left")
    strong = -F.col("best.less") >= ratio * F.col("n")
    formed = staged(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(formed.where("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

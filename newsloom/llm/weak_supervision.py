"""Quality rules under weak supervision.

Every rule votes good, bad or abstains on a text's statistics. How often a rule's bad vote is right, and how often it is
wrong, is not given but estimated by expectation-maximisation over the votes of all texts: a text's unknown quality is
the latent class, and rules are independent given it. The posterior probability of the good class takes the place of a
filter that every rule must pass: one bad vote of a rule that errs often weighs little, one of a rule that never fires
among good texts decides.

Statistics, votes and posteriors are column expressions. What leaves the cluster is the number of texts for each
combination of votes, at most three to the power of the rules. DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import staged

#: White space between words, and the characters that count as symbols.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[^#*$%&|<>]+"
WINDOW = 5


def _kept(text: Column, others: str) -> Column:
    """How many code points are left without runs of ``others``."""
    return F.char_length(F.regexp_replace(text, others, "")).cast("long")


def _pairs(array: Column, n: Column, far: int, join) -> Column:
    """``join`` of every element and the one ``far`` places behind it, of an array of ``n``."""
    left = F.greatest(n - far, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), left), F.slice(array, F.lit(far + 1), left), join)


def _windows(items: Column, n: Column, join) -> Column:
    """``join`` over every five consecutive items: of twos, then fours, then one more."""
    twos = _pairs(items, n, 1, join)
    fours = _pairs(twos, n - 1, 2, join)
    left = F.greatest(n - 4, F.lit(0))
    return F.zip_with(F.slice(fours, F.lit(1), left), F.slice(items, F.lit(5), left), join)


def repeat_words(rows: DataFrame, name: str = "n_repeat_words") -> DataFrame:
    """``rows(w, n)`` with the number of words inside five-word windows that stand twice or more in ``w``.

    Windows are compared by hash first; only where two agree are they compared by their words. Windows in order show
    their repeats as neighbours; what they cover follows from the distances of their places.
    """
    hashed = rows.withColumn("__h", F.transform("w", lambda x: F.xxhash64(x)))
    hashed = hashed.withColumn("__h", _windows(F.col("__h"), F.col("n"), lambda a, b: F.xxhash64(a, b)))
    may = F.size(F.array_distinct("__h")) < F.size("__h")
    said = _windows(F.col("w"), F.col("n"), lambda a, b: F.concat_ws(" ", a, b))
    placed = F.when(may, F.sort_array(F.transform(said, lambda x, i: F.struct(x.alias("s"), i.alias("i")))))
    none = F.array().cast("array<int>")
    same = _pairs(F.col("__p"), F.size("__p"), 1, lambda a, b: F.when(a["s"] == b["s"], F.array(a["i"], b["i"])).otherwise(none))
    places = F.sort_array(F.array_distinct(F.flatten(same)))
    step = _pairs(F.col("__q"), F.size("__q"), 1, lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(step, F.lit(WINDOW).cast("long"), lambda total, d: total + d)
    found = hashed.withColumn("__p", placed).withColumn("__q", F.when(F.col("__p").isNotNull(), places))
    return found.withColumn(name, F.when(F.size(F.coalesce("__q", none)) > 0, covered).otherwise(F.lit(0).cast("long"))).drop("__h", "__p", "__q")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_letters, n_upper, n_digits, n_bangs, n_stops, n_runs, n_bare)``.

    ``n_bare`` counts words without letter or digit, ``n_runs`` places where one mark (no letter, digit or space) stands three times in a row.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    split = rows.withColumn("w", F.array_remove(F.split("t", SPACE, -1), ""))
    split = split.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    counted = split.select(
        "id", "w", F.size("w").alias("n"), F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"), _kept(F.col("t"), SYMBOLS).alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _kept(F.col("t"), r"\P{L}+").alias("n_letters"), _kept(F.col("t"), "[^A-Z]+").alias("n_upper"), _kept(F.col("t"), "[^0-9]+").alias("n_digits"), _kept(F.col("t"), "[^!?]+").alias("n_bangs"), _kept(F.col("t"), "[^.,;:]+").alias("n_stops"),
        F.regexp_count("t", F.lit(r"([^\p{L}\p{N}\s])\1\1")).cast("long").alias("n_runs"), F.regexp_count("t", F.lit(r"(?<!\S)[^\p{L}\p{N}\s]+(?!\S)")).cast("long").alias("n_bare"),
    )
    return repeat_words(counted).select("id", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_digits", "n_bangs", "n_stops", "n_runs", "n_bare")


@dataclass(frozen=True)
class Rule:
    """SQL conditions under which a rule votes bad and good; else it abstains. Both must hold for no row at once."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 10", "n_words >= 40"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words and n_words > 0"),
    Rule("letters", "100 * n_letters < 75 * word_chars", "100 * n_letters >= 85 * word_chars and n_words > 0"),
    Rule("runs", "20 * n_runs > n_words", "100 * n_runs <= n_words and n_words > 0"),
    Rule("bare", "10 * n_bare > n_words", "50 * n_bare <= n_words and n_words > 0"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 and n_lines >= 3"),
    Rule("repeats", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words and n_words >= 40"),
    Rule("word_size", "word_chars < 3 * n_words or word_chars > 12 * n_words", "word_chars between 4 * n_words and 9 * n_words and n_words > 0"),
    Rule("capitals", "100 * n_upper > 30 * word_chars", "100 * n_upper <= 10 * word_chars and n_words > 0"),
    Rule("digits", "100 * n_digits > 20 * word_chars", "100 * n_digits <= 5 * word_chars and n_words > 0"),
    Rule("exclamation", "10 * n_bangs > n_words and n_bangs > 1", "50 * n_bangs <= n_words and n_words >= 40"),
    Rule("sentences", "n_stops = 0 and n_words >= 40 or n_stops > n_words", "n_stops between n_words / 60 and n_words / 2 and n_words >= 40"),
)


def votes(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """Each rule's vote as a column: 1 good, -1 bad, 0 none."""
    return {f"vote_{r.name}": F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0).cast("tinyint") for r in rules}


@dataclass
class VoteModel:
    """``good``: the share of the good class; by rule, how many of its votes are bad among bad and among good texts."""

    good: float
    bad_when_bad: list[float]
    bad_when_good: list[float]

    def evidence(self) -> list[tuple[float, float]]:
        """By rule what a bad and a good vote add to the log odds of the good class."""
        return [(math.log(g / b), math.log((1 - g) / (1 - b))) for b, g in zip(self.bad_when_bad, self.bad_when_good)]

    def odds(self, pattern: tuple[int, ...]) -> float:
        z = math.log(self.good / (1 - self.good))
        for vote, (bad, good) in zip(pattern, self.evidence()):
            z += bad if vote < 0 else good if vote > 0 else 0.0
        return z

    def posterior(self, rules: tuple[Rule, ...] = RULES) -> Column:
        z = F.lit(math.log(self.good / (1 - self.good)))
        for rule, (bad, good) in zip(rules, self.evidence()):
            vote = F.col(f"vote_{rule.name}")
            z = z + F.when(vote < 0, bad).when(vote > 0, good).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


#: Where estimation begins, and what counts besides the texts: a bad text breaks three rules of ten, a good one hardly any.
START = _GOOD, _BAD_WHEN_BAD, _BAD_WHEN_GOOD = 0.8, 0.3, 0.02


def estimate(patterns: dict[tuple[int, ...], int], rules: int, rounds: int = 50, prior: float = 0.01) -> VoteModel:
    """Expectation-maximisation over the numbers of texts by votes.

    Besides the texts, each class has ``prior`` times as many that vote as it was assumed at the start, so nothing is
    certain; and a rule's bad votes are at least as common among bad texts as among good ones, so no bad vote ever
    speaks for a text. The result does not depend on the order of the patterns, nor on the corpus' size.
    """
    model = VoteModel(_GOOD, [_BAD_WHEN_BAD] * rules, [_BAD_WHEN_GOOD] * rules)
    known = sorted(patterns.items())
    total = sum(patterns.values())
    extra = prior * total
    for _ in range(rounds if total else 0):
        # by rule the good and bad votes of bad and of good texts
        bad = [[extra * (1 - _BAD_WHEN_BAD), extra * _BAD_WHEN_BAD] for _ in range(rules)]
        good = [[extra * (1 - _BAD_WHEN_GOOD), extra * _BAD_WHEN_GOOD] for _ in range(rules)]
        mass, evidence, start = extra * _GOOD, model.evidence(), math.log(model.good / (1 - model.good))
        for pattern, n in known:
            z = start + sum(e[0] if v < 0 else e[1] for v, e in zip(pattern, evidence) if v)
            p = 1 / (1 + math.exp(-z))
            mass += n * p
            for j, v in enumerate(pattern):
                if v:
                    good[j][v < 0] += n * p
                    bad[j][v < 0] += n * (1 - p)
        when_good = [b / (a + b) for a, b in good]
        when_bad = [max(b / (a + b), g) for (a, b), g in zip(bad, when_good)]
        model = VoteModel(mass / (total + extra), when_bad, when_good)
    return model


def vote_counts(voted: DataFrame, rules: tuple[Rule, ...] = RULES) -> dict[tuple[int, ...], int]:
    """How many texts have each combination of votes: at most ``3 ** len(rules)`` of them."""
    names = [f"vote_{r.name}" for r in rules]
    return {tuple(r[n] for n in names): r["n"] for r in voted.groupBy(*names).agg(F.count("*").alias("n")).collect()}


def quality_votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior, vote_..)`` for every row.

    Accuracies are estimated from all rows, without labels. ``base_failed`` texts have less than ten words or more than
    a fifth of them in repeated windows; ``kept`` are others whose ``posterior`` of being good is at least ``threshold``.
    A null text counts as empty (no words, so it fails); repeated rows vote each; null ids take part; an empty table
    gives an empty result; other columns are not read. A text is handled in one row, with arrays of its words.
    """
    counted = statistics(docs, id_col, text_col)
    voted = staged(counted.select("*", *(v.alias(name) for name, v in votes(rules).items())), "votes")
    model = estimate(vote_counts(voted, rules), len(rules))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = voted.withColumn("base_failed", failed).withColumn("posterior", model.posterior(rules))
    return scored.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"), "posterior", *votes(rules),
    )

"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of every whole text are computed once. Small boosted trees are grown on a bounded sample of labelled rows;
every path from a root to a node becomes a conjunctive rule; a lasso-penalised logistic regression keeps few of them.
What is left is compiled into one Spark column expression, so scoring runs inside the engine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import byte_column, free_name

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "longest_word", "upper_share", "digit_share", "bang_share", "symbol_share",
    "bar_share", "stop_share", "line_share", "distinct_share", "repeat_share", "short_share", "high_byte_share",
)

_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = b"0123456789"
#: Words among which repeats count for ``distinct_share``.
_WINDOW = 50


def statistics(raw: bytes) -> tuple[float, ...]:
    """The values of ``STATISTICS`` for a text in UTF-8; all zero for an empty one."""
    n = len(raw)
    words = raw.split()
    if not words:
        return (math.log1p(n),) + (0.0,) * (len(STATISTICS) - 1)
    count = len(words)

    def share(chars: bytes, of: int = n) -> float:
        return (n - len(raw.translate(None, chars))) / of

    sizes = list(map(len, words))
    letters = sum(sizes)
    return (
        math.log1p(n),
        math.log1p(count),
        letters / count,
        math.log1p(max(sizes)),
        share(_UPPER),
        share(_DIGITS),
        share(b"!?", count),
        share(b"#$%&*@^~<>{}[]\\=+", count),
        share(b"|", count),
        share(b".,;:", count),
        share(b"\n", count),
        # within windows, as the share over a whole text falls with its length
        sum(len(set(words[i : i + _WINDOW])) for i in range(0, count, _WINDOW)) / count,
        sum(map(eq, words, words[1:])) / count,
        sum(s <= 3 for s in sizes) / count,
        (n - len(raw.translate(None, bytes(range(128, 256))))) / n,
    )


def with_statistics(docs: DataFrame, text_col: str = "text", name: str = "__statistics") -> DataFrame:
    """``docs`` with a column (array of doubles in the order of ``STATISTICS``) of every whole text's statistics."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [list(statistics(raw or b"")) for raw in byte_column(batch, text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.float64()))], names=[*names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(run, schema)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold) conditions, sorted


def _grow(bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int, path: Rule = ()) -> tuple[list[tuple[Rule, float]], np.ndarray]:
    """A regression tree on second-order statistics; its rules and its values on the rows."""
    value = grad.sum() / (hess.sum() + 1.0)
    leaf = np.full(len(grad), value)
    if depth == 0 or len(grad) < 2 * least:
        return [], leaf
    best, total_g, total_h = (1e-6, None, None), grad.sum(), hess.sum()
    base = total_g**2 / (total_h + 1.0)
    for f in range(bins.shape[1]):
        size = len(edges[f]) + 1
        g = np.bincount(bins[:, f], grad, size).cumsum()[:-1]
        h = np.bincount(bins[:, f], hess, size).cumsum()[:-1]
        n = np.bincount(bins[:, f], minlength=size).cumsum()[:-1]
        gain = g**2 / (h + 1.0) + (total_g - g) ** 2 / (total_h - h + 1.0) - base
        gain[(n < least) | (len(grad) - n < least)] = 0
        if len(gain) and gain.max() > best[0]:
            best = (gain.max(), f, int(gain.argmax()))
    if best[1] is None:
        return [], leaf
    _, f, at = best
    left, rules = bins[:, f] <= at, []
    for mask, above in ((left, False), (~left, True)):
        rule = tuple(sorted({*path, (f, above, float(edges[f][at]))}))
        rules.append(rule)
        deeper, leaf[mask] = _grow(bins[mask], edges, grad[mask], hess[mask], depth - 1, least, rule)
        rules += deeper
    return rules, leaf


def _holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), dtype=np.float32)
    for j, rule in enumerate(rules):
        for f, above, edge in rule:
            out[:, j] *= (x[:, f] > edge) == above
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient."""
    scale = np.sqrt(np.maximum(x.mean(0) * (1 - x.mean(0)), 1e-4)).astype(np.float32)
    z = (x - x.mean(0)) / scale
    probe = np.ones(z.shape[1], dtype=np.float32) / max(1, z.shape[1]) ** 0.5
    for _ in range(15):  # largest eigenvalue of z'z/n, for the step
        probe = z.T @ (z @ probe) / len(z)
        probe /= max(np.linalg.norm(probe), 1e-12)
    step = 4 / max(float(np.linalg.norm(z @ probe) ** 2 / len(z)), 1e-3) / 1.1
    w = v = np.zeros(z.shape[1], dtype=np.float32)
    b, t = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)), 1.0
    for _ in range(rounds):
        error = (_sigmoid(z @ v + b) - y).astype(np.float32)
        b -= 2 * float(error.mean())
        moved = v - step * (z.T @ error) / len(z)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / after * (new - w), new, after
    weights = w / scale
    return b - float((weights * x.mean(0)).sum()), weights


@dataclass
class RuleModel:
    bias: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self, statistics: str = "__statistics") -> Column:
        """Probability of label 1 as an expression over the column of statistics."""
        value = lambda f: F.get(F.col(f"`{statistics}`"), F.lit(f))
        z = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights):
            holds = None
            for f, above, edge in rule:
                one = value(f) > edge if above else value(f) <= edge
                holds = one if holds is None else holds & one
            z = z + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, penalty: float = 0.002, rounds: int = 200) -> RuleModel:
    """Trees, their rules, lasso weights. Without rows of both labels the score is the share of label 1 (0.5 if none)."""
    if not len(y) or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.5
        return RuleModel(math.log((mean + 1e-3) / (1 - mean + 1e-3)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49))) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    rules: dict[Rule, None] = {}
    z = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = _sigmoid(z)
        grown, step = _grow(bins, edges, y - p, p * (1 - p), depth, max(5, len(y) // 500))
        rules.update(dict.fromkeys(grown))
        z += rate * step
    names = list(rules)
    bias, weights = _lasso(_holds(names, x), y, penalty, rounds)
    kept = [j for j in np.argsort(-np.abs(weights)) if abs(weights[j]) > 1e-4]
    return RuleModel(bias, [names[j] for j in kept], [float(weights[j]) for j in kept])


def crc_fold(id_col: Column, folds: int = 5) -> Column:
    """``crc32(id as text) mod folds``; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, held_fold: int, sample_rows: int) -> RuleModel:
    """Fit on at most ``sample_rows`` labelled rows outside ``held_fold``, the first by a hash of the id."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__y in (0, 1)")
    known = known.where(crc_fold(F.col("__id")) != held_fold)
    order = F.xxhash64(F.col("__id").cast("string"))
    # the sample has a fixed number of rows of two numbers: it is small enough to broadcast whatever the corpus' size
    sample = F.broadcast(known.orderBy(order, "__id", "__y").limit(sample_rows))
    met = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(sample, "__id")
    learnt = with_statistics(met, "__text").select("__id", "__y", "__statistics").orderBy(order, "__id", "__y", "__statistics").limit(sample_rows).toArrow()
    x = np.array(learnt["__statistics"].to_pylist(), dtype=np.float64).reshape(-1, len(STATISTICS))
    return fit_rules(x, learnt["__y"].to_numpy().astype(float))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_fold: int = 0, threshold: float = 0.3, sample_rows: int = 20_000
) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row of ``docs``.

    Only labelled rows whose crc fold is not ``held_fold`` are learnt from, at most ``sample_rows`` of them (the
    documented bound of the fit; scoring covers every row). Neither id, language nor source is an input of the score.
    A null text counts as empty and is scored; a null id is never held out nor learnt from; null labels are ignored; an
    id labelled twice or used by several rows gives a row of the sample each; an empty table gives an empty result;
    without labels of both kinds the score is constant. Other columns are not read.
    """
    model = fit_quality(docs, labels, id_col, text_col, label_col, held_fold, sample_rows)
    rows = with_statistics(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text")
    return rows.select(
        F.col("__id").alias(id_col), F.coalesce(crc_fold(F.col("__id")) == held_fold, F.lit(False)).alias("held_out"), model.score().alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_fold: int = 0, threshold: float = 0.3, sample_rows: int = 20_000
) -> DataFrame:
    """The rows of ``docs``, unchanged, that ``quality_scores`` predicts to be of label 1; no join and no shuffle."""
    model = fit_quality(docs, labels, id_col, text_col, label_col, held_fold, sample_rows)
    name = free_name(docs, "statistics")
    return with_statistics(docs, text_col, name).where(model.score(name) >= threshold).drop(name)

"""Date and number functions as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import lexicon as L


def session_hour(ts: Column, offset: int = -5) -> Column:
    """Hour of the day at a fixed offset from UTC."""
    return F.pmod(F.hour(ts) + offset, F.lit(24))


def market_period(ts: Column) -> Column:
    """Session by whole hours: up to 9 pre_market, 10-15 trading_hours, 16-19 after_hours, later overnight."""
    h = session_hour(ts)
    return F.when(h < 9.5, "pre_market").when(h < 16, "trading_hours").when(h < 20, "after_hours").otherwise("overnight")


def exchange_date(ts: Column, zone: str = "America/New_York") -> Column:
    """Date at the exchange of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def binned(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins; values at or below the lowest edge, or above the highest, are null."""
    out = F.when(value <= edges[0], None)
    for edge, label in zip(edges[1:], labels):
        out = out.when(value <= edge, label)
    return out.otherwise(None)


def sentiment_bin(score: Column) -> Column:
    return binned(score, (-1, -0.1, 0.1, 1), ("negative", "neutral", "positive"))


def impact_bin(score: Column) -> Column:
    return binned(score, (0, 0.3, 0.6, 1.0), ("low", "medium", "high"))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(values: Sequence[Column]) -> list[Column]:
    """Probabilities of a row's scores."""
    top = F.greatest(*values) if len(values) > 1 else values[0]
    total = sum((F.exp(v - top) for v in values[1:]), F.exp(values[0] - top))
    return [F.exp(v - top) / total for v in values]


def checkpoint_name(ts: Column, prefix: str = "encoder_", first: int = 1999, last: int = 2024) -> Column:
    """Name of the model that knows nothing after the year before ``ts``."""
    year = F.greatest(F.lit(first), F.least(F.lit(last), F.year(ts) - 1))
    return F.concat(F.lit(prefix), year.cast("string"), F.lit("1231"))


def encoder_name(ts: Column, default: str = "all-MiniLM-L6-v2") -> Column:
    """The encoder released before a year's news."""
    table = F.create_map(*(F.lit(x) for pair in L.ENCODERS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.year(ts)), F.lit(default))


def parsed_time(c: Column, formats: Sequence[str] = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")) -> Column:
    """A timestamp from text in the first format that fits; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats))


def merged(older: Column, newer: Column) -> Column:
    """Entries of two maps; where a key is in both, the newer one's."""
    return F.map_concat(F.map_filter(older, lambda k, _: ~F.array_contains(F.map_keys(newer), k)), newer)


def merged_settings(older: Mapping, newer: Mapping) -> dict:
    """Two nested tables of settings as one; where both have a value, the newer one's."""
    both = dict(older)
    for key, value in newer.items():
        both[key] = merged_settings(both[key], value) if isinstance(value, Mapping) and isinstance(both.get(key), Mapping) else value
    return both


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.try_divide(dot, norm(a) * norm(b))

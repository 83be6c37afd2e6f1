"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import join_hot, staged


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(u, v)`` of longs -> ``(node, root)``, root being the smallest node of the component.

    Nodes without links are left out; null ends and self links are ignored; repeated links count once. Each round
    is two aggregations with two joins and is staged; no component is ever gathered in a task, and nodes with very many
    links are joined apart. Raises if
    ``max_rounds`` do not suffice (they are logarithmic in the longest path).
    """
    edges = staged(
        links.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    before = _state(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        large = staged(join_hot(both, low, "u", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (
            join_hot(large, low, "u", 2 * before[0])
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        edges = staged(small, "links")
        after = _state(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

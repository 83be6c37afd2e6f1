"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

Every participant of a dialogue gets it rendered once with their own turns as the assistant's and everybody else's as
named users', and the spans of the own turns as a mask. Roles of the context (the system's) are rendered as they are
and take no perspective. Dialogues of at most ``block_turns`` turns meet in one grouping, the only shuffle of their texts.
The turns of longer ones are numbered over range partitions, not in one window per dialogue, and rendered in blocks of so
many turns wherever these lie; what meets at last is a rendering's own blocks, which its row holds anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import staged

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def numbered(turns: DataFrame) -> DataFrame:
    """``turns(conv, turn, role, text)`` with ``ordinal`` from 0 in each dialogue, by turn, role and text (nulls first).

    Range partitions on the whole order split a long dialogue, equal rows included; places inside a partition plus the
    sizes of what lies before in the same dialogue give the ordinal.
    """
    order = ["conv", "turn", "role", "text"]
    dealt = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie")
    rows = staged(dealt.drop("tie").withColumn("pid", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "turns")
    sizes = rows.groupBy("conv", "pid").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy("conv").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(F.col("conv").alias("conv_"), F.col("pid").alias("pid_"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(starts, (F.col("pid") == F.col("pid_")) & F.col("conv").eqNullSafe(F.col("conv_"))).select(*order, (F.col("at") + F.col("shift")).alias("ordinal"))


def _met(rows: DataFrame, convs: DataFrame, how: str) -> DataFrame:
    return rows.join(convs.select(F.col("conv").alias("conv_")), F.col("conv").eqNullSafe(F.col("conv_")), how)


SPANS = "array<struct<start:int,stop:int>>"


def _views(rows: DataFrame, context_roles: tuple[str, ...], block_turns: int) -> tuple[DataFrame, DataFrame | None]:
    """``(conv, turns, perspective)`` of the dialogues that meet in one grouping, and of blocks of the others, by ``part``.

    How long a dialogue is comes from counts alone, so the ids of the long ones, at most a ``block_turns``-th of the
    turns, are all that is matched against the turns.
    """
    speaks = lambda r: ~r.isin(*context_roles) if context_roles else F.lit(True)
    said = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    long = staged(rows.groupBy("conv").agg(F.count("*").alias("n")).where(F.col("n") > block_turns).select("conv"), "long-dialogues")
    some_long = not long.isEmpty()
    short = (_met(rows, long, "left_anti") if some_long else rows).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    people = F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), speaks))
    views = short.select("conv", said, F.explode(people).alias("perspective"))
    if not some_long:
        return views, None
    placed = staged(numbered(_met(rows, long, "left_semi")), "numbered")
    part = F.floor(F.col("ordinal") / block_turns).alias("part")
    blocks = placed.groupBy("conv", part).agg(F.array_sort(F.collect_list(F.struct("ordinal", "role", "text"))).alias("turns"))
    named = staged(placed.where(speaks(F.col("role"))).select(F.col("conv").alias("conv_"), F.col("role").alias("perspective")).distinct(), "participants")
    return views, blocks.select("conv", "part", said).join(named, F.col("conv").eqNullSafe(F.col("conv_"))).drop("conv_")


def _rendered(views: DataFrame, context_roles: tuple[str, ...]) -> DataFrame:
    """``views`` with ``rendered``, ``mask``, ``n_turns`` and ``n_own`` in the place of their turns."""
    own = lambda t: t["role"] == F.col("perspective")
    head = lambda t: F.concat(
        F.lit(OPEN), F.when(own(t), "assistant").when(t["role"].isin(*context_roles), t["role"]).otherwise(F.concat(F.lit("user name="), t["role"])), F.lit("\n")
    )
    body = lambda t: F.concat(t["text"], F.lit(CLOSE))
    pieces = F.transform("turns", lambda t: F.struct(F.concat(head(t), body(t), F.lit("\n")).alias("text"), F.length(head(t)).alias("before"), F.length(body(t)).alias("size"), own(t).alias("own")))

    def add(acc, p):
        start = acc["at"] + p["before"]
        grown = F.concat(acc["spans"], F.array(F.struct(start.alias("start"), (start + p["size"]).alias("stop"))))
        return F.struct(F.when(p["own"], grown).otherwise(acc["spans"]).alias("spans"), (start + p["size"] + 1).alias("at"))

    mask = F.aggregate("pieces", F.struct(F.array().cast(SPANS).alias("spans"), F.lit(0).alias("at")), add, lambda acc: acc["spans"])
    kept = [c for c in views.columns if c != "turns"]
    return (
        views.withColumn("pieces", pieces)
        .withColumn("mask", mask)
        .select(*kept, F.size("pieces").cast("long").alias("n_turns"), F.size("mask").cast("long").alias("n_own"), F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("rendered"), "mask")
    )


def _whole(blocks: DataFrame) -> DataFrame:
    """Rendered blocks of the same dialogue and perspective as one row, spans counted from its start."""
    blocks = staged(blocks.withColumn("size", F.length("rendered")), "rendered-blocks")
    # sizes alone are put in order first, one row for a block
    before = W.partitionBy("conv", "perspective").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shifts = blocks.select(F.col("conv").alias("conv_"), F.col("perspective").alias("perspective_"), F.col("part").alias("part_"), F.coalesce(F.sum("size").over(before), F.lit(0)).cast("int").alias("shift"))
    same = F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("perspective") == F.col("perspective_")) & (F.col("part") == F.col("part_"))
    moved = F.transform("mask", lambda m: F.struct((m["start"] + F.col("shift")).alias("start"), (m["stop"] + F.col("shift")).alias("stop")))
    placed = blocks.join(shifts, same).withColumn("mask", moved)
    whole = placed.groupBy("conv", "perspective").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("n_own").alias("n_own"), F.array_sort(F.collect_list(F.struct("part", "rendered"))).alias("parts"), F.array_sort(F.flatten(F.collect_list("mask"))).alias("mask")
    )
    return whole.withColumn("rendered", F.array_join(F.transform("parts", lambda p: p["rendered"]), ""))


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", context_roles: tuple[str, ...] = ("system",), block_turns: int = 512
) -> DataFrame:
    """``(conv, perspective, n_turns, n_own, rendered, mask)``, a row for each participant of a dialogue.

    ``mask`` is an array of ``struct(start, stop)`` in characters of ``rendered``: the own turns' text with its closing
    mark. Turns are in order of their number, role and text, whatever their number is; ``block_turns`` only moves work.
    A rendering is one value, so Spark's limit of 2 GB for a row is that of a dialogue: a longer one fails. A null or
    empty role is the participant "unknown"; a null text is empty; turns with a null dialogue id form one dialogue, a
    null turn number comes first; equal rows are all kept; "<|" in texts and names becomes "< |", and
    control characters and line ends in names become spaces, so neither can forge a mark or a header. A dialogue without participants has no rows, like an empty table. Extra columns are not read.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    line = F.regexp_replace(F.col(role_col), r"[\x00-\x1F\x7F\x85\x{2028}\x{2029}]", " ")
    role = F.when(F.coalesce(F.col(role_col), F.lit("")) == "", "unknown").otherwise(safe(line))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), safe(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    views, blocks = _views(rows, context_roles, block_turns)
    names = ["conv", "perspective", "n_turns", "n_own", "rendered", "mask"]
    out = _rendered(views, context_roles).select(*names)
    if blocks is not None:
        out = out.unionByName(_whole(_rendered(blocks, context_roles)).select(*names))
    return out.withColumnRenamed("conv", conv_col)

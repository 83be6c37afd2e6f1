"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Every scan partition hashes its texts and sends each owner (a range of hash values) its distinct hashes, sorted and
Golomb-Rice coded. Owners look for hashes that came from several partitions and answer each with a bitmap in the
order of its message; a partition knows its own repeats. Only the suspects that this leaves are shuffled with their
texts, and grouping by the text itself verifies them byte by byte.

For that the texts are staged once where they lie, bucketed by their scan partition: bitmaps by place in a partition
meet them there, so neither finding the suspects nor removing copies moves any other text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import BITS, at_positions, bits_row, join_hot, positioned, staged


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted, distinct unsigned 64-bit values: count (4 bytes), remainder bits (1), remainders, unary quotients."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(gaps.astype(np.float64).mean()).bit_length() - 1)
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    high = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(high.sum()) + n, np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    return n.to_bytes(4, "little") + bytes([k]) + np.packbits(low.reshape(-1)).tobytes() + np.packbits(unary).tobytes()


def golomb_decode(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    n, k = int.from_bytes(data[:4], "little"), data[4]
    cut = 5 + (n * k + 7) // 8
    low = np.unpackbits(np.frombuffer(data[5:cut], np.uint8), count=n * k).reshape(n, k).astype(np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data[cut:], np.uint8)))[:n]
    high = np.diff(ends, prepend=-1) - 1
    gaps = (high.astype(np.uint64) << np.uint64(k)) + (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _owners(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _messages(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """The distinct hashes in order, cut into owners' ranges."""
    values = np.unique(hashes)
    owner = _owners(values, bits)
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for part in np.split(values, cuts):
        if len(part):
            yield int(_owners(part[:1], bits)[0]), part


def _base(owner: int, bits: int) -> np.uint64:
    return np.uint64(owner << (64 - bits)) if bits else np.uint64(0)


def send(hashes: DataFrame, bits: int) -> DataFrame:
    """``hashes(slot, h)`` -> ``(slot, owner, message)``: what every scan partition tells the owners."""

    def run(rows: pa.Table) -> pa.Table:
        at = rows["slot"][0].as_py()
        sent = [(owner, golomb_encode(v - _base(owner, bits))) for owner, v in _messages(rows["h"].to_numpy().view(np.uint64), bits)]
        return pa.table({"slot": pa.array([at] * len(sent), pa.int32()), "owner": pa.array([o for o, _ in sent], pa.int32()), "message": pa.array([m for _, m in sent], pa.binary())})

    return hashes.groupBy("slot").applyInArrow(run, "slot int, owner int, message binary")


def answer(messages: DataFrame) -> DataFrame:
    """Owners' replies ``(slot, owner, bitmap)``: a bit for each hash of the message, set if other partitions sent it too."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sent = [golomb_decode(m) for m in pdf["message"]]
        values, count = np.unique(np.concatenate(sent), return_counts=True)
        shared = values[count > 1]
        bits = [np.packbits(np.isin(s, shared, assume_unique=True)).tobytes() for s in sent]
        return pd.DataFrame({"slot": pdf["slot"], "owner": pdf["owner"], "bitmap": bits})

    return messages.groupBy("owner").applyInPandas(run, "slot int, owner int, bitmap binary")


def suspects_of(hashes: DataFrame, replies: DataFrame, bits: int) -> DataFrame:
    """``hashes(slot, ord, h)`` -> a bitmap of places per partition: the hash is there again, or its bit is set in a reply."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes = left["h"].to_numpy().view(np.uint64)
        bitmaps = dict(zip(right["owner"].to_pylist(), right["bitmap"].to_pylist()))
        values, count = np.unique(hashes, return_counts=True)
        known = [values[count > 1]]
        for owner, sent in _messages(hashes, bits):
            known.append(sent[np.unpackbits(np.frombuffer(bitmaps[owner], np.uint8), count=len(sent)).astype(bool)])
        return bits_row(left["slot"][0].as_py(), left["ord"].to_numpy()[np.isin(hashes, np.concatenate(known))])

    return hashes.groupBy("slot").cogroup(replies.groupBy("slot")).applyInArrow(run, BITS)


def _placed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents by position ``(slot, ord, row, id, h, sha)``, the suspects' bitmaps and their groups.

    ``groups(sha, n, keep)``: ``keep`` is the position ``(id, slot, ord)`` of the row that stays. The text is the
    grouping key, so its bytes are compared and copies of one task meet before the shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = positioned(docs, "texts", id=F.col(id_col), h=F.xxhash64(text), sha=F.unhex(F.sha2(text, 256)))
    # an owner's share of the hashes: at most about eight million, and work for every core where there are fewer
    bits = max(3, min(6, placed.rdd.getNumPartitions().bit_length()), (placed.count() >> 23).bit_length())
    replies = answer(send(placed.select("slot", "h"), bits))
    suspects = staged(suspects_of(placed.select("slot", "ord", "h"), replies, bits), "suspects")
    light = at_positions(placed.select("slot", "ord", "id", "sha"), suspects)
    classes = light.groupBy("sha").agg(F.max(F.struct("id", "slot", "ord")).alias("keep"), F.count("*").alias("n"))
    again = at_positions(placed.select("slot", "ord", "sha", F.coalesce(F.col("row").getField(text_col), F.lit("")).alias("text")), suspects)
    verified = again.groupBy("sha", "text").agg(F.count("*").alias("same")).select("sha", "same")
    different = F.raise_error(F.lit("different texts share a digest"))
    groups = classes.join(verified, "sha").select("sha", "keep", F.when(F.col("n") == F.col("same"), F.col("n")).otherwise(different).alias("n"))
    return placed, suspects, staged(groups, "groups")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` for every row; of equal texts the row with the largest id stays.

    A null text counts as empty. A null id is smaller than any other. Rows with the same id and the same text are
    equal texts like any others: exactly one of a group is kept. Other columns are not read; an empty table gives an
    empty result.
    """
    placed, suspects, groups = _placed(docs.select(id_col, text_col), id_col, text_col)
    light = placed.select("slot", "ord", "id", "sha")
    met = join_hot(at_positions(light, suspects), groups, "sha", light.count())
    kept = (F.col("slot") == F.col("keep.slot")) & (F.col("ord") == F.col("keep.ord"))
    digest = F.lower(F.hex("sha")).alias("text_sha256")
    again = met.select("id", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), digest)
    alone = at_positions(light, suspects, "left_anti").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest)
    return alone.unionByName(again).withColumnRenamed("id", id_col)


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, of which one stays for each text: that with the largest id.

    Rows as in ``exact_groups``; they are taken out where they lie, by position.
    """
    placed, suspects, groups = _placed(docs, id_col, text_col)

    def less(found: pa.Table, keep: pa.Table) -> pa.Table:
        words = found["bits"][0].values.to_numpy()
        places = np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))
        return bits_row(found["slot"][0].as_py(), np.setdiff1d(places, keep["ord"].to_numpy()))

    keep = groups.select("keep.slot", "keep.ord")
    dropped = suspects.groupBy("slot").cogroup(keep.groupBy("slot")).applyInArrow(less, BITS)
    return at_positions(placed, dropped, "left_anti").select("row.*")

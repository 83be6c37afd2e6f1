"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive words of a benchmark item, kept as a place in the items' word numbers. For
patterns of one length m, a table tells for each block of two words how far the search may jump without missing an
occurrence; where the jump is zero, the hash of the last words picks the patterns that end there, and their words are
compared directly.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import alnum_words, at_positions, byte_column, free_name, position_bits, positioned, staged

Span = tuple[int, int]
_WORD = 0xFFFFFFFFFFFFFFFF
#: Odd multiplier of the hashes of word numbers.
_MIX = 0x9E3779B97F4A7C15


def item_windows(n_words: int, size: int = 13) -> range:
    """Where an item's windows start; one of all its words if it has fewer, none if it has no word."""
    return range(max(1, n_words - size + 1) if n_words else 0)


class WuManber:
    """Shift table and suffix buckets for windows of one length, which are places in one array of word numbers.

    The table has a byte for each hash of two word numbers: how far the search may jump where they stand. Equal hashes
    of different pairs keep the lesser jump, so none is missed. A window is found through the hash of its last words and
    then compared, number by number.
    """

    def __init__(self, numbers: np.ndarray, starts: np.ndarray, m: int):
        self.m, self.block, self.suffix = m, min(2, m), min(4, m)
        self.longest_jump = m - self.block + 1
        self.bits = max(10, (2 * len(starts)).bit_length())
        table = np.full(1 << self.bits, self.longest_jump, np.uint8)
        words = numbers.astype(np.uint64)
        for end in range(self.block, m + 1):
            np.minimum.at(table, self._pairs(words, starts + end), m - end)
        self.jumps = table.tobytes()
        keys = np.zeros(len(starts), np.uint64)
        for back in range(self.suffix, 0, -1):
            keys = (keys + words[starts + m - back] + np.uint64(1)) * np.uint64(_MIX)
        order = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[order], starts[order]

    def _pairs(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        last = words[ends - 1] + np.uint64(1)
        found = last if self.block == 1 else last + (words[ends - 2] + np.uint64(1)) * np.uint64(_MIX)
        return (found * np.uint64(_MIX)) >> np.uint64(64 - self.bits)

    def find(self, words: list[bytes], number_of: Callable[[bytes], int | None], numbers: array) -> Iterator[tuple[int, int]]:
        """``(first word, place of the window)`` of every occurrence."""
        jumps, m, shift, two = self.jumps, self.m, 64 - self.bits, self.block == 2
        end, n = m, len(words)
        while end <= n:
            last = number_of(words[end - 1])
            if last is None:  # no window has this word: none can hold its place
                end += m
                continue
            key = last + 1
            if two:
                before = number_of(words[end - 2])
                if before is None:
                    end += m - 1
                    continue
                key += (before + 1) * _MIX
            jump = jumps[(key * _MIX & _WORD) >> shift]
            if jump:
                end += jump
                continue
            found = [number_of(w) for w in words[end - m : end]]
            if None not in found:
                key = 0
                for number in found[m - self.suffix :]:
                    key = (key + number + 1) * _MIX & _WORD
                at = int(np.searchsorted(self.keys, np.uint64(key)))
                here = array("i", found)
                while at < len(self.keys) and self.keys[at] == key:
                    place = int(self.places[at])
                    if numbers[place : place + m] == here:
                        yield end - m, place
                    at += 1
            end += 1


class Searcher:
    """All windows of a block of items: the items' words as numbers, one Wu-Manber table for each window length."""

    def __init__(self, items: Iterable[tuple[str, bytes]], size: int = 13):
        index, self.names, firsts, at = {}, [], [], 0
        numbers, by_length = array("i"), defaultdict(list)
        for item, raw in sorted(set(items)):
            words = alnum_words(raw)
            if not words:
                continue
            self.names.append(item)
            firsts.append(at)
            numbers.extend(index.setdefault(w, len(index)) for w in words)
            starts = item_windows(len(words), size)
            by_length[min(size, len(words))].append(np.arange(at, at + len(starts), dtype=np.int64))
            at += len(words)
        self.numbers, self.number_of, self.firsts = numbers, index.get, firsts
        flat = np.frombuffer(numbers, np.int32) if numbers else np.zeros(0, np.int32)
        self.tables = [WuManber(flat, np.concatenate(starts), m) for m, starts in sorted(by_length.items())]

    def search(self, words: list[bytes]) -> tuple[list[Span], set[str]]:
        """Merged ``(first word, end)`` stretches inside occurrences, and the items that occur."""
        found, items = [], set()
        for table in self.tables:
            for start, place in table.find(words, self.number_of, self.numbers):
                found.append((start, start + table.m))
                items.add(bisect_right(self.firsts, place) - 1)
        return merged(found), {self.names[i] for i in items}


def merged(spans: Iterable[Span]) -> list[Span]:
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class Blocks:
    """The benchmark's items in blocks of about ``block_bytes`` of text, each fetched when it is its turn."""

    def __init__(self, benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
        self.rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text")).where("text is not null")
        total = self.rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.count = max(1, -(-total // block_bytes))

    def sent(self, k: int) -> Broadcast:
        part = self.rows if self.count == 1 else self.rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(self.count)) == k)
        return part.sparkSession.sparkContext.broadcast([(r["item"], r["text"].encode()) for r in part.collect()])


_FOUND = "n_words long, hits array<struct<start:int,end:int>>, items array<string>"
_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _columns(n_words: list[int], hits: list[list[Span]], items: list[Iterable[str]]) -> list[pa.Array]:
    spans = [[{"start": a, "end": b} for a, b in h] for h in hits]
    return [pa.array(n_words, pa.int64()), pa.array(spans, _HITS), pa.array([sorted(i) for i in items], pa.list_(pa.string()))]


def scanned(rows: DataFrame, text_col: str, block: Broadcast, names: list[str], size: int, hits_only: bool = False) -> DataFrame:
    """``rows`` with three columns called ``names``: words, hits and items of one block of the benchmark."""
    carried = rows.columns
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, f.dataType) for n, f in zip(names, T._parse_datatype_string(_FOUND)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(block.value, size)
        for batch in batches:
            n_words, hits, items = [], [], []
            for raw in byte_column(batch, text_col):
                words = alnum_words(raw or b"")
                spans, found = searcher.search(words)
                n_words.append(len(words)), hits.append(spans), items.append(found)
            out = pa.RecordBatch.from_arrays([*batch.columns, *_columns(n_words, hits, items)], names=[*carried, *names])
            yield out.filter(pa.array([bool(h) for h in hits])) if hits_only else out

    return rows.mapInArrow(run, schema)


def _by_position(placed: DataFrame, blocks: Blocks, size: int) -> DataFrame:
    """``(slot, ord, id, n_words, hits, items)`` over all blocks of the benchmark, for every row of ``placed``.

    Only positions and hits are staged between blocks and meet by position; ``placed`` has ``id`` and ``text``.
    """
    names, parts = ["n_words", "hits", "items"], []
    for k in range(blocks.count):
        block = blocks.sent(k)
        found = scanned(placed.select("slot", "ord", "id", "text"), "text", block, names, size, hits_only=k > 0)
        parts.append(staged(found.drop("text").withColumn("k", F.lit(k)), "hits"))
        block.destroy()
    first, *rest = parts
    if not rest:
        return first.drop("k")
    more = reduce(DataFrame.unionByName, rest).groupBy("slot", "ord").agg(F.flatten(F.collect_list("hits")).alias("more_hits"), F.flatten(F.collect_list("items")).alias("more_items"))
    both = first.join(more, ["slot", "ord"], "left").select(
        "slot", "ord", "id", "n_words", F.concat("hits", F.coalesce("more_hits", F.array())).alias("hits"), F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", F.array())))).alias("items")
    )

    columns = both.columns

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [merged((h["start"], h["end"]) for h in row) for row in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *_columns(batch.column(3).to_pylist(), hits, batch.column(5).to_pylist())], names=columns)

    return both.mapInArrow(merge, both.schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 13, block_bytes: int = 8 << 20
) -> DataFrame:
    """``(id, n_words, hits, items)`` for every row of ``docs``.

    ``hits`` are merged stretches ``struct(start, end)`` of words inside occurrences, ``items`` the sorted ids (as
    strings) of items with an occurring window. A null or wordless text has no words and no hits; items without words
    have no windows; a null item id reads "null"; repeated items count once; repeated documents give a row each; other
    columns are not read. The benchmark is searched in blocks of bounded size, fetched one at a time; where there are
    several, documents are staged once and only hits are kept between blocks.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = Blocks(benchmark, item_col, item_text_col, block_bytes)
    if blocks.count == 1:
        found = scanned(rows, "text", blocks.sent(0), ["n_words", "hits", "items"], size)
    else:
        found = _by_position(positioned(rows, "searched").select("slot", "ord", "row.*"), blocks, size)
    return found.select(F.col("id").alias(id_col), "n_words", "hits", "items")


def hit_words(hits: str) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda acc, h: acc + h["end"] - h["start"])


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 13, block_bytes: int = 8 << 20
) -> DataFrame:
    """The rows of ``docs``, unchanged, that are not contaminated; no text is shuffled."""
    blocks = Blocks(benchmark, item_col, item_text_col, block_bytes)
    if blocks.count == 1:
        names = [free_name(docs, n) for n in ("n_words", "hits", "items")]
        rows = scanned(docs, text_col, blocks.sent(0), names, size)
        return rows.where(~contaminated(F.col(names[0]), hit_words(names[1]))).drop(*names)
    placed = positioned(docs, "searched")
    found = _by_position(placed.select("slot", "ord", F.lit(0).alias("id"), F.col("row").getField(text_col).alias("text")), blocks, size)
    bad = found.where(contaminated(F.col("n_words"), hit_words("hits")))
    return at_positions(placed, position_bits(bad), "left_anti").select("row.*")


def contaminated(n_words, n_hit):
    """The rule, for numbers or columns: a hit, and hits are a twentieth of the words at least."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)

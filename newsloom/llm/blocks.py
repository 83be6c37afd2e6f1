"""Texts as codes of words, by block, and an exchange that tells every block about its words.

A block is a stretch of one scan partition with a bounded number of words and of distinct words. Its texts become codes
that count in the block's own list of distinct words. The list goes to owners, each of which has the words of one hash
value from all blocks: there a word is dealt with once, however many blocks hold it, and the answer returns to them.
Texts are read and cut into words once; codes stay where they were written, bucketed by block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import byte_column, scan_buckets, slices, slot, staged_by

#: Bounds of a block: distinct words, and words.
BLOCK_WORDS, BLOCK_TOKENS = 400_000, 6_000_000
_ZSTD = pa.Codec("zstd", 3)


def squeeze(data: bytes) -> bytes:
    """Compressed bytes that know their size."""
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def pack(words: list[bytes]) -> bytes:
    """Byte strings as one."""
    sizes = np.fromiter(map(len, words), "<u4", len(words))
    return squeeze(len(words).to_bytes(8, "little") + sizes.tobytes() + b"".join(words))


def unpack(data: bytes) -> list[bytes]:
    raw = unsqueeze(data)
    n = int.from_bytes(raw[:8], "little")
    ends = (np.frombuffer(raw, "<u4", n, 8).astype(np.int64).cumsum() + 8 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([8 + 4 * n, *ends], ends)]


def numbering() -> defaultdict:
    """Numbers its keys from 0 in the order in which they are first asked for."""
    return defaultdict(count().__next__)


def numbers(index: defaultdict, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(index.__getitem__, words), np.uint32, len(words))


def places(codes: np.ndarray) -> bytes:
    return squeeze(codes.astype("<u4").tobytes())


def placed(data: bytes) -> np.ndarray:
    return np.frombuffer(unsqueeze(data), "<u4")


_PLANES = ("low", "middle", "high")


def codes_to(rows: list[np.ndarray]) -> pa.StructArray:
    """Codes below 2^24 as their low, middle and high bytes, each in a column of its own."""
    planes = [[], [], []]
    for codes in rows:
        of = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
        for plane, one in zip(planes, of):
            plane.append(one.tobytes())
    return pa.StructArray.from_arrays([pa.array(p, pa.binary()) for p in planes], _PLANES)


def codes_of(row: dict[str, bytes]) -> np.ndarray:
    low, middle, high = (np.frombuffer(row[plane], np.uint8).astype(np.uint32) for plane in _PLANES)
    return low | middle << 8 | high << 16


@dataclass
class Coded:
    """One staged table of texts as codes and of the blocks' words.

    ``rows(block, <other columns>, codes, size)``: a text's codes (see ``codes_of``) and their number.
    ``messages(block, owner, places, words, learnt)``: the packed words of a block that have one owner, the codes they
    have there, and how often each stands in the block's rows that are learnt from (32-bit; null where none was asked
    for). ``table`` has both.
    """

    table: DataFrame
    names: list[str]
    buckets: int

    @property
    def rows(self) -> DataFrame:
        return self.table.where("owner is null").select("block", *self.names, "codes", "size")

    @property
    def messages(self) -> DataFrame:
        return self.table.where("owner is not null").select("block", "owner", "places", "words", "learnt")

    def by_block(self, replies: DataFrame, label: str) -> DataFrame:
        """Staged replies, brought to the blocks once for all the times they are met."""
        return staged_by(replies.repartition(self.buckets, "block"), label, "block", self.buckets)


def coded(
    docs: DataFrame, split: Callable[[bytes], list[bytes]], label: str, text_col: str = "text", learn: str | None = None, block_words: int = BLOCK_WORDS, block_tokens: int = BLOCK_TOKENS
) -> Coded:
    """One pass over the texts; a null text has no words. Words of rows whose column ``learn`` holds are counted."""
    carried = [T.StructField(f.name, f.dataType) for f in docs.schema.fields if f.name != text_col]
    names = [f.name for f in carried]
    buckets = scan_buckets(docs)
    owners = 4 * buckets
    schema = T.StructType([T.StructField("block", T.IntegerType()), *carried, *T._parse_datatype_string("codes struct<low:binary,middle:binary,high:binary>, size long, owner int, places binary, words binary, learnt binary").fields])
    learnt_at = names.index(learn) if learn else None
    codes_type = pa.struct([(plane, pa.binary()) for plane in _PLANES])
    said_types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    if block_words + block_tokens >= 1 << 24:
        raise ValueError("codes have 24 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, epoch = TaskContext.get().partitionId(), 0
        index, pieces, held = numbering(), [], 0

        def row_batch(block: int, n: int, columns: list[pa.Array], codes=None, message=None) -> pa.RecordBatch:
            said = [pa.array(c, t) for c, t in zip(message, said_types)] if message else [pa.nulls(n, t) for t in said_types]
            found = [codes_to(codes), pa.array(list(map(len, codes)), pa.int64())] if codes is not None else [pa.nulls(n, codes_type), pa.nulls(n, pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int32)), *columns, *found, *said], names=schema.names)

        def out() -> Iterator[pa.RecordBatch]:
            if not pieces:
                return
            block = slot(part + buckets * epoch)
            words = list(index)
            often = np.zeros(len(words), np.int64)
            for _, found in pieces:
                often += np.bincount(np.concatenate(found), minlength=len(words))
            rank = np.argsort(-often, kind="stable")
            code = np.empty(len(words), np.uint32)
            code[rank] = np.arange(len(words), dtype=np.uint32)
            sums = np.zeros(len(words), np.int64)
            for columns, found in pieces:
                found = [code[c] for c in found]
                if learn:
                    read = [c for c, yes in zip(found, columns[learnt_at].to_pylist()) if yes]
                    if read:
                        sums += np.bincount(np.concatenate(read), minlength=len(words))
                yield row_batch(block, len(found), columns, found)
            words = [words[i] for i in rank.tolist()]
            owner = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(owners)
            order = np.argsort(owner, kind="stable")
            said: tuple[list, ...] = ([], [], [], [])
            for at in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1) if words else ():
                said[0].append(int(owner[at[0]]))
                said[1].append(places(at))
                said[2].append(pack([words[i] for i in at.tolist()]))
                said[3].append(squeeze(sums[at].astype("<u4").tobytes()) if learn else None)
            if words:
                yield row_batch(block, len(said[0]), [pa.nulls(len(said[0]), c.type) for c in pieces[0][0]], message=said)

        for whole in batches:
            for batch in slices(whole, 500):
                columns, found, at = [batch.column(i) for i in range(len(names))], [], 0
                for i, raw in enumerate(byte_column(batch, text_col)):
                    found.append(numbers(index, split(raw or b"")))
                    held += len(found[-1])
                    if len(index) >= block_words or held >= block_tokens:
                        pieces.append(([c.slice(at, i + 1 - at) for c in columns], found))
                        yield from out()
                        index, pieces, held, epoch, found, at = numbering(), [], 0, epoch + 1, [], i + 1
                if found:
                    pieces.append(([c.slice(at) for c in columns], found))
        yield from out()

    rows = docs.select(*names, text_col).mapInArrow(run, schema)
    table = staged_by(rows, label, "block", buckets)
    return Coded(table, names, buckets)


def met(rows: DataFrame, replies: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """Every block's rows with the replies to it; the rows are not moved."""
    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)

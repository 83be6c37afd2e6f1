"""Product codes of vectors by weighted Lloyd over distinct parts.

Vectors become integers and are cut into equal parts. Equal parts of one position are one row with a weight, found in two
steps: within a block (a stretch of a scan partition), then at the part's owner, who has it from all blocks. So a vector
or part that a third of all rows share costs each block one message and its owner one row. Lloyd's rounds run over these
weighted rows alone; at the end the owners code each of their parts once and answer the blocks, which put codes and
errors back together in the order of their vectors. Vectors themselves are never moved, only their distinct parts are.

All arithmetic is exact: 64-bit integers where nothing can overflow, else Python's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.blocks import codes_of, codes_to, met, squeeze, unsqueeze
from newsloom.llm.common import join_hot, scan_buckets, slot, staged, staged_by

#: Vectors of a block, of a row of its table, and distinct parts whose distances are held at once.
_BLOCK, _CHUNK, _ASSIGNED = 1 << 17, 1 << 12, 1 << 14
#: Distinct parts (as told by blocks) that an owner may have.
_OWNED = 1 << 22
_MOST = (1 << 63) - 1
Codebooks = list[list[list[int]]]  # by position, entry, place in the part


def usable(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(vector, finite), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component (beyond 64 bits: the nearest 64-bit integer)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)))


def nearest(parts: np.ndarray, book: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: the lower) and the squared distance to it, exactly."""
    entries = np.array(book, dtype=object)
    bound = max(_bound(parts), _bound(entries))
    exact = np.int64 if parts.shape[1] * (2 * bound) ** 2 <= _MOST else object
    entries, code, far = entries.astype(exact), np.empty(len(parts), np.uint8), np.empty(len(parts), exact)
    for at in range(0, len(parts), _ASSIGNED):
        here = parts[at : at + _ASSIGNED].astype(exact)
        d = np.stack([((here - e) ** 2).sum(1) for e in entries], axis=1)
        code[at : at + _ASSIGNED] = best = d.argmin(1)
        far[at : at + _ASSIGNED] = d[np.arange(len(d)), best]
    return code, far


def _bound(values: np.ndarray) -> int:
    """The largest absolute value."""
    return max(int(values.max()), -int(values.min())) if values.size else 0


def weighted_sums(parts: np.ndarray, weights: np.ndarray, code: np.ndarray, entries: int) -> list[list[int]]:
    """For each entry the weighted component sums of its parts, and behind them their weight."""
    out = []
    for e in range(entries):
        mine, w = parts[code == e], weights[code == e]
        total = int(w.sum())
        exact = np.int64 if _bound(mine) * total <= _MOST else object
        out.append([int(v) for v in (mine.astype(exact) * w.astype(exact)[:, None]).sum(0)] + [total])
    return out


def moved(book: list[list[int]], sums: list[list[int]]) -> list[list[int]]:
    """Every entry at the floor of its parts' mean; unused ones stay."""
    return [[v // s[-1] for v in s[:-1]] if s[-1] else entry for entry, s in zip(book, sums)]


def _owners(keys: np.ndarray, position: int, owners: int) -> np.ndarray:
    """Owners of parts (a row of integers each), by a hash of position and values."""
    h = np.full(len(keys), position + 1, np.uint64)
    with np.errstate(over="ignore"):
        for column in keys.astype(np.int64).view(np.uint64).reshape(keys.shape).T:
            h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return (h % np.uint64(owners)).astype(np.int64)


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of integers, and the number of each row among them."""
    packed = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).reshape(-1)
    first, inverse = np.unique(packed, return_index=True, return_inverse=True)[1:]
    return rows[first], inverse.reshape(-1)


class Exchange:
    """Blocks of vectors and the owners of their distinct parts; see the module's text."""

    def __init__(self, vectors: DataFrame, dims: int, positions: int, kind: str, owners: int, block_rows: int):
        self.positions, self.width, self.kind, self.owners = positions, dims // positions, np.dtype(kind), owners
        self.vectors, self.block_rows, self.buckets = vectors, block_rows, scan_buckets(vectors)
        if block_rows * positions >= 1 << 24:
            raise ValueError("codes of a block have 24 bits")

    def blocks(self) -> DataFrame:
        """``vectors(id, label, v)`` -> staged by block: rows ``(block, ids, labels, codes)``, messages ``(block, owner, at, start, keys, weights)``.

        A vector's codes are the numbers of its parts in the block. A message has an owner's distinct parts of position
        ``at``, whose numbers count on from ``start``, and how often each stands in the block.
        """
        kinds = {f.name: f.dataType for f in self.vectors.schema.fields}
        arrow = {f.name: f.type for f in self.vectors.limit(0).toArrow().schema}
        schema = T.StructType([
            T.StructField("block", T.IntegerType()), T.StructField("ids", T.ArrayType(kinds["id"])), T.StructField("labels", T.ArrayType(kinds["label"])),
            *T._parse_datatype_string("codes struct<low:binary,middle:binary,high:binary>, owner int, at int, start int, keys binary, weights binary").fields,
        ])
        codes_type = pa.struct([(p, pa.binary()) for p in ("low", "middle", "high")])
        types = [pa.int32(), pa.list_(arrow["id"]), pa.list_(arrow["label"]), codes_type, pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        positions, width, kind, owners, most, buckets = self.positions, self.width, self.kind, self.owners, self.block_rows, self.buckets

        def batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, t) for f, t in zip(schema.fields, types)], names=schema.names)

        def out(block: int, ids: pa.Array, labels: pa.Array, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            told, codes, start = [], np.empty((len(values), positions), np.uint32), 0
            for at in range(positions):
                found, inverse = distinct_rows(values[:, at * width : (at + 1) * width].astype(kind))
                weights, owner = np.bincount(inverse, minlength=len(found)), _owners(found, at, owners)
                order = np.argsort(owner, kind="stable")
                number = np.empty(len(order), np.uint32)
                number[order] = np.arange(start, start + len(order), dtype=np.uint32)
                codes[:, at] = number[inverse]
                owner = owner[order]
                for mine in np.split(np.arange(len(order)), np.flatnonzero(np.diff(owner)) + 1):
                    which = order[mine]
                    told.append((int(owner[mine[0]]), at, start + int(mine[0]), squeeze(np.ascontiguousarray(found[which]).tobytes()), squeeze(weights[which].astype("<u4").tobytes())))
                start += len(order)
            columns = zip(("owner", "at", "start", "keys", "weights"), types[4:], zip(*told))
            yield batch(len(told), block=pa.array([block] * len(told), pa.int32()), **{name: pa.array(c, t) for name, t, c in columns})
            for a in range(0, len(values), _CHUNK):
                b = min(a + _CHUNK, len(values))
                one = lambda c: pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), c.slice(a, b - a))
                yield batch(1, block=pa.array([block], pa.int32()), ids=one(ids), labels=one(labels), codes=codes_to([codes[a:b].reshape(-1)]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, epoch, held, n = TaskContext.get().partitionId(), 0, [], 0

            def joined() -> tuple[pa.Array, pa.Array, np.ndarray]:
                ids, labels = (pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
                return ids, labels, np.concatenate([b.column(2).flatten().to_numpy() for b in held]).reshape(len(ids), -1)

            for whole in batches:
                at = 0
                while at < whole.num_rows:
                    held.append(whole.slice(at, most - n))
                    at, n = at + held[-1].num_rows, n + held[-1].num_rows
                    if n == most:
                        yield from out(slot(part + buckets * epoch), *joined())
                        held, n, epoch = [], 0, epoch + 1
            if n:
                yield from out(slot(part + buckets * epoch), *joined())

        return staged_by(self.vectors.select("id", "label", "v").mapInArrow(run, schema), "vector-blocks", "block", buckets)

    def owned(self, blocks: DataFrame) -> DataFrame:
        """Weighted distinct rows and what blocks asked for, staged by owner.

        Rows ``(owner, at, keys, weights)`` hold an owner's distinct parts of a position, in pieces in order; rows
        ``(owner, at, block, start, ids)`` the numbers of those that a block told of.
        """
        positions, width, kind = self.positions, self.width, self.kind

        def run(told: pa.Table) -> pa.Table:
            owner, out = told["owner"][0].as_py(), []
            for at in range(positions):
                here = told.filter(pc.equal(told["at"], at)).select(["block", "start", "keys", "weights"]).to_pylist()
                if not here:
                    continue
                asked = [np.frombuffer(unsqueeze(r["keys"]), kind).reshape(-1, width) for r in here]
                found, inverse = distinct_rows(np.concatenate(asked))
                often = np.concatenate([np.frombuffer(unsqueeze(r["weights"]), "<u4") for r in here]).astype(np.int64)
                weights = np.zeros(len(found), np.int64)
                np.add.at(weights, inverse, often)
                for a in range(0, len(found), 1 << 16):
                    piece = slice(a, a + (1 << 16))
                    out.append((owner, at, np.ascontiguousarray(found[piece]).tobytes(), weights[piece].astype("<i8").tobytes(), a, None, None))
                ends = np.cumsum([len(k) for k in asked])
                for r, ids in zip(here, np.split(inverse, ends[:-1])):
                    out.append((owner, at, None, None, r["start"], r["block"], squeeze(ids.astype("<u4").tobytes())))
            types = dict(owner=pa.int32(), at=pa.int32(), keys=pa.binary(), weights=pa.binary(), start=pa.int32(), block=pa.int32(), ids=pa.binary())
            return pa.table({name: pa.array(c, t) for (name, t), c in zip(types.items(), zip(*out))})

        messages = blocks.where("owner is not null").select("block", "owner", "at", "start", "keys", "weights")
        schema = "owner int, at int, keys binary, weights binary, start int, block int, ids binary"
        return staged_by(messages.groupBy("owner").applyInArrow(run, schema), "vector-owners", "owner", min(self.owners, 100_000))

    def round(self, owned: DataFrame, books: Codebooks) -> Codebooks:
        """One round of weighted Lloyd; only sums by entry, as many numbers as codebooks have, reach the driver."""
        kind, width, positions, k = self.kind, self.width, self.positions, len(books[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((positions, k, width + 1), object)
            for batch in batches:
                for at, keys, weights in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    parts, w = np.frombuffer(keys, kind).reshape(-1, width), np.frombuffer(weights, "<i8")
                    sums[at] += np.array(weighted_sums(parts, w, nearest(parts, books[at])[0], k), dtype=object)
            some = [(i, Decimal(int(v))) for i, v in enumerate(sums.reshape(-1)) if v]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int32()), pa.array([v for _, v in some], pa.decimal128(38, 0))], names=["i", "v"])

        told = owned.where("keys is not null").select("at", "keys", "weights").mapInArrow(run, "i int, v decimal(38,0)")
        sums = np.zeros(positions * k * (width + 1), object)
        for i, v in told.groupBy("i").agg(F.sum("v").alias("v")).collect():
            sums[i] = int(v)
        return [moved(book, s.tolist()) for book, s in zip(books, sums.reshape(positions, k, width + 1))]

    def coded(self, blocks: DataFrame, owned: DataFrame, books: Codebooks) -> DataFrame:
        """``(id, label, code, error)`` for every vector: owners code their distinct parts and answer, blocks put codes together."""
        kind, width, positions = self.kind, self.width, self.positions
        def answer(mine: pa.Table) -> pa.Table:
            rows, out = sorted(mine.to_pylist(), key=lambda r: (r["at"], r["keys"] is None, r["start"])), []
            code, far, now = [], [], None
            for r in rows:
                if r["keys"] is not None:
                    if r["at"] != now:
                        code, far, now = [], [], r["at"]
                    c, d = nearest(np.frombuffer(r["keys"], kind).reshape(-1, width), books[now])
                    code.append(c)
                    far.append(np.minimum(d, _MOST).astype(np.int64))
                else:
                    if len(code) > 1:
                        code, far = [np.concatenate(code)], [np.concatenate(far)]
                    ids = np.frombuffer(unsqueeze(r["ids"]), "<u4")
                    out.append((r["block"], r["start"], squeeze(code[0][ids].tobytes()), squeeze(far[0][ids].astype("<i8").tobytes())))
            return pa.table({name: pa.array(c, t) for name, t, c in zip(("block", "start", "code", "far"), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), zip(*out))})

        def together(rows: pa.Table, said: pa.Table) -> pa.Table:
            code, far = (np.concatenate(c) for c in zip(*(
                (np.frombuffer(unsqueeze(r["code"]), np.uint8), np.frombuffer(unsqueeze(r["far"]), "<i8")) for r in sorted(said.to_pylist(), key=lambda r: r["start"])
            )))
            texts, errors = [], []
            for row in rows["codes"].to_pylist():
                at = codes_of(row)
                hexed, d = code[at].tobytes().hex(), far[at].reshape(-1, positions)
                texts += [hexed[i : i + 2 * positions] for i in range(0, len(hexed), 2 * positions)]
                errors.append(np.minimum(d.astype(object).sum(1), _MOST).astype(np.int64) if d.max(initial=0) > _MOST // positions else d.sum(1))
            flat = lambda name: pa.chunked_array([c.flatten() for c in rows[name].chunks])
            return pa.table({"id": flat("ids"), "label": flat("labels"), "code": pa.array(texts, pa.string()), "error": pa.array(np.concatenate(errors), pa.int64())})

        replies = owned.groupBy("owner").applyInArrow(answer, "block int, start int, code binary, far binary")
        by_block = staged_by(replies.repartition(self.buckets, "block"), "vector-replies", "block", self.buckets)
        of = {f.name: f.dataType.simpleString() for f in self.vectors.schema.fields}
        rows = blocks.where("owner is null").select("block", "ids", "labels", "codes")
        return met(rows, by_block, together, f"id {of['id']}, label {of['label']}, code string, error long")


def codebook_text(books: Codebooks) -> str:
    """All entries' components by position, entry and place."""
    return ",".join(str(v) for book in books for entry in book for v in entry)


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 4096, positions: int = 8, entries: int = 16, rounds: int = 6, block_rows: int = _BLOCK
) -> DataFrame:
    """``(id, code, error, label_error, codebooks_sha256)`` for every usable row of ``vectors``.

    Rows whose vector is null, empty or holds null or non-finite components are dropped. Vectors have the length of the
    first by id (ties of the id: the smaller vector; null ids last); those of another length have no code and are
    dropped as well, as are all if ``positions`` does not divide it. A codebook starts as the parts of the first
    ``entries`` rows, fewer if there are fewer. Repeated rows and repeated or null ids are coded each; null labels are
    one label; sums beyond 64 bits are given as the largest 64-bit number; an empty table gives an empty result; other
    columns are not read. ``block_rows`` bounds what a task holds, not what is done.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v")).where(usable(F.col("v"))).withColumn("v", integers(F.col("v"), scale))
    # a null id sorts behind all others
    first = lambda df, n: df.orderBy(F.col("id").asc_nulls_last(), "v").limit(n).select("v").collect()
    lead = first(rows, entries)
    dims = len(lead[0]["v"]) if lead else 0
    if any(len(r["v"]) != dims for r in lead):
        lead = first(rows.where(F.size("v") == dims), entries)
    if not dims or dims % positions:
        lead, rows = [], rows.where(F.lit(False))
    rows = rows.where(F.size("v") == dims)
    n, low, high = rows.agg(F.count("*"), F.min(F.array_min("v")), F.max(F.array_max("v"))).first() if lead else (0, 0, 0)
    if not n:
        return rows.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    width = dims // positions
    books = [[r["v"][at * width : (at + 1) * width] for r in lead] for at in range(positions)]
    kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    spread = min(4 * spark.sparkContext.defaultParallelism, -(-n // 512))
    exchange = Exchange(rows, dims, positions, kind, max(1, spread, -(-n * positions // _OWNED)), block_rows)
    blocks = exchange.blocks()
    owned = exchange.owned(blocks)
    for _ in range(rounds):
        books = exchange.round(owned, books)
    # labels are met as structs, in which nulls are equal
    coded = staged(exchange.coded(blocks, owned, books).withColumn("key", F.struct("label")), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(_MOST))).cast("long")
    sums = staged(coded.groupBy("key").agg(total.alias("label_error"), F.count("*").alias("n")), "label-errors")
    sha = hashlib.sha256(codebook_text(books).encode()).hexdigest()
    return join_hot(coded, sums, "key", n).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))

"""Helpers that the corpus operators share: staged tables, positions, byte-level words, Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a scope has staged: (session, path, name of the catalogue or None).
Staged = list[tuple[weakref.ref, str, str | None]]
_PROCESS: Staged = []
#: Row groups are small, as every open file holds one in memory.
_FILES = {"compression": "zstd", "parquet.block.size": str(16 << 20)}
_SCOPE: ContextVar[Staged] = ContextVar("staged", default=_PROCESS)

#: Lower-cases A-Z and turns every ASCII byte that is no digit or letter into a space; other bytes stay.
_ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def space_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z (both bytes methods only touch ASCII)."""
    return raw.lower().split()


def alnum_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return raw.translate(_ALNUM).split()


# --- staged tables -----------------------------------------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A temporary one of our own serves only where it is unset and everything runs on this machine; on a cluster that
    names none this raises, as no executor could read what another wrote.
    """
    context = spark.sparkContext
    conf = context.getConf()
    found = conf.get("spark.checkpoint.dir") if conf.contains("spark.checkpoint.dir") else None
    if not found:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="newsloom-")
        context.setCheckpointDir(found)
    return found


def _place(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/newsloom-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage: a lost executor costs the reread of a few files, never the whole plan again, and rows keep
    whatever ids were given to them before.
    """
    return staged_at(df, label)[0]


def staged_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``staged``, with its folder, for those who remove it themselves once it has been read."""
    spark = df.sparkSession
    path = _place(spark, label)
    _SCOPE.get().append((weakref.ref(spark), path, None))
    df.write.options(**_FILES).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def staged_by(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """``staged``, bucketed by ``key``: what is later joined or grouped by it meets these rows where they lie.

    Every task here writes one value of ``key`` or few of the same bucket, so files stay few and nothing is sorted.
    """
    spark, open_files = df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    path = _place(spark, label)
    name = f"newsloom_{label.replace('-', '_')}_{uuid.uuid4().hex}"
    _SCOPE.get().append((weakref.ref(spark), path, name))
    before = spark.conf.get(open_files)
    spark.conf.set(open_files, "8")
    try:
        df.write.options(**_FILES, path=path).bucketBy(buckets, key).saveAsTable(name)
    finally:
        spark.conf.set(open_files, before)
    return spark.table(name)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def remove_later(spark: SparkSession, path: str) -> None:
    """Have a folder deleted with what is staged outside any scope: by ``release_staged`` or when the process ends."""
    _PROCESS.append((weakref.ref(spark), path, None))


def _delete(found: Staged) -> None:
    while found:
        ref, path, name = found.pop()
        spark = ref()
        try:
            if name:
                spark.sql(f"drop table if exists {name}")
            remove_folder(spark, path)
        except Exception:  # noqa: BLE001  the session has ended: nothing can be deleted through it
            continue


@contextmanager
def staging() -> Iterator[None]:
    """Tables staged inside are deleted at the end; results of other callers keep theirs.

    Only for callers that write inside all results which read them.
    """
    found: Staged = []
    token = _SCOPE.set(found)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        _delete(found)


def release_staged() -> None:
    """Delete what was staged outside any ``staging`` scope; only for callers that have written all results."""
    _delete(_PROCESS)


atexit.register(release_staged)

# --- positions ---------------------------------------------------------------------------------------------------

_LOW32 = (1 << 32) - 1


def _unhash(mul, xor, right, left) -> list:
    """Steps from ``n`` to the 32-bit value whose Murmur3 hash with seed 42, by which Spark buckets an int, is ``n``.

    Every step of that hash can be undone: shifts by xor, products by the inverse factor, rotations by their rest.
    """
    back = lambda c: lambda h: mul(h, pow(c, -1, 1 << 32))
    turn = lambda h, r: xor(left(h, r), right(h, 32 - r))
    return [
        lambda h: xor(h, right(h, 16)), back(0xC2B2AE35),
        lambda h: xor(h, xor(right(h, 13), right(h, 26))), back(0x85EBCA6B),
        lambda h: xor(xor(h, right(h, 16)), 4),  # four bytes long
        lambda h: mul(h + (1 << 32) - 0xE6546B64, 1), back(5),
        lambda h: xor(turn(h, 19), 42), back(0x1B873593),
        lambda h: turn(h, 17), back(0xCC9E2D51),
    ]


def slot(n: int) -> int:
    """The int that Spark puts into bucket ``n`` (mod the number of buckets); no two numbers share one."""
    for step in _unhash(lambda h, c: h * c & _LOW32, lambda a, b: a ^ b, lambda h, r: h >> r, lambda h, r: h << r & _LOW32):
        n = step(n)
    return n - (1 << 32) if n >> 31 else n


def slot_column(n: Column) -> Column:
    """``slot`` of a column of numbers below 2^31, in products of at most 49 bits."""
    number = lambda v: F.lit(v).cast("long") if isinstance(v, int) else v
    low = lambda h, bits: h.bitwiseAND(number((1 << bits) - 1))

    def mul(h: Column, c: int) -> Column:
        return low(low(h, 16) * number(c) + F.shiftleft(low(F.shiftright(h, 16) * number(c), 16), 16), 32)

    # a step names its value several times: an array of one and a lambda keep the expression from doubling with each
    value = F.array(n.cast("long"))
    for step in _unhash(mul, lambda a, b: a.bitwiseXOR(number(b)), F.shiftright, lambda h, r: low(F.shiftleft(h, r), 32)):
        value = F.transform(value, step)
    return (F.get(value, F.lit(0)).bitwiseXOR(number(1 << 31)) - number(1 << 31)).cast("int")


def scan_buckets(docs: DataFrame) -> int:
    """As many buckets as ``docs`` has scan partitions (Spark allows 100,000)."""
    return min(max(1, docs.rdd.getNumPartitions()), 100_000)


def positioned(docs: DataFrame, label: str, **more: Column) -> DataFrame:
    """``docs`` staged where they lie: ``(slot int, ord int, row struct<docs' columns>, more)``.

    ``slot`` names the scan partition and its bucket, ``ord`` the place in it. Columns of ``docs``, whatever their
    names, are inside ``row``; expressions of ``more`` are taken over ``docs``. One write, no shuffle; rows are found
    again by position where they lie.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("int").alias("ord")
    placed = docs.select(F.spark_partition_id().alias("part"), place, row, *(c.alias(name) for name, c in more.items()))
    return staged_by(placed.select(slot_column(F.col("part")).alias("slot"), "ord", "row", *more), label, "slot", scan_buckets(docs))


def bit_words(places: np.ndarray) -> np.ndarray:
    """A bitmap of 64-bit words with the bits at ``places`` set."""
    bits = np.zeros((int(places.max(initial=-1)) // 64 + 1) * 64, np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


BITS = "slot int, bits array<bigint>"


def bits_row(slot_of_rows: int, places: np.ndarray) -> pa.Table:
    return pa.table({"slot": pa.array([slot_of_rows], pa.int32()), "bits": pa.array([bit_words(places)], pa.list_(pa.int64()))})


def position_bits(places: DataFrame) -> DataFrame:
    """``places(slot, ord)`` as a bitmap for each scan partition: ``(slot, bits)``."""
    run = lambda t: bits_row(t["slot"][0].as_py(), t["ord"].to_numpy())
    return places.select("slot", "ord").groupBy("slot").applyInArrow(run, BITS)


def at_positions(table: DataFrame, bits: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of a ``positioned`` table whose bit is set, or (``left_anti``) the others.

    The table is not moved: its buckets are by slot, the bitmaps (one row for each scan partition) come to them.
    """
    there = bits.select(F.col("slot").alias("slot_"), "bits").hint("shuffle_hash")
    word = F.get("bits", F.shiftright(F.col("ord"), 6))
    is_set = F.getbit(word, F.col("ord").bitwiseAND(F.lit(63))) == 1
    return table.join(there, (F.col("slot") == F.col("slot_")) & is_set, how)


def join_hot(rows: DataFrame, table: DataFrame, key: str, most: int) -> DataFrame:
    """Inner join of ``rows`` with ``table(key, n, ...)``, a row for each key, whatever share one key has of the rows.

    ``n`` is how often the key stands in ``rows``. Keys with more than a thousandth of ``most``, the number of all
    rows, are fewer than a thousand: they are broadcast, and only the rest is dealt by key. The rest grows with the rows,
    so it is merged: left alone, Spark would send up to ``autoBroadcastJoinThreshold`` of its files through the driver.
    """
    hot = F.col("n") > most // 1000
    return rows.join(F.broadcast(table.where(hot)), key).unionByName(
        rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti").join(table.where(~hot).hint("merge"), key)
    )


# --- Arrow batches -----------------------------------------------------------------------------------------------


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Small pieces of a batch, so that what is made from long texts stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` has it (names are equal in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

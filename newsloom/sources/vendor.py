"""Vendor answers as a data source: windows of time are its partitions, in batch and as a stream.

An archive of answers has a folder a window, ``window=<first day>``, with files of one JSON answer a line: a list of
records, or an object that holds the list as ``news``. Any store that ``pyarrow.fs`` knows may hold it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: The settings that let a filter reach a source written in Python.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Window(InputPartition):
    """A window of days, both included."""

    first: date
    last: date


def windows(start: date, end: date, stride: int) -> list[Window]:
    """Strides from ``start``, the last cut at ``end``."""
    out = []
    while start <= end:
        out.append(Window(start, min(end, start + timedelta(days=stride - 1))))
        start += timedelta(days=stride)
    return out


def _files(folder: str):
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return store, root


def records(folder: str, window: Window) -> Iterator[dict]:
    """What the answers of a window hold, in the order of its files and lines; a window without a folder holds nothing."""
    from pyarrow import fs

    store, root = _files(folder)
    at = f"{root}/window={window.first.isoformat()}"
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return
    for info in sorted(store.get_file_info(fs.FileSelector(at)), key=lambda i: i.path):
        if info.base_name.startswith(("_", ".")):
            continue
        with store.open_input_stream(info.path) as stream:
            for line in stream.read().decode().split("\n"):
                if line.strip():
                    said = json.loads(line)
                    yield from said["news"] if isinstance(said, dict) else said


def _rows(folder: str, window: Window, names: list[str]) -> Iterator[tuple]:
    for record in records(folder, window):
        yield tuple(date.fromisoformat(record[n]) if n == "day" and record.get(n) else record.get(n) for n in names)


class AnswerReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.folder, self.names = options["path"], [f.name for f in schema.fields]
        self.windows = windows(date.fromisoformat(options["from"]), date.fromisoformat(options["to"]), int(options.get("stride", "31")))

    def pushFilters(self, filters: list) -> Iterable:
        """Bounds of ``day`` take windows out; every filter is still applied to the rows."""
        for f in filters:
            if getattr(f, "attribute", None) == ("day",) and isinstance(getattr(f, "value", None), date):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.windows = [w for w in self.windows if w.last >= f.value]
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.windows = [w for w in self.windows if w.first <= f.value]
            yield f

    def partitions(self) -> list[Window]:
        return self.windows or [Window(date.max, date.max)]

    def read(self, partition: Window) -> Iterator[tuple]:
        return _rows(self.folder, partition, self.names)


class AnswerStream(DataSourceStreamReader):
    """Offsets count windows; those whose folder is there, without a gap, have arrived."""

    def __init__(self, options: dict, schema: StructType):
        self.folder, self.names = options["path"], [f.name for f in schema.fields]
        self.windows = windows(date.fromisoformat(options["from"]), date.fromisoformat(options["to"]), int(options.get("stride", "31")))

    def initialOffset(self) -> dict:
        return {"windows": 0}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, root = _files(self.folder)
        n = 0
        while n < len(self.windows) and store.get_file_info(f"{root}/window={self.windows[n].first.isoformat()}").type != fs.FileType.NotFound:
            n += 1
        return {"windows": n}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        return self.windows[start["windows"] : end["windows"]]

    def read(self, partition: Window) -> Iterator[tuple]:
        return _rows(self.folder, partition, self.names)

    def commit(self, end: dict) -> None:
        pass


class Answers(DataSource):
    """``spark.read.format("vendor_answers").schema(..).option("from", ..).option("to", ..).load(path)``.

    ``stride`` is the days of a window (31). Fields that an answer lacks are null; a field ``day`` is an ISO date.
    """

    @classmethod
    def name(cls) -> str:
        return "vendor_answers"

    def schema(self) -> str:
        return "day date, symbol string, title string, content string"

    def reader(self, schema: StructType) -> AnswerReader:
        return AnswerReader(self.options, schema)

    def streamReader(self, schema: StructType) -> AnswerStream:
        return AnswerStream(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Answers)
    spark.conf.set(PUSHDOWN, "true")


def write_answers(rows: DataFrame, path: str, start: date, stride: int = 31, page: int = 100, pages: int = 64) -> None:
    """An archive of answers from ``rows`` with a ``day``: up to about ``page`` records an answer, never a window in one.

    Records are dealt over a window's answers by a hash, so that a window of very many rows is still many answers.
    """
    first = F.date_add(F.lit(start), (F.floor(F.datediff("day", F.lit(start)) / stride) * stride).cast("int"))
    said = rows.select(first.alias("window"), F.struct(*rows.columns).alias("r"))
    sizes = said.groupBy("window").agg(F.count("*").alias("n"))  # a row a window
    dealt = said.join(F.broadcast(sizes), "window").withColumn("answer", F.pmod(F.xxhash64("r"), F.ceil(F.col("n") / page)))
    answers = dealt.groupBy("window", "answer").agg(F.collect_list("r").alias("news"))
    text = F.when(F.col("answer") % 2 == 0, F.to_json("news")).otherwise(F.to_json(F.struct("news")))
    answers.select(F.col("window").cast("string").alias("window"), text.alias("value")).repartition(pages, "window", "answer").write.partitionBy("window").text(path)

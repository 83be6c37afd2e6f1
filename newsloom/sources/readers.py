"""Sources: files of several formats, symbol lists, vendor payloads, paging windows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEWS_SCHEMA = T.StructType(
    [
        T.StructField("date", T.TimestampType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("symbols", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("sentiment", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
PRICE_SCHEMA = T.StructType([T.StructField("date", T.DateType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adjusted_close")), T.StructField("volume", T.LongType())])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; columns and rows are pruned by the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its scan has fewer partitions (a single small file); larger scans are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def csv_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; a schema avoids a pass over the data to infer one. Quoted fields may hold line ends."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def latest_file(spark: SparkSession, pattern: str) -> DataFrame:
    """The Parquet file or folder of a glob pattern whose name comes last; listed through Hadoop, so any store will do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    names = sorted(str(s.getPath().toString()) for s in found) if found else []
    if not names:
        raise FileNotFoundError(pattern)
    return spark.read.parquet(names[-1])


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """``(word)`` of a list file: trimmed lines without blank ones and # comments."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("word")).where((F.col("word") != "") & ~F.col("word").startswith("#"))


def news_payload(spark: SparkSession, path: str) -> DataFrame:
    """Articles from vendor answers, one JSON document a file: a list, or an object holding the list as ``news``."""
    whole = spark.read.option("wholetext", True).text(path)
    listed = F.from_json("value", T.ArrayType(NEWS_SCHEMA))
    held = F.from_json("value", T.StructType([T.StructField("news", T.ArrayType(NEWS_SCHEMA))]))["news"]
    articles = F.when(F.trim("value").startswith("{"), held).otherwise(listed)
    return whole.select(F.explode(articles).alias("a")).select("a.*")


def price_payload(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Prices from a vendor answer (a JSON list), with their symbol."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", T.ArrayType(PRICE_SCHEMA))).alias("p")).select("p.*", F.lit(symbol).alias("symbol"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (f.select("*") for f in frames))


def readable(paths: list[str], read: Callable[[str], DataFrame]) -> tuple[list[DataFrame], dict[str, str]]:
    """Frames of the inputs that can be read, and why the others cannot: one vendor answer missing does not stop the rest."""
    frames, skipped = [], {}
    for path in paths:
        try:
            frame = read(path)
            frame.limit(1).collect()  # files are opened here, not when a frame is made
            frames.append(frame)
        except (PySparkException, Py4JJavaError) as error:
            skipped[path] = str(error).split("\n")[0]
    return frames, skipped


def paging_windows(bounds: DataFrame, start: Column, end: Column, stride: int = 31) -> DataFrame:
    """``(window_from, window_to)``: strides from start, each ``stride - 1`` days long at most, none past the end."""
    starts = bounds.select(F.explode(F.sequence(start, end, F.expr(f"interval {stride} days"))).alias("window_from"), end.alias("end"))
    return starts.select("window_from", F.least(F.date_add("window_from", stride - 1), F.col("end")).alias("window_to"))


def long_quotes(wide: DataFrame, tickers: list[str], field: str = "adj_close") -> DataFrame:
    """Quotes with a column for each ticker (``<field>_<ticker>``) as rows of ``(date, ticker, <field>)`` without nulls."""
    pairs = ", ".join(f"'{t}', `{field}_{t}`" for t in tickers)
    return wide.selectExpr("date", f"stack({len(tickers)}, {pairs}) as (ticker, {field})").where(F.col(field).isNotNull())


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df``; raises ValueError naming the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def columns_like(df: DataFrame, prefix: str = "topic_", without_suffix: str = "_smoothed") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and not c.endswith(without_suffix)]

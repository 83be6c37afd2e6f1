import datetime as dt
import json

from pyspark.sql import functions as F

from newsloom.sources import vendor

DAY = dt.date(2024, 1, 1)
SCHEMA = "day date, symbol string, title string, n long"


def rows_of(spark, n=400):
    rows = [(DAY + dt.timedelta(days=i % 90), f"s{i % 3}", None if i % 7 == 0 else f'tïtle "{i}"\n', i) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def load(spark, path, start=DAY, end=dt.date(2024, 3, 30), stride=10):
    vendor.register(spark)
    return spark.read.format("vendor_answers").schema(SCHEMA).option("from", start.isoformat()).option("to", end.isoformat()).option("stride", stride).load(path)


def test_answers_are_read_back_by_windows(spark, tmp_path):
    rows, df = rows_of(spark)
    path = str(tmp_path / "a")
    vendor.write_answers(df, path, DAY, stride=10, page=7, pages=4)
    found = load(spark, path)
    assert sorted(map(str, found.collect())) == sorted(map(str, df.collect())) and len(rows) == 400
    assert found.rdd.getNumPartitions() == 9
    lines = [line for f in (tmp_path / "a").rglob("*.txt") for line in f.read_text().splitlines()]
    assert {type(json.loads(line)) for line in lines} == {list, dict} and len(lines) > 40


def test_filters_leave_windows_unopened(spark, tmp_path):
    rows, df = rows_of(spark)
    path = str(tmp_path / "a")
    vendor.write_answers(df, path, DAY, stride=10)
    for folder in (tmp_path / "a").iterdir():  # windows that the filter excludes cannot be read any more
        if folder.name.startswith("window=") and not "2024-01-21" <= folder.name[7:] < "2024-02-20":
            for f in folder.glob("*.txt"):
                f.write_text("no answer")
    kept = load(spark, path).where((F.col("day") >= dt.date(2024, 1, 25)) & (F.col("day") < dt.date(2024, 2, 15)) & (F.col("symbol") != "s1"))
    assert kept.rdd.getNumPartitions() == 3
    want = [r for r in rows if dt.date(2024, 1, 25) <= r[0] < dt.date(2024, 2, 15) and r[1] != "s1"]
    assert sorted(r.n for r in kept.collect()) == sorted(r[3] for r in want) and want
    assert load(spark, path).where(F.col("day") > dt.date(2030, 1, 1)).count() == 0


def test_missing_windows_and_fields(spark, tmp_path):
    (tmp_path / "window=2024-01-11").mkdir()
    (tmp_path / "window=2024-01-11" / "x.json").write_text('[{"title": "a"}, {"day": "2024-01-12", "symbol": "s"}]\n\n{"news": []}\n')
    got = load(spark, str(tmp_path)).collect()
    assert sorted((r.title, r.symbol, r.day) for r in got if r.title) == [("a", None, None)] and {r.day for r in got} == {None, dt.date(2024, 1, 12)}


def test_windows_arrive_as_a_stream(spark, tmp_path):
    rows, df = rows_of(spark, 120)
    source, target = str(tmp_path / "a"), str(tmp_path / "out")
    vendor.register(spark)

    def follow():
        stream = spark.readStream.format("vendor_answers").schema(SCHEMA).option("from", "2024-01-01").option("to", "2024-03-30").option("stride", "10").load(source)
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{target}-state").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.n for r in spark.read.schema(SCHEMA).parquet(target).collect())

    early = df.where(F.col("day") < dt.date(2024, 1, 21))
    vendor.write_answers(early, source, DAY, stride=10)
    assert follow() == sorted(r[3] for r in rows if r[0] < dt.date(2024, 1, 21))
    vendor.write_answers(df.where(F.col("day") >= dt.date(2024, 1, 21)), str(tmp_path / "b"), DAY, stride=10)
    for folder in (tmp_path / "b").glob("window=*"):
        folder.rename(tmp_path / "a" / folder.name)
    assert follow() == sorted(r[3] for r in rows)

import pytest

from newsloom.functions import tables
from newsloom.operators import vocabulary as T


def test_table_function_counts_as_the_columns_do(spark):
    rows = [(1, ["a", "b", "a", None]), (2, []), (3, None), (4, ["x", "y", "x", "y"]), (None, ["n"])]
    docs = spark.createDataFrame(rows, "id long, words array<string>").repartition(3)
    tables.register(spark)
    got = spark.sql("select * from term_counts(table({d}), key => 'id', tokens => 'words')", d=docs)
    assert got.dtypes == [("id", "bigint"), ("term", "string"), ("count", "bigint")]
    native = T.term_counts(docs, "id", "words")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, (tuple(r) for r in native.collect())))
    two = spark.sql("select * from term_counts(table({d}), key => 'id', tokens => 'words', n => 2)", d=docs)
    assert sorted((r.term, r["count"]) for r in two.where("id = 4").collect()) == [("x_y", 2), ("y_x", 1)]


@pytest.mark.parametrize("call", ["key => 'nobody', tokens => 'words'", "key => 'id', tokens => 'id'"])
def test_table_function_refuses_columns_it_cannot_use(spark, call):
    docs = spark.createDataFrame([(1, ["a"])], "id long, words array<string>")
    tables.register(spark)
    with pytest.raises(Exception, match="no column|no array"):
        spark.sql(f"select * from term_counts(table({{d}}), {call})", d=docs).collect()

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import common, exact_dedup, secret_scan, simhash


def test_slots_name_their_buckets(spark):
    numbers = [*range(2000), 99_999, 2**31 - 1]
    rows = spark.createDataFrame([(n, common.slot(n)) for n in numbers], "n long, s int").select("n", "s", common.slot_column(F.col("n")).alias("c"))
    assert rows.where("c <> s or hash(s) <> n").count() == 0
    assert len({common.slot(n) for n in numbers}) == len(numbers)


def test_positions_are_found_where_they_lie(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    placed = common.positioned(docs, "probe", n=F.length("text"))
    marks = placed.where("row.doc_id % 3 = 0")
    got = common.at_positions(placed, common.position_bits(marks))
    rest = common.at_positions(placed, common.position_bits(marks), "left_anti")
    assert {r.row.doc_id for r in got.collect()} == {r.doc_id for r in docs.where("doc_id % 3 = 0").collect()}
    assert rest.count() + got.count() == docs.count() and rest.where("row.doc_id % 3 = 0").count() == 0
    scans = got._jdf.queryExecution().sparkPlan().toString() + got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    # only the bitmaps travel
    assert "SelectedBucketsCount: 7 out of 7" in scans and scans.count("Exchange ") == scans.count("Exchange hashpartitioning(slot_#") == 1


def test_one_text_is_half_of_the_corpus(spark):
    same, n = "the very same words again and again " * 20, 6000
    docs = spark.range(n, numPartitions=9).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, same).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    rows = exact_dedup.exact_groups(docs).groupBy("group_size", "kept").agg(F.count("*").alias("n"), F.max("keep_id").alias("top")).collect()
    assert {(r.group_size, r.kept, r.n) for r in rows} == {(n // 2, True, 1), (n // 2, False, n // 2 - 1), (1, True, n // 2)}
    assert {r.top for r in rows if r.group_size > 1} == {n - 2}
    assert exact_dedup.drop_exact(docs).agg(F.count("*"), F.sum((F.col("text") == same).cast("int"))).first()[:] == (n // 2 + 1, 1)
    assert simhash.drop_near(docs.where("doc_id % 2 = 0")).collect()[0].doc_id == 0


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact, simhash.drop_near])
def test_columns_of_any_name_pass(spark, drop):
    names = ["doc_id", "text", "row", "slot", "ord", "sha", "__sha", "h", "id", "n", "bits", "keep", "fp", "low", "a.b"]
    schema = ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names)
    rows = [(i, f"some words number {i % 4} here" if i % 5 else None, *(f"{c}{i}" for c in names[2:])) for i in range(40)]
    docs = spark.createDataFrame(rows, schema)
    kept = drop(docs)
    assert kept.columns == names and 0 < kept.count() <= 5 and set(map(tuple, kept.collect())) <= set(rows)
    assert drop(docs.where("doc_id < 0")).count() == 0


def test_scopes_delete_only_their_own(spark):
    docs = spark.createDataFrame([(1, "password = abcdefghijklmnop"), (2, "x")], "doc_id long, text string")
    lazy = secret_scan.secret_scan(docs)
    with common.staging():
        inner = common.positioned(docs, "inner")
        assert exact_dedup.drop_exact(docs).count() == 2
    assert lazy.count() == 2
    with pytest.raises(Exception):
        inner.count()


def cloud(most, n, seed):
    rng = np.random.default_rng(seed)
    center = int(rng.integers(0, 2**63))
    fps = {center ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, most + 1), replace=False)) for _ in range(n)}
    return [f - 2**64 if f >= 2**63 else f for f in fps]


def test_a_cloud_costs_what_its_members_cost(spark):
    fps = cloud(3, 20_000, 1)
    values = spark.createDataFrame([(f,) for f in fps], "fp long")
    ring = simhash.Ring(4)
    keyed = values.select("fp", F.explode(ring.keys(F.col("fp"))).alias("key"))
    hubs = simhash._hubs(keyed, ring.parts * len(fps))
    tied = keyed.join(hubs, "key").where("fp <> hub").where(simhash._distance("fp", "hub") <= 4).select(F.col("fp").alias("u"), F.col("hub").alias("v"))
    roots = simhash.connected_components(tied)
    # a link a member and bucket makes one root of the cloud, so no pairs are left to meet
    assert len(fps) > 5900 and tied.count() <= ring.parts * len(fps) and roots.select("root").distinct().count() == 1
    assert roots.count() + 1 == len(fps) and simhash.near_components(values).select("root").distinct().count() == 1


@pytest.mark.parametrize("links", [1, 2, 3])
def test_any_chain_length_gives_the_same_links(spark, links):
    from test_codec_warc_simhash import brute_components

    fps = sorted({f for seed in range(5) for f in cloud(7, 80, seed)})
    got = {r.fp: r.root for r in simhash.near_components(spark.createDataFrame([(f,) for f in fps], "fp long"), links=links).collect()}
    tops = brute_components([f & (2**64 - 1) for f in fps])
    pairs = {(got[f], t) for f, t in zip(fps, tops)}
    assert len(got) == len(fps) and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_buckets_make_no_more_links_than_members(spark):
    from test_codec_warc_simhash import brute_components

    fps = sorted({f for seed in range(3) for f in cloud(9, 500, seed)})
    values = spark.createDataFrame([(f,) for f in fps], "fp long")
    ring = simhash.Ring(4, 1)
    keyed = values.select("fp", F.explode(ring.keys(F.col("fp"))).alias("key"), F.lit(0).alias("block"))
    found = simhash._bucket_links(keyed, ring)
    assert len(fps) < found.count() <= ring.parts * len(fps)
    tops = brute_components([f & (2**64 - 1) for f in fps])
    for room in (None, 100, 7):  # crowded buckets in blocks
        got = {r.fp: r.root for r in simhash.near_components(values, room=room).collect()}
        pairs = {(got[f], t) for f, t in zip(fps, tops)}
        assert len(got) == len(fps) and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})

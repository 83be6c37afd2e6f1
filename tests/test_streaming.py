import datetime as dt

from newsloom.streaming import events as ES

START = dt.datetime(2024, 1, 1)


def write(spark, folder, name, rows):
    """One file of events: (event_id, hours after the start, user, type)."""
    df = spark.createDataFrame([(i, START + dt.timedelta(hours=h), u, k, 1.0, "{}") for i, h, u, k in rows], ES.EVENT_SCHEMA)
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}.parquet")


def follow(spark, stream, folder):
    """Starts the stream once for all that is there; state goes on from where it was."""
    before = spark.conf.get(ES._STORE[0])
    spark.conf.set(*ES._STORE)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        progress = query.recentProgress
    finally:
        spark.conf.set(ES._STORE[0], before)
    rows = spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()
    return rows, progress


def stream_of(spark, folder):
    raw = spark.readStream.schema(ES.EVENT_SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
    return raw.withColumn("ts", raw["ts"].cast("timestamp"))


def test_novelty_keeps_state_drops_late_rows_and_forgets(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    novelty = lambda: ES.novelty(stream_of(spark, source), rows=2, late="1 hours", idle_days=2)
    write(spark, source, "a", [(1, 0, 7, "x"), (2, 1, 7, "y"), (3, 2, 7, "x"), (4, 0, 8, "x")])
    rows, _ = follow(spark, novelty(), target)
    assert {r.event_id: r.novelty for r in rows} == {1: 1.0, 2: 1.0, 3: 0.5, 4: 1.0}
    # the state goes on; event 6 is older than the watermark (two hours less one) and is dropped
    write(spark, source, "b", [(5, 3, 7, "x"), (6, 0.25, 7, "x")])
    rows, progress = follow(spark, novelty(), target)
    assert {r.event_id: r.novelty for r in rows}.get(5) == 0.5 and 6 not in {r.event_id for r in rows}
    assert sum(s.numRowsDroppedByWatermark for p in progress for s in p.stateOperators) == 1
    # user 9 moves the watermark past two silent days, so users 7 and 8 are forgotten
    write(spark, source, "c", [(10, 24 * 4, 9, "x")])
    follow(spark, novelty(), target)
    write(spark, source, "d", [(11, 24 * 4 + 1, 7, "x"), (12, 24 * 4 + 2, 7, "x"), (13, 24 * 4 + 3, 7, "x")])
    rows, _ = follow(spark, novelty(), target)
    found = {r.event_id: r.novelty for r in rows}
    assert found[11] == found[12] == 1.0 and found[13] == 0.0


def test_state_is_empty_after_expiry(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    novelty = lambda: ES.novelty(stream_of(spark, source), rows=2, late="1 hours", idle_days=1)
    write(spark, source, "a", [(i, i % 3, i, "x") for i in range(20)])
    follow(spark, novelty(), target)
    write(spark, source, "b", [(100, 24 * 9, 500, "x")])
    follow(spark, novelty(), target)
    write(spark, source, "c", [(101, 24 * 20, 501, "x")])
    _, progress = follow(spark, novelty(), target)
    left = spark.read.format("statestore").option("stateVarName", "seen").load(f"{target}/state")
    assert {r.key.user_id for r in left.select("key").collect()} <= {500, 501}
    assert progress


def test_sessions_end_with_a_gap(spark, tmp_path):
    source = str(tmp_path / "in")
    write(spark, source, "a", [(1, 0, 7, "x"), (2, 5, 7, "x"), (3, 12, 7, "y"), (4, 1, 8, "x")])
    got = ES.drain(ES.sessions(stream_of(spark, source)), str(tmp_path), "complete").collect()
    assert sorted((r.user_id, r.n, (r.last - r.start).total_seconds() / 3600) for r in got) == [(7, 1, 0.0), (7, 2, 5.0), (8, 1, 0.0)]

import hashlib
import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from newsloom.llm import vector_codes
from newsloom.llm.queries import op12_vector_codes, oracle_sql

SF = "/root/testdata/sf0.01"
ROWS = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, positions=8, entries=16, rounds=6):
    """Python's own integers throughout; rows are (id, vector, label)."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    lead = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    w = len(lead[0][1]) // positions
    part = lambda v, at: v[at * w : (at + 1) * w]
    books = [[part(v, at) for _, v, _ in lead] for at in range(positions)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for at, book in enumerate(books):
            mine = defaultdict(list)
            for _, v, _ in kept:
                mine[near(part(v, at), book)[1]].append(part(v, at))
            books[at] = [[sum(c) // len(mine[e]) for c in zip(*mine[e])] if mine[e] else entry for e, entry in enumerate(book)]
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    found = [(i, label, [near(part(v, at), books[at]) for at in range(positions)]) for i, v, label in kept]
    sums = defaultdict(int)
    for _, label, f in found:
        sums[label] += sum(d for d, _ in f)
    return sorted(((str(i), "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), sums[label], sha) for i, label, f in found))


def got(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_whole_query_against_loops_and_sql(spark):
    df = op12_vector_codes(spark, SF)
    want = brute([(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])
    assert got(df) == want and len(want) == 500
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert sorted((str(i), *more) for i, *more in db.execute(oracle_sql()["op12_vector_codes"]).fetchall()) == want


def test_odd_rows_in_small_blocks(spark):
    rng = np.random.default_rng(3)
    base = [rng.normal(size=16).astype(np.float32).tolist() for _ in range(40)]
    rows = [(int(i), base[i % 40], int(i % 3) if i % 5 else None) for i in range(200)]
    rows += [(3, None, 1), (4, [math.nan] * 16, 1), (5, [math.inf] + [0.0] * 15, 1), (6, [None] + [0.0] * 15, 2), (None, base[0], None), (7, [-0.0] * 16, 9), (7, [-1e-9] * 16, 9), (7, [-1e-9] * 16, 9)]
    df = spark.createDataFrame([(*r, "x") for r in rows], ROWS).repartition(5)
    want = brute(rows)
    assert got(vector_codes.compress(df)) == want
    assert got(vector_codes.compress(df, block_rows=7)) == want
    few = [r for r in rows if r[0] is not None and r[0] < 3]
    assert got(vector_codes.compress(df.where("vec_id < 3"))) == brute(few)
    assert got(vector_codes.compress(df.withColumn("embedding", df.embedding.cast("array<double>")))) == want


def test_rows_without_codes(spark):
    rows = [(2, [1.0] * 8, 1, "x"), (1, [0.5] * 8, 1, "x"), (3, [1.0] * 16, 1, "x"), (4, [], 1, "x")]
    df = spark.createDataFrame(rows, ROWS)
    assert [r.vec_id for r in vector_codes.compress(df).orderBy("vec_id").collect()] == [1, 2]
    assert vector_codes.compress(df.where("vec_id = 9")).count() == 0
    odd = spark.createDataFrame([(1, [1.0] * 7, 1, "x")], ROWS)
    assert vector_codes.compress(odd).count() == 0 and vector_codes.compress(odd).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        vector_codes.compress(df, entries=300)


@pytest.mark.parametrize("size", [1e3, 3e7, 2e14])
def test_large_components_are_exact(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * size).astype(np.float32).tolist(), None) for i in range(60)]
    df = spark.createDataFrame([(*r, "x") for r in rows], ROWS)
    most = (1 << 63) - 1
    want = [(i, c, min(e, most), min(s, most), sha) for i, c, e, s, sha in brute(rows)]
    assert got(vector_codes.compress(df)) == want


def test_distinct_parts_are_coded_once(spark):
    base = [[float(a)] * 8 + [float(a + b) for b in range(8)] for a in range(10)]
    df = spark.createDataFrame([(i, base[0] if i % 3 else base[i % 10], 1, "x") for i in range(3000)], ROWS).repartition(6)
    rows = df.selectExpr("vec_id as id", "label", "transform(embedding, x -> bigint(x)) as v")
    exchange = vector_codes.Exchange(rows, 16, 2, "<i2", 5, 100)
    blocks = exchange.blocks()
    owned = exchange.owned(blocks).where("keys is not null").collect()
    for at in (0, 1):
        parts = [p for r in owned if r["at"] == at for p in np.frombuffer(r["keys"], "<i2").reshape(-1, 8).tolist()]
        assert len(parts) == len({tuple(p) for p in parts}) == 10
        assert sum(np.frombuffer(r["weights"], "<i8").sum() for r in owned if r["at"] == at) == 3000

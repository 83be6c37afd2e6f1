"""Every plan with an oracle against DuckDB, and invariants of those without."""

import datetime
import decimal
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from newsloom.plans import catalogue

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_plan_equals_oracle(spark, duck, name):
    df, sql = catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name]
    columns = sorted(df.columns)
    assert sorted(duck.sql(sql).columns) == columns
    want = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({sql})").fetchall()
    assert ordered(df.select(*(f"`{c}`" for c in columns)).collect()) == ordered(want)


def test_models_keep_their_invariants(spark):
    run = {name: f(spark, SF) for name, f in catalogue.queries().items() if name in ("lda_topics", "kmeans_topics", "kmeans_elbow", "pca_latent", "autoencoder_latent", "hashed_embeddings", "temporal_pca")}
    for row in run["lda_topics"].collect():
        weights = [v for k, v in row.asDict().items() if k.startswith("topic_")]
        assert math.isclose(sum(weights), 1, abs_tol=1e-6) and min(weights) >= 0
    assert {r.topic_id for r in run["kmeans_topics"].collect()} <= set(range(50))
    costs = [r.cost for r in run["kmeans_elbow"].orderBy("k").collect()]
    assert costs[-1] < costs[0]
    latent = run["pca_latent"].toPandas().drop(columns="doc_id")
    assert (latent.var().diff().dropna() <= 1e-9).all() and latent.mean().abs().max() < 1e-6
    assert run["autoencoder_latent"].toPandas()["error"].mean() < 1.0
    assert {len(r.embedding) for r in run["hashed_embeddings"].collect()} == {64}
    assert {len(r.latent) for r in run["temporal_pca"].collect()} <= {8}


def test_entry_works_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
    assert out.returncode == 0 and int(out.stdout.split()[-1]) > 80, out.stderr[-2000:]


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "newsloom")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "newsloom.llm" not in open(os.path.join(folder, f)).read(), f

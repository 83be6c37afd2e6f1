"""The pipeline against one written with loops, and over odd tables."""

import hashlib
import math
import zlib

import numpy as np
import pytest

import corpus_pipeline
from newsloom.llm import quality_rules
from newsloom.llm.queries import tokenizer_path
from newsloom.llm.sentencepiece_codec import _processor, read_model

from test_codec_warc_simhash import brute, brute_components, brute_fp
from test_scans_and_dedup import brute_contamination

SF = "/root/testdata/sf0.01"


def brute_statistics(text):
    """The statistics, by loops over bytes and words."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [math.log1p(len(raw))] + [0.0] * (len(quality_rules.STATISTICS) - 1)
    n, count = len(raw), len(words)
    of = lambda test: sum(1 for b in raw if test(b))
    among = lambda chars: of(lambda b: chr(b) in chars)
    windows = [words[i : i + 50] for i in range(0, count, 50)]
    return [
        math.log1p(n), math.log1p(count), sum(len(w) for w in words) / count, math.log1p(max(len(w) for w in words)),
        of(lambda b: 65 <= b <= 90) / n, of(lambda b: 48 <= b <= 57) / n, among("!?") / count, among("#$%&*@^~<>{}[]\\=+") / count, among("|") / count, among(".,;:") / count, among("\n") / count,
        sum(len(set(w)) for w in windows) / count, sum(a == b for a, b in zip(words, words[1:])) / count, sum(len(w) <= 3 for w in words) / count, of(lambda b: b >= 128) / n,
    ]


def brute_score(model, values):
    z = model.bias
    for rule, weight in zip(model.rules, model.weights):
        if all((values[f] > edge) == above for f, above, edge in rule):
            z += weight
    return 1 / (1 + math.exp(-z))


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels, quality_rules.fit_quality(docs, labels, "doc_id", "text", "quality", 0, 20_000)


def test_quality_equals_brute_force(spark, corpus):
    docs, labels, model = corpus
    got = {r.doc_id: r for r in quality_rules.quality_scores(docs, labels).collect()}
    for r in docs.collect():
        score = brute_score(model, brute_statistics(r.text))
        assert math.isclose(got[r.doc_id].score, score, abs_tol=1e-9) and got[r.doc_id].predicted == int(score >= 0.3)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_splits_are_the_best_there_are():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (60, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3)).astype(float)
    grad, hess = y - 0.5, np.full(60, 0.25)
    edges = [np.unique(x[:, f])[:-1] for f in range(3)]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    rules, leaf = quality_rules._grow(bins, edges, grad, hess, 2, 5)

    def gain(rows, f, edge):
        parts = [rows & (x[:, f] <= edge), rows & (x[:, f] > edge)]
        if min(p.sum() for p in parts) < 5:
            return -1
        return sum(grad[p].sum() ** 2 / (hess[p].sum() + 1) for p in parts) - grad[rows].sum() ** 2 / (hess[rows].sum() + 1)

    for path in {rule[:-1] for rule in rules if len(rule) == 1} | {rule for rule in rules if len(rule) == 1}:
        rows = np.all([(x[:, f] > e) == above for f, above, e in path], axis=0) if path else np.ones(60, bool)
        deeper = [next(iter(set(r) - set(path))) for r in rules if len(r) == len(path) + 1 and set(path) <= set(r)]
        if deeper:
            best = max(gain(rows, f, e) for f in range(3) for e in edges[f])
            assert any(math.isclose(gain(rows, f, e), best) for f, _, e in deeper)
    assert len(set(leaf.round(9))) <= 4


def brute_pipeline(rows, model, items, sp):
    rows = [r for r in rows if brute_score(model, brute_statistics(r.text)) >= 0.3]
    order = lambda i: (i is not None, i or 0)
    top = {}
    for r in rows:
        if (r.text or "") not in top or order(r.doc_id) > order(top[r.text or ""].doc_id):
            top[r.text or ""] = r
    rows = list(top.values())
    parts = {}
    for r, root in zip(rows, brute_components([brute_fp(r.text) for r in rows])):
        key = (r.doc_id is None, r.doc_id or 0, hashlib.sha256((r.text or "").encode()).digest())
        parts[root] = min(parts.get(root, (key, r)), (key, r), key=lambda x: x[0])
    rows = [r for _, r in parts.values() if not brute_contamination(r.text, items)[-1]]
    return sorted(((r.doc_id, *brute(sp, r.text)) for r in rows), key=str)


def result(out):
    return sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()), key=str)


def test_pipeline_equals_loops(spark, corpus):
    docs, _, model = corpus
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sp = _processor(read_model(tokenizer_path()))
    assert result(corpus_pipeline.run(spark, SF)) == brute_pipeline(docs.collect(), model, items, sp)


def test_pipeline_of_odd_rows(spark, tmp_path, corpus):
    """Nulls, empty and long texts, repeated rows and extra columns with clashing names."""
    good = [r for r in corpus[0].where("lang = 'en' and length(text) > 400").limit(30).collect()]
    item = " ".join(f"w{i}" for i in range(40))
    rows = [(r.doc_id, r.text) for r in good] + [(r.doc_id, r.text) for r in good[:5]] + [(100_000 + r.doc_id, r.text) for r in good[:5]] + [(None, good[6].text), (None, None), (1, None), (2, ""), (3, " \n"), (4, f"{good[7].text} {item}")]
    rows += [(5, (good[8].text + "\n") * 400), (None, None)]
    extra = ["row", "slot", "ord", "id", "statistics", "n_words", "hits", "items", "codes", "sha", "bits"]
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    labels = corpus[1]
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string"))):
        table.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    model = quality_rules.fit_quality(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels, "doc_id", "text", "quality", 0, 20_000)
    sp = _processor(read_model(tokenizer_path()))
    got = result(corpus_pipeline.run(spark, str(tmp_path)))
    assert got == brute_pipeline(docs.collect(), model, [(1, item), (None, None), (2, "")], sp) and len(got) > 5
    stages = dict(corpus_pipeline.STAGES)
    for name in list(stages)[:-1]:
        assert stages[name](spark, docs, str(tmp_path)).columns == docs.columns, name


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string"), ("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_running_it_leaves_other_results_alone(spark, tmp_path):
    from newsloom.llm import secret_scan

    lazy = secret_scan.secret_scan(spark.createDataFrame([(1, "password = abcdefghijklmnop")], "doc_id long, text string"))
    for name, schema in (("documents", "doc_id long, text string"), ("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    corpus_pipeline.run(spark, str(tmp_path))
    assert lazy.count() == 1

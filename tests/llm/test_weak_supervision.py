import math
import re
from collections import Counter

import duckdb
import pytest

from newsloom.llm import weak_supervision as W
from newsloom.llm.queries import op11_weak_supervision, oracle_sql

SF = "/root/testdata/sf0.01"
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in lines
            lines.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def brute_estimate(patterns, rules, rounds=50, share=0.01):
    """The same model by tables of likelihoods, a text at a time, with shares instead of numbers."""
    total = sum(patterns.values())
    pi, like = [0.2, 0.8], [[0.3] * rules, [0.02] * rules]
    for _ in range(rounds):
        votes = [[[share * (1 - b), share * b] for b in (0.3, 0.02)] for _ in range(rules)]
        mass = [share * 0.2, share * 0.8]
        for pattern, n in patterns.items():
            joint = [pi[c] * math.prod(like[c][j] if v < 0 else 1 - like[c][j] for j, v in enumerate(pattern) if v) for c in (0, 1)]
            for c in (0, 1):
                part = n / total * joint[c] / sum(joint)
                mass[c] += part
                for j, v in enumerate(pattern):
                    if v:
                        votes[j][c][v < 0] += part
        pi = [m / sum(mass) for m in mass]
        like[1] = [v[1][1] / sum(v[1]) for v in votes]
        like[0] = [max(v[0][1] / sum(v[0]), g) for v, g in zip(votes, like[1])]
    return pi, like


def test_whole_query_against_loops(spark):
    rows = {r.doc_id: r for r in op11_weak_supervision(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r, want = rows[d.doc_id], brute(d.text)
        assert tuple(r[n] for n in NAMES) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    stated = db.execute(oracle_sql()["op11_weak_supervision"]).fetchall()
    assert sorted(s[:-1] for s in stated) == sorted((i, *(r[n] for n in NAMES), r.base_failed, r.kept) for i, r in rows.items())
    assert all(abs(s[-1] - rows[s[0]].posterior) < 2e-6 for s in stated)
    voted = W.quality_votes(spark.read.parquet(f"{SF}/documents.parquet"))
    found = voted.collect()
    patterns = Counter(tuple(r[f"vote_{rule.name}"] for rule in W.RULES) for r in found)
    pi, like = brute_estimate(patterns, len(W.RULES))
    for r in found:
        joint = [pi[c] * math.prod(like[c][j] if r[f"vote_{rule.name}"] < 0 else 1 - like[c][j] for j, rule in enumerate(W.RULES) if r[f"vote_{rule.name}"]) for c in (0, 1)]
        assert r.posterior == pytest.approx(joint[1] / sum(joint), abs=1e-9)


def test_verdicts_agree_with_labels_that_were_never_read(spark):
    kept = {r.doc_id: r for r in op11_weak_supervision(spark, SF).collect()}
    labels = [(kept[r.doc_id], r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    clean = [r for r, q in labels if q == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)
    junk = [r for r, q in labels if q == 0]
    assert sum(not r.kept for r in junk) >= 0.9 * len(junk)


def test_odd_rows(spark):
    a = "one two three four five"
    texts = [
        None, "", " \n\t ", "one", a, f"{a} {a}", f"{a} six {a} six {a}", "x " * 30, "a b c d e " * 3000, f"{a}\n{a}\n \n \n{a} \n", "é # ** $%&|<> ñ\x0b\x0cz", "#" * 500, " a b c",
        "tie tie tie tie tie tie", "a b c d e a b c d f a b c d e", "l\r\nl\r\nl\n", f"{a} " * 2 + "z " + "q r s t u " * 2,
    ]
    docs = spark.createDataFrame([(i if i % 5 else None, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n long, w string").repartition(3)
    got = Counter((r.doc_id, *(r[n] for n in NAMES)) for r in W.quality_votes(docs).collect())
    assert got == Counter((i if i % 5 else None, *brute(t)) for i, t in enumerate(texts))
    assert W.quality_votes(docs.where("doc_id = 99")).count() == 0
    assert all(r.base_failed and not r.kept for r in W.quality_votes(docs.where("text is null or text = ''")).collect())


def test_windows_whose_hashes_agree_are_compared_by_words(spark, monkeypatch):
    texts = ["a b c d e f g h i j k l", "a b c d e f a b c d e f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(W.F, "xxhash64", lambda *cols: W.F.lit(1).cast("long"))
    assert {r.doc_id: r.n_repeat_words for r in W.statistics(docs).withColumnRenamed("id", "doc_id").collect()} == {0: 0, 1: 12}


def test_estimates_find_planted_accuracies():
    import random

    rng = random.Random(5)
    bad_when = [(0.7, 0.02), (0.6, 0.05), (0.5, 0.1), (0.8, 0.01), (0.3, 0.3)]
    patterns, truth = Counter(), Counter()
    for _ in range(20000):
        good = rng.random() < 0.85
        p = tuple(0 if rng.random() < 0.2 else -1 if rng.random() < b[good] else 1 for b in bad_when)
        patterns[p] += 1
        truth[p] += good
    model = W.estimate(patterns, 5, prior=1e-4)
    assert abs(model.good - 0.85) < 0.03
    for (b, g), mb, mg in zip(bad_when, model.bad_when_bad, model.bad_when_good):
        assert abs(b - mb) < 0.08 and abs(g - mg) < 0.03
    assert all(bad <= 0 for bad, _ in model.evidence())
    model = W.estimate(patterns, 5)
    assert W.estimate(dict(reversed(patterns.items())), 5) == model
    assert W.estimate({p: 10 * n for p, n in patterns.items()}, 5).good == pytest.approx(model.good)
    assert W.estimate({}, 5).good == 0.8


def test_no_python_runs_on_executors(spark):
    plan = op11_weak_supervision(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from newsloom.llm import blocks, common, hmm_lm, quality_rules
from newsloom.llm.queries import op4_quality, op5_hmm

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in op4_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in rows.items())
    held = [(rows[r.doc_id], r.quality) for r in labels if rows[r.doc_id].held_out]
    assert np.mean([r.predicted == q for r, q in held]) > 0.95
    good = [r.score for r, q in held if q]
    bad = [r.score for r, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_quality_learns_nothing_from_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0, 1 - quality, quality) as quality")
    score = lambda found: {r.doc_id: r.score for r in quality_rules.quality_scores(docs, found).collect()}
    assert score(labels) == score(turned)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "a b", 0.5), (3, "x " * 50000, 0.1), (3, "x", 0.2)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (3, 0), (None, 1)], "doc_id long, quality int")
    assert quality_rules.quality_scores(docs, labels).count() == 5
    kept = quality_rules.keep_quality(docs, labels)
    assert kept.columns == docs.columns
    none = labels.where("doc_id = 99")
    assert {round(r.score, 6) for r in quality_rules.quality_scores(docs, none).collect()} == {0.5}
    assert quality_rules.quality_scores(docs.where("doc_id = 99"), labels).count() == 0


def test_rules_are_conjunctions_that_the_expression_repeats(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, len(quality_rules.STATISTICS)))
    y = ((x[:, 4] < 0.5) & (x[:, 6] < 0.7)).astype(float)
    model = quality_rules.fit_rules(x, y)
    df = spark.createDataFrame([(row.tolist(),) for row in x], "__statistics array<double>")
    got = np.array([r[0] for r in df.select(model.score()).collect()])
    z = model.bias + quality_rules._holds(model.rules, x) @ np.array(model.weights)
    assert np.allclose(got, 1 / (1 + np.exp(-z)), atol=1e-6)
    assert ((got > 0.5) == y).mean() > 0.95 and 0 < len(model.rules) < 200


def naive_forward(model, seq):
    a = [model.start[i] * model.emit[seq[0], i] for i in range(len(model.start))]
    for s in seq[1:]:
        a = [sum(a[j] * model.move[j, i] for j in range(len(a))) * model.emit[s, i] for i in range(len(a))]
    return math.log(sum(a))


def naive_counts(model, seq):
    k = len(model.start)
    n = len(seq)
    paths = np.stack(np.meshgrid(*[range(k)] * n, indexing="ij"), -1).reshape(-1, n)
    p = np.array([model.start[q[0]] * np.prod([model.move[a, b] for a, b in zip(q, q[1:])]) * np.prod([model.emit[s, i] for s, i in zip(seq, q)]) for q in paths])
    p /= p.sum()
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit)
    for q, w in zip(paths, p):
        start[q[0]] += w
        for a, b in zip(q, q[1:]):
            move[a, b] += w
        for s, i in zip(seq, q):
            emit[s, i] += w
    return start, move, emit


def test_baum_welch_equals_sum_over_paths():
    unigram = np.array([0.4, 0.3, 0.2, 0.1])
    model = hmm_lm.Hmm.begin(unigram, 3, 5)
    seqs = [np.array(s) for s in ([0, 1, 2, 3], [3], [2, 2, 0], [1, 0, 3, 2, 1])]
    assert np.allclose(hmm_lm.log_likelihoods(model, seqs), [naive_forward(model, s) for s in seqs])
    want = [sum(x) for x in zip(*(naive_counts(model, s) for s in seqs))]
    start, move, emit, total = hmm_lm.expected_counts(model, seqs)
    assert np.allclose(start, want[0]) and np.allclose(move, want[1]) and np.allclose(emit, want[2])
    assert math.isclose(total, sum(naive_forward(model, s) for s in seqs))


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_lm(rows):
    tokens = {i: re.findall("[^\x20\x09-\x0d]+", lower(t)) for i, (_, t) in enumerate(rows)}
    train = [i for i, (d, _) in enumerate(rows) if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    counts = Counter(w for i in train for w in tokens[i])
    ends = len(train)
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    p = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    out = []
    for i, (d, _) in enumerate(rows):
        base = sum(p(counts[w]) for w in tokens[i]) + p(ends)
        known = sum(counts[w] > 0 for w in tokens[i]) + (ends > 0)
        out.append((d, i not in train, len(tokens[i]) + 1, known, n, round(base, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("words", [40, 400_000])
def test_lm_counts_and_base_equal_brute_force(spark, sf, words):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(1001, None), (1002, ""), (1003, "zzz zzz qqq"), (1003, "zzz zzz qqq"), (None, "THE the \x0b of"), (1004, "unseen-word " * 3000)], "doc_id long, text string")
    both = docs.union(odd)
    rows = [(r.doc_id, r.text) for r in both.collect()]
    got = hmm_lm.lm_scores(both.selectExpr("*", "1 as score", "2 as word"), block_words=words, rounds=2).collect()
    assert sorted([(*tuple(r)[:5], round(r.base_score, 6)) for r in got], key=str) == brute_lm(rows)
    assert all(r.score < 0 for r in got)


def test_lm_beats_counts_and_is_a_distribution(spark):
    rows = [r for r in op5_hmm(spark, SF).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    # over a closed alphabet, texts of up to n tokens have a probability of at most one, growing with n
    words = ["a", "b", "c"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "b", "a a b c", "c a", "b b"] * 4)], "doc_id long, text string")
    texts = [""] + words + [f"{x} {y}" for x in words for y in words]
    probe = docs.union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    total = sum(10**r.score for r in hmm_lm.lm_scores(probe, rounds=2).collect() if r.doc_id >= 10_000)
    assert 0.3 < total < 1


def brute_hmm(rows, k=4, rounds=5, seed=7, shrink=4.0):
    """The whole model by hand: every word's shares among states kept in one dictionary, no blocks, owners or stretches."""
    texts = [(d, re.findall("[^\x20\x09-\x0d]+", lower(t))) for d, t in rows]
    train = [t for d, t in texts if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    counts, ends = Counter(w for t in train for w in t), len(train)
    total = sum(counts.values()) + ends
    shares = {w: hmm_lm.first_shares(np.array([xxhash.xxh64_intdigest(w.encode())], np.uint64), k, seed)[0] for w in counts}
    tokens = sum(n * shares[w] for w, n in counts.items())
    end_share = hmm_lm.first_shares(np.array([0], np.uint64), k, seed)[0]
    start, move = np.full(k, 1 / k), np.full((k, k), 0.1 / (k - 1)) + np.eye(k) * (0.9 - 0.1 / (k - 1))
    end = (ends * end_share + ends / total) / (ends * end_share + tokens + 1)

    def emissions(t):
        prior = tokens + 1e-6 * tokens.sum() + 1e-12
        prior = prior / prior.sum()
        words = [(1 - end) * (counts[w] * shares.get(w, 0) + 0.5 * prior) / (tokens + 0.5 * (len(counts) + 1) * prior) for w in t]
        return prior, np.array([*words, end])

    def sweep(t):
        prior, e = emissions(t)
        run = hmm_lm.Recursion(start, move, e, np.arange(len(e)), np.array([len(e)]), stretch=10**9)
        return prior, run

    for _ in range(rounds):
        sums, starts, moves, at_end = {w: np.zeros(k) for w in counts}, np.zeros(k), np.zeros((k, k)), np.zeros(k)
        for t in train:
            prior, run = sweep(t)
            first, moved, gamma = run.smooth()
            gamma = gamma.T[np.argsort(run.lay.at)]
            starts, moves, at_end = starts + first, moves + moved, at_end + gamma[-1]
            for w, g in zip(t, gamma):
                sums[w] += g
        shares = {w: (s + shrink * prior) / (counts[w] + shrink) for w, s in sums.items()}
        tokens = sum(counts[w] * shares[w] for w in counts)
        start, move = (starts + 0.1) / (starts + 0.1).sum(), (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True)
        end = (at_end + ends / total) / (at_end + tokens + 1)
    return [(d, float(np.log(sweep(t)[1].scales).sum() / math.log(10))) for d, t in texts], start, move


def test_whole_scores_equal_a_model_made_by_hand(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(5001, None), (5002, "only here only here"), (None, rows[0][1]), (5003, "the " * 3000)]
    want, *_ = brute_hmm(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for words in (3000, 400_000):
        got = sorted((str(r.doc_id), r.score) for r in hmm_lm.lm_scores(docs, block_words=words).collect())
        assert len(got) == len(want)
        assert all(i == j and math.isclose(a, b, rel_tol=2e-3) for (i, a), (j, b) in zip(got, sorted((str(d), v) for d, v in want)))


def test_rounds_read_every_word_and_count_starts_once(spark):
    rng = np.random.default_rng(4)
    words = ["a", "b", "c", "rare", "x" * 100, "é"]
    texts = [" ".join(rng.choice(words, n, p=[0.4, 0.3, 0.2, 0.05, 0.03, 0.02])) for n in (1700, 513, 4, 0, 90, 700)]
    rows = [(i, False, True, t) for i, t in enumerate(texts)] + [(99, True, False, "a unseen b")]
    docs = spark.createDataFrame(rows, "id long, held_out boolean, learn boolean, text string").repartition(3)
    coded = blocks.coded(docs, common.space_words, "words", learn="learn", block_words=4)
    owners = hmm_lm.count_words(coded.messages, 3, 7, 8)
    counts = Counter(w for t in texts for w in t.split())
    begun = hmm_lm._summed(owners, 4)
    assert begun[-1] == len(counts) and math.isclose(begun[:-1].sum(), sum(counts.values()))
    model = hmm_lm._begin(3, 7, begun[:-1], sum(counts.values()) + 6, len(counts) + 1, 6)
    learn = coded.table.where("owner is not null or learn").select("block", "owner", "places", "codes")
    answers, after, _ = hmm_lm.baum_welch(learn, owners, owners.where("parts is not null").select("block", "owner", "counts", "parts", "sums"), model, 4.0)
    assert math.isclose(after.tokens.sum(), sum(counts.values())) and np.allclose(after.move.sum(1), 1) and 0 < after.end.max() < 1
    # emissions of all known words, one unseen event and the end are a distribution in every state
    told = {}
    for r in answers.collect():
        n, s = np.frombuffer(blocks.unsqueeze(r["counts"]), "<i8"), hmm_lm.fractions(np.frombuffer(blocks.unsqueeze(r["parts"]), "<u2"), 3)
        told |= {(int(c), tuple(x)): 1 for c, x in zip(n, s) if c}
    each = np.array([(c, *x) for c, x in told])
    assert len(each) == len(counts)
    total = after.emission(each[:, 0], each[:, 1:]).sum(0) + after.emission(np.zeros(1), np.zeros((1, 3)))[0] + after.end
    assert np.allclose(total, 1)


@pytest.mark.parametrize("stretch", [1, 2, 3, 7, 1000])
def test_cuts_change_nothing(stretch):
    rng = np.random.default_rng(2)
    model = hmm_lm.Hmm.begin(np.full(9, 1 / 9), 4, 1)
    seqs = [rng.integers(0, 9, n) for n in (1, 2, 60, 7, 3, 21, 1, 40)]
    want, got = hmm_lm.expected_counts(model, seqs, 1000), hmm_lm.expected_counts(model, seqs, stretch)
    assert all(np.allclose(a, b) for a, b in zip(want, got))
    assert np.allclose(hmm_lm.log_likelihoods(model, seqs, stretch), [naive_forward(model, s) for s in seqs])


def test_lm_empty_table(spark):
    assert hmm_lm.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from newsloom.llm import spelling
from newsloom.llm.queries import op13_spelling, oracle_sql

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute_words(rows, least=3):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}


def brute_near(words):
    """By all wildcards of one place, and by all deletions of one place."""
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            short = w[:i] + w[i + 1 :]
            if short in words:
                near[w].add(short)
                near[short].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute(rows):
    words = brute_words(rows)
    near, form = brute_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_whole_query_against_loops(spark):
    df = op13_spelling(spark, SF)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(rows)
    assert got(df) == want and df.count() == len(want) > 1000
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert {w: tuple(more) for w, *more in db.execute(oracle_sql()["op13_spelling"]).fetchall()} == want
    assert any(f and r != f for f, r, *_ in want.values())
    assert dict(df.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}


def test_odd_rows(spark):
    texts = [(1, "straße STRAßE straße strasse Étude étude etude"), (2, None), (3, ""), (None, "colour color Colour, colours! colourX"), (4, "aaaab aaaaab aaaaaab baaaa " * 3), (4, "aaaab aaaaab aaaaaab baaaa " * 3), (5, "z" * 5000 + " " + "z" * 4999 + " 1234")]
    rows = [(i, t) for i, t in texts for _ in range(3)]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], DOCS + ", word string, n int").repartition(4)
    assert got(spelling.spelling_variants(docs)) == brute(rows)
    assert spelling.spelling_variants(docs.where("doc_id = 99")).count() == 0
    assert spelling.spelling_variants(docs.where("doc_id = 3")).count() == 0


def test_words_that_share_nearly_all_are_met_in_divided_buckets(spark, monkeypatch):
    letters = "abcdefghijklmnopqrstuvwxyz"
    # a third of all words share everything but two places; the others are spread out
    words = {f"prefixes{a}{b}": 3 + (ord(a) * 7 + ord(b)) % 50 for a in letters for b in letters}
    words |= {f"{a}{b}{a}zzz{c}": 4 for a in letters for b in letters[:9] for c in letters[:6]}
    words |= {f"prefixes{a}": 300 for a in letters[:5]}
    depth = []
    halves = spelling._halves
    monkeypatch.setattr(spelling, "_halves", lambda rows: depth.append(1) or halves(rows))
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = {(r.a, r.b) for r in spelling.near_pairs(df, bucket=90).collect()}
    near = brute_near(words)
    assert len(depth) > 2
    assert pairs == {(a, b) if (len(a), a) < (len(b), b) else (b, a) for a in near for b in near[a]}


def test_a_bucket_that_every_word_probes(spark):
    words = {"abcdef": 5} | {f"abc{a}{b}def{c}"[:7]: 3 for a in "klmnop" for b in "qrstuv" for c in "x"} | {f"abcdef{a}": 9 for a in "ghijk"}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(1)
    near = brute_near(words)
    rows = spelling.near_pairs(df).collect()
    assert len(rows) == len({(r.a, r.b) for r in rows})
    assert {frozenset((r.a, r.b)) for r in rows} == {frozenset((a, b)) for a in near for b in near[a]}
    with pytest.raises(ValueError):
        spelling.spelling_variants(df.select(F.lit(1).alias("doc_id"), F.col("word").alias("text")), bucket=10)

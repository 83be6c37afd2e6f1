import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import simhash, warc
from newsloom.llm.blocks import coded, pack, unpack
from newsloom.llm.queries import codec_digest, op2_warc, op3_simhash, tokenizer_path
from newsloom.llm.sentencepiece_codec import _processor, check_model, chunk_keys, encode_documents, read_model, segment, segment_table

ODD = ["", " ", "  a  b ", "a\tb\nc", "▁x ▁▁ y", "ﬁ Å① \x00 z", "   ", "x" * 5000, "word " * 3000, "ééé ñ", "\n\n", "🙂🙂 🙂", "<s> </s> <0x0A> <unk>", "a ▁", "▁", " ▁ "]


def brute(sp, text):
    ids = sp.encode(text or "", add_bos=True, add_eos=True)
    return len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_codec_equals_library(spark, sf):
    rows = [(i, t, "clash") for i, t in enumerate([*ODD, None, ODD[2], ODD[2]])] + [(None, "null id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    sp = _processor(read_model(tokenizer_path()))
    for small in (1, 3, 400_000):
        got = {r[0]: tuple(r[1:]) for r in codec_digest(encode_documents(docs, tokenizer_path(), block_words=small)).collect()}
        assert got == {i: brute(sp, t) for i, t, _ in rows}
    corpus = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r[0]: tuple(r[1:]) for r in codec_digest(encode_documents(corpus, tokenizer_path())).collect()}
    assert got == {r.doc_id: brute(sp, r.text) for r in corpus.collect()}


def test_codec_empty_table(spark):
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁\n\tabé<>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_chunks_join_to_the_whole(text):
    model = read_model(tokenizer_path())
    check_model(model)
    sp = _processor(model)
    found, surfaces = segment(sp, chunk_keys(text.encode()))
    ids = sp.encode(text)
    assert b"".join(found) == np.asarray(ids, "<u2").tobytes()
    assert b" ".join(surfaces).decode() == sp.decode(ids)


@pytest.mark.parametrize("words", [50, 400_000])
def test_every_distinct_chunk_is_segmented_once(spark, words):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    model = read_model(tokenizer_path())
    messages = coded(docs.select("doc_id", "text"), chunk_keys, "probe", block_words=words).messages
    distinct = {k for r in docs.collect() for k in chunk_keys((r.text or "").encode())}
    assert segment_table(messages, model).agg({"made": "sum"}).first()[0] == len(distinct)
    assert messages.select("block").distinct().count() >= (5 if words > 50 else 100)


@given(st.lists(st.binary(max_size=12), max_size=30))
def test_packed_words_round_trip(words):
    assert unpack(pack(words)) == words


def brute_pages(pages):
    groups = defaultdict(list)
    for page_id, html in pages:
        groups[(html or "").encode()].append(page_id)
    out = []
    for page_id, html in pages:
        raw = (html or "").encode()
        top = max(groups[raw])
        again = len(raw) >= 1000 and page_id != top
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out)


def test_warc_equals_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert sorted(map(tuple, op2_warc(spark, sf).collect())) == brute_pages([(r.page_id, r.html) for r in pages.collect()])


def test_warc_odd_pages(spark, tmp_path):
    big = "é<p>\r\n\r\n" * 400
    rows = [(1, "http://a b/", big), (2, None, big), (3, "http://c/é", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "WARC/1.1\r\n\r\n" * 200), (8, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as archive")
    archives = warc.archive_pages(pages)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warcs(archives).collect()]
    assert sorted(got) == brute_pages([(a, c) for a, _, c in rows])
    payloads = {r.page_id: bytes(r.payload) for r in warc.read_warcs(archives).where("record_type = 'response'").collect()}
    assert payloads[8] == big.encode() and payloads[7] == rows[6][2].encode()
    names = warc.export_archives(archives, str(tmp_path))
    assert names and all(n.endswith(".warc.gz") for n in names)
    with open(tmp_path / names[0], "rb") as f:
        assert [h["warc-type"] for h, _ in warc.parse_warc(f.read())][0] == "warcinfo"


def test_warc_equal_rows_and_empty_table(spark):
    same = spark.createDataFrame([(1, "u", "x" * 1000), (1, "u", "x" * 1000), (None, "u", "x" * 1000)], "page_id long, url string, html string")
    got = warc.read_warcs(warc.archive_pages(same)).collect()
    assert sorted(r.record_type for r in got) == ["response", "revisit", "revisit"]
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {1}
    assert warc.read_warcs(warc.archive_pages(same.where("page_id = 9"))).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_parses_declared_lengths(version):
    body = warc.http_message(b"line\n1 0 x\nhttp://x 0.0.0.0 2 t 3\n", 5)
    data = warc.arc_version_block(version, "f", "20240101000000") + warc.arc_record(version, "http://u", "2023", body, "f", 0) * 2
    assert [r.body for r in warc.parse_arc(warc._member(data))] == [body, body]
    assert warc.warc_time("2023") == "2023-01-01T00:00:00Z"
    good, bad = warc.parse_arc(warc._member(data[:-10]))
    assert good.body == body and "are left" in bad.reason


#: Archives as other writers made them: not compressed, a blank in a URL, an address of a version 2 line with more fields.
ARC_1 = b"""filedesc://IA-001102.arc 0.0.0.0 19960923142103 text/plain 76
1 0 Alexa Internet
URL IP-address Archive-date Content-type Archive-length

http://www.example.com:80/some file.html 207.241.224.241 19961104142103 text/html 61
HTTP/1.0 200 Document follows
Content-Type: text/html

hello

dns:www.example.com 207.241.224.241 19961104142104 text/dns 5
A 1 2
"""
ARC_2 = b"""filedesc://IA-2.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 IA-2.arc 122
2 0 Alexa Internet
URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

http://b.example/ 10.0.0.1 2001 text/html 200 fac069150613fe55599cc7fa88aa089d - 209 IA-2.arc 18
HTTP/1.0 200 OK

x
"""


def test_arcs_of_other_writers():
    first, second = warc.parse_arc(ARC_1)
    assert first.fields["URL"] == "http://www.example.com:80/some file.html" and first.body.endswith(b"hello\n")
    assert second.fields["URL"] == "dns:www.example.com" and second.body == b"A 1 2"
    (only,) = warc.parse_arc(ARC_2)
    assert only.fields["Result-code"] == "200" and only.fields["Filename"] == "IA-2.arc" and only.body == b"HTTP/1.0 200 OK\n\nx"
    assert warc.warc_time(only.fields["Archive-date"]) == "2001-01-01T00:00:00Z"
    whole = [warc._member(ARC_1), *warc.unzipped(b"")]
    assert [r.body for r in warc.parse_arc(whole[0])] == [first.body, second.body]


def test_bad_records_are_reported_and_the_rest_goes_on(spark):
    broken = ARC_1.replace(b"text/html 61", b"text/html 6100")
    kinds = [type(r).__name__ for r in warc.parse_arc(broken)]
    assert kinds == ["BadRecord", "ArcRecord"]
    assert [type(r).__name__ for r in warc.parse_arc(b"no archive at all\n")] == ["BadRecord"]
    assert list(warc.parse_arc(b"")) == []
    name, rows = "x.arc.gz", [warc.arc_version_block(1, "x", "2020")] + [warc.arc_record(1, "http://u/", "2020", warc.http_message(b"p" * 1000, i), "x", 0) for i in range(4)]
    members = [warc._member(r) for r in rows]
    members[2] = members[2][:40] + b"\x00" * 30
    arcs = spark.createDataFrame([(name, bytearray(b"".join(members))), ("plain.arc", bytearray(ARC_1)), ("bad.arc", bytearray(b"\x1f\x8b\x08 zip"))], warc.ARCHIVES)
    payloads = warc.arc_payloads(arcs)
    assert {(r.archive, r.idx) for r in payloads.where("bad is null").collect()} == {(name, 0), (name, 1), (name, 2), ("plain.arc", 0), ("plain.arc", 1)}
    assert {r.archive for r in payloads.where("bad is not null").collect()} == {name, "bad.arc"}
    got = warc.read_warcs(warc.convert_arcs(arcs, warc.revisits(payloads))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id is not None) == [(0, "revisit", 3), (2, "revisit", 3), (3, "response", None)]
    assert len(got) == 5 and len({r.record_id for r in got}) == 5


def test_record_identifiers_differ_between_tables(spark):
    ids = set()
    for word in ("one", "two"):
        pages = spark.createDataFrame([(i, f"http://{word}/{i}", f"{word} {i}") for i in range(20)], "page_id long, url string, html string").repartition(2)
        ids |= {r.record_id for r in warc.read_warcs(warc.archive_pages(pages)).collect()}
    assert len(ids) == 40


def test_revisits_name_what_they_revisit(spark):
    same = spark.createDataFrame([(i, f"http://u/{i}", "x" * 1000) for i in range(3)], "page_id long, url string, html string")
    (row,) = warc.archive_pages(same).collect() if same.rdd.getNumPartitions() == 1 else [r for r in warc.archive_pages(same.coalesce(1)).collect()]
    heads = [h for h, _ in warc.parse_warc(bytes(row.content))]
    response = [h for h in heads if h["warc-type"] == "response"][0]
    for h in heads:
        if h["warc-type"] == "revisit":
            assert h["warc-refers-to"] == response["warc-record-id"] and h["warc-refers-to-target-uri"] == "http://u/2" and h["warc-refers-to-date"] == response["warc-date"]


def brute_fp(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = list(range(len(fps)))
    parent = ids[:]

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a = np.array(fps, dtype=np.uint64)
    for i in ids:
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4):
            parent[top(int(j))] = top(i)
    return [top(i) for i in ids]


def test_simhash_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = [brute_fp(r.text) for r in docs]
    tops = brute_components(fps)
    low = defaultdict(lambda: 1 << 60)
    for r, t in zip(docs, tops):
        low[t] = min(low[t], r.doc_id)
    want = sorted((r.doc_id, f"{f:016x}", low[t]) for r, f, t in zip(docs, fps, tops))
    assert sorted(map(tuple, op3_simhash(spark, sf).collect())) == want


def test_near_components_of_a_dense_cloud(spark):
    rng = np.random.default_rng(3)
    cloud = []
    for center in rng.integers(0, 2**63, 6):
        for _ in range(150):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            cloud.append(int(center) ^ sum(1 << int(b) for b in flips))
    fps = sorted({x & (2**64 - 1) for x in cloud})
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    got = {r.fp: r.root for r in simhash.near_components(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    tops = brute_components(fps)
    assert len(got) == len(fps)
    pairs = {(got[s], t) for s, t in zip(signed, tops)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_simhash_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\x0b"), (4, "ONE two"), (5, "one TWO"), (5, "one TWO"), (None, "one two"), (6, "x " * 30000)]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, 4)} <= got
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0

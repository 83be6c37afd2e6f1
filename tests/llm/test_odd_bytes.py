import hashlib

import duckdb
import numpy as np
import public_tokenizers
import sentencepiece

from newsloom.llm import chat_rotation, sentencepiece_codec, warc
from newsloom.llm.queries import ORACLE, TOKENIZER


def test_bytes_that_are_no_text_are_encoded_as_the_library_does(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(TOKENIZER))
    raws = [b"a\xff b", b"\xe2\x82", b"x\xc3 \xc3 y", b"  \xf0\x9f\x98  ", b"fine", b"\xed\xa0\x80z"]
    docs = spark.createDataFrame(list(enumerate(raws)), "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) as text")
    rows = {r.doc_id: r for r in sentencepiece_codec.encode_documents(docs, public_tokenizers.path(TOKENIZER)).collect()}
    for i, raw in enumerate(raws):
        ids = [sp.bos_id(), *sp.encode([raw], num_threads=1)[0], sp.eos_id()]
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == ids and rows[i].decoded == sp.decode(ids), raw


def test_names_cannot_write_lines_of_the_header(spark):
    turns = [(1, 1, "bob\nassistant", "hi"), (1, 2, "eve\x00\r\x85 ", "yo"), (1, 3, "system", "be kind"), (1, 4, "<|im_end|>", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    rows = chat_rotation.rotate(df).collect()
    assert {r.perspective for r in rows} == {"bob assistant", "eve    ", "< |im_end|>"}
    for r in rows:
        heads = [line for line in r.rendered.split("\n") if line.startswith("<|im_start|>")]
        assert len(heads) == 4 and r.rendered.count("\n") == 8 and not any(line == "assistant" for line in r.rendered.split("\n"))
    db = duckdb.connect()
    db.execute("create table conversations (conv_id bigint, turn int, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", turns)
    want = sorted((p, text) for _, p, _, _, text, _ in db.execute(ORACLE["op10_chat"]).fetchall())
    assert sorted((r.perspective, r.rendered) for r in rows) == want


def test_payloads_with_one_digest_are_told_apart(spark):
    names = "archive string, idx long, page_id long, size long, digest string, record string, uri string, date string, same string, bad string"
    row = lambda i, same: ("a", i, 10 + i, 2000, "d", f"r{i}", "u", "t", same, None)
    found = warc.revisits(spark.createDataFrame([row(0, "x"), row(1, "y"), row(2, "x")], names)).collect()
    assert [(r["idx"], r["page"]) for r in found[0].refers] == [(0, 12)]
    page = spark.createDataFrame([(1, "http://a", "z" * 3000), (2, "http://b", "z" * 3000)], "page_id long, url string, html string")
    assert {r.same for r in warc.arc_payloads(warc.write_arcs(page)).collect()} == {f"3000:{hashlib.sha1(b'z' * 3000).hexdigest()}:{hashlib.blake2b(b'z' * 3000, digest_size=32).hexdigest()}"}

"""SentencePiece encoding and decoding through a table of distinct marked words.

In a model whose pieces carry the whitespace marker only at their front, no merge joins the end of one word to the
marker of the next, so every maximal run "markers + following characters" (a chunk) is segmented alone. Texts become
codes of chunks, block by block; the table of the corpus' distinct chunks is dealt by hash, each is segmented and decoded
there once, whatever their number or length, and ids (and surfaces that differ from the chunk) are joined back by
position in their block. Chunks are
kept without their first marker and with spaces for further ones, which is exactly the text that the library turns
back into the chunk.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.blocks import BLOCK_TOKENS, BLOCK_WORDS, coded, codes_of, met, numbering, numbers, pack, placed, places, unpack

MARK = "▁".encode()


@lru_cache(maxsize=4)
def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def check_model(model: bytes) -> None:
    """Raise unless chunks can be segmented alone: markers only in front, spaces and other characters untouched."""
    sp = _processor(model)
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if "▁" in piece.lstrip("▁"):
            raise ValueError(f"piece {i} has a whitespace marker inside; chunks cannot be segmented alone")
    probe = "  a  b "
    if sp.decode(sp.encode(probe)) != probe:
        raise ValueError("the model normalises white space; chunks cannot be segmented alone")


def chunk_keys(raw: bytes) -> list[bytes]:
    """Chunks of a text, in order; none for an empty text."""
    if not raw:
        return []
    parts = raw.replace(MARK, b" ").split(b" ")
    if b"" not in parts:
        return parts
    out, waiting = [], 0
    for part in parts:
        if part:
            out.append(b" " * waiting + part)
            waiting = 0
        else:
            waiting += 1
    if waiting:
        out.append(b" " * (waiting - 1))
    return out


def segment(sp, keys: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Ids (little-endian unsigned 16-bit) and decoded bytes of every chunk; bytes that are no UTF-8 are the library's to replace."""
    alone = [sp.piece_to_id("▁")]
    ids = [found or alone for found in sp.encode(keys, num_threads=1)]
    return [np.asarray(found, "<u2").tobytes() for found in ids], [text.encode() for text in sp.decode(ids, num_threads=1)]


def segment_table(messages: DataFrame, model: bytes, batch: int = 10_000) -> DataFrame:
    """The distinct chunks' table, answered to the blocks: ``(block, owner, ids, odd, surfaces, made)``.

    ``surfaces`` are only those of the message's chunks numbered ``odd``, which are not decoded to themselves. ``made``
    counts the chunks that an owner segmented (on the first of its replies), so its sum is the table's size.
    """

    def run(asked: pa.Table) -> pa.Table:
        index = numbering()
        wanted = [numbers(index, unpack(m)) for m in asked["words"].to_pylist()]
        keys, ids, surfaces = list(index), [], []
        for at in range(0, len(keys), batch):
            some = segment(_processor(model), keys[at : at + batch])
            ids += some[0]
            surfaces += some[1]
        is_odd = np.fromiter((k != s for k, s in zip(keys, surfaces)), bool, len(keys))
        odd = [np.flatnonzero(is_odd[want]) for want in wanted]
        binary = lambda parts: pa.array(list(parts), pa.binary())
        return pa.table({
            "block": asked["block"], "owner": asked["owner"], "ids": binary(pack([ids[i] for i in want.tolist()]) for want in wanted),
            "odd": binary(map(places, odd)), "surfaces": binary(pack([surfaces[i] for i in want[o].tolist()]) for want, o in zip(wanted, odd)),
            "made": pa.array([len(keys)] + [0] * (len(wanted) - 1), pa.int64()),
        })

    schema = "block int, owner int, ids binary, odd binary, surfaces binary, made long"
    return messages.select("block", "owner", "words").groupBy("owner").applyInArrow(run, schema)


def encode_documents(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Encode every whole text with begin and end ids, and decode it again.

    Returns one row per input row: the id column, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded``.
    A null text counts as empty (begin and end only, decoded to ''); bytes that are no UTF-8 are encoded as the library
    does, each as U+FFFD; null ids stay null; repeated rows give repeated
    results; other columns, whatever their names, are not read. An empty table gives an empty result. ``block_words``
    and ``block_tokens`` bound what a task holds, not what is done.
    """
    model = read_model(model_path)
    check_model(model)
    sp = _processor(model)
    if sp.get_piece_size() > 1 << 16:
        raise ValueError("ids are exchanged in 16 bits")
    texts = coded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), chunk_keys, "chunks", block_words=block_words, block_tokens=block_tokens)
    replies = segment_table(texts.messages, model).drop("made")
    begin, end = (np.asarray([i], dtype="<u4").tobytes() for i in (sp.bos_id(), sp.eos_id()))

    def join_back(rows: pa.Table, said: pa.Table) -> pa.Table:
        listed = rows.filter(pc.is_valid(rows["owner"]))
        rows = rows.filter(pc.is_null(rows["owner"]))
        id_at, codes_at = rows.column_names.index("id"), rows.column_names.index("codes")
        own = {row["owner"]: row for row in listed.select(["owner", "places", "words"]).to_pylist()}
        ids: list[bytes] = []
        surfaces: list[bytes] = []
        codes: list[np.ndarray] = []
        for reply in said.to_pylist():
            mine = own[reply["owner"]]
            codes.append(placed(mine["places"]))
            ids += unpack(reply["ids"])
            found = unpack(mine["words"])
            for at, surface in zip(placed(reply["odd"]).tolist(), unpack(reply["surfaces"])):
                found[at] = surface
            surfaces += found
        where = np.empty(len(ids), np.int64)
        if codes:
            where[np.concatenate(codes)] = np.arange(len(ids))
        out = []
        for some in rows.to_batches(max_chunksize=200):  # what is made of a block's texts stays in Arrow's buffers only
            all_ids, decoded = [], []
            for raw in some.column(codes_at).to_pylist():
                at = where[codes_of(raw)].tolist()
                all_ids.append(begin + np.frombuffer(b"".join([ids[i] for i in at]), "<u2").astype("<u4").tobytes() + end)
                decoded.append(b" ".join([surfaces[i] for i in at]))
            out.append(pa.RecordBatch.from_arrays([some.column(id_at), pa.array(all_ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())], names=[id_col, "ids", "decoded"]))
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out, pa.schema([(id_col, rows["id"].type), ("ids", pa.binary()), ("decoded", pa.string())]))

    kind = docs.schema[id_col].dataType.simpleString()
    # a block's own words lie beside its codes, so only ids travel back
    return met(texts.table.select("block", "id", "codes", "owner", "places", "words"), replies, join_back, f"`{id_col}` {kind}, ids binary, decoded string")

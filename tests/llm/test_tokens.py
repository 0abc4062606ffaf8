import io
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tidemark.llm.common import new_path  # noqa: E402
from tidemark.llm.token_counts import pre_tokens, token_counts  # noqa: E402
from tidemark.llm.token_output import Reader, Writer, read_tokens, write_tokens  # noqa: E402

BYTE, WORD = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def test_counts_are_the_librarys(odd, docs):
    model = Tokenizer.from_file(BYTE)
    for df in (odd, docs):
        expected = sorted((r.doc_id or -1, len((r.text or "").encode()), len(model.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
        found = token_counts(df, BYTE).collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in found) == expected
        assert all(r.over_limit == (r.n_tokens > 512) for r in found)


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "\n a \n\n  b", "a  b", "a  b", "x    y", "it's 's 42 <|endoftext|> z", "\t\t x"])
def test_pre_tokens_never_change_the_tokens(text):
    model = Tokenizer.from_file(BYTE)
    assert "".join(pre_tokens(text)) == text
    parts = [i for p in pre_tokens(text) if p for i in model.encode(p, add_special_tokens=False).ids]
    assert parts == model.encode(text, add_special_tokens=False).ids


def test_sentencepiece_counts(docs):
    from sentencepiece import SentencePieceProcessor

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model, few = SentencePieceProcessor(model_file=path), docs.orderBy("doc_id").limit(5)
    assert {r.doc_id: r.n_tokens for r in token_counts(few, path).collect()} == {r.doc_id: len(model.encode(r.text)) for r in few.collect()}


def test_files_hold_the_librarys_ids(spark, odd, docs):
    model = Tokenizer.from_file(WORD)
    for df in (odd, docs):
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id))
        ids = [np.array([*model.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in rows]
        found = sorted(read_tokens(write_tokens(df, WORD, new_path(spark, "ids"))).collect(), key=lambda r: r.start)
        starts = np.cumsum([0, *map(len, ids)])[:-1]
        assert [(r.doc_id, r.start, r.n_tokens) for r in found] == [(r.doc_id, s, len(i)) for r, s, i in zip(rows, starts, ids)]
        assert sorted(r.ids_crc32 for r in found) == sorted(zlib.crc32(i.tobytes()) for i in ids)


def test_a_reader_opens_only_the_frames_it_needs():
    sink = io.BytesIO()
    writer = Writer(sink, frame_bytes=64)
    docs = [np.arange(k * 7, k * 7 + k % 5 + 1, dtype="<u4").tobytes() for k in range(40)]
    for k, ids in enumerate(docs):
        writer.add(k, ids)
    writer.close()
    raw = sink.getvalue()
    reader = Reader(io.BytesIO(raw), len(raw))
    opened = []
    whole, reader.frame = reader.frame, lambda k: (opened.append(k), whole(k))[1]
    assert dict(reader.documents([3, 39])) == {3: docs[3], 39: docs[39]} and len(opened) == 2 < len(reader.seek)
    assert [ids for _, ids in reader.documents()] == docs
    broken = bytearray(raw)
    broken[8] ^= 255
    with pytest.raises(Exception):
        list(Reader(io.BytesIO(bytes(broken)), len(raw)).documents([0]))


def test_empty_tables(spark, nothing):
    assert token_counts(nothing, BYTE).count() == 0
    assert read_tokens(write_tokens(nothing, WORD, new_path(spark, "ids"))).count() == 0


def test_each_distinct_pre_token_is_counted_once(docs):
    from tidemark.llm.common import unpacked
    from tidemark.llm.token_counts import _NAME_BITS, _chunks, _counts

    # as if from the last partitions that can be: names and places are columns of their own and never overflow
    far = (1 << 31) - 10 << _NAME_BITS
    chunks = _chunks(docs.repartition(5), False, 20_000).selectExpr(f"chunk + {far}L AS chunk", "pieces").cache()
    assert chunks.agg({"chunk": "min"}).first()[0] >= far > 0
    assert chunks.count() > 5
    found = {r.chunk: {} for r in chunks.select("chunk").collect()}
    for row in _counts(chunks, BYTE).collect():
        place, n = unpacked(row.counts)
        assert not set(place.tolist()) & set(found[row.chunk])
        found[row.chunk].update(zip(place.tolist(), n.tolist()))
    model = Tokenizer.from_file(BYTE)
    for row in chunks.select("chunk", "pieces").collect():
        assert [found[row.chunk][k] for k in range(len(row.pieces))] == [len(model.encode(p, add_special_tokens=False).ids) for p in row.pieces]


def test_counts_query_as_registered(spark, sf, docs):
    from tidemark.llm.registry import QUERIES

    found, model = QUERIES["op9_token_counts"](spark, sf), Tokenizer.from_file(BYTE)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    expected = [(r.doc_id, len(r.text.encode()), len(model.encode(r.text, add_special_tokens=False).ids)) for r in docs.fillna("", ["text"]).collect()]
    assert sorted(map(tuple, found.collect())) == sorted((*r, r[2] > 512) for r in expected)

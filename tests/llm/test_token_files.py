import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import token_files


def test_segments_come_back_exactly_and_blocks_on_their_own(monkeypatch):
    r = np.random.default_rng(4)
    monkeypatch.setattr(token_files, "BLOCK_IDS", 5000)
    for ids in (np.array([7]), np.zeros(3000, np.int64), r.integers(0, 49_000, 20_001), np.minimum(r.zipf(1.3, 23_456), 49_000) - 1):
        data = token_files.encode_segment(ids)
        assert (token_files.decode_segment(data) == ids).all()
        if len(ids) > 10_000:
            assert (token_files.decode_segment(data, range(1, 3)) == ids[5000:15_000]).all()
    assert len(data) < 4 * len(ids)


def test_more_symbols_than_the_usual_scale_has_slots():
    for ids in (np.arange(262_145), np.concatenate([np.arange(300_000), np.zeros(50_000, np.int64)])):
        symbols, freq = token_files.frequencies(ids)
        assert len(symbols) == len(set(ids.tolist())) and freq.min() >= 1 and freq.sum() == 1 << token_files.scale_of(len(symbols)) > 1 << token_files.SCALE
        data = token_files.encode_segment(ids)
        assert (token_files.decode_segment(data) == ids).all()
        assert (token_files.decode_segment(data, range(1, 2)) == ids[token_files.BLOCK_IDS : 2 * token_files.BLOCK_IDS]).all()


def test_damage_is_noticed():
    data = bytearray(token_files.encode_segment(np.arange(5000) % 300))
    data[-9] ^= 4
    with pytest.raises(ValueError):
        token_files.decode_segment(bytes(data))


def test_files_hold_the_ids_of_the_tokenizer_in_order(odd_docs, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 1000)
    got = token_files.read_documents(token_files.write_segments(odd_docs), with_ids=True).collect()
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = sorted(odd_docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    start = 0
    for d, r in zip(docs, sorted(got, key=lambda r: r["start"]), strict=True):
        ids = coder.encode(d["text"] or "", add_special_tokens=False).ids + [1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"], r["ids_crc32"]) == (d["doc_id"], start, len(ids), ids, zlib.crc32(np.array(ids, "<u4")))
        start += len(ids)
    assert token_files.read_documents(token_files.write_segments(odd_docs.limit(0))).count() == 0


def test_ids_of_odd_words_are_the_tokenizers(monkeypatch):
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    from corpusloom.llm import tokens

    texts = ["Straße STRASSE straße, Été ÉTÉ! ÿ Þ þ", "-- --a a-- a.b A'b it's (x) x) ... don't!?", "é́ ｆｕｌｌ 日本語 a日 İi ǅ", "x1 1x 12,5% a_b _a [UNK] </w> a</w> <b>", "", None, "  \t\n ", "word " * 50, " a b  c"]
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for limit in (500_000, 3):
        monkeypatch.setattr(tokens, "CACHE_WORDS", limit)
        coder = tokens.BatchTokenizer()
        for _ in range(2):
            ids, at = coder.encode(pa.array(texts), 1)
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [plain.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]

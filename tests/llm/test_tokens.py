"""Packing and byte-level BPE against the public libraries."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sigwatch.llm import bpe, packing

SF = "/root/testdata/sf0.001"
ODD = ["", "it's we'll they've I'm he'd can't you're", "''s '' 's's 'll've", "a  b\n\n c\t\td   ", " 'x !'s x'S",
       "  \n", "café ² Ⅷ 123abc", "x" * 3000, "!" * 900 + "a", "日本語テキスト　空白", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "End. end, END! it's. ...! a.b.c. x?y? İİ. DŽ. ﬁ, ǅ ß. Ω. Å. क़. क़! e\u0301. 각각. ʰ. ª.",
       "\x1c\x1d a\x85b\xa0c", "'re'ree'ved'lll'l", "é ́ Σίσυφος İ", "a​b c", "'", "' ", "\n's"]


@pytest.fixture(scope="module")
def byte_reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


@pytest.fixture(scope="module")
def byte_encoder():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return bpe.ByteEncoder(file.read())


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, t, i) for i, t in enumerate(ODD)] + [(100, None, None, None), (None, "null id", "", 3), (1, ODD[1], "", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, part int")


def test_odd_texts_encode_as_the_library_does(byte_reference, byte_encoder):
    for ids, text in zip(byte_encoder.encode(ODD), ODD):
        assert ids.tolist() == byte_reference.encode_ordinary(text), text
        assert byte_encoder.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("'stmdrvle xS\n\t .1é²　'") | st.characters(exclude_categories=["Cs", "Cn"]),
                        max_size=40), max_size=6))
def test_any_texts_encode_as_the_library_does(byte_reference, byte_encoder, texts):
    assert [i.tolist() for i in byte_encoder.encode(texts)] == [byte_reference.encode_ordinary(t) for t in texts]


def test_classes_agree_with_the_library_up_to_unicode_version(byte_reference):
    import regex
    table = bpe._class_table()
    for pattern, kinds in ((r"\p{L}", (bpe.LETTER, bpe.STMD, bpe.R, bpe.V, bpe.L, bpe.E)), (r"\p{N}", (bpe.NUMBER,))):
        match = regex.compile(pattern).match
        wrong = [c for c in range(0x30000) if bool(match(chr(c))) != (table[c] in kinds)
                 and bpe.unicodedata.category(chr(c)) != "Cn"]
        assert not wrong


def test_scan_equals_a_sequential_run():
    kinds = np.random.default_rng(3).integers(0, bpe.CLASSES - 1, 1000).astype(np.uint8)
    table, state, expected = bpe._transitions(), bpe.IN_BLANK, []
    for kind in kinds:
        state = table[kind, state]
        expected.append(state)
    assert bpe.scan_states(kinds).tolist() == expected


def test_documents_digest_as_the_library_says(spark, byte_reference, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for frame in (docs, odd):
        texts = [(r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()]
        expected = []
        for key, text in texts:
            ids = byte_reference.encode_ordinary(text)
            expected.append((key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                             hashlib.sha256(text.encode()).hexdigest()))
        assert sorted(map(tuple, bpe.digests(frame).collect()), key=str) == sorted(expected, key=str)


def test_offsets_and_round_trip(spark, odd):
    encoded = bpe.encode(odd)
    assert sorted((r[0] is None, r[0], bytes(r[1])) for r in bpe.decode(encoded).collect() if r[0] is not None) == \
        sorted((False, r.doc_id, (r.text or "").encode()) for r in odd.collect() if r.doc_id is not None)
    row = encoded.where("doc_id = 6").first()
    assert row.offsets[0] == 0 and len(row.offsets) == len(row.ids)


@pytest.mark.parametrize("window", [4096, 7])
def test_pieces_cover_every_id_once(spark, odd, window):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for frame in (docs.repartition(5), odd.where("doc_id <> 1")):
        ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in frame.collect()}
        tokens = packing.tokenised(frame)
        rows = packing.pieces(tokens, window).collect()
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for r in rows:
            part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
            assert len(part) == r.length and r.ids_crc32 == zlib.crc32(part.tobytes())
            assert r.doc_tokens == len(ids[r.doc_id])
            by_doc[r.doc_id].append((r.start, r.length))
            by_sequence[r.sequence_id].append((r.offset, r.length, part))
        assert by_doc.keys() == ids.keys()
        for spans in by_doc.values():
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
        total = sum(map(len, ids.values()))
        assert sorted(by_sequence) == list(range(-(-total // window)))
        whole = {r.sequence_id: r.ids for r in packing.sequences(tokens, window).collect()}
        assert whole.keys() == by_sequence.keys()
        for number, spans in by_sequence.items():
            at, joined = 0, []
            for offset, length, part in sorted(spans, key=lambda s: s[0]):
                assert offset == at
                at += length
                joined += part.tolist()
            assert at == min(window, total - number * window)
            assert whole[number] == joined


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty).count() == 0
    assert packing.sequences(packing.tokenised(empty)).count() == 0
    assert bpe.digests(empty).count() == 0

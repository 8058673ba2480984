"""Token counts against the public library."""

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sigwatch.llm import token_counts

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "it's we'll 've I'm", "a  b\n\n c\t\td   ", "x" * 3000, "=" * 200 + " " + "=" * 200, "café ² Ⅷ 123abc",
       "a <|endoftext|> b  <|endoftext|>", "<|endoftext|><|endoftext|>", "<|endof", "\x1c\x1d a\x85b\xa0c ᠎ d",
       "日本語 \U0001f600\U0001faf8 ᲀࡰ \U00016d40", "é '́s    x", "\u0000\u0001 �"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def cut():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        return token_counts.PreTokenizer(file.read())


def expected(library, frame):
    found = []
    for r in frame.select("doc_id", "text").collect():
        text = r.text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        found.append((r.doc_id, len(text.encode()), n, n > 512))
    return sorted(found, key=str)


@pytest.mark.parametrize("most", [token_counts.FREQUENT, 40, 0])
def test_counts_are_the_library_s(spark, library, most):
    rows = [(i, t, 1, 2) for i, t in enumerate(ODD)] + [(1, "again again", 1, 1), (1, "again again", 1, 1), (None, "null id", 0, 0),
                                                       (99, None, None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, sum int, rest int")
    for frame in (odd.repartition(3), spark.read.parquet(f"{SF}/documents.parquet")):
        found = token_counts.count_tokens(frame, most=most)
        assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert sorted(map(tuple, found.collect()), key=str) == expected(library, frame)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("'stmdrvle S\n\t .1é²　<|>") | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_counts_as_in_the_library(library, cut, text):
    found, special = cut(text)
    assert sum(n * k for n, k in zip(found.values(), cut.lengths(list(found)))) + special == len(
        library.encode(text, add_special_tokens=False).ids)


def test_every_piece_is_counted_once(spark, library):
    docs = spark.createDataFrame([(1, "ab cd ab"), (2, "ab cd"), (3, None)], "doc_id long, text string")
    found = {r.piece: (r.n, r.tokens) for r in token_counts.piece_counts(docs.repartition(3)).collect()}
    assert {p: n for p, (n, _) in found.items()} == {"ab": 2, " cd": 2, " ab": 1}
    assert all(tokens == len(library.encode(p).ids) for p, (_, tokens) in found.items())
    # Two or three pieces can be held; the power of two that fits decides.
    counts = token_counts.piece_counts(docs)
    assert sorted(token_counts.frequent_pieces(counts, 2).column("key").to_pylist()) == [" cd", "ab"]
    assert token_counts.frequent_pieces(counts, 1).num_rows == 0


def test_empty_table(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0

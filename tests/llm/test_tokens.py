from pathlib import Path

import pytest

from lodestrata.llm import tokens

TEXTS = ["", None, "Hello world", "  two  spaces\n\n\tand tabs ", "größe Straße café 状態は ok です。 🙂👩‍👩‍👧", "<|endoftext|> is text", "don't I'll they've", "1234567890 3.14e-5", "\u0000\x7f\u200b\u00a0", "a" * 20_000, "x = {'a': [1, 2]}\r\n"]
HERE = Path(tokens.tokenizer_file())


@pytest.fixture(scope="module")
def bpe():
    if not HERE.exists():
        pytest.skip("no vocabulary files")
    return tokens.byte_bpe(str(HERE))


def test_equals_the_vocabulary_under_another_library(bpe):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=tokens.word_pattern(), mergeable_ranks=tokens.read_ranks(str(HERE)), special_tokens={})
    for text, ids in zip(TEXTS, bpe.encode_batch(TEXTS)):
        assert ids == (own.encode_ordinary(text) if text else [])


def test_round_trip(bpe):
    for text, ids in zip(TEXTS, bpe.encode_batch(TEXTS)):
        assert bpe.decode(ids) == (text or "")


def test_pattern_is_the_files_own():
    public = pytest.importorskip("public_tokenizers")
    import regex

    for text in filter(None, TEXTS):
        assert regex.findall(public.PATTERN, text) == regex.findall(tokens.word_pattern(), text)


def test_frame_keeps_rows_and_clashing_columns(spark, bpe):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, "", "x")], "doc_id long, text string, ids string")
    out = tokens.encode(frame)
    assert out.columns == ["doc_id", "text", "ids"] and out.count() == len(TEXTS) + 1
    assert {r.doc_id: r.ids for r in out.collect()}[1] == []
    counts = {r.doc_id: r.n_tokens for r in tokens.count_tokens(frame, keep=["doc_id"]).collect()}
    assert counts[0] == counts[1] == 0 and counts[2] == 2
    assert tokens.encode(frame.limit(0), keep=["doc_id"]).count() == 0

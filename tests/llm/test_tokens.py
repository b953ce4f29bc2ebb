import os
import random

import pytest

from docloom.llm import tokens as T

PATH = os.path.join(T.DEFAULT_FOLDER, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def enc():
    with open(PATH, "rb") as file:
        return T.encoder(file.read())


def test_long_texts_are_cut_safely(enc, monkeypatch):
    r = random.Random(1)
    parts = ["word", "it's", " ", "  ", "\n", "\n\n ", "12", "é", "日本", "!?", "<|endoftext|>", "\u00a0", "\x1c", "ไทย", "😀", "\r\n", "'"]
    for _ in range(60):
        text = "".join(r.choice(parts) for _ in range(300))
        cut = T.stretches(text, 40)
        assert "".join(cut) == text
        assert [i for c in cut for i in enc.encode_ordinary(c)] == enc.encode_ordinary(text)


def test_against_the_other_library(enc):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(os.path.join(T.DEFAULT_FOLDER, "byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for text in ["Hello  world\n\n it's <|endoftext|> 12é日本", "", " a", "x" * 500]:
        assert T.encode(text, enc) == other.encode(text, add_special_tokens=False).ids
        assert T.decode(T.encode(text, enc), enc) == text


def test_tables(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "hello", None), (3, "hello", "a"), (None, "hello", "a"), (4, "a b " * 40_000, "a")], "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in T.with_ids(df, "doc_id", "text", PATH).collect()]
    assert dict(got)[1] == [] and dict(got)[2] == [] and len(got) == 6 and dict(got)[3] == dict(got)[None]
    assert T.with_ids(df.limit(0), "doc_id", "text", PATH).count() == 0
    assert {r.same for r in T.round_trip(df, "doc_id", "text", PATH).collect()} == {True}


def test_rank_file_from_any_file_system(spark, tmp_path):
    from docloom.llm.tokens import content_of

    (tmp_path / "r").write_bytes(b"IQ== 0\n\xff")
    assert content_of(spark, str(tmp_path / "r")) == content_of(spark, f"file://{tmp_path}/r") == b"IQ== 0\n\xff"

import codecs
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from commitlake.llm import bpe

DATA = open(bpe.DEFAULT_VOCABULARY, "rb").read()
CODER = bpe.tokenizer(DATA)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(bpe.DEFAULT_VOCABULARY.replace(".tiktoken", ".json"))
    found.encode_special_tokens = True
    return found


EDGES = ["", " ", "  \n\n a", "a" * 5000, "<|endoftext|> x", "it's we'll '''s", "\x1c\x1d\x85\xa0 x", "é ñ", "٣ ½ Ⅷ", "日本語のテキスト", "🚀🇪🇺 ❤️", "�\x00", "Ünï_cödé42"]


def test_edges_against_the_public_library(reference):
    assert [CODER.encode(t) for t in EDGES] == [reference.encode(t, add_special_tokens=False).ids for t in EDGES]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    ids = CODER.encode(text)
    assert CODER.decode(ids, piece=3) == text
    want = [i for word in bpe.regex.findall(bpe.PATTERN, text) for i in bpe.merge_by_rank(word.encode(), CODER.transducer.ranks)]
    assert ids == want


def test_words_by_definition():
    """The transducer gives what merging by rank gives, also when its tables are dropped in between."""
    random.seed(5)
    small = bpe.Transducer(CODER.transducer.ranks, max_states=50)
    for _ in range(400):
        word = bytes(random.choice(b"aeinrst \xc3\xa9\xe4\xb8\xad") for _ in range(random.randint(1, 40)))
        assert small.encode_word(word) == CODER.transducer.encode_word(word) == bpe.merge_by_rank(word, small.ranks)


def test_utf8_stream():
    """Any cut of any bytes gives what one decoding of the whole gives."""
    random.seed(2)
    for _ in range(300):
        data = bytes(random.choice(b"a\xc3\xa9\xe4\xb8\xad\xf0\x9f\x9a\x80\xed\xa0\xff\xf4\x90") for _ in range(12))
        stream, cut = bpe.Utf8Stream(), random.randint(0, 12)
        got = stream.feed(data[:cut]) + stream.feed(data[cut:]) + stream.close()
        other = codecs.getincrementaldecoder("utf-8")("replace")
        assert got == other.decode(data[:cut]) + other.decode(data[cut:], final=True)


def test_frames(spark):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", None), (3, "", None), (4, "word " * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = bpe.encode(df, "text", ["doc_id", "text"], count="n")
    got = sorted((r["doc_id"], r["ids"], r["n"]) for r in coded.collect())
    assert [g[2] for g in got][:4] == [2, 0, 0, 0] and got[1][1] == []
    back = bpe.decode(coded, "ids", ["doc_id"]).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {1: "Hello world", 2: "", 3: "", 4: "word " * 30_000}
    assert bpe.encode(df.limit(0), "text", ["doc_id"]).count() == 0
    only = bpe.encode(df, "text", ["doc_id"], ids=None, count="n")
    assert only.columns == ["doc_id", "n"]


def test_no_vocabulary_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError):
        bpe.encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "text", ["doc_id"])

"""The document queries over the smallest tables."""

import pytest

from commitlake.llm import bpe, langid, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_ids(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.DEFAULT_VOCABULARY.replace(".tiktoken", ".json"))
    library.encode_special_tokens = True
    got = {r["doc_id"]: r["ids"] for r in queries.p6_ids(spark, FOLDER).collect()}
    assert got == {i: library.encode(r["text"] or "", add_special_tokens=False).ids for i, r in documents.items()}
    assert all(r["same"] for r in queries.p6_round_trip(spark, FOLDER).collect())


def test_containers(spark, documents):
    rows = queries.p7_containers(spark, FOLDER).collect()
    sizes = {r["doc_id"]: r["n_tokens"] for r in queries.p6_round_trip(spark, FOLDER).collect()}
    for model in {r["model"] for r in rows}:
        mine = [r for r in rows if r["model"] == model]
        window = mine[0]["window_tokens"]
        held, full = {}, {}
        for r in mine:
            held.setdefault(r["doc_id"], []).append((r["piece"], r["piece_start"], r["piece_size"]))
            full.setdefault(r["container_id"], []).append((r["place"], r["offset"], r["piece_size"], documents[r["doc_id"]]["text"] or None))
        assert {i: sum(s for *_, s in p) for i, p in held.items()} == sizes
        assert all(len(p) == 1 or sizes[i] > window for i, p in held.items())
        for parts in full.values():
            at = 0
            for n, (place, offset, size, _) in enumerate(sorted(parts, key=lambda p: p[0])):
                assert (place, offset) == (n, at)
                at += size
            assert at <= window
            texts = [t for *_, t in parts if t]
            assert len(texts) == len(set(texts))
    fill = queries.p7_fill(spark, FOLDER).collect()
    assert all(r["n_containers"] >= r["least_containers"] for r in fill)


def test_languages(spark, documents):
    cases = queries.p8_found(spark, FOLDER).collect()
    assert cases and {r["share"] for r in cases} <= {"main", "other"}
    mains = {r["doc_id"]: r["found_lang"] for r in cases if r["share"] == "main"}
    assert len(mains) == sum(r["share"] == "main" for r in cases)
    assert {r["doc_id"] for r in cases} == set(mains)
    assert all(documents[i]["text"].strip() for i in mains)
    others = {r["doc_id"] for r in cases if r["share"] == "other"}
    assert all(i in others or langid.normal_label(documents[i]["lang"]) != lang for i, lang in mains.items())
    assert all(0 <= r["start_at"] < r["end_at"] <= len(documents[r["doc_id"]]["text"]) for r in queries.p8_segments(spark, FOLDER).collect())
    assert queries.p8_documents(spark, FOLDER).count() == sum(bool((r["text"] or "").strip()) for r in documents.values())

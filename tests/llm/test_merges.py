"""Encoding by merges, held against the library's own encoder."""

import random

import cases
import pytest

from clinigrid.llm import merges, pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())


def texts():
    rng = random.Random(3)
    solid = "".join(rng.choices(["the", "ing", "x", "é", "😀"], k=2000))
    spaced = "".join(rng.choices(["river", " ", "  ", "\n", "of", "stone ", "▁", "a1b2"], k=2000))
    made = [solid, spaced, spaced[:900] + solid + spaced[900:], " " * 900, "a" * 700, "x" + " " * 77 + "the", "The weather in London is nice today."]
    return [*cases.TEXTS, *enumerate(made, 100)]


@pytest.mark.parametrize("giant_chars", [1 << 16, 300])
def test_ids_are_the_librarys(spark, library, giant_chars):
    found = merges.encode_merges(cases.documents(spark, texts()), giant_chars=giant_chars, chunk_chars=200).collect()
    assert len(found) == len(texts())
    for row in found:
        assert list(row["ids"]) == library.encode(row["text"] or "")
        assert row["n_pieces"] == len(row["ids"])


def test_a_heap_merges_as_a_scan(monkeypatch):
    model = merges.Merges(merges.merge_vocabulary(pieces.model_bytes()))
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices("▁▁theingandoun", k=rng.randint(1, 90)))
        assert model.merged_by_heap(text) == model.merged(text)


def test_chunks_end_at_cuts(library):
    model = merges.Merges(merges.merge_vocabulary(pieces.model_bytes()))
    for _, text in texts():
        text = " " + (text or "")
        parts = model.chunks(text, 100, 30)
        assert "".join(parts) == text
        assert sum(len(model.path(p.replace(" ", "▁"))[1]) for p in parts) == len(library.encode(text[1:]) if text[1:] else [model.pieces["▁"]])


def test_query_and_last_stage_encode_as_merges(spark, library):
    docs = cases.documents(spark, [(1, "The weather in London is nice today.")])
    assert [list(r["ids"]) for r in pieces.encoding_stage(spark, docs, "").collect()] == [library.encode("The weather in London is nice today.")]

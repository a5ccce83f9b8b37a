"""Encoding through the lattice of compatible neighbours, held against the library's own encoder."""

import random

import cases
import numpy as np
import pytest
from test_merges import texts

from clinigrid.llm import lattice, merges, pieces
from clinigrid.llm.registry import QUERIES


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())


@pytest.fixture(scope="module")
def known():
    return merges.merge_vocabulary(pieces.model_bytes())


@pytest.mark.parametrize("giant_chars,chunk_chars", [(1 << 16, 1 << 15), (300, 200), (20, 17)])
def test_ids_are_the_librarys(spark, library, giant_chars, chunk_chars):
    """Also where a text without any space is cut in the middle of its pieces."""
    small = [(i, t and t[:20_000]) for i, t in texts()]
    found = lattice.encode_lattice(cases.documents(spark, small), giant_chars=giant_chars, chunk_chars=chunk_chars).collect()
    assert len(found) == len(small)
    for row in found:
        assert list(row["ids"]) == library.encode(row["text"] or "")
        assert row["n_pieces"] == len(row["ids"])


def test_whole_documents_in_chunks(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = lattice.encode_lattice(docs, giant_chars=300, chunk_chars=200).select("text", "ids").collect()
    assert len(found) == docs.count()
    wrong = [r for r in found if list(r["ids"]) != library.encode(r["text"] or "")]
    assert wrong == []


def test_words_go_the_way_of_the_merges(known):
    model, plain = lattice.Lattice(known), merges.Merges(known)
    rng = random.Random(5)
    for _ in range(600):
        text = "".join(rng.choices("▁▁theingandoun😀éß", k=rng.randint(1, 60)))
        assert model.path(text) == plain.path(text)


def test_compatible_pieces_are_those_that_stay(known):
    model, plain = lattice.Lattice(known), merges.Merges(known)
    rng = random.Random(6)
    names = rng.sample(sorted(model.pieces), 400)
    for left, right in zip(names, names[1:]):
        assert model.compatible(left, right) == (plain.merged(left + right) == [left, right])


def test_products_are_associative_and_max_plus():
    rng = np.random.default_rng(2)
    stack = rng.random((23, 6, 6)) < 0.3
    scores = np.where(stack, 0.0, -np.inf)
    total, expected = scores[0], [scores[0]]
    for m in scores[1:]:
        total = np.max(total[:, :, None] + m[None, :, :], axis=1)
        expected.append(total)
    assert np.array_equal(lattice.prefix_products(stack), np.stack(expected) == 0)
    a, b, c = stack[:3]
    assert np.array_equal(lattice.product(lattice.product(a, b), c), lattice.product(a, lattice.product(b, c)))


@pytest.mark.parametrize("block", [1, 3, 256])
def test_states_lie_on_one_way(block):
    rng = np.random.default_rng(4)
    sizes = [1, *rng.integers(1, 7, 11), 1]
    matrices = [rng.random((a, b)) < 0.7 for a, b in zip(sizes, sizes[1:])]
    for m in matrices:
        m[0, 0] = True
    states = lattice.boundary_states(matrices, block)
    assert states[0][0] == states[-1][1] == 0
    assert all(m[a, b] for m, (a, b) in zip(matrices, states)) and all(x[1] == y[0] for x, y in zip(states, states[1:]))


def test_matrices_are_packed_whole():
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (3, 17), (121, 9)):
        m = rng.random(shape) < 0.5
        assert np.array_equal(lattice.unpacked(lattice.packed(m)), m)


def test_query_and_last_stage_come_through_the_lattice(spark, table, library, monkeypatch):
    asked, encode = [], lattice.encode_lattice

    def told(*args, **kwargs):
        asked.append(kwargs)
        return encode(*args, **kwargs)

    monkeypatch.setattr(lattice, "encode_lattice", told)
    docs = cases.documents(spark, [(1, "The weather in London is nice today.")], clashing=False)
    assert [list(r["ids"]) for r in pieces.encoding_stage(spark, docs, "").collect()] == [library.encode("The weather in London is nice today.")]
    assert QUERIES["op7_sentencepiece"](spark, table(documents=docs)).first()["round_trip"]
    assert len(asked) == 2


def test_a_model_that_changes_texts_is_refused():
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(pieces.model_bytes())
    model.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError, match="changes texts"):
        merges.merge_vocabulary(model.SerializeToString())


def test_a_run_beside_any_sign_is_encoded_once(known, library, monkeypatch):
    model, asked, path = lattice.Lattice(known), [], lattice.Lattice.path

    def told(self, text):
        asked.append(text)
        return path(self, text)

    monkeypatch.setattr(lattice.Lattice, "path", told)
    text = "a river river, river. river; river) river\n"
    assert np.frombuffer(model.encode([" " + text])[0], "<i4").tolist() == library.encode(text)
    assert sum("river" in t for t in asked) == 1


def test_runs_of_many_scripts_end_where_no_piece_crosses(known):
    model, plain = lattice.Lattice(known), merges.Merges(known)
    rng = random.Random(7)
    signs = ["the", "ing", "É", "²", ".", "..", "--", ",", "\n", "\t", "фи", "据数", "个", "ل", "😀", "[", "]", "^", "\\", "7", " ", "  ", "▁", "\0"]
    for _ in range(400):
        text = " " + "".join(rng.choices(signs, k=rng.randint(0, 40)))
        assert model.encode([text])[0] == plain.encode([text])[0]


def test_a_character_that_only_longer_pieces_hold(known):
    found, *rest = known
    fewer = ({p: v for p, v in found.items() if p not in ("e", "h", "▁")}, *rest)
    model, plain = lattice.Lattice(fewer), merges.Merges(fewer)
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choices("▁▁theingandoun😀éß", k=rng.randint(1, 40)))
        assert model.path(text) == plain.path(text)

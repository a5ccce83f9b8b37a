"""Near-duplicates, repeats, encoding, language, toxicity and the pipeline."""

import random

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clinigrid.llm import language, pieces, repeats, simhash, toxicity
from clinigrid.llm.registry import QUERIES


# --- near-duplicates --------------------------------------------------------------------

def test_words_one_bit_apart_share_a_codeword():
    tables = simhash.golay_tables()
    assert tables[1].shape == (2048, 6)
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000)
    near = simhash.near_codewords(words, tables)
    for bit in range(23):
        other = simhash.near_codewords(words ^ (1 << bit), tables)
        assert (near[:, :, None] == other[:, None, :]).any(axis=(1, 2)).all()


@pytest.mark.parametrize("small", [0, 2, 16])
def test_links_connect_what_is_near(spark, monkeypatch, small):
    """Also where all buckets count as crowded, so that fingerprints meet at hubs."""
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    rng = random.Random(small)
    values = [0, (1 << 64) - 1]
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 14)):
            values.append(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                x ^= 1 << b
    values = list(dict.fromkeys(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes)).collect()}
    expected = cases.linked(values, lambda a, b: (a ^ b).bit_count() <= 2)
    classes = {}
    for v, c in zip(signed, expected):
        classes.setdefault(c, set()).add(v)
    found = {}
    for v in signed:
        found.setdefault(roots.get(v, v), set()).add(v)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, classes.values()))


def test_near_duplicates(spark, table):
    words = [f"w{i}" for i in range(400)]
    near = [(20 + i, " ".join(words[:i] + ["other"] + words[i + 1:])) for i in range(0, 60, 10)]
    texts = cases.TEXTS + near + [(90, "THE RIVER"), (91, "the  river"), (92, "the")]
    folder = table(documents=cases.documents(spark, texts, clashing=False))
    rows = QUERIES["op5_simhash_near_duplicates"](spark, folder).collect()
    prints = [cases.fingerprint(t) for _, t in texts]
    assert sorted((str(r[0]), r[1]) for r in rows) == sorted((str(i), f"{p:016x}") for (i, _), p in zip(texts, prints))
    classes = cases.linked(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for (i, _), c in zip(texts, classes):
        if i is not None:
            first[c] = min(first.get(c, i), i)
    expected = sorted((str(i), first[c]) for (i, _), c in zip(texts, classes))
    assert sorted((str(r[0]), r[2]) for r in rows) == expected


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300) if i != 150], "a bigint, b bigint")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert roots == {i: 0 if i <= 150 else 151 for i in range(301)}


# --- repeats ----------------------------------------------------------------------------

def check_repeats(spark, texts):
    found = repeats.remove_repeats(cases.documents(spark, texts)).select(
        "doc.doc_id", "n_bytes", "spans", F.sha2("kept", 256))
    got = sorted((str(i), n, sum(e - s for s, e in spans), len(spans), h) for i, n, spans, h in found.collect())
    assert got == sorted((str(i), *r) for (i, _), r in zip(texts, cases.repeats(texts)))


def test_repeats_of_edge_cases(spark):
    check_repeats(spark, [(i, t and t[:9000]) for i, t in cases.TEXTS] + [(30, cases.USUAL * 3), (31, "é" * 90), (2, "é" * 70)])


def test_repeats_at_all_offsets(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 131)
    monkeypatch.setattr(repeats, "BUCKET_ENTRIES", 50)
    rng = random.Random(9)
    passages = ["".join(rng.choices("abcé", k=rng.choice([30, 49, 50, 51, 90, 400]))) for _ in range(8)]
    texts = []
    for i in range(40):
        parts = []
        for _ in range(4):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            parts += ["".join(rng.choices("abxyz", k=rng.randint(0, 60))), p[a:len(p) - rng.randint(0, 20)]]
        texts.append((rng.choice([i, i, 7]), "".join(parts)))
    check_repeats(spark, texts)


def test_repeats_of_runs_of_one_sign(spark):
    check_repeats(spark, [(1, "a" * 300), (2, "a" * 120), (3, "b" + "a" * 49), (4, "ab" * 100), (5, "ba" * 30), (6, "a" * 50)])


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(cases.nothing(spark)).count() == 0


# --- encoding ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return pieces.vocabulary(pieces.model_bytes())


def unigram_library():
    """The library's own unigram lattice over the same pieces, nothing put in front."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(pieces.model_bytes())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    model.normalizer_spec.add_dummy_prefix = False
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_words_score_as_the_library_lattice(vocabulary):
    lattice, library = pieces.Pieces(vocabulary), unigram_library()
    rng = random.Random(1)
    for _ in range(300):
        word = " " + "".join(rng.choices("theingandounsl", k=rng.randint(1, 14)))
        best = library.nbest_encode(word, nbest_size=2)[0]
        assert lattice.path(word.replace(" ", "▁"))[0] == sum(library.get_score(i) for i in best)


def test_pieces_left_out_change_nothing(vocabulary):
    useful, byte_ids, surface, unknown, cuts = vocabulary
    library = unigram_library()
    full = {library.id_to_piece(i): (library.get_score(i), i) for i in range(library.get_piece_size())
            if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
    assert 0 < len(useful) < len(full)
    whole, lattice = pieces.Pieces((full, byte_ids, surface, unknown, cuts)), pieces.Pieces(vocabulary)
    for text in cases.PROSE[:600].split() + ["naïve", "😀x", "▁▁▁two", "ß" * 9, "thethethe"]:
        assert whole.path("▁" + text) == lattice.path("▁" + text)


def test_round_trip_and_whole_text_lattice(spark, vocabulary):
    lattice = pieces.Pieces(vocabulary)
    texts = [(i, t and t[:3000]) for i, t in cases.TEXTS]
    found = pieces.decode(pieces.encode(cases.documents(spark, texts)))
    for row in found.collect():
        text = row["text"] or ""
        assert row["decoded"] == text.replace("▁", " ")
        assert row["n_pieces"] == len(row["ids"])
        assert row["ids"] == (lattice.path("▁" + text.replace(" ", "▁"))[1] if text else [])


def test_giant_texts_in_chunks_equal_whole_ones(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(pieces, "CHUNK_CHARS", 200)
    monkeypatch.setattr(pieces, "CUT_SEARCH", 60)
    rng = random.Random(8)
    solid = "".join(rng.choices(["the", "ing", "x", "é", "😀"], k=700))
    spaced = "".join(rng.choices(["river", " ", "  ", "\n", "of", "stone "], k=700))
    mixed = spaced[:900] + solid + spaced[900:]
    texts = [(1, solid), (2, spaced), (3, mixed), (4, "short"), (5, None), (6, " " * 900)]
    whole = {r["doc"]["doc_id"]: r["ids"] for r in pieces.encode(cases.documents(spark, texts)).collect()}
    cut = pieces.encode(cases.documents(spark, texts), giant_chars=300).collect()
    lattice = pieces.Pieces(vocabulary)

    def score(ids):
        scores = {i: s for s, i in lattice.pieces.values()}
        return sum(scores.get(i, 0.0) for i in ids)

    assert {r["doc"]["doc_id"] for r in cut} == set(whole)
    for row in pieces.decode(pieces.encode(cases.documents(spark, texts), giant_chars=300)).collect():
        i = row["doc"]["doc_id"]
        assert row["decoded"] == (row["text"] or "")
        assert score(row["ids"]) == score(whole[i]) and len(row["ids"]) == row["n_pieces"]


def test_prefix_products_are_associative():
    rng = np.random.default_rng(2)
    stack = rng.integers(-50, 0, (23, 4, 4)).astype(float)
    expected, total = [], stack[0]
    for k in range(23):
        total = stack[0] if k == 0 else pieces.product(total, stack[k])
        expected.append(total)
    for block in (1, 4, 512):
        assert np.array_equal(pieces.prefix_products(stack, block), np.stack(expected))


# --- language ---------------------------------------------------------------------------

LETTERS = {"aa": "abcde", "bb": "defgh", "cc": "αβγδε"}


def spoken(lang, rng):
    return " ".join("".join(rng.choices(LETTERS[lang], k=rng.randint(2, 7))) for _ in range(30))


def test_language_of_held_out_texts(spark, table):
    rng = random.Random(6)
    rows = [(i, lang, spoken(lang, rng)) for i, lang in enumerate(rng.choices(list(LETTERS), k=200))]
    odd = [(1000, "aa", None), (1001, "bb", "12 3 !"), (1002, None, spoken("aa", rng)), (None, "cc", spoken("cc", rng)),
           (1003, "aa", cases.LONG[:50_000])]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, lang string, text string")
    got = QUERIES["op9_language_id"](spark, table(documents=docs)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    held = [r for r in rows if by_id[r[0]]["held_out"]]
    assert len(held) > 20
    assert np.mean([by_id[i]["lang_pred"] == lang for i, lang, _ in held]) > 0.95
    assert by_id[1000]["lang_pred"] == by_id[1001]["lang_pred"] == "und" and by_id[1002]["lang_pred"] == "aa"


def test_labels_of_held_out_rows_are_not_learned(spark):
    rng = random.Random(6)
    rows = [(i, "aa", spoken("aa", rng)) for i in range(60)]
    held = language.held_out("doc_id")
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    lied = docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang")))
    learned = language.prototypes(lied.where(~held))
    assert set(learned) == {"aa"}
    assert language.identify(docs, {}).where("lang_pred <> 'und' or score <> 0").count() == 0


def test_blocks_of_long_texts_count_every_trigram(monkeypatch):
    text = "Abc dé 12 fgh " * 40
    whole = dict(zip(*(x.tolist() for x in language.Hypervectors().trigrams(text))))
    monkeypatch.setattr(language, "BLOCK_CHARS", 50)
    cut = dict(zip(*(x.tolist() for x in language.Hypervectors().trigrams(text))))
    assert set(whole) <= set(cut) and sum(cut.values()) <= sum(whole.values()) * 1.2


@pytest.mark.parametrize("block", [1, 2, 3, 50, 1000])
def test_a_cut_text_counts_exactly_as_a_whole_one(monkeypatch, block):
    rng = random.Random(block)
    texts = ["", " ", "a", "ΑΣ ΣΑΣ", "İstanbul", *(
        "".join(rng.choices("aB é1 \n😀Σß,", k=rng.randint(1, 300))) for _ in range(40))]
    whole = [language.Hypervectors().trigrams(t) for t in texts]
    monkeypatch.setattr(language, "BLOCK_CHARS", block)
    for text, (keys, counts) in zip(texts, whole):
        found = language.Hypervectors().trigrams(text)
        assert dict(zip(*(x.tolist() for x in found))) == dict(zip(keys.tolist(), counts.tolist()))


def test_three_million_characters_count_as_a_whole():
    text = ("Die Katze läuft, und 3 Vögel singen. " * 85_000)[:3_000_000]
    keys, counts = language.Hypervectors().trigrams(text)
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    from collections import Counter

    times = Counter(words)
    plain = Counter()
    for word, n in times.items():
        padded = f" {word} "
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            plain[(ord(a) << 42) | (ord(b) << 21) | ord(c)] += n
    assert dict(zip(keys.tolist(), counts.tolist())) == dict(plain)


def test_language_query_equals_a_plain_version(spark, table):
    """The whole query in plain Python: dictionaries of trigrams, sums and cosines."""
    import zlib

    rng = random.Random(9)
    rows = [(i, rng.choice(list(LETTERS)), None) for i in range(60)]
    rows = [(i, lang, spoken(lang, rng)) for i, lang, _ in rows] + [(90, "aa", None), (91, "bb", "12 !")]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    got = {r["doc_id"]: r for r in QUERIES["op9_language_id"](spark, table(documents=docs)).collect()}

    def letter(code):
        signs = np.random.default_rng([language.SEED, code]).integers(0, 2, language.DIMENSIONS, dtype=np.int8)
        return [2 * int(s) - 1 for s in signs]

    def vector(text):
        total, n = np.zeros(language.DIMENSIONS), 0
        for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            padded = f" {word} "
            for a, b, c in zip(padded, padded[1:], padded[2:]):
                total += np.roll(letter(ord(a)), 2) * np.roll(letter(ord(b)), 1) * np.array(letter(ord(c)))
                n += 1
        return total, n

    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    vectors = {i: vector(t) for i, _, t in rows}
    sums = {}
    for i, lang, _ in rows:
        if not held[i] and vectors[i][1]:
            sums[lang] = sums.get(lang, 0) + vectors[i][0] / vectors[i][1]
    unit = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    middle = np.mean(list(unit.values()), axis=0)
    learned = {k: (v - middle) / np.linalg.norm(v - middle) for k, v in sorted(unit.items())}
    for i, *_ in rows:
        v, n = vectors[i]
        assert got[i]["held_out"] == held[i]
        if not n:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        cosines = {k: p @ v / np.linalg.norm(v) for k, p in learned.items()}
        best = max(cosines, key=cosines.get)
        assert got[i]["lang_pred"] == best
        assert got[i]["score"] == pytest.approx((1 + cosines[best]) / 2, abs=1e-5)


# --- toxicity ---------------------------------------------------------------------------

def test_folding():
    assert toxicity.fold("1D10T m0r0n tra5h! іdіоt $tupid 2024 moron$$$") == "idiot moron trash! idiot stupid 2024 moron$$$"


def test_signs_of_any_number_are_folded():
    assert toxicity.fold("l053r 2024 100 l00000ser id10t!! 5500") == "loser 2024 100 loooooser idiot!! 5500"


def test_a_rare_toxic_word_is_learned(spark, table):
    """It stands in one of two hundred toxic texts only."""
    rng = random.Random(8)
    usual = "river stone light house winter garden letter".split()
    rows, labels = [], []
    for i in range(14_000):
        toxic = int(i % 5 == 0)
        words = rng.choices(usual, k=12)
        if toxic:
            words[3] = "zquumbo" if i % 1000 == 0 else rng.choice(["trash", "vequmo"])
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    training = toxicity.training_rows(
        spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"), 20_000
    )
    found = toxicity.lexicon(training)
    assert {"zquumbo", "trash", "vequmo"} <= set(found) and not set(usual) & set(found)
    with pytest.raises(ValueError, match="lexicon"):
        toxicity.lexicon(training, max_bytes=10)


def toxic_tables(spark, table):
    rng = random.Random(3)
    usual = "river stone light house winter garden letter".split()
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(usual, k=40)
        toxic = int(i % 5 == 0)
        if toxic:
            words[rng.randint(0, 39)] = rng.choice(["trash", "vequmo", "vequla", "vequre", "vequti"])
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    rows += [(500, None), (501, ""), (502, "the tra5h of a VEQUXX"), (503, "a trash can in the garden " * 3), (None, "trash")]
    labels += [(None, 1), (3, None), (9999, 1)]
    return table(
        documents=spark.createDataFrame(rows, "doc_id bigint, text string"),
        labels=spark.createDataFrame(labels, "doc_id bigint, toxic int"),
    )


def test_toxicity(spark, table):
    folder = toxic_tables(spark, table)
    got = {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, folder).collect()}
    assert len(got) == 405 and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["predicted"] for i in range(400)] == [int(i % 5 == 0) for i in range(400)]
    assert (got[500]["predicted"], got[501]["predicted"], got[502]["predicted"], got[503]["predicted"]) == (0, 0, 1, 0)


def test_training_rows_are_the_first_by_hash(spark):
    labels = spark.range(3000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    docs = spark.range(3000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    got = {int(r["text"]) for r in toxicity.training_rows(docs, labels, 40).collect()}
    usable = labels.where(~language.held_out("doc_id"))
    assert got == {r["doc_id"] for r in usable.orderBy(F.xxhash64("doc_id")).limit(40).collect()}


def test_toxicity_without_labels(spark, table):
    docs = cases.documents(spark, clashing=False)
    folder = table(documents=docs, labels=spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert QUERIES["op10_toxicity"](spark, folder).where("score > 0.01 or predicted = 1").count() == 0


def test_matches_equal_a_plain_search():
    weights = {"trash": 2.0, "vequ*": 3.0, "trashy": 1.0}
    automaton = toxicity.matcher(weights, ("trash can",))
    for text, expected in (
        ("trash trashy xtrash trash", (5.0, 3)), ("vequ vequla avequ", (6.0, 2)), ("trash can trash", (2.0, 1)), ("", (0.0, 0)),
    ):
        assert toxicity.matches(automaton, text) == expected


# --- pipeline ---------------------------------------------------------------------------

@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_and_survive(spark, table, name, stage):
    items = spark.createDataFrame([(1, cases.PROSE[:200])], "item_id bigint, text string")
    folder = table(benchmark=items)
    for docs in (cases.documents(spark), cases.nothing(spark)):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        kept = out.collect()
        assert len(kept) <= len(cases.TEXTS)
        assert all(r["fp"] == "own fp" and r["row"] == "own row" for r in kept)


def test_last_stage_survives(spark):
    for docs in (cases.documents(spark), cases.nothing(spark)):
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_one_of_each_class_stays(spark):
    copies = [(7, cases.USUAL), (3, cases.USUAL), (3, cases.USUAL), (None, cases.USUAL), (1, "something else entirely here")]
    kept = simhash.near_duplicate_stage(spark, cases.documents(spark, copies), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3]


def test_pipeline_equals_brute_force(spark):
    """Over the small tables: what each stage decides, from plain Python on its own input."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    stages = [f for _, f in corpus_pipeline.STAGES]

    first = stages[0](spark, docs, folder)
    base = {r["doc_id"] for r in docs.collect() if not cases.quality(r["text"])[5]}
    one = {r["doc_id"]: r["text"] for r in first.collect()}
    assert set(one) <= base and len(one) > 0.7 * len(base)

    ids = sorted(one)
    prints = [cases.fingerprint(one[i]) for i in ids]
    classes = cases.linked(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    two = {ids[c]: one[ids[c]] for c in classes}

    three = {}
    for i, text in two.items():
        if not cases.contamination(text, items)[4]:
            three[i] = text
    final = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(final) == set(three)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())
    plain = [i for i in three if not cases.secrets(three[i]) and not cases.contamination(three[i], items)[1]]
    assert len(plain) > 20
    for i in plain:
        assert list(final[i]["ids"]) == library.encode(three[i])
    for i in set(three) - set(plain):
        text = library.decode(list(final[i]["ids"]))
        assert not cases.secrets(text) and not cases.contamination(text, items)[1]


# --- all queries ------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_over_empty_and_missing(spark, table, name):
    items = spark.createDataFrame([], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    talk = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    empty = table(documents=cases.nothing(spark), benchmark=items, labels=labels, conversations=talk)
    assert QUERIES[name](spark, empty).count() == 0
    if name in ("op11_spelling_variants", "op12_conversation_trie"):
        return  # These return words and nodes; missing values are in their own tests.
    missing = spark.createDataFrame([(None, None, None)] * 3, "doc_id bigint, text string, lang string")
    found = QUERIES[name](spark, table(documents=missing, benchmark=items, labels=labels))
    assert found.count() == 3

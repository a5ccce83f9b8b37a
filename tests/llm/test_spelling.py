"""Spelling variants against a plain version that compares all pairs."""

import random
import re
import zlib
from collections import Counter

import cases
import pytest

from clinigrid.llm import spelling
from clinigrid.llm.registry import QUERIES


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(texts):
    """Rows of the query by word."""
    n = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    out = {}
    for word in n:
        near = [w for w in n if one_edit(word, w)]
        best = min(near, key=lambda w: (-n[w], w), default=None)
        form = best if best is not None and n[best] >= 2 * n[word] else None
        out[word] = [form, word, n[word], len(near), n[form] if form else None]
    for word, found in out.items():
        while out[found[1]][0]:
            found[1] = out[found[1]][0]
    return {w: tuple(v) for w, v in out.items()}


def check(spark, table, texts):
    got = QUERIES["op11_spelling_variants"](spark, table(documents=cases.documents(spark, texts))).collect()
    assert [tuple(r)[0] for r in got] and len(got) == len({r["word"] for r in got})
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == plain_variants(texts)


@pytest.mark.parametrize("seed", range(3))
def test_scans_find_all_pairs_of_a_list(seed):
    rng = random.Random(seed)
    for _ in range(400):
        short = rng.randint(0, 5)
        differ = rng.randint(0, short)
        rests = sorted({"".join(rng.choices("abé", k=short + rng.randint(0, 1))) for _ in range(rng.randint(1, 30))})
        expected = [
            (i, j) for j in range(len(rests)) for i in range(j)
            if one_edit(rests[i], rests[j]) and min(len(rests[i]), len(rests[j])) == short
            and not (differ and rests[i][:differ] == rests[j][:differ])
        ]
        assert sorted(spelling.near_pairs(rests, short, differ)) == sorted(expected)


def words_of(rng, letters, n, longest):
    return ["".join(rng.choices(letters, k=rng.randint(4, longest))) for _ in range(n)]


def test_variants(spark, table):
    rng = random.Random(5)
    words = words_of(rng, "abÀé", 300, 7) + ["kitten", "mitten", "sitten", "sittin", "sitting", "ß×÷ÿñ", "Ångström"]
    texts = [(i, " ".join(rng.choices(words, k=150)) + ", Kitten! 12 kitten_kitten" * (i % 3)) for i in range(60)]
    texts += [*cases.TEXTS[:7], (7, "naïve 😀 Ünïcode"), (None, " ".join(words)), (None, " ".join(words)), (3, "kitten " * 50)]
    check(spark, table, texts)


def test_long_lists_are_parted(spark, table, monkeypatch):
    """A third of all words begin alike, and lists may hold three words only."""
    monkeypatch.setattr(spelling, "LIST_WORDS", 3)
    rng = random.Random(6)
    words = [f"common{w}" for w in words_of(rng, "abc", 60, 9)] + [f"{w}ending" for w in words_of(rng, "abc", 60, 9)]
    words += words_of(rng, "ab", 60, 12) + ["a" * 400, "a" * 401, "a" * 200 + "b" + "a" * 199]
    texts = [(i, " ".join(words)) for i in range(4)]
    seen = []
    lists = spelling.lists

    def short(listed, list_words):
        seen.append(listed)
        return lists(listed, 3)

    monkeypatch.setattr(spelling, "lists", short)
    check(spark, table, texts)
    assert seen
    listed = lists(seen[0], 3)
    members = Counter(r["key"] for r in listed.where("short > 1").select("key").collect())
    assert members and max(members.values()) <= 3


def test_no_words(spark, table):
    for docs in (cases.nothing(spark), cases.documents(spark, [(1, None), (2, ""), (None, "four 1234"), (3, "words words")])):
        assert QUERIES["op11_spelling_variants"](spark, table(documents=docs)).count() == 0

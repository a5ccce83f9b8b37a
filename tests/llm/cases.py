"""Documents with everything that may go wrong, and brute-force versions of the contracts."""

import hashlib
import random
import re

from pyspark.sql import functions as F

LONG = "".join(random.Random(4).choice("abcdefgh") for _ in range(150_000))
PROSE = " ".join(random.Random(5).choices("the of and to in a is that river stone light house ran".split(), k=30_000))
USUAL = (
    "The river ran to the house in the light of a stone, and that is it.\nA house of stone is in the light "
    "that the river ran to, and the stone is of the house. It was for the river with a light, and the house "
    "ran in the stone and of the light that is to the river and the stone house is a light of it all."
)
TEXTS = [
    (1, None), (2, ""), (3, USUAL), (3, USUAL), (4, USUAL + " One more."), (None, USUAL), (5, LONG), (6, PROSE),
    (7, "naïve 😀 Ünïcode\n\n  two  spaces ▁ and tail "), (8, " \t\n"), (9, "x"), (10, "\n"), (-5, USUAL.upper()),
]


def documents(spark, texts=TEXTS, clashing=True):
    rows = [(i, t, "en" if i is None or i % 2 else None, "src", None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    if clashing:
        names = ("doc", "row", "fp", "spans", "kept", "n_words", "key", "ids", "kind", "secrets", "root", "w", "score")
        df = df.withColumns({n: F.lit(f"own {n}") for n in names})
    return df


def nothing(spark):
    return documents(spark).limit(0)


def sha(strings):
    return hashlib.sha256(",".join(strings).encode()).hexdigest()


def described(spans):
    return [f"{k}:{s}:{e}" for k, s, e in spans]


def quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts = {}
    for g in grams:
        counts[g] = counts.get(g, 0) + 1
    hit = {i + j for i, g in enumerate(grams) if counts[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
        len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words),
    )


def repeats(rows, width=50):
    """(n_bytes, n_removed, n_spans, sha256 of what stays) per row."""
    texts = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        for p in range(len(t) - width + 1):
            w = t[p:p + width]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            if first[t[p:p + width]] < i:
                gone[p:p + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def contamination(text, items, window=13):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def words(t):
        return re.findall(pattern, re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    mine, hit, named = words(text), set(), set()
    for item, t in items:
        theirs = words(t)
        k = min(window, len(theirs))
        wanted = {tuple(theirs[i:i + k]) for i in range(len(theirs) - k + 1)} if k else set()
        for i in range(len(mine) - k + 1 if k else 0):
            if tuple(mine[i:i + k]) in wanted:
                hit.update(range(i, i + k))
                named.add(str(item))
    return len(mine), len(hit), len(named), sha(sorted(named)), bool(hit) and 20 * len(hit) >= len(mine)


def personal_data(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        total = sum(sum(divmod(int(d) * (1 + n % 2), 10)) for n, d in enumerate(digits[::-1]))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def secrets(text):
    text, out = text or "", []
    names = "|".join(re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", n) for n in (
        "password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"({names})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, "access", m.end()))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            out.append((m.start(), 2, "hex", m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else (
        [b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, near):
    """Class of every position: the positions reachable through ``near`` pairs, as their least."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]

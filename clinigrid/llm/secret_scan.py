"""Secret scans: patterns, and novelty measured with dictionary-primed zstandard.

Strings near sensitive words that no pattern covers are judged by how many bytes they add
to the compressed surroundings, with a dictionary of common identifiers: words, paths and
names that stand nearby compress away, random keys do not.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinigrid.llm.common import append, code_points, documents, pack, raw, sha256_of_list, ship, with_text

# The base patterns, in the order of their kinds.
ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "novel")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
# Sensitive context: a candidate stands in a line with one of these words, or in a line beside it.
CONTEXT = re.compile(
    rb"(?<![a-z])(?:api|key|secret|token|passphrase|passwd|password|pwd|auth|credential|private|bearer|signature|salt)"
)
CONTEXT_WORDS = (
    b"api", b"key", b"secret", b"token", b"pass", b"pwd", b"auth", b"credential", b"private", b"bearer",
    b"signature", b"salt",
)
MIN_CANDIDATE = 16
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=.-]{%d,}" % MIN_CANDIDATE)
LETTER = re.compile(rb"[A-Za-z]")
# Surroundings that prime the compressor, before and after the candidate.
BEFORE_BYTES, AFTER_BYTES = 512, 256
# Marginal compressed bytes per byte from which a candidate is incompressible.
MIN_NOVELTY = 0.75
# Common identifiers and words of code and configuration.
IDENTIFIERS = (
    "abstract access account address admin api_key apikey application args array assert async auth "
    "authorization await aws_access_key_id aws_secret_access_key base64 bearer boolean bucket byte cache "
    "callback certificate char class client client_id client_secret commit config configuration connection "
    "const constructor content context cookie credentials database debug default define delete description "
    "development directory document double download element email encoding endpoint environment error event "
    "example exception export extends false file filename final float format from function github global "
    "google handler hash header headers hostname http https identifier import include index init instance "
    "integer interface internal json key kubernetes lambda language length library license localhost login "
    "manifest message metadata method model module namespace network null number object options output "
    "package parameter params passphrase password path pattern permission placeholder port postgres private "
    "private_key production project property protected protocol public query queue read record refresh_token "
    "register release remote repository request require resource response result return role root schema "
    "scope script secret secret_key security select self sequence server service session settings signature "
    "source static status storage stream string struct template test timeout timestamp token true type "
    "undefined update upload url user username utf-8 value variable version void while window worker write"
)


def base_spans(text: bytes, low: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the patterns, in bytes."""
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= MIN_ACCESS]
    if LONG_HEX in text.translate(HEX_MAP):
        found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)
                  if m.end() - m.start() >= MIN_HEX]
    return found


HEX_MAP = bytes(49 if b in b"0123456789abcdef" else 48 for b in range(256))
LONG_HEX = b"1" * MIN_HEX


def contexts(low: bytes) -> list[tuple[int, int]]:
    """Disjoint stretches of whole lines: every line with a sensitive word, and the lines beside it."""
    found: list[tuple[int, int]] = []
    seen = -1
    for word in CONTEXT.finditer(low):
        if word.start() < seen:
            continue
        first = low.rfind(b"\n", 0, word.start())
        first = low.rfind(b"\n", 0, max(first, 0)) + 1
        seen = low.find(b"\n", word.end()) % (len(low) + 1)
        last = low.find(b"\n", seen + 1) % (len(low) + 1)
        if found and first <= found[-1][1]:
            first = found.pop()[0]
        found.append((first, last))
    return found


def candidates(text: bytes, low: bytes, taken: list) -> list[tuple[int, int]]:
    """Unpatterned strings with a letter in the lines around sensitive words; hosts of addresses are none."""
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    covered = sorted((s, e) for s, _, e, _ in taken)
    found, k, reach = [], 0, 0
    for first, last in contexts(low):
        for m in CANDIDATE.finditer(text, first, last):
            start, end = m.span()
            while k < len(covered) and covered[k][0] < end:
                reach = max(reach, covered[k][1])
                k += 1
            address = text[start - 1:start] == b"@"
            if start >= reach and not address and LETTER.search(text, start, end):
                found.append((start, end))
    return found


class Novelty:
    """Marginal compressed size of a string among its surroundings."""

    def __init__(self, identifiers: str, level: int = 3):
        import zstandard

        held = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(
            level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
        )

    def per_byte(self, text: bytes, start: int, end: int) -> float:
        before, after = text[max(0, start - BEFORE_BYTES):start], text[end:end + AFTER_BYTES]
        around = before + after
        added = len(self.compressor.compress(around + text[start:end])) - len(self.compressor.compress(around))
        return added / (end - start)


def secret_spans(text: bytes, novelty: Novelty, min_novelty: float) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) by start, then kind, in code points."""
    low = text.lower()
    found = base_spans(text, low)
    found += [(s, 3, e, s) for s, e in candidates(text, low, found) if novelty.per_byte(text, s, e) >= min_novelty]
    if not found:
        return []
    found.sort()
    offsets = sorted({x for s, _, e, v in found for x in (s, e, v)})
    at = dict(zip(offsets, code_points(text, offsets)))
    return [(KINDS[k], at[s], at[e], at[v]) for s, k, e, v in found]


def redact(text: bytes, spans: list[tuple[str, int, int, int]], mark: str) -> str:
    """The text with every value replaced by ``mark``; overlapping values by one."""
    whole, out, at = text.decode(), [], 0
    for start, end in sorted((v, e) for _, _, e, v in spans):
        if start >= at:
            out += [whole[at:start], mark]
        at = max(at, end)
    return "".join([*out, whole[at:]])


def scan_secrets(
    docs: DataFrame, carry=None, min_novelty: float = MIN_NOVELTY, identifiers: str = IDENTIFIERS,
    mark: str = "[SECRET]",
) -> DataFrame:
    """``doc`` and ``text`` of every document with ``secrets`` and ``redacted``, its text without them.

    Secrets are (kind, start, end, value): offsets in code points, end exclusive, ``value``
    where the secret itself starts. Kinds ``assign``, ``access`` and ``hex`` come from the
    patterns, ``novel`` from the compressor. A missing text has no secrets; every row is
    scanned by itself, so repeated rows, ties and empty tables need no rule.
    """
    def start():
        novelty = Novelty(identifiers)

        def step(batch):
            texts = raw(batch)
            spans = [secret_spans(t, novelty, min_novelty) for t in texts]
            return spans, [redact(t, s, mark) if s else None for t, s in zip(texts, spans)]

        return step

    kind = "array<struct<kind:string,start:int,end:int,value:int>>"
    found = append(pack(docs, carry), start, f"secrets {kind}, changed string")
    return found.withColumn("redacted", F.coalesce("changed", "text")).drop("changed")


def described(spans) -> Column:
    """Spans as strings kind:start:end."""
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))


def secret_scan_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return with_text(scan_secrets(docs), "redacted")


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir, "doc_id", "text"), carry=["doc_id"])
    base = F.filter("secrets", lambda s: s["kind"] != "novel")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc.doc_id", *[count(k) for k in KINDS[:3]],
        sha256_of_list(described(base)).alias("base_sha256"),
        F.array_join(described(F.col("secrets")), ",").alias("spans"),
    )


ship(__name__)

"""Personal data by bootstrapped contextual extraction.

Patterns find seed entities. The words around seeds are lexical patterns; Spark scores the
graph of lexical patterns and instances in rounds: a pattern is trusted as far as its
instances are, an instance as far as its patterns are. Identifiers that no base pattern
covers are added where trusted patterns surround them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinigrid.llm.common import append, code_points, documents, pack, raw, sha256_of_list, ship, small_batches
from clinigrid.operators.joins import skew_safe_join
from clinigrid.session import materialise

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Email is matched from its sign, which gives the same
# matches in linear time; a look behind keeps the others from trying inside a run.
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(rb"[0-9]")
NOT_DIGITS = bytes(b for b in range(256) if not 48 <= b <= 57)
# Strings that may be identifiers: groups of digits, or anything with a digit or an at sign.
CANDIDATE = re.compile(rb"\(?[0-9][0-9().\x20-]{5,40}[0-9]|[^\s\"'<>,;]*[0-9@][^\s\"'<>,;]*")
MIN_CANDIDATE = 6
CONTEXT_BYTES = 96
WORD_BYTES = 32
# A lexical pattern needs so many different seeds of one kind.
MIN_SEEDS = 5
ROUNDS = 3
PRIOR = 2.0
MIN_SCORE = 0.8


def luhn(digits: bytes) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        d -= 48
        if n % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start, in bytes."""
    found = []
    at, free = text.find(b"@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            free = m.end()
        at = text.find(b"@", max(at + 1, free))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m.group().split(b".")):
                found.append((1, *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().translate(None, NOT_DIGITS)
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, *m.span()))
        for m in PHONE.finditer(text) if b"+" in text else ():
            if 9 <= len(m.group().translate(None, NOT_DIGITS)) <= 15:
                found.append((3, *m.span()))
    return found


def plausible(value: bytes) -> int:
    """Bits of the kinds whose broad shape a string has; 0 for none."""
    digits = len(value.translate(None, NOT_DIGITS))
    email = b"@" in value.strip(b"@")
    ip = digits >= 4 and value.count(b".") + value.count(b":") >= 3
    return email | ip << 1 | (12 <= digits <= 19) << 2 | (7 <= digits <= 15) << 3


def patterns(text: bytes, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: two words before, and one on either side."""
    before = text[max(0, start - CONTEXT_BYTES):start].lower().split()[-2:]
    after = text[end:end + CONTEXT_BYTES].lower().split()[:1]
    left = [w[-WORD_BYTES:].decode(errors="replace") for w in before]
    right = [w[:WORD_BYTES].decode(errors="replace") for w in after]
    out = []
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    return out


def candidates(text: bytes, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kinds) of strings that look like identifiers outside the base spans."""
    if not DIGIT.search(text) and b"@" not in text:
        return []
    found = []
    for token in TOKEN.finditer(text):
        m = CANDIDATE.match(text, token.start())
        if m is None or m.end() - m.start() < MIN_CANDIDATE:
            continue
        kinds = plausible(m.group())
        if kinds and not any(s < m.end() and m.start() < e for _, s, e in taken):
            if not found or found[-1][1] <= m.start():
                found.append((m.start(), m.end(), kinds))
    return found


# Where a candidate may start: at a word with a digit or an at sign among its first bytes.
TOKEN = re.compile(rb"(?<![^\s\"'<>,;])[^\s\"'<>,;0-9@]{0,64}[0-9@]")


def with_spans(packed: DataFrame) -> DataFrame:
    """Add ``base`` spans, ``seeds`` and ``maybe``, the candidates, with their patterns."""
    def start():
        from xxhash import xxh64_intdigest

        def value(text):
            x = xxh64_intdigest(text.lower())
            return x - (1 << 64) if x >> 63 else x

        def step(batch):
            base, seeds, maybe = [], [], []
            for text in raw(batch):
                spans = base_spans(text)
                extra = candidates(text, spans)
                offsets = sorted({x for _, s, e in spans for x in (s, e)} | {x for s, e, _ in extra for x in (s, e)})
                at = dict(zip(offsets, code_points(text, offsets))) if offsets else {}
                base.append([(KINDS[k], at[s], at[e]) for k, s, e in spans])
                seeds.append([(k, value(text[s:e]), patterns(text, s, e)) for k, s, e in spans])
                maybe.append([(at[s], at[e], kinds, value(text[s:e]), patterns(text, s, e)) for s, e, kinds in extra])
            return base, seeds, maybe

        return step

    return append(packed, start, (
        "base array<struct<kind:string,start:int,end:int>>, "
        "seeds array<struct<kind:int,value:bigint,patterns:array<string>>>, "
        "maybe array<struct<start:int,end:int,kinds:int,value:bigint,patterns:array<string>>>"
    ))


def induced_patterns(found: DataFrame) -> DataFrame:
    """(pattern, kind, n_seeds, n_all): lexical patterns with enough different seeds of a kind."""
    seeds = found.select(F.explode("seeds").alias("s")).select("s.*").select(
        "kind", "value", F.explode("patterns").alias("pattern")
    ).distinct()
    counted = seeds.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n_seeds"))
    totals = counted.groupBy("pattern").agg(F.sum("n_seeds").alias("n_all"))
    return counted.where(F.col("n_seeds") >= MIN_SEEDS).join(totals, "pattern")


def score_instances(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind, score) of candidates, by alternating trust between patterns and instances."""
    induced = materialise(induced_patterns(found), "patterns")
    maybe = found.select(F.explode("maybe").alias("m")).select("m.*").select(
        "value", "kinds", F.explode("patterns").alias("pattern")
    ).distinct()
    edges = materialise(
        skew_safe_join(maybe, induced, ["pattern"], salt_on=["value"])
        .where("(kinds >> kind) & 1 = 1").select("pattern", "kind", "n_seeds", "n_all", "value"), "edges",
    )
    scores = edges.select("value", "kind").distinct().withColumn("score", F.lit(0.0))
    for _ in range(rounds):
        trust = edges.join(scores, ["value", "kind"]).groupBy("pattern", "kind").agg(
            ((F.first("n_seeds") + F.sum("score")) / (F.first("n_all") + F.count(F.lit(1)) + PRIOR)).alias("trust")
        )
        doubt = F.sum(F.log1p(-F.least(F.col("trust"), F.lit(0.999))))
        scores = materialise(
            skew_safe_join(edges.select("pattern", "kind", "value"), trust, ["pattern", "kind"], salt_on=["value"])
            .groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("score")), "scores",
        )
    return scores


def find_personal_data(docs: DataFrame, carry=None, min_score: float = MIN_SCORE) -> DataFrame:
    """``doc`` with ``base`` and ``added`` spans (kind, start, end; code points, end exclusive).

    ``base`` are the patterns' matches in order of kind and start; ``added`` are
    identifiers found by context, each with its best kind. A missing text counts as empty.
    Repeated rows are found alike and count once as evidence; an empty table, or one with
    few seeds, gives no added spans. Texts are read once.
    """
    with small_batches(docs.sparkSession):
        found = materialise(
            with_spans(pack(docs, carry)).drop("text").withColumn("row", F.monotonically_increasing_id()), "found"
        )
    best = score_instances(found).where(F.col("score") >= min_score).groupBy("value").agg(
        F.max(F.struct("score", (-F.col("kind")).alias("k")))["k"].alias("k")
    ).select("value", (-F.col("k")).cast("int").alias("kind"))
    spots = found.select("row", F.explode("maybe").alias("m")).select("row", "m.value", "m.start", "m.end")
    # One value may stand in many documents, each document has a bounded list of its own.
    named = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    added = skew_safe_join(spots, best, ["value"], salt_on=["row"]).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("kind", "start", "end", named.alias("name")))).alias("spans")
    )
    listed = F.transform("spans", lambda s: F.struct(s["name"].alias("kind"), s["start"], s["end"]))
    return found.join(materialise(added, "added"), "row", "left").select(
        "doc", "base",
        F.when(F.col("spans").isNotNull(), listed).otherwise(
            F.array().cast("array<struct<kind:string,start:int,end:int>>")
        ).alias("added"),
    )


def ordered(spans: Column) -> Column:
    """Spans as strings kind:start:end, by kind as listed, then start."""
    rank = F.create_map(*[x for n, k in enumerate(KINDS) for x in (F.lit(k), F.lit(n))])
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(
        rank[s["kind"]].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")
    )))
    return F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))


def op3_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(documents(spark, sf_dir, "doc_id", "text"), carry=["doc_id"])

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc.doc_id", *[count(k) for k in KINDS],
        sha256_of_list(ordered(F.col("base"))).alias("base_sha256"),
        F.array_join(ordered(F.concat("base", "added")), ",").alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
    )


ship(__name__)

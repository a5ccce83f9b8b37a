"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and of its language's common words is
compared with the language's histogram over all documents by Jensen-Shannon distance.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinigrid.llm.common import documents, rows_of
from clinigrid.session import materialise

BREAK = r"[\x20\x09-\x0D]"
# Character classes, taken away in turn; what is left is the last class, of symbols.
CLASSES = {
    "lower": "[a-z]+", "space": BREAK + "+", "upper": "[A-Z]+", "beyond_ascii": "[^\\x00-\\x7F]+",
    "digit": "[0-9]+", "sentence": "[.,;:?'\"()-]+",
}
SYMBOLS = r"[#*$%&|<>]+"
# A digit with so many letters and digits behind it is an identifier and weighs as one digit in the classes:
# whole, a single key or digest would outweigh the prose of a short text.
IDENTIFIER = "[0-9][0-9A-Za-z]{23,}"
# Frequent words by language.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "was"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ist"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"),
}
MIN_WORDS = 50
# Up to so many different repeated grams are looked up; more are found by a sort.
FEW_REPEATS = 32
MAX_REPEATED_PERCENT = 50
# Jensen-Shannon distances (0 to 1) above which a document is rejected.
TYPICAL_DISTANCE = 0.25
MAX_CLASS_DISTANCE = 0.2
MAX_WORD_DISTANCE = 0.35


def features(
    docs: DataFrame, carry: Sequence[str] | None = None,
    common_words: Mapping[str, Sequence[str]] = COMMON_WORDS,
) -> DataFrame:
    """``doc`` (the carried columns) with counts and histograms of the whole text.

    A missing text counts as empty; a missing language, or table without ``lang``, as
    ``und``, which like any language without a word list has one bin of words. The
    counts are of the text itself; in its classes an identifier is one digit.
    """
    lang = F.coalesce(docs["lang"].cast("string"), F.lit("und")) if "lang" in docs.columns else F.lit("und")
    kept = docs.columns if carry is None else list(carry)
    packed = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in kept]).alias("doc"), lang.alias("lang"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    words = packed.select(
        "doc", "lang", "text", lines.alias("lines"),
        F.filter(F.split("text", BREAK + "+"), lambda w: w != "").alias("w"),
    )
    # Each class is what the text loses with it, so later classes search a short rest.
    rest, left = words.withColumn("shown", F.regexp_replace("text", IDENTIFIER, "0")), F.col("shown")
    for name, pattern in CLASSES.items():
        rest = rest.withColumn(f"after_{name}", F.regexp_replace(left, pattern, ""))
        left = F.col(f"after_{name}")
    lengths = [F.length("shown"), *[F.length(f"after_{n}") for n in CLASSES]]
    classes = {n: lengths[i] - lengths[i + 1] for i, n in enumerate(CLASSES)}
    counted = rest.select(
        "doc", "lang", "w", F.size("w").cast("long").alias("n_words"),
        (F.length("text") - classes["space"]).cast("long").alias("word_chars"),
        (F.length(left) - F.length(F.regexp_replace(left, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.array(*[c.cast("double") for c in classes.values()], F.length(left).cast("double")).alias("class_counts"),
        F.when(F.size("w") >= 3, F.transform(
            F.sequence(F.lit(0), F.size("w") - 3),
            lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)),
        )).otherwise(F.array().cast("array<bigint>")).alias("grams"),
    )
    repeated = with_repeats(counted).drop("grams")
    binned = with_word_counts(repeated, common_words)
    return binned.select(
        "doc", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered("hits", 3), F.lit(0)).cast("long").alias("n_repeat_words"),
        "class_counts", "word_counts",
    )


def with_repeats(df: DataFrame) -> DataFrame:
    """Add ``hits``: the ascending positions of the ``grams`` that occur twice or more, or NULL.

    Most texts repeat nothing and stop after a distinct; a few repeated values are looked
    up directly, and only texts with many sort all their grams with positions.
    """
    sorted_once = df.withColumn("s", F.when(
        F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array("grams")
    ))
    valued = sorted_once.withColumn("twice", F.array_distinct(
        F.filter("s", lambda g, i: F.coalesce(g == F.get("s", i + 1), F.lit(False)))
    )).drop("s")
    few = F.size("twice") <= FEW_REPEATS
    paired = valued.withColumn("pairs", F.when(~few, F.sort_array(
        F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    )))
    found = F.when(few, F.filter(
        F.sequence(F.lit(0), F.size("grams") - 1), lambda i: F.array_contains("twice", F.get("grams", i))
    )).otherwise(F.sort_array(F.transform(
        F.filter("pairs", lambda p, i: (
            F.coalesce(F.get("pairs", i - 1)["g"] == p["g"], F.lit(False))
            | F.coalesce(F.get("pairs", i + 1)["g"] == p["g"], F.lit(False))
        )),
        lambda p: p["i"],
    )))
    return paired.withColumn("hits", F.when(F.col("twice").isNotNull(), found)).drop("pairs", "twice")


def covered(starts: str, width: int) -> Column:
    """How many positions the stretches of ``width`` from the sorted ``starts`` cover."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        F.col(starts), zero,
        lambda a, x: F.struct(
            (a["n"] + x + width - F.greatest(a["end"], x)).alias("n"), (x + width).alias("end")
        ),
        lambda a: a["n"],
    )


def with_word_counts(df: DataFrame, common_words: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add ``word_counts``: counts of the language's common words as listed, then of all others.

    The words of a list are taken away in turn and the array's loss is counted.
    """
    width = max([0, *map(len, common_words.values())])
    out, last = df.withColumn("left_0", F.col("w")), "left_0"
    for k in range(width):
        word = F.lit(None).cast("string")
        for name, listed in common_words.items():
            if k < len(listed):
                word = F.when(F.col("lang") == name, F.lit(listed[k])).otherwise(word)
        # No word is a space, so that takes nothing away.
        out = out.withColumn(f"left_{k + 1}", F.array_remove(last, F.coalesce(word, F.lit(" "))))
        last = f"left_{k + 1}"
    sizes = [F.size(f"left_{k}").cast("double") for k in range(width + 1)]
    bins = [sizes[k] - sizes[k + 1] for k in range(width)]
    return out.withColumn("word_counts", F.array(*bins, sizes[-1])).drop(*[f"left_{k}" for k in range(width + 1)])


def references(counted: DataFrame) -> DataFrame:
    """Per language the sums of both histograms over all documents; one small row a language."""
    kinds = ("class_counts", "word_counts")
    cells = None
    for kind in kinds:
        part = counted.select("lang", F.lit(kind).alias("kind"), F.posexplode(kind).alias("bin", "n"))
        cells = part if cells is None else cells.unionByName(part)
    sums = cells.groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n"))
    lists = sums.groupBy("lang").agg(*[
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("bin", "n")))), lambda c: c["n"]
        ).alias(f"ref_{k}") for k in kinds
    ])
    return lists


def jensen_shannon(counts: str, reference: str) -> Column:
    """Distance between two histograms of counts, 0 to 1; 0 where either is empty."""
    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    def part(p, m):
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    n, m = total(F.col(counts)), total(F.col(reference))
    terms = F.zip_with(
        F.col(counts), F.col(reference),
        lambda a, b: part(a / n, (a / n + b / m) / 2) + part(b / m, (a / n + b / m) / 2),
    )
    return F.when((n > 0) & (F.coalesce(m, F.lit(0.0)) > 0), F.sqrt(F.greatest(total(terms) / 2, F.lit(0.0)))).otherwise(0.0)


def with_distances(counted: DataFrame, refs: DataFrame) -> DataFrame:
    """Add both distances to the references of the document's language.

    The references are written first, so that a broadcast follows their real size.
    """
    return counted.join(materialise(refs, "references"), "lang", "left").withColumns({
        "class_distance": jensen_shannon("class_counts", "ref_class_counts"),
        "word_distance": jensen_shannon("word_counts", "ref_word_counts"),
    }).drop("ref_class_counts", "ref_word_counts")


def quality_rules(
    docs: DataFrame, carry: Sequence[str] | None = None, min_words: int = MIN_WORDS,
    max_repeated_percent: int = MAX_REPEATED_PERCENT, max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    common_words: Mapping[str, Sequence[str]] = COMMON_WORDS,
) -> DataFrame:
    """Counts, both distances and the verdict ``kept`` of every document.

    Fewer than ``min_words`` words, or more than ``max_repeated_percent`` of the words in
    repeated 3-word windows, fail at once; the same minimum guards the distances, which
    say nothing about short texts. Reads the texts once: the counts are written, then
    summed per language and compared. Missing, empty and repeated rows are rows like any
    other; an empty table gives an empty result.
    """
    counted = materialise(features(docs, carry, common_words), "quality").withColumn(
        "base_failed", (F.col("n_words") < min_words)
        | (100 * F.col("n_repeat_words") > max_repeated_percent * F.col("n_words")),
    )
    # The first references hold junk as well; the second leave out what is far from them.
    rough = with_distances(counted, references(counted.where(~F.col("base_failed"))))
    typical = rough.where(
        ~F.col("base_failed") & (F.col("class_distance") <= TYPICAL_DISTANCE)
        & (F.col("word_distance") <= TYPICAL_DISTANCE)
    )
    judged = with_distances(counted, references(typical))
    return judged.select(
        "doc", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "class_distance", "word_distance", "base_failed",
        (~F.col("base_failed") & (F.col("class_distance") <= max_class_distance)
         & (F.col("word_distance") <= max_word_distance)).alias("kept"),
    )


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return rows_of(quality_rules(docs).where("kept"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = quality_rules(documents(spark, sf_dir, "doc_id", "lang", "text"), carry=["doc_id"])
    return judged.select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def _words_sql() -> str:
    listed = ", ".join(
        f"('{lang}', {k}, '{word}')" for lang, words in COMMON_WORDS.items() for k, word in enumerate(words)
    )
    return f"(VALUES {listed}) AS listed(lang, bin, word)"


def _distance_sql(kind: str, refs: str) -> str:
    """Distances of one kind of histogram to the references by bin."""
    return f"""
    SELECT doc_id, sqrt(greatest(sum(
        CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
        + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS distance
    FROM (
        SELECT b.doc_id, b.n / sum(b.n) OVER (PARTITION BY b.doc_id) AS p,
               r.n / sum(r.n) OVER (PARTITION BY b.doc_id) AS q
        FROM bins b JOIN {refs} r USING (lang, kind, bin) WHERE b.kind = '{kind}'
    ) GROUP BY doc_id"""


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(text, '') AS t,
             regexp_replace(coalesce(text, ''), '{IDENTIFIER}', '0', 'g') AS u FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (
    SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3))),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
            FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n > 1) GROUP BY doc_id),
c AS (SELECT doc_id, lang, w, len(w) AS n_words, length(u) AS n,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             length(u) - length(regexp_replace(u, '[a-z]', '', 'g')) AS c0,
             length(u) - length(regexp_replace(u, '[\x20\x09-\x0D]', '', 'g')) AS c1,
             length(u) - length(regexp_replace(u, '[A-Z]', '', 'g')) AS c2,
             length(u) - length(regexp_replace(u, '[^\x00-\x7F]', '', 'g')) AS c3,
             length(u) - length(regexp_replace(u, '[0-9]', '', 'g')) AS c4,
             length(u) - length(regexp_replace(u, '[.,;:?''"()-]', '', 'g')) AS c5 FROM w),
counted AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
                   n_words < {MIN_WORDS}
                   OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEATED_PERCENT} * n_words AS base_failed
            FROM c LEFT JOIN repeats USING (doc_id)),
met AS (SELECT doc_id, lang, bin, count(*) AS n
        FROM (SELECT doc_id, lang, unnest(w) AS word FROM counted) JOIN {_words_sql()} USING (lang, word)
        GROUP BY ALL),
cells AS (SELECT doc_id, lang, bin, coalesce(met.n, 0) AS n
          FROM counted JOIN {_words_sql()} USING (lang) LEFT JOIN met USING (doc_id, lang, bin)),
bins AS (
    SELECT doc_id, lang, 'class' AS kind, bin, n::DOUBLE AS n FROM (
        SELECT doc_id, lang, unnest([0, 1, 2, 3, 4, 5, 6]) AS bin,
               unnest([c0, c1, c2, c3, c4, c5, n - c0 - c1 - c2 - c3 - c4 - c5]) AS n FROM counted)
    UNION ALL SELECT doc_id, lang, 'word', bin, n::DOUBLE FROM cells
    UNION ALL SELECT doc_id, lang, 'word', 1000, (n_words - coalesce(m, 0))::DOUBLE
              FROM counted LEFT JOIN (SELECT doc_id, sum(n) AS m FROM met GROUP BY 1) USING (doc_id)),
rough AS (SELECT lang, kind, bin, sum(bins.n) AS n FROM bins JOIN counted USING (doc_id, lang)
          WHERE NOT base_failed GROUP BY ALL),
c_rough AS ({_distance_sql("class", "rough")}),
w_rough AS ({_distance_sql("word", "rough")}),
typical AS (SELECT doc_id FROM counted LEFT JOIN c_rough a USING (doc_id) LEFT JOIN w_rough b USING (doc_id)
            WHERE NOT base_failed AND coalesce(a.distance, 0) <= {TYPICAL_DISTANCE}
            AND coalesce(b.distance, 0) <= {TYPICAL_DISTANCE}),
refs AS (SELECT lang, kind, bin, sum(bins.n) AS n FROM bins JOIN typical USING (doc_id) GROUP BY ALL),
c_fine AS ({_distance_sql("class", "refs")}),
w_fine AS ({_distance_sql("word", "refs")})
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(a.distance, 0) <= {MAX_CLASS_DISTANCE}
       AND coalesce(b.distance, 0) <= {MAX_WORD_DISTANCE} AS kept
FROM counted LEFT JOIN c_fine a USING (doc_id) LEFT JOIN w_fine b USING (doc_id)
"""

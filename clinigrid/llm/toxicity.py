"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Homoglyphs and digits in place of letters are folded first. Words of the lexicon count
with learned weights unless they stand in an exception phrase; the sum is normalised by
the text's length and calibrated on the training rows.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinigrid.llm.common import MAX_BROADCAST_BYTES, append, documents, emit, raw, ship
from clinigrid.llm.language import held_out
from clinigrid.session import materialise

# Labelled rows that are learned from: the first by a hash of their id. A documented bound.
MAX_TRAINING_ROWS = 20_000
# A lexicon word occurs in this many toxic training texts at least, and its log-likelihood ratio against
# equal shares of toxic and other texts is so large: one word in a million is by chance.
MIN_TEXTS, MIN_RATIO = 3, 24.0
MIN_WEIGHT, MIN_STEM_WEIGHT = 3.5, 5.0
# Entries are whole words, or stems of so many letters that any word may begin with.
STEM_LETTERS = (4, 5, 6, 7)
# A larger lexicon than this is refused, as it goes to every task.
MAX_LEXICON_BYTES = MAX_BROADCAST_BYTES
THRESHOLD = 0.3
# Phrases in which a lexicon word is harmless.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "clown fish", "class clown", "rodeo clown",
    "pond scum", "scum line", "sore loser", "stupid question", "disgusting smell", "pathetic fallacy",
    "worthless check",
)
# Look-alike letters, and what they stand for.
HOMOGLYPHS = str.maketrans(
    "аәеёіїјоорсухѕԁһкмтвнɑαεικνορτυχωàáâãåçèéêëìíîïñòóôõùúûýÿ",
    "aaeeiijoopcyxsdhkmtbhaaeiknoptuxwaaaaaceeeeiiiinoooouuuyy",
)
# Signs in place of letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
         "!": "i", "|": "l", "2": "z", "6": "g"}
# Signs in front of a letter, however many.
SIGN_RUN = re.compile(r"[0-9@$!|]+(?=[^\W\d_])")
HAS_SIGN = re.compile(r"[0-9@$!|][^\W\d_]")
WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, homoglyphs and signs in words as plain letters."""
    low = text.lower()
    if not low.isascii():
        low = low.translate(HOMOGLYPHS)
    if HAS_SIGN.search(low):
        low = SIGN_RUN.sub(lambda m: "".join(SIGNS[c] for c in m.group()), low)
    return low


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic) of at most ``max_rows`` labelled rows outside the held-out quarter.

    A document labelled more than once counts as toxic if any label says so. The labels
    are bounded before they are broadcast, so texts stay where they are.
    """
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id"))
    drawn = F.xxhash64("doc_id")
    n = usable.count()
    if n > 2 * max_rows:
        # Half as many again as needed: so the sort does not see all labels.
        usable = usable.where(drawn < int((1.5 * max_rows / n - 0.5) * 2**64))
    wanted = (
        usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(drawn, "doc_id").limit(max_rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("text", "toxic")


def entries(words: set[str]) -> set[str]:
    """What a lexicon may list of these words: the words, and their stems marked with a star."""
    return words | {w[:n] + "*" for w in words for n in STEM_LETTERS if len(w) > n}


def lexicon(training: DataFrame, max_bytes: int = MAX_LEXICON_BYTES) -> dict[str, float]:
    """Words with their log odds of occurring in toxic texts rather than others.

    Words are counted per slice, then by Spark; only those that stand out reach the
    driver, and more than ``max_bytes`` of them are an error.
    """
    def start():
        def step(batch):
            toxic, clean = Counter(), Counter()
            for text, label in zip(raw(batch), batch.column("toxic").to_pylist()):
                (toxic if label else clean).update(entries(set(WORD.findall(fold(text.decode())))))
            words = list(toxic.keys() | clean.keys())
            return words, [toxic[w] for w in words], [clean[w] for w in words]

        return step

    sizes = training.agg(F.count_if(F.col("toxic") != 0).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).collect()[0]
    n_toxic, n_clean = sizes["t"], sizes["c"]
    if not n_toxic:
        return {}
    counts = emit(training, start, "word string, toxic bigint, clean bigint").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    weight = (
        F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    )
    n = n_toxic + n_clean
    texts = F.col("toxic") + F.col("clean")

    def part(seen, share):
        return F.when(seen > 0, 2 * seen * F.log(seen / (texts * share))).otherwise(0.0)

    # With toxic texts alone no word tells them from others by this.
    ratio = part(F.col("toxic"), n_toxic / n) + (part(F.col("clean"), n_clean / n) if n_clean else F.lit(0.0))
    best = counts.where(F.col("toxic") >= MIN_TEXTS).withColumn("weight", weight).where(ratio >= MIN_RATIO).where(
        F.col("weight") >= F.when(F.col("word").endswith("*"), MIN_STEM_WEIGHT).otherwise(MIN_WEIGHT)
    )
    best = materialise(best.select("word", "weight"), "lexicon")
    size = best.agg(F.sum(F.octet_length("word") + 16)).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"a lexicon of {size} bytes; at most {max_bytes} are sent to tasks")
    return {r["word"]: r["weight"] for r in best.orderBy(F.desc("weight"), "word").collect()}


def matcher(weights: dict[str, float], exceptions):
    """Aho-Corasick automaton of folded words and exception phrases, or None without words."""
    import ahocorasick

    if not weights:
        return None
    automaton = ahocorasick.Automaton()
    # Per string: its length, its weight as a word, its weight as a stem.
    listed: dict[str, list] = {}
    for entry, weight in weights.items():
        stem = entry.endswith("*")
        listed.setdefault(entry.rstrip("*"), [None, None])[stem] = weight
    for phrase in exceptions:
        listed.setdefault(phrase, [None, None])
    for text, (word, stem) in listed.items():
        automaton.add_word(text, (len(text), word, stem, text in exceptions))
    automaton.make_automaton()
    return automaton


def matches(automaton, text: str) -> tuple[float, int]:
    """Weights and number of the words that match outside exception phrases.

    A word that several entries match counts once, with the largest weight.
    """
    folded = fold(text)
    hits: dict[int, float] = {}
    excused = []
    for last, (size, word, stem, exception) in automaton.iter(folded):
        start, end = last - size + 1, last + 1
        if start and folded[start - 1].isalpha():
            continue
        whole = end == len(folded) or not folded[end].isalpha()
        if whole and exception:
            excused.append((start, end))
        weight = max(word or 0.0, stem or 0.0) if whole else stem or 0.0
        if weight > hits.get(start, 0.0):
            hits[start] = weight
    for start, end in excused:
        for at in [h for h in hits if start <= h < end]:
            del hits[at]
    return float(sum(hits.values())), len(hits)


def with_matches(df: DataFrame, weights: dict[str, float], exceptions=EXCEPTIONS) -> DataFrame:
    """Add ``hit_weight``, ``n_hits`` and ``n_tokens``; the lexicon has at most MAX_LEXICON_BYTES."""
    held = df.sparkSession.sparkContext.broadcast((weights, tuple(fold(e) for e in exceptions)))

    def start():
        automaton = matcher(*held.value)

        def step(batch):
            texts = raw(batch)
            found = [matches(automaton, t.decode()) if automaton else (0.0, 0) for t in texts]
            return [f[0] for f in found], [f[1] for f in found], [len(t.split()) for t in texts]

        return step

    matched = append(df, start, "hit_weight double, n_hits bigint, n_tokens bigint")
    return matched.withColumns({
        "level": F.log1p("hit_weight"), "density": F.log1p(100 * F.col("hit_weight") / (F.col("n_tokens") + 10)),
    })


def calibrated(training: DataFrame) -> tuple[float, float, float]:
    """Intercept and coefficients of level and density, by logistic regression on the training rows."""
    rows = training.select(F.when(F.col("toxic") != 0, 1.0).otherwise(0.0).alias("label"), "level", "density")
    if rows.select("label").distinct().count() < 2:
        return -20.0, 0.0, 0.0
    model = LogisticRegression(regParam=1e-3, maxIter=50).fit(
        VectorAssembler(inputCols=["level", "density"], outputCol="features").transform(rows)
    )
    return float(model.intercept), *map(float, model.coefficients)


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``) with ``score``, ``predicted``, ``hit_weight`` and ``n_hits``.

    Missing and empty texts have no hits and get the score of texts without any; repeated
    rows score alike; without toxic labels every score is near 0.
    """
    training = materialise(training_rows(docs, labels, max_rows), "training")
    weights = lexicon(training)
    intercept, level, density = calibrated(materialise(with_matches(training, weights).drop("text"), "matched"))
    logit = intercept + level * F.col("level") + density * F.col("density")
    scored = with_matches(docs, weights).withColumn("score", 1 / (1 + F.exp(-logit)))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)).drop(
        "level", "density", "n_tokens"
    )


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_toxicity(docs, labels).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "n_hits"
    )


ship(__name__)

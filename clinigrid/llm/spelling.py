"""Spelling variants one edit apart, by dynamic programming over sorted word lists.

Words that are one edit apart share their first half or, where the edit is in it, the rest.
So a word is put under both parts, and what is left of it is listed with the others of that
part, sorted. For each word the list is scanned once: the rows of the banded edit matrix that
belong to the prefix two neighbours of the list have in common are kept, and where the row of
a prefix exceeds one edit, all that begin with it are skipped. Lists that grow long are parted
by halves of what is left, again and again, so that none has more than a bounded number of words.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinigrid.llm.common import documents, emit, raw, ship
from clinigrid.session import drop_stage, materialise, write_stage

MIN_CHARS, MIN_COUNT = 5, 3
# A word's form occurs at least so many times as often.
FORM_RATIO = 2
# Runs whose hash this divides lose a code point.
ONE_IN = 97
# Letters are A-Z, a-z and U+00C0 to U+00FF.
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
ALPHABET = 26 + 64
# A list that is left with one letter, or two, holds no more words than this: longer ones can be parted.
LIST_WORDS = ALPHABET + ALPHABET**2
# Different words a task counts before it passes them on.
COUNTED_WORDS = 100_000


def spelled(data: bytes, doc_id: str) -> Counter:
    """Words of a document with their counts. All equal runs of one document lose the same code point."""
    found: Counter = Counter()
    start = crc32(f"{doc_id}:".encode())
    for run, n in Counter(LETTERS.findall(data.lower().decode())).items():
        h = crc32(run.encode(), start)
        if h % ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= MIN_CHARS:
            found[run] += n
    return found


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words that occur often enough. Counted by task, then by Spark."""
    def start():
        counts: Counter = Counter()

        def told():
            if not counts:
                return None
            out = list(counts), list(counts.values())
            counts.clear()
            return out

        def step(batch):
            for doc_id, data in zip(batch.column("id").to_pylist(), raw(batch)):
                counts.update(spelled(data, doc_id))
            return told() if len(counts) >= COUNTED_WORDS else None

        return step, told

    known = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string"))
    return emit(known, start, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= min_count
    )


def parts(rest, short: Column, key, differ: Column) -> Column:
    """The two lists that ``rest`` goes to, among words left with ``short`` characters or one more.

    Either the first ``short // 2`` characters are shared and go, or the last ``short -
    short // 2`` are; then those before differ in their first ``short // 2``, or the pair
    is in the other list already. ``differ`` is in how many first characters a pair has to
    differ (0: anywhere).
    """
    half = F.floor(short / 2).cast("int")
    tail = short - half
    size = F.length(rest)
    front = F.struct(
        F.concat(key, F.lit("P"), F.substring(rest, F.lit(1), half)).alias("key"),
        F.substring(rest, half + 1, size).alias("rest"), (short - half).alias("short"),
        F.when(differ > 0, differ - half).otherwise(F.lit(0)).alias("differ"),
    )
    back = F.struct(
        F.concat(key, F.lit("S"), F.substring(rest, size - tail + 1, tail)).alias("key"),
        F.substring(rest, F.lit(1), size - tail).alias("rest"), half.alias("short"), half.alias("differ"),
    )
    return F.array(front, back)


LISTED = ["word", "n", "key", "rest", "short", "differ"]


def lists(words: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """LISTED rows: words under the parts they share, no list longer than ``list_words``.

    A word is listed among words as long as the shorter of a pair: among its own length,
    and among the length below, where it can only be the longer. ``words`` is stored.
    """
    size = F.length("word")
    among = F.explode(F.when(size > MIN_CHARS, F.array(size, size - 1)).otherwise(F.array(size)))
    sized = words.select("word", "n", among.alias("among"))
    placed = sized.select("word", "n", F.inline(
        parts(F.col("word"), F.col("among"), F.col("among").cast("string"), F.lit(0))
    ))
    done, held = None, None
    while True:
        placed, path = write_stage(placed.select(*LISTED), "spelling-lists")
        if held:
            drop_stage(words.sparkSession, held)
        held = path
        # A list of words left with one character or none cannot be parted, and is short by itself.
        long = materialise(
            placed.groupBy("key", "short").agg(F.count(F.lit(1)).alias("members"))
            .where((F.col("members") > list_words) & (F.col("short") > 1)).select("key"), "long-lists",
        )
        if not long.take(1):
            return placed if done is None else done.unionByName(placed)
        short = materialise(placed.join(long, "key", "left_anti"), "spelling-lists")
        done = short if done is None else done.unionByName(short)
        placed = placed.join(long, "key", "left_semi").select(
            "word", "n", F.inline(parts(F.col("rest"), F.col("short"), F.col("key"), F.col("differ")))
        )


def transitions() -> tuple[list[int], int]:
    """Next state by state and matches, and the dead state.

    A state is a row of the edit matrix within its band: the costs of a prefix of one
    word against the other's prefixes that are one character shorter, as long, and one
    longer, 2 standing for more than one edit. The matches tell which of the other's three
    characters at the band equal the next character.
    """
    def step(a, b, c, low, mid, high):
        x = min(b + 1, a + (not low))
        y = min(c + 1, x + 1, b + (not mid))
        z = min(y + 1, c + (not high))
        return min(x, 2), min(y, 2), min(z, 2)

    table = []
    for state in range(27):
        for bits in range(8):
            x, y, z = step(state // 9, state // 3 % 3, state % 3, bits & 1, bits >> 1 & 1, bits >> 2)
            table.append((x * 9 + y * 3 + z) * 8)
    return table, 26 * 8


NEXT, DEAD = transitions()
# The empty prefix costs nothing against itself and one against a character.
BEGIN = (2 * 9 + 0 * 3 + 1) * 8


def near_pairs(rests: list[str], short: int, differ: int) -> list[tuple[int, int]]:
    """Places (i, j), i < j, of words one edit apart in a sorted list of different words.

    One of a pair is ``short`` characters long, and they differ in their first ``differ``.
    """
    size = len(rests)
    if size < 2:
        return []
    # Common prefix with the one before, and the next place where it is shorter.
    common = [0] * (size + 1)
    for i in range(1, size):
        a, b = rests[i - 1], rests[i]
        n = min(len(a), len(b))
        k = 0
        while k < n and a[k] == b[k]:
            k += 1
        common[i] = k
    common[size] = -1
    shorter = [size] * (size + 1)
    stack: list[int] = []
    for i in range(size + 1):
        while stack and common[stack[-1]] > common[i]:
            shorter[stack.pop()] = i
        stack.append(i)
    found = []
    depth = max(map(len, rests)) + 1
    rows = [BEGIN] * (depth + 1)
    for i, word in enumerate(rests):
        length = len(word)
        # ``\\0`` equals no letter.
        padded = "\0" + word + "\0\0\0"
        # Rows are known for so many characters of the place before.
        known, j = 0, i + 1
        if length > short + 1 or j == size:
            continue
        # Rows of the word's own prefixes stand for the first neighbour's common prefix.
        state = BEGIN
        for d in range(common[j]):
            low, ch = d, word[d]
            state = NEXT[state | (padded[low] == ch) | 2 | (padded[low + 2] == ch) << 2]
            rows[d + 1] = state
        known = common[j]
        while j < size:
            other = rests[j]
            at = known if known < common[j] else common[j]
            state, last = rows[at], len(other)
            if last > length + 1:
                last = length + 1
            while at < last:
                ch = other[at]
                state = NEXT[state | (padded[at] == ch) | (padded[at + 1] == ch) << 1 | (padded[at + 2] == ch) << 2]
                at += 1
                rows[at] = state
                if state == DEAD:
                    break
            if state == DEAD or at < len(other):
                # Whatever begins with these characters is too far away: on to the first that does not.
                cut = at if state == DEAD else at + 1
                j += 1
                while common[j] >= cut:
                    j = shorter[j]
                known = at if state != DEAD else at - 1
                continue
            known = at
            gap = length - len(other)
            if -1 <= gap <= 1 and min(length, len(other)) == short:
                cost = (state >> 3) // (9, 3, 1)[gap + 1] % 3
                if cost == 1 and not (differ and word[:differ] == other[:differ]):
                    found.append((i, j))
            j += 1
    return found


def variants(listed: DataFrame) -> DataFrame:
    """(word, near, best_n, best) per list in which a word has near words: how many, and the most frequent.

    Lists are stretches of a task's sorted rows; one is held at a time.
    """
    def start():
        current = [None, []]

        def told():
            key, rows = current
            if len(rows) < 2:
                return None
            _, _, _, _, short, differ = rows[0]
            pairs = near_pairs([r[3] for r in rows], short, differ)
            if not pairs:
                return None
            best: dict[int, list] = {}
            for i, j in pairs:
                for a, b in ((i, j), (j, i)):
                    word, n = rows[b][0], rows[b][1]
                    held = best.setdefault(a, [0, n, word])
                    held[0] += 1
                    if (-n, word) < (-held[1], held[2]):
                        held[1:] = n, word
            return [(rows[a][0], near, n, word) for a, (near, n, word) in best.items()]

        def step(batch):
            out = []
            for row in zip(*[batch.column(c).to_pylist() for c in LISTED]):
                if row[2] != current[0]:
                    out += told() or []
                    current[:] = row[2], []
                current[1].append(row)
            return list(zip(*out)) or None

        def finish():
            return list(zip(*(told() or []))) or None

        return step, finish

    dealt = listed.repartition("key").sortWithinPartitions("key", "rest")
    return emit(dealt, start, "word string, near bigint, best_n bigint, best string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: forms followed to the last, twice as far in every round.

    A form is at least FORM_RATIO times as frequent, so paths are short and end.
    """
    spark = forms.sparkSession
    current, held = write_stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = current.join(further, "root", "left")
        moved, path = write_stage(joined.select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        drop_stage(spark, held)
        held = path
        current = moved.select("word", "root")
        if not moved.where("next is not null").take(1):
            return current


def spelling_variants(docs: DataFrame, min_count: int = MIN_COUNT, list_words: int = LIST_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of ``docs`` (``doc_id`` and ``text``).

    Missing and empty texts have no words, a missing doc_id counts as an empty one, and
    rows of one doc_id each count. Equal counts: the form is the first by code points. Very
    long runs of letters are words like any other. Other columns are not looked at; an
    empty table has no words.
    """
    words = materialise(vocabulary(docs, min_count), "vocabulary")
    found = variants(lists(words, list_words))
    # Every pair is in one list alone, so lists add up.
    best = found.groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top")
    )
    usual = -F.col("top.less") >= FORM_RATIO * F.col("n")
    near = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(usual, F.col("top.best")).alias("form"), F.when(usual, -F.col("top.less")).alias("form_n"),
    )
    near = materialise(near, "variants")
    rooted = roots(near.where("form is not null").select("word", "form"))
    return near.join(rooted, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir, "doc_id", "text")).select(
        "word", "form", "root", "n", "n_near", "form_n"
    )


# Pairs by the words that one deletion leaves: at the same place for words as long, of one of both otherwise.
OP11_SQL = """
WITH RECURSIVE crc AS (
    SELECT list(list_reduce(list_concat([i], range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) r(i)
), runs AS (
    SELECT d, run, count(*) AS n FROM (
        SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[a-z\\x{C0}-\\x{FF}]+')) AS run FROM documents)
    GROUP BY ALL
), hashed AS (
    SELECT run, n, xor(list_reduce(list_concat([4294967295],
        list_transform(range(0, length(hex(encode(d || ':' || run))) // 2),
            lambda i: ('0x' || substr(hex(encode(d || ':' || run)), 2 * i + 1, 2))::BIGINT)),
        lambda a, v: xor(a >> 8, t[(xor(a, v) & 255) + 1])), 4294967295) AS h
    FROM runs, crc
), vocabulary AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT n, CASE WHEN h % 97 = 0
            THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), shorter AS (
    SELECT word, i, left(word, i) || substr(word, i + 2) AS rest
    FROM (SELECT word, unnest(range(length(word))) AS i FROM vocabulary)
), pairs AS (
    SELECT a.word AS a, b.word AS b FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT word, rest FROM shorter WHERE rest IN (SELECT word FROM vocabulary)
    UNION SELECT rest, word FROM shorter WHERE rest IN (SELECT word FROM vocabulary)
), best AS (
    SELECT a AS word, count(*) AS n_near, arg_min({'w': b, 'n': n}, (-n, b)) AS top
    FROM pairs JOIN vocabulary ON b = word GROUP BY a
), formed AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top.n >= 2 * n THEN top.w END AS form,
        CASE WHEN top.n >= 2 * n THEN top.n END AS form_n
    FROM vocabulary LEFT JOIN best USING (word)
), chain AS (
    SELECT word, coalesce(form, word) AS root FROM formed
    UNION SELECT chain.word, form FROM chain JOIN formed ON chain.root = formed.word WHERE form IS NOT NULL
), last AS (
    SELECT chain.word, root FROM chain JOIN formed ON chain.root = formed.word WHERE form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN last USING (word)
"""

ship(__name__)

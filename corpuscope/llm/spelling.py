"""Spelling variants of a vocabulary by pivotal grams.

Bigrams have one order, the rarest first.  Of each word the prefix is its three first bigrams (with
all places of the third one's bigram); two of them that do not overlap, the rarest such two by
dynamic programming, are its pivots.  One edit breaks at most one of two pivots, so of two near
words the one whose prefix ends no later in the order has a pivot that is whole in the other, and in
the other's prefix.  Left of a whole pivot or right of it nothing was edited either, so pivots are
indexed with the text on that side (its place follows), the word's length, and the half of the
other side that the edit left alone; the other words look up each gram of their prefix in the same
way.  Candidates are verified by their edit distance.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.batches import bounded
from corpuscope.sources.shared import stored

PREFIX = 3  # bigrams of a prefix: one edit breaks at most two
LEAST_LENGTH, LEAST_COUNT = 5, 3
MOST_KEPT = 300_000  # different words that a task counts before it hands them on
RUN = re.compile("[A-Za-z\u00C0-\u00FF]+")
LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}
KEYS = "word string, last int, key string"


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: runs of Latin letters, A-Z lower-cased, that have 5 letters and occur 3 times.

    A run whose checksum with its document's id is divisible by 97 loses one letter, as the query's
    contract says.  Texts are taken whole; a NULL text has no words and a NULL id is an empty one;
    the runs are counted inside each task first, so a frequent word is one row per task.
    """
    import pyarrow as pa

    def count(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                head = b"" if doc_id is None else str(doc_id).encode()
                for run, n in Counter(RUN.findall(text.as_py() or "")).items():
                    low = run.lower() if run.isascii() else run.translate(LOWER)
                    h = crc32(head + b":" + low.encode())
                    if h % 97 == 0:
                        at = h % len(low)
                        low = low[:at] + low[at + 1:]
                    if len(low) >= LEAST_LENGTH:
                        seen[low] += n
                if len(seen) > MOST_KEPT:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    return bounded(docs).select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def grams(word: str) -> list[str]:
    return [word[i:i + 2] for i in range(len(word) - 1)]


def gram_order(words: DataFrame) -> dict[str, int]:
    """The place of every bigram, the rarest first: at most 90 x 90, as words have 90 different letters."""
    def count(batches):
        import pyarrow as pa

        for batch in batches:
            found = Counter(g for word in batch.column(0).to_pylist() for g in grams(word))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["gram", "n"])

    found = words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r["gram"]: k for k, r in enumerate(sorted(found, key=lambda r: (r["n"], r["gram"])))}


def prefix(word: str, order: dict[str, int]) -> list[tuple[int, int]]:
    """(order, place) of the word's first grams, with every place of the last of them."""
    found = sorted((order[g], i) for i, g in enumerate(grams(word)))
    return [f for f in found if f[0] <= found[min(PREFIX, len(found)) - 1][0]]


def pivots(word: str, order: dict[str, int]) -> tuple[int, int]:
    """Places of the two grams of the prefix that do not overlap and are rarest together."""
    one: tuple | None = None  # rarest single gram that ended before the current one
    two: tuple | None = None
    waiting: list[tuple[int, int]] = []
    for rank, i in sorted(prefix(word, order), key=lambda f: f[1]):
        while waiting and waiting[0][1] + 2 <= i:
            done = waiting.pop(0)
            one = done if one is None or done < one else one
        if one is not None and (two is None or one[0] + rank < two[0]):
            two = (one[0] + rank, one[1], i)
        waiting.append((rank, i))
    return two[1], two[2]


def pivot_keys(word: str, order: dict[str, int]) -> Iterator[str]:
    """Keys of a word's pivots: an edit is right of the left pivot's start or left of the right pivot's end."""
    left, right = pivots(word, order)
    n = len(word)
    kept, rest = word[:left + 2], word[left + 2:]
    half = len(rest) // 2
    yield f"<{n}<{kept}<{rest[:half]}"
    yield f"<{n}>{kept}>{rest[half:]}"
    kept, rest = word[right:], word[:right]
    half = len(rest) // 2
    yield f">{n}<{kept}<{rest[:half]}"
    yield f">{n}>{kept}>{rest[half:]}"


def prefix_keys(word: str, order: dict[str, int]) -> Iterator[str]:
    """Keys under which a near word's pivot may be indexed, for each gram of the prefix and each length."""
    n = len(word)
    for _, i in prefix(word, order):
        for side, kept, rest in (("<", word[:i + 2], word[i + 2:]), (">", word[i:], word[:i])):
            for m in (n - 1, n, n + 1):
                other = m - len(kept)  # letters of the near word beside what is kept
                half = other // 2
                if other >= 0:
                    if len(rest) >= half:
                        yield f"{side}{m}<{kept}<{rest[:half]}"
                    if len(rest) >= other - half:
                        yield f"{side}{m}>{kept}>{rest[len(rest) - (other - half):]}"


def _shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast: it grows with the vocabulary, and files or emitted keys are sized far too low."""
    return df.hint("merge")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: every two words (5 letters at least) that differ by one letter put in, left out or replaced; once each."""
    import pyarrow as pa

    order = gram_order(words)
    # a small table may lie in one file, and each of its words makes some forty rows
    dealt = bounded(words).select("word").repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")

    def keys(of) -> DataFrame:
        def emit(batches):
            for batch in batches:
                for start in range(0, batch.num_rows, 500):
                    part = batch.column(0).slice(start, 500)
                    words = part.to_pylist()
                    found = [list(of(w, order)) for w in words]
                    which = pa.array(np.repeat(np.arange(len(words)), list(map(len, found))))
                    last = pa.array([prefix(w, order)[-1][0] for w in words], pa.int32())
                    yield pa.RecordBatch.from_arrays([part.take(which), last.take(which), pa.array(chain.from_iterable(found), pa.string())],
                                                     names=["word", "last", "key"])

        # verification makes up for keys with equal hashes
        return dealt.mapInArrow(emit, KEYS).select("word", "last", F.xxhash64("key").alias("key"))

    index = keys(pivot_keys).select("key", F.col("word").alias("x"), F.col("last").alias("last_x"))
    probes = keys(prefix_keys).select("key", F.col("word").alias("y"), F.col("last").alias("last_y"))
    near = (F.col("last_x") <= F.col("last_y")) & (F.col("x") != F.col("y")) & (F.levenshtein("x", "y", 1) == 1)
    found = index.join(_shuffled(probes), (index["key"] == probes["key"]) & near)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n; words differ).

    A word's form is its most frequent near word (ties: the smallest) if that is at least twice as
    frequent, else NULL; its root is reached by following forms.  Counts at least double from form
    to form, so a chain has at most 63 steps and never closes; it is followed by doubling steps.
    Words of fewer than 5 letters take no part in the search; an empty table gives no rows.
    """
    words = stored(words.select("word", "n"), "words")
    pairs = stored(near_pairs(words.where(F.length("word") >= LEAST_LENGTH)), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.join(_shuffled(words.select(F.col("word").alias("b"), F.col("n").alias("m"))), "b").groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("b").alias("b"))).alias("best"))
    has = -F.col("best.m") >= 2 * F.col("n")
    found = stored(words.join(_shuffled(best), "word", "left").select(
        "word", F.when(has, F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, -F.col("best.m")).alias("form_n")), "forms")
    steps = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = stored(steps.join(_shuffled(ahead), "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = steps.where("moved").limit(1).count()
        steps = steps.select("word", "root")
        if not moved:
            break
    return found.join(_shuffled(steps), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group(docs: DataFrame) -> DataFrame:
    """Spelling variants of the words of ``docs`` (doc_id, text); other columns, whatever their names, are not read."""
    return variants(vocabulary(docs))

"""A hashed maximum-entropy language model.

A token's probability is that of its class, given the tokens before it, times that of the word in
its class.  Frequent words are classes of their own; the others share classes by their form (what
they end with, which letters they hold), so every word has a class, also one never seen.  Both are
softmaxes over hashed features of the tokens before: the word before, the word before that (a skip)
and both together.  In a shared class the softmax runs over all its words: a word's weight is that of
its group under the features and the class, its bias the logarithm of its count with half a count
added.  A class's most frequent words are groups of their own, its others share groups by hash, so
the sum over all words is one over groups of exp(weight) times the counts of the group.

Training: counts are summed over all training texts.  Then, in rounds, each task makes gradient
steps over its texts from the weights that were sent to it, and the tasks' changes of them are
averaged by their tokens; a round has its own part of the texts.  Scoring works on numpy batches that gather a
few rows of weights for each token.  Words outside a bounded table of frequent ones are scored by a
join with the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.batches import bounded
from corpuscope.llm.shingles import text_chunks, word_hashes
from corpuscope.sources.shared import stored

HEAD = 1 << 17  # words in the table that is sent to the tasks: 4 MB
OWN = 47  # words that are classes of their own, besides the end
FORMS = 16
CLASSES = 1 + OWN + FORMS
BUCKETS = 1 << 13  # rows of weights for each kind of feature; 16 bits hold their numbers
KINDS = 3
KNOWN = 16  # words of each shared class that are groups of their own
SHARED = 16  # groups of its other words
GROUPS = KNOWN + SHARED
ROUNDS = 2
BATCH = 8_192
RATE = 0.2
PARTS = 24
END = np.uint64(0x5851F42D4C957F2D)
_BEGIN = np.uint64(0x14057B7EF767814F)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

# forms: two bits for the last byte, two for the letters beyond ASCII (by their second UTF-8 byte)
_LAST = np.full(256, 3, np.int64)
_LAST[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = 0
_LAST[ord(".")], _LAST[ord(",")] = 1, 2
_LETTER = np.zeros(256, np.uint8)
_LETTER[list("éèêàçùû".encode()[1::2])] = 1
_LETTER[list("äöüß".encode()[1::2])] = 2
_LETTER[list("ñóíáú".encode()[1::2])] = 3


def tokens(column) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, tokens, where each row's begin, forms) of some texts at a time; each ends with END."""
    for row, data, offsets in text_chunks(column):
        h, at, first = word_hashes(data, offsets)
        count = len(offsets) - 1
        out, form = np.empty(len(h) + count, np.uint64), np.zeros(len(h) + count, np.int64)
        ends = at[1:] + np.arange(count)
        is_word = np.ones(len(out), bool)
        is_word[ends] = False
        out[ends], out[is_word] = END, h
        if len(h):
            until = np.r_[first[1:], len(data)]
            solid = ~((data == 32) | (data >= 9) & (data <= 13))
            last = np.maximum.accumulate(np.where(solid, np.arange(len(data)), 0))[until - 1]
            form[is_word] = _LAST[data[last]] * 4 + np.maximum.reduceat(_LETTER[data] * (data >= 128), first)
        yield row, out, at + np.arange(count + 1), form


def buckets(t: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The hashed features of every position: one number for each kind."""
    one, two = np.r_[_BEGIN, t[:-1]], np.r_[_BEGIN, _BEGIN, t[:-2]][: len(t)]
    begins = starts[:-1]
    one[begins], two[begins] = _BEGIN, _BEGIN
    second = begins + 1
    two[second[second < np.minimum(starts[1:], len(t))]] = _BEGIN
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return [((x * m) >> shift).astype(np.int64) for x, m in ((one, _M1), (two, _M2), (one * _M2 + (two ^ two >> np.uint64(31)), _M1))]


@dataclass
class Words:
    """The frequent words, and each class's totals."""
    head: np.ndarray  # hashes in order
    count: np.ndarray
    klass: np.ndarray
    total: np.ndarray  # training tokens of each class
    distinct: np.ndarray
    group: np.ndarray  # of each word of the table
    mass: np.ndarray  # counts and half counts of each shared class's groups
    n: int
    v: int

    def __post_init__(self):
        self.start = np.searchsorted(self.head, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46))
        self.deepest = int(np.diff(np.r_[self.start, len(self.head)]).max(initial=0))

    def find(self, t: np.ndarray) -> np.ndarray:
        """Where each token is in the table, or -1."""
        place = self.start[(t >> np.uint64(46)).astype(np.int64)]
        out, open_ = np.full(len(t), -1), np.arange(len(t))
        for _ in range(self.deepest):
            inside = place < len(self.head)
            open_, place = open_[inside], place[inside]
            hit = self.head[place] == t[open_]
            out[open_[hit]] = place[hit]
            less = self.head[place] < t[open_]
            open_, place = open_[less], place[less] + 1
            if not open_.size:
                break
        return out

    def classes(self, t: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, place in the table) of each token."""
        place = self.find(t)
        return np.where(place >= 0, self.klass[place] if len(self.klass) else 0, 1 + OWN + form), place

    def groups(self, t: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The group in its class of each token."""
        return np.where(place >= 0, self.group[place] if len(self.group) else 0, hashed_group(t))

    def bias(self) -> np.ndarray:
        return np.log((self.total + 0.5) / (self.total + 0.5).sum()).astype(np.float32)

    def group_bias(self) -> np.ndarray:
        """Logarithms of the groups' masses, by shared class; no word is in a group without mass."""
        return np.log(np.maximum(self.mass, 1e-30)).astype(np.float32)


def hashed_group(t: np.ndarray) -> np.ndarray:
    """The shared group of words that are not among the most frequent of their class."""
    return KNOWN + (t % np.uint64(SHARED)).astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """h, form, c: every word of the texts and the end; combined in each task first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, t, _, form in tokens(batch.column(0)):
                # the low bits of a hash make room for the form, which follows from the word
                h, first, n = np.unique(t, return_index=True, return_counts=True)
                held.append((h, form[first], n))
                size += len(h)
                if size > 3_000_000:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > 1_500_000:
                        yield record(held.pop())
                        size = 0
        if held:
            yield record(merged(held))

    def merged(held):
        h, form, n = (np.concatenate(x) for x in zip(*held))
        h, first, where = np.unique(h, return_index=True, return_inverse=True)
        return h, form[first], np.bincount(where, n).astype(np.int64)

    def record(rows):
        h, form, n = rows
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(form.astype(np.int32)), pa.array(n.astype(np.int64))],
                                          names=["h", "form", "c"])

    return docs.select("text").mapInArrow(count, "h long, form int, c long").groupBy("h").agg(
        F.min("form").alias("form"), F.sum("c").alias("c"))


def table_of(counts: DataFrame) -> Words:
    """The HEAD most frequent words and the totals of all classes; nothing else comes to the driver."""
    head = counts.orderBy(F.desc("c"), "h").limit(HEAD).toPandas()
    forms = counts.groupBy("form", F.col("h").bitwiseAND(F.lit(SHARED - 1)).alias("low")).agg(
        F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # FORMS x SHARED rows at most
    h, c = head["h"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(np.int64)
    form = head["form"].to_numpy(np.int64)
    klass = 1 + OWN + form
    own = np.flatnonzero(h != END)[:OWN]
    klass[own] = 1 + np.arange(len(own))
    klass[h == END] = 0
    total, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    group, mass = hashed_group(h.view(np.uint64)), np.zeros((FORMS, GROUPS))
    mass[:, KNOWN:] = 0.5  # for words never seen
    for r in forms:
        total[1 + OWN + r["form"]] += r["n"]
        distinct[1 + OWN + r["form"]] += r["v"]
        mass[r["form"], KNOWN + r["low"]] += r["n"] + 0.5 * r["v"]
    for i in [*own, *np.flatnonzero(h == END)]:  # they leave the class of their form
        total[1 + OWN + form[i]] -= c[i]
        distinct[1 + OWN + form[i]] -= 1
        total[klass[i]], distinct[klass[i]] = c[i], 1
        mass[form[i], group[i]] -= c[i] + 0.5
    for f in range(FORMS):
        first = np.flatnonzero(klass == 1 + OWN + f)[:KNOWN]  # the table is in order of counts
        np.subtract.at(mass[f], group[first], c[first] + 0.5)
        group[first] = np.arange(len(first))
        mass[f, :len(first)] = c[first] + 0.5
    order = np.argsort(h)
    return Words(h[order], c[order], klass[order], total, distinct, group[order], mass, int(sum(r["n"] for r in forms)),
                 int(sum(r["v"] for r in forms)))


def log_classes(weights: np.ndarray, bias: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    """Natural logarithms of all class probabilities, one row a token."""
    z = _scores(weights, bias, features)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def _scores(weights: np.ndarray, bias: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    """Logarithms up to one number a token, with 0 as each token's largest."""
    z = weights[0].take(features[0], axis=0)
    for k in range(1, KINDS):
        z += weights[k].take(features[k], axis=0)
    z += bias
    z -= z.max(1, keepdims=True)
    return z


def log_chosen(weights: np.ndarray, bias: np.ndarray, features: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each token's ``chosen`` class."""
    z = _scores(weights, bias, features)
    own = z[np.arange(len(z)), chosen]
    return own - np.log(np.exp(z, out=z).sum(1))


def in_class(klass: np.ndarray, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(tokens of shared classes, their forms, their features under the class)."""
    at = np.flatnonzero(klass > OWN)
    form = klass[at] - 1 - OWN
    turn = form * (BUCKETS // FORMS * 5 + 1)
    return at, form, [(f[at] + turn) % BUCKETS for f in features]


def log_words(weights: np.ndarray, bias: np.ndarray, form: np.ndarray, features: list[np.ndarray], group: np.ndarray) -> np.ndarray:
    """Natural logarithms of exp(weight of the token's group) by the sum over all words of its class.

    A word's probability in its class is that times its count with half a count added.
    """
    return log_chosen(weights, bias[form], features, group) - bias[form, group]


def gradient_steps(weights, squares, bias, features, klass) -> None:
    """One step over some tokens, in place; a row's step shrinks with the gradients it has had."""
    g = _scores(weights, bias, features)
    np.exp(g, out=g)
    g /= g.sum(1, keepdims=True)
    g[np.arange(len(klass)), klass] -= 1
    for k in range(KINDS):
        order = np.argsort(features[k].astype(np.uint16), kind="stable")
        rows = features[k][order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        # as complex numbers two columns are summed at once
        total = np.add.reduceat(g.take(order, axis=0).view(np.complex64), first, axis=0).view(np.float32)
        rows = rows[first]
        squares[k][rows] += np.einsum("ij,ij->i", total, total)
        weights[k][rows] -= RATE * total / np.sqrt(squares[k][rows] + 1)[:, None]


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of one part of the tasks' changes of the weights, batch by batch."""
    part, total, n = None, 0.0, 0
    for batch in batches:
        part = batch.column(0)[0].as_py()
        for x, m in zip(batch.column(1), batch.column(2).to_pylist()):
            total = total + np.frombuffer(x.as_py(), np.float16) * np.float64(m)
            n += m
    mean = (total / n).astype(np.float32)
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([mean.tobytes()], pa.binary())], names=["part", "w"])


def train(docs: DataFrame, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the softmax of classes, and of words in them, after ROUNDS rounds; each text is in one round."""
    sc = docs.sparkSession.sparkContext
    weights = np.zeros((KINDS, BUCKETS, CLASSES + GROUPS), np.float32)
    table, bias, group_bias = sc.broadcast(words), words.bias(), words.group_bias()
    turn = F.pmod(F.xxhash64("text"), F.lit(ROUNDS))
    for k in range(ROUNDS):
        sent = sc.broadcast(weights)

        def step(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            w, v = halves(sent.value)
            squares, n = np.zeros((2, KINDS, BUCKETS), np.float32), 0
            for batch in batches:
                for _, t, starts, form in tokens(batch.column(0)):
                    (klass, place), features = table.value.classes(t, form), buckets(t, starts)
                    at, form, under = in_class(klass, features)
                    group = table.value.groups(t[at], place[at])
                    for begin in range(0, len(t), BATCH):
                        some = slice(begin, begin + BATCH)
                        gradient_steps(w, squares[0], bias, [f[some] for f in features], klass[some])
                    for begin in range(0, len(at), BATCH):
                        some = slice(begin, begin + BATCH)
                        gradient_steps(v, squares[1], group_bias[form[some]], [f[some] for f in under], group[some])
                    n += len(t)
            if n:
                # what the task has changed, in half precision: rows that it has not met are zeros
                flat = (np.concatenate([w, v], 2) - sent.value).astype(np.float16).reshape(PARTS, -1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in flat], pa.binary()), pa.array([n] * PARTS, pa.int64())],
                    names=["part", "w", "n"])

        rows = docs.where(turn == k).select("text").mapInArrow(step, "part int, w binary, n long").groupBy("part").applyInArrow(
            _add, "part int, w binary").collect()  # PARTS rows of fixed size
        if rows:
            weights = weights + np.concatenate([np.frombuffer(r["w"], np.float32) for r in sorted(rows)]).reshape(weights.shape)
    return halves(weights)


def halves(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of the classes and those of the groups in them, each for itself."""
    return weights[..., :CLASSES].copy(), weights[..., CLASSES:].copy()


def score(docs: DataFrame, learns: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row for each of ``docs``.

    ``learns`` tells the rows to learn from (NULL: no).  Tokens are blank-separated words with A to Z
    in lower case, then one end.  base_score is the sum of log10((c + 0.5) / (N + 0.5 (V + 1))) over
    them, score the model's log10 probability.  In base_score all words never seen share one half
    count; in score those of each shared group of a class do.
    NULL texts are empty (the end alone); repeated rows are each scored and each counted; a NULL
    doc_id stays; other columns are left aside; without rows to learn from every word is unknown.
    """
    rows = bounded(docs).select(F.col("doc_id").cast("long"), F.coalesce(learns, F.lit(False)).alias("learns"), "text")
    study = rows.where("learns")
    counts = stored(count_words(study), "counts")
    words = table_of(counts)
    weights = train(study, words)
    sc = docs.sparkSession.sparkContext
    table, sent, bias, group_bias = sc.broadcast(words), sc.broadcast(weights), words.bias(), words.group_bias()
    scale = np.log10(words.total + 0.5)  # of a class that is one word, so that it takes all of the class
    known = np.log10(words.count + 0.5)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t, starts, form in tokens(batch.column(2)):
                klass, place = table.value.classes(t, form)
                features, model = buckets(t, starts), np.empty(len(t))
                for begin in range(0, len(t), BATCH):
                    some = slice(begin, begin + BATCH)
                    model[some] = log_chosen(sent.value[0], bias, [f[some] for f in features], klass[some])
                at, form, under = in_class(klass, features)
                group, word = table.value.groups(t[at], place[at]), np.empty(len(at))
                for begin in range(0, len(at), BATCH):
                    some = slice(begin, begin + BATCH)
                    word[some] = log_words(sent.value[1], group_bias, form[some], [f[some] for f in under], group[some])
                model = model / np.log(10) - np.where(klass > OWN, 0.0, scale[klass])
                model[at] += word / np.log(10)
                inside = place >= 0
                word = np.where(inside, known[place] if len(known) else 0.0, 0.0)
                rest = np.flatnonzero(~inside)
                cuts = np.searchsorted(rest, starts).astype(np.int32)
                size = len(starts) - 1
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[row:row + size], batch.column(1)[row:row + size], pa.array(np.diff(starts)),
                    pa.array(np.add.reduceat(inside.astype(np.int64), starts[:-1])),
                    pa.array(np.add.reduceat(word, starts[:-1])), pa.array(np.add.reduceat(model, starts[:-1])),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(t[rest].view(np.int64)))],
                    names=["doc_id", "learns", "n_tokens", "n_head", "head", "model", "rest"])

    scored = stored(rows.mapInArrow(
        rate, "doc_id long, learns boolean, n_tokens long, n_head long, head double, model double, rest array<long>").withColumn(
        "row", F.monotonically_increasing_id()), "scored")
    tail = scored.select("row", F.explode("rest").alias("h")).join(counts, "h", "left").groupBy("row").agg(
        F.count("c").alias("n_tail"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("tail"))
    whole = float(np.log10(words.n + 0.5 * (words.v + 1)))
    word = F.col("head") + F.coalesce("tail", F.lit(0.0))
    return scored.drop("rest").join(tail, "row", "left").select(
        "doc_id", (~F.col("learns")).alias("held_out"), "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"), F.lit(words.n).cast("long").alias("train_tokens"),
        (word - F.col("n_tokens") * whole).alias("base_score"), (word + F.col("model")).alias("score"))

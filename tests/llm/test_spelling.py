import random
import re
import zlib
from collections import Counter

from corpuscope.llm import spelling as s
from corpuscope.llm.spelling_queries import op11_pivotal_spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(docs):
    seen = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def near_words(words):
    """By left-out letters: equal after leaving one out at one place, or one is the other with one left out."""
    holes, near = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1:]), []).append(w)
            shorter = w[:i] + w[i + 1:]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    return near


def brute(words):
    near, form = near_words(words), {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def test_query_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = op11_pivotal_spelling(spark, sf)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in found.collect()]
    want = brute(words_of(docs))
    assert len(rows) == len(want) and set(rows) == want and any(r[1] for r in rows)


def test_dense_words_against_brute_force(spark):
    """Few letters, repeated bigrams, letters of two bytes, ties: every kind of edit at every place."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 9))): rng.choice([3, 6, 7, 30]) for _ in range(1500)}
    words |= {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 13, "ÿÀ×÷é": 4}
    found = s.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {tuple(r) for r in found.collect()} == brute(words)


def test_pivots_are_the_rarest_two():
    rng = random.Random(6)
    for _ in range(500):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(5, 12)))
        order = {g: k for k, g in enumerate(rng.sample([x + y for x in "abc" for y in "abc"], 9))}
        held = s.prefix(word, order)
        sums = [(p + q, i, j) for p, i in held for q, j in held if j >= i + 2]
        i, j = s.pivots(word, order)
        assert j >= i + 2 and order[word[i:i + 2]] + order[word[j:j + 2]] == min(sums)[0]


def test_odd_and_no_documents(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert {tuple(r) for r in s.group(odd_docs).collect()} == brute(words_of(docs))
    assert s.group(no_docs).collect() == []


def test_nothing_is_broadcast(spark, monkeypatch):
    """However small a side looks: emitted keys are many times their words, and files are compressed."""
    plans, stored = [], s.stored

    def planned(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(s, "stored", lambda df, name: planned(df) or stored(df, name))
    words = spark.createDataFrame([("abcdefgh"[:n] + x, 3 * 4**n) for n in range(5, 9) for x in ("", "q")], "word string, n long")
    planned(s.variants(words))
    assert sum("SortMergeJoin" in p for p in plans) >= 5 and not any("Broadcast" in p for p in plans)

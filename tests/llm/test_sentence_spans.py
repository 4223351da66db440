import re

from corpuscope.llm import sentence_spans as s


def split(text):
    """(words, end) of each sentence, by a plain loop."""
    data, out, held = (text or "").encode(), [], []
    found = list(re.finditer(rb"[^\x20\x09-\x0d]+", data))
    for i, m in enumerate(found):
        held.append(m.group().lower())
        after = found[i + 1].start() if i + 1 < len(found) else len(data)
        if m.group()[-1:] in (b".", b"!", b"?") or b"\n" in data[m.end():after] or i + 1 == len(found):
            out.append(held)
            held = []
    return out


def runs(parts):
    """The shortest run from each sentence on and up to each sentence."""
    enough = lambda i, j: j - i + 1 >= s.SENTENCES and sum(map(len, parts[i:j + 1])) >= s.WORDS
    n, out = len(parts), set()
    for i in range(n):
        out.update([(i, j) for j in range(i, n) if enough(i, j)][:1])
        out.update([(j, i) for j in range(i, -1, -1) if enough(j, i)][:1])
    return out


def removed(docs):
    seen, gone = {}, {}
    for doc_id, text in sorted(docs):
        parts = split(text)
        for i, j in sorted(runs(parts)):
            words = tuple(w for p in parts[i:j + 1] for w in p)
            if seen.setdefault(words, (doc_id, i)) != (doc_id, i):
                gone.setdefault(doc_id, set()).update(range(i, j + 1))
    return {d: len(g) for d, g in gone.items()}


def test_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = s.remove_repeats(docs).collect()
    want = removed([tuple(r) for r in docs.collect()])
    assert {r["doc_id"]: r["n_removed"] for r in rows if r["n_removed"]} == want and len(want) > 5
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        left = [w for p in split(r["text"]) for w in p]
        if r["doc_id"] not in want:
            assert r["text"] == held[r["doc_id"]]
        else:
            assert len(left) < len([w for p in split(held[r["doc_id"]]) for w in p])


def test_first_passage_stays(odd_docs, no_docs):
    rows = {(r["doc_id"], r["text"]): r for r in s.remove_repeats(odd_docs).collect()}
    by = {r["doc_id"]: r for r in rows.values()}
    assert by[1]["n_removed"] == 0 and by[9]["text"] == "" and by[9]["n_removed"] == 4
    assert by[2]["text"] == "And then it rained."
    assert by[5]["n_removed"] == 0 and by[3]["text"] is None and by[8]["text"] == "  \n\t "
    assert s.remove_repeats(odd_docs).count() == odd_docs.count()
    assert s.remove_repeats(no_docs).count() == 0


def words(*span):
    return " ".join(f"word{i}" for i in range(*span))


def left_of(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in s.remove_passages(docs).orderBy("doc_id").collect()]


def test_one_long_sentence_between_different_neighbours(spark):
    sentence = words(60) + "."
    first = f"Here one begins. {sentence} Some more of it."
    assert left_of(spark, first, f"Quite another start. {sentence} And another end.") == [first, "Quite another start. And another end."]
    short = words(26) + "."
    assert left_of(spark, f"One. {short} Two.", f"Three. {short} Four.")[1] == "Three. Four."
    assert left_of(spark, words(20) + ".", words(20) + ".")[1] == words(20) + "."


def test_passages_without_whole_sentences(spark):
    for at in range(0, 40, 3):
        shared = words(1000 + at, 1000 + at + s.PASSAGE)
        first, again = f"{words(70)} {shared} {words(2000, 2070)}", f"{words(3000, 3050)} {shared} {words(4000, 4030)}"
        left = left_of(spark, first, again) if at < 3 else [first, cut(first, again)]
        kept = left[1].split()
        assert left[0] == first and sum(w in shared.split() for w in kept) <= 2 * s.WINDOW
        assert [w for w in kept if w not in shared.split()] == f"{words(3000, 3050)} {words(4000, 4030)}".split()


def cut(first, again):
    import numpy as np

    data = [np.frombuffer(t.encode(), np.uint8) for t in (first, again)]
    (_, _, _, *h), (_, low, high, *g) = (s.runs(d, np.array([0, len(d)])) for d in data)
    known = set(zip(*h))
    return s.without_words(again, [(a, b) for a, b, *k in zip(low, high, *g) if tuple(k) in known])[0]


def test_other_line_breaks(spark):
    text = words(200)
    wrapped = text.split()
    lines = lambda n: "\n".join(" ".join(wrapped[i:i + n]) for i in range(0, 200, n))
    left = left_of(spark, lines(11), lines(13), lines(7))
    assert left[0] == lines(11) and all(len(t.split()) <= 2 * s.WINDOW for t in left[1:])


def test_odd_texts_have_runs_in_their_row():
    import numpy as np

    texts = ["", "a", words(60), "b. " * 40, " ", words(9), "x " * 100]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    row, low, high, *_ = s.runs(data, np.r_[0, np.cumsum([len(t) for t in texts])])
    sizes = np.array([len(t.split()) for t in texts])
    assert (low >= 0).all() and (high <= sizes[row]).all() and (high - low >= s.WORDS).all() and set(row) == {2, 3, 6}


def test_turns_share_out_the_runs(spark, sf):
    import numpy as np

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(40)
    turns = [[tuple(r) for r in s._runs_of(docs, True, k).select("h1", "h2", "doc_id", "low", "high").collect()] for k in range(s.TURNS)]
    want = []
    for doc_id, text in docs.collect():
        data = np.frombuffer((text or "").encode(), np.uint8)
        _, low, high, h1, h2 = s.runs(data, np.array([0, len(data)]))
        want += zip(h1.view(np.int64).tolist(), h2.view(np.int64).tolist(), [doc_id] * len(low), low.tolist(), high.tolist())
    assert sorted(sum(turns, [])) == sorted(want) and all(len(t) < 0.7 * len(want) for t in turns)

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscope.llm import ngram_join as j
from corpuscope.llm.components import components


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 12), st.integers(1, 12))
def test_tree_finds_every_link(seed, n, m):
    rng = np.random.default_rng(seed)
    bases = [rng.choice(200, rng.integers(1, 40), replace=False) for _ in range(3)]

    def some():
        s = set(bases[rng.integers(3)].tolist())
        return np.array(sorted(set(list(s)[rng.integers(0, 4):]) | set(rng.integers(0, 200, rng.integers(0, 4)).tolist()) or {1}), np.uint64)

    ours, theirs = [some() for _ in range(n)], [some() for _ in range(m)]
    want = {(a, b) for a, x in enumerate(ours) for b, y in enumerate(theirs)
            if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))}
    assert sorted(j.tree_links(ours, theirs)) == sorted(want)


def test_signatures_lose_no_link():
    rng = np.random.default_rng(0)
    links = left = 0

    def some(n):
        return np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))

    for _ in range(60):
        base = some(rng.integers(5, 900))

        def copy():
            return np.unique(np.concatenate([base[rng.integers(0, max(1, len(base) // 4)):], some(rng.integers(0, max(1, len(base) // 5)))]))

        sides = [[copy() for _ in range(5)] + [some(len(base)) for _ in range(3)] for _ in range(2)]
        able = j.near(*[[(len(s), j.signature(s)) for s in side] for side in sides], False)
        for a, b in j.tree_links(*sides):
            links += 1
            assert able[0][a] and able[1][b]
        left += int((~able[0]).sum())
    assert links > 100 and left > 50


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000, k) for k in range(1001, 1400)] + [(2000 + k, 2001 + k) for k in range(60)]
    root = {x: x for e in links for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    table = spark.createDataFrame([*links, (5, 5), (None, 3), *links[:20]], "a long, b long")
    found = {r["node"]: r["root"] for r in components(table).collect()}
    assert found == {x: top(x) for e in links for x in e if any(a != b for a, b in links if x in (a, b))}
    assert components(table.limit(0)).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))
    for _ in docs:
        for a, x in enumerate(sets):
            for b in range(a):
                if x and 100 * len(x & sets[b]) >= 80 * len(x | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    out = []
    for k, (d, _) in enumerate(docs):
        group = [docs[i][0] for i in range(len(docs)) if root[i] == root[k] and docs[i][0] is not None]
        out.append((d, len(sets[k]), min(group, default=None) if sets[k] else d))
    return out


def test_many_near_copies(spark):
    """A group in which pairs lie around the threshold, spread over several blocks."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(60)]
    docs = []
    for k in range(300):
        w = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 4)):
            w[at] = f"x{rng.integers(0, 40)}"
        docs.append((k, " ".join(w)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = sorted(tuple(r) for r in j.component_ids(j.similar_groups(table)).collect())
    assert found == sorted(brute(docs)) and len({r[2] for r in found}) > 1


def test_odd_rows(odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = [tuple(r) for r in j.component_ids(j.similar_groups(odd_docs)).collect()]
    assert sorted(found, key=str) == sorted(brute(docs), key=str)
    assert j.similar_groups(no_docs).count() == 0
    stay = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in j.one_of_each_group(odd_docs).collect())
    assert [d for d, _ in stay] == [-1, -1, 1, 3, 4, 5, 6, 7, 8]

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpuscope.llm import token_links as t
from corpuscope.llm.token_units import Aligner, Pair

A = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
BYTE = {}  # the byte-level alphabet: printable bytes are themselves, the others follow from U+0100 on
for b in range(256):
    shown = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
    BYTE[chr(b) if shown else chr(256 + len([1 for c in BYTE.values() if not (33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255)]))] = b


def tokens(text):
    a = [(i, bytes(BYTE[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode())
         for i, p in ((i, B.id_to_piece(i)) for i in B.encode(text))]
    data = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == data == b"".join(x for _, x in b) else ([], [])


def spans(found):
    ends = np.cumsum([len(x) for _, x in found]).tolist()
    return [(i, e - len(x), e) for (i, x), e in zip(found, ends)]


def brute(docs):
    each, total = [], Counter()
    for doc_id, text in docs:
        a, b = map(spans, tokens(text)) if text else ([], [])
        links = Counter((i, k) for i, s, e in a for k, f, g in b if s < g and f < e)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [(",".join(str(i) for i, s, e in a if low < e <= high), ",".join(str(k) for k, s, e in b if low < e <= high))
                  for low, high in zip([0, *cuts], cuts)]
        each.append((doc_id, len(a), len(b), len(groups), links, ";".join("|".join(g) for g in groups)))
        total.update(links)
    best = Counter()
    for (i, k), n in total.items():
        best[k] = max(best[k], n)
    return total, sorted((str(d), n_a, n_b, n_g, links.total(), sum(m for p, m in links.items() if total[p] == best[p[1]]),
                          sum(m * total[p] for p, m in links.items()), hashlib.sha256(s.encode()).hexdigest() if s else "")
                         for d, n_a, n_b, n_g, links, s in each)


ODD = ["", None, " ", "a", "  two  spaces ", "tab\tnew\nline \n x", "<|endoftext|> </s> <s>", "it's 12345 don't", "naïve œuvre — “q”",
       "漢字 かな 한글", "🙂 x▁y", "▁", "é ​   z", "\x00\x1c a", "ﬁ ａ", "x" * 300, "Ünder <0x0A> ▁the", "a\r\nb  c"]


@pytest.mark.parametrize("buffer, fan_in", [(t.SPILL, t.FAN_IN), (500, 2)])
def test_brute_force(spark, sf, monkeypatch, buffer, fan_in):
    monkeypatch.setattr(t, "FAN_IN", fan_in)
    docs = [(r["doc_id"], r["text"][:1500]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    docs += list(enumerate(ODD, 10_000)) + [(10_003, "a"), (None, "a b")]
    total, want = brute(docs)
    found, pairs = t.align(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), Pair.public(), buffer)
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == want
    assert {(r["a_id"], r["b_id"]): r["n_links"] for r in pairs.collect()} == total


def test_merge_sums_equal_pairs(monkeypatch):
    monkeypatch.setattr(t, "BLOCK", 7)
    rng = np.random.default_rng(1)
    runs = [np.unique(rng.integers(0, 3000, n), return_counts=True) for n in (0, 1, 500, 9000)]
    want = Counter()
    for keys, counts in runs:
        want.update(dict(zip(keys.tolist(), counts.tolist())))
    merged = [(k, c) for keys, counts in t.merge(runs) for k, c in zip(keys.tolist(), counts.tolist())]
    assert merged == sorted(want.items())


def test_odd_and_no_documents(spark, odd_docs, no_docs):
    found = t.align(odd_docs, Pair.public())[0].collect()
    assert len(found) == odd_docs.count()
    assert {r["n_links"] for r in found if r["doc_id"] in (3, 4)} == {0}
    assert [x.collect() for x in t.align(no_docs, Pair.public())] == [[], []]


def test_units_at_once_are_aligned_as_one_by_one():
    find = Aligner(Pair.public())
    units = ["one", "naïve", "it's", "1234567", "x" * 40, "end.\n\nNext", "<s>", "▁odd", "a\tb", "Größe,", "don't!!", "é"]
    plain = [u for u in units if max(u) < "ɐ"]
    shown, counts, sizes, links = find._all_at_once(plain)
    want = find._one_by_one(plain)
    assert shown == want[0] and all((x == y).all() for x, y in zip((counts, sizes, links), want[1:], strict=True))
    mixed = [*units, " ", "\n", "", "語", " lead", "trail\n"]
    which = [find[u] for u in mixed]
    find.learn()
    for k, unit in zip(which, mixed, strict=True):
        shown, counts, _, links = find._one_by_one([unit])
        assert find.groups[k] == shown[0] and (find.counts[k] == counts[0]).all()
        assert (find.links[find.ends[k]:find.ends[k + 1]] == links).all()

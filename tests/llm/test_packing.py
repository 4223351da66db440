import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscope.llm import packing
from corpuscope.llm.packing_queries import packed_digest
from corpuscope.llm.tokens import Encoder

VOCABULARY = packing.Vocabulary.public()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY.tokenizer)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(VOCABULARY.tokenizer, VOCABULARY.ranks, VOCABULARY.pattern)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t  'aZé9.,!<|ー한🙂"), st.characters(exclude_categories=("Cs",))), max_size=40))
def test_ids_are_the_tokenizers(encoder, tokenizer, text):
    for t in (text, f"{text} <|endoftext|>  {text}", "it's " + text + "  we'll"):
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(0, 20))
def test_best_fill(counts, room):
    taken = packing.best_fill(sorted(counts, reverse=True), counts, room)
    sums = {sum(k * m for k, m in zip(counts, c)) for c in itertools.product(*[range(n + 1) for n in counts.values()])}
    assert sum(k * m for k, m in taken.items()) == max(x for x in sums if x <= room)
    assert all(0 < m <= counts[k] for k, m in taken.items())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
def test_plan_places_every_piece_once(histogram):
    seen, filled = {k: 0 for k in histogram}, {}
    for length, low, high, each, first, offset in packing.plan(histogram, 64):
        assert low == seen[length] and (high - low) % each == 0
        seen[length] = high
        for k in range(high - low):
            filled.setdefault(first + k // each, []).append((offset + k % each * length, length))
    assert seen == histogram and sorted(filled) == list(range(len(filled)))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1] and sum(n for _, n in parts) <= 64


def check(rows, docs, tokenizer):
    pieces, ids = {}, {}
    for doc_id, text in docs:
        ids.setdefault(doc_id, []).append(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        assert any(zlib.crc32(np.array(x[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] and len(x) == r["doc_tokens"]
                   for x in ids[r["doc_id"]])
    assert {k: sum(len(x) for x in v) for k, v in ids.items()} == {k: sum(r["length"] for r in v) for k, v in pieces.items()}
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(filled) == list(range(len(filled))) and max(filled.values()) <= 2048
    return filled


def test_documents(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    filled = check(packed_digest(docs).collect(), [tuple(r) for r in docs.collect()], tokenizer)
    assert sum(2048 - n for n in filled.values()) < 2 * 2048


def test_sequences_hold_the_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(30)
    packed = packing.pack(docs, VOCABULARY)
    rows = packing.sequences(packed).collect()
    assert all(len(r["ids"]) == 4 * r["filled"] for r in rows)
    assert sum(r["filled"] for r in rows) == packed.agg({"length": "sum"}).first()[0]


def test_odd_rows(odd_docs, no_docs, tokenizer):
    check(packed_digest(odd_docs).collect(), [(r["doc_id"], r["text"]) for r in odd_docs.collect()], tokenizer)
    assert packed_digest(no_docs).count() == 0

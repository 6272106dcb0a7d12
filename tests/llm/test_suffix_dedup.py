"""Removal of repeated bytes against a window by window search."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from shopledger.llm import suffix_dedup

from . import odd


def expected(rows):
    seen, out = set(), Counter()
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[(doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, suffix_dedup.digests(docs).collect())) == expected(rows)


@pytest.fixture(scope="module")
def passages(spark):
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [letters(n) for n in (99, 100, 101, 130, 250, 600)]
    texts = [letters(rng.randrange(150)) + rng.choice(shared) + letters(rng.randrange(150)) + rng.choice(shared) for _ in range(60)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


def test_passages(passages):
    check(passages)


def test_odd_rows(spark):
    check(odd.documents(spark))


def test_given_documents(spark):
    check(odd.small(spark))


def test_crowded_keys_lose_nothing(passages, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_NAMES", 3)
    check(passages)


@pytest.mark.parametrize("names", [3, 50_000])
def test_frequent_keys_lose_nothing(spark, passages, monkeypatch, names):
    monkeypatch.setattr(suffix_dedup, "LOOKED_AT", 1)
    monkeypatch.setattr(suffix_dedup, "SEEN", 2)
    monkeypatch.setattr(suffix_dedup, "MOST_NAMES", names)
    assert len(suffix_dedup._frequent(suffix_dedup.numbered(passages))) > 5
    check(passages)
    check(odd.documents(spark, [odd.PROSE * 2] * 40 + ["ab" + odd.PROSE * 2 + "cd", None]))


def test_deduplicate(spark):
    docs = odd.documents(spark, [odd.PROSE * 2, "ab" + odd.PROSE * 2 + "cd", None])
    got = suffix_dedup.deduplicate(docs)
    assert got.schema.simpleString() == docs.schema.simpleString()
    texts = [r.text for r in got.where("lang is null and doc_id is not null").orderBy("doc_id").collect()]
    assert texts[1] == "abcd" and texts[2] is None
    assert suffix_dedup.deduplicate(odd.empty(spark)).count() == 0

"""Near-duplicate components against all pairs."""

from __future__ import annotations

import random
import re

import pytest

from shopledger.llm import components, ngram_join

from . import odd


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if 0 < len(w) < 5:
        return {tuple(w)}
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                up[top(a)] = top(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        ids = least.setdefault(top(k), [])
        if doc is not None:
            ids.append(doc)
    return sorted(
        ((doc, len(sets[k]), min(least[top(k)]) if sets[k] and least[top(k)] else doc) for k, (doc, _) in enumerate(rows)), key=str
    )


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, ngram_join.similar(docs).collect()), key=str) == expected(rows)


def edited(base, share, rng):
    return " ".join("w%d" % rng.randrange(10**9) if rng.random() < share else w for w in base)


@pytest.fixture(scope="module")
def copies(spark):
    """Groups of near copies around the threshold, with a passage that all share."""
    rng = random.Random(5)
    passage = " ".join("p%d" % k for k in range(60))
    texts = []
    for _ in range(12):
        base = ["b%d" % rng.randrange(10**9) for _ in range(rng.choice((6, 30, 200)))]
        for _ in range(12):
            texts.append(edited(base, rng.choice((0, 0.01, 0.03)), rng) + rng.choice(("", " " + passage)))
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def test_all_pairs(copies):
    check(copies)


def test_odd_rows(spark):
    check(odd.documents(spark))


def test_small_blocks_lose_no_link(copies, monkeypatch):
    monkeypatch.setattr(ngram_join, "MOST_SETS", 3)
    monkeypatch.setattr(components, "EACH", 40)
    check(copies)


def test_one_of_each(spark):
    docs = odd.documents(spark)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert texts.count("word") == 1 and len(texts) == docs.count() - 2 - 2
    assert ngram_join.similar(odd.empty(spark)).count() == 0


def test_one_of_each_numbers_once(spark):
    """Row numbers of a sampled range sort differ from one numbering to the next on a table of this size."""
    n = 100_000
    word = "concat('w', {0} * 31 + {1})"
    text = "concat_ws(' ', " + ", ".join(word.format("base", k) for k in range(8)) + ")"
    docs = spark.range(0, n, 1, 40).selectExpr("id", "IF(id % 4 = 3, id - 1, id) AS base")  # one of four is a copy
    docs = docs.selectExpr("CASE WHEN id % 9973 = 0 THEN NULL WHEN id % 9001 = 1 THEN 5 ELSE id END AS doc_id", f"{text} AS text")
    kept = ngram_join.one_of_each(docs.repartition(40))
    assert kept.count() == kept.select("text").distinct().count() == docs.select("text").distinct().count()


@pytest.fixture(scope="module")
def unlinked(spark):
    """One large group of candidates: texts of like size around one passage, few of which are linked."""
    rng = random.Random(8)
    passage = " ".join("p%d" % k for k in range(130))
    texts = [" ".join("u%d" % rng.randrange(10**9) for _ in range(rng.randrange(25, 30))) + " " + passage for _ in range(120)]
    texts += [t + " end" for t in texts[::10]] + [passage + " " + t for t in texts[:3]]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def test_candidates_without_links(unlinked, monkeypatch):
    monkeypatch.setattr(ngram_join, "MOST_SETS", 10)
    held = []
    crossed = ngram_join._crossed

    def seen(hosts, visits, sets):
        held.append((sets.count(), visits.count()))
        return crossed(hosts, visits, sets)

    monkeypatch.setattr(ngram_join, "_crossed", seen)
    check(unlinked)
    (n, first), (_, then) = held
    assert n >= 100 and first <= n and then <= n * (n // 10 + 1) / 2 * 1.2  # each pair of blocks meets once


def test_passages_alone_make_no_candidates(spark):
    """Half of each text is a passage that all share; rare-first order keeps them apart, wherever hashes fall."""
    rng = random.Random(9)
    passage = " ".join("p%d" % k for k in range(60))
    texts = [" ".join("u%d" % rng.randrange(10**9) for _ in range(60)) + " " + passage for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    levels = spark.sparkContext.broadcast(ngram_join._levels(docs))
    assert ngram_join._candidates(ngram_join._prefixes(docs, levels)).count() == 0
    check(docs)

"""SimHash near-copies against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from shopledger.llm import simhash
from shopledger.llm.components import components

from . import odd

SPACE = re.compile("[\x20\x09-\x0d]+")


def fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in SPACE.split(lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(points):
    """The least point of each point's group, by all pairs."""
    points = np.array(sorted(set(points)), np.uint64)
    near = [np.flatnonzero(np.bitwise_count(points ^ p) <= 4) for p in points]
    root = {}
    for start in range(len(points)):
        todo = [start] if start not in root else []
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = start
                todo += near[k].tolist()
    return {int(points[k]): int(points[r]) for k, r in root.items()}


def brute(rows):
    """(doc_id, fingerprint, component_id) of (doc_id, text) rows."""
    found = [(i, fingerprint(t)) for i, t in rows]
    root = groups(f for _, f in found)
    first = {}
    for i, f in found:
        if i is not None:
            first[root[f]] = min(i, first.get(root[f], i))
    return sorted(((i, f"{f:016x}", first.get(root[f])) for i, f in found), key=repr)


def found(df, **more):
    return sorted((tuple(r) for r in simhash.near_copies(df, **more).collect()), key=repr)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_given_documents(spark):
    df = odd.small(spark)
    got = found(df)
    assert got == brute(pairs(df))
    assert len({r[2] for r in got}) < len(got)


def test_odd_documents(spark):
    df = odd.documents(spark)
    rows = df.select("doc_id", "text", df.lang.alias("fingerprint"), df.n_chars.alias("point"), df.n_words.alias("root"))
    rows = rows.unionByName(rows.selectExpr("doc_id + (1L << 60) AS doc_id", "text", "fingerprint", "point", "root")).coalesce(1)
    assert found(rows) == brute(pairs(rows))
    only = rows.where("doc_id IS NULL AND text IS NOT NULL")
    assert found(only) == brute(pairs(only)) and found(only)[0][2] is None
    assert found(odd.empty(spark)) == []


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 100)
    text = " ".join(random.Random(3).choices(["a", "Bb", "ç", "dd"], k=1234))
    assert simhash.fingerprint(text.encode()) == fingerprint(text)


def made(seed=0, alone=1500, clusters=40, around=1500):
    """Points of their own, small chains, and one large crowd of near ones."""
    rng = random.Random(seed)
    flip = lambda p, n: p ^ sum(1 << b for b in rng.sample(range(64), n))
    out = [rng.getrandbits(64) for _ in range(alone)]
    for _ in range(clusters):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(2, 9)):
            out.append(p)
            p = flip(p, rng.choice([1, 3, 4, 4, 4, 5, 6]))
    centre = rng.getrandbits(64)
    out += [flip(centre, rng.randint(0, 5)) for _ in range(around)]
    out += [0, 1, 31, (1 << 64) - 1, (1 << 64) - 16]
    return out


@pytest.mark.parametrize(("count", "most"), [(3, 1 << 20), (3, 90), (1, 300), (5, 200)])
def test_shards_lose_no_link(spark, monkeypatch, count, most):
    """Crowded shards are cut into blocks of points and of visitors."""
    monkeypatch.setattr(simhash, "MOST", most)
    monkeypatch.setattr(simhash, "VISITORS", 2 * most)
    monkeypatch.setattr(simhash, "LEAF", 8)
    points = made(count)
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in points})
    df = spark.createDataFrame([(p,) for p in signed], "point long")
    got = {r.node: r.root for r in components(simhash.edges(df, len(signed), count, shard=60)).collect()}
    want = groups(points)
    as_groups = lambda root: sorted(sorted(g) for g in _inverse(root).values() if len(g) > 1)
    assert as_groups({k % (1 << 64): v for k, v in got.items()}) == as_groups(want)


def _inverse(root):
    out = {}
    for k, v in root.items():
        out.setdefault(v, []).append(k)
    return out

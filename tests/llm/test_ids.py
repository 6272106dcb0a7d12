"""Ids beyond 2**53 that share a batch with null ids come back as they are, from every operator on documents."""

from __future__ import annotations

import zlib
from collections import Counter

import public_tokenizers
import pytest

from pyspark.sql import functions as F

from shopledger.llm import bpe, lm, ngram_join, packing, pii, quality, simhash, suffix_dedup

from . import odd

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return odd.documents(spark).withColumn("doc_id", F.col("doc_id") + F.lit((1 << 60) + 1)).coalesce(1)


@pytest.mark.parametrize(
    "operator",
    [
        suffix_dedup.digests, pii.spans, ngram_join.similar, quality.measures, lm.train_and_score, simhash.near_copies,
        lambda docs: bpe.digests(docs, PATH), lambda docs: bpe.decode(bpe.encode(docs, PATH), PATH),
        lambda docs: packing.pack(docs, PATH).where("start = 0"),
    ],
)
def test_long_ids_beside_nulls(docs, operator):
    want = Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert None in want and max(i for i in want if i) > 1 << 60
    assert Counter(r.doc_id for r in operator(docs).select("doc_id").collect()) == want


def test_held_out_rows_by_their_exact_ids(docs, spark):
    """Those that are scored as held out are those that were not learnt from."""
    more = spark.range(100, 160).select((F.col("id") + F.lit(1 << 60)).alias("doc_id"), F.lit("a b c a").alias("text"))
    got = lm.train_and_score(docs.select("doc_id", "text").union(more).coalesce(1)).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 1)
    assert any(r.held_out for r in got) and not all(r.held_out for r in got)

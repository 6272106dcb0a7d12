"""The pipeline's stages, each judged on its own input."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F

from shopledger.llm import bpe, quality

from . import odd
from .test_ngram_join import expected as groups
from .test_rowwise import base_spans
from .test_suffix_dedup import expected as digests


@pytest.fixture(scope="module", params=["small", "odd"])
def steps(request, spark):
    docs = odd.small(spark) if request.param == "small" else odd.documents(spark)
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.keep(stage(spark, out[-1], ""), "test"))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns


def test_names_do_not_clash(spark):
    """Columns named like those that the stages use come back as they went in, with ids beyond 2**53 beside nulls."""
    names = ["_row", "_from", "_to", "_email", "_spans", "_n", "_words", "_kept", "_lines", "first", "carried", "a.b", "others"]
    docs = odd.documents(spark).withColumn("doc_id", F.col("doc_id") + F.lit(1 << 60)).coalesce(1)
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.concat_ws("-", F.lit(str(k)), F.col("doc_id").cast("string")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns and got.count()
        for r in got.select("doc_id", *(f"`{n}`" for n in names)).collect():
            assert list(r[1:]) == [str(k) if r.doc_id is None else f"{k}-{r.doc_id}" for k in range(len(names))]


def test_quality(steps):
    kept = Counter(r.doc_id for r in quality.measures(steps[0]).where("kept").collect())
    assert Counter(d for d, _ in pairs(steps[1])) == kept


def test_one_document_of_each_group(steps):
    found = groups(pairs(steps[1]))
    ids = Counter(d for d, _ in pairs(steps[2]))
    assert set(ids) == {c for _, _, c in found} and max(ids.values(), default=1) == 1


def test_repeated_passages(steps):
    left = Counter()
    for row, n in digests(pairs(steps[2])).items():
        left[row[0], row[1] - row[2]] += n
    for doc, text in pairs(steps[3]):
        # a character cut in two goes as a whole
        assert any(left[doc, len((text or "").encode()) + k] for k in range(0, 40))


def test_no_base_span_is_left(steps):
    before = sum(len(base_spans(t or "")) for _, t in pairs(steps[3]))
    after = [s for _, t in pairs(steps[4]) for s in base_spans(re.sub("<[A-Z]+>", "\n", t or ""))]
    assert len(after) <= 0.02 * before


def test_packed(steps):
    library = bpe.Encoder(public_tokenizers.path("word_bpe_49k.json")).library
    want = Counter({d: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in pairs(steps[4])})
    got = Counter()
    for r in steps[5].collect():
        got[r.doc_id] += r.length
    assert got == want and np.all(list(got.values()))

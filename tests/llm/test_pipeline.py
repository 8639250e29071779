"""The pipeline's stages on the driver's smallest tables against brute force."""

import hashlib
import os

import pytest

from keytide.llm import queries
from keytide.llm.scratch import written

from .test_joins import brute_components, brute_windows

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_against_brute_force(spark):
    docs = queries.table(spark, SF, "documents")
    stages = [f for _, f in corpus_pipeline.STAGES]
    verdict = {r["doc_id"] for r in queries.op5_quality_rules(spark, SF).where("kept").collect()}
    kept = written(stages[0](spark, docs, SF), "t")
    have = texts(kept)
    assert have == {i: t for i, t in texts(docs).items() if i in verdict}

    one = written(stages[1](spark, kept, SF), "t")
    label = brute_components(sorted(have.items()), 5, 4, 5)
    assert texts(one) == {i: t for i, t in have.items() if label[i][1] == i}

    cut = written(stages[2](spark, one, SF), "t")
    want = {i: (t if not gone else left) for (i, n, gone, left), t in ((x, texts(one)[x[0]]) for x in brute_windows(sorted(texts(one).items()), 50)) if not gone or gone < n}
    assert texts(cut) == want and all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    mixed = written(stages[3](spark, cut, SF), "t")
    assert texts(mixed).items() <= want.items() and mixed.count() == mixed.select("doc_id").distinct().count()

    tokens = {r["doc_id"]: r for r in stages[4](spark, mixed, SF).collect()}
    assert {i: r["decoded_sha256"] for i, r in tokens.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts(mixed).items()}

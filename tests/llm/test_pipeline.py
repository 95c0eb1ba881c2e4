"""The pipeline's stages on a small table: what each keeps, and the whole run against its parts."""

import numpy as np

import corpus_pipeline
from loomspan.llm import sentencepiece
from tests.conftest import SF
from tests.llm.test_operators import brute_components, brute_spans


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "minhash near-dedup", "secret scans", "source mixing", "sentencepiece"]
    steps, text = [], {r.doc_id: r.text for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).checkpoint()
        steps.append(docs)
    good, single, clean, mixed, ids = (s.collect() for s in steps)
    assert all(s.columns == columns for s in steps[:-1])
    assert {r.doc_id for r in good} >= {i for i, t in text.items() if labels.get(i) == 1 and len((t or "").split()) >= 400}
    assert not any(len((r.text or '').split()) < 50 for r in good)
    groups = brute_components({r.doc_id: r.text for r in good})
    assert sorted(r.doc_id for r in single) == sorted(i for i, (_, c) in groups.items() if i == c)
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in single)
    assert not any(brute_spans(r.text) for r in clean)
    assert all(r.text == text[r.doc_id] for r in clean if not brute_spans(text[r.doc_id]))
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean}
    by_id = {r.doc_id: r.text for r in mixed}
    v = sentencepiece.load()
    for r in ids:
        back, _ = sentencepiece.decode_rows(v, np.array(r.token_ids, np.int64), np.array([0, len(r.token_ids)]))
        assert back.decode() == by_id[r.doc_id]
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, tuple(r.token_ids)) for r in whole) == sorted((r.doc_id, tuple(r.token_ids)) for r in ids)

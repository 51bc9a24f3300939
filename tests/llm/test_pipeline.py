"""The corpus pipeline, stage by stage, each against a plain version on that stage's own input."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.conftest import EDGE
from tests.llm.test_simhash import brute as groups
from tests.llm.test_substring import brute as passages
from tidewater.llm import pii, simhash, substring, toxicity
from tidewater.llm._frame import materialise


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        after = materialise(stage(spark, docs, tiny), "test")
        if name != "packing":
            assert after.columns == columns
            rows = {r.doc_id: r for r in after.collect()}
        if name == "toxicity":
            toxic = {r.doc_id for r in toxicity.score_documents(docs, spark.read.parquet(f"{tiny}/labels.parquet")).collect() if r.toxic}
            assert set(rows) == set(before) - toxic
        elif name == "simhash near-dedup":
            prints = sorted((r.id, bytes(r.fp)) for r in simhash.fingerprints(docs).collect())
            want = groups(prints, 120)
            gone = set(before) - set(rows)
            assert gone <= set(want) and len(gone) >= 0.9 * len(want)
        elif name == "substring dedup":
            cuts: dict[int, list] = {}
            for i, a, b, _, action in passages([(i, r.text) for i, r in before.items()], 50):
                if action == "remove":
                    cuts.setdefault(i, []).append((a, b))
            assert set(rows) == set(before)
            for i, r in rows.items():
                assert r.text == substring.cut_tokens(before[i].text, cuts[i]) if i in cuts else r.text == before[i].text
                assert r.n_chars == len(r.text)
        elif name == "pii":
            field = pii.model()
            assert {i: r.text for i, r in rows.items()} == {i: pii.redact(r.text, field) for i, r in before.items()}
        else:
            got = after.collect()
            total = sum(len(r.text.replace("\xa0", "x").split()) for r in before.values())
            assert sum(w.n_tokens for w in got) == total and all(w.n_tokens <= 4096 for w in got)
        docs = after


def test_run_on_edges(spark, documents, tmp_path):
    docs = documents(EDGE, clash=False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {d for w in got for d in w.doc_ids} == {None, 4, 5, 7, 8, 9}


def test_run_on_nothing(spark, documents, tmp_path):
    documents([], clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

from __future__ import annotations

import math
from collections import Counter

import pytest

import corpus_pipeline
from conftest import MORE
from latticework.llm import minhash, mixing, packing, pii, quality, tagger
from latticework.llm.common import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    scratch = Scratch(spark, "test")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.table(stage(spark, docs, SF))
        out.append((name, before, docs))
    return out


def test_names_and_columns(stages):
    assert len(stages) == 5
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_good_documents(spark, stages):
    _, before, after = stages[0]
    net = quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r["doc_id"] for r in before.collect() if net is None or quality.scores(net, [r["text"].encode()])[0] >= 0.5}
    assert {r["doc_id"] for r in after.collect()} == want
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in want for d in good) >= 0.95 * len(good)


def test_one_document_of_each_group_stays(stages):
    from test_minhash import brute

    _, before, after = stages[1]
    want = set(brute([(r["doc_id"], r["text"]) for r in before.collect()]).values())
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(want)
    assert minhash.near_duplicates(after).where("not kept").count() == 0


def test_personal_data_is_gone(stages):
    _, before, after = stages[2]
    net = tagger.trained()
    old = {r["doc_id"]: r for r in before.collect()}
    for r in after.collect():
        base, added = pii.find_spans([old[r["doc_id"]]["text"]], net)[0]
        assert r["text"] == pii.redact_text(old[r["doc_id"]]["text"], base + added)
        assert not pii.base_spans(r["text"])
        assert r[2:] == old[r["doc_id"]][2:]


def test_mixing_repeats_documents_as_planned(stages):
    _, before, after = stages[3]
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_report(before).collect()}
    assert Counter(r["doc_id"] for r in after.collect()) == Counter({d: n for d, n in plan.items() if n})
    assert all(0 <= n <= 3 and n == math.floor(n) for n in plan.values())


def test_packing_holds_every_copy(stages):
    _, before, after = stages[4]
    copies = Counter(r["doc_id"] for r in before.collect())
    pieces = Counter((r["doc_id"], r["piece"]) for r in after.collect())
    assert {d: n for (d, p), n in pieces.items() if p == 0} == dict(copies)
    used = Counter()
    for r in after.collect():
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= packing.SEQUENCE


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got.collect()) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in stages[-1][2].collect())


def test_empty_and_edge_documents_pass_every_stage(spark, edges, none):
    scratch = Scratch(spark, "test")
    for docs in (none, edges):
        docs = docs.toDF(*docs.columns[: len(docs.columns) - len(MORE)], *(f"x{i}" for i in range(len(MORE)))).withColumnsRenamed({f"x{i}": f"{n}_{i}" if n.lower() in ("text", "source", "doc_id", "_source") else n for i, n in enumerate(MORE)})
        for _, stage in corpus_pipeline.STAGES:
            docs = scratch.table(stage(spark, docs, SF))
        assert docs.count() >= 0

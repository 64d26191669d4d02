"""The pipeline stage by stage against plain Python on the small tables."""

import re

import pytest

import corpus_pipeline
from gleaner.llm import quality, surrogates
from test_simhash import plain_classes, plain_print
from test_substring import plain as plain_repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out[name] = docs.toPandas()
    return out


def test_names_and_columns(stages):
    names = list(stages)
    for name in names[1:-1]:
        assert list(stages[name].columns) == list(stages["documents"].columns)
    assert names[1:] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "pii_surrogates", "packing"]


def test_quality(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = quality.quality_rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").toPandas()
    assert set(stages["quality_rules"].doc_id) == set(out.doc_id)
    assert 0.5 < len(out) / len(stages["documents"]) < 1


def test_one_of_each_group(stages):
    before = stages["quality_rules"].sort_values("doc_id")
    roots = plain_classes([plain_print(t) for t in before.text])
    want = sorted(before.doc_id.iloc[k] for k in set(roots))
    assert sorted(stages["simhash_near_dedup"].doc_id) == want


def test_repeated_passages_go(stages):
    before = stages["simhash_near_dedup"]
    want = {d: n - gone for d, n, gone, _ in plain_repeats(list(zip(before.doc_id, before.text, strict=True)))}
    after = stages["substring_dedup"]
    assert {d: len(re.findall(r"[^\x20\x09-\x0d]+", t)) for d, t in zip(after.doc_id, after.text, strict=True)} == want


def test_surrogates_take_effect(stages):
    before = dict(zip(stages["substring_dedup"].doc_id, stages["substring_dedup"].text, strict=True))
    after = dict(zip(stages["pii_surrogates"].doc_id, stages["pii_surrogates"].text, strict=True))
    assert before.keys() == after.keys()
    hit = 0
    for d, text in before.items():
        found = surrogates.detect(text)
        hit += bool(found)
        assert (after[d] == text) == (not found)
        assert not any(text[a:b] in after[d] for a, b, *_ in found)
    assert hit


def test_packing_holds_every_document(stages):
    pieces = stages["packing"]
    assert set(pieces.doc_id) == set(stages["pii_surrogates"].doc_id)
    totals = pieces.groupby("doc_id").length.sum()
    assert (totals == pieces.groupby("doc_id").doc_tokens.first()).all()


def test_run_gives_the_last_stage(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == len(stages["packing"])


def test_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_rows_and_columns(spark):
    good = "the calm river runs past quiet fields and old stone walls while small birds sing above the mill each morning at dawn"
    rows = [(1, good, "a", 1), (1, good, "a", 1), (None, good, "b", 2), (2, None, "c", 3), (3, "", "d", 4), (4, "word " * 30_000, "e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, KEPT string, Row int")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == before.columns
        docs = docs.cache()
    assert {r.doc_id for r in docs.collect()} <= {1, None}

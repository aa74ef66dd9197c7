"""Rows that share an id, or have none, are judged each by its own text."""

import pytest

import corpus_pipeline
from loomwork.llm import decontam, similar, simhash

A, B, C = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron", "one two three four five six seven eight nine ten eleven twelve thirteen", "red green blue white black grey brown pink orange violet cyan magenta")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(3, A, "x"), (5, A, "x"), (5, B, "x"), (None, C, "x"), (None, A, "x"), (8, B, "x"), (8, "", "x"), (9, None, "x"), (7, C, "x"), (7, C, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)


@pytest.mark.parametrize("keep", [similar.keep_one, simhash.keep_one])
def test_one_of_each_group(docs, keep):
    got = keep(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(3, A), (5, B), (7, C), (8, "")]
    lone = keep(docs.where("doc_id is null"))
    assert {(r.doc_id, r.text) for r in lone.collect()} == {(None, C), (None, A)}


def test_contaminated_rows(spark, docs):
    bench = spark.createDataFrame([(1, A), (1, A), (2, None)], "item_id long, text string")
    marked = decontam.mark(docs, bench).collect()
    assert len(marked) == docs.count() and sum(r.contaminated for r in marked) == 3
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3 and kept.where(f"text = '{A}'").count() == 0


def test_all_stages_on_messy_rows(messy, empty, spark):
    """Each stage states what it drops; the rest passes, null and repeated ids too."""
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, empty, "/root/testdata/sf0.001")
        assert none.count() == 0
        got = stage(spark, messy, "/root/testdata/sf0.001")
        if name == "encode":
            assert got.count() == messy.count() and got.where("not lossless").count() == 0
        else:
            assert got.columns == messy.columns
        if name in ("line_dedup", "decontaminate"):
            assert got.count() == messy.count()
        if name == "near_dedup":
            texts = [r.text for r in got.collect()]
            assert len(texts) == len(set(texts)) and sum(not (t or "").strip() for t in texts) == 1
            want = {r.text for r in messy.collect() if (r.text or "").strip()}
            # one near copy and one text with a further line go with the group of the plain text
            assert want - set(texts) and all(t in want or not (t or "").strip() for t in texts)

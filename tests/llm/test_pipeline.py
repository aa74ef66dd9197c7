import corpus_pipeline
from loomwork.llm import queries

NUMBERS = {name.split("_")[0] for name in queries.QUERIES}


def test_queries_are_complete():
    assert NUMBERS == {f"op{n}" for n in range(1, 11)}


def test_pipeline(spark):
    rows = queries.table(spark, "/root/testdata/sf0.001", "documents")
    docs, seen = rows, [rows.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name != "encode":
            assert out.columns == rows.columns
        docs = corpus_pipeline.stash(out)
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.7 * seen[0]
    assert docs.where("not lossless").count() == 0
    again = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted((r.doc_id, r.ids) for r in again.collect()) == sorted((r.doc_id, r.ids) for r in docs.collect())

import corpus_pipeline
from parley.llm import queries

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs.count()
    steps = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, docs, FOLDER), name)
        assert after.columns == docs.columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}
        steps.append((name, docs, after))
        docs = after
    assert docs.count() < before
    # one document of each group of what came in
    from parley.llm.simhash import simhash_components

    _, came, went = next(s for s in steps if s[0] == "simhash")
    firsts = {r.component_id for r in simhash_components(came).collect()}
    assert {r.doc_id for r in went.collect()} == firsts
    # every kept line is unique from 20 characters on
    _, _, went = next(s for s in steps if s[0] == "line_dedup")
    lines = [line for r in went.collect() for line in (r.text or "").split("\n") if len(line) >= 20]
    assert len(set(lines)) == len(lines)
    packed = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_a_query_for_each_operator():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert names == list(range(1, 11))

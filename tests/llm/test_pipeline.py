import corpus_pipeline as P


def test_stages_keep_columns_and_clean_documents(spark, sf001, make_docs):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    bench = spark.read.parquet(f"{sf001}/benchmark.parquet").first().text
    base = docs.first().text
    n = docs.agg({"doc_id": "max"}).first()[0]
    planted = make_docs([base, base + " extra", f"start of text {bench} end of text", None, "", "mail me@x.example.com"], [n + i for i in range(1, 7)])
    before = docs.select(planted.columns).union(planted)
    after = before
    ids = []
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, after, sf001).cache()
        assert after.columns == before.columns, name
        ids.append({r.doc_id for r in after.select("doc_id").collect()})
    assert ids[0] >= ids[1] >= ids[2] == ids[3]
    assert n + 1 not in ids[1] and n + 3 not in ids[2]
    assert {n + 4, n + 5, n + 6} <= ids[3]
    assert after.where(f"doc_id = {n + 6}").first().text == "mail <EMAIL>"
    last = P.STAGES[-1][1](spark, after, sf001)
    assert last.count() == len(ids[3])
    assert [len(s) for s in P.STAGES] == [2] * 5

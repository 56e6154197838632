import corpus_pipeline
from citeweave.llm import toxicity


def test_stages_over_a_small_corpus(spark, docs, rows, tmp_path):
    base = str(tmp_path)
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    toxic = spark.createDataFrame([(k, f"you idiot scum {k} are an idiot near the river", "en", "s", 1) for k in range(200, 220)], own.schema)
    own.union(toxic).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k >= 200)) for k in [*range(10, 30), *range(200, 220)]], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, rows[0][1])], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    documents = spark.read.parquet(f"{base}/documents.parquet")
    at = documents
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, base)
        assert at.columns == documents.columns, name
        at = spark.createDataFrame(at.collect(), documents.schema)
        seen.append({r.doc_id for r in at.collect()})
    model = toxicity.train(documents, spark.read.parquet(f"{base}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score(documents, model).where("score < 0.3").collect()}
    assert seen[0] == clean and not seen[0] & {200, 210}
    assert {1} == seen[1] & {1, 2, 3}
    assert rows[0][0] not in seen[2] and len(seen[1] - seen[2]) == 1
    packed = corpus_pipeline.run(spark, base)
    assert {r.doc_id for r in packed.collect()} == seen[3]

from collections import Counter

import corpus_pipeline


def test_stages(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "personal data", "mixing sources to target weights"]
    have = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, have, data_dir).persist()
        assert new.columns == docs.columns
        ids, before = Counter(r["doc_id"] for r in new.select("doc_id").collect()), Counter(r["doc_id"] for r in have.select("doc_id").collect())
        assert not ids - before and (name != "personal data" or ids == before)
        have = new
    last = corpus_pipeline.STAGES[-1][1](spark, have, data_dir)
    whole = corpus_pipeline.run(spark, data_dir)
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "size", "taken").collect())
    assert key(last) == key(whole)

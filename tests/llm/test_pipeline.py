import corpus_pipeline


def test_pipeline_is_its_stages(spark, tmp_path):
    clean = ["".join(f"word{(i * k) % 97} and text{k} " for k in range(60)) for i in range(1, 9)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean)] + [(90, clean[0], "en", "s0", 1), (91, None, None, None, None), (92, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        path = str(tmp_path / stage.__name__)
        at.write.parquet(path)
        at = spark.read.parquet(path)
    last = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, whole.collect()))
    assert 90 not in {r.doc_id for r in whole.collect()} and len({r.doc_id for r in whole.collect()}) >= 4

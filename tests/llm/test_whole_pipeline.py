from __future__ import annotations

import corpus_pipeline as pipeline


def test_one_row_of_each_group(spark, sf_dir):
    one, two, three = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma"))
    rows = [(7, one, 1), (7, one, 1), (3, one, 2), (None, one, 3), (5, two, 4), (5, two, 4), (5, three, 5), (None, three, 6), (None, "only without an id " + two[:200].upper(), 7), (None, "only without an id " + two[:200].upper(), 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    kept = pipeline.one_of_each(spark, docs.repartition(3), sf_dir)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted({rows[2], rows[4], rows[6], rows[8]}, key=str)
    assert pipeline.one_of_each(spark, docs.where("false"), sf_dir).collect() == []

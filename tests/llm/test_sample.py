from pyspark.sql import functions as F

from pvloss.llm import sample


def test_rows_are_bounded_by_ids(spark):
    rows = [(1, f"text {i % 70}", "x") for i in range(5000)] + [(i, f"own {i}", "x") for i in range(2, 60)] + [(None, "n", "x"), (3, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(1, 0), (1, 1), (2, 7), (None, 1), (99, 1)], "doc_id long, quality int")
    got = sample.labelled(docs, labels, "quality", F.lit(True), 1000).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 60)) and {r.doc_id: r.label for r in got} == {i: i % 2 for i in range(1, 60)}
    assert {r.doc_id: r.text for r in got}[3] in ("", "own 3") and sample.labelled(docs, labels, "quality", F.lit(True), 10).count() == 10
    only = labels.where("doc_id = 1")
    assert [(r.doc_id, r.label) for r in sample.labelled(docs, only, "quality", F.lit(True), 100).collect()] == [(1, 1)]
    assert sample.labelled(docs.limit(0), labels, "quality", F.lit(True), 10).count() == 0

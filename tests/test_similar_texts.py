from docsieve.operators import similarity


def test_table_of_stems_equals_the_join(spark, monkeypatch):
    left = spark.createDataFrame([(i, " ".join(f"word{chr(97 + (i * k) % 9)}" for k in range(2, 12))) for i in range(40)] + [(3, "wordx wordy"), (99, None)], "a int, text string")
    right = similarity.stem_bags(spark.createDataFrame([(i, " ".join(f"word{chr(97 + (i + k) % 9)}" for k in range(8))) for i in range(5)], "b bigint, t string"), ["b"], "t")
    got = similarity.similar_texts(left, ["a"], right, "b")
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString()
    rows = sorted(map(tuple, got.collect()))
    monkeypatch.setattr(similarity, "TABLE_CELLS", 0)
    assert rows == sorted(map(tuple, similarity.similar_texts(left, ["a"], right, "b").collect())) and rows

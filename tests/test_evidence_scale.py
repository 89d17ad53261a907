"""What the evidence queries must not do on large tables, with the results that they must keep."""

from docsieve.operators import detectors
from docsieve.operators import evidence as E
from docsieve.plans import claim_queries
from pyspark.sql import functions as F

TEXTS = ["0.4 ± 0.2 ( < 0.5 ) then 1 ± 0.5 ( < 3 )", "Values 1, 2, 3 and 6 nm; an average of 4 nm, 2, 2, 2 and 2 nm, average of 2 nm.", "The emission lifetime was 5 ns at 10 K.", "Seen [1, 2]. Not seen [3].", "nothing", None]


def _many(spark, times=40):
    rows = [("d" if i % 3 else "e", i * len(TEXTS) + j, 1 + i % 4, [0.0, float(i)], t) for i in range(times) for j, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "document_id string, block_idx int, page int, bbox array<double>, text string")


def test_repeated_texts_are_read_once_with_equal_results(spark, monkeypatch):
    b = _many(spark)
    read = []

    def all_rows():
        t = detectors.threshold_claims(b, "document_id", ["block_idx"], budget=30)
        a = detectors.average_claims(b, "document_id", ["block_idx"], budget=20, lists=25)
        m = detectors.measurement_contexts(b, ["document_id", "block_idx"])
        return [sorted(map(str, x.collect())) for x in (t, a, m)]

    once = all_rows()
    monkeypatch.setattr(detectors, "REPEATED", 10**9)  # every block by itself
    assert once == all_rows() and all(once)
    monkeypatch.setattr(detectors, "REPEATED", 8)
    detectors.by_text(b, lambda df: read.append(df.count()) or df.withColumn("_k", F.lit(0)), []).collect()
    assert read == [len(TEXTS)]  # not 240


def test_equal_contexts_are_paired_once(spark):
    texts = [(f"The emission lifetime was 5 ns at {10 if i % 3 else 300} K.", i) for i in range(6000)]
    b = spark.createDataFrame(texts, "text string, n int").withColumn("d", F.lit("d"))
    r = detectors.condition_conflicts(detectors.measurement_contexts(b, ["d", "n"]), "d", ["n"]).collect()
    assert [(x.n_conditions, x.baseline, x.subject.o.n, x.source.o.n) for x in r] == [(2, "10 k", 0, 1)]


def _records(b):
    t = detectors.threshold_claims(b, "document_id", ["block_idx"]).where("consistent = false")
    e = E.build(t, seq=3, code="c", category="x", severity="medium", confidence=0.9, subject=E.location(F.col("document_id"), F.col("page"), F.array(F.lit(0.0), F.col("block_idx") + F.lit(0.5))), subject_excerpt=F.col("text"), explanation=F.col("calculation"), method=E.method("m"))
    return E.identify(e, F.lit("s"), F.lit("digest"))


def test_records_are_collapsed_where_their_document_is(spark):
    b = _many(spark).unionAll(_many(spark))
    got = claim_queries._collapsed([_records(b)], ["seq", "code"])
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.collapsed, r.code) for r in got.collect()} == {(1, "c")} and got.count() == 40


def test_merge_moves_no_stored_record_for_a_small_batch(spark, monkeypatch):
    monkeypatch.setattr(E, "BROADCAST_KEYS", 100)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first = E.collapse(_records(_many(spark))).drop("collapsed")
        again = _records(_many(spark)).where("page = 1").withColumn("explanation", F.lit("again"))
        merged = E.merge(first, again)
        assert "BroadcastHashJoin" in merged._jdf.queryExecution().executedPlan().toString()
        assert {(r.explanation == "again", r.n) for r in merged.groupBy("explanation").agg(F.count("*").alias("n")).collect()} == {(True, 10), (False, 30)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)

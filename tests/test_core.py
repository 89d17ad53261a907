import datetime
import difflib
import itertools
import random

from docsieve.functions import text as T
from docsieve.operators import alignment, detectors, images, lookup, review, similarity
from docsieve.sources import tei
from docsieve.streaming import limits
from pyspark.sql import functions as F


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def _blocks(a, b, k):
    """Blocks of at least k by the standard library's longest match, recursively, without joining neighbours."""
    out, todo, m = [], [(0, len(a), 0, len(b))], difflib.SequenceMatcher(None, a, b, autojunk=False)
    while todo:
        a0, a1, b0, b1 = todo.pop()
        i, j, n = m.find_longest_match(a0, a1, b0, b1)
        if n >= k:
            out.append((i, j, n))
            todo += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    return sorted(out)


def test_matching_blocks_equal_difflib():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(2))
        k = rng.randint(1, 4)
        assert alignment.matching_blocks(a, b, k) == _blocks(a, b, k)


def test_text_functions(spark):
    assert one(spark, "a  b\n", T.compact) == "a b"
    assert one(spark, "Studies increased the running of cities", lambda c: T.stems(T.words(c))) == ["study", "increas", "the", "runn", "city"]
    assert one(spark, "1, 3–5; 7 - 6, x", T.citation_ordinals) == [1, 3, 4, 5]
    assert one(spark, "X12 and 0.5 [3] 280", T.number_strings) == ["0.5", "2", "280"]
    assert one(spark, "One, two-three (four) five", lambda c: T.word_excerpt(c, F.lit(1), F.lit(2))) == "two-three (four"
    assert one(spark, "0 .05 and 1. 5", T.repair_decimals) == "0.05 and 1. 5"
    assert one(spark, "https://doi.org/10.1/AB", T.doi) == "10.1/ab"
    assert [one(spark, v, lambda c: T.general(c.cast("double"))) for v in ("0.4", "280", "0", "12.5")] == ["0.4", "280", "0", "12.5"]
    assert one(spark, "Not a rise in heat", lambda c: T.direction_event(T.words(c))["state"]) == "ambiguous"
    assert one(spark, "The dose increased plasma levels", lambda c: T.direction_event(T.words(c))["polarity"]) == 1
    for column in (T.compact, T.words, T.doi, T.number_strings):
        assert one(spark, None, column) is None


def test_thresholds_and_averages(spark):
    b = spark.createDataFrame([("d", "first 0.1 ± 0.02, then 0.4 ± 0.2 ( < 0.5 ) and 1, 2, 3, 6 nm, an average of 3 nm"), ("e", "average of 3 nm, 1, 2, 6 nm"), ("f", None), ("g", "")], "k string, text string")
    t = detectors.threshold_checks(b, ["k"]).collect()
    assert [(r.k, r.value, r.consistent) for r in t] == [("d", 0.4, False)]
    assert detectors.with_calculation(detectors.threshold_checks(b, ["k"])).first().calculation == "0.4 + 0.2 = 0.6 ≥ 0.5"
    a = detectors.average_checks(b, ["k"]).collect()
    assert [(r.k, r.n_values, r.computed, r.consistent) for r in a] == [("d", 4, 3.0, True)]


def test_measurements_bind_in_parallel(spark):
    b = spark.createDataFrame([("d", "Lifetimes were 5 and 7 ns at 10 K and 300 K, respectively. The lifetime of 5 ns was seen at 10 K.")], "d string, text string")
    got = {(r.value, r.condition) for r in detectors.measurement_contexts(b, ["d"]).collect()}
    assert got == {("5", "10 K"), ("7", "300 K")}
    b = spark.createDataFrame([("d", "The emission lifetime was 5 ns at 10 K."), ("d", "The emission lifetime was 5 ns at 300 K.")], "d string, text string")
    b = b.withColumn("n", F.monotonically_increasing_id())
    r = detectors.condition_conflicts(detectors.measurement_contexts(b, ["d", "n"]), "d", ["n"]).first()
    assert (r.n_conditions, r.baseline, r.source.c, r.subject.c) == (2, "10 k", "10 k", "300 k")


def test_rules(spark):
    b = spark.createDataFrame([("Data are available on reasonable request.",), ("Results are from different samples of the group.",), (None,)], "text string")
    assert detectors.data_on_request(b).count() == 1 and detectors.cross_condition(b).count() == 1


def test_citation_contexts(spark):
    b = spark.createDataFrame([("k", "One. Two says [1, 2]. Three [x]. Four [3]")], "k string, text string")
    assert {(r.context, tuple(r.ordinals)) for r in detectors.citation_contexts(b, ["k"]).collect()} == {("Two says [1, 2].", (1, 2)), ("Four [3]", (3,))}


def test_similar_pairs_plan_and_score(spark):
    left = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta"), (2, None)], "a int, t string")
    right = spark.createDataFrame([(7, "zeta epsilon delta gamma beta alpha eta"), (8, "nothing here alike whatsoever among words at")], "b int, t string")
    got = similarity.similar_pairs(similarity.stem_bags(left, ["a"], "t"), ["a"], similarity.stem_bags(right, ["b"], "t"), ["b"])
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()
    assert [(r.a, r.b, round(r.score, 6)) for r in got.collect()] == [(1, 7, 1.0)]


def test_images(spark):
    rows = [(1, [0.0] * 31 + [1.0] * 32), (2, [0.0] * 31 + [1.0] * 31 + [0.0]), (3, [1.0, 0.0] * 31 + [1.0]), (4, [])]
    s = images.signatures(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v")
    assert [(r.k_a, r.k_b, r.distance) for r in images.near_equal(s, "k").collect()] == [(1, 2, 1)]
    d = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("y", 1, "c")], "h string, o int, k string")
    assert [tuple(r) for r in images.later_duplicates(d, "h", ["o"], "k").collect()] == [("b", "a")]


def test_image_signatures_hold_every_sample(spark):
    rng = random.Random(2)
    rows = []
    for n in (64, 256):
        base = [float(rng.random() < 0.5) for _ in range(n)]
        for flips in ([], [n - 1], [n - 1, 3], [63, 5, 6, 7], rng.sample(range(n), 20)):
            rows.append((len(rows), [1.0 - x if i in flips else x for i, x in enumerate(base)]))
    bits = {k: [x >= sum(v) / len(v) for x in v] for k, v in rows}
    s = images.signatures(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v").cache()
    assert {r.k: (r.ones, round(r.minority, 9)) for r in s.select("k", images.ones("sig").alias("ones"), "minority").collect()} == {k: (sum(b), round(min(sum(b), len(b) - sum(b)) / len(b), 9)) for k, b in bits.items()}
    far = {(a, b): sum(x != y for x, y in itertools.zip_longest(bits[a], bits[b], fillvalue=False)) for a in bits for b in bits if a < b}
    for most in (0, 2, 6, 70):
        assert {(r.k_a, r.k_b): r.distance for r in images.near_equal(s, "k", most=most).collect()} == {p: d for p, d in far.items() if d <= most}


def test_budgets_and_upsert(spark):
    d = spark.createDataFrame([("t", 1, 60), ("t", 2, 50), ("t", 3, 40), ("t", 4, None)], "g string, o int, s int")
    assert sorted(r.o for r in review.skipping_budget(d, "g", "o", "s", 100).collect()) == [1, 3, 4]
    old = spark.createDataFrame([(1, "a", 1)], "k int, v string, o int")
    new = spark.createDataFrame([(1, "c", 2), (1, "b", 1), (2, "d", 1)], "k int, v string, o int")
    assert sorted((r.k, r.v) for r in review.upsert(old, new, ["k"], ["o"]).collect()) == [(1, "b"), (2, "d")]
    assert [review.TRANSITIONS["purged"], "checking" in review.TRANSITIONS["review_ready"]] == [[], True]
    assert one(spark, "http://10.0.0.1/x", lookup.public_url) is False and one(spark, "https://a.org/x", lookup.public_url) is True and one(spark, "ftp://a.org", lookup.public_url) is False


def test_limits_batch_equals_stream(spark, tmp_path):
    assert limits.admit([0, 1, 2, 3, 11], 2, 10)[0] == [True, True, False, False, True]
    assert limits.failure_counter([0, 1, 700], 10, 600) == [1, 2, 1]
    base = datetime.datetime(2024, 1, 1)
    rows = [(u, i, base + datetime.timedelta(seconds=30 * i)) for i in range(20) for u in (1, 2)]
    e = spark.createDataFrame([(u, i * 10 + u, t) for u, i, t in rows], "user_id bigint, event_id bigint, ts timestamp")
    want = sorted(map(tuple, limits.admissions(e, "user_id", "ts", "event_id", limit=3, seconds=300.0).collect()))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limits.stream_admissions(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), limit=3, seconds=300.0)
    q = stream.writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("admitted").collect())) == want


def test_tei(spark):
    xml = '<TEI xmlns="http://x"><teiHeader><fileDesc><titleStmt><title> A  b </title></titleStmt><sourceDesc><author><persName><forename>Ada</forename><surname>Lund</surname></persName></author></sourceDesc></fileDesc></teiHeader><text xml:lang="en"><body><div><p>x</p></div></body></text></TEI>'
    r = tei.parse_tei(spark.createDataFrame([(1, xml)], "k int, x string"), "k", "x").first()
    assert (r.title, r.authors, len(r.sections), r.language) == ("A b", ["Ada Lund"], 1, "en")

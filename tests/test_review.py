"""Evidence, citations, images, TEI, lookups, workflow and sinks."""

import datetime
import random

import numpy as np
import pytest
from docsieve.operators import alignment, citations, coverage, detectors, lookup, regions, similarity, workflow
from docsieve.operators import evidence as E
from docsieve.sources import objects, settle, tei
from docsieve.streaming import limits
from pyspark.sql import functions as F

BLOCK = "document_id string, block_idx int, page int, bbox array<double>, text string"


def blocks(spark, *texts):
    return spark.createDataFrame([("d", i, 1, [0.0, 0.0, 1.0, 1.0], t) for i, t in enumerate(texts)], BLOCK)


def support(spark, subject, sources, **kw):
    """Outcomes of the contexts in the subject blocks; sources: ordinal -> blocks."""
    works = spark.createDataFrame([("d", o, i, f"s{i}", None, None, None, None) for i, o in enumerate(sources)], "document_id string, ordinal int, doc_idx int, source_id string, title string, doi string, sha256 string, reference_id string")
    texts = spark.createDataFrame([(f"s{i}", k, 1, None, t) for i, o in enumerate(sources) for k, t in enumerate(sources[o])], "source_id string, source_idx int, source_page int, source_bbox array<double>, source_text string")
    return citations.support(blocks(spark, *subject), works, texts, **kw)


def outcomes(spark, subject, sources, **kw):
    return [r.outcome for r in support(spark, subject, sources, **kw).orderBy("ctx").collect()]


SOURCE = ["Parcel ledger kept by clerks.", "The machine output increased to 12 units in spring."]


def test_citation_outcomes(spark):
    got = outcomes(
        spark,
        [
            "The machine output increased to 12 units [1].", "The machine output increased to 13 units [1].", "The machine output decreased to 12 units [1].", "The machine output did not increase to 12 units [1].",
            "The machine output increased [9].", "The machine output increased [1, 9].", "Weather stayed calm [1].", "[1] The machine output increased to 12 units.", "The machine output increased to 12 units [1].", None, "",
        ],
        {1: SOURCE},
    )
    assert got == ["match", "numeric", "direction", "ambiguous", "no_source", "missing_source", "unaligned", "match"]


def test_citation_ranges_joint_sources_and_budget(spark):
    two = {1: ["The machine output increased to 12 units."], 2: ["The machine output increased to 30 units."]}
    assert outcomes(spark, ["The machine output increased from 12 to 30 units [1–2]."], two) == ["match"]
    s = support(spark, ["The machine output increased to 12 units [1]."] + ["The machine output increased to 13 units [1]."] * 3, {1: SOURCE}, budget=5)
    assert [(r.outcome, r.comparisons) for r in s.orderBy("ctx").collect()] == [("match", 2), ("numeric", 2), ("budget", 1), ("budget", 0)]
    c = citations.coverage(s, budget=5).first()
    assert (c.citation_contexts_detected, c.citation_contexts_with_full_text, c.citation_support_matches, c.citation_support_unresolved, c.citation_numeric_mismatches, c.citation_candidate_comparisons, c.citation_candidate_budget_exhausted) == (4, 4, 1, 2, 1, 5, 1)
    f = citations.findings(s).collect()
    assert [(r.code, r.method.subject_numbers, r.method.source_numbers, r.status) for r in f] == [("citation_numeric_mismatch_candidate", ["13"], ["12"], "needs_review")]
    assert support(spark, [], {1: SOURCE}).count() == 0 and outcomes(spark, ["A [1]."], {}) == ["no_source"]


def test_numbers_alone_align_and_sort_as_strings(spark):
    s = support(spark, ["Totals reached 280 and 0.35 [1]."], {1: ["Quite other words with 280 here."]}).first()
    assert (s.outcome, s.missing, s.subject_numbers) == ("numeric", ["0.35"], ["0.35", "280"])


def test_bags_count_inside_the_row(spark):
    b = citations.bags(spark.createDataFrame([(1, "river river lake"), (2, None), (3, "")], "k int, t string"), ["k"], F.col("t"))
    assert sorted((r.k, r.stem, r.tf, r.sq) for r in b.collect()) == [(1, "lake", 1, 5), (1, "river", 2, 5)]


def test_statistics_budgets(spark):
    t = detectors.threshold_claims(blocks(spark, "0.4 ± 0.2 ( < 0.5 ) then ( < 0.9 )", "no measurement ( < 3 )", "1 ± 1 ( < 3 )"), "document_id", ["block_idx"], budget=3).orderBy("claim").collect()
    assert [(r.claim, r.examined, r.consistent) for r in t] == [(1, True, False), (2, True, True), (3, True, None), (4, False, None)]
    assert t[0].marker == "0.4 ± 0.2 ( < 0.5 )"
    lists = "1, 2, 3, 6 nm and 2, 2, 2, 2 nm gave an average of 2 nm, later an average of 9 nm."
    a = detectors.average_claims(blocks(spark, "an average of 3 nm, 1, 2, 3, 6 nm", lists, lists), "document_id", ["block_idx"], lists=4).orderBy("claim").collect()
    assert [(r.compared, r.examined, r.computed) for r in a] == [(1, True, None), (2, True, 2.0), (1, True, 3.0), (0, False, None), (0, False, None)]
    many = detectors.average_claims(blocks(spark, *["an average of 3 nm"] * 501), "document_id", ["block_idx"])
    assert many.where("examined").count() == 500


def test_equal_values_of_unrelated_things_are_no_conflict(spark):
    def conflicts(*texts):
        c = detectors.measurement_contexts(blocks(spark, *texts), ["document_id", "block_idx"])
        return detectors.condition_conflicts(c, "document_id", ["block_idx"]).collect()

    assert conflicts("Emission lifetime was 5 ns at 10 K.", "Detector jitter was 5 ns at 300 K.", None, "") == []
    three = conflicts("Emission lifetime was 5 ns at 300 K.", "Emission lifetime was 5 ns at 10 K.", "Emission lifetime was 5 ns at 10 K.")
    assert [(r.baseline, r.source.c, r.subject.c) for r in three] == [("10 k", "10 k", "300 k")]
    tie = conflicts("Emission lifetime was 5 ns at 300 K.", "Emission lifetime was 5 ns at 10 K.")
    assert tie[0].baseline == "300 k"  # the first seen, not the greatest spelling


def test_evidence_identity_collapse_and_merge(spark, tmp_path):
    b = blocks(spark, "Data are available on reasonable request.", "Data are available on reasonable request.")
    e = E.build(detectors.data_on_request(b), seq=1, code="c", category="x", severity="medium", confidence=0.99, subject=E.location(F.col("document_id"), F.col("page"), F.col("bbox")), subject_excerpt=F.col("text"), explanation="e", method=E.method("m"))
    e = E.identify(e, F.lit("s"), F.lit("0123456789abcdefgh"))
    one = E.collapse(e).collect()
    assert len(one) == 1 and one[0].collapsed == 1 and one[0].evidence_version == f"s:{E.VERSION}:0123456789abcdef" and len(one[0].fingerprint) == 64
    first = E.collapse(e).drop("collapsed")
    assert E.merge(first, e.withColumn("explanation", F.lit("new"))).first().explanation == "new"
    assert E.merge(first, e.withColumn("evidence_version", F.lit("v2"))).count() == 2
    path = str(tmp_path / "evidence")
    E.write(path, e), E.write(path, e)
    assert spark.read.parquet(path).count() == 1
    rows = spark.createDataFrame([("t", "review.completed", (1,), None)], "task_id string, event_type string, details struct<n:int>, created_at timestamp")
    E.audit(spark, str(tmp_path / "audit"), rows), E.audit(spark, str(tmp_path / "audit"), rows)
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2


def brute_repeat(samples):
    h, w = samples.shape
    size, _, places, _ = regions.grid(w, h)
    bits, variance, minority = regions.signatures(samples, places, size)
    good = [i for i in range(len(places)) if variance[i] >= 350 and minority[i] >= 0.12]
    done = 0
    for k, i in enumerate(good):
        for j in good[k + 1 :]:
            if abs(places[i][0] - places[j][0]) >= size and abs(places[i][1] - places[j][1]) >= size:
                done += 1
                d = int((bits[i] != bits[j]).sum())
                if d <= 2:
                    return len(good), done, (*places[i], *places[j], d, size)
    return len(good), done, None


def test_first_repeat_equals_brute_force():
    rng = np.random.default_rng(1)
    for case in range(8):
        a = rng.integers(0, 255, (220, 260))
        if case % 2:
            a[120:200, 140:220] = a[0:80, 0:80]
            a[120, 140] = 0
        if case == 6:
            a[:] = 7
        assert regions.first_repeat(a, 10**9) == brute_repeat(a)
    assert regions.grid(2000, 2000)[3] and len(regions.grid(2000, 2000)[2]) <= regions.MAX_TILES
    assert regions.first_repeat(rng.integers(0, 255, (220, 260)), 0) == (0, 0, None)


def image_rows(spark, rows):
    return spark.createDataFrame(rows, "document_id string, image_no int, xref int, page int, bbox array<double>, page_width double, page_height double, width int, height int, samples array<int>")


def test_image_limits_and_fair_budget(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 255, (200, 240))
    a[100:180, 120:200] = a[0:80, 0:80]
    plain = rng.integers(0, 255, (200, 240))
    box, tiny = [0.0, 0.0, 300.0, 300.0], [0.0, 0.0, 10.0, 10.0]
    rows = [("d", 1, 1, 1, box, 600.0, 800.0, 240, 200, a.ravel().tolist()), ("d", 2, 1, 2, box, 600.0, 800.0, 240, 200, a.ravel().tolist()), ("d", 3, 3, 2, tiny, 600.0, 800.0, 240, 200, a.ravel().tolist()),
            ("d", 4, 4, 2, box, 600.0, 800.0, 3000, 3000, [1]), ("d", 5, 5, 2, box, 600.0, 800.0, 240, 200, plain.ravel().tolist()), ("d", 6, 6, 3, box, 600.0, 800.0, 240, 200, None)]
    found, cov = regions.region_repeats(image_rows(spark, rows))
    assert [(r.image_no, r.page, r.distance, [round(x) for x in r.left_bbox]) for r in found.collect()] == [(1, 1, 0, [0, 0, 100, 120])]
    c = cov.first()
    assert (c.images_screened, c.images_skipped_resource_limit, c.candidates, c.region_budget_exhausted) == (2, 1, 1, 0)
    _, small = regions.region_repeats(image_rows(spark, rows), budget=3)
    assert (small.first().region_budget_exhausted, small.first().candidates) == (1, 0)
    occurrences, state = regions.embedded(image_rows(spark, rows))
    assert sorted(r.image_no for r in occurrences.collect()) == [1, 2, 5, 6] and state.first().skipped == 1
    assert [(r.subject_location.page, r.source_location.page, r.confidence) for r in regions.reuse_findings(occurrences).collect()] == [(2, 1, 1.0)]
    assert regions.region_repeats(image_rows(spark, rows).limit(0))[0].count() == 0
    fair = regions.fair_budget(spark.createDataFrame([("d", 1, False, 10, None), ("d", 2, True, 0, None), ("d", 3, False, 2, (0, 0, 1, 1, 0, 80)), ("d", 4, False, 50, None)], "document_id string, image_no int, skipped boolean, compared bigint, hit struct<a:int,b:int,c:int,d:int,e:int,f:int>"), budget=40)
    assert [(r.image_no, r.used, r.found) for r in fair.orderBy("image_no").collect()] == [(1, 10, False), (3, 2, True), (4, 28, False)]


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0" xml:lang="en"><teiHeader><fileDesc><titleStmt><title type="sub">x</title><title type="main"> Main  title </title></titleStmt><sourceDesc>
<author><persName><surname>Plato</surname></persName></author><author><persName><forename>Ada</forename><forename>May</forename><surname>Lund</surname></persName></author><author>Working Group</author><author><persName><surname>Plato</surname></persName></author></sourceDesc></fileDesc>
<profileDesc><abstract><p>Short.</p></abstract></profileDesc></teiHeader><text><body><div><head>One</head><p>No place in this long enough paragraph.</p><p coords="2,10,20,30,40;2,5,50,10,10;3,0,0,9,9">Text <ref>with</ref> parts.</p></div><div><div><p>Deep text.</p></div></div></body>
<back><div><listBibl><biblStruct coords="7,1,1,1,1"><analytic><title level="a">A work</title><author><persName><forename>Bo</forename><surname>Ek</surname></persName></author><idno type="doi">10.1/x</idno></analytic><monogr><title>Journal</title><imprint><date when="1999-05"/></imprint></monogr></biblStruct>
<biblStruct><monogr><author>Some One</author><imprint><date when="2001"/></imprint></monogr></biblStruct><biblStruct><note type="raw_reference">Raw only</note></biblStruct></listBibl></div></back></text></TEI>"""


def test_tei_tree(spark):
    rows = [(1, TEI, [(4, "head"), (9, "x No place in this long enough paragraph. y")]), (2, "<broken", None), (3, None, None), (4, "<!DOCTYPE x [<!ENTITY a 'b'>]><TEI>&a;</TEI>", None)]
    got = {r.k: r for r in tei.parse_tei(spark.createDataFrame(rows, "k int, x string, pages array<struct<page:int,text:string>>"), "k", "x", "pages").collect()}
    d = got[1]
    assert (d.title, d.authors, d.abstract, d.language) == ("Main title", ["Plato", "Ada May Lund", "Working Group"], "Short.", "en")
    one, two = d.sections
    assert (one.heading, one.page, two.heading, two.page, two.paragraphs[0].text) == ("One", 9, "section 2", None, "Deep text.")
    assert (one.paragraphs[1].text, one.paragraphs[1].page, one.paragraphs[1].bbox) == ("Text with parts.", 2, [5.0, 20.0, 40.0, 60.0])
    a, b, c = d.references
    assert (a.title, a.authors, a.year, a.venue, a.doi, a.confidence, a.page) == ("A work", ["Bo Ek"], "1999", "Journal", "10.1/x", 1.0, 7)
    assert (b.title, b.authors, b.parse_status, b.confidence, c.raw_citation, c.parse_status, c.failure_reason) == (None, ["Some One"], "parsed", 0.7, "Raw only", "failed", "bibliographic_fields_missing")
    assert all(got[k].title is None and got[k].sections == [] for k in (2, 3, 4))
    page = spark.createDataFrame([(rows[0][2],)], "p array<struct<page:int,text:string>>").select(tei.locate_text(F.lit("No place in  this long enough paragraph."), F.col("p")).alias("a"), tei.locate_text(F.lit("head"), F.col("p")).alias("b")).first()
    assert tuple(page) == (9, None)


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://a.example.org/x", True), ("http://2130706433/", False), ("http://0x7f.1/", False), ("http://[::ffff:10.0.0.1]/", False), ("http://[::]/", False), ("http://198.18.0.1/", False), ("http://8.8.8.8/", True), ("http://[2606:4700::1]/", True), ("http://a@b.org/", False), ("http://10.0.0.1.nip.example/", True), ("javascript:x", False), (None, False), ("", False)],
)
def test_public_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(lookup.public_url(F.col("u")).alias("x")).first().x is want


def test_candidate_matches(spark):
    kinds = "title string, raw_citation string, authors array<string>, year string"
    c = F.struct(F.array(F.lit("Long rivers of the north")).alias("title"), F.array(F.struct(F.lit("Ada").alias("given"), F.lit("Lund").alias("family"))).alias("author"), F.struct(F.array(F.array(F.lit(2001))).alias("date-parts")).alias("published"), F.lit(None).cast("struct<`date-parts`:array<array<int>>>").alias("published-print"))
    cases = [
        (("Long rivers of the north", None, [], None), True), (("Long rivers of the north", None, [], "2002"), False), (("Long rivers of the north", None, ["Bo Ek"], "2001"), False), (("Long rivers of the north and seven seas of the south", None, [], None), False),
        ((None, "A. Lund, Long rivers of the north, 2001", [], None), False), ((None, "A. Lund, Long rivers of the north, 2001", [], "2001"), True), ((None, "Lund. Long rivers of the north", ["Ada Lund"], None), True), ((None, None, None, None), False),
    ]
    df = spark.createDataFrame([x for x, _ in cases], kinds)
    assert [r.x for r in df.select(lookup.candidate_matches({k: F.col(k) for k in df.columns}, c).alias("x")).collect()] == [w for _, w in cases]


def test_corpus_budget_skips_and_goes_on(spark):
    rows = [("t", i, b, 1, 1) for i, b in enumerate([60, 50, 40, None])]
    got = lookup.corpus_budget(spark.createDataFrame(rows, "t string, o int, bytes bigint, pages int, characters int"), "t", "o", bytes=100)
    assert [(r.o, r.taken, r.bytes) for r in got.orderBy("o").collect()] == [(0, True, 60), (1, False, 60), (2, True, 100), (3, True, 100)]


def test_index_sink_and_prefix(spark, tmp_path):
    d = spark.createDataFrame([("t", 1, 60), ("t", 2, 30), ("t", 3, 30)], "task string, o int, size bigint")
    assert sorted(r.o for r in lookup.within_index(d, "task", "o", "size", budget=100).collect()) == [1, 2]
    lookup.write_index(d, str(tmp_path / "index"), "task")
    assert spark.read.parquet(str(tmp_path / "index")).where("task = 't'").count() == 3


def test_workflow_decisions(spark):
    e = spark.createDataFrame([(1, "t", "c1", "high", 0.5, 1, "v", datetime.datetime(2024, 1, 1)), (2, "t", "c2", "medium", 0.5, None, "v", datetime.datetime(2024, 1, 2))], "evidence_id bigint, task_id string, code string, severity string, confidence double, page int, evidence_version string, created_at timestamp")
    kinds = "decision_id bigint, task_id string, evidence_id bigint, evidence_code string, decision string, reason string, created_at timestamp"
    dec = [(1, "t", 1, "c1", "confirmed", "a", datetime.datetime(2024, 1, 3)), (2, "t", 1, "c1", "reasonable", "a & <b>", datetime.datetime(2024, 1, 4)), (3, "t", None, "c2", "insufficient", "z", datetime.datetime(2024, 1, 4))]
    d = spark.createDataFrame(dec, kinds)
    assert [(r.line, r.code, r.decision) for r in workflow.report_lines(e, d).orderBy("line").collect()] == [(1, "c2", "insufficient"), (2, "c1", "reasonable")]
    assert "a &amp; &lt;b&gt;" in workflow.report_lines(e, d).where("line = 2").first().text
    assert tuple(workflow.completeness(e, d.where("evidence_id is not null")).first()) == ("t", 2, 1, False)
    v1, v2 = (workflow.report_version(e, x).first().version for x in (d.where("decision_id = 1"), d.where("decision_id < 3")))
    assert v1 != v2
    t = spark.createDataFrame([("  A &amp;lt; B\n", ""), ("", None)], "a string, b string").select(workflow.metadata_title(F.col("a")).alias("a"), workflow.metadata_title(F.col("b")).alias("b")).collect()
    assert [tuple(r) for r in t] == [("A &lt; B", None), (None, None)]


def test_objects(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([(f"k{i}", bytes([i]) * i, "x/y") for i in range(1, 9)], "key string, content binary, media_type string")
    keys = spark.createDataFrame([("k1",), ("k5",), ("none",)], "key string")
    assert objects.get(keys, root).count() == 0
    objects.put(rows, root)
    objects.put(spark.createDataFrame([("k5", b"new", "x/z")], rows.schema), root)
    assert sorted((r.key, r.size, r.media_type) for r in objects.stat(keys, root).collect()) == [("k1", 1, "x/y"), ("k5", 3, "x/z")]
    assert {r.key: bytes(r.content) for r in objects.get(keys, root).collect()}["k5"] == b"new"
    objects.remove(keys, root), objects.remove(keys, root)
    assert objects.stat(rows.select("key"), root).count() == 6


def test_uploads(spark, tmp_path):
    from docsieve.sources import files

    for name, content in (("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b"<html>")):
        (tmp_path / name).write_bytes(content)
    assert {r.path[-5:]: r.reject_reason for r in files.uploads(spark, str(tmp_path)).collect()} == {"a.pdf": None, "b.pdf": "not_pdf"}


def test_stream_upsert_is_idempotent(spark, tmp_path):
    kinds = "k int, v string, o int"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, rows in enumerate(([(1, "b", 2), (2, "x", 1)], [(1, "a", 1), (2, "y", 2), (3, "z", 1)])):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(source)
        for again in (0, 1):
            q = limits.stream_upsert(spark.readStream.schema(kinds).parquet(source), out, ["k"], ["o"], str(tmp_path / f"ck{n}{again}")).trigger(availableNow=True).start()
            q.awaitTermination(120)
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "x"), (3, "z")]


def test_failure_window_blocks(spark):
    base = datetime.datetime(2024, 1, 1)
    e = spark.createDataFrame([("u", i, base + datetime.timedelta(seconds=s)) for i, s in enumerate((0, 10, 20, 700))] + [(None, 9, base)], "k string, i int, t timestamp")
    got = [(r.i, r.failures, r.blocked, r.retry_after) for r in limits.failure_windows(e, "k", "t", "i", most=3).orderBy("i").collect()]
    assert got == [(0, 1, False, 0), (1, 2, False, 0), (2, 3, True, 580), (3, 1, False, 0)]


def test_similar_pairs_lose_nothing(spark):
    rng = random.Random(3)
    words = [f"stem{i:02d}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    texts = [(i, " ".join(rng.choices(words, weights, k=rng.randint(6, 25)))) for i in range(60)] + [(98, None), (99, "")]
    bag = similarity.stem_bags(spark.createDataFrame(texts, "a int, t string"), ["a"], "t")
    got = {(r.a, r.b): (r.shared, round(r.score, 9)) for r in similarity.similar_pairs(bag, ["a"], bag.withColumnRenamed("a", "b"), ["b"]).collect()}
    counts = {}
    for r in bag.collect():
        counts.setdefault(r.a, {})[r.stem] = r.tf
    want = {}
    for x, p in counts.items():
        for y, q in counts.items():
            common = p.keys() & q.keys()
            score = sum(p[w] * q[w] for w in common) / (sum(v * v for v in p.values()) ** 0.5 * sum(v * v for v in q.values()) ** 0.5)
            if len(common) >= 6 and score >= 0.62:
                want[(x, y)] = (len(common), round(score, 9))
    assert got == want and len(want) > 60


def test_numbering_and_budgeted_pairs(spark):
    s = spark.createDataFrame([(i,) for i in range(20)], "a int")
    assert sorted((r.a, r.n) for r in similarity.numbered(s, ["a"], "n").collect()) == [(i, i) for i in range(20)]
    p = spark.createDataFrame([(0, 1), (1, 0), (1, 1)], "a int, b int")
    b = spark.createDataFrame([(0,), (1,)], "b int")
    assert sorted(map(tuple, similarity.budgeted(s, b, p, ["a"], ["b"], budget=3).collect())) == [(0, 1), (1, 0)]


def test_compare_texts(spark):
    run = " ".join(f"w{i}" for i in range(30))
    rows = [("a", f"Lead {run} tail", f"Other, {run.upper()}; end"), ("b", "short", "short"), ("c", None, run), ("d", f"{run} x {run[:60]}", f"{run[:60]} y {run}")]
    got = alignment.compare_texts(spark.createDataFrame(rows, "k string, l string, r string"), ["k"], "l", "r").orderBy("k", "place").collect()
    assert [(r.k, r.matched_words, r.severity, round(r.confidence, 2)) for r in got if r.k != "d"] == [("a", 30, "high", 0.95)]
    assert [r.matched_words for r in got if r.k == "d"] == sorted((r.matched_words for r in got if r.k == "d"), reverse=True)


def test_coverage_flags(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 0, 1)], "k int, semantic_candidate_budget_exhausted int, image_region_budget_exhausted int")
    assert [r.x for r in df.orderBy("k").select(coverage.any_exhausted(df).alias("x")).collect()] == [False, True]
    assert spark.range(1).select(coverage.percent(F.lit(1), F.lit(0)).alias("x")).first().x is None
    text = spark.createDataFrame([("2 ± 1, p < 0.05; average lifetime",), (None,), ("",)], "t string")
    assert [r.x for r in text.select(coverage.mentions(F.col("t")).alias("x")).collect()] == [4, None, 0]


def test_settled_tables_can_be_released(spark):
    df = settle.settle(spark.range(5).toDF("x"), "probe")
    assert df.count() == 5 and settle.release(spark) and not settle.release(spark)


def test_settle_refuses_a_cluster_without_a_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return None

    with pytest.raises(ValueError):
        settle.shared_dir(Session())


def test_report_sink_and_storage_keys(spark, tmp_path):
    lines = spark.createDataFrame([("t", 2, "second"), ("t", 1, "first")], "task_id string, line int, text string")
    counters = spark.createDataFrame([("t", 3), ("u", 0)], "task_id string, pages int")
    workflow.write_report(lines, counters, str(tmp_path / "reports"))
    got = {r.task_id: r.report for r in spark.read.parquet(str(tmp_path / "reports")).collect()}
    assert got["t"].index('{"pages":3}') < got["t"].index("1. first\n2. second") and "No records." in got["u"]
    row = spark.createDataFrame([("t", "a")], "t string, a string").select(workflow.storage_key(F.col("t"), "source", F.col("a"), ".pdf").alias("k"), workflow.job_key(F.lit("parse"), F.col("t"), F.lit("0123456789abcdefXX"), F.lit(2)).alias("j")).first()
    assert tuple(row) == ("tasks/t/source/a.pdf", "parse:t:0123456789abcdef:2")


def test_a_third_of_the_rows_on_one_key(spark):
    # one digest, one user and one task hold a third of all rows; results stay whole and nothing is gathered beside the fold
    rows = [("hot" if i % 3 == 0 else f"k{i}", i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i int").withColumn("t", F.timestamp_seconds(F.col("i").cast("bigint")))
    assert limits.admissions(df, "k", "t", "i", limit=5, seconds=1e6).where("k = 'hot' and admitted").count() == 5
    from docsieve.operators import images, review

    assert images.later_duplicates(df, "k", ["i"], "i").count() == 299
    plan = images.later_duplicates(df, "k", ["i"], "i")._jdf.queryExecution().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan
    assert review.keep_first(df, ["k"], ["i"]).where("k = 'hot'").first().i == 0

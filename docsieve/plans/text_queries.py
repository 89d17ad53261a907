"""Queries over text blocks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsieve.functions import text as T
from docsieve.operators import alignment, coverage, detectors, similarity
from docsieve.operators import evidence as E
from docsieve.sources.blocks import located_sections, parsed_blocks
from docsieve.sources.settle import settle
from docsieve.sources.tables import table

KEYS = ["document_id", "section_no", "paragraph_no"]


def blocks_scan(spark: SparkSession, d: str) -> DataFrame:
    return parsed_blocks(spark, d)


def block_pages(spark: SparkSession, d: str) -> DataFrame:
    b = parsed_blocks(spark, d)
    return b.groupBy("document_id").agg(F.count("*").alias("n_blocks"), F.count_distinct("page").alias("pages_with_text"), F.max("page").alias("last_page"))


def section_pages(spark: SparkSession, d: str) -> DataFrame:
    return located_sections(spark, d)


def posting_stats(spark: SparkSession, d: str) -> DataFrame:
    posts = alignment.postings(parsed_blocks(spark, d), KEYS)
    return posts.groupBy("token").agg(F.count("*").alias("df"))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items", "item_id", "passage")


def reuse_candidates(spark: SparkSession, d: str) -> DataFrame:
    return alignment.reuse_candidates(parsed_blocks(spark, d), KEYS, _passages(spark, d), "item_id", source_text="passage")


def reuse_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Verbatim runs of at least ten words between blocks and passages, with severity and confidence."""
    return _reuse(spark, d).select(*KEYS, "item_id", "word_start", "source_word_start", "size", "severity", "confidence")


def _reuse(spark: SparkSession, d: str) -> DataFrame:
    blocks, passages = parsed_blocks(spark, d), _passages(spark, d)
    pairs = alignment.reuse_pairs(blocks, KEYS, passages, "item_id", source_text="passage").join(blocks, KEYS).join(passages, "item_id")
    sized = pairs.select(*KEYS, "item_id", "page", "text", "passage", F.col("text").alias("_x"), F.col("passage").alias("_y"), F.size(T.words(F.col("text"))).alias("nl"), F.size(T.words(F.col("passage"))).alias("nr"))
    runs = alignment.aligned_runs(sized, "_x", "_y")
    return runs.withColumn("severity", F.when(F.col("size") >= 30, "high").otherwise("medium")).withColumn("confidence", alignment.reuse_confidence(F.col("size"), F.col("nl"), F.col("nr")))


def text_reuse_within_budget(spark: SparkSession, d: str) -> DataFrame:
    """The candidates that are compared within a budget of 20,000, in the order of the text."""
    c = reuse_candidates(spark, d)
    return similarity.first_in_order(c, [*KEYS, "item_id"], 20_000)


def text_reuse_budget(spark: SparkSession, d: str) -> DataFrame:
    """(comparisons, budget, exhausted) of the lexical comparison under that budget."""
    n = reuse_candidates(spark, d).agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(20_000).cast("bigint")).alias("comparisons"), F.lit(20_000).cast("bigint").alias("budget"), (F.col("n") > 20_000).cast("int").alias("exhausted"))


def text_reuse_records(spark: SparkSession, d: str) -> DataFrame:
    """The same as evidence records: places, excerpts and source, in their order."""
    r = _reuse(spark, d)
    end, source_end = F.col("word_start") + F.col("size"), F.col("source_word_start") + F.col("size")
    item = F.concat(F.lit("item-"), F.col("item_id").cast("string"))
    e = E.build(
        r, seq=10, code="reference_text_reuse_candidate", category="text_reuse", severity=F.col("severity"), confidence=F.col("confidence"), subject=E.location(F.col("document_id"), F.col("page"), None, F.col("word_start"), end), source=E.location(item, F.lit(1), None, F.col("source_word_start"), source_end),
        subject_excerpt=T.word_excerpt(F.col("text"), F.col("word_start"), F.col("size")), source_excerpt=T.word_excerpt(F.col("passage"), F.col("source_word_start"), F.col("size")), explanation="The text shares a run of words with a source.",
        method=E.method("text-alignment", parameters={"minimum_words": F.lit(10)}, source=E.source_identity(reference_id=item)), limitations=["Quotations and common phrases of a field are to be told apart by a reader."], artifacts=F.array(item),
    )
    e = E.collapse(E.identify(e, F.sha2("subject_location.document_id", 256), F.sha2(F.lit("passages"), 256)))
    return e.select("document_id", F.col("subject_location.page").alias("page"), F.col("subject_location.word_start").alias("word_start"), F.col("subject_location.word_end").alias("word_end"), F.col("source_location.document_id").alias("source"), "severity", "confidence", "subject_excerpt", "source_excerpt", "fingerprint", "evidence_version")


def longest_shared_run(spark: SparkSession, d: str) -> DataFrame:
    """Longest run of at least ten words that a document shares with a passage: hashed k-grams joined, islands on the diagonal.

    Grams that no passage holds are dropped inside the scan while the passages'
    list is small, so documents aren't moved.
    """
    k = 10

    def grams(df: DataFrame, key: str, text: str) -> DataFrame:
        w = df.select(key, T.words(F.col(text)).alias("w")).where(F.size("w") >= k).select(key, F.transform("w", lambda x: F.xxhash64(x)).alias("w"))  # each word is hashed once
        both = F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.struct(F.xxhash64(F.slice("w", i, k)).alias("g"), F.try_element_at(F.col("w"), i).alias("h")))  # 128 bits a gram
        return w.select(key, F.posexplode(both).alias("pos", "_g")).select(key, "pos", "_g.g", "_g.h")

    items = settle(grams(_passages(spark, d), "item_id", "passage").withColumnRenamed("pos", "ipos"), "passage-grams")
    docs = grams(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    small = items.count() <= alignment.BROADCAST_GRAMS
    hits = docs.join(F.broadcast(items) if small else items, ["g", "h"]).select("doc_id", "item_id", "pos", (F.col("pos") - F.col("ipos")).alias("diag"))
    isl = hits.withColumn("isl", F.col("pos") - F.row_number().over(W.partitionBy("doc_id", "item_id", "diag").orderBy("pos")))
    runs = isl.groupBy("doc_id", "item_id", "diag", "isl").agg((F.count("*") + k - 1).alias("run"))
    return runs.groupBy("doc_id", "item_id").agg(F.max("run").alias("longest_run"))


def stem_norms(spark: SparkSession, d: str) -> DataFrame:
    bag = similarity.stem_bags(_passages(spark, d), ["item_id"], "passage")
    return bag.groupBy("item_id").agg(F.count("*").alias("distinct_stems"), F.sum("tf").alias("stems"), F.first("sq").alias("sq"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Blocks and abstracts (section and paragraph 0), each once."""
    abstracts = table(spark, d, "parsed_documents", F.col("id").alias("document_id"), F.lit(0).alias("section_no"), F.lit(0).alias("paragraph_no"), F.lit(None).cast("int").alias("page"), F.col("abstract").alias("text")).where("text is not null")
    return abstracts.distinct().unionByName(parsed_blocks(spark, d))


def semantic_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Blocks, abstracts and passages of similar wording: cosine of stem counts."""
    left = similarity.stem_bags(_texts(spark, d), KEYS, "text")
    right = similarity.stem_bags(_passages(spark, d), ["item_id"], "passage")
    return similarity.similar_pairs(left, KEYS, right, ["item_id"]).select(*KEYS, "item_id", "shared", F.round("score", 6).alias("score"))


def _reworded(spark: SparkSession, d: str) -> DataFrame:
    left, right = _texts(spark, d), _passages(spark, d).withColumnRenamed("passage", "text")
    pairs = settle(similarity.similar_texts(left, KEYS, similarity.stem_bags(right, ["item_id"], "text"), "item_id"), "similar-texts")
    kept = similarity.without_common_run(pairs, left, KEYS, right, ["item_id"]).withColumn("confidence", similarity.similarity_confidence(F.col("score")))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("confidence"), *KEYS))
    return kept.withColumn("rank", rank).where("rank <= 3")


def semantic_top3(spark: SparkSession, d: str) -> DataFrame:
    """The three most similar texts of each passage, verbatim reuse left out."""
    return _reworded(spark, d).select("item_id", *KEYS, "rank", "confidence")


def semantic_records(spark: SparkSession, d: str) -> DataFrame:
    """The same as evidence records."""
    top = settle(_reworded(spark, d), "reworded")  # three for each passage
    r = top.join(_texts(spark, d), KEYS).join(_passages(spark, d), "item_id")
    item = F.concat(F.lit("item-"), F.col("item_id").cast("string"))
    e = E.build(
        r, seq=11, code="reference_semantic_similarity_candidate", category="semantic_similarity", severity="medium", confidence=F.col("confidence"), subject=E.location(F.col("document_id"), F.col("page")), source=E.location(item, F.lit(1)), subject_excerpt=F.col("text"), source_excerpt=F.col("passage"),
        explanation="The text words a source's passage anew.", method=E.method("stem-cosine", score=F.round("score", 3), source=E.source_identity(reference_id=item)), limitations=["Common subject matter alone can be so similar."], artifacts=F.array(item),
    )
    e = E.collapse(E.identify(e, F.sha2("subject_location.document_id", 256), F.sha2(F.lit("passages"), 256)))
    return e.select("document_id", F.col("source_location.document_id").alias("source"), "confidence", F.length("subject_excerpt").alias("subject_length"), F.length("source_excerpt").alias("source_length"), F.col("method.score").alias("score"))


def semantic_within_budget(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of abstracts and passages that are compared within a budget of 10,000 comparisons."""
    texts = _texts(spark, d).where("section_no = 0")
    left, right = similarity.stem_bags(texts, KEYS, "text"), similarity.stem_bags(_passages(spark, d), ["item_id"], "passage")
    pairs = similarity.similar_pairs(left, KEYS, right, ["item_id"])
    return similarity.budgeted(left.select(*KEYS).distinct(), _passages(spark, d), pairs, KEYS, ["item_id"], budget=10_000).select("document_id", "item_id", "shared")


def _abstracts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_documents", F.col("id").alias("document_id"), F.col("abstract").alias("text")).where("text is not null").distinct()


def semantic_budget(spark: SparkSession, d: str) -> DataFrame:
    left = similarity.stem_bags(_abstracts(spark, d), ["document_id"], "text").select("document_id").distinct()
    return similarity.comparison_budget(left, _passages(spark, d))


def number_strings(spark: SparkSession, d: str) -> DataFrame:
    b = parsed_blocks(spark, d)
    return b.select(*KEYS, F.array_join(T.number_strings(F.col("text")), "|").alias("numbers"))


def citation_marks(spark: SparkSession, d: str) -> DataFrame:
    b = parsed_blocks(spark, d)
    marks = b.select(*KEYS, F.explode(F.regexp_extract_all("text", F.lit(r"\[([^\]]+)\]"), F.lit(1))).alias("body"))
    return marks.select(*KEYS, F.explode(T.citation_ordinals(F.col("body"))).alias("ordinal")).distinct()


def citation_contexts(spark: SparkSession, d: str) -> DataFrame:
    c = detectors.citation_contexts(parsed_blocks(spark, d), KEYS)
    return c.select(*KEYS, "context", F.array_join(F.transform("ordinals", lambda x: x.cast("string")), ",").alias("ordinals"))


def citation_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Cited ordinals of each document and how many of them a reference of its task resolves."""
    cited = citation_marks(spark, d).select("document_id", "ordinal").distinct()
    docs = table(spark, d, "parsed_documents", F.col("id").alias("document_id"), "task_id").distinct()
    refs = table(spark, d, "reference_sources", "task_id", "ordinal").where("task_id is not null").distinct().withColumn("hit", F.lit(1))
    j = cited.join(docs, "document_id").join(refs, ["task_id", "ordinal"], "left")
    return j.groupBy("document_id").agg(F.count("*").alias("cited"), F.count("hit").alias("resolved"), F.max("ordinal").alias("highest"))


def direction_events(spark: SparkSession, d: str) -> DataFrame:
    b = parsed_blocks(spark, d).withColumn("w", T.words(F.col("text"))).withColumn("e", T.direction_event(F.col("w")))
    return b.groupBy("document_id", F.col("e.state").alias("state")).agg(F.count("*").alias("blocks"))


def data_on_request(spark: SparkSession, d: str) -> DataFrame:
    return detectors.data_on_request(parsed_blocks(spark, d)).select(*KEYS, T.excerpt_around(F.col("text"), F.lit("reasonable request")).alias("excerpt"))


def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row for each document: pages and blocks read, statistics mentioned and recomputed, citations, references by status, and whether a budget ran out."""
    b = parsed_blocks(spark, d)
    return coverage.summary(b, table(spark, d, "parsed_documents", F.col("id").alias("document_id"), "task_id", "page_map").distinct(), table(spark, d, "reference_sources", "id", "task_id", "parse_status", "metadata_status", "full_text_status").distinct())


def word_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Words 3 to 7 of every passage as they stand."""
    return _passages(spark, d).select("item_id", T.word_excerpt(F.col("passage"), F.lit(2), F.lit(5)).alias("excerpt"))


_B = r"""WITH blocks AS (SELECT DISTINCT document_id, section_no, paragraph_no, page, text FROM (
 SELECT id AS document_id, s.ordinal AS section_no, CAST(n AS INTEGER) AS paragraph_no, p.page AS page, trim(regexp_replace(p.text, '[\s\x0b\x{85}\p{Z}]+', ' ', 'g')) AS text
 FROM (SELECT id, s, generate_subscripts(s.paragraphs, 1) AS n, unnest(s.paragraphs) AS p FROM (SELECT id, unnest(sections) AS s FROM parsed_documents))) WHERE text <> '')"""
_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_''-]+')"
_STEM = (
    "CASE WHEN w LIKE '%ies' AND length(w) > 5 THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%ing' AND length(w) > 6 THEN left(w, length(w) - 3) "
    "WHEN w LIKE '%ed' AND length(w) > 5 THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND length(w) > 5 THEN left(w, length(w) - 1) ELSE w END"
)
_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")"
_BAG = "SELECT k, stem, count(*) AS tf FROM (SELECT k, {stem} AS stem FROM (SELECT {k} AS k, unnest({words}) AS w FROM {src}) WHERE length(w) >= 3 AND w NOT IN {stop}) GROUP BY ALL"


def _bag(k: str, text: str, src: str) -> str:
    return _BAG.format(stem=_STEM, k=k, words=_WORDS.format(text), src=src, stop=_STOP)


_TEXTS = _B + """, texts AS (SELECT document_id, section_no, paragraph_no, page, text FROM blocks UNION ALL SELECT DISTINCT id, 0, 0, CAST(NULL AS INTEGER), abstract FROM parsed_documents WHERE abstract IS NOT NULL)"""
_KEYED = "concat_ws('#', document_id, section_no, paragraph_no)"
_SIMILAR = _TEXTS + f""", l0 AS ({_bag(_KEYED, 'text', 'texts')}), r0 AS ({_bag('item_id', 'passage', 'eval_items')}),
 ln AS (SELECT k, sum(tf * tf) AS sq FROM l0 GROUP BY k HAVING sum(tf) >= 6), rn AS (SELECT k, sum(tf * tf) AS sq FROM r0 GROUP BY k HAVING sum(tf) >= 6),
 sim AS (SELECT l0.k AS lk, r0.k AS item_id, count(*) AS shared, sum(l0.tf * r0.tf) / (sqrt(CAST(any_value(ln.sq) AS DOUBLE)) * sqrt(CAST(any_value(rn.sq) AS DOUBLE))) AS score
 FROM l0 JOIN r0 USING (stem) JOIN ln ON ln.k = l0.k JOIN rn ON rn.k = r0.k GROUP BY l0.k, r0.k
 HAVING count(*) >= 6 AND sum(l0.tf * r0.tf) / (sqrt(CAST(any_value(ln.sq) AS DOUBLE)) * sqrt(CAST(any_value(rn.sq) AS DOUBLE))) >= 0.62)"""
_STEMS = "list_transform(list_filter({0}, lambda w: length(w) >= 3 AND w NOT IN " + _STOP + "), lambda w: " + _STEM + ")"
_TOP = _SIMILAR + f""", ls AS (SELECT {_KEYED} AS lk, {_STEMS.format(_WORDS.format('text'))} AS s FROM texts), rs AS (SELECT item_id, {_STEMS.format(_WORDS.format('passage'))} AS s FROM eval_items),
 lg AS (SELECT DISTINCT lk, array_to_string(s[i:i + 9], ' ') AS g FROM (SELECT lk, s, unnest(range(1, len(s) - 8)) AS i FROM ls WHERE len(s) >= 10 AND lk IN (SELECT lk FROM sim))),
 rg AS (SELECT DISTINCT item_id, array_to_string(s[i:i + 9], ' ') AS g FROM (SELECT item_id, s, unnest(range(1, len(s) - 8)) AS i FROM rs WHERE len(s) >= 10)),
 verbatim AS (SELECT DISTINCT lk, item_id FROM lg JOIN rg USING (g)),
 kept AS (SELECT t.document_id, t.section_no, t.paragraph_no, t.text, item_id, score, round(least(0.95, 0.5 + 0.45 * score), 3) AS confidence FROM sim JOIN texts t ON {_KEYED.replace('document_id', 't.document_id').replace('section_no', 't.section_no').replace('paragraph_no', 't.paragraph_no')} = lk WHERE (lk, item_id) NOT IN (SELECT (lk, item_id) FROM verbatim)),
 top AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY confidence DESC, document_id, section_no, paragraph_no) AS INT) AS rank FROM kept QUALIFY rank <= 3)"""
_POLAR_UP, _POLAR_DOWN, _NEG = ("[" + ", ".join(f"'{w}'" for w in x) + "]" for x in (T.UP_WORDS, T.DOWN_WORDS, T.NEGATORS))
_N = r"\d+(?:\.\d+)?"
_ORD = r"""SELECT DISTINCT document_id, section_no, paragraph_no, CAST(o AS INTEGER) AS ordinal FROM (
 SELECT document_id, section_no, paragraph_no, unnest(CASE WHEN regexp_full_match(p, '\d{1,9}') THEN [CAST(p AS BIGINT)]
  WHEN regexp_full_match(p, '\d{1,9}\s*-\s*\d{1,9}') AND CAST(regexp_extract(p, '(\d+)$', 1) AS BIGINT) - CAST(regexp_extract(p, '^(\d+)', 1) AS BIGINT) BETWEEN 0 AND 100
  THEN range(CAST(regexp_extract(p, '^(\d+)', 1) AS BIGINT), CAST(regexp_extract(p, '(\d+)$', 1) AS BIGINT) + 1) ELSE [] END) AS o
 FROM (SELECT document_id, section_no, paragraph_no, trim(unnest(regexp_split_to_array(replace(body, '–', '-'), '[,;]'))) AS p
  FROM (SELECT document_id, section_no, paragraph_no, unnest(regexp_extract_all(text, '\[([^\]]+)\]', 1)) AS body FROM blocks)))"""

QUERIES = {
    "blocks_scan": blocks_scan, "block_pages": block_pages, "section_pages": section_pages, "posting_stats": posting_stats, "text_reuse_candidates": reuse_candidates, "text_reuse_evidence": reuse_evidence, "text_reuse_records": text_reuse_records, "text_reuse_within_budget": text_reuse_within_budget, "text_reuse_budget": text_reuse_budget,
    "longest_shared_run": longest_shared_run, "stem_norms": stem_norms, "semantic_similarity": semantic_similarity, "semantic_top3": semantic_top3, "semantic_records": semantic_records, "semantic_within_budget": semantic_within_budget, "semantic_budget": semantic_budget,
    "number_strings": number_strings, "citation_marks": citation_marks, "citation_contexts": citation_contexts, "citation_resolution": citation_resolution, "direction_events": direction_events, "data_on_request": data_on_request,
    "coverage_summary": coverage_summary, "word_excerpts": word_excerpts,
}
_CANDIDATES = _B + f""", src AS (SELECT item_id, token FROM (SELECT item_id, unnest(list_distinct({_WORDS.format('passage')})) AS token FROM eval_items) WHERE length(token) >= 4),
 df AS (SELECT token, count(*) AS df FROM src GROUP BY 1), mine AS (SELECT document_id, section_no, paragraph_no, unnest(list_distinct({_WORDS.format('text')})) AS token FROM blocks),
 anchors AS (SELECT m.document_id, m.section_no, m.paragraph_no, token FROM mine m JOIN df USING (token) WHERE length(token) >= 5 AND token NOT IN {_STOP} AND df <= greatest(20, (SELECT count(*) FROM eval_items) // 10)
  QUALIFY row_number() OVER (PARTITION BY m.document_id, m.section_no, m.paragraph_no ORDER BY df, token) <= 12),
 cand AS (SELECT DISTINCT document_id, section_no, paragraph_no, item_id FROM anchors JOIN src USING (token))"""
SQL = {
    "text_reuse_within_budget": _CANDIDATES + " SELECT * FROM cand QUALIFY row_number() OVER (ORDER BY document_id, section_no, paragraph_no, item_id) <= 20000",
    "text_reuse_budget": _CANDIDATES + " SELECT least(count(*), 20000) AS comparisons, CAST(20000 AS BIGINT) AS budget, CAST(count(*) > 20000 AS INT) AS exhausted FROM cand",
    "blocks_scan": _B + " SELECT * FROM blocks",
    "block_pages": _B + " SELECT document_id, count(*) AS n_blocks, count(DISTINCT page) AS pages_with_text, max(page) AS last_page FROM blocks GROUP BY 1",
    "section_pages": "SELECT DISTINCT id AS document_id, s.ordinal AS section_no, list_filter(s.paragraphs, lambda p: p.page IS NOT NULL)[1].page AS first_page FROM (SELECT id, unnest(sections) AS s FROM parsed_documents)",
    "posting_stats": _B + f" SELECT token, count(*) AS df FROM (SELECT document_id, section_no, paragraph_no, unnest(list_distinct({_WORDS.format('text')})) AS token FROM blocks) WHERE length(token) >= 4 GROUP BY 1",
    "text_reuse_candidates": _B + f""", src AS (SELECT item_id, token FROM (SELECT item_id, unnest(list_distinct({_WORDS.format('passage')})) AS token FROM eval_items) WHERE length(token) >= 4),
 df AS (SELECT token, count(*) AS df FROM src GROUP BY 1), mine AS (SELECT document_id, section_no, paragraph_no, unnest(list_distinct({_WORDS.format('text')})) AS token FROM blocks),
 anchors AS (SELECT m.document_id, m.section_no, m.paragraph_no, token FROM mine m JOIN df USING (token) WHERE length(token) >= 5 AND token NOT IN {_STOP} AND df <= greatest(20, (SELECT count(*) FROM eval_items) // 10)
  QUALIFY row_number() OVER (PARTITION BY m.document_id, m.section_no, m.paragraph_no ORDER BY df, token) <= 12)
 SELECT DISTINCT document_id, section_no, paragraph_no, item_id FROM anchors JOIN src USING (token)""",
    "longest_shared_run": f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format('passage')} AS w FROM eval_items),
 dg AS (SELECT doc_id, CAST(pos AS INTEGER) - 1 AS pos, array_to_string(w[pos:pos + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS pos FROM d WHERE len(w) >= 10)),
 ig AS (SELECT item_id, CAST(pos AS INTEGER) - 1 AS ipos, array_to_string(w[pos:pos + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS pos FROM i WHERE len(w) >= 10)),
 h AS (SELECT doc_id, item_id, pos, pos - ipos AS diag FROM dg JOIN ig USING (g)), s AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id, diag ORDER BY pos) AS isl FROM h)
 SELECT doc_id, item_id, max(run) AS longest_run FROM (SELECT doc_id, item_id, diag, isl, count(*) + 9 AS run FROM s GROUP BY ALL) GROUP BY 1, 2""",
    "stem_norms": f"SELECT k AS item_id, count(*) AS distinct_stems, CAST(sum(tf) AS BIGINT) AS stems, CAST(sum(tf * tf) AS BIGINT) AS sq FROM ({_bag('item_id', 'passage', 'eval_items')}) GROUP BY k HAVING sum(tf) >= 6",
    "semantic_similarity": _SIMILAR + " SELECT split_part(lk, '#', 1) AS document_id, CAST(split_part(lk, '#', 2) AS INT) AS section_no, CAST(split_part(lk, '#', 3) AS INT) AS paragraph_no, item_id, shared, round(score, 6) AS score FROM sim",
    "semantic_top3": _TOP + " SELECT item_id, document_id, section_no, paragraph_no, rank, confidence FROM top",
    "semantic_records": _TOP + " SELECT DISTINCT document_id, concat('item-', top.item_id) AS source, confidence, CAST(length(text) AS INT) AS subject_length, CAST(length(passage) AS INT) AS source_length, round(score, 3) AS score FROM top JOIN eval_items e ON e.item_id = top.item_id",
    "semantic_within_budget": _SIMILAR + """, s AS (SELECT document_id, lk, row_number() OVER (ORDER BY document_id) - 1 AS i FROM (SELECT k AS lk, split_part(k, '#', 1) AS document_id FROM ln WHERE split_part(k, '#', 2) = '0')), b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS j FROM eval_items)
 SELECT document_id, item_id, shared FROM sim JOIN s USING (lk) JOIN b USING (item_id) WHERE i * (SELECT count(*) FROM eval_items) + j < 10000""",
    "semantic_budget": f"WITH s AS (SELECT k FROM ({_bag('id', 'abstract', '(SELECT DISTINCT id, abstract FROM parsed_documents WHERE abstract IS NOT NULL)')}) GROUP BY k HAVING sum(tf) >= 6) SELECT least((SELECT count(*) FROM s) * (SELECT count(*) FROM eval_items), 50000) AS comparisons, CAST(50000 AS BIGINT) AS budget, CAST((SELECT count(*) FROM s) * (SELECT count(*) FROM eval_items) > 50000 AS INTEGER) AS exhausted",
    "number_strings": _B + r""" SELECT document_id, section_no, paragraph_no, array_to_string(list_sort(list_distinct(list_transform(
 regexp_extract_all(regexp_replace(text, '\[[^\]]+\]', '', 'g'), '([A-Za-z]\d(?:\d*\.\d+|\d+)?|\d+(?:\.\d+)?)'), lambda x: regexp_replace(x, '^[A-Za-z]\d', '')).list_filter(lambda x: x <> '' AND x[1] <> '.'))), '|') AS numbers FROM blocks""",
    "citation_marks": _B + " " + _ORD,
    "citation_resolution": _B + f", c AS (SELECT DISTINCT document_id, ordinal FROM ({_ORD})), t AS (SELECT DISTINCT id AS document_id, task_id FROM parsed_documents), r AS (SELECT DISTINCT task_id, ordinal, 1 AS hit FROM reference_sources WHERE task_id IS NOT NULL) SELECT document_id, count(*) AS cited, count(hit) AS resolved, max(ordinal) AS highest FROM c JOIN t USING (document_id) LEFT JOIN r USING (task_id, ordinal) GROUP BY 1",
    "citation_contexts": _B + r""", seg AS (SELECT document_id, section_no, paragraph_no, i, CASE WHEN i < len(parts) THEN parts[i] || '.' ELSE parts[i] END AS piece FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, string_split(text, '. ') AS parts FROM blocks WHERE contains(text, '[')))),
 mk AS (SELECT document_id, section_no, paragraph_no, trim(piece) AS context, unnest(regexp_extract_all(piece, '\[([^\]]+)\]', 1)) AS body FROM seg),
 od AS (SELECT *, list_sort(list_distinct(flatten(list_transform(list_transform(regexp_split_to_array(replace(body, '–', '-'), '[,;]'), lambda p: trim(p)), lambda p: CASE WHEN regexp_full_match(p, '\d{1,9}') THEN [CAST(p AS BIGINT)]
  WHEN regexp_full_match(p, '\d{1,9}\s*-\s*\d{1,9}') AND TRY_CAST(regexp_extract(p, '(\d+)$', 1) AS BIGINT) - TRY_CAST(regexp_extract(p, '^(\d+)', 1) AS BIGINT) BETWEEN 0 AND 100 THEN range(TRY_CAST(regexp_extract(p, '^(\d+)', 1) AS BIGINT), TRY_CAST(regexp_extract(p, '(\d+)$', 1) AS BIGINT) + 1) ELSE CAST([] AS BIGINT[]) END)))) AS os FROM mk)
 SELECT DISTINCT document_id, section_no, paragraph_no, context, array_to_string(os, ',') AS ordinals FROM od WHERE len(os) > 0""",
    "direction_events": _B + f""", w AS (SELECT document_id, {_WORDS.format('text')} AS w FROM blocks), ats AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: list_contains({_POLAR_UP}, w[i]) OR list_contains({_POLAR_DOWN}, w[i])) AS p FROM w),
 st AS (SELECT document_id, CASE WHEN len(p) = 0 THEN 'none' WHEN len(list_filter(p, lambda i: len(list_intersect(w[greatest(1, i - 3):i - 1], {_NEG})) > 0)) > 0 OR len(p) > 1 OR len(list_filter(w[p[1] + 1:p[1] + 4], lambda x: x NOT IN {_STOP} AND NOT list_contains({_POLAR_UP}, x) AND NOT list_contains({_POLAR_DOWN}, x) AND NOT regexp_full_match(x, '\\d+'))) = 0 THEN 'ambiguous' ELSE 'event' END AS state FROM ats)
 SELECT document_id, state, count(*) AS blocks FROM st GROUP BY 1, 2""",
    "coverage_summary": _B + r""", doc AS (SELECT DISTINCT id AS document_id, task_id, CAST(coalesce(len(page_map), 0) AS INT) AS pages_total FROM parsed_documents),
 bl AS (SELECT document_id, count(DISTINCT page) AS pages_with_text, count(*) AS text_blocks_reviewed, CAST(sum(len(regexp_extract_all(text, '(?i)±|p\s*[<=>]|g\s*\(\s*2\s*\)|FWHM|lifetime|\baverage\b'))) AS BIGINT) AS mentions, coalesce(max(list_max(list_transform(regexp_extract_all(text, '\[(\d{1,9})\]', 1), lambda x: CAST(x AS INT)))), 0) AS highest_citation FROM blocks GROUP BY 1),
 rf AS (SELECT DISTINCT id, task_id, parse_status, metadata_status, full_text_status FROM reference_sources),
 rc AS (SELECT task_id, count(*) AS references_total, count(*) FILTER (parse_status = 'failed') AS references_failed, count(*) FILTER (metadata_status = 'resolved') AS references_metadata_resolved, count(*) FILTER (full_text_status IN ('obtained', 'obtained_no_text')) AS reference_full_texts_obtained FROM rf GROUP BY 1),
 rh AS (SELECT task_id, string_agg(concat(full_text_status, '=', n), ';' ORDER BY full_text_status) AS failure_reasons FROM (SELECT task_id, full_text_status, count(*) AS n FROM rf WHERE full_text_status <> 'obtained' GROUP BY 1, 2) GROUP BY 1)
 SELECT document_id, pages_total, coalesce(pages_with_text, 0) AS pages_with_text, coalesce(text_blocks_reviewed, 0) AS text_blocks_reviewed, coalesce(mentions, 0) AS statistical_mentions_detected, coalesce(highest_citation, 0) AS highest_citation, coalesce(references_total, 0) AS references_total, coalesce(references_failed, 0) AS references_failed, coalesce(references_metadata_resolved, 0) AS references_metadata_resolved, coalesce(reference_full_texts_obtained, 0) AS reference_full_texts_obtained,
  coalesce(failure_reasons, '') AS failure_reasons, CAST(CASE WHEN coalesce(references_total, 0) > 0 THEN round(100.0 * (references_total - references_failed) / references_total) END AS INT) AS parsed_percent FROM doc LEFT JOIN bl USING (document_id) LEFT JOIN rc USING (task_id) LEFT JOIN rh USING (task_id)""",
    "word_excerpts": r"SELECT item_id, regexp_extract(passage, '^[^\p{L}\p{N}_''-]*(?:[\p{L}\p{N}_''-]+[^\p{L}\p{N}_''-]+){2}([\p{L}\p{N}_''-]+(?:[^\p{L}\p{N}_''-]+[\p{L}\p{N}_''-]+){4})', 1) AS excerpt FROM eval_items",
    "data_on_request": _B + """, f AS (SELECT *, strpos(lower(text), 'reasonable request') - 1 AS a FROM blocks WHERE contains(lower(text), 'available') AND contains(lower(text), 'reasonable request'))
 SELECT document_id, section_no, paragraph_no, CASE WHEN length(text) <= 520 THEN text ELSE CASE WHEN a > 260 THEN '…' ELSE '' END || trim(substr(text, CAST(greatest(0, a - 260) + 1 AS BIGINT), CAST(least(length(text), a + 18 + 260) - greatest(0, a - 260) AS BIGINT))) || CASE WHEN a + 278 < length(text) THEN '…' ELSE '' END END AS excerpt FROM f""",
}

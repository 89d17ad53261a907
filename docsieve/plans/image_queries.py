"""Queries of the image detectors on generated images, with SQL over the same sample formula."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.operators import evidence as E
from docsieve.operators import regions
from docsieve.sources.tables import table

WIDTH, HEIGHT = 240, 200
BUDGET = 1500
# one image for each nation, one document for each region; every second image repeats itself 120 to the right and 100 down
_PIXEL = "CASE WHEN n_nationkey % 2 = 0 THEN (({x} % 120) * 7 + ({y} % 100) * 13 + ({x} % 120) * ({y} % 100) * (n_nationkey + 3)) % 251 ELSE ({x} * {x} * 3 + {y} * {y} * 5 + {x} * {y} * 7 + {x} * n_nationkey) % 251 END"


def _images(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation", "n_nationkey", "n_regionkey")
    pixel = _PIXEL.format(x=f"(i % {WIDTH})", y=f"(i div {WIDTH})")
    samples = f"transform(sequence(0, {WIDTH * HEIGHT - 1}), i -> cast({pixel} as int))"
    big = "CASE WHEN n_nationkey = 24 THEN 3000 ELSE {} END"
    return n.selectExpr(
        "concat('region-', cast(n_regionkey as string)) AS document_id", "cast(n_nationkey as int) AS image_no", "cast(n_nationkey as int) AS xref", "cast(1 + n_nationkey % 4 as int) AS page",
        "array(10D, 20D, 10D + 240, 20D + CASE WHEN n_nationkey % 10 = 7 THEN 1 ELSE 200 END) AS bbox", "600D AS page_width", "800D AS page_height", f"cast({big.format(WIDTH)} as int) AS width", f"cast({big.format(HEIGHT)} as int) AS height", f"{samples} AS samples",
    )


def image_regions(spark: SparkSession, d: str) -> DataFrame:
    """The first repeated region of every image, as evidence."""
    found, _ = regions.region_repeats(_images(spark, d), budget=BUDGET)
    e = regions.region_findings(found)
    s, r = F.col("subject_location"), F.col("source_location")

    def box(c):
        return F.array_join(F.transform(c["bbox"], lambda x: x.cast("int").cast("string")), ",")

    return e.select(s["document_id"].alias("document_id"), "code", "category", "severity", "confidence", s["page"].alias("page"), box(s).alias("bbox"), box(r).alias("source_bbox"), F.col("method.parameters")["hamming_distance"].alias("distance"), F.col("method.parameters")["tile_pixels"].alias("tile"))


def image_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What was screened, skipped and compared in each document."""
    _, coverage = regions.region_repeats(_images(spark, d), budget=BUDGET)
    return coverage


def image_tiles(spark: SparkSession, d: str) -> DataFrame:
    """(image_no, eligible_tiles, compared): before any budget is shared out."""
    i = _images(spark, d)
    return regions.search(i, regions.resources(i)).select("image_no", "eligible_tiles", "compared")


def image_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Equal images of a document: every nation's image again on a later page for every third one."""
    i = _images(spark, d)
    again = i.where("image_no % 3 = 0").withColumn("image_no", F.col("image_no") + 100).withColumn("xref", F.col("xref") + 100).withColumn("page", F.col("page") + 10)
    rows, _ = regions.embedded(i.unionByName(again))
    e = E.identify(regions.reuse_findings(rows), F.lit("s"), F.lit("d"))
    return e.select(F.col("subject_location.document_id").alias("document_id"), "code", "confidence", F.col("subject_location.page").alias("page"), F.col("source_location.page").alias("source_page"), "subject_excerpt")


QUERIES = {"image_regions": image_regions, "image_coverage": image_coverage, "image_tiles": image_tiles, "image_reuse": image_reuse}

_SMALL = "n_nationkey % 10 <> 7 AND n_nationkey <> 24"
_PX = _PIXEL.format(x="least(239, x + CAST(round_even((c + 0.5) * 5, 0) AS INT))", y="least(199, y + CAST(round_even((r + 0.5) * 5, 0) AS INT))")
_TILES = f"""places AS (SELECT x, y, row_number() OVER (ORDER BY y, x) AS tile FROM (SELECT unnest(range(0, 161, 20)) AS x) CROSS JOIN (SELECT unnest(range(0, 121, 20)) AS y)),
 points AS (SELECT n_nationkey, n_regionkey, tile, x, y, r * 16 + c AS k, {_PX} AS v FROM nation CROSS JOIN places CROSS JOIN (SELECT unnest(range(0, 16)) AS r) CROSS JOIN (SELECT unnest(range(0, 16)) AS c) WHERE {_SMALL}),
 means AS (SELECT n_nationkey, tile, avg(v) AS m, round_even(var_pop(v), 0) AS variance FROM points GROUP BY ALL),
 sigs AS (SELECT n_nationkey, n_regionkey, tile, x, y, any_value(variance) AS variance, sum(CAST(v >= m AS INT)) AS light, list(CAST(v >= m AS INT) ORDER BY k) AS bits FROM points JOIN means USING (n_nationkey, tile) GROUP BY ALL),
 good AS (SELECT * FROM sigs WHERE variance >= 350 AND least(light, 256 - light) / 256 >= 0.12),
 pairs AS (SELECT a.n_nationkey, a.n_regionkey, a.x AS lx, a.y AS ly, b.x AS rx, b.y AS ry, row_number() OVER (PARTITION BY a.n_nationkey ORDER BY a.tile, b.tile) AS nr, list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: abs(z[1] - z[2]))) AS d
  FROM good a JOIN good b ON a.n_nationkey = b.n_nationkey AND a.tile < b.tile AND abs(a.x - b.x) >= 80 AND abs(a.y - b.y) >= 80),
 each AS (SELECT n.n_nationkey, n.n_regionkey, coalesce((SELECT count(*) FROM good g WHERE g.n_nationkey = n.n_nationkey), 0) AS eligible, coalesce(min(nr) FILTER (d <= 2), max(nr), 0) AS need, min(nr) FILTER (d <= 2) IS NOT NULL AS hit, arg_min(struct_pack(lx, ly, rx, ry, d), nr) FILTER (d <= 2) AS p
  FROM nation n LEFT JOIN pairs USING (n_nationkey) WHERE {_SMALL.replace('n_nationkey', 'n.n_nationkey')} GROUP BY 1, 2),
 ord AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY n_regionkey) AS n FROM each),
 fold AS (SELECT n_regionkey, n_nationkey, i, n, least(need, {BUDGET} // n) AS used, least(need, {BUDGET} // n) AS total, hit AND need <= {BUDGET} // n AS found, need > {BUDGET} // n AS cut FROM ord WHERE i = 1
  UNION ALL SELECT o.n_regionkey, o.n_nationkey, o.i, o.n, least(o.need, ({BUDGET} - f.total) // (o.n - o.i + 1)), f.total + least(o.need, ({BUDGET} - f.total) // (o.n - o.i + 1)), o.hit AND o.need <= ({BUDGET} - f.total) // (o.n - o.i + 1), f.cut OR o.need > ({BUDGET} - f.total) // (o.n - o.i + 1)
  FROM fold f JOIN ord o ON o.n_regionkey = f.n_regionkey AND o.i = f.i + 1)"""
_BOXTEXT = "concat(10 + {0}, ',', 20 + {1}, ',', 10 + {0} + 80, ',', 20 + {1} + 80)"

SQL = {
    "image_tiles": f"WITH RECURSIVE {_TILES} SELECT CAST(n_nationkey AS INT) AS image_no, CAST(eligible AS INT) AS eligible_tiles, need AS compared FROM each",
    "image_regions": f"WITH RECURSIVE {_TILES} SELECT concat('region-', o.n_regionkey) AS document_id, 'image_region_reuse_candidate' AS code, 'image_forensics' AS category, 'medium' AS severity, round(1 - p.d / 256, 3) AS confidence, CAST(1 + o.n_nationkey % 4 AS INT) AS page, {_BOXTEXT.format('p.rx', 'p.ry')} AS bbox, {_BOXTEXT.format('p.lx', 'p.ly')} AS source_bbox, CAST(p.d AS STRING) AS distance, '80' AS tile FROM fold JOIN ord o USING (n_nationkey) WHERE found",
    "image_coverage": f"""WITH RECURSIVE {_TILES} SELECT concat('region-', n_regionkey) AS document_id, max(n) AS images_screened, CAST((SELECT count(*) FROM nation x WHERE x.n_nationkey = 24 AND x.n_regionkey = fold.n_regionkey AND 3000 * 3000 > 4000000) AS BIGINT) AS images_skipped_resource_limit, CAST(0 AS BIGINT) AS tile_sampling_adjusted, max(n) * 63 AS tiles_generated, max(n) * {WIDTH * HEIGHT} AS decoded_pixels, CAST(0 AS INT) AS resource_budget_exhausted, CAST(sum(used) AS BIGINT) AS regions_compared, CAST(max(CAST(cut AS INT)) AS INT) AS region_budget_exhausted, count(*) FILTER (found) AS candidates FROM fold GROUP BY n_regionkey""",
    "image_reuse": "SELECT concat('region-', n_regionkey) AS document_id, 'embedded_image_reuse_candidate' AS code, CAST(1.0 AS DOUBLE) AS confidence, CAST(11 + n_nationkey % 4 AS INT) AS page, CAST(1 + n_nationkey % 4 AS INT) AS source_page, concat('The image on page ', 11 + n_nationkey % 4, ' equals the one on page ', 1 + n_nationkey % 4, '.') AS subject_excerpt FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 10 <> 7 AND n_nationkey <> 24",
}

"""Repeated regions inside one image, and images that stand more than once in a document.

Images come in as decoded grey samples.  Each is cut into tiles on a grid; a
tile's signature is 16 x 16 samples against their mean.  Two tiles that lie
apart on both axes and differ in at most two of 256 samples are a finding, the
first such pair of an image only.

Bounds are those of the contract, disclosed with the result: pixels of one
image and of a document, tiles of one image (a coarser grid beyond) and of a
document, comparisons of a document shared fairly among its images.  The pixel
and tile bounds follow from the images' sizes alone, so they are folded before
any sample is read; the comparison bound needs only each image's count up to its
first hit, so images are searched in parallel and folded afterwards.

Defined results: images without samples or outside the size limits aren't
screened and are counted as skipped only for their size; an image without two
eligible tiles has no finding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.operators import evidence as E

MAX_PIXELS, TASK_PIXELS = 4_000_000, 40_000_000
MAX_TILES, TASK_TILES = 2_500, 25_000
COMPARISONS = 50_000
MIN_WIDTH, MIN_HEIGHT, MIN_AREA = 160, 100, 0.01
TILE, SIDE = 80, 16
MIN_VARIANCE, MIN_MINORITY, MAX_DISTANCE = 350, 0.12, 2


def grid(width: int, height: int) -> tuple[int, int, list[tuple[int, int]], bool]:
    """(tile size, step, places in reading order, whether the grid was made coarser)."""
    size = min(TILE, width // 2, height // 2)
    step = max(16, size // 4)
    cells = ((width - size) // step + 1) * ((height - size) // step + 1)
    coarse = cells > MAX_TILES
    if coarse:
        step *= int(np.ceil(np.sqrt(cells / MAX_TILES)))
    return size, step, [(x, y) for y in range(0, height - size + 1, step) for x in range(0, width - size + 1, step)], coarse


def tile_columns(width: Column, height: Column) -> tuple[Column, Column, Column]:
    """(columns of the grid, rows of the grid, whether it was made coarser), from the size alone."""
    size = F.least(F.lit(TILE), F.floor(width / 2), F.floor(height / 2))
    step = F.greatest(F.lit(16), F.floor(size / 4))
    cells = (F.floor((width - size) / step) + 1) * (F.floor((height - size) / step) + 1)
    wide = step * F.when(cells > MAX_TILES, F.ceil(F.sqrt(cells / MAX_TILES))).otherwise(1)
    return F.floor((width - size) / wide) + 1, F.floor((height - size) / wide) + 1, cells > MAX_TILES


def signatures(samples: np.ndarray, places: list[tuple[int, int]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits of each tile, rounded variance, fraction of the rarer bit) of the tiles at ``places``."""
    height, width = samples.shape
    step = np.rint((np.arange(SIDE) + 0.5) * size / SIDE).astype(np.int64)
    x, y = np.array([p[0] for p in places])[:, None] + step, np.array([p[1] for p in places])[:, None] + step
    points = samples[np.minimum(y, height - 1)[:, :, None], np.minimum(x, width - 1)[:, None, :]].reshape(len(places), -1).astype(np.float64)
    mean = points.mean(axis=1, keepdims=True)
    bits = points >= mean
    light = bits.sum(axis=1)
    return bits, np.rint(((points - mean) ** 2).mean(axis=1)), np.minimum(light, bits.shape[1] - light) / bits.shape[1]


def first_repeat(samples: np.ndarray, allowed: int) -> tuple[int, int, tuple[int, int, int, int, int, int] | None]:
    """(eligible tiles, comparisons up to the first hit or in all, hit: left x, y, right x, y, distance, tile size) among the first ``allowed`` tiles."""
    size, _, places, _ = grid(samples.shape[1], samples.shape[0])
    places = places[:allowed]
    if not places:
        return 0, 0, None
    bits, variance, minority = signatures(samples, places, size)
    good = np.flatnonzero((variance >= MIN_VARIANCE) & (minority >= MIN_MINORITY))
    at = np.array(places)[good]
    words = np.packbits(bits[good], axis=1)
    done = 0
    for i in range(len(good) - 1):
        apart = np.flatnonzero((np.abs(at[i + 1 :] - at[i]) >= size).all(axis=1)) + i + 1
        if not len(apart):
            continue
        distance = np.bitwise_count(words[apart] ^ words[i]).sum(axis=1)
        hit = np.flatnonzero(distance <= MAX_DISTANCE)
        if len(hit):
            j = apart[hit[0]]
            return len(good), done + int(hit[0]) + 1, (*at[i].tolist(), *at[j].tolist(), int(distance[hit[0]]), size)
        done += len(apart)
    return len(good), done, None


def eligible(images: DataFrame) -> DataFrame:
    """``images`` with ``_fits`` (size limits) and ``_large`` (skipped for its pixels); one row for each embedded object, its first place.

    images: (document_id, image_no, xref, page, bbox, page_width, page_height, width, height, samples).
    """
    first = images.groupBy("document_id", "xref").agg(F.min("image_no").alias("image_no"))
    area = (F.col("bbox")[2] - F.col("bbox")[0]) * (F.col("bbox")[3] - F.col("bbox")[1]) / (F.col("page_width") * F.col("page_height"))
    big = F.col("width").cast("bigint") * F.col("height")
    placed = (F.size("bbox") == 4) & (area >= MIN_AREA) & (F.col("width") >= MIN_WIDTH) & (F.col("height") >= MIN_HEIGHT)
    one = images.join(first, ["document_id", "xref", "image_no"])
    return one.withColumn("_px", big).withColumn("_large", F.coalesce(placed & (big > MAX_PIXELS), F.lit(False))).withColumn("_fits", F.coalesce(placed & (big <= MAX_PIXELS) & F.col("samples").isNotNull(), F.lit(False)))


_RESOURCES = """aggregate(array_sort(_i), named_struct('pixels', decoded, 'tiles', cast(0 as bigint), 'out', exhausted, 'rows', filter(transform(_i, x -> named_struct('image_no', x.image_no, 'allowed', cast(0 as bigint), 'skipped', false)), x -> false)),
 (acc, x) -> if(acc.pixels + x.px > {pixels},
   named_struct('pixels', acc.pixels, 'tiles', acc.tiles, 'out', true, 'rows', concat(acc.rows, array(named_struct('image_no', x.image_no, 'allowed', cast(0 as bigint), 'skipped', true)))),
   named_struct('pixels', acc.pixels + x.px, 'tiles', acc.tiles + least(x.cols * if(acc.out, 1, x.rows), {tiles} - acc.tiles), 'out', acc.out or acc.tiles + x.cols * x.rows > {tiles},
     'rows', concat(acc.rows, array(named_struct('image_no', x.image_no, 'allowed', least(x.cols * if(acc.out, 1, x.rows), {tiles} - acc.tiles), 'skipped', false))))))"""


def resources(images: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """(document_id, image_no, allowed, skipped, decoded_pixels, exhausted): how many tiles of each image may be made.

    Images are decoded in order while the document's pixels last; one that
    would exceed them is skipped.  Once pixels or tiles have run out, every later
    image gives its first row of tiles only, as far as tiles are left.  ``used``:
    (document_id, decoded, exhausted) from screening whole images before.
    """
    cols, rows, _ = tile_columns(F.col("width"), F.col("height"))
    item = F.struct("image_no", F.col("_px").alias("px"), cols.cast("bigint").alias("cols"), rows.cast("bigint").alias("rows"))
    each = eligible(images).where("_fits").groupBy("document_id").agg(F.collect_list(item).alias("_i"))  # sizes only, of one document
    if used is not None:
        each = each.join(used, "document_id", "left")
    else:
        each = each.withColumn("decoded", F.lit(0)).withColumn("exhausted", F.lit(False))
    each = each.withColumn("decoded", F.coalesce("decoded", F.lit(0)).cast("bigint")).withColumn("exhausted", F.coalesce("exhausted", F.lit(False)))
    folded = each.withColumn("_f", F.expr(_RESOURCES.format(pixels=TASK_PIXELS, tiles=TASK_TILES)))
    return folded.select("document_id", F.col("_f.pixels").alias("decoded_pixels"), F.col("_f.out").alias("exhausted"), F.explode("_f.rows").alias("r")).select("document_id", "r.image_no", "r.allowed", "r.skipped", "decoded_pixels", "exhausted")


_FAIR = """aggregate(array_sort(_i), named_struct('used', cast(0 as bigint), 'cut', false, 'rows', filter(transform(_i, x -> named_struct('image_no', x.image_no, 'used', cast(0 as bigint), 'found', false)), x -> false)),
 (acc, x) -> named_struct('used', acc.used + least(x.need, ({budget} - acc.used) div x.left_over), 'cut', acc.cut or x.need > ({budget} - acc.used) div x.left_over,
   'rows', concat(acc.rows, array(named_struct('image_no', x.image_no, 'used', least(x.need, ({budget} - acc.used) div x.left_over), 'found', x.hit and x.need <= ({budget} - acc.used) div x.left_over)))))"""


def fair_budget(searched: DataFrame, *, budget: int = COMPARISONS) -> DataFrame:
    """(document_id, image_no, used, found, cut): what each image may compare, in order, of a budget shared among the images that are left.

    searched: (document_id, image_no, skipped, compared, hit); a skipped image
    compares nothing but counts as one that is left.
    """
    from pyspark.sql import Window as W

    left = F.count("*").over(W.partitionBy("document_id").orderBy("image_no").rowsBetween(0, W.unboundedFollowing))
    items = searched.withColumn("_left", left).where("not skipped")
    item = F.struct("image_no", F.col("compared").cast("bigint").alias("need"), F.col("hit").isNotNull().alias("hit"), F.col("_left").alias("left_over"))
    each = items.groupBy("document_id").agg(F.collect_list(item).alias("_i")).withColumn("_f", F.expr(_FAIR.format(budget=budget)))  # the images of one document
    return each.select("document_id", F.explode("_f.rows").alias("r"), F.col("_f.cut").alias("cut")).select("document_id", "r.image_no", "r.used", "r.found", "cut")


def search(images: DataFrame, allowed: DataFrame) -> DataFrame:
    """(document_id, image_no, page, bbox, width, height, skipped, allowed, eligible_tiles, compared, hit): the first repeat of every image."""
    names = ["document_id", "image_no", "page", "bbox", "width", "height", "skipped", "allowed"]
    rows = images.join(allowed.select("document_id", "image_no", "skipped", "allowed"), ["document_id", "image_no"]).select(*names, "samples")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    hit_type = pa.struct([(n, pa.int32()) for n in ("left_x", "left_y", "right_x", "right_y", "distance", "size")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tiles, compared, hits = [], [], []
            for i in range(b.num_rows):
                w, h, skip, most = (b.column(k)[i].as_py() for k in (4, 5, 6, 7))
                flat = b.column(8)[i]
                if skip:
                    data = None
                elif pa.types.is_binary(flat.type):
                    data = np.frombuffer(flat.as_py(), np.uint8)
                else:
                    data = flat.values.to_numpy(zero_copy_only=False)
                t, c, hit = first_repeat(data.reshape(h, w), most) if data is not None and len(data) == w * h else (0, 0, None)
                tiles.append(t), compared.append(c), hits.append(dict(zip((f.name for f in hit_type), hit, strict=True)) if hit else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:8], pa.array(tiles, pa.int32()), pa.array(compared, pa.int64()), pa.array(hits, hit_type)], names=[*names, "eligible_tiles", "compared", "hit"])

    return rows.mapInArrow(work, f"{kinds}, eligible_tiles int, compared bigint, hit struct<left_x:int,left_y:int,right_x:int,right_y:int,distance:int,size:int>")


def region_repeats(images: DataFrame, *, budget: int = COMPARISONS, used: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings (document_id, image_no, page, bbox, left_bbox, distance, size) and coverage, one row for each document."""
    from docsieve.sources.settle import settle

    allowed = resources(images, used)
    found = settle(search(images, allowed), "image-repeats")
    fair = settle(fair_budget(found, budget=budget), "image-budget")
    hits = found.join(fair.where("found"), ["document_id", "image_no"])

    def on_page(side: str) -> Column:
        x, y, n, box = F.col(f"hit.{side}_x"), F.col(f"hit.{side}_y"), F.col("hit.size"), F.col("bbox")
        wide, high = box[2] - box[0], box[3] - box[1]
        return F.array(box[0] + wide * x / F.col("width"), box[1] + high * y / F.col("height"), box[0] + wide * (x + n) / F.col("width"), box[1] + high * (y + n) / F.col("height"))

    findings = hits.select("document_id", "image_no", "page", on_page("right").alias("bbox"), on_page("left").alias("left_bbox"), "hit.distance", "hit.size")
    large = eligible(images).groupBy("document_id").agg(F.count_if("_large").alias("_l"))
    screened = found.groupBy("document_id").agg(F.count_if(~F.col("skipped")).alias("images_screened"), F.count_if("skipped").alias("_s"), F.sum("allowed").alias("tiles_generated"), F.count_if(~F.col("skipped") & tile_columns(F.col("width"), F.col("height"))[2]).alias("tile_sampling_adjusted"))
    state = allowed.groupBy("document_id").agg(F.max("decoded_pixels").alias("decoded_pixels"), F.max(F.col("exhausted").cast("int")).alias("resource_budget_exhausted"))
    spent = fair.groupBy("document_id").agg(F.sum("used").alias("regions_compared"), F.max(F.col("cut").cast("int")).alias("region_budget_exhausted"), F.count_if("found").alias("candidates"))
    zero = F.lit(0)
    coverage = large.join(screened, "document_id", "left").join(state, "document_id", "left").join(spent, "document_id", "left").select(
        "document_id", F.coalesce("images_screened", zero).alias("images_screened"), (F.col("_l") + F.coalesce("_s", zero)).alias("images_skipped_resource_limit"), F.coalesce("tile_sampling_adjusted", zero).alias("tile_sampling_adjusted"), F.coalesce("tiles_generated", zero).alias("tiles_generated"),
        F.coalesce("decoded_pixels", zero).alias("decoded_pixels"), F.coalesce("resource_budget_exhausted", zero).alias("resource_budget_exhausted"), F.coalesce("regions_compared", zero).alias("regions_compared"), F.coalesce("region_budget_exhausted", zero).alias("region_budget_exhausted"), F.coalesce("candidates", zero).alias("candidates"),
    )
    return findings, coverage


def embedded(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences that are screened whole: (document_id, image_no, page, bbox, digest), and (document_id, decoded, exhausted, skipped).

    Occurrences under a hundredth of the page are left out; each object is
    decoded once, in order, while the document's pixels last.
    """
    area = F.coalesce((F.col("bbox")[2] - F.col("bbox")[0]) * (F.col("bbox")[3] - F.col("bbox")[1]) / (F.col("page_width") * F.col("page_height")), F.lit(1.0))
    seen = images.where(area >= MIN_AREA).withColumn("_px", F.col("width").cast("bigint") * F.col("height"))
    item = F.struct(F.col("image_no").alias("n"), "xref", F.col("_px").alias("px"))
    fold = f"""aggregate(array_sort(_i), named_struct('pixels', cast(0 as bigint), 'out', false, 'taken', filter(transform(_i, x -> x.xref), x -> false), 'skipped', 0),
     (acc, x) -> if(x.px > {MAX_PIXELS}, named_struct('pixels', acc.pixels, 'out', acc.out, 'taken', acc.taken, 'skipped', acc.skipped + 1),
       if(array_contains(acc.taken, x.xref), acc, if(acc.pixels + x.px > {TASK_PIXELS}, named_struct('pixels', acc.pixels, 'out', true, 'taken', acc.taken, 'skipped', acc.skipped + 1),
         named_struct('pixels', acc.pixels + x.px, 'out', acc.out, 'taken', concat(acc.taken, array(x.xref)), 'skipped', acc.skipped)))))"""
    state = seen.groupBy("document_id").agg(F.collect_list(item).alias("_i")).withColumn("_f", F.expr(fold))  # sizes only, of one document
    taken = state.select("document_id", F.explode("_f.taken").alias("xref"))
    digest = F.sha2(F.col("samples") if dict(images.dtypes)["samples"] == "binary" else F.to_json("samples"), 256)
    rows = seen.join(taken, ["document_id", "xref"]).select("document_id", "image_no", "page", "bbox", digest.alias("digest"))
    return rows, state.select("document_id", F.col("_f.pixels").alias("decoded"), F.col("_f.out").alias("exhausted"), F.col("_f.skipped").alias("skipped"))


def reuse_findings(occurrences: DataFrame) -> DataFrame:
    """Evidence rows of every later occurrence of equal samples with the first of its document."""
    first = occurrences.groupBy("document_id", "digest").agg(F.min_by(F.struct("image_no", "page", "bbox"), F.col("image_no")).alias("f"))
    later = occurrences.join(first, ["document_id", "digest"]).where(F.col("image_no") > F.col("f.image_no"))
    return E.build(
        later, seq=0, code="embedded_image_reuse_candidate", category="image_similarity", severity="medium", confidence=1.0, subject=E.location(F.col("document_id"), F.col("page"), F.col("bbox")), source=E.location(F.col("document_id"), F.col("f.page"), F.col("f.bbox")),
        subject_excerpt=F.concat(F.lit("The image on page "), F.col("page").cast("string"), F.lit(" equals the one on page "), F.col("f.page").cast("string"), F.lit(".")), explanation="The same samples stand twice in the document.", method=E.method("image-digest"),
    )


def region_findings(repeats: DataFrame) -> DataFrame:
    """Evidence rows of repeated regions."""
    confidence = F.round(1 - F.col("distance") / F.lit(float(SIDE * SIDE)), 3)
    return E.build(
        repeats, seq=5, code="image_region_reuse_candidate", category="image_forensics", severity="medium", confidence=confidence, subject=E.location(F.col("document_id"), F.col("page"), F.col("bbox")), source=E.location(F.col("document_id"), F.col("page"), F.col("left_bbox")),
        subject_excerpt=F.concat(F.lit("An image on page "), F.col("page").cast("string"), F.lit(" holds two nearly equal regions apart from each other.")), explanation="Two regions have nearly the same signature.",
        method=E.method("image-region-signature", parameters={"tile_pixels": F.col("size"), "hamming_distance": F.col("distance")}), limitations=["Regions level with or above each other aren't compared, because axes and panels repeat there."],
    )

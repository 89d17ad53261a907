"""Repeated image regions: binary tile signatures and near-equal pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64  # samples in one word of a signature


def signatures(df: DataFrame, key: str, samples: str) -> DataFrame:
    """(key, sig, minority, variance): bit i is set where sample i is at or above the mean; sig holds 64 samples a word, all of them."""
    v = F.transform(samples, lambda x: x.cast("double"))
    n = F.size("_v")
    mean = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / n
    rows = df.select(key, v.alias("_v")).where(n > 0).withColumn("_mean", mean)
    none = F.lit(0).cast("bigint")
    bits = F.transform("_v", lambda x, i: F.when(x >= F.col("_mean"), F.call_function("shiftleft", F.lit(1).cast("bigint"), i % WORD)).otherwise(none))
    rows = rows.withColumn("_bits", bits).withColumn("sig", F.transform(F.expr(f"sequence(0, (size(_v) - 1) div {WORD})"), lambda w: F.aggregate(F.slice("_bits", (w * WORD + 1).cast("int"), WORD), none, lambda a, x: a.bitwiseOR(x))))
    variance = F.aggregate("_v", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / n
    return rows.select(key, "sig", (F.least(ones("sig"), n - ones("sig")) / n).alias("minority"), variance.alias("variance"))


def ones(sig: str) -> Column:
    """How many bits of a signature are set."""
    return F.aggregate(sig, F.lit(0), lambda a, w: a + F.bit_count(w))


def _bits(low: int, high: int) -> Callable[[Column], Column]:
    """The bits from ``low`` up to ``high`` of a word, as text."""
    mask = F.lit((1 << (high - low)) - 1 if high - low < WORD else -1).cast("bigint")
    return lambda w: F.shiftrightunsigned(w, low).bitwiseAND(mask).cast("string")


def near_equal(tiles: DataFrame, key: str, *, most: int = 2) -> DataFrame:
    """(key_a, key_b, distance): signatures that differ in at most ``most`` bits; a missing word counts as zeros.

    Pigeonhole: with ``most`` + 1 bands at least one is equal, so equal bands
    of equal place join.  A band holds the same bits of every word.  Equal
    signatures are one class first; its members come in only with the classes
    that it is near to.
    """
    classes = tiles.select("sig").distinct()
    bands = None
    cuts = [WORD * i // (most + 1) for i in range(most + 2)] if most < WORD else []  # more bands than bits of a word: all with all
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])) if cuts else [(0, (0, 0))]:
        part = F.transform("sig", _bits(low, high))
        band = F.regexp_replace(F.array_join(part, ","), "(,0)+$", "") if cuts else F.lit("")
        b = classes.select("sig", F.lit(i).alias("i"), band.alias("b"))
        bands = b if bands is None else bands.unionAll(b)
    x, y = bands.select(F.col("sig").alias("sa"), "i", "b"), bands.select(F.col("sig").alias("sb"), "i", "b")
    zero = F.lit(0).cast("bigint")
    d = F.aggregate(F.zip_with("sa", "sb", lambda p, q: F.bit_count(F.coalesce(p, zero).bitwiseXOR(F.coalesce(q, zero)))), F.lit(0), lambda a, n: a + n)
    pairs = x.join(y, ["i", "b"]).where("sa <= sb").select("sa", "sb", d.alias("distance")).where(F.col("distance") <= most).distinct()
    left, right = tiles.select(F.col("sig").alias("sa"), F.col(key).alias("_x")), tiles.select(F.col("sig").alias("sb"), F.col(key).alias("_y"))
    both = pairs.join(left, "sa").join(right, "sb").where("sa <> sb or _x < _y")
    return both.select(F.least("_x", "_y").alias(f"{key}_a"), F.greatest("_x", "_y").alias(f"{key}_b"), F.col("distance").cast("int").alias("distance"))


def later_duplicates(df: DataFrame, digest: str, order: list[str], key: str) -> DataFrame:
    """(key, first_key): every later occurrence of a digest with the first one.

    The first is a combined minimum joined back, so a digest that a third of
    all rows carry is never gathered in one task.
    """
    place = F.struct(*dict.fromkeys([*order, key]))
    first = df.groupBy(digest).agg(F.min(place).alias("_f"))
    joined = df.join(first, digest)
    return joined.where(place != F.col("_f")).select(F.col(key), F.col(f"_f.{key}").alias(f"first_{key}"))

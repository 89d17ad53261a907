"""Documents that look the same but differ in their characters (problem 10)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.canonical import canonical
from docsieve.sources.settle import settle


def look_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form, exact): 128-bit digests of the canonical form and of the text itself.

    Null texts and texts without a visible character give no row.
    """
    kind = df.schema[key].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, form, exact = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                c = canonical(t)
                if c:
                    rows.append(i)
                    form.append(hashlib.blake2b(c.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    exact.append(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(form, pa.binary()), pa.array(exact, pa.binary())], names=[key, "form", "exact"])

    return df.select(key, text).mapInArrow(digest, f"`{key}` {kind}, form binary, exact binary")


def same_look_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key_a, key_b), a < b: rows whose texts share a canonical form but not their code points.

    Pairs are formed between the distinct spellings of a form first; rows come
    in only through their spelling, so a large group of exact copies costs its
    result, never its square.
    """
    keyed = settle(look_keys(df, key, text).distinct(), "look-keys")
    several = keyed.groupBy("form").agg(F.min("exact").alias("_lo"), F.max("exact").alias("_hi")).where("_lo <> _hi").select("form")
    rows = keyed.join(several, "form", "left_semi")
    spellings = rows.select("form", "exact").distinct()
    a, b = spellings.alias("a"), spellings.alias("b")
    pairs = a.join(b, F.expr("a.form = b.form and a.exact < b.exact")).select(F.col("a.exact").alias("ea"), F.col("b.exact").alias("eb"))
    left = rows.select(F.col("exact").alias("ea"), F.col(key).alias("_x"))
    right = rows.select(F.col("exact").alias("eb"), F.col(key).alias("_y"))
    both = pairs.join(left, "ea").join(right, "eb")
    return both.select(F.least("_x", "_y").alias(f"{key}_a"), F.greatest("_x", "_y").alias(f"{key}_b")).where(F.col(f"{key}_a") < F.col(f"{key}_b")).distinct()


def same_look_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id, links): every row that has a partner, its class, and with how many rows it makes a pair.

    Counts per form and spelling are combined map-side, so this form of the
    result costs one row for each row whatever the size of a class.
    """
    keyed = settle(look_keys(df, key, text).distinct(), "look-keys")
    counts = keyed.groupBy("form", "exact").agg(F.count("*").alias("_own"))
    totals = counts.groupBy("form").agg(F.sum("_own").alias("_all"), F.count("*").alias("_n")).where("_n > 1")
    links = counts.join(totals, "form").select("form", "exact", (F.col("_all") - F.col("_own")).alias("links"))
    return keyed.join(links, ["form", "exact"]).select(key, F.lower(F.hex("form")).alias("class_id"), "links")

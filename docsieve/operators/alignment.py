"""Verbatim word runs between two texts.

``matching_blocks`` finds the longest common run, the earliest in the left then
in the right text among equals, and goes on to the left and right of it; runs
under ``k`` words can't be part of the answer, so only runs seeded by common
k-grams are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.functions.text import words
from docsieve.sources.settle import settle

BROADCAST_GRAMS = 2_000_000  # 8 bytes each


def maximal_runs(a: list[str], b: list[str], k: int) -> list[tuple[int, int, int]]:
    """(i, j, size) of every maximal common run of at least ``k`` words."""
    at: dict[tuple[str, ...], list[int]] = {}
    for j in range(len(b) - k + 1):
        at.setdefault(tuple(b[j : j + k]), []).append(j)
    runs = []
    for i in range(len(a) - k + 1):
        for j in at.get(tuple(a[i : i + k]), ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue  # inside a run that began before
            n = k
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            runs.append((i, j, n))
    return runs


def matching_blocks(a: list[str], b: list[str], k: int) -> list[tuple[int, int, int]]:
    """Non-crossing blocks (i, j, size >= k), in order."""
    out: list[tuple[int, int, int]] = []
    todo = [(0, len(a), 0, len(b), maximal_runs(a, b, k))]
    while todo:
        a0, a1, b0, b1, runs = todo.pop()
        inside = []
        for i, j, n in runs:
            cut = max(a0 - i, b0 - j, 0)
            size = min(i + n, a1) - (i + cut), min(j + n, b1) - (j + cut)
            if min(size) >= k:
                inside.append((i + cut, j + cut, min(size)))
        if not inside:
            continue
        i, j, n = min(inside, key=lambda r: (-r[2], r[0], r[1]))
        out.append((i, j, n))
        todo += [(a0, i, b0, j, inside), (i + n, a1, j + n, b1, inside)]
    return sorted(out)


def postings(blocks: DataFrame, keys: list[str], text: str = "text", shortest: int = 4) -> DataFrame:
    """(keys.., token): distinct tokens of at least ``shortest`` letters of each block."""
    tokens = F.array_distinct(F.filter(words(F.col(text)), lambda w: F.length(w) >= shortest))
    return blocks.select(*keys, F.explode(tokens).alias("token"))


def rare_anchors(subjects: DataFrame, keys: list[str], df: DataFrame, n_blocks: int, *, text: str = "text", most: int = 12) -> DataFrame:
    """(keys.., token): the ``most`` rarest anchors of each block: five letters, no stop word, in at most max(20, blocks / 10) blocks."""
    from pyspark.sql import Window as W

    from docsieve.functions.text import STOPWORDS

    mine = postings(subjects, keys, text, 5).where(~F.col("token").isin(STOPWORDS))
    rare = mine.join(df.where(F.col("df") <= max(20, n_blocks // 10)), "token")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("df", "token"))
    return rare.withColumn("_r", rank).where(F.col("_r") <= most).select(*keys, "token")


def reuse_candidates(subjects: DataFrame, keys: list[str], sources: DataFrame, source_key: str, *, text: str = "text", source_text: str = "text") -> DataFrame:
    """(keys.., source_key): pairs that share a rare anchor.  An anchor stands in at most max(20, sources / 10) sources and a block has twelve."""
    src = postings(sources, [source_key], source_text)
    df = src.groupBy("token").agg(F.count("*").alias("df"))
    anchors = rare_anchors(subjects, keys, df, sources.count(), text=text)
    return anchors.join(src, "token").select(*keys, source_key).distinct()


def reuse_pairs(subjects: DataFrame, keys: list[str], sources: DataFrame, source_key: str, *, text: str = "text", source_text: str = "text", k: int = 10) -> DataFrame:
    """(keys.., source_key): candidates that can hold a run: those with ``k`` words in a row in common and a rare anchor.

    The common grams come first, so the anchors, of which every block shares
    some with many sources, are looked up for few pairs only.
    """
    some = gram_pairs(subjects, keys, sources, source_key, text=text, source_text=source_text, k=k)
    src = postings(sources, [source_key], source_text)
    df = src.groupBy("token").agg(F.count("*").alias("df"))
    anchors = rare_anchors(subjects.join(some.select(*keys).distinct(), keys, "left_semi"), keys, df, sources.count(), text=text)
    return some.join(anchors, keys).join(src, [source_key, "token"], "left_semi").select(*keys, source_key).distinct()


def gram_pairs(subjects: DataFrame, keys: list[str], sources: DataFrame, source_key: str, *, text: str = "text", source_text: str = "text", k: int = 10) -> DataFrame:
    """(keys.., source_key): pairs with ``k`` words in a row in common; only these can hold a matching block."""

    def grams(df: DataFrame, cols: list[str], column: str) -> DataFrame:
        w = df.select(*cols, words(F.col(column)).alias("_w")).where(F.size("_w") >= k)
        g = F.transform(F.sequence(F.lit(1), F.size("_w") - k + 1), lambda i: F.xxhash64(F.slice("_w", i, k)))
        return w.select(*cols, F.explode(F.array_distinct(g)).alias("_g"))

    theirs = settle(grams(sources, [source_key], source_text), "source-grams")
    known = theirs.select("_g").distinct()
    mine = grams(subjects, keys, text)
    if known.count() <= BROADCAST_GRAMS:  # the subjects' other grams never leave their task
        mine = mine.join(F.broadcast(known), "_g", "left_semi")
    return mine.join(theirs, "_g").select(*keys, source_key).distinct()


def aligned_runs(pairs: DataFrame, left: str, right: str, k: int = 10) -> DataFrame:
    """``pairs`` with (word_start, source_word_start, size): the matching blocks of two texts; both text columns are dropped."""
    keep = [c for c in pairs.columns if c not in (left, right)]
    prepared = pairs.select(*keep, words(F.col(left)).alias("_a"), words(F.col(right)).alias("_b")).where(f"size(_a) >= {k} and size(_b) >= {k}")
    schema = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keep) + ", word_start int, source_word_start int, size int"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keep)
        for b in batches:
            at, i_, j_, n_ = [], [], [], []
            for r, (x, y) in enumerate(zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True)):
                for i, j, size in matching_blocks(x, y, k):
                    at.append(r), i_.append(i), j_.append(j), n_.append(size)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(take) for c in range(n)], *[pa.array(v, pa.int32()) for v in (i_, j_, n_)]], names=[*keep, "word_start", "source_word_start", "size"])

    return prepared.mapInArrow(align, schema)


def reuse_confidence(size, left, right):
    """0.6 + 0.4 * size / longer text, at most 0.99, three places."""
    return F.round(F.least(F.lit(0.99), 0.6 + 0.4 * size / F.greatest(left, right)), 3)


PAIR_WORDS = r"[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)?"


def compare_texts(pairs: DataFrame, keys: list[str], left: str, right: str, k: int = 12) -> DataFrame:
    """(keys.., place, matched_words, severity, confidence, subject_excerpt, source_excerpt): runs of at least ``k`` words that two texts share.

    Words are runs of Latin letters and digits with one inner apostrophe or
    hyphen, compared without case; ``place`` orders a pair's runs, the longest
    first, then as they stand.  Null texts share nothing.
    """
    w = pairs.select(*keys, F.regexp_extract_all(left, F.lit(PAIR_WORDS), F.lit(0)).alias("_l"), F.regexp_extract_all(right, F.lit(PAIR_WORDS), F.lit(0)).alias("_r")).where(f"size(_l) >= {k} and size(_r) >= {k}")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in w.schema.fields[: len(keys)])
    names = [*keys, "place", "matched_words", "subject_excerpt", "source_excerpt"]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keys)
        for b in batches:
            at, place, size_, xs, ys = [], [], [], [], []
            for r, (x, y) in enumerate(zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True)):
                blocks = matching_blocks([t.lower() for t in x], [t.lower() for t in y], k)
                for p, (i, j, size) in enumerate(sorted(blocks, key=lambda m: -m[2]), 1):
                    at.append(r), place.append(p), size_.append(size), xs.append(" ".join(x[i : i + size])), ys.append(" ".join(y[j : j + size]))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(take) for c in range(n)], pa.array(place, pa.int32()), pa.array(size_, pa.int32()), pa.array(xs, pa.string()), pa.array(ys, pa.string())], names=names)

    runs = w.mapInArrow(align, f"{kinds}, place int, matched_words int, subject_excerpt string, source_excerpt string")
    return runs.withColumn("severity", F.when(F.col("matched_words") >= 25, "high").otherwise("medium")).withColumn("confidence", F.least(F.lit(0.99), 0.65 + F.col("matched_words") / 100))

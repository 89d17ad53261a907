"""Filling fixed-capacity containers with texts (problem 8).

1. Each text is measured in tokens of a public tokenizer; texts above the
   capacity are cut into full containers and one rest, all others stay whole.
2. The histogram of lengths (at most ``capacity`` rows, whatever the corpus)
   goes to the driver.  Dynamic programming over it chooses the length buckets
   that minimise padding.
3. Bucket by bucket, the longest first, batches of at most ``capacity`` tokens
   form from the items of that bucket: the longest first, each into the fullest
   batch of its bucket that has room, else into a new one.  What a bucket's own
   items leave of its batches is then topped up, the tightest spaces first, with
   the longest items of shorter buckets that fit; these are gone when their own
   bucket's turn comes.  So the bounds decide which items stand together.
   Containers of one make-up are handled as a range, so this works on the
   histogram and costs the same for any corpus.
4. Items get their place by their number within their length.  Numbers come
   from salted windows plus offsets, with as many salts as the items need, so a
   length that a third of the corpus shares is numbered by many tasks.

Defined results: null and empty texts have no tokens and no container; equal
texts are separate items; no item is in two containers unless it was cut.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsieve.sources.settle import settle

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 2048
BUCKETS = 8
SALT_ROWS = 250_000  # items numbered by one task
# Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE whose ranks stand in ``path``."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens): the length of each text; texts without tokens give no row."""
    kind = df.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])
            yield out.filter(pa.compute.greater(out.column(1), 0))

    return df.select(key, text).mapInArrow(count, f"`{key}` {kind}, n_tokens bigint")


def bucket_bounds(histogram: dict[int, int], k: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``k`` length buckets with the least padding to the bound, by dynamic programming."""
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    n = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0], np.cumsum(counts * lengths)])
    m = len(lengths)
    best = np.where(np.arange(m + 1) == 0, 0.0, np.inf)
    choices = []
    for _ in range(min(k, m)):
        # cost[i, j]: items i..j-1 in one bucket padded to lengths[j-1]
        new, take = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        new[0] = 0.0
        for j in range(1, m + 1):
            cost = best[:j] + (n[j] - n[:j]) * float(lengths[j - 1]) - (total[j] - total[:j])
            take[j] = int(np.argmin(cost))
            new[j] = cost[take[j]]
        choices.append(take)
        best = new
    bounds, j = [], m
    for take in reversed(choices):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(take[j])
    return sorted(bounds)


class _Spaces:
    """Open containers by the space left in them: ranges (first container, containers)."""

    def __init__(self) -> None:
        self.room: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []  # sorted keys of room

    def put(self, space: int, first: int, many: int) -> None:
        if space > 0 and many > 0:
            if space not in self.room:
                self.room[space] = []
                bisect.insort(self.sizes, space)
            self.room[space].append((first, many))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """(space, first container, containers) of the tightest space of at least ``least``."""
        at = bisect.bisect_left(self.sizes, least)
        if at == len(self.sizes):
            return None
        space = self.sizes[at]
        first, many = self.room[space].pop()
        if not self.room[space]:
            del self.room[space]
            self.sizes.pop(at)
        return space, first, many


def plan_batches(histogram: dict[int, int], capacity: int, bounds: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the items of each length go: (length, first item, end item, first container, items per container, bucket).

    ``bucket`` is the bound of the bucket whose batch the container is.
    """
    segments: list[tuple[int, int, int, int, int, int]] = []
    placed = dict.fromkeys(histogram, 0)  # items of each length that have their place
    waiting = sorted(n for n, c in histogram.items() if c)  # lengths with items left
    opened = 0

    def fill(length: int, space: int, first: int, many: int, bound: int, spaces: _Spaces) -> None:
        """Items of one length into ``many`` containers with ``space`` each; what is left of them goes back to ``spaces``."""
        item, end, per = placed[length], histogram[length], space // length
        full = min(many, (end - item) // per)
        if full:
            segments.append((length, item, item + full * per, first, per, bound))
            spaces.put(space - per * length, first, full)
            item += full * per
        used, rest = full, end - item
        if full < many and 0 < rest < per:
            segments.append((length, item, end, first + full, per, bound))
            spaces.put(space - rest * length, first + full, 1)
            item, used = end, full + 1
        spaces.put(space, first + used, many - used)
        placed[length] = item
        if item == end:
            waiting.pop(bisect.bisect_left(waiting, length))

    for k in range(len(bounds) - 1, -1, -1):
        least, bound, spaces = bounds[k - 1] if k else 0, bounds[k], _Spaces()
        while waiting and waiting[-1] > least:
            length = waiting[-1]
            found = spaces.take(length)
            if found is None:
                many = -(-(histogram[length] - placed[length]) // (capacity // length))
                found = capacity, opened, many
                opened += many
            fill(length, *found, bound, spaces)
        while waiting and (found := spaces.take(waiting[0])):  # a space below the shortest item left stays
            fill(waiting[bisect.bisect_right(waiting, found[0]) - 1], *found, bound, spaces)
    return segments


def containers(df: DataFrame, key: str, text: str, *, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """(container_id, key, part, token_start, token_end, n_tokens, bucket): the items of every container.

    ``token_start`` and ``token_end`` cut the token sequence of a text above
    the capacity; any other text has one part from 0 to its length.
    """
    spark = df.sparkSession
    counts = token_counts(df, key, text, tokenizer)
    parts = counts.select(key, "n_tokens", F.posexplode(F.sequence(F.lit(0), F.expr(f"cast((n_tokens - 1) div {capacity} as int)"))).alias("part", "_p"))
    items = parts.select(
        F.col(key),
        (F.col("part") + 1).alias("part"),
        (F.col("_p") * capacity).cast("bigint").alias("token_start"),
        F.least(F.col("n_tokens"), (F.col("_p") + 1).cast("bigint") * capacity).alias("token_end"),
    ).withColumn("n_tokens", F.expr("cast(token_end - token_start as int)"))
    items = settle(items, "pack-items")
    salts = 1 + items.count() // SALT_ROWS
    items = items.withColumn("_salt", F.expr(f"cast(pmod(xxhash64(`{key}`, part), {salts}) as int)"))
    cells = items.groupBy("n_tokens", "_salt").agg(F.count("*").alias("_n"))
    histogram = {r[0]: r[1] for r in cells.groupBy("n_tokens").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    segments = plan_batches(histogram, capacity, bucket_bounds(histogram, buckets))
    plan = _segments(spark, segments)
    before = W.partitionBy("n_tokens").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = cells.select("n_tokens", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))  # one row for each salt and length
    within = W.partitionBy("n_tokens", "_salt").orderBy(key, "part")
    numbered = items.withColumn("_r", F.row_number().over(within) - 1).join(offsets, ["n_tokens", "_salt"]).withColumn("_i", F.col("_r") + F.col("_off"))
    placed = numbered.join(F.broadcast(plan), (numbered["n_tokens"] == plan["_len"]) & (numbered["_i"] >= plan["_a"]) & (numbered["_i"] < plan["_b"]))  # a few rows for each of at most `capacity` lengths
    return placed.select(F.expr("_c + (_i - _a) div _q").alias("container_id"), F.col(key), "part", "token_start", "token_end", "n_tokens", "bucket")


def _segments(spark: SparkSession, segments: list[tuple]) -> DataFrame:
    return spark.createDataFrame(segments, "_len int, _a bigint, _b bigint, _c bigint, _q bigint, bucket int")


def bucket_report(df: DataFrame, key: str, text: str, *, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n_items, n_tokens, padding): the buckets that dynamic programming chose and what padding to their bounds would cost."""
    spark = df.sparkSession
    lengths = token_counts(df, key, text, tokenizer)
    rest = lengths.select(F.expr(f"cast(pmod(n_tokens - 1, {capacity}) + 1 as int)").alias("n"), F.lit(1).cast("bigint").alias("c"))
    full = lengths.where(f"n_tokens > {capacity}").select(F.lit(capacity).alias("n"), F.expr(f"(n_tokens - 1) div {capacity}").alias("c"))
    hist = {r[0]: r[1] for r in rest.unionAll(full).groupBy("n").agg(F.sum("c")).collect()}  # at most `capacity` rows
    bounds = bucket_bounds(hist, buckets)
    rows = {b: [0, 0, 0] for b in bounds}
    for n, c in hist.items():
        b = bounds[bisect.bisect_left(bounds, n)]
        rows[b][0] += c
        rows[b][1] += c * n
        rows[b][2] += c * (b - n)
    return spark.createDataFrame([(b, *v) for b, v in rows.items()], "bucket int, n_items bigint, n_tokens bigint, padding bigint")

"""Reworded passages: cosine over light stems, joined on stems, never all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsieve.functions.text import stems, words
from docsieve.sources.settle import settle


def stem_bags(df: DataFrame, keys: list[str], text: str, *, at_least: int = 6) -> DataFrame:
    """(keys.., stem, tf, sq): stem counts of the texts with at least ``at_least`` stems; sq is the squared norm."""
    flat = df.select(*keys, F.explode(stems(words(F.col(text)))).alias("stem"))
    tf = flat.groupBy(*keys, "stem").agg(F.count("*").alias("tf"))
    whole = W.partitionBy(*keys)
    sized = tf.withColumn("sq", F.sum(F.col("tf") * F.col("tf")).over(whole)).withColumn("_n", F.sum("tf").over(whole))
    return sized.where(F.col("_n") >= at_least).select(*keys, "sq", "stem", "tf")


def _prefixed(bags: DataFrame, keys: list[str], df: DataFrame, min_score: float, min_shared: int) -> DataFrame:
    """(keys.., sq, prefix, rest, rest_sq): each text's stems in two parts, the rarer ones that a similar text must hold one of, and the rest.

    Two texts that have no stem of the prefix in common have all common stems
    among the rest, whose norm is below ``min_score`` of the whole or which are
    fewer than ``min_shared``; so no similar pair is lost, and the stems of most
    texts, which would pair all with all, are hardly ever in a prefix.
    """
    ranked = bags.join(df, "stem").groupBy(*keys, "sq").agg(F.array_sort(F.collect_list(F.struct("df", "stem", F.col("tf").cast("bigint").alias("tf")))).alias("_s"))  # one text's stems
    fold = f"""aggregate(reverse(_s), named_struct('sum', cast(0 as bigint), 'n', 0, 'cut', 0),
     (acc, x) -> if(acc.n = acc.cut and (acc.n < {min_shared - 1} or acc.sum + x.tf * x.tf < {min_score} * {min_score} * sq * 0.999999), named_struct('sum', acc.sum + x.tf * x.tf, 'n', acc.n + 1, 'cut', acc.cut + 1), named_struct('sum', acc.sum, 'n', acc.n + 1, 'cut', acc.cut)), acc -> least(acc.cut, size(_s) - 1))"""
    cut = ranked.withColumn("_cut", F.expr(fold))
    rest = F.slice("_s", F.size("_s") - F.col("_cut") + 1, F.col("_cut"))
    return cut.select(*keys, "sq", F.slice("_s", F.lit(1), F.size("_s") - F.col("_cut")).alias("prefix"), rest.alias("rest")).withColumn("rest_sq", F.aggregate("rest", F.lit(0).cast("bigint"), lambda a, x: a + x["tf"] * x["tf"]))


def similar_pairs(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str], *, min_score: float = 0.62, min_shared: int = 6) -> DataFrame:
    """(left keys.., right keys.., shared, score) of two bags: cosine at least ``min_score`` over at least ``min_shared`` stems.

    The rarer stems of the left texts are joined with all of the right; what
    the rest can add at most decides which pairs are completed.  Dot products
    are exact integers and are divided last.
    """
    both_keys = [*left_keys, *right_keys]
    df = left.select("stem").unionAll(right.select("stem")).groupBy("stem").agg(F.count("*").alias("df"))
    l = settle(_prefixed(left, left_keys, df, min_score, min_shared), "similar-left")
    r = right.select(*right_keys, F.col("sq").alias("_rs"), "stem", F.col("tf").cast("bigint").alias("_rt"))
    rare = l.select(*left_keys, F.col("sq").alias("_ls"), F.col("rest_sq").alias("_q"), F.size("rest").alias("_m"), F.explode("prefix").alias("_p")).select(*left_keys, "_ls", "_q", "_m", F.col("_p.stem").alias("stem"), F.col("_p.tf").alias("_lt"))
    part = rare.join(r, "stem").groupBy(*both_keys).agg(F.sum(F.col("_lt") * F.col("_rt")).alias("_dot"), F.count("*").alias("_n"), F.first("_ls").alias("_ls"), F.first("_rs").alias("_rs"), F.first("_q").alias("_q"), F.first("_m").alias("_m"))
    norm = F.sqrt(F.col("_ls").cast("double")) * F.sqrt(F.col("_rs").cast("double"))
    able = part.where((F.col("_n") + F.col("_m") >= min_shared) & (F.col("_dot") + F.sqrt(F.col("_q").cast("double")) * F.sqrt(F.col("_rs").cast("double")) >= min_score * norm * 0.999999))
    bags = right.groupBy(*right_keys).agg(F.map_from_entries(F.collect_list(F.struct("stem", F.col("tf").cast("bigint")))).alias("_bag"))  # one text's stems
    done = able.join(l.select(*left_keys, "rest"), left_keys).join(bags, right_keys)
    more = F.filter(F.transform("rest", lambda x: x["tf"] * F.try_element_at(F.col("_bag"), x["stem"])), lambda v: v.isNotNull())
    done = done.withColumn("_more", more).withColumn("shared", F.col("_n") + F.size("_more")).withColumn("score", (F.col("_dot") + F.aggregate("_more", F.lit(0).cast("bigint"), lambda a, v: a + v)) / norm)
    return done.where((F.col("shared") >= min_shared) & (F.col("score") >= min_score)).select(*both_keys, "shared", "score")


TABLE_CELLS = 4_000_000  # 8 bytes each, in every task


def similar_texts(texts: DataFrame, keys: list[str], right: DataFrame, right_key: str, *, text: str = "text", at_least: int = 6, min_score: float = 0.62, min_shared: int = 6) -> DataFrame:
    """``similar_pairs`` of texts with the bags of a few others: their stem counts are one table in every task, so no pair is moved.

    Texts with the same keys are one bag.  Beyond the table's size the stems are joined.
    """
    many = right.agg(F.count_distinct("stem").alias("s"), F.count_distinct(right_key).alias("t")).first()
    if many.s * many.t > TABLE_CELLS:
        return similar_pairs(stem_bags(texts, keys, text, at_least=at_least), keys, right, [right_key], min_score=min_score, min_shared=min_shared)
    rows = right.select(right_key, "sq", "stem", "tf").collect()  # as many as the table's cells at most
    column = {k: j for j, k in enumerate(dict.fromkeys(r[0] for r in rows))}
    line = {w: i for i, w in enumerate(dict.fromkeys(r.stem for r in rows))}
    counts, theirs = np.zeros((len(line), len(column))), np.zeros(len(column))
    for r in rows:
        counts[line[r.stem], column[r[0]]], theirs[column[r[0]]] = r.tf, r.sq
    names, n = list(column), len(keys)
    bags = texts.select(*keys, stems(words(F.col(text))).alias("_s")).groupBy(*keys).agg(F.flatten(F.collect_list("_s")).alias("_s")).where(F.size("_s") >= at_least)
    kinds = {f.name: f.dataType.simpleString() for f in [*texts.select(*keys).schema, right.schema[right_key]]}
    kind = pa.from_numpy_dtype(np.asarray(names).dtype) if names and not isinstance(names[0], str) else pa.string()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = np.sqrt(theirs)
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                b = whole.slice(first, 512)
                lists = b.column(n)
                coded = lists.flatten().dictionary_encode()
                known = np.array([line.get(w, -1) for w in coded.dictionary.to_pylist()], dtype=np.int64)
                row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
                cell, tf = np.unique(row * max(1, len(known)) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                row, stem = cell // len(known), known[cell % len(known)]
                sq = np.bincount(row, tf * tf, b.num_rows)
                row, stem, tf = row[stem >= 0], stem[stem >= 0], tf[stem >= 0]
                some, start = np.unique(row, return_index=True)
                if not len(some) or not len(names):
                    continue
                score = np.add.reduceat(counts[stem] * tf[:, None], start, axis=0) / (np.sqrt(sq[some])[:, None] * root)  # exact integers, divided last
                at, j = np.nonzero(score >= min_score)
                end = np.append(start[1:], len(row))
                shared = np.array([np.count_nonzero(counts[stem[start[a] : end[a]], c]) for a, c in zip(at, j, strict=True)], dtype=np.int64)
                at, j, shared = at[shared >= min_shared], j[shared >= min_shared], shared[shared >= min_shared]
                take = pa.array(some[at], pa.int64())
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(take) for c in range(n)], pa.array([names[c] for c in j], kind), pa.array(shared), pa.array(score[at, j])], names=[*keys, right_key, "shared", "score"])

    return bags.mapInArrow(compare, ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + ", shared bigint, score double")


def without_common_run(pairs: DataFrame, texts_left: DataFrame, left_keys: list[str], texts_right: DataFrame, right_keys: list[str], text: str = "text", k: int = 10) -> DataFrame:
    """Drop pairs that share ``k`` stems in a row: those are verbatim reuse.  A common run exists exactly if a common k-gram does."""

    def grams(df: DataFrame, keys: list[str]) -> DataFrame:
        s = df.select(*keys, stems(words(F.col(text))).alias("_s")).where(F.size("_s") >= k)
        return s.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.size("_s") - k + 1), lambda i: F.xxhash64(F.slice("_s", i, k)))).alias("_g")).distinct()

    l = grams(texts_left.join(pairs.select(*left_keys).distinct(), left_keys, "left_semi"), left_keys)
    r = grams(texts_right.join(pairs.select(*right_keys).distinct(), right_keys, "left_semi"), right_keys)
    return pairs.join(l.join(r, "_g").select(*left_keys, *right_keys).distinct(), [*left_keys, *right_keys], "left_anti")


def similarity_confidence(score: Column) -> Column:
    return F.round(F.least(F.lit(0.95), 0.5 + 0.45 * score), 3)


def budgeted(subjects: DataFrame, sources: DataFrame, pairs: DataFrame, subject_keys: list[str], source_keys: list[str], *, budget: int = 50_000) -> DataFrame:
    """The pairs that fall within a comparison budget, without comparing the others.

    Every eligible subject meets every source in the order of their keys; the
    number of a pair follows from both places, so the cut needs no comparison.
    Places are counted per range first and never by one task alone.
    """
    s, b = numbered(subjects, subject_keys, "_s"), numbered(sources, source_keys, "_b")
    n = sources.agg(F.count("*").alias("_n"))
    j = pairs.join(s, subject_keys).join(b, source_keys).crossJoin(F.broadcast(n))  # one row
    return j.where(F.col("_s") * F.col("_n") + F.col("_b") < budget).drop("_s", "_b", "_n")


def first_in_order(df: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """The first ``budget`` rows in the order of their keys: what a sequential comparison would get to."""
    return numbered(df, keys, "_i").where(F.col("_i") < budget).drop("_i")


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys.., name): the place of each row in the order of its keys, from 0.

    Rows are range-partitioned and sorted; the partitions' sizes, one number
    each, give the offsets.
    """
    rows = settle(df.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_off")  # one row a partition
    within = F.row_number().over(W.partitionBy("_part").orderBy(*keys)) - 1
    return rows.withColumn("_i", within).join(F.broadcast(offsets), "_part").select(*keys, (F.col("_i") + F.col("_off")).alias(name))


def comparison_budget(subjects: DataFrame, sources: DataFrame, budget: int = 50_000) -> DataFrame:
    """(comparisons, budget, exhausted) in closed form: every eligible subject against every source, in loop order, up to the budget."""
    s, b = subjects.agg(F.count("*").alias("s")), sources.agg(F.count("*").alias("b"))
    total = F.col("s") * F.col("b")
    return s.join(F.broadcast(b)).select(F.least(total, F.lit(budget).cast("bigint")).alias("comparisons"), F.lit(budget).cast("bigint").alias("budget"), (total > budget).cast("int").alias("exhausted"))  # one row each

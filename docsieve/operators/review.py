"""Review bookkeeping: decisions, budgets, idempotent evidence, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the result contract: the states of a task and where each may go.
TRANSITIONS = {
    "created": ["validating"],
    "validating": ["parsing", "validation_failed"],
    "validation_failed": ["validating"],
    "parsing": ["references_ready", "parsing_failed"],
    "parsing_failed": ["parsing"],
    "references_ready": ["fetching_sources", "checking"],
    "fetching_sources": ["indexing", "checking_failed"],
    "indexing": ["checking", "checking_failed"],
    "checking": ["review_ready", "reviewed", "checking_failed"],
    "checking_failed": ["fetching_sources", "checking", "retention_pending"],
    "review_ready": ["checking", "reviewed"],
    "reviewed": ["reporting"],
    "reporting": ["completed"],
    "completed": ["retention_pending"],
    "retention_pending": ["purged", "purge_failed"],
    "purge_failed": ["retention_pending"],
    "purged": [],
}


def latest(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """One row per key: the last by ``order``; an aggregation, so a hot key is combined map-side."""
    return df.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(key, *[F.col(f"_v.{v}").alias(v) for v in values])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by ``order`` (never an arbitrary one)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(*keys, *[F.col(f"_v.{v}").alias(v) for v in rest]).select(*df.columns)


def allowed(source: Column, target: Column) -> Column:
    """Whether a task may go from one state to the other; unknown states may not."""
    table = F.create_map(*[x for s, ts in TRANSITIONS.items() for x in (F.lit(s), F.array(*[F.lit(t) for t in ts]).cast("array<string>"))])
    return F.coalesce(F.array_contains(F.try_element_at(table, source), target), F.lit(False))


def prefix_budget(df: DataFrame, group: str, order: list[str], size: Column, budget: int) -> DataFrame:
    """Rows of each group whose running total stays within the budget."""
    total = F.sum(size).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("running", total).where(F.col("running") <= budget)


def skipping_budget(df: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """(group, order, size) of the rows taken in order where an item that would overflow is skipped and later ones may still fit.

    The fold is per task, whose items are bounded by its own limits.
    """
    fold = """aggregate(array_sort(_items), named_struct('used', cast(0 as bigint), 'taken', filter(_items, x -> false)),
      (acc, x) -> if(acc.used + x.s > {0}, acc, named_struct('used', acc.used + x.s, 'taken', concat(acc.taken, array(x)))), acc -> acc.taken)""".format(budget)
    items = df.groupBy(group).agg(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("s"))).alias("_items"))
    return items.select(group, F.explode(F.expr(fold)).alias("x")).select(group, F.col("x.o").alias(order), F.col("x.s").alias(size))


def fingerprint(*fields: Column) -> Column:
    """SHA-256 of the fields in a canonical form that tells null from empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.concat(F.lit("="), f.cast("string")), F.lit("~")) for f in fields]), 256)


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``existing`` with ``batch`` merged by key; the batch is reduced to its first row per key before."""
    new = keep_first(batch, keys, order)
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


def purge(assets: DataFrame, roles: list[str]) -> DataFrame:
    """Assets of temporary roles that aren't purged yet, marked purged."""
    return assets.where(F.col("role").isin(roles) & (F.col("retention_state") != "purged")).withColumn("retention_state", F.lit("purged"))

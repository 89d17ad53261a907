"""Claims for the detectors, made from numeric columns by expressions that both engines read.

The test tables hold few of the sentences that the rule detectors look for.
Each template is a list of SQL expressions over one table; the query runs them
through Spark and its SQL reads the same columns, so the expected finding comes
from the numbers, not from reading the text again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsieve.sources.tables import table


def _s(e: str) -> str:
    return f"CAST({e} AS STRING)"


# name: (table, columns it reads, expressions of document_id, block_idx, page and text)
TEMPLATES: dict[str, tuple[str, list[str], list[str]]] = {
    "thresholds": (
        "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", "l_partkey"],
        [
            f"concat('order-', {_s('l_orderkey')}) AS document_id", "CAST(l_linenumber * 100000000000 + l_partkey * 1000 + CAST(l_quantity AS INT) AS BIGINT) AS block_idx", "CAST(1 + l_linenumber % 3 AS INT) AS page",
            f"concat('An earlier run gave 9 ± 1 mV. The yield now was ', {_s('CAST(l_quantity AS INT)')}, ' ± ', {_s('l_linenumber')}, ' .5 units ( < ', {_s('l_suppkey % 60 + 1')}, ' ) again.') AS text",
        ],
    ),
    "averages": (
        "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", "l_partkey"],
        [
            f"concat('order-', {_s('l_orderkey')}) AS document_id", "CAST(l_linenumber * 100000000000 + l_partkey * 1000 + CAST(l_quantity AS INT) AS BIGINT) AS block_idx", "CAST(1 + l_linenumber % 3 AS INT) AS page",
            f"concat('Values of 1, 1, 1 and 1 ns came first. Then ', {_s('CAST(l_quantity AS INT)')}, ', ', {_s('CAST(l_quantity AS INT) + l_linenumber')}, ', 2 and ', {_s('l_suppkey % 7')}, ' ns were listed; an average lifetime of approximately ', {_s('CAST(l_quantity AS INT) % 9 + l_partkey % 5')}, ' ns followed.') AS text",
        ],
    ),
    "measurements": (
        "part", ["p_partkey", "p_brand", "p_size"],
        [
            "p_brand AS document_id", "CAST(p_partkey AS INT) AS block_idx", "CAST(1 + p_partkey % 9 AS INT) AS page",
            f"concat('The emission lifetime of the crystal was ', {_s('p_size')}, ' ns at ', CASE p_partkey % 3 WHEN 0 THEN '10' WHEN 1 THEN '77' ELSE '300' END, ' K.') AS text",
        ],
    ),
    "subjects": (
        "customer", ["c_custkey", "c_nationkey", "c_mktsegment"],
        [
            f"concat('nation-', {_s('c_nationkey')}) AS document_id", "CAST(c_custkey AS INT) AS block_idx", "CAST(1 + c_custkey % 5 AS INT) AS page",
            "concat(CASE c_custkey % 4 WHEN 0 THEN 'The results come from different patients of segment ' WHEN 1 THEN 'These spectra were not recorded from the same samples of segment ' WHEN 2 THEN 'Data are available on reasonable request for segment ' ELSE 'Samples of one group were measured twice in segment ' END, lower(c_mktsegment), '.') AS text",
        ],
    ),
    "citing": (
        "orders", ["o_orderkey", "o_custkey"],
        [
            f"concat('paper-', {_s('o_custkey % 39')}) AS document_id", "CAST(o_orderkey AS INT) AS block_idx", "CAST(1 + o_orderkey % 8 AS INT) AS page",
            f"concat(CASE WHEN o_orderkey % 7 = 3 THEN concat('[', {_s('1 + o_custkey % 4')}, '] The machine output entry') "
            f"WHEN o_orderkey % 7 = 6 THEN concat('Weather stayed calm all week near villages [', {_s('1 + o_custkey % 4')}, ']') "
            f"ELSE concat('The machine output ', CASE o_orderkey % 7 WHEN 1 THEN 'decreased' WHEN 2 THEN 'did not increase' ELSE 'increased' END, ' to ', {_s('10 + o_orderkey % 5')}, ' units [', CASE o_orderkey % 7 WHEN 4 THEN '9' WHEN 5 THEN concat({_s('1 + o_custkey % 4')}, ', 9') ELSE {_s('1 + o_custkey % 4')} END, ']') END, '.') AS text",
        ],
    ),
    "cited": (
        "orders", ["o_custkey"],
        [
            f"concat('paper-', {_s('o_custkey % 39')}) AS document_id", "CAST(1 + o_custkey % 4 AS INT) AS ordinal", "CAST(o_custkey % 39 * 10 + 1 + o_custkey % 4 AS INT) AS doc_idx",
            f"concat('work-', {_s('o_custkey % 39')}, '-', {_s('1 + o_custkey % 4')}) AS source_id",
            f"concat('The machine output increased to ', {_s('10 + (o_custkey % 39 + 1 + o_custkey % 4) % 5')}, ' units in spring.') AS source_text",
        ],
    ),
}


def claims(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The blocks of a template: (document_id, block_idx, page, text) and a box."""
    source, columns, expressions = TEMPLATES[name]
    rows = table(spark, d, source, *columns).selectExpr(*expressions)
    return rows.selectExpr("*", "array(CAST(page AS DOUBLE), 10.0D, page + 0.5D, 20.0D) AS bbox") if "block_idx" in rows.columns else rows.distinct()


def sql(name: str) -> str:
    """The same as a SELECT, with the columns of its table beside."""
    source, columns, expressions = TEMPLATES[name]
    return f"SELECT {', '.join([*columns, *expressions])} FROM {source}"

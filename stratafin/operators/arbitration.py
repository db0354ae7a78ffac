"""Which of several extractions of a document to keep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafin.operators.statements import FIELDS

#: Fixed value: strategies in the order that wins ties.
STRATEGIES = ("structured", "plain", "direct")


def known_fields(fields: Sequence[str] = FIELDS) -> Column:
    """How many of the facts a row holds."""
    return sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))


def pick_strategy(candidates: DataFrame, key: str = "doc_id", fields: Sequence[str] = FIELDS) -> DataFrame:
    """The candidate of each document with the most facts; the earlier strategy wins ties, an unknown one comes last.

    ``max_by`` over the score is an aggregate with map-side combine; one row a
    document and task is shuffled.
    """
    order = F.coalesce(F.array_position(F.array(*map(F.lit, STRATEGIES)), F.col("strategy")), F.lit(0))
    order = F.when(order == 0, len(STRATEGIES) + 1).otherwise(order)
    rest = [c for c in candidates.columns if c != key]
    scored = candidates.withColumn("score", known_fields(fields))
    best = F.max_by(F.struct(*rest, "score"), F.struct(F.col("score"), -order, F.coalesce("strategy", F.lit(""))))
    return scored.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def first_known(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value): the known value that comes first."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias(value))


def last_known(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value): the known value that comes last."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, order).alias(value))


def distinct_in_order(df: DataFrame, item: str, order: str) -> DataFrame:
    """(item, first): every item once, with where it first stood."""
    return df.groupBy(item).agg(F.min(order).alias("first"))

"""Readers of the parquet tables, with re-delivered rows counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafin.session import reach, stage

#: Most repeated keys that are broadcast (about 24 bytes each).
REPEATED_KEYS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the data folder; columns and filters are pushed to the scan."""
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def newest(df: DataFrame, key: str, at: str, *cols: str) -> DataFrame:
    """One row a key: the latest by ``at``, ties by the greatest of the row's other values in their order.

    For narrow rows: the aggregate sorts and moves one whole row a key and map
    task. Rows with texts go through ``once``.
    """
    rest = [c for c in (cols or df.columns) if c not in (key, at)]
    best = F.max(F.struct(F.col(at), *rest))
    keep = [c for c in (cols or df.columns) if c != key]
    return df.groupBy(key).agg(best.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in keep])


def once(df: DataFrame, key: str, at: str, *cols: str, bound: int = REPEATED_KEYS) -> DataFrame:
    """Like ``newest``, for rows with texts: what is not delivered twice stays where it lies.

    The keys that occur more than once are found from the key column alone and
    staged; up to ``bound`` of them are broadcast, and only their rows are moved
    to be compared. Beyond that all rows are. Rows without a key are kept each.
    """
    keep = [key, *[c for c in (cols or df.columns) if c != key]]
    rows = df.select(*dict.fromkeys([*keep, at]))
    repeated = stage(df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key))
    n = repeated.count()
    if not n:
        return rows.select(*keep)
    if n > bound:
        single, several = rows.filter(F.col(key).isNull()), rows.filter(F.col(key).isNotNull())
    else:
        single, several = rows.join(F.broadcast(repeated), key, "left_anti"), rows.join(F.broadcast(repeated), key, "left_semi")
    return single.select(*keep).union(newest(several, key, at).select(*keep))

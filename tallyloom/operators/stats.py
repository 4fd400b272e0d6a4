"""Exact column statistics of relations."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..sources.catalog import Catalog


def column_stats(df: DataFrame) -> DataFrame:
    """One row per column c<i>: column, low, high, n_rows, n_distinct.

    One scan: the columns are stacked, pre-aggregated per (column, value)
    before the only wide shuffle, then per column; no sort and no expand of
    a distinct aggregate.
    """
    n = len(df.columns)
    pairs = ", ".join(f"{i}L, `{c}`" for i, c in enumerate(df.columns))
    values = df.select(F.expr(f"stack({n}, {pairs}) as (column, value)"))
    counted = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("k"))
    return counted.groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("k").alias("n_rows"), F.count("value").alias("n_distinct"))


def catalog_stats(catalog: Catalog) -> DataFrame:
    """``column_stats`` of every relation, with its id in ``relation``."""
    parts = [column_stats(catalog[i]).select(F.lit(i).cast("bigint").alias("relation"), "*") for i in range(len(catalog)) if catalog.width(i)]
    return reduce(DataFrame.unionByName, parts)

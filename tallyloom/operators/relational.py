"""Scans as (key, row) lists and their ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def filtered_scan(df: DataFrame, conditions: list[Column], columns: list[str]) -> DataFrame:
    """Rows that meet all conditions, reduced to the named columns; both reach the scan."""
    for c in conditions:
        df = df.where(c)
    return df.select(*columns)


def sort_by_key(df: DataFrame, key: str, row: str) -> DataFrame:
    """Global order by (key, row): a range partitioning and a sort within partitions."""
    return df.orderBy(key, row)

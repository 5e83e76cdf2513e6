"""Retention, trimming and clean-up: what stays of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reads import ntz


def effective(requested: Column, overall: Column) -> Column:
    """The smaller period; null is unlimited on its side."""
    return F.least(requested, overall)  # least() skips nulls


def keep_since(rows: DataFrame, ts: str, cutoff) -> DataFrame:
    """Rows at the cut-off or later; the filter reaches the scan and prunes date partitions."""
    return rows.where(F.col(ts) >= ntz(cutoff))


def keep_newest(rows: DataFrame, key: str, ts: str, id_column: str, count: int) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(id_column))
    return rows.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= count).drop("nth")


def cleanup(rows: DataFrame, ts: str, cutoff, key: str | None = None, ids: list | None = None) -> DataFrame:
    """Without rows before the cut-off, of the given series only if any are given."""
    old = F.col(ts) < ntz(cutoff)
    return rows.where(~F.coalesce(old & F.col(key).isin(ids) if ids is not None else old, F.lit(False)))


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.where(~F.coalesce(condition, F.lit(False)))


def trim(rows: DataFrame, key: str, ts: str, id_column: str, cutoff=None, count: int = 0) -> DataFrame:
    """By age if there is a period, else by count if there is one."""
    if cutoff is not None:
        return keep_since(rows, ts, cutoff)
    return keep_newest(rows, key, ts, id_column, count) if count > 0 else rows


def deactivate(dimension: DataFrame, key: str, ids: list) -> DataFrame:
    """Soft deletion: the rows stay, with is_active false."""
    was = F.col("is_active") if "is_active" in dimension.columns else F.lit(True)
    return dimension.withColumn("is_active", was & ~F.coalesce(F.col(key).isin(ids), F.lit(False)))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counted = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count")) for name, df in sorted(tables.items())]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionAll(c)
    return out

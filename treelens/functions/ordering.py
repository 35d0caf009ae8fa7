"""Sort keys: missing values first ascending and last descending, ties by id
ascending; and positions in a total order without a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Sort
from ..sources.shared import materialize


def sort_column(name: str, descending: bool = False) -> Column:
    c = F.col(f"`{name}`")
    return c.desc_nulls_last() if descending else c.asc_nulls_first()


def sort_keys(sorts: Sequence[Sort], id_col: str = "id", prefix: str = "") -> list[Column]:
    """The sorts, then id ascending, whatever their directions."""
    keys = [sort_column(prefix + s.field, s.descending) for s in sorts]
    return [*keys, F.col(f"`{prefix}{id_col}`").asc_nulls_first()]


def reversed_keys(sorts: Sequence[Sort], id_col: str = "id") -> list[Column]:
    """The whole order backwards: missing values and ties too."""
    keys = [sort_column(s.field, not s.descending) for s in sorts]
    return [*keys, F.col(f"`{id_col}`").desc_nulls_last()]


def numbered(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """df with each row's position from 0 in the given order.

    Rows are range-partitioned and numbered within their range; the totals of
    the ranges before (a number each) are added.  No task sees all rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    kept = materialize(dealt.withColumn("__at", F.monotonically_increasing_id()))
    part, inner = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["part"]: r["n"] for r in kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, at = [], 0
    for k in range(max(counts, default=-1) + 1):
        offsets.append(at)
        at += counts.get(k, 0)
    first = F.element_at(F.split(F.lit(",".join(map(str, offsets or [0]))), ","), part.cast("int") + 1).cast("long")
    return kept.withColumn(name, first + inner).drop("__at")

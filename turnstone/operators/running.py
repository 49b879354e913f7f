"""Running aggregates that stay parallel when one key holds most of the rows.

A plain window sends a whole key to one task. Here a key's rows are split into
blocks that follow the sort order; each block is windowed on its own and the
totals of earlier blocks, one small row each, are added on top.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.session import ensure_checkpoint_dir

BLOCK = 65_536


@dataclass(frozen=True)
class Running:
    """``kind`` is sum, count or max. ``before`` leaves the current row out."""

    name: str
    kind: str
    value: Column
    before: bool = False


_AGGREGATE = {"sum": F.sum, "count": F.count, "max": F.max}
_COMBINE = {"sum": F.sum, "count": F.sum, "max": F.max}


def int_block(position: Column, size: int = BLOCK) -> Column:
    """Blocks for a dense integer position."""
    return F.floor(position / size)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column,
            wanted: Sequence[Running]) -> DataFrame:
    """``df`` plus one column per wanted aggregate over ``keys`` in ``order``.
    ``block`` must not decrease along the order. Keys must not be null."""
    keys = list(keys)
    base = df.withColumn("_block", block)
    totals = base.groupBy(*keys, "_block").agg(
        *[_AGGREGATE[w.kind](w.value).alias(f"_t_{w.name}") for w in wanted])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_block", *[
        _COMBINE[w.kind](f"_t_{w.name}").over(earlier).alias(f"_o_{w.name}") for w in wanted])
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    joined = base.join(offsets, [*keys, "_block"])
    out = joined
    for w in wanted:
        frame = inside.rowsBetween(Window.unboundedPreceding, -1 if w.before else 0)
        local, offset = _AGGREGATE[w.kind](w.value).over(frame), F.col(f"_o_{w.name}")
        both = F.greatest(local, offset) if w.kind == "max" else (
            F.coalesce(local, F.lit(0)) + F.coalesce(offset, F.lit(0)))
        out = out.withColumn(w.name, both)
    return out.drop("_block", *[f"_o_{w.name}" for w in wanted])


def spread_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` with ``_spread``, blocks that follow the order and hold about equally
    many rows: the partitions of a range shuffle on keys and order together, so one
    key's rows are split as well. Any orderable type will do. Written out once,
    because the sample that sets the bounds is drawn anew by every run."""
    ensure_checkpoint_dir(df.sparkSession)
    along = [*map(F.col, keys), *order]
    return df.repartitionByRange(*along).withColumn("_spread", F.spark_partition_id()).checkpoint()


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column,
             name: str) -> DataFrame:
    """``row_number`` by the same means, counted from one."""
    return running(df, keys, order, block, [Running(name, "count", F.lit(1))])

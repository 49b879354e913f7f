"""Exact order statistics per key without sorting a key in one task.

A first pass keeps one KLL sketch per key: a small state that merges over days,
partitions or keys. Its quantiles a little to each side of a rank bracket the value
there. A second pass counts: values inside a bracket each, all between two brackets
as one number, so that little more than the brackets is shuffled. A rank that falls
outside its bracket, which the sketch makes very unlikely, is looked up again without.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.operators.running import BLOCK, Running, running, spread_blocks
from turnstone.session import ensure_checkpoint_dir

SKETCH_K = 800  # rank error about 0.35 %
STEPS = 200  # of the quantiles read from a sketch
MARGIN = 2  # steps from a rank to the ends of its bracket, 1 %


def is_value(value: str) -> Column:
    """Null and NaN are no values and have no rank."""
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def sketch(value: str) -> Column:
    """An aggregate: the mergeable state of a column's values."""
    return F.kll_sketch_agg_double(F.when(is_value(value), F.col(value).cast("double")), F.lit(SKETCH_K))


def merged(column: str) -> Column:
    """An aggregate: the state of several states."""
    return F.kll_merge_agg_double(column, F.lit(SKETCH_K))


def sketches(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key ``total``, the number of values, and their ``sketch``."""
    return rows.where(is_value(value)).groupBy(*keys).agg(
        F.count("*").alias("total"), sketch(value).alias("sketch"))


def order_statistics(rows: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Column],
                     states: DataFrame | None = None) -> DataFrame:
    """Per key ``total`` and the value at each one-based rank; a rank is an expression
    over ``total``. Keys must not be null; a key without values has no row. ``rows``
    is read twice, or once if ``states`` (keys, total, sketch) is kept."""
    ensure_checkpoint_dir(rows.sparkSession)
    keys, names = list(keys), list(ranks)
    states = sketches(rows, keys, value) if states is None else states.where("total > 0")
    wanted = states.select(*keys, "total", "sketch", *[r.cast("long").alias(f"_r{i}") for i, r in enumerate(ranks.values())])
    found = _look(rows, keys, value, names, wanted, MARGIN)
    holes = found.where(" or ".join(f"`{n}` is null" for n in names))
    if not holes.isEmpty():
        missed = wanted.join(holes, keys, "left_semi")
        again = _look(rows.join(missed.select(*keys), keys, "left_semi"), keys, value, names, missed, STEPS)
        found = found.join(again, keys, "left_anti").unionByName(again)
    return found


def _look(rows: DataFrame, keys: list[str], value: str, names: list[str], wanted: DataFrame, margin: int) -> DataFrame:
    """A rank outside its bracket comes back as null."""
    steps = ", ".join(f"{i / STEPS}D" for i in range(STEPS + 1))
    wanted = wanted.withColumn("_grid", F.expr(f"kll_sketch_get_quantile_double(sketch, array({steps}))"))

    def low(i: int) -> Column:
        step = F.floor(F.col(f"_r{i}") * STEPS / F.col("total")).cast("int") - margin
        return F.when(step > 0, F.get("_grid", step)).otherwise(float("-inf"))

    def high(i: int) -> Column:
        step = F.ceil(F.col(f"_r{i}") * STEPS / F.col("total")).cast("int") + margin
        return F.when(step < STEPS, F.get("_grid", step)).otherwise(float("inf"))

    every = range(len(names))
    brackets = wanted.select(*keys, "total", *[f"_r{i}" for i in every], *[low(i).alias(f"_l{i}") for i in every],
                             *[high(i).alias(f"_h{i}") for i in every]).checkpoint()
    v = F.col(value).cast("double")
    # How many bounds lie below a value orders the stretches between them.
    stretch = sum(((F.col(f"_{s}{i}") < v).cast("int") for i in every for s in "lh"), F.lit(0))
    covered = F.lit(False)
    for i in every:
        covered = covered | ((v >= F.col(f"_l{i}")) & (v <= F.col(f"_h{i}")))
    bounds = brackets.drop("total", *[f"_r{i}" for i in every])
    cells = rows.where(is_value(value)).join(bounds, keys).groupBy(
        *keys, stretch.alias("_stretch"), F.when(covered, F.col(value)).alias("_value")).agg(F.count("*").alias("_n"))
    # Uncounted values of a stretch lie below its last one, which may be a bound itself.
    order = [F.col("_stretch"), F.col("_value").asc_nulls_first()]
    share = min(1.0, len(names) * (2 * margin + 2) / STEPS)  # about, of a key's rows
    largest = brackets.agg(F.max("total")).first()[0] or 0
    if largest * share <= BLOCK:
        along = Window.partitionBy(*keys).orderBy(*order)
        upto = cells.withColumn("_upto", F.sum("_n").over(along))
    else:
        blocks = spread_blocks(cells.checkpoint(), keys, order)
        upto = running(blocks, keys, order, F.col("_spread"), [Running("_upto", "sum", F.col("_n"))])
    reached = [F.min_by("_value", F.when(F.col("_upto") >= F.col(f"_r{i}"), F.col("_upto"))).alias(n)
               for i, n in enumerate(names)]
    return upto.join(brackets.select(*keys, "total", *[f"_r{i}" for i in every]), keys).groupBy(*keys).agg(
        F.first("total").alias("total"), *reached).checkpoint()


def index_rank(fraction: float) -> Column:
    """Rank of ``sorted(values)[int(fraction * n)]``."""
    return F.floor(F.lit(fraction) * F.col("total")) + 1


def median_ranks() -> tuple[Column, Column]:
    """The two ranks whose mean is the interpolated median."""
    return F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1

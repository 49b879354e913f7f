"""The advertisement rule over a table of turns, one row per turn.

``parse.flag_ads`` is for turns still held in their transcript's row. Here a
key may own any share of the table, so the rule is two running maxima over
blocks: a follower counts if the last opener is no older than the last break.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions import text as tx
from turnstone.operators.running import Running, int_block, running
from turnstone.settings import DEFAULTS, Settings


def flag_ad_turns(turns: DataFrame, keys: Sequence[str], position: str,
                  settings: Settings = DEFAULTS, block: Column | None = None) -> DataFrame:
    """Add ``is_sponsor`` to ``turns(keys.., position, speaker, text)``."""
    block = int_block(F.col(position)) if block is None else block
    low = F.lower("text")
    marked = turns.withColumn("_opens", tx.contains_any(low, settings.ad_openers)).withColumn(
        "_follows", tx.contains_any(low, settings.ad_followers))
    order = [F.col(position)]
    # Last (position, speaker) before this row, across block borders.
    before = running(marked, keys, order, block, [
        Running("_prev", "max", F.struct(F.col(position).alias("p"), F.col("speaker")), True)])
    same = F.coalesce(F.col("_prev.speaker") == F.col("speaker"), F.lit(False))
    breaks = ~same | ~(F.col("_opens") | F.col("_follows"))
    seen = running(before.withColumn("_breaks", breaks), keys, order, block, [
        Running("_last_break", "max", F.when(F.col("_breaks"), F.col(position))),
        Running("_last_open", "max", F.when(F.col("_opens"), F.col(position)))])
    hangs = F.col("_follows") & F.coalesce(
        F.col("_last_open") >= F.col("_last_break"), F.lit(False))
    return seen.withColumn("is_sponsor", F.col("_opens") | hangs).select(
        *turns.columns, "is_sponsor")

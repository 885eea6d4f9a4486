"""Ranking and de-duplication that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from taskmine.sources.stages import staged


WIDE = 4  # tasks for each partition of a shuffle, where rows hold whole patches


def dealt(rows: DataFrame, keys: list[str], times: int = 1) -> DataFrame:
    """``rows`` with those of one key in one task, in as many tasks as a shuffle has partitions, or ``times`` as many.

    For steps that widen or multiply rows: Spark sizes their tasks by the small (or well compressed)
    rows before them, so a task would hold ever more as the input grows.
    """
    number = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * times
    return rows.repartition(number, *keys)


def first_n(rows: DataFrame, keys: list[str], order: list[Column], n: int | None, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key (None: all), numbered from 1 in ``rank`` when that is named.

    Catalyst limits each group inside every map task before the shuffle, so a hot
    key sends at most ``n`` rows per task. That pre-limit has a threshold: keep ``n``
    below ``spark.sql.optimizer.windowGroupLimitThreshold``.
    """
    number = rank or "_rank"
    ranked = rows.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    best = ranked if n is None else ranked.where(F.col(number) <= n)
    return best if rank else best.drop(number)


def keep_one(rows: DataFrame, keys: list[str], order: list[str], keep: str) -> DataFrame:
    """The first or last row per key by ``order``."""
    direction = F.asc if keep == "first" else F.desc
    return first_n(rows, keys, [direction(name) for name in order], 1)


def landed_once(rows: DataFrame, keys: list[str], order: list[str], keep: str = "last") -> DataFrame:
    """One row per key of a table whose keys may have landed again, by the order they landed in.

    The place is chosen on narrow rows with partial aggregates; wide rows only pass a semi join.
    ``order`` must tell the rows of one key apart.
    """
    place = F.struct(*order)
    chosen = rows.groupBy(*keys).agg((F.max if keep == "last" else F.min)(place).alias("_at"))
    return rows.join(chosen.select(*keys, "_at.*"), [*keys, *order], "left_semi")


def keep_first_but_all_without_id(rows: DataFrame, keys: list[str], id_column: str, order: list[str]) -> DataFrame:
    """Keep the first row per key; rows whose id is null or empty all stay.

    The rows without id are split off before the shuffle: they would share one key.
    """
    identity = F.col(id_column)
    without = rows.where(identity.isNull() | (identity == ""))
    return keep_one(rows.where(identity != ""), keys, order, "first").unionByName(without)


def numbered_in_blocks(
    rows: DataFrame, keys: list[str], block: Column, order: list[str], number: str, weight: Column | None = None
) -> DataFrame:
    """Exact position (from 0) inside each group, without a task per group.

    ``block`` is a key of bounded size that follows ``order`` (say, the leading
    position divided by a constant). Rows are numbered per (group, block); the
    offsets come from block counts, one small row per block. With ``weight`` the
    group total of it is added as ``<number>_total``.
    """
    rows = rows.withColumn("_block", block)
    amount = weight if weight is not None else F.lit(0)
    blocks = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n"), F.sum(amount).alias("_w"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        *keys, "_block",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_w").over(group).alias(f"{number}_total"),
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)) - 1
    joined = rows.withColumn("_local", local).join(offsets, [*keys, "_block"])
    numbered = joined.withColumn(number, F.col("_offset") + F.col("_local")).drop("_offset", "_local", "_block")
    return numbered if weight is not None else numbered.drop(f"{number}_total")



def ranked(rows: DataFrame, order: list[Column], number: str, ranges: int | None = None) -> DataFrame:
    """Rank (from 1) in one order over all rows, without a task that sees them all.

    Rows are dealt out by ranges of the sort key and written; each range is numbered by
    itself and begins after the rows of the ranges before it, one small row for each. Rows of
    equal keys share a range: add columns to ``order`` until ties are few. Runs a job when called.
    """
    session = rows.sparkSession
    ranges = ranges or int(session.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    later = sizes.select(F.explode(F.sequence(F.col("_range") + 1, F.lit(ranges))).alias("_range"), "_n")
    begun = later.groupBy("_range").agg(F.sum("_n").alias("_begun"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = dealt.withColumn("_inside", inside).join(begun, "_range", "left")
    return placed.withColumn(number, F.col("_inside") + F.coalesce("_begun", F.lit(0))).drop("_range", "_inside", "_begun")

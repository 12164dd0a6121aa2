"""Row numbers and running sums inside groups of which none has to fit one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightmatch.sources.scratch import cut

PART = "_part"


def number(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    name: str = "nth",
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """df with the row number in its group by `order` (from 1) and, for each new name of `totals`,
    the running sum of an integer column up to and with the row.

    Rows are dealt by ranges of (group, order), so a hot group lies in many partitions; each numbers
    its own part, and the parts before it are added. Only groups that cross the end of a partition
    have several parts, so what is broadcast has at most two rows per partition. Rows that agree in
    the whole order share a partition; their mutual order is open.
    """
    totals = totals or {}
    keys = [F.col(g).asc_nulls_first() for g in group]
    dealt = cut(df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()))
    sums = {name: F.lit(1), **{new: F.col(old) for new, old in totals.items()}}
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy(*group, PART)
        .agg(*[F.sum(value).alias(f"_{new}") for new, value in sums.items()])
        .select(
            *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)],
            F.col(PART).alias("_p"),
            *[F.sum(f"_{new}").over(earlier).alias(f"_{new}") for new in sums],
        )
        .filter(f"_{name} is not null")
    )
    same = F.col(PART) == F.col("_p")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    here = Window.partitionBy(*group, PART).orderBy(*order)
    here = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumns({new: F.sum(value).over(here) for new, value in sums.items()})
    joined = local.join(F.broadcast(before), same, "left")
    return joined.select(
        *df.columns,
        *[
            (F.col(new) + F.coalesce(F.col(f"_{new}"), F.lit(0))).cast("long").alias(new)
            for new in sums
        ],
    )


def spread_join(
    df: DataFrame, table: DataFrame, keys: list[str], spread: Column, salts: int = 32
) -> DataFrame:
    """Inner join of df with a table of one row per key (nulls are equal), in which a hot key of df
    is dealt over `salts` tasks by the values of `spread`; Spark broadcasts a table that is small."""
    dealt = table.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[c for c in table.columns if c not in keys],
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
    )
    same = F.pmod(F.xxhash64(spread), F.lit(salts)) == F.col("_salt")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(dealt, same).drop("_salt", *[f"_k{i}" for i in range(len(keys))])

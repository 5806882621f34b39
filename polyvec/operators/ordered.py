"""Running values and percentiles over one order, without putting it into one task.

Rows are range-partitioned on the order; each partition makes its own running values, and those of the
partitions before it, of which there are few, are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyvec.plans.shared import checkpoint

FEW = 100_000  # rows of a side that may be broadcast, counted before


def if_few(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has at most ``FEW`` rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def running(df: DataFrame, order: Sequence[Column], sums: Sequence[str] = (), largest: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """``df`` with ``place`` from 1, ``<c>_upto`` of each of ``sums`` (this row included) and ``<c>_before`` of each of ``largest`` (earlier rows only).

    The order must leave no ties. Written to the shared folder once, so that both passes see the same partitions.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    parts = checkpoint(ranged.withColumn("_part", F.spark_partition_id()))
    each = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums], *[F.max(c).alias(f"_m_{c}") for c in largest])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    before = each.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_s0_{c}") for c in sums], *[F.max(f"_m_{c}").over(earlier).alias(f"_m0_{c}") for c in largest])
    own = Window.partitionBy("_part").orderBy(*order)
    upto, past = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    inside = parts.withColumns({"_p": F.row_number().over(own), **{f"_u_{c}": F.sum(c).over(upto) for c in sums}, **{f"_x_{c}": F.max(c).over(past) for c in largest}})
    rows = inside.join(F.broadcast(before), "_part")  # as many rows as partitions
    return rows.select(*df.columns, (F.col("_p") + F.col("_n0")).cast("bigint").alias("place"), *[(F.col(f"_u_{c}") + F.col(f"_s0_{c}")).alias(f"{c}_upto") for c in sums], *[F.greatest(f"_x_{c}", f"_m0_{c}").alias(f"{c}_before") for c in largest])


def percentiles(df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """``(<by>, n, <name>...)``: exact linear percentiles per group; null and NaN values are left out.

    Equal values are counted before the shuffle; the counts are summed up along one range-partitioned
    order of group and value, so that a group of any size is spread, and only the counts that hold a
    wanted place go on.
    """
    good = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("_v"))
    counts = good.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = running(counts, [*[F.col(b) for b in by], F.col("_v")], ["_c"])
    key = F.struct(*[F.col(b) for b in by]) if by else F.lit(1)
    placed = placed.withColumn("_key", F.to_json(F.struct(key.alias("k"), F.lit(1).alias("one"))))
    groups = placed.groupBy("_key").agg(F.min(F.col("_c_upto") - F.col("_c")).alias("_base"), F.sum("_c").alias("n"))
    rows = placed.join(if_few(groups), "_key")
    first = F.col("_c_upto") - F.col("_c") - F.col("_base")  # places from 0 that the value has: [first, first + c)
    has = lambda p: (p >= first) & (p < first + F.col("_c"))
    low = {name: F.floor((F.col("n") - 1) * F.lit(q)) for name, q in wanted.items()}
    high = {name: F.least(low[name] + 1, F.col("n") - 1) for name in wanted}
    near = rows.where(F.lit(False) if not wanted else _any([has(p) for m in (low, high) for p in m.values()]))
    found = near.groupBy(*by, "n").agg(*[F.max(F.when(has(p[name]), F.col("_v"))).alias(f"_{side}_{name}") for name in wanted for side, p in (("l", low), ("h", high))])
    share = {name: (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q)) for name, q in wanted.items()}
    return found.select(*by, "n", *[(F.col(f"_l_{name}") + share[name] * (F.col(f"_h_{name}") - F.col(f"_l_{name}"))).alias(name) for name in wanted])


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out

"""Percentiles of large numeric columns by radix selection over mergeable summaries.

A double becomes a 64-bit integer of the same order (sign, exponent, mantissa). Its leading digits
are counted per group; these counts are the summary, and summaries of days or partitions combine by
adding counts. Selection walks the digits: the histogram of the first digit gives the digit that
holds each wanted rank, the next histogram is taken below that digit only, and so on.

A summary keeps 12 bits of sign and exponent and ``mantissa`` bits of the mantissa, so the exact
order statistic lies in the reported bucket, whose width is at most 2 ** -mantissa of the value
(relative), whatever the number of rows. ``refine`` goes on through the remaining digits, to the exact
value, with one more read of the data for each digit of ``digit_bits`` bits: two for the 44 bits beyond 8.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyvec.operators.ordered import if_few

HEAD = 12  # bits of sign and exponent


def _pow2(e: Column) -> Column:
    return F.pow(F.lit(2.0), e.cast("double"))


def ordered_bits(value: Column) -> Column:
    """The 64-bit pattern of a double as a bigint that sorts as the value does; both zeros give 0.

    Arithmetic only, so it stays in generated code: every product is with a power of two and exact.
    Null and NaN give null.
    """
    x = value.cast("double")
    a = F.abs(x)
    guess = F.least(F.greatest(F.floor(F.log2(a)), F.lit(-1022)), F.lit(1023)).cast("int")
    shift = F.lit(52) - guess
    half = F.floor(shift / 2).cast("int")
    scaled = a * _pow2(half) * _pow2(shift - half)  # in [2^51, 2^54), an integer when in range
    low, high = scaled < float(2**52), scaled >= float(2**53)
    exponent = F.when(low, guess - 1).when(high, guess + 1).otherwise(guess)
    mantissa = F.when(low, scaled * 2).when(high, scaled / 2).otherwise(scaled).cast("bigint")
    normal = (exponent + 1023).cast("bigint") * F.lit(2**52) + (mantissa - F.lit(2**52))
    tiny = (a * float(2.0**537) * float(2.0**537)).cast("bigint")
    bits = (
        F.when(a == float("inf"), F.lit(2047 * 2**52))
        .when(a < 2.0**-1022, tiny)
        .otherwise(normal)
    )
    return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("bigint")).when(x < 0, -bits).otherwise(bits)


def from_bits(bits: Column) -> Column:
    """The double whose ``ordered_bits`` are given."""
    a = F.abs(bits)
    e = F.shiftright(a, 52)
    mantissa = a.bitwiseAND(F.lit(2**52 - 1))
    power = (e - 1075).cast("int")
    half = F.floor(power / 2).cast("int")
    normal = (mantissa + F.lit(2**52)).cast("double") * _pow2(half) * _pow2(power - half)
    tiny = mantissa.cast("double") * float(2.0**-537) * float(2.0**-537)
    size = F.when(e == 2047, F.lit(float("inf"))).when(e == 0, tiny).otherwise(normal)
    return F.when(bits < 0, -size).otherwise(size)


def _floor_shift(bits: Column, by: int) -> Column:
    return F.shiftright(bits, by)  # arithmetic shift: floor for negative numbers too


def summarise(df: DataFrame, groups: Sequence[str], value: str, mantissa: int = 8) -> DataFrame:
    """Summary rows ``(<groups>, prefix, n)``. Counted before the shuffle; at most
    2 ** (12 + mantissa) rows per group, in practice some thousand.

    Every row with a value counts, repeated rows included. Null and NaN values are left out;
    infinite, negative and zero values are ordinary. Null is a group of its own.
    """
    bits = df.select(*groups, ordered_bits(F.col(value)).alias("bits")).where("bits is not null")
    return bits.groupBy(*groups, _floor_shift(F.col("bits"), 52 - mantissa).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def combine(summaries: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Summaries of several days or partitions as one, over coarser ``groups`` if wanted."""
    return summaries.groupBy(*groups, "prefix").agg(F.sum("n").alias("n"))


def _holding(histogram: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each ``(keys, digit, n, left)``, the digit that holds rank ``left``, and the rank within it."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
    hit = histogram.withColumn("upto", upto).where((F.col("left") <= F.col("upto")) & (F.col("left") > F.col("upto") - F.col("n")))
    return hit.withColumn("left", F.col("left") - (F.col("upto") - F.col("n"))).drop("upto", "n")


def select(summary: DataFrame, groups: Sequence[str], quantiles: Sequence[float], mantissa: int = 8) -> DataFrame:
    """Rows ``(key, q, n, prefix, left)``, ``key`` a struct of ``groups``: the bucket that holds the order
    statistic of rank ``max(1, ceil(q * n))``, and the rank within the bucket.

    Two digits: the histogram of sign and exponent first, then that of the kept mantissa bits below
    the one exponent that holds the rank.
    """
    counts = summary.select(F.struct(*groups).alias("key"), "prefix", "n", _floor_shift(F.col("prefix"), mantissa).alias("digit"))
    first = counts.groupBy("key", "digit").agg(F.sum("n").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("key")))
    rank = lambda q: F.greatest(F.ceil(F.col("total") * F.lit(q) - F.lit(1e-9)), F.lit(1)).cast("bigint")
    wanted = F.array(*[F.struct(F.lit(float(q)).alias("q"), rank(float(q)).alias("left")) for q in quantiles])
    first = _holding(first.select("key", "digit", "n", "total", F.inline(wanted)), ["key", "q"])
    second = counts.join(first, ["key", "digit"]).select("key", "q", "left", "total", F.col("prefix").alias("digit"), "n")
    found = _holding(second, ["key", "q"])
    return found.select("key", "q", F.col("total").alias("n"), F.col("digit").alias("prefix"), "left")


def bounds(selected: DataFrame, mantissa: int = 8) -> DataFrame:
    """``(groups, q, n, value, low, high)``: the exact order statistic lies within ``[low, high]``; ``value`` is the middle, within ``error_bound`` of it.

    In the last bucket before infinity ``high`` and the middle are infinite.
    """
    edge = lambda c: from_bits(F.shiftleft(c, 52 - mantissa))
    rows = selected.select("key.*", "q", "n", edge(F.col("prefix")).alias("low"), edge(F.col("prefix") + 1).alias("high"))
    return rows.withColumn("value", F.col("low") + (F.col("high") - F.col("low")) / 2)


def refine(df: DataFrame, groups: Sequence[str], value: str, selected: DataFrame, mantissa: int = 8, digit_bits: int = 22) -> DataFrame:
    """``(groups, q, n, value)``: the exact order statistics, by the digits that the summary left out.

    Each round reads the values below the buckets that hold a rank and no others, and counts one
    more digit of them. The list of these buckets is broadcast up to a counted number of rows, so that a
    bucket with very many values (a coarse clock) isn't one task; a longer list is joined by shuffle.
    """
    values = df.select(F.struct(*groups).alias("key"), ordered_bits(F.col(value)).alias("bits")).where("bits is not null")
    at, rest = selected, 52 - mantissa
    while rest:
        step = min(digit_bits, rest)
        below = if_few(at.select("key", "prefix").distinct())
        near = values.withColumn("prefix", _floor_shift(F.col("bits"), rest)).join(below, ["key", "prefix"])
        counts = near.groupBy("key", "prefix", _floor_shift(F.col("bits"), rest - step).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        at = _holding(counts.join(at.withColumnRenamed("n", "total"), ["key", "prefix"]), ["key", "q"])
        at = at.select("key", "q", F.col("total").alias("n"), F.col("digit").alias("prefix"), "left")
        rest -= step
    return at.select("key.*", "q", "n", from_bits(F.col("prefix")).alias("value"))


def error_bound(mantissa: int) -> float:
    """Largest distance of the middle of a bucket from any value in it, relative to the value."""
    return math.ldexp(1.0, -(mantissa + 1))

"""Comparing runs and settings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyvec.operators.encode import FACTOR, MODULUS, START
from polyvec.operators.ordered import if_few, percentiles, running


def deltas(cand: DataFrame, base: DataFrame, metric: str, k: int) -> DataFrame:
    """``(query_id, delta)`` of two per-query tables at one cutoff."""
    a = cand.where(F.col("k") == k).select("query_id", F.col(metric).alias("a"))
    b = base.where(F.col("k") == k).select("query_id", F.col(metric).alias("b"))
    return a.join(b, "query_id").select("query_id", (F.col("a") - F.col("b")).alias("delta"))


def paired_summary(delta: DataFrame, near: float = 1e-9) -> DataFrame:
    """``(n, mean_delta, wins, ties, losses)``; differences up to ``near`` are ties."""
    d = F.col("delta")
    return delta.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_delta"), F.count_if(d > near).alias("wins"), F.count_if(F.abs(d) <= near).alias("ties"), F.count_if(d < -near).alias("losses"))


VALUES = 4_000_000  # differences that are broadcast, 8 bytes each


def bootstrap_means(delta: DataFrame, resamples: int, seed: int = 0) -> DataFrame:
    """``(b, mean)``: means of resamples, drawn by hashed place so that any engine draws the same.

    Up to ``VALUES`` differences are broadcast and each task draws its share of the resamples from them.
    More are drawn as rows, queries times resamples, and summed before the shuffle.
    """
    if delta.limit(VALUES + 1).count() <= VALUES:
        return _drawn_in_blocks(delta, resamples, seed)
    placed = running(delta, [F.col("query_id")]).withColumn("place", F.col("place") - 1)
    n = delta.agg(F.count(F.lit(1)).alias("n"))
    draws = placed.select("place").crossJoin(F.broadcast(n)).select("place", "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    x = (F.col("b").cast("bigint") * 1_000_003 + F.col("place") + seed * 7919 + 1) * START % MODULUS
    picked = draws.select("b", ((x * FACTOR % MODULUS) % F.col("n")).alias("pick"))
    return picked.join(F.broadcast(placed.select(F.col("place").alias("pick"), "delta")), "pick").groupBy("b").agg(F.avg("delta").alias("mean"))


def _drawn_in_blocks(delta: DataFrame, resamples: int, seed: int) -> DataFrame:
    values = delta.orderBy("query_id").select("delta").toArrow().column(0).to_numpy()
    held = delta.sparkSession.sparkContext.broadcast(values)

    def run(batches):
        values = held.value
        n = np.int64(len(values))
        place = np.arange(len(values), dtype=np.int64)
        for batch in batches:
            if n:
                means = [float(values[((b * 1_000_003 + place + seed * 7919 + 1) * START % MODULUS * FACTOR % MODULUS) % n].mean()) for b in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(means, pa.float64())], names=["b", "mean"])

    spark = delta.sparkSession
    return spark.range(resamples, numPartitions=max(1, min(resamples // 100, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, "b bigint, mean double")


def bootstrap_interval(delta: DataFrame, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """``(low, high)``: 2.5 and 97.5 percentiles, linear, of the resampled means."""
    means = bootstrap_means(delta, resamples, seed)
    return means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None, name: str = "avg_rank") -> DataFrame:
    """Ranks from 1 with ties averaged. Values are counted first, so equal ones meet before the window."""
    by = by or []
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    if not by:
        ranked = running(counts, [F.col(value)], ["_n"]).select(value, (F.col("_n_upto") - (F.col("_n") - 1) / 2.0).alias(name))
        return df.join(ranked, value)
    w = Window.partitionBy(*by).orderBy(value)
    ranked = counts.withColumn(name, F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - (F.col("_n") - 1) / 2.0)
    return df.join(ranked.drop("_n"), [*by, value])


EXACT = 25  # differences up to which p is exact


def _signed_rank_p(ranks: list[float], w_plus: float) -> float:
    """Two-sided p over all signs: ranks (doubled, so that averaged ones are whole) are added one by one to the distribution of their sum."""
    doubled = [round(2 * r) for r in ranks]
    ways = np.zeros(sum(doubled) + 1)
    ways[0] = 1
    for r in doubled:
        shifted = np.zeros_like(ways)
        shifted[r:] = ways[: len(ways) - r]
        ways = (ways + shifted) / 2
    w = round(2 * w_plus)
    return float(min(1.0, 2 * min(ways[: w + 1].sum(), ways[w:].sum())))


def wilcoxon(delta: DataFrame) -> DataFrame:
    """``(n, w_plus, w_minus, z, p)``: signed ranks of the differences other than 0; p 1 if there are none.

    Up to ``EXACT`` differences p is exact, averaged ranks of ties included; beyond, by the normal approximation with tie correction.
    """
    d = delta.where(F.abs("delta") > 1e-12).withColumn("size", F.round(F.abs("delta"), 12))
    ranked = average_ranks(d, "size")
    few = ranked.limit(EXACT + 1).agg(F.collect_list("avg_rank").alias("ranks"))
    sums = ranked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("delta") > 0, F.col("avg_rank"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("delta") < 0, F.col("avg_rank"))), F.lit(0.0)).alias("w_minus"))
    ties = d.groupBy("size").agg(F.count(F.lit(1)).alias("t")).agg(F.coalesce(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")), F.lit(0)).alias("ties"))

    @F.pandas_udf("double")
    def two_sided(z: pd.Series, w_plus: pd.Series, ranks: pd.Series) -> pd.Series:
        normal = lambda v: 1.0 if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2))
        return pd.Series([normal(a) if r is None else _signed_rank_p(list(r), w) for a, w, r in zip(z, w_plus, ranks)])

    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0
    z = F.when(var > 0, (F.col("w_plus") - n * (n + 1) / 4.0) / F.sqrt(var))
    rows = sums.crossJoin(ties).crossJoin(few)  # single rows
    rows = rows.select("n", "w_plus", "w_minus", z.alias("z"), F.when(n <= EXACT, F.col("ranks")).alias("ranks"))
    return rows.withColumn("p", two_sided("z", "w_plus", "ranks")).drop("ranks")


def spearman(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """``(pearson, spearman)`` of two columns."""
    ranked = average_ranks(average_ranks(pairs, x, name="_rx"), y, name="_ry")
    return ranked.agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))


def fidelity(cand: DataFrame, base: DataFrame, depth: int = 10) -> DataFrame:
    """``(queries, overlap, coverage, median_rank, missing)``.

    Share of the baseline's first ``depth`` that are in the candidate's first ``depth`` and anywhere in
    it, always divided by ``depth``; the median candidate rank of the baseline's first document, and
    for how many queries the candidate lacks it.
    """
    b = base.where(F.col("rank") <= depth).select("query_id", "doc_id", F.col("rank").alias("b_rank"))
    both = b.join(cand.select("query_id", "doc_id", F.col("rank").alias("c_rank")), ["query_id", "doc_id"], "left")
    per = both.groupBy("query_id").agg(
        (F.count_if(F.col("c_rank") <= depth) / depth).alias("overlap"), (F.count("c_rank") / depth).alias("coverage"),
        F.max(F.when(F.col("b_rank") == 1, F.col("c_rank"))).alias("top_rank"),
    )
    return per.agg(F.count(F.lit(1)).alias("queries"), F.avg("overlap").alias("overlap"), F.avg("coverage").alias("coverage"), F.median("top_rank").alias("median_rank"), F.count_if(F.col("top_rank").isNull()).alias("missing"))


def pareto(settings: DataFrame, cost: str, value: str) -> DataFrame:
    """Settings that no cheaper or equally cheap one matches; of equal ones none is left out for the other."""
    points = settings.select(cost, value).distinct()
    best = running(points, [F.col(cost), F.col(value).desc()], largest=[value])
    kept = best.where(F.col(f"{value}_before").isNull() | (F.col(value) > F.col(f"{value}_before"))).select(F.col(cost).alias("_c"), F.col(value).alias("_v"))
    return settings.join(if_few(kept), (F.col(cost) == F.col("_c")) & (F.col(value) == F.col("_v"))).drop("_c", "_v")


def best_within(settings: DataFrame, by: list[str], cost: str, limits: list[float], value: str, tie: str) -> DataFrame:
    """Per group and limit, the row with the highest ``value`` among those with ``cost`` up to the limit."""
    allowed = settings.withColumn("limit", F.explode(F.array(*[F.lit(float(x)) for x in limits]))).where(F.col(cost) <= F.col("limit"))
    order = Window.partitionBy(*by, "limit").orderBy(F.col(value).desc(), tie)
    return allowed.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def seed_spread(settings: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(by, n, mean, std)`` of settings run with more than one seed; sample deviation."""
    return settings.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")).where("n > 1")


def relative_change(value, base):
    """Change in per cent of ``base``."""
    return (value / base - 1) * 100


def break_even(build_seconds, saved_ms):
    """Queries after which an index has paid for its build."""
    return build_seconds / F.greatest(F.lit(1e-9), saved_ms / 1000)


def nearest_level(value, levels: list[float]):
    """The level nearest a value, the lower of two as near."""
    away = F.array(*[F.struct(F.round(F.abs(value - F.lit(x)), 6).alias("away"), F.lit(float(x)).alias("level")) for x in levels])
    return F.array_min(away)["level"]


def dispersion(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(by, n, zero_share, mean, cv)``; the coefficient of variation is of the values other than 0, with population deviation."""
    v = F.when(F.col(value) != 0, F.col(value))
    return values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col(value) == 0) / F.count(F.lit(1))).alias("zero_share"), F.avg(value).alias("mean"), (F.stddev_pop(v) / F.avg(v)).alias("cv"))


def latency_summary(log: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(by, n, median, p95)``, exact and linear; null and NaN times are left out."""
    return percentiles(log, by, value, {"median": 0.5, "p95": 0.95})


def latency_probe(run, n: int, items: int, warm: int = 1) -> float:
    """Median milliseconds of ``run(i)`` over ``n`` evenly spaced items, after warming up."""
    import time

    picks = np.linspace(0, items - 1, min(n, items)).astype(int)
    for i in picks[:warm]:
        run(int(i))
    took = []
    for i in picks:
        t = time.perf_counter()
        run(int(i))
        took.append((time.perf_counter() - t) * 1000)
    return float(np.median(took))


def correlated_pairs(spark, levels: list[float], pairs: int, dim: int, seed: int = 0) -> DataFrame:
    """``(pair, level, x, y)``: unit vectors with the cosine ``level``, the second turned within the plane of a
    hashed direction. Made on the workers, partition by partition."""
    from polyvec.operators.encode import directions

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_pylist()
            xs, ys, cs = [], [], []
            for i in ids:
                c = levels[i % len(levels)]
                x, u = directions(seed * 1_000_003 + i, 2, dim)
                u = u - (u @ x) * x
                u /= np.linalg.norm(u)
                xs.append(x)
                ys.append(c * x + math.sqrt(1 - c * c) * u)
                cs.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cs), pa.array(xs), pa.array(ys)], names=["pair", "level", "x", "y"])

    return spark.range(pairs * len(levels)).mapInArrow(run, "pair bigint, level double, x array<double>, y array<double>")

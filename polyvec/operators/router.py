"""Deciding per query between a cheap and a dear reranker."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyvec.operators import stats
from polyvec.operators.ordered import running
from polyvec.operators.stats import average_ranks


def _shape(run: DataFrame, name: str) -> DataFrame:
    """First score, margin, spread of the first ten of a run; missing scores of a short list are 0."""
    at = lambda r: F.coalesce(F.max(F.when(F.col("rank") == r, F.col("score"))), F.lit(0.0))
    top = run.where("rank <= 10").groupBy("query_id")
    sums = top.agg(at(1).alias("s1"), at(2).alias("s2"), at(10).alias("s10"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("ss"), F.sort_array(F.collect_list("doc_id")).alias("ids"), F.max_by("doc_id", -F.col("rank")).alias("first"))
    spread = F.sqrt(F.greatest(F.col("ss") / 10 - (F.col("s") / 10) * (F.col("s") / 10), F.lit(0.0)))
    return sums.select("query_id", F.col("s1").alias(f"{name}_top1"), (F.col("s1") - F.col("s2")).alias(f"{name}_margin12"), (F.col("s1") - F.col("s10")).alias(f"{name}_gap1_10"), spread.alias(f"{name}_std10"), F.col("ids").alias(f"{name}_ids"), F.col("first").alias(f"{name}_first"))


def features(hyb: DataFrame, dense: DataFrame, lex: DataFrame) -> DataFrame:
    """14 features of three runs per query: shapes, and how far the lists agree. A query missing in one has zeros there."""
    h, d, x = _shape(hyb, "hyb"), _shape(dense, "dense").drop("dense_std10"), _shape(lex, "lex").drop("lex_std10")
    rows = h.join(d, "query_id", "left").join(x, "query_id", "left")
    none = F.array().cast("array<string>")
    a, b = F.coalesce("dense_ids", none), F.coalesce("lex_ids", none)
    union = F.size(F.array_union(a, b))
    jaccard = F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    numbers = [c for c in rows.columns if not c.endswith(("_ids", "_first")) and c != "query_id"]
    return rows.select(
        "query_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in numbers], jaccard.alias("dense_lex_jaccard10"),
        flag(F.array_contains(b, F.col("dense_first"))).alias("dense_top1_in_lex10"), flag(F.array_contains(a, F.col("lex_first"))).alias("lex_top1_in_dense10"), flag(F.col("hyb_first") == F.col("dense_first")).alias("hyb_top1_is_dense_top1"),
    )


def labels(first: DataFrame, base: DataFrame, escalated: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, ndcg_first, ndcg_base, ndcg_escalate, gain, y)`` of three per-query tables."""
    pick = lambda t, name: t.where(F.col("k") == k).select("query_id", F.col("ndcg").alias(name))
    rows = pick(first, "ndcg_first").join(pick(base, "ndcg_base"), "query_id").join(pick(escalated, "ndcg_escalate"), "query_id")
    return rows.withColumn("gain", F.col("ndcg_escalate") - F.col("ndcg_base")).withColumn("y", (F.col("ndcg_escalate") > F.col("ndcg_base")).cast("int"))


def escalation_curve(scored: DataFrame) -> DataFrame:
    """``(n, frac, value)`` of ``(query_id, score, gain, base)``: the mean when the n highest scores are escalated, ties by id.

    The order is range-partitioned; its running sum isn't made in one task.
    """
    total = scored.agg(F.count(F.lit(1)).alias("size"), F.avg("base").alias("mean"))
    steps = running(scored, [F.col("score").desc(), F.col("query_id")], ["gain"]).select(F.col("place").alias("n"), F.col("gain_upto").alias("won"))
    start = total.select(F.lit(0).alias("n"), F.lit(0.0).alias("won"))
    return steps.unionByName(start).crossJoin(total).select(F.col("n").cast("bigint").alias("n"), (F.col("n") / F.col("size")).alias("frac"), (F.col("mean") + F.col("won") / F.col("size")).alias("value"))


def curve_area(curve: DataFrame) -> DataFrame:
    """``(area)``: trapezoids between the curve and its first value. Steps are equal, so the area is a sum without an order."""
    ends = curve.agg(F.sum("value").alias("s"), F.min_by("value", "n").alias("first"), F.max_by("value", "n").alias("last"), F.max("n").alias("n"))
    area = (F.col("s") - (F.col("first") + F.col("last")) / 2 - F.col("n") * F.col("first")) / F.col("n")
    return ends.select(F.coalesce(F.when(F.col("n") > 0, area), F.lit(0.0)).alias("area"))


def gain_kept(scored: DataFrame) -> DataFrame:
    """``(area, oracle_area, random_area, gain_kept)``."""
    own = curve_area(escalation_curve(scored))
    oracle = curve_area(escalation_curve(scored.withColumn("score", F.col("gain")))).withColumnRenamed("area", "oracle_area")
    chance = scored.agg((F.avg("gain") / 2).alias("random_area"))
    rows = own.crossJoin(oracle).crossJoin(chance)  # single rows
    spread = F.col("oracle_area") - F.col("random_area")
    return rows.withColumn("gain_kept", F.when(F.abs(spread) > 1e-12, (F.col("area") - F.col("random_area")) / spread))


def at_budgets(curve: DataFrame, budgets: tuple[float, ...] = (0.1, 0.2, 0.3)) -> DataFrame:
    """``(budget, n, value)``: the curve at half-even rounded shares of the queries."""
    size = curve.agg(F.max("n").alias("size"))
    want = size.select(F.explode(F.array(*[F.lit(float(b)) for b in budgets])).alias("budget"), "size").withColumn("n", F.bround(F.col("budget") * F.col("size"), 0).cast("bigint"))
    return want.join(curve, "n").select("budget", "n", "value")


def roc_auc(scored: DataFrame) -> DataFrame:
    """``(auc)`` of ``(score, y)``: ties count half; null unless both classes occur."""
    ranked = average_ranks(scored, "score")
    sums = ranked.agg(F.sum(F.when(F.col("y") == 1, F.col("avg_rank"))).alias("r"), F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("n") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n"))).alias("auc"))


def auc_resamples(scored: DataFrame, scores: list[str], resamples: int = 5000, seed: int = 0) -> DataFrame:
    """``(b, <scores>)``: the AUC of each score column of ``(query_id, y, <scores>)`` on resamples, the same queries for all; null where a resample has one class.

    One row a query: up to ``stats.VALUES`` rows are broadcast, more are refused rather than sampled.
    """
    scores = list(dict.fromkeys(scores))
    if scored.limit(stats.VALUES + 1).count() > stats.VALUES:
        raise ValueError(f"more than {stats.VALUES} queries")
    rows = scored.orderBy("query_id").select(F.col("y").cast("double").alias("y"), *[F.col(s).cast("double").alias(s) for s in scores]).toArrow()
    held = scored.sparkSession.sparkContext.broadcast({c: rows.column(c).to_numpy() for c in rows.column_names})

    def run(batches):
        table = held.value
        y = table["y"]
        n = len(y)
        orders = {}  # sorted once; a resample is how often each row of this order is drawn
        for s in scores:
            order = np.argsort(table[s], kind="stable")
            values = table[s][order]
            orders[s] = order, y[order], np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if n else order
        for batch in batches:
            found: list[list] = [[] for _ in scores]
            for b in batch.column(0).to_pylist():
                drawn = np.bincount(np.random.default_rng((seed, b)).integers(0, max(n, 1), n), minlength=n).astype(np.float64)
                p = drawn @ y
                for out, s in zip(found, scores):
                    if not 0 < p < n:
                        out.append(None)
                        continue
                    order, labels, firsts = orders[s]
                    times = drawn[order]
                    counts, positive = np.add.reduceat(times, firsts), np.add.reduceat(times * labels, firsts)
                    ranks = np.cumsum(counts) - (counts - 1) / 2
                    out.append(float((positive @ ranks - p * (p + 1) / 2) / (p * (n - p))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(f, pa.float64()) for f in found)], names=["b", *scores])

    spark = scored.sparkSession
    parts = max(1, min(resamples // 100, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(resamples, numPartitions=parts).mapInArrow(run, "b bigint, " + ", ".join(f"`{s}` double" for s in scores))


def auc_interval(scored: DataFrame, score: str = "score", resamples: int = 5000, seed: int = 0) -> DataFrame:
    """``(low, high)``: 2.5 and 97.5 percentiles of the resampled AUC."""
    means = auc_resamples(scored, [score], resamples, seed)
    return means.agg(F.percentile(score, F.lit(0.025)).alias("low"), F.percentile(score, F.lit(0.975)).alias("high"))


def paired_auc(scored: DataFrame, a: str, b: str, resamples: int = 5000, seed: int = 0) -> DataFrame:
    """``(delta, low, high, p)`` of the AUC of ``a`` less that of ``b`` on the same resamples; p two-sided, twice the lesser share on either side of 0."""
    d = auc_resamples(scored, [a, b], resamples, seed).select((F.col(a) - F.col(b)).alias("d")).where("d is not null")
    side = F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double")))
    return d.agg(F.avg("d").alias("delta"), F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"), F.least(F.lit(1.0), 2 * side).alias("p"))


def transfer(df: DataFrame, columns: list[str], label: str, origin: str, value: str, model: str = "logistic") -> DataFrame:
    """``df`` with ``p`` by a model fitted on the rows whose ``origin`` is ``value``; those rows are left out."""
    fitted = fit_model(df.where(F.col(origin) == value), columns, label, model)
    return predict(fitted, df.where(F.col(origin) != value))


def stacked(df: DataFrame, columns: list[str], answers: list[str], label: str, model: str = "logistic") -> DataFrame:
    """``out_of_fold`` over the features and the answers of another router as further columns."""
    return out_of_fold(df, [*columns, *answers], label, model)


def reliability(scored: DataFrame, bins: int = 10, least: int = 1) -> DataFrame:
    """``(bin, n, confidence, accuracy)`` of ``(p, y)`` in equal bins with at least ``least`` rows."""
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("bigint")
    return scored.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("confidence"), F.avg("y").alias("accuracy")).where(F.col("n") >= least)


def expected_calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    table = reliability(scored, bins)
    return table.agg((F.sum(F.abs(F.col("confidence") - F.col("accuracy")) * F.col("n")) / F.sum("n")).alias("ece"))


def folds(df: DataFrame, stratum: str, key: str, n: int = 5) -> DataFrame:
    """Rows with ``fold``: dealt out in hashed order within each stratum."""
    order = Window.partitionBy(stratum).orderBy(F.sha2(F.col(key).cast("string"), 256), key)
    return df.withColumn("fold", ((F.row_number().over(order) - 1) % n).cast("int"))


def out_of_fold(df: DataFrame, columns: list[str], label: str, model: str = "logistic", folds_in: str = "fold") -> DataFrame:
    """``df`` with ``p``, the probability by a model that hasn't seen the row's fold."""
    every = sorted(r[0] for r in df.select(folds_in).distinct().collect())

    def fitted_without(fold: int) -> DataFrame:
        return predict(fit_model(df.where(F.col(folds_in) != fold), columns, label, model), df.where(F.col(folds_in) == fold))

    with ThreadPoolExecutor(max(1, len(every))) as pool:  # a fit is a row of small jobs, which wait for each other only
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(df.sparkSession)(fitted_without), every)) if every else None


def fit_model(train: DataFrame, columns: list[str], label: str, model: str = "logistic"):
    """Standardised logistic regression (C = 0.5) or boosted trees (depth 3, 200 rounds of 0.05, 30 rows a leaf)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    parts = [VectorAssembler(inputCols=columns, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True)]
    if model == "logistic":
        parts.append(LogisticRegression(featuresCol="_x", labelCol=label, regParam=1 / (0.5 * max(1, train.count())), elasticNetParam=0.0, standardization=False))
    else:
        parts.append(GBTClassifier(featuresCol="_x", labelCol=label, maxDepth=3, stepSize=0.05, maxIter=200, minInstancesPerNode=30, seed=0))
    return Pipeline(stages=parts).fit(train)


def predict(fitted, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    scored = fitted.transform(rows)
    return scored.withColumn("p", vector_to_array("probability")[1]).drop("_raw", "_x", "rawPrediction", "probability", "prediction")


def coefficients(fitted, columns: list[str]) -> list[tuple[str, float]]:
    """Standardised coefficients, largest first."""
    return sorted(zip(columns, fitted.stages[-1].coefficients.toArray().tolist()), key=lambda c: -abs(c[1]))


def latency_at(base_ms, extra_ms, budget, overhead_ms=0.0):
    """Mean milliseconds when a share ``budget`` of the queries is escalated."""
    return base_ms + overhead_ms + budget * extra_ms


def decision_charge(decision_ms, base_ms, parallel: bool):
    """What a decision adds: all of it, or only what outlasts the base when both start together."""
    return F.greatest(F.lit(0.0), decision_ms - base_ms) if parallel else decision_ms

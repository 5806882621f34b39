"""Ranking metrics of a run ``(query_id, doc_id, score, rank)`` against judgments ``(query_id, doc_id, rel)``.

Every judged query counts; one that the run lacks has 0. Unjudged documents have relevance 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cutoffs and names of the metrics.
KS = (1, 3, 5, 10, 20, 50, 100)
METRICS = ("ndcg", "precision", "recall", "mrr", "map")


def _hits(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Relevant documents that the run found, with their number among them."""
    found = qrels.where("rel > 0").join(run.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"])
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def _ideal(qrels: DataFrame) -> DataFrame:
    """Gains of the ideal order of all judged documents."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rel").desc(), "doc_id"))
    return qrels.where("rel > 0").select("query_id", "rel", place.alias("place"))


def evaluate(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """``(query_id, k, ndcg, precision, recall, mrr, map)``, one row per judged query and cutoff."""
    cut = F.array(*[F.lit(k) for k in ks])
    judged = qrels.where("rel > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    gain = F.col("rel") / F.log2(F.col("rank") + 1.0)
    found = _hits(run, qrels).withColumn("k", F.explode(cut)).where(F.col("rank") <= F.col("k"))
    seen = found.groupBy("query_id", "k").agg(
        F.sum(gain).alias("dcg"), F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(F.col("nth") / F.col("rank")).alias("precisions")
    )
    best = _ideal(qrels).withColumn("k", F.explode(cut)).where(F.col("place") <= F.col("k"))
    best = best.groupBy("query_id", "k").agg(F.sum(F.col("rel") / F.log2(F.col("place") + 1.0)).alias("ideal"))
    rows = judged.withColumn("k", F.explode(cut)).join(best, ["query_id", "k"]).join(seen, ["query_id", "k"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "query_id", F.col("k").cast("bigint").alias("k"), zero(F.col("dcg") / F.col("ideal")).alias("ndcg"), zero(F.col("hits") / F.col("k")).alias("precision"),
        zero(F.col("hits") / F.col("relevant")).alias("recall"), zero(1.0 / F.col("first")).alias("mrr"), zero(F.col("precisions") / F.col("relevant")).alias("map"),
    )


def named(per_query: DataFrame, name: str) -> DataFrame:
    """``(query_id, value)`` of a metric by its name, as ``ndcg@10``; an unknown name is an error."""
    metric, _, k = name.partition("@")
    if metric not in METRICS or not k.isdigit():
        raise ValueError(f"no such metric: {name!r}; known are {', '.join(METRICS)} with a cutoff, as ndcg@10")
    return per_query.where(F.col("k") == int(k)).select("query_id", F.col(metric).alias("value"))


def ndcg_of_gains(gains: Column, ideal: Column) -> Column:
    """nDCG of an array of gains in ranked order beside an explicit ideal array; null if either is null or the ideal has no gain."""
    dcg = lambda a: F.aggregate(F.transform(a, lambda g, i: g.cast("double") / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    return F.when(dcg(ideal) > 0, dcg(gains) / dcg(ideal))


def long_form(per_query: DataFrame) -> DataFrame:
    """``(query_id, metric, k, value)``."""
    parts = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return per_query.select("query_id", "k", F.inline(parts))


def wide_form(per_query: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row per query, columns ``metric@k``; the list of columns is given, so no pass looks for it."""
    names = [f"{m}@{k}" for m in METRICS for k in ks]
    named = long_form(per_query).withColumn("name", F.concat_ws("@", "metric", "k"))
    return named.groupBy("query_id").pivot("name", names).agg(F.first("value"))


def means(per_query: DataFrame) -> DataFrame:
    """``(metric, k, value)``: means over the judged queries."""
    return long_form(per_query).groupBy("metric", "k").agg(F.avg("value").alias("value"))


def curves(run: DataFrame, qrels: DataFrame, depth: int = 100) -> DataFrame:
    """Means at every cutoff up to ``depth``."""
    return means(evaluate(run, qrels, tuple(range(1, depth + 1))))


def first_relevant(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``(query_id, first_rank)``, null where the run found nothing relevant."""
    judged = qrels.where("rel > 0").select("query_id").distinct()
    return judged.join(_hits(run, qrels).groupBy("query_id").agg(F.min("rank").alias("first_rank")), "query_id", "left")


def first_relevant_profile(run: DataFrame, qrels: DataFrame, depth: int = 100) -> DataFrame:
    """``(bin, queries)`` of the first relevant rank."""
    r = F.col("first_rank")
    label = F.when(r == 1, "1")
    for lo, hi in ((2, 3), (4, 5), (6, 10), (11, 20), (21, 50), (51, depth)):
        label = label.when((r >= lo) & (r <= hi), f"{lo}-{hi}")
    return first_relevant(run, qrels).groupBy(label.otherwise(f">{depth}").alias("bin")).agg(F.count(F.lit(1)).alias("queries"))


def score_separation(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``(relevant, n, mean, low, median, high)`` of the scores of relevant and other documents of the run."""
    marked = run.join(qrels.where("rel > 0").select("query_id", "doc_id", F.lit(True).alias("hit")), ["query_id", "doc_id"], "left")
    return marked.groupBy(F.coalesce("hit", F.lit(False)).alias("relevant")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.min("score").alias("low"), F.median("score").alias("median"), F.max("score").alias("high")
    )


def histogram(values: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """``(bin, n)``: equal bins from 1; the last holds ``high`` too, values outside are left out."""
    x = F.col(column)
    at = F.least(F.floor((x - F.lit(low)) / F.lit((high - low) / bins)) + 1, F.lit(bins))
    return values.where((x >= low) & (x <= high)).groupBy(at.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))

"""Evaluations that are saved, read again as folders of runs, and compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyvec.operators import metrics, stats
from polyvec.sources import tables as S

SUMMARY = "run string, n_queries bigint, n_docs bigint, depth int, params map<string,string>, timing map<string,double>, index map<string,string>, metrics map<string,double>"


def evaluate_and_save(run: DataFrame, qrels: DataFrame, folder: str, name: str, n_docs: int, params: dict | None = None, timing: dict[str, float] | None = None, index: dict | None = None, ks: Sequence[int] = metrics.KS, depth: int = 100) -> None:
    """Writes under ``folder/run=name``: the run, metrics per query, their curve to ``depth`` and a summary.

    The summary has means rounded to five digits, the parameters, the timing in milliseconds or seconds
    as given, what the index is, and how many queries were judged.
    """
    at = f"{folder}/%s/run={name}"
    top = run.where(F.col("rank") <= depth)
    S.write_trec_run(top, at % "runs", name)
    per = metrics.evaluate(top, qrels, tuple(ks))
    metrics.wide_form(per, tuple(ks)).write.mode("overwrite").option("header", True).csv(at % "per_query")
    metrics.curves(top, qrels, depth).write.mode("overwrite").option("header", True).csv(at % "curves")
    means = metrics.means(per).select(F.concat_ws("@", "metric", "k").alias("name"), F.round("value", 5).alias("value"))
    text = lambda d: F.create_map(*[x for k, v in (d or {}).items() for x in (F.lit(k), F.lit(v))]) if d else F.create_map().cast("map<string,string>")
    one = means.agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("metrics"))  # as many as metrics and cutoffs
    queries = per.agg(F.countDistinct("query_id").alias("n_queries"))
    row = one.join(F.broadcast(queries)).select(
        F.lit(name).alias("run"), "n_queries", F.lit(n_docs).alias("n_docs"), F.lit(depth).alias("depth"), text({k: str(v) for k, v in (params or {}).items()}).alias("params"),
        text({k: float(v) for k, v in (timing or {}).items()}).alias("timing"), text({k: str(v) for k, v in (index or {}).items()}).alias("index"), "metrics",
    )
    row.coalesce(1).write.mode("overwrite").json(at % "summaries")


def save_scores(scores: DataFrame, folder: str, name: str) -> None:
    """The score matrix in long form."""
    scores.write.mode("overwrite").parquet(f"{folder}/scores/run={name}")


def read_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """One row a run: ``SUMMARY``."""
    return spark.read.schema(SUMMARY).json(f"{folder}/summaries/run=*")


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """``(run, query_id, doc_id, rank, score)`` of all runs of a folder."""
    rows = S.read_trec_run(spark, f"{folder}/runs/run=*")
    return rows.select(F.col("tag").alias("run"), "query_id", "doc_id", "rank", "score")


def read_per_query(spark: SparkSession, folder: str, ks: Sequence[int] = metrics.KS) -> DataFrame:
    """``(run, query_id, metric, k, value)`` of all runs of a folder."""
    names = [f"{m}@{k}" for m in metrics.METRICS for k in ks]
    schema = "query_id string, " + ", ".join(f"`{n}` double" for n in names)
    rows = spark.read.schema(schema).option("header", True).option("basePath", f"{folder}/per_query").csv(f"{folder}/per_query/run=*")
    parts = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("value")) for n in names])
    name = F.split("name", "@")
    return rows.select("run", "query_id", F.inline(parts)).select("run", "query_id", name[0].alias("metric"), name[1].cast("bigint").alias("k"), "value")


def compare_runs(per_query: DataFrame, base: str, digits: int = 6) -> DataFrame:
    """``(run, metric, k, queries, base, value, delta, change, wins, ties, losses)`` of every other run of ``read_per_query`` beside ``base``.

    Queries that both have are compared; ``change`` in per cent is null where the base is 0.
    """
    a = per_query.where(F.col("run") != base)
    b = per_query.where(F.col("run") == base).select("query_id", "metric", "k", F.col("value").alias("base"))
    d = F.col("value") - F.col("base")
    rows = a.join(b, ["query_id", "metric", "k"]).groupBy("run", "metric", "k").agg(
        F.count(F.lit(1)).alias("queries"), F.avg("base").alias("base"), F.avg("value").alias("value"), F.avg(d).alias("delta"), F.count_if(d > 1e-9).alias("wins"), F.count_if(F.abs(d) <= 1e-9).alias("ties"), F.count_if(d < -1e-9).alias("losses")
    )
    change = F.when(F.col("base") != 0, stats.relative_change(F.col("value"), F.col("base")))
    return rows.withColumn("change", change).select("run", "metric", "k", "queries", *[(F.round(c, digits) + F.lit(0.0)).alias(c) for c in ("base", "value", "delta", "change")], "wins", "ties", "losses")


def save_comparison(per_query: DataFrame, base: str, folder: str) -> None:
    """The comparison as JSON, and the differences per query as CSV."""
    compare_runs(per_query, base).coalesce(1).write.mode("overwrite").json(f"{folder}/comparison")
    b = per_query.where(F.col("run") == base).select("query_id", "metric", "k", F.col("value").alias("base"))
    rows = per_query.where(F.col("run") != base).join(b, ["query_id", "metric", "k"]).withColumn("delta", F.col("value") - F.col("base"))
    rows.write.mode("overwrite").option("header", True).csv(f"{folder}/comparison_per_query")


def headroom(means: DataFrame, reference: str) -> DataFrame:
    """``(dataset, method, value, place, headroom)`` of ``(dataset, method, value)``: the place within the dataset and what ``reference`` lacks to the method."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("dataset").orderBy(F.col("value").desc(), "method")).cast("bigint")  # one row a method
    base = means.where(F.col("method") == reference).select("dataset", F.col("value").alias("_base"))
    return means.withColumn("place", place).join(base, "dataset", "left").withColumn("headroom", F.col("value") - F.col("_base")).drop("_base")

"""Ranking: top-k, reranking, subsets of runs. Ties go by document id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyvec.operators.ordered import running


def top_k(scores: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``scores`` with ``rank`` from 1 to ``k`` per ``by``. Spark keeps k rows a group and task before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def top_vector(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of one list, without a shuffle of the rest."""
    return scores.orderBy(F.col("score").desc(), F.col("doc_id")).limit(k)


def exclude_self(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("query_id").cast("string") != F.col("doc_id").cast("string"))


def rerank(run: DataFrame, scores: DataFrame, depth: int, keep_tail: bool = True) -> DataFrame:
    """``run`` with its first ``depth`` documents in order of new scores, equal or missing ones in their old order.

    A document without a new score comes after those with one. Documents below ``depth`` follow as
    they were, or are left out.
    """
    head = run if keep_tail else run.where(F.col("rank") <= depth)
    both = head.select("query_id", "doc_id", "rank").join(scores.select("query_id", "doc_id", F.col("score").alias("new")), ["query_id", "doc_id"], "left")
    order = Window.partitionBy("query_id").orderBy((F.col("rank") > depth).asc(), F.when(F.col("rank") <= depth, F.col("new")).desc_nulls_last(), F.col("rank"))
    return both.withColumn("rank", F.row_number().over(order).cast("bigint")).select("query_id", "doc_id", F.col("new").alias("score"), "rank")


def judged_only(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    return queries.join(qrels.select("query_id"), "query_id", "left_semi")


def ordered_subset(bags: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(ord, id, pos, vec, row)``: the vectors of the bags ``wanted`` ``(id, ord)`` one after the other, ``row`` their place from 0.

    An id listed twice comes twice; one without a bag gives nothing.
    """
    rows = bags.select("id", "pos", "vec").join(wanted.select("id", "ord"), "id")
    return running(rows, [F.col("ord"), F.col("pos")]).select("ord", "id", "pos", "vec", (F.col("place") - 1).alias("row"))


def first_n(df: DataFrame, n: int, by: list[str], order: list[Column]) -> DataFrame:
    """``n`` rows of each group in a fixed order; a hash of an id as order gives a repeatable sample."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def missing(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return todo.join(done.select(*keys), keys, "left_anti")


def candidate_union(runs: list[DataFrame], depth: int) -> DataFrame:
    """Distinct ``(query_id, doc_id)`` of the first ``depth`` of several runs."""
    parts = [r.where(F.col("rank") <= depth).select("query_id", "doc_id") for r in runs]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()

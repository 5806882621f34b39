"""Seams for scorers that are models, and what a run of them costs. No model ships with this library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyvec.functions.text import tokens


def score_pairs(pairs: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], batch: int = 64) -> DataFrame:
    """``(query_id, doc_id, score)`` of ``(query_id, doc_id, query_text, doc_text)`` by any function on two lists of texts.

    Batches hold texts of like length. The scorer is pickled to the workers once a task.
    """
    kinds = [pairs.schema[c].dataType.simpleString() for c in ("query_id", "doc_id")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                g = f.iloc[at : at + batch]
                yield pd.DataFrame({"query_id": g["query_id"], "doc_id": g["doc_id"], "score": scorer(g["query_text"].tolist(), g["doc_text"].tolist())})

    ordered = pairs.select("query_id", "doc_id", "query_text", "doc_text").sortWithinPartitions(F.length("doc_text"))
    return ordered.mapInPandas(run, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")


def overlap_scorer(pairs: DataFrame) -> DataFrame:
    """A stand-in for a model: the share of the query's distinct terms that the document has."""
    return overlap_of_terms(pairs.withColumns({"query_terms": term_set(F.col("query_text")), "doc_terms": term_set(F.col("doc_text"))}))


def term_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def overlap_of_terms(pairs: DataFrame) -> DataFrame:
    """``overlap_scorer`` of ``query_terms`` and ``doc_terms``: a text that is in several pairs needs to be cut only once."""
    q, d = F.col("query_terms"), F.col("doc_terms")
    share = F.when(F.size(q) > 0, F.size(F.array_intersect(q, d)) / F.size(q)).otherwise(0.0)
    return pairs.select("query_id", "doc_id", F.round(share, 6).alias("score"))


def request_key(*parts: Column) -> Column:
    """SHA-256 of a canonical JSON array of the parts."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def ask_missing(requests: DataFrame, cache: str, answer: Callable[[list[str]], list[float]], batch: int = 64) -> DataFrame:
    """``(key, value, latency_ms)`` of ``(key, prompt)`` by any function on a list of prompts; what the cache folder has isn't asked again.

    Answers are appended to the cache with the mean milliseconds of their batch, each key once however
    often it is requested; the last written counts. Null prompts are asked as empty ones.
    """
    from polyvec.sources.tables import append_missing, read_cache

    def ask(left: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import time

            for f in frames:
                for at in range(0, len(f), batch):
                    g = f.iloc[at : at + batch]
                    began = time.perf_counter()
                    values = answer(g["prompt"].fillna("").tolist())
                    yield pd.DataFrame({"key": g["key"], "value": values, "latency_ms": (time.perf_counter() - began) * 1000 / len(g)})

        return left.mapInPandas(run, "key string, value double, latency_ms double")

    append_missing(requests.select("key", "prompt").dropDuplicates(["key"]), cache, ["key"], ask)
    return read_cache(requests.sparkSession, cache, "key string, value double, latency_ms double", form="parquet").join(requests.select("key").distinct(), "key", "left_semi")


def routing_question(query: Column, titles: Column) -> Column:
    """The question whether a query needs the dear reranker: its text and the first results."""
    return F.concat(F.lit("Query: "), F.coalesce(query, F.lit("")), F.lit("\nResults:\n"), F.array_join(F.coalesce(titles, F.array().cast("array<string>")), "\n"), F.lit("\nWould a slower reranker improve this order?"))


def yes_no_scores(answers: DataFrame, least: float = 0.5) -> DataFrame:
    """``(query_id, doc_id, score)`` 1 for a yes, an answer of at least ``least``, else 0."""
    return answers.select("query_id", "doc_id", (F.coalesce(F.col("score"), F.lit(0.0)) >= least).cast("double").alias("score"))


def choice_scores(answers: DataFrame, options: DataFrame) -> DataFrame:
    """``(query_id, doc_id, score)`` of answers ``(query_id, probs map)``: the probability of each option ``(query_id, doc_id, option)``, 0 if missing."""
    return options.join(answers, "query_id", "left").select("query_id", "doc_id", F.coalesce(F.try_element_at("probs", F.col("option")), F.lit(0.0)).alias("score"))


def stable_rerank(scores: DataFrame) -> DataFrame:
    """Full lists by new score, equal ones in their first order ``first_rank``."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "first_rank")
    return scores.withColumn("rank", F.row_number().over(w).cast("bigint"))


def cross_encoder_flops(tokens: Column, parameters: float = 567e6, layers: int = 24, hidden: int = 1024) -> Column:
    n = tokens.cast("double")
    return F.lit(2 * parameters) * n + F.lit(4.0 * layers * hidden) * n * n


def dense_flops(dim: int, docs: Column) -> Column:
    return F.lit(2.0 * dim) * docs


def sparse_flops(query_tokens: Column, dim: int, width: int, query_nnz: Column, doc_nnz: Column, docs: Column) -> Column:
    return F.lit(2.0 * dim * width) * query_tokens + 2.0 * query_nnz * (doc_nnz * docs / width)


def maxsim_flops(query_tokens: Column, doc_tokens: Column, dim: int) -> Column:
    return F.lit(2.0 * dim) * query_tokens * doc_tokens


def storage_bytes(texts: DataFrame) -> DataFrame:
    """``(items, text_bytes)`` in UTF-8."""
    return texts.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("text_bytes"))


def api_price(tokens: Column, per_million: float = 0.042) -> Column:
    return tokens * F.lit(per_million) / 1e6

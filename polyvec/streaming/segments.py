"""Growing a BM25 index by segments: raw counts of new documents are appended batch by batch.

Weights depend on the whole corpus, counts don't, so segments hold counts and weights are made from
their union. A batch writes its own folder, so that a repeated batch replaces itself. A document
without terms has one row with a null term: it counts in the number of documents, and replaces what an
earlier segment had of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyvec.operators.encode import bm25_weights, lengths_of, term_frequencies


def segment_counts(texts: DataFrame, **options) -> DataFrame:
    """``(id, term, tf, length)`` of ``(id, text)``, documents without terms included."""
    found = term_frequencies(texts, **options)
    empty = texts.select("id").distinct().join(found.select("id").distinct(), "id", "left_anti")
    return found.unionByName(empty.select("id", F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("tf"), F.lit(0).alias("length")))


def write_segment(texts: DataFrame, path: str, number: int, **options) -> None:
    segment_counts(texts, **options).write.mode("overwrite").parquet(f"{path}/segment={number}")


def append_segments(texts: DataFrame, path: str, checkpoint: str, **options):
    """Start a stream that turns ``(id, text)`` into segments of term counts under ``path``."""
    return texts.writeStream.foreachBatch(lambda batch, number: write_segment(batch, path, number, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _last(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    last = rows.groupBy("id").agg(F.max("segment").alias("segment"))
    return rows.join(last, ["id", "segment"], "left_semi").select("id", "term", "tf", "length")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """``(id, term, tf, length)``; of an id in several segments the last counts."""
    return _last(spark, path).where("term is not null")


def segment_weights(spark: SparkSession, path: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(id, term, weight)``: the BM25 index of all segments, as of their texts at once."""
    rows = _last(spark, path)
    return bm25_weights(rows.where("term is not null"), lengths_of(rows), k1, b)

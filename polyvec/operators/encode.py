"""Encodings of token bags and texts: anchor-sparse, fixed-dimensional, BM25.

Random directions come from integer arithmetic on (seed, row, dimension), so any engine can make the
same ones and nothing depends on a library's generator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyvec.functions.text import STOP_WORDS, stems, tokens
from polyvec.functions.vectors import centre
from polyvec.operators.ordered import if_few

# A multiplicative congruential generator modulo the prime 2^31 - 1.
MODULUS, FACTOR, START = 2147483647, 48271, 69621


def hashed(seed: int, rows: int, dim: int) -> np.ndarray:
    """Integers below ``MODULUS`` by row and dimension."""
    x = np.arange(rows, dtype=np.int64)[:, None] * dim + np.arange(dim) + seed * 7919 + 1
    return x * START % MODULUS


def directions(seed: int, rows: int, dim: int, unit: bool = True) -> np.ndarray:
    """Directions with nearly normal elements (sums of four uniforms), of unit length if wanted."""
    x, total = hashed(seed, rows, dim), np.zeros((rows, dim))
    for _ in range(4):
        x = x * FACTOR % MODULUS
        total += x / MODULUS
    total -= 2.0
    return total / np.sqrt((total * total).sum(1, keepdims=True)) if unit else total


def signs(seed: int, rows: int, dim: int) -> np.ndarray:
    """Elements of 1 / sqrt(rows) with hashed signs."""
    x = hashed(seed, rows, dim) * FACTOR % MODULUS
    return np.where(x % 2 == 0, 1.0, -1.0) / np.sqrt(rows)


def token_mean(bags: DataFrame) -> DataFrame:
    """``(dim, mean)`` of all vectors; partial sums before the shuffle."""
    return bags.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"))


def mean_vector(bags: DataFrame) -> list[float]:
    """The mean as a list: as many numbers as dimensions."""
    return [r["mean"] for r in token_mean(bags).orderBy("dim").collect()]


def centred(bags: DataFrame, mean: list[float]) -> DataFrame:
    return bags.withColumn("vec", centre(F.col("vec"), F.array(*[F.lit(float(m)) for m in mean])))


def anchor_weights(bags: DataFrame, width: int, k: int, reps: int = 1, seed: int = 0, dim: int = 64) -> DataFrame:
    """``(id, pos, anchor, p)``: of each of ``reps`` blocks of ``width`` anchors the ``k`` with the largest
    projection of a token, ties by anchor. Projections keep nine decimals. No shuffle."""
    if k > width:
        raise ValueError("k must not be above the width of a block")
    kinds = [bags.schema[c].dataType.simpleString() for c in ("id", "pos")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = directions(seed, width * reps, dim)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                x = np.asarray(piece.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
                p = np.round(x @ anchors.T, 9).reshape(len(x), reps, width)
                top = np.argsort(-p, axis=2, kind="stable")[:, :, :k]
                row = np.repeat(np.arange(len(x)), reps * k)
                index = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(index), piece.column(1).take(index), pa.array((top + (np.arange(reps) * width)[None, :, None]).ravel(), pa.int64()), pa.array(np.take_along_axis(p, top, 2).ravel())],
                    names=["id", "pos", "anchor", "p"],
                )

    return bags.select("id", "pos", "vec").mapInArrow(run, f"id {kinds[0]}, pos {kinds[1]}, anchor bigint, p double")


def smve_encode(bags: DataFrame, width: int, k: int, reps: int = 1, role: str = "document", seed: int = 0, dim: int = 64) -> DataFrame:
    """``(id, term, weight)``: per anchor the sum (``query``) or the mean (``document``) over the tokens that kept it."""
    hits = anchor_weights(bags, width, k, reps, seed, dim)
    pool = F.sum("p") if role == "query" else F.avg("p")
    return hits.groupBy("id", F.col("anchor").alias("term")).agg(pool.alias("weight"))


def bucket_codes(bags: DataFrame, reps: int, bits: int, proj: int, seed: int = 0, dim: int = 64) -> DataFrame:
    """``(id, pos, rep, code, psi)``: a token's bucket in each repetition and its projection to ``proj`` dimensions.

    Bit i is set where the dot product with hyperplane i, to nine decimals, is above 0.
    """
    if bits > 8:
        raise ValueError("at most 8 hyperplanes a repetition")
    kinds = [bags.schema[c].dataType.simpleString() for c in ("id", "pos")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = directions(seed + 1000, reps * bits, dim, unit=False)
        flips = [signs(seed + 2000 + r, proj, dim) for r in range(reps)]
        for batch in batches:
            x = np.asarray(batch.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
            if not len(x):
                continue
            code = ((np.round(x @ planes.T, 9) > 0).reshape(len(x), reps, bits) * (1 << np.arange(bits))).sum(2)
            psi = np.stack([x @ f.T for f in flips], 1)
            index = pa.array(np.repeat(np.arange(len(x)), reps))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), batch.column(1).take(index), pa.array(np.tile(np.arange(reps), len(x)), pa.int32()), pa.array(code.ravel(), pa.int32()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(x) * reps + 1) * proj, pa.int32()), pa.array(psi.ravel()))],
                names=["id", "pos", "rep", "code", "psi"],
            )

    return bags.select("id", "pos", "vec").mapInArrow(run, f"id {kinds[0]}, pos {kinds[1]}, rep int, code int, psi array<double>")


def fde_encode(bags: DataFrame, reps: int, bits: int, proj: int, role: str = "document", seed: int = 0, dim: int = 64) -> DataFrame:
    """``(id, rep, bucket, dim, value)`` of the buckets that hold something.

    Query: sums. Document: means, and an empty bucket takes the projection of the first token whose
    code differs from it in the fewest bits.
    """
    codes = bucket_codes(bags, reps, bits, proj, seed, dim)
    each = codes.select("id", "rep", F.col("code").alias("bucket"), F.posexplode("psi").alias("dim", "v"))
    if role == "query":
        return each.groupBy("id", "rep", "bucket", "dim").agg(F.sum("v").alias("value"))
    mean = each.groupBy("id", "rep", "bucket", "dim").agg(F.avg("v").alias("value"))
    buckets = F.sequence(F.lit(0), F.lit((1 << bits) - 1))
    near = codes.select("id", "pos", "rep", "code", "psi", F.explode(buckets).alias("bucket")).withColumn("away", F.bit_count(F.col("code").bitwiseXOR(F.col("bucket"))))
    fill = near.groupBy("id", "rep", "bucket").agg(F.min("away").alias("away"), F.min_by("psi", F.struct("away", "pos")).alias("psi")).where("away > 0")
    filled = fill.select("id", "rep", "bucket", F.posexplode("psi").alias("dim", "value"))
    return mean.unionByName(filled)


def fde_terms(fde: DataFrame, bits: int, proj: int) -> DataFrame:
    """``(id, term, weight)``: cells as terms, for the sparse product. Zeros of empty query buckets never arise."""
    term = (F.col("rep").cast("bigint") * (1 << bits) + F.col("bucket")) * proj + F.col("dim")
    return fde.select("id", term.alias("term"), F.col("value").alias("weight"))


def term_frequencies(texts: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS, stemmed: bool = False) -> DataFrame:
    """``(id, term, tf, length)`` of ``(id, text)``; texts without terms give no row."""
    words = tokens(F.col("text"), stop_words)
    rows = texts.select("id", (stems(words) if stemmed else words).alias("words"))
    exploded = rows.select("id", F.size("words").alias("length"), F.explode("words").alias("term"))
    return exploded.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def asked_counts(texts: DataFrame, terms: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS, stemmed: bool = False) -> DataFrame:
    """``(id, term, tf, length)`` of the terms of ``terms`` ``(term)`` only, which the caller has counted and which are broadcast.

    All other tokens of a document are one row with a null term, a text without tokens too, so that every
    document is there with its length, from one pass over the texts.
    """
    words = tokens(F.col("text"), stop_words)
    rows = texts.select("id", (stems(words) if stemmed else words).alias("words"))
    exploded = rows.select("id", F.size("words").alias("length"), F.explode_outer("words").alias("token"))
    known = F.broadcast(terms.select(F.col("term").alias("token"), F.col("term")).distinct())
    return exploded.join(known, "token", "left").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def lengths_of(counts: DataFrame) -> DataFrame:
    """``(n_docs, all)`` of counts in which every document has a row."""
    return counts.groupBy("id").agg(F.first("length").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("length").alias("all"))


def bm25_index(texts: DataFrame, k1: float = 1.2, b: float = 0.75, stop_words: tuple[str, ...] = STOP_WORDS, stemmed: bool = False) -> DataFrame:
    """``(id, term, weight)`` with ``idf = ln(1 + (N - df + 0.5) / (df + 0.5))``. Texts without terms count in N and the mean length."""
    tf = term_frequencies(texts, stop_words, stemmed)
    total = texts.agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(tf.agg(F.sum("tf").alias("all")))  # two single rows
    return bm25_weights(tf, total, k1, b)


def bm25_weights(tf: DataFrame, total: DataFrame, k1: float = 1.2, b: float = 0.75, asked: bool = False, **also: Column) -> DataFrame:
    """``(id, term, weight)`` from raw counts ``(id, term, tf, length)`` and one row ``(n_docs, all)``; ``also``: further columns of the counts.

    ``asked``: the counts are stored, and of the terms of queries only, so that these may be counted and broadcast.
    """
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = if_few(df) if asked else df
    stats = total.select("n_docs", (F.col("all") / F.col("n_docs")).alias("mean_length"))
    joined = tf.join(df, "term").crossJoin(F.broadcast(stats))  # one row, whatever the corpus
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    return joined.select("id", "term", weight.alias("weight"), *[c.alias(n) for n, c in also.items()])


def bm25_queries(texts: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS, stemmed: bool = False) -> DataFrame:
    """``(id, term, weight)``: term counts. Terms that no document has fall out in the join."""
    return term_frequencies(texts, stop_words, stemmed).select("id", "term", F.col("tf").cast("double").alias("weight"))


def index_size(postings: DataFrame, items: int) -> DataFrame:
    """``(nnz, terms, csr_bytes, index_bytes)``: 4-byte values and ids, 4-byte row and 8-byte term offsets."""
    one = postings.agg(F.count(F.lit(1)).alias("nnz"), F.countDistinct("term").alias("terms"))
    return one.select("nnz", "terms", (F.col("nnz") * 8 + (F.lit(items) + 1) * 4).alias("csr_bytes"), (F.col("nnz") * 8 + (F.col("terms") + 1) * 8).alias("index_bytes"))


def mean_nnz(postings: DataFrame, items: DataFrame) -> DataFrame:
    """``(items, nnz, mean_nnz)`` over all items, those without a posting too."""
    return items.agg(F.count(F.lit(1)).alias("items")).crossJoin(postings.agg(F.count(F.lit(1)).alias("nnz"))).withColumn("mean_nnz", F.col("nnz") / F.col("items"))


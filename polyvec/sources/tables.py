"""Reading and writing: corpora, judgments, runs, summaries, caches. Ids stay strings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyvec.functions.text import join_title
from polyvec.functions.vectors import is_finite, normalise


@dataclass(frozen=True)
class Dataset:
    """Where a dataset lies and whether a query may be its own document."""

    name: str
    display: str
    excludes_self: bool = False

    def embeddings(self, root: str, model: str) -> str:
        return f"{root}/{self.name}/{model}/embeddings"

    def results(self, root: str, model: str) -> str:
        return f"{root}/{self.name}_{model}"

    def allowed(self, scores: DataFrame) -> DataFrame:
        """Scores without those of a query with itself, where the dataset's queries are documents too."""
        return scores.where(F.col("query_id").cast("string") != F.col("doc_id").cast("string")) if self.excludes_self else scores


DATASETS: dict[str, Dataset] = {d.name: d for d in (Dataset("labclaims", "Lab claims"), Dataset("nutriqa", "Nutrition questions"), Dataset("debatepro", "Debate", True))}


def latest(df: DataFrame, keys: list[str], at: str, *ties: Column) -> DataFrame:
    """One row per ``keys``: the latest by ``at``, nulls last, then by ``ties``."""
    order = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), *ties)
    return df.withColumn("_pick", F.row_number().over(order)).where(F.col("_pick") == 1).drop("_pick")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, dataset, text)``: the latest delivery of every document that has a text."""
    docs = read_table(spark, folder, "docs").where("doc_texts is not null")
    return latest(docs, ["doc_id"], "loaded_at", F.col("doc_texts")).select("doc_id", "dataset", F.col("doc_texts").alias("text"))


def queries(spark: SparkSession, folder: str) -> DataFrame:
    """``(query_id, dataset, split, text)`` of every query whose text isn't blank."""
    rows = read_table(spark, folder, "queries").where("trim(query_text) <> ''")
    return latest(rows, ["query_id"], "created_at", F.col("query_text")).select("query_id", "dataset", "split", F.col("query_text").alias("text"))


def qrels(spark: SparkSession, folder: str) -> DataFrame:
    """``(query_id, doc_id, rel)`` with ``rel > 0``: the latest judgment of a pair."""
    rows = read_table(spark, folder, "qrels").where("score is not null")
    return latest(rows, ["query_id", "doc_id"], "judged_at", F.col("score").desc()).select("query_id", "doc_id", F.col("score").alias("rel")).where("rel > 0")


def token_bags(spark: SparkSession, folder: str, unit: bool = True) -> DataFrame:
    """``(id, pos, vec)``: token vectors of every document, at unit length or as stored, without null, zero and NaN vectors."""
    rows = read_table(spark, folder, "token_embeddings").where(is_finite(F.col("colbert_flat")))
    one = rows.groupBy("token_id").agg(F.min(F.struct("doc_id", "pos", "colbert_flat")).alias("r"))
    return one.select(F.col("r.doc_id").alias("id"), F.col("token_id").alias("pos"), (normalise(F.col("r.colbert_flat")) if unit else F.col("r.colbert_flat")).alias("vec"))


def query_bags(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, pos, vec)``: the vectors of ``embeddings``, a bag per label."""
    return read_table(spark, folder, "embeddings").select(F.col("label").alias("id"), F.col("vec_id").alias("pos"), normalise(F.col("embedding")).alias("vec"))


def dense_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, vec)``: the unit dense vector of every document that has one."""
    rows = read_table(spark, folder, "doc_embeddings").where(is_finite(F.col("dense")))
    return latest(rows, ["doc_id"], "encoded_at", F.col("dense")).select(F.col("doc_id").alias("id"), normalise(F.col("dense")).alias("vec"))


def sparse_weights(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, term, weight)`` of every document; a term listed more than once has the sum of its weights."""
    rows = latest(read_table(spark, folder, "doc_embeddings").where("sparse_ids is not null"), ["doc_id"], "encoded_at", F.col("sparse_ids"))
    pairs = rows.select("doc_id", F.explode(F.arrays_zip("sparse_ids", "sparse_weights")).alias("e"))
    return pairs.where("e.sparse_ids is not null and e.sparse_weights is not null").groupBy(F.col("doc_id").alias("id"), F.col("e.sparse_ids").alias("term")).agg(F.sum(F.col("e.sparse_weights").cast("double")).alias("weight"))


def sparse_map(weights: DataFrame, key: str) -> DataFrame:
    """``(term, weight)`` of one item; the filter reaches the scan."""
    return weights.where(F.col("id") == key).select("term", "weight")


def token_bag(bags: DataFrame, key: str) -> DataFrame:
    """The one item's vectors in order, as an array of arrays."""
    return bags.where(F.col("id") == key).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "vec"))), lambda e: e["vec"]).alias("vecs"))


def read_beir_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, text)`` of JSON lines with ``_id``, ``title`` and ``text``."""
    rows = spark.read.schema("_id string, title string, text string").json(path)
    return rows.select(F.col("_id").alias("doc_id"), join_title(F.col("title"), F.col("text")).alias("text"))


def read_beir_qrels(spark: SparkSession, path: str, keep_zero: bool = False) -> DataFrame:
    """``(query_id, doc_id, rel)`` of a tab-separated file with header; judgments of 0 only if wanted."""
    rows = spark.read.schema("query_id string, doc_id string, rel int").csv(path, sep="\t", header=True)
    return rows if keep_zero else rows.where("rel > 0")


def read_trec_run(spark: SparkSession, path: str) -> DataFrame:
    """``(query_id, doc_id, rank, score, tag)`` of lines ``qid Q0 did rank score tag``."""
    p = F.split(F.trim("value"), "\\s+")
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(p[0].alias("query_id"), p[2].alias("doc_id"), p[3].cast("int").alias("rank"), p[4].cast("double").alias("score"), p[5].alias("tag"))


def trec_lines(run: DataFrame, tag: str) -> DataFrame:
    """``(line)``: the lines of a run, scores with six decimals."""
    return run.select(F.format_string("%s Q0 %s %d %.6f %s", F.col("query_id").cast("string"), F.col("doc_id").cast("string"), F.col("rank"), F.col("score"), F.lit(tag)).alias("line"))


def write_trec_run(run: DataFrame, path: str, tag: str) -> None:
    """Text files in order of query and rank; range partitions, so no single writer."""
    ordered = run.repartitionByRange("query_id", "rank").sortWithinPartitions("query_id", "rank")
    trec_lines(ordered, tag).write.mode("overwrite").text(path)


def write_embeddings(path: str, **parts: DataFrame) -> None:
    """One folder a representation, so that a reader takes only what it needs."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_summary(metrics: DataFrame, path: str, **params: object) -> None:
    """Mean metrics ``(metric, value)``, rounded to five digits, and parameters as one JSON object."""
    row = metrics.agg(F.map_from_entries(F.collect_list(F.struct("metric", F.round("value", 5)))).alias("metrics"))
    made = row.select(F.struct(*[F.lit(v).alias(k) for k, v in params.items()]).alias("params") if params else F.lit(None).cast("string").alias("params"), "metrics", F.current_timestamp().alias("made_at"))
    made.write.mode("overwrite").json(path)


def read_summaries(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """One row per summary file of a glob, with its path; ``params`` without ``reps`` get 1."""
    rows = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("path", F.input_file_name())
    if "params" in rows.columns and "reps" in rows.schema["params"].dataType.fieldNames():
        rows = rows.withColumn("params", F.col("params").withField("reps", F.coalesce("params.reps", F.lit(1))))
    return rows


def merge_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join on keys that must be unique on both sides; a repeated key is an error, found by one aggregate a side."""
    for side, df in (("left", left), ("right", right)):
        twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"{side}: more than one row of {tuple(twice[0])[:-1]}")
    return left.join(right, keys, how)


def read_typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_cache(spark: SparkSession, path: str, schema: str, key: str = "key", form: str = "json") -> DataFrame:
    """A cache of JSON lines, or of Parquet; of several records of a key the one written last counts.

    ``append_missing`` numbers its appends in ``_written``; a higher number is later. Records without
    one, or of one append, go by file, then place in it.
    """
    rows = spark.read.schema(f"{schema}, _written bigint").format(form).load(path)
    rows = rows.withColumn("_at", F.struct(F.coalesce("_written", F.lit(-1)), F.input_file_name(), F.monotonically_increasing_id())).drop("_written")
    fields = [F.col(c) for c in rows.columns if c != "_at"]
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*fields), F.col("_at")).alias("r")).select("r.*")


def append_missing(todo: DataFrame, cache_path: str, keys: list[str], score, form: str = "parquet") -> None:
    """Score what the cache lacks and append it with the number of the append; a second call finds nothing to do."""
    left, number = todo, 0
    try:
        kinds = ", ".join(f"{k} {todo.schema[k].dataType.simpleString()}" for k in keys)
        done = todo.sparkSession.read.schema(f"{kinds}, _written bigint").format(form).load(cache_path)
        number = done.agg(F.coalesce(F.max("_written"), F.lit(-1)) + 1).first()[0]
        left = todo.join(done.select(*keys), keys, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    score(left).withColumn("_written", F.lit(number).cast("bigint")).write.mode("append").format(form).save(cache_path)

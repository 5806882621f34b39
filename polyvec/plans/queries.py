"""The engine's queries over the test tables. Every one reads whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyvec.functions import text as T
from polyvec.functions.vectors import dot
from polyvec.operators import encode, metrics, rank, router, scorers, scoring, stats
from polyvec.operators.ordered import percentiles
from polyvec.plans.shared import checkpoint, scratch
from polyvec.sources import tables as S
from polyvec.streaming import segments

# The settings of the queries; the SQL twins use the same. The weights of ALPHAS.
WIDTH, KEEP, REPS = 64, 4, 2
BITS, PROJ = 3, 4
ALPHA = 0.3
ALPHAS = (0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0)
LEVELS = (0.0, 0.1, 0.2, 0.3, 0.4)
DEPTH = 100
CURVE = 20
# The surveyed settings, of the queries named *_surveyed. They have no SQL.
RESAMPLES = 10_000
SURVEYED_LEVELS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
SURVEYED_WIDTH, SURVEYED_KEEP = 256, 8
BUDGETS = (1, 2, 4, 8)
SEED = 0
BUDGETS_MS = (10.0, 30.0, 100.0, 250.0)


def _r(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: _r(n, digits) for n in names})


# --- dense and late interaction


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return S.query_bags(spark, d).select(F.col("pos").alias("id"), "vec")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return rank.top_k(scoring.dense_scores(v, v, k=10), 10)


def dense_topk_self_excluded(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return rank.top_k(scoring.dense_scores(v, v, k=10, exclude_self=True), 10)


def maxsim_exhaustive(spark: SparkSession, d: str) -> DataFrame:
    return scoring.maxsim_scores(S.query_bags(spark, d), S.token_bags(spark, d))


def maxsim_topk(spark: SparkSession, d: str) -> DataFrame:
    return rank.top_k(scoring.maxsim_scores(S.query_bags(spark, d), S.token_bags(spark, d), k=10), 10)


def _smve_run(spark: SparkSession, d: str, k: int, reps: int = 1, mean: list[float] | None = None) -> DataFrame:
    q, t = S.query_bags(spark, d), S.token_bags(spark, d)
    if mean is not None:
        q, t = encode.centred(q, mean), encode.centred(t, mean)
    return rank.top_k(scoring.sparse_topk(encode.smve_encode(q, WIDTH, KEEP, reps, "query"), encode.smve_encode(t, WIDTH, KEEP, reps), k), k)


def _reranked(spark: SparkSession, d: str, keep_tail: bool) -> DataFrame:
    run = _smve_run(spark, d, 50)
    pairs = run.where("rank <= 20")
    scores = scoring.maxsim_relational(S.query_bags(spark, d), S.token_bags(spark, d), pairs)
    return rank.rerank(run, scores, 20, keep_tail).select("query_id", "doc_id", "rank")


def maxsim_rerank_tail(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d, True)


def maxsim_rerank_truncate(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d, False)


def token_mean(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(encode.token_mean(S.token_bags(spark, d)), "mean").withColumn("dim", F.col("dim").cast("bigint"))


def centered_tokens(spark: SparkSession, d: str) -> DataFrame:
    bags = S.token_bags(spark, d)
    moved = encode.centred(bags, encode.mean_vector(bags))
    return moved.select(F.col("pos").alias("token_id"), F.posexplode("vec").alias("dim", "value")).select("token_id", F.col("dim").cast("bigint").alias("dim"), _r("value").alias("value"))


# --- anchor-sparse and fixed-dimensional encodings


def smve_encode_docs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(encode.smve_encode(S.token_bags(spark, d), WIDTH, KEEP), "weight")


def smve_encode_queries(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(encode.smve_encode(S.query_bags(spark, d), WIDTH, KEEP, role="query"), "weight")


def smve_topk(spark: SparkSession, d: str) -> DataFrame:
    return _smve_run(spark, d, 10)


def smve_reps(spark: SparkSession, d: str) -> DataFrame:
    return _smve_run(spark, d, 10, REPS)


def smve_centered(spark: SparkSession, d: str) -> DataFrame:
    return _smve_run(spark, d, 10, mean=encode.mean_vector(S.token_bags(spark, d)))


def muvera_codes(spark: SparkSession, d: str) -> DataFrame:
    codes = encode.bucket_codes(S.token_bags(spark, d), REPS, BITS, PROJ)
    return codes.select(F.col("pos").alias("token_id"), F.col("rep").cast("bigint").alias("rep"), F.col("code").cast("bigint").alias("code"))


def _fde(bags: DataFrame, role: str) -> DataFrame:
    fde = encode.fde_encode(bags, REPS, BITS, PROJ, role)
    return fde.select("id", *[F.col(c).cast("bigint").alias(c) for c in ("rep", "bucket", "dim")], _r("value").alias("value"))


def muvera_fde_docs(spark: SparkSession, d: str) -> DataFrame:
    return _fde(S.token_bags(spark, d), "document")


def muvera_fde_queries(spark: SparkSession, d: str) -> DataFrame:
    return _fde(S.query_bags(spark, d), "query")


def muvera_topk(spark: SparkSession, d: str) -> DataFrame:
    q = encode.fde_terms(encode.fde_encode(S.query_bags(spark, d), REPS, BITS, PROJ, "query"), BITS, PROJ)
    t = encode.fde_terms(encode.fde_encode(S.token_bags(spark, d), REPS, BITS, PROJ), BITS, PROJ)
    return rank.top_k(scoring.sparse_topk(q, t, 10), 10)


# --- BM25 and lexical


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return S.documents(spark, d).select(F.col("doc_id").alias("id"), "text")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return S.queries(spark, d).select(F.col("query_id").alias("id"), "text")


def _counts(spark: SparkSession, d: str, stop: tuple[str, ...] = T.STOP_WORDS, stemmed: bool = False) -> tuple[DataFrame, DataFrame]:
    """The terms of the queries, and their counts in the documents: the texts are read once.

    A query side too large to broadcast its terms takes the counts of all terms.
    """
    asked, texts = checkpoint(encode.bm25_queries(_asked(spark, d), stop, stemmed)), _texts(spark, d)
    if asked.count() <= scoring.BLOCK_FLOATS:
        return asked, checkpoint(encode.asked_counts(texts, asked, stop, stemmed))
    return asked, checkpoint(segments.segment_counts(texts, stop_words=stop, stemmed=stemmed))


def _both_weights(counts: DataFrame) -> DataFrame:
    """``(id, term, weight, weight2)``: BM25 and lexical, from one row."""
    return encode.bm25_weights(counts.where("term is not null"), encode.lengths_of(counts), asked=True, weight2=F.ln(F.col("tf") + 1.0))


def _bm25_of(asked: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    index = _both_weights(counts).drop("weight2")
    return rank.top_k(scoring.sparse_topk(asked, index, k), k)


def _lex_of(asked: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    weights = counts.where("term is not null").select("id", "term", F.ln(F.col("tf") + 1.0).alias("weight"))
    return rank.top_k(scoring.sparse_topk(asked, weights, k), k)


def _bm25_run(spark: SparkSession, d: str, k: int = DEPTH, stop: tuple[str, ...] = T.STOP_WORDS, stemmed: bool = False) -> DataFrame:
    return _bm25_of(*_counts(spark, d, stop, stemmed), k)


def _two_runs(spark: SparkSession, d: str, k: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """BM25 and lexical, from the same counts."""
    counts = _counts(spark, d)
    return _bm25_of(*counts, k), _lex_of(*counts, k)


def _lex_run(spark: SparkSession, d: str, k: int = DEPTH) -> DataFrame:
    return _lex_of(*_counts(spark, d), k)


def bm25_terms(spark: SparkSession, d: str) -> DataFrame:
    return encode.term_frequencies(_texts(spark, d)).select("id", "term", "tf", F.col("length").cast("bigint").alias("length"))


def bm25_index(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(encode.bm25_index(_texts(spark, d)), "weight")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25_run(spark, d)


def bm25_nostop(spark: SparkSession, d: str) -> DataFrame:
    return _bm25_run(spark, d, 10, ())


def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return _bm25_run(spark, d, 10, stemmed=True)


def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    w = S.sparse_weights(spark, d)
    return rank.top_k(scoring.lexical_topk(w, w, 10, exclude_self=True), 10)


def postings_read(spark: SparkSession, d: str) -> DataFrame:
    return scoring.postings_read(encode.bm25_queries(_asked(spark, d)), encode.bm25_index(_texts(spark, d)))


def bm25_from_segments(spark: SparkSession, d: str) -> DataFrame:
    """The index from counts in two segments, of which the second replaces what the first has of the same documents."""
    texts, path = _texts(spark, d), scratch(spark, "segments")
    late = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    segments.write_segment(texts.withColumn("text", F.when(late, F.lit("an older text")).otherwise(F.col("text"))), path, 0)
    segments.write_segment(texts.where(late), path, 1)
    return _rounded(segments.segment_weights(spark, path), "weight")


def index_size(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    return encode.index_size(encode.term_frequencies(texts), texts.count())


def nnz_stats(spark: SparkSession, d: str) -> DataFrame:
    texts, asked = _texts(spark, d), _asked(spark, d)
    parts = [encode.mean_nnz(encode.term_frequencies(t), t).withColumn("side", F.lit(n)) for n, t in (("documents", texts), ("queries", asked))]
    return _rounded(parts[0].unionByName(parts[1]), "mean_nnz")


# --- fusion


def _hybrid_run(spark: SparkSession, d: str, k: int, parts: bool = False) -> DataFrame:
    v, w = S.dense_vectors(spark, d), S.sparse_weights(spark, d)
    return rank.top_k(scoring.hybrid_topk(v, v, w, w, k, ALPHA, exclude_self=True, dim=32, parts=parts), k)


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid_run(spark, d, 10)


def hybrid_three_way(spark: SparkSession, d: str) -> DataFrame:
    """0.4 dense + 0.2 sparse + 0.4 MaxSim on the hybrid's first 20, each score of these pairs only; the first two come with the run."""
    run, bags = checkpoint(_hybrid_run(spark, d, 20, parts=True)), S.token_bags(spark, d, unit=False)
    known = run.select("query_id", "doc_id", (0.4 * F.col("dense") + 0.2 * F.col("lex")).alias("score"))
    return rank.top_k(scoring.weighted_fusion([(1.0, known), (0.4, scoring.maxsim_of_pairs(bags, bags, run, unit=True))]), 10)


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("query_id", F.concat_ws("|", F.col("alpha").cast("string"), "query_id")).drop("alpha")


def alpha_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Mean nDCG@10 of BM25 + alpha * lexical for ten alphas: one scoring of the judged queries, whose best ten for each alpha leave the kernel."""
    alphas, qrels = F.array(*[F.lit(a) for a in ALPHAS]), S.qrels(spark, d)
    asked, counts = _counts(spark, d)
    asked = rank.judged_only(asked.withColumnRenamed("id", "query_id"), qrels).withColumnRenamed("query_id", "id")
    best = scoring.sparse_best(asked, _both_weights(counts), [(1.0, a, 10) for a in ALPHAS])
    run = rank.top_k(_keyed(best.withColumn("alpha", alphas[F.col("want")]).select("alpha", "query_id", "doc_id", "score")), 10)
    per = metrics.evaluate(run, _keyed(qrels.withColumn("alpha", F.explode(alphas))), (10,))
    return per.groupBy(F.split("query_id", "\\|")[0].cast("double").alias("alpha")).agg(_r(F.avg("ndcg")).alias("ndcg"))


# --- evaluation


def _per_query(spark: SparkSession, d: str, ks: tuple[int, ...] = metrics.KS) -> DataFrame:
    return metrics.evaluate(_bm25_run(spark, d), S.qrels(spark, d), ks)


def eval_per_query(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_per_query(spark, d), *metrics.METRICS)


def eval_mean(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.means(_per_query(spark, d)), "value")


def eval_wide(spark: SparkSession, d: str) -> DataFrame:
    wide = metrics.wide_form(_per_query(spark, d, (1, 10)), (1, 10))
    return wide.select("query_id", *[_r(F.col(f"`{m}@{k}`")).alias(f"{m}_{k}") for m in metrics.METRICS for k in (1, 10)])


def metrics_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.curves(_bm25_run(spark, d), S.qrels(spark, d), CURVE), "value")


def metrics_at_k_surveyed(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.curves(_bm25_run(spark, d), S.qrels(spark, d), DEPTH), "value")


def first_relevant(spark: SparkSession, d: str) -> DataFrame:
    return metrics.first_relevant(_bm25_run(spark, d), S.qrels(spark, d))


def first_relevant_profile(spark: SparkSession, d: str) -> DataFrame:
    return metrics.first_relevant_profile(_bm25_run(spark, d), S.qrels(spark, d), DEPTH)


def score_separation(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.score_separation(_bm25_run(spark, d), S.qrels(spark, d)), "mean", "low", "median", "high")


def ndcg_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(_rounded(_per_query(spark, d, (10,)), "ndcg"), "ndcg", 0.0, 1.0, 8)


def dataset_means(spark: SparkSession, d: str) -> DataFrame:
    """Means per dataset of the queries and method, one column a method: the headroom table."""
    parts = [metrics.evaluate(run, S.qrels(spark, d), (10,)).select("query_id", "ndcg", F.lit(name).alias("method")) for name, run in zip(("bm25", "lexical"), _two_runs(spark, d))]
    named = parts[0].unionByName(parts[1]).join(S.queries(spark, d).select("query_id", "dataset"), "query_id")
    wide = named.groupBy("dataset").pivot("method", ["bm25", "lexical"]).agg(F.avg("ndcg"))
    return wide.select("dataset", _r("bm25").alias("bm25"), _r("lexical").alias("lexical"), _r(F.col("lexical") - F.col("bm25")).alias("headroom"))


# --- comparing runs


def run_fidelity(spark: SparkSession, d: str) -> DataFrame:
    bm25, lexical = _two_runs(spark, d)
    return _rounded(stats.fidelity(lexical, bm25), "overlap", "coverage", "median_rank")


def _delta(spark: SparkSession, d: str) -> DataFrame:
    judged, (bm25, lexical) = S.qrels(spark, d), _two_runs(spark, d, 10)
    delta = stats.deltas(metrics.evaluate(lexical, judged, (10,)), metrics.evaluate(bm25, judged, (10,)), "ndcg", 10)
    return checkpoint(delta.select("query_id", _r("delta").alias("delta")))  # a row a query, read several times


def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    return _delta(spark, d)


def paired_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.paired_summary(_delta(spark, d)), "mean_delta")


def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.bootstrap_interval(_delta(spark, d), 200), "low", "high")


def paired_bootstrap_surveyed(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.bootstrap_interval(_delta(spark, d), RESAMPLES), "low", "high")


def wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.wilcoxon(_delta(spark, d)), "w_plus", "w_minus", "z").drop("p")


def wilcoxon_p(spark: SparkSession, d: str) -> DataFrame:
    return stats.wilcoxon(_delta(spark, d)).select("n", "p")


def _settings(spark: SparkSession, d: str) -> DataFrame:
    """One row a method of the log: its parameters, median time, mean postings; the log's spellings folded."""
    log = S.read_table(spark, d, "latency_log").where("method is not null and total_ms > 0 and not isnan(total_ms)")
    number = lambda p: F.regexp_extract("method", p, 1).try_cast("bigint")
    log = log.select(F.lower(F.trim("method")).alias("method"), "total_ms", "postings_read")
    means = log.groupBy("method").agg(F.avg("postings_read").alias("value"))
    one = percentiles(log, ["method"], "total_ms", {"cost": 0.5}).join(means, "method")
    return checkpoint(one.select(
        "method", F.split("method", " ")[0].alias("family"), number("w=(\\d+)").alias("w"), number("k=(\\d+)").alias("k"), number("r=(\\d+)").alias("reps"),
        F.col("method").contains("center").alias("center"), "n", _r("cost").alias("cost"), _r("value").alias("value"),
    ))


def experiment_table(spark: SparkSession, d: str) -> DataFrame:
    return _settings(spark, d)


def experiment_labels(spark: SparkSession, d: str) -> DataFrame:
    s = _settings(spark, d).where("w is not null")
    label = F.concat(F.format_string("%s w%d k%d", F.col("family"), F.col("w"), F.col("k")), F.when(F.col("reps") > 1, F.format_string(" x%d", F.col("reps"))).otherwise(""), F.when(F.col("center"), " centred").otherwise(""))
    return s.select("method", label.alias("label"))


def pareto_frontier(spark: SparkSession, d: str) -> DataFrame:
    return stats.pareto(_settings(spark, d).where("value is not null").select("method", "cost", "value"), "cost", "value")


def equal_budget_best(spark: SparkSession, d: str) -> DataFrame:
    s = _settings(spark, d).where("value is not null")
    return stats.best_within(s, ["family"], "cost", list(BUDGETS_MS), "value", "method").select("family", "limit", "method", "cost", "value")


def seed_spread(spark: SparkSession, d: str) -> DataFrame:
    s = _settings(spark, d).where("w is not null")
    return _rounded(stats.seed_spread(s, ["family", "w", "k"], "cost"), "mean", "std", digits=9)


def reps_vs_single(spark: SparkSession, d: str) -> DataFrame:
    """Repetitions beside the one wide setting of the same budget."""
    s = _settings(spark, d).where("w is not null and reps is not null")
    a, b = s.alias("a"), s.where("reps = 1").alias("b")
    on = (F.col("a.w") * F.col("a.reps") == F.col("b.w")) & (F.col("a.k") * F.col("a.reps") == F.col("b.k")) & (F.col("a.center") == F.col("b.center")) & (F.col("a.family") == F.col("b.family")) & (F.col("a.reps") > 1)
    return a.join(b, on).select(F.col("a.method").alias("reps_method"), F.col("b.method").alias("single_method"), F.col("a.cost").alias("reps_cost"), F.col("b.cost").alias("single_cost"), _r(stats.relative_change(F.col("a.cost"), F.col("b.cost"))).alias("change"))


def cost_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Each method beside exhaustive MaxSim: speed-up, and queries until a build of 100 s has paid."""
    s = _settings(spark, d).select("method", "cost")
    base = s.where("method = 'maxsim exhaustive'").select(F.col("cost").alias("base"))
    return s.crossJoin(F.broadcast(base)).select("method", _r(F.col("base") / F.col("cost")).alias("speed_up"), _r(stats.break_even(F.lit(100.0), F.col("base") - F.col("cost")), 3).alias("break_even"))  # base has one row


def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.latency_summary(S.read_table(spark, d, "latency_log"), ["method"], "total_ms"), "median", "p95")


# --- mechanism


def pair_levels(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors near each cosine level, at most 1,000 a level in order of ids."""
    return _pair_levels(spark, d, LEVELS, [F.col("query_id"), F.col("doc_id")])


def pair_levels_surveyed(spark: SparkSession, d: str) -> DataFrame:
    """At most 1,000 pairs a level, a sample by a seeded hash of the ids."""
    return _pair_levels(spark, d, SURVEYED_LEVELS, [F.xxhash64(F.lit(SEED), "query_id", "doc_id"), F.col("query_id"), F.col("doc_id")])


def _pair_levels(spark: SparkSession, d: str, levels: tuple[float, ...], order: list[Column]) -> DataFrame:
    pairs = scoring.dense_band(_vectors(spark, d), levels, 0.025).where("query_id < doc_id")
    near = pairs.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]))).where(F.abs(F.round(F.col("score") - F.col("level"), 6)) <= 0.025)
    return rank.first_n(near, 1000, ["level"], order).select("level", F.col("query_id").alias("a"), F.col("doc_id").alias("b"), F.col("score").alias("cosine"))


def _mechanism(spark: SparkSession, d: str) -> DataFrame:
    return _pair_scores(spark, d, pair_levels(spark, d), WIDTH, KEEP)


def _pair_scores(spark: SparkSession, d: str, pairs: DataFrame, width: int, keep: int, reps: int = 1) -> DataFrame:
    hits = encode.anchor_weights(S.query_bags(spark, d), width, keep, reps).select(F.col("pos").alias("id"), "anchor", "p")
    left = pairs.join(hits.select(F.col("id").alias("a"), "anchor", F.col("p").alias("pa")), "a")
    both = left.join(hits.select(F.col("id").alias("b"), "anchor", F.col("p").alias("pb")), ["b", "anchor"])
    sums = both.groupBy("level", "a", "b").agg(F.sum(F.col("pa") * F.col("pb")).alias("s"))
    return pairs.join(sums, ["level", "a", "b"], "left").select("level", "a", "b", "cosine", _r(F.coalesce("s", F.lit(0.0))).alias("score"))


def pair_mechanism(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.dispersion(_mechanism(spark, d), ["level"], "score"), "zero_share", "mean", "cv")


def _variants(spark: SparkSession, d: str) -> list[DataFrame]:
    """Scores of the pairs for each budget, by repetitions and by one matrix as wide as all of them."""
    pairs = checkpoint(pair_levels_surveyed(spark, d))
    shapes = [("repetitions", m, SURVEYED_WIDTH, SURVEYED_KEEP, m) for m in BUDGETS] + [("single matrix", m, SURVEYED_WIDTH * m, SURVEYED_KEEP * m, 1) for m in BUDGETS if m > 1]
    return [_pair_scores(spark, d, pairs, w, k, r).withColumns({"mode": F.lit(mode), "budget": F.lit(m)}) for mode, m, w, k, r in shapes]


def pair_mechanism_surveyed(spark: SparkSession, d: str) -> DataFrame:
    every = reduce(DataFrame.unionByName, _variants(spark, d))
    return _rounded(stats.dispersion(every, ["mode", "budget", "level"], "score"), "zero_share", "mean", "cv")


def rank_correlation_surveyed(spark: SparkSession, d: str) -> DataFrame:
    """One row a mode and budget."""
    found = [stats.spearman(v, "cosine", "score").join(F.broadcast(v.select("mode", "budget").limit(1))) for v in _variants(spark, d)]
    return _rounded(reduce(DataFrame.unionByName, found), "pearson", "spearman").select("mode", "budget", "pearson", "spearman")


def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.spearman(_mechanism(spark, d), "cosine", "score"), "pearson", "spearman")


# --- routing


def _routing_runs(spark: SparkSession, d: str, judged: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The first ten of the fusion, the first 20 of BM25, which is what the rerankers and nDCG@10 read, the first ten of the lexical run, and
    lexical scores of BM25's first ten, all from one scoring: no other pair is written. ``judged``: of the judged queries only."""
    asked, counts = _counts(spark, d)
    if judged:
        asked = rank.judged_only(asked.withColumnRenamed("id", "query_id"), S.qrels(spark, d)).withColumnRenamed("query_id", "id")
    best = checkpoint(scoring.sparse_best(asked, _both_weights(counts), [(1.0, ALPHA, 10), (1.0, 0.0, 20), (0.0, 1.0, 10)]))
    runs = [rank.top_k(best.where(F.col("want") == want).drop("want"), k) for want, k in ((0, 10), (1, 20), (2, 10))]
    hyb, bm25, lists = (checkpoint(r) for r in runs)
    return hyb.drop("second"), bm25.drop("second"), lists.drop("second"), bm25.where("rank <= 10").select("query_id", "doc_id", F.col("second").alias("score"))


def router_features(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d, *_routing_runs(spark, d))


def _features(spark: SparkSession, d: str, hyb: DataFrame, bm25: DataFrame, lists: DataFrame, lex: DataFrame) -> DataFrame:
    rows = router.features(hyb, bm25.where("rank <= 10"), lists)
    length = encode.bm25_queries(_asked(spark, d)).groupBy(F.col("id").alias("query_id")).agg(F.sum("weight").cast("bigint").alias("q_tokens"), F.count(F.lit(1)).alias("q_lex_terms"))
    rows = rows.join(length, "query_id", "left").fillna(0, ["q_tokens", "q_lex_terms"])
    return rows.select(*[_r(c).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in rows.dtypes])


def _stored(spark: SparkSession, d: str) -> DataFrame:
    good = F.col("ce_score").isNotNull() & ~F.isnan("ce_score")
    one = S.latest(S.read_table(spark, d, "pair_scores").withColumn("good", good), ["query_id", "doc_id"], "scored_at", F.col("good").desc(), F.col("ce_score").desc())
    return one.where("good").select("query_id", "doc_id", F.col("ce_score").alias("score"), "n_tokens")


def rerank_stored(spark: SparkSession, d: str) -> DataFrame:
    """The BM25 run with its first 20 in order of stored scores."""
    return rank.rerank(_bm25_run(spark, d), _stored(spark, d), 20).select("query_id", "doc_id", "rank")


def router_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d, *_routing_runs(spark, d))


def _labels(spark: SparkSession, d: str, hyb: DataFrame, bm25: DataFrame, lists: DataFrame, lex: DataFrame) -> DataFrame:
    judged, stored = S.qrels(spark, d), _stored(spark, d)
    per = [metrics.evaluate(r, judged, (10,)) for r in (bm25, rank.rerank(bm25, lex, 10), rank.rerank(bm25, stored, 20))]
    return _rounded(router.labels(*per), "ndcg_first", "ndcg_base", "ndcg_escalate", "gain").withColumn("y", F.col("y").cast("bigint"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    scores = _routing_runs(spark, d, judged=True)
    margin = _features(spark, d, *scores).select("query_id", (-F.col("hyb_margin12")).alias("score"))
    return checkpoint(_labels(spark, d, *scores).join(margin, "query_id").select("query_id", "score", "gain", F.col("ndcg_base").alias("base"), "y"))


def escalation_curve(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(router.escalation_curve(_scored(spark, d)), "frac", "value")


def router_gain_kept(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(router.gain_kept(_scored(spark, d)), "area", "oracle_area", "random_area", "gain_kept")


def router_budgets(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(router.at_budgets(router.escalation_curve(_scored(spark, d))), "value")


def router_auc(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(router.roc_auc(_scored(spark, d)), "auc")


def _probabilities(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("query_id", (1 / (1 + F.exp(-F.col("score")))).alias("p"), "y")


def router_ece(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(router.expected_calibration_error(_probabilities(spark, d)), "ece")


def router_reliability(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(router.reliability(_probabilities(spark, d), least=2), "confidence", "accuracy")


# The names of the features. The queries of the tables are texts without vectors, so that BM25 is the dense run's stand-in.
FEATURES = ["hyb_top1", "hyb_margin12", "hyb_gap1_10", "hyb_std10", "dense_top1", "dense_margin12", "dense_gap1_10", "lex_top1", "lex_margin12", "lex_gap1_10", "dense_lex_jaccard10", "dense_top1_in_lex10", "lex_top1_in_dense10", "hyb_top1_is_dense_top1", "q_tokens", "q_lex_terms"]


def _routing_rows(spark: SparkSession, d: str) -> DataFrame:
    scores = _routing_runs(spark, d, judged=True)
    rows = _features(spark, d, *scores).join(_labels(spark, d, *scores), "query_id").join(S.queries(spark, d).select("query_id", "dataset", "split"), "query_id")
    return checkpoint(rows)


def router_logistic_oof(spark: SparkSession, d: str) -> DataFrame:
    rows = _routing_rows(spark, d).withColumn("stratum", F.concat_ws("_", "dataset", F.col("y").cast("string")))
    return router.out_of_fold(router.folds(rows, "stratum", "query_id", 3), FEATURES, "y").select("query_id", "fold", "y", "p")


# --- lists, caches, texts, costs


def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    return rank.candidate_union(list(_two_runs(spark, d, 20)), 20)


def cache_todo(spark: SparkSession, d: str) -> DataFrame:
    return rank.missing(candidate_union(spark, d), S.read_table(spark, d, "pair_scores"), ["query_id", "doc_id"])


def overlap_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The BM25 run's first 20 by the stand-in scorer; no others are looked for."""
    run = checkpoint(_bm25_run(spark, d, 20))
    docs = S.documents(spark, d).select("doc_id", scorers.term_set(F.col("text")).alias("doc_terms"))
    asked = S.queries(spark, d).select("query_id", scorers.term_set(F.col("text")).alias("query_terms"))
    return rank.rerank(run, scorers.overlap_of_terms(run.join(docs, "doc_id").join(asked, "query_id")), 20, keep_tail=False).select("query_id", "doc_id", "score", "rank")


def shorten_text(spark: SparkSession, d: str) -> DataFrame:
    return S.documents(spark, d).select("doc_id", T.shorten(F.col("text"), 120).alias("short"))


def request_key(spark: SparkSession, d: str) -> DataFrame:
    return S.queries(spark, d).select("query_id", scorers.request_key(F.col("query_id"), F.col("dataset")).alias("key"))


def join_titles(spark: SparkSession, d: str) -> DataFrame:
    docs = S.latest(S.read_table(spark, d, "docs").where("doc_texts is not null"), ["doc_id"], "loaded_at", F.col("doc_texts"))
    return docs.select("doc_id", F.sha2(T.join_title(F.col("title"), F.lit("body")), 256).alias("joined"))


def trec_export(spark: SparkSession, d: str) -> DataFrame:
    return S.trec_lines(_bm25_run(spark, d, 10), "bm25")


def cost_model(spark: SparkSession, d: str) -> DataFrame:
    s = _stored(spark, d).where("n_tokens is not null")
    one = s.groupBy("query_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum("n_tokens").alias("tokens"), F.sum(scorers.cross_encoder_flops(F.col("n_tokens"))).alias("flops"))
    return one.select("query_id", "pairs", "tokens", _r(F.col("flops") / 1e12).alias("tflops"), _r(scorers.api_price(F.col("tokens")), 9).alias("price"))


def storage_bytes(spark: SparkSession, d: str) -> DataFrame:
    return scorers.storage_bytes(_texts(spark, d))


def judged_queries(spark: SparkSession, d: str) -> DataFrame:
    return rank.judged_only(S.queries(spark, d), S.qrels(spark, d)).select("query_id", "dataset", "split")


def corpus_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Places of every document's tokens in one flat array: running offsets, then ranges written out."""
    lengths = S.token_bags(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("len"))
    return scoring.expand_ranges(scoring.running_offsets(lengths))


_ALL = (
    dense_topk, dense_topk_self_excluded, maxsim_exhaustive, maxsim_topk, maxsim_rerank_tail, maxsim_rerank_truncate, token_mean, centered_tokens,
    smve_encode_docs, smve_encode_queries, smve_topk, smve_reps, smve_centered, muvera_codes, muvera_fde_docs, muvera_fde_queries, muvera_topk,
    bm25_terms, bm25_index, bm25_from_segments, bm25_topk, bm25_nostop, bm25_stemmed, lexical_topk, postings_read, index_size, nnz_stats, hybrid_topk, hybrid_three_way, alpha_sensitivity,
    eval_per_query, eval_mean, eval_wide, metrics_at_k, first_relevant, first_relevant_profile, score_separation, ndcg_histogram, dataset_means,
    run_fidelity, paired_delta, paired_summary, paired_bootstrap, wilcoxon, wilcoxon_p, experiment_table, experiment_labels, pareto_frontier, equal_budget_best, seed_spread,
    reps_vs_single, cost_comparison, latency_summary, pair_levels, pair_mechanism, rank_correlation,
    metrics_at_k_surveyed, paired_bootstrap_surveyed, pair_levels_surveyed, pair_mechanism_surveyed, rank_correlation_surveyed,
    router_features, rerank_stored, router_labels, escalation_curve, router_gain_kept, router_budgets, router_auc, router_ece, router_reliability, router_logistic_oof,
    candidate_union, cache_todo, overlap_rerank, shorten_text, request_key, join_titles, trec_export, cost_model, storage_bytes, judged_queries, corpus_ranges,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}

"""Queries over saved runs, costs, levels and routers; the settings are those of ``queries``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyvec.operators import encode, metrics, rank, router, scorers, scoring, stats
from polyvec.operators.ordered import if_few, percentiles
from polyvec.plans import queries as Q
from polyvec.plans import reports
from polyvec.plans.shared import checkpoint, scratch
from polyvec.sources import tables as S

DEPTHS = (5, 10, 20, 50)
LATENCIES = ("encode_ms", "score_ms", "topk_ms", "total_ms")
GENERATED = 200  # pairs of each level


def _saved(spark: SparkSession, d: str) -> str:
    """A folder with the BM25 and the lexical run."""
    folder, judged = scratch(spark, "runs"), S.qrels(spark, d)
    docs = S.documents(spark, d).count()
    for name, run in zip(("bm25", "lexical"), map(checkpoint, Q._two_runs(spark, d))):  # written by several outputs
        reports.evaluate_and_save(run, judged, folder, name, docs, {"k1": 1.2, "b": 0.75}, {"online_seconds": 1.0}, {"description": "postings"})
    return folder


def saved_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The means of the summaries, read back: ``(run, n_queries, n_docs, metric, k, value)``."""
    rows = reports.read_summaries(spark, _saved(spark, d)).select("run", "n_queries", "n_docs", F.explode("metrics").alias("name", "value"))
    name = F.split("name", "@")
    return rows.select("run", "n_queries", "n_docs", name[0].alias("metric"), name[1].cast("bigint").alias("k"), "value")


def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The lexical run beside BM25, from the files of a folder of runs."""
    return reports.compare_runs(reports.read_per_query(spark, _saved(spark, d)), "bm25")


def run_folder(spark: SparkSession, d: str) -> DataFrame:
    """How many lines each saved run has."""
    return reports.read_runs(spark, _saved(spark, d)).groupBy("run").agg(F.count(F.lit(1)).alias("lines"), F.max("rank").cast("bigint").alias("deepest"))


def rerank_depths(spark: SparkSession, d: str) -> DataFrame:
    """Per depth: nDCG@10 of the BM25 run reranked by stored scores, pairs scored, operations and price."""
    run, stored, judged = checkpoint(Q._bm25_run(spark, d)), checkpoint(Q._stored(spark, d)), S.qrels(spark, d)
    scored = run.join(stored.drop("score"), ["query_id", "doc_id"])
    parts = []
    for depth in DEPTHS:
        mean = metrics.evaluate(rank.rerank(run, stored, depth), judged, (10,)).agg(Q._r(F.avg("ndcg")).alias("ndcg"))
        cost = scored.where(F.col("rank") <= depth).agg(
            F.count(F.lit(1)).alias("pairs"), Q._r(F.coalesce(F.sum(scorers.cross_encoder_flops(F.col("n_tokens"))), F.lit(0.0)) / 1e12).alias("tflops"), Q._r(scorers.api_price(F.coalesce(F.sum("n_tokens"), F.lit(0))), 9).alias("price")
        )
        parts.append(mean.join(F.broadcast(cost)).select(F.lit(depth).cast("bigint").alias("depth"), "ndcg", "pairs", "tflops", "price"))  # single rows
    return reduce(DataFrame.unionByName, parts)


def first_stage_costs(spark: SparkSession, d: str) -> DataFrame:
    """Per query bag: millions of operations of a dense scan, of the anchor-sparse encoding and scan, and of MaxSim over all documents."""
    q, t = S.query_bags(spark, d), S.token_bags(spark, d)
    docs = t.agg(F.countDistinct("id").alias("docs"), F.count(F.lit(1)).alias("doc_tokens"))
    nnz = encode.smve_encode(t, Q.WIDTH, Q.KEEP).agg(F.count(F.lit(1)).alias("nnz"))
    tokens = q.groupBy(F.col("id").alias("query_id")).agg(F.count(F.lit(1)).alias("q_tokens"))
    terms = encode.smve_encode(q, Q.WIDTH, Q.KEEP, role="query").groupBy(F.col("id").alias("query_id")).agg(F.count(F.lit(1)).alias("q_nnz"))
    rows = tokens.join(terms, "query_id").join(F.broadcast(docs)).join(F.broadcast(nnz))  # single rows
    mega = lambda c: Q._r(c / 1e6)
    return rows.select(
        "query_id", mega(scorers.dense_flops(64, F.col("docs"))).alias("dense"), mega(scorers.sparse_flops(F.col("q_tokens"), 64, Q.WIDTH, F.col("q_nnz"), F.col("nnz") / F.col("docs"), F.col("docs"))).alias("sparse"),
        mega(scorers.maxsim_flops(F.col("q_tokens"), F.col("doc_tokens"), 64)).alias("maxsim"),
    )


def cross_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Mean nDCG@10 of four methods per dataset, their places, and what BM25 lacks to each."""
    (asked, counts), judged = Q._counts(spark, d), S.qrels(spark, d)
    run = checkpoint(Q._bm25_of(asked, counts, Q.DEPTH))
    weights = counts.where("term is not null").select("id", "term", F.ln(F.col("tf") + 1.0).alias("weight"))
    lexical = scoring.sparse_relational(asked, weights, run.where("rank <= 10"))
    runs = {"bm25": run, "lexical": Q._lex_of(asked, counts, Q.DEPTH), "bm25 > lexical@10": rank.rerank(run, lexical, 10), "bm25 > stored@20": rank.rerank(run, Q._stored(spark, d), 20)}
    of = S.queries(spark, d).select("query_id", "dataset")
    parts = [metrics.named(metrics.evaluate(r, judged, (10,)), "ndcg@10").withColumn("method", F.lit(name)) for name, r in runs.items()]
    means = reduce(DataFrame.unionByName, parts).join(of, "query_id").groupBy("dataset", "method").agg(Q._r(F.avg("value")).alias("value"))
    return Q._rounded(reports.headroom(means, "bm25"), "headroom")


def fixed_settings(spark: SparkSession, d: str) -> DataFrame:
    """Per family one fixed setting, the first by name, with its cost and value."""
    s = Q._settings(spark, d)
    fixed = s.groupBy("family").agg(F.min("method").alias("method"))
    return s.join(if_few(fixed), ["family", "method"]).select("family", "method", "cost", "value")


def sweep_axes(spark: SparkSession, d: str) -> DataFrame:
    """Per family the widths and depths that occur, sorted."""
    text = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return Q._settings(spark, d).where("w is not null").groupBy("family").agg(text("w").alias("w"), text("k").alias("k"))


def sweep_heat_map(spark: SparkSession, d: str) -> DataFrame:
    """Mean cost of each cell of width and depth, and how much dearer centring is there."""
    s = Q._settings(spark, d).where("w is not null and k is not null")
    cell = s.groupBy("family", "w", "k").agg(F.avg("cost").alias("cost"), F.avg(F.when(F.col("center"), F.col("cost"))).alias("c"), F.avg(F.when(~F.col("center"), F.col("cost"))).alias("p"))
    return cell.select("family", "w", "k", Q._r("cost", 9).alias("cost"), Q._r(F.col("c") - F.col("p"), 9).alias("centring"))


def nearest_levels(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of vectors by the nearest cosine level."""
    v = Q._vectors(spark, d)
    pairs = scoring.dense_scores(v, v).where("query_id < doc_id")
    return pairs.groupBy(stats.nearest_level(F.col("score"), list(Q.LEVELS)).alias("level")).agg(F.count(F.lit(1)).alias("pairs"), Q._r(F.avg("score")).alias("mean"))


def mechanism_generated(spark: SparkSession, d: str) -> DataFrame:
    """The mechanism study over generated pairs of exact cosine 0.2 to 0.9, at all budgets and both modes."""
    made = stats.correlated_pairs(spark, list(Q.SURVEYED_LEVELS), GENERATED, 64)
    ends = made.select((F.col("pair") * 2).alias("pos"), F.col("x").alias("vec")).unionByName(made.select((F.col("pair") * 2 + 1).alias("pos"), F.col("y").alias("vec"))).withColumn("id", F.col("pos"))
    shapes = [("repetitions", m, Q.SURVEYED_WIDTH, Q.SURVEYED_KEEP, m) for m in Q.BUDGETS] + [("single matrix", m, Q.SURVEYED_WIDTH * m, Q.SURVEYED_KEEP * m, 1) for m in Q.BUDGETS if m > 1]
    parts = []
    for mode, m, w, k, r in shapes:
        hits = encode.anchor_weights(ends, w, k, r).select(F.floor(F.col("pos") / 2).alias("pair"), (F.col("pos") % 2).alias("end"), "anchor", "p")
        both = hits.groupBy("pair", "anchor").agg(F.max(F.when(F.col("end") == 0, F.col("p"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("p"))).alias("b"))
        sums = both.groupBy("pair").agg(Q._r(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0))).alias("score"))
        parts.append(made.select("pair", "level").join(sums, "pair").withColumns({"mode": F.lit(mode), "budget": F.lit(m)}))
    return Q._rounded(stats.dispersion(reduce(DataFrame.unionByName, parts), ["mode", "budget", "level"], "score"), "zero_share", "mean", "cv")


def latency_split(spark: SparkSession, d: str) -> DataFrame:
    """Per method the medians of the parts of its time, each over its own valid values."""
    log = S.read_table(spark, d, "latency_log").where("method is not null")
    parts = [percentiles(log, ["method"], c, {"median": 0.5}).select("method", F.lit(c).alias("part"), "n", Q._r("median").alias("median")) for c in LATENCIES]
    return reduce(DataFrame.unionByName, parts)


def escalation_latency(spark: SparkSession, d: str) -> DataFrame:
    """Mean milliseconds when a share of the queries goes on to exhaustive MaxSim, the decision taken beside the base or after it."""
    s = Q._settings(spark, d)
    cost = lambda m: F.max(F.when(F.col("method") == m, F.col("cost")))
    one = s.agg(cost("hybrid > maxsim@10").alias("base"), cost("maxsim exhaustive").alias("extra"), cost("bm25 index").alias("decision"))
    rows = one.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in (0.1, 0.2, 0.3)]))).withColumn("parallel", F.explode(F.array(F.lit(True), F.lit(False))))
    charge = F.when(F.col("parallel"), router.decision_charge(F.col("decision"), F.col("base"), True)).otherwise(router.decision_charge(F.col("decision"), F.col("base"), False))
    return rows.select("budget", "parallel", Q._r(router.latency_at(F.col("base"), F.col("extra"), F.col("budget"), charge)).alias("ms"))


def router_heuristics(spark: SparkSession, d: str) -> DataFrame:
    """AUC of rules that need no training: small margin, lists that differ, small gap, weak first score."""
    scores = Q._routing_runs(spark, d)
    rows = checkpoint(Q._features(spark, d, *scores).join(Q._labels(spark, d, *scores).select("query_id", "y"), "query_id"))
    rules = {"margin": -F.col("hyb_margin12"), "jaccard": -F.col("dense_lex_jaccard10"), "gap": -F.col("hyb_gap1_10"), "top1": -F.col("hyb_top1")}
    parts = [router.roc_auc(rows.select("query_id", c.alias("score"), "y")).select(F.lit(name).alias("rule"), Q._r("auc").alias("auc")) for name, c in rules.items()]
    return reduce(DataFrame.unionByName, parts)


def router_auc_interval(spark: SparkSession, d: str) -> DataFrame:
    return Q._rounded(router.auc_interval(Q._scored(spark, d)), "low", "high")


def router_paired_auc(spark: SparkSession, d: str) -> DataFrame:
    """The logistic router, out of fold, beside the margin rule."""
    rows = checkpoint(_folded(spark, d))
    both = router.out_of_fold(rows, Q.FEATURES, "y").select("query_id", "y", "p", (-F.col("hyb_margin12")).alias("margin"))
    return Q._rounded(router.paired_auc(checkpoint(both), "p", "margin"), "delta", "low", "high", "p")


def _folded(spark: SparkSession, d: str, n: int = 5) -> DataFrame:
    rows = Q._routing_rows(spark, d).withColumn("stratum", F.concat_ws("_", "dataset", F.col("y").cast("string")))
    return router.folds(rows, "stratum", "query_id", n)


def router_boosted_oof(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees, out of fold."""
    return router.out_of_fold(checkpoint(_folded(spark, d, 3)), Q.FEATURES, "y", "trees").select("query_id", "fold", "y", "p")


def router_stacked_oof(spark: SparkSession, d: str) -> DataFrame:
    """The features with the logistic router's out-of-fold answer as one more."""
    first = router.out_of_fold(checkpoint(_folded(spark, d, 3)), Q.FEATURES, "y").withColumnRenamed("p", "answer")
    return router.stacked(checkpoint(first), Q.FEATURES, ["answer"], "y").select("query_id", "fold", "y", "p")


def router_transfer(spark: SparkSession, d: str) -> DataFrame:
    """A router fitted on the dataset with the most judged queries, over the others."""
    rows = Q._routing_rows(spark, d)
    origin = rows.groupBy("dataset").count().orderBy(F.col("count").desc(), "dataset").first()
    return router.transfer(rows, Q.FEATURES, "y", "dataset", origin[0] if origin else "").select("query_id", "dataset", "y", "p")


def router_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """The logistic router's standardised coefficients, largest first."""
    found = router.coefficients(router.fit_model(Q._routing_rows(spark, d), Q.FEATURES, "y"), Q.FEATURES)
    return spark.createDataFrame([(n, float(round(v, 6)), i + 1) for i, (n, v) in enumerate(found)], "feature string, coefficient double, place int")


def decision_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a stand-in to every query, asked through the cache, twice; the second time nothing is asked."""
    asked = S.queries(spark, d).select("query_id", scorers.request_key(F.col("query_id"), F.col("text")).alias("key"), F.col("text").alias("prompt"))
    cache = scratch(spark, "cache")
    for answer in (lambda prompts: [round(len(p) % 100 / 100, 2) for p in prompts], lambda prompts: [-1.0] * len(prompts)):
        got = scorers.ask_missing(asked, cache, answer)
    return asked.join(got, "key").select("query_id", "key", "value")


def yes_no_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The BM25 run's first 20, those with at least half of the query's terms first, else in their order."""
    run = checkpoint(Q._bm25_run(spark, d, 20))
    pairs = run.join(S.documents(spark, d).select("doc_id", F.col("text").alias("doc_text")), "doc_id").join(S.queries(spark, d).select("query_id", F.col("text").alias("query_text")), "query_id")
    yes = scorers.yes_no_scores(scorers.overlap_scorer(pairs)).join(run.select("query_id", "doc_id", F.col("rank").alias("first_rank")), ["query_id", "doc_id"])
    return scorers.stable_rerank(yes).select("query_id", "doc_id", "rank")


def routing_questions(spark: SparkSession, d: str) -> DataFrame:
    """The question for each query, as its hash: the query and the titles of its first three results."""
    docs = S.latest(S.read_table(spark, d, "docs").where("doc_texts is not null"), ["doc_id"], "loaded_at", F.col("doc_texts")).select("doc_id", "title")
    top = Q._bm25_run(spark, d, 3).join(docs, "doc_id").groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.coalesce("title", F.lit("")).alias("title")))), lambda e: e["title"]).alias("titles"))
    return S.queries(spark, d).join(top, "query_id", "left").select("query_id", F.sha2(scorers.routing_question(F.col("text"), F.col("titles")), 256).alias("question"))


def ndcg_explicit(spark: SparkSession, d: str) -> DataFrame:
    """nDCG@10 per query of the gains in ranked order beside the ideal list."""
    judged = S.qrels(spark, d)
    top = Q._bm25_run(spark, d, 10).join(judged, ["query_id", "doc_id"], "left")
    gains = top.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.coalesce("rel", F.lit(0)).alias("rel")))), lambda e: e["rel"]).alias("gains"))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rel").desc(), "doc_id"))
    ideal = judged.withColumn("n", first).where("n <= 10").groupBy("query_id").agg(F.sort_array(F.collect_list("rel"), asc=False).alias("ideal"))
    return ideal.join(gains, "query_id", "left").select("query_id", Q._r(F.coalesce(metrics.ndcg_of_gains(F.col("gains"), F.col("ideal")), F.lit(0.0))).alias("ndcg"))


def score_per_token(spark: SparkSession, d: str) -> DataFrame:
    """The BM25 run's first ten with scores by query token, for display."""
    length = encode.bm25_queries(Q._asked(spark, d)).groupBy(F.col("id").alias("query_id")).agg(F.sum("weight").alias("q_tokens"))
    return Q._bm25_run(spark, d, 10).join(length, "query_id").select("query_id", "doc_id", Q._r(F.col("score") / F.col("q_tokens"), 9).alias("score"))


def bag_subset(spark: SparkSession, d: str) -> DataFrame:
    """The bags of the judged documents, in order of their ids backwards, as one array."""
    bags = S.token_bags(spark, d)
    wanted = S.qrels(spark, d).select(F.col("doc_id").alias("id")).distinct()
    order = scoring.running(wanted, [F.col("id").desc()]).select("id", F.col("place").alias("ord"))
    return rank.ordered_subset(bags, order).select("id", F.col("pos").alias("token_id"), "row")


def item_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The sparse weights of one document, that with the least id."""
    w = S.sparse_weights(spark, d)
    key = w.agg(F.min("id")).first()[0]
    return S.sparse_map(w, key or "").select(F.col("term").cast("bigint").alias("term"), Q._r("weight").alias("weight"))


def bag_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The token vectors of one document, that with the least id, in order."""
    bags = S.token_bags(spark, d)
    rows = S.token_bag(bags, bags.agg(F.min("id")).first()[0] or "")
    return rows.select("id", F.posexplode("vecs").alias("place", "vec")).select("id", F.col("place").cast("bigint").alias("place"), Q._r(F.element_at("vec", 1)).alias("first"))


def topk_of_list(spark: SparkSession, d: str) -> DataFrame:
    """The ten highest stored scores of all."""
    return rank.top_vector(Q._stored(spark, d).select("query_id", "doc_id", "score"), 10)


def one_to_one(spark: SparkSession, d: str) -> DataFrame:
    """Queries with their number of judgments, keys checked on both sides."""
    counts = S.qrels(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("judged"))
    return S.merge_one_to_one(S.queries(spark, d).select("query_id", "dataset"), counts, ["query_id"])


ALL = (
    saved_summaries, run_comparison, run_folder, rerank_depths, first_stage_costs, cross_dataset, fixed_settings, sweep_axes, sweep_heat_map, nearest_levels, mechanism_generated, latency_split, escalation_latency,
    router_heuristics, router_auc_interval, router_paired_auc, router_boosted_oof, router_stacked_oof, router_transfer, router_coefficients, decision_answers, yes_no_rerank, routing_questions,
    ndcg_explicit, score_per_token, bag_subset, item_lookup, bag_lookup, topk_of_list, one_to_one,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL}

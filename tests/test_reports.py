"""Running values, percentiles, cells, saved runs, the decision client, intervals: brute force and hand-made cases."""

import itertools
import math
import random
import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polyvec.functions.vectors import normalise
from polyvec.operators import encode, metrics, rank, router, scorers, scoring, stats
from polyvec.operators.ordered import percentiles, running
from polyvec.plans import objects, queries, report_queries, reports
from polyvec.sources import tables as S
from polyvec.streaming import segments

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("partitions", [None, 1, 9])
def test_running_values(spark, partitions):
    rng = random.Random(1)
    rows = [(i, rng.randint(-5, 5), rng.random()) for i in range(500)]
    got = {r["i"]: r for r in running(spark.createDataFrame(rows, "i int, a bigint, b double").repartition(5), [F.col("i").desc()], ["a"], ["b"], partitions).collect()}
    total, most = 0, None
    for place, (i, a, b) in enumerate(sorted(rows, reverse=True), 1):
        total += a
        assert (got[i]["place"], got[i]["a_upto"], got[i]["b_before"]) == (place, total, most)
        most = b if most is None else max(most, b)
    assert running(spark.createDataFrame([], "i int"), [F.col("i")]).count() == 0


def test_percentiles_are_exact(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 9 + ["a", "b", None]), float(rng.choice([1, 2, 3, rng.random(), -7.5]))) for _ in range(3000)] + [("a", None), ("a", math.nan), ("one", 4.0), ("none", None)]
    got = {r["g"]: r for r in percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"low": 0.0, "mid": 0.5, "p95": 0.95, "top": 1.0}).collect()}
    assert set(got) == {"hot", "a", "b", None, "one"}
    for g, r in got.items():
        v = [x for h, x in rows if h == g and x is not None and x == x]
        assert r["n"] == len(v) and [r["low"], r["mid"], r["p95"], r["top"]] == pytest.approx(np.percentile(v, [0, 50, 95, 100]).tolist())


def vectors(spark, n, seed, name):
    rng = np.random.default_rng(seed)
    rows = [(f"{name}{i}", rng.normal(size=8).tolist()) for i in range(n)]
    words = [(f"{name}{i}", "hot" if j == 0 else f"t{rng.integers(30)}", float(rng.integers(1, 5))) for i in range(n) for j in range(rng.integers(0, 6))]
    return spark.createDataFrame(rows, "id string, vec array<double>"), spark.createDataFrame(words, "id string, term string, weight double").groupBy("id", "term").agg(F.sum("weight").alias("weight"))


def ranked(scores, k):
    return sorted(map(tuple, rank.top_k(scores, k).collect()))


@pytest.mark.parametrize("blocks", [1, 4])
def test_cells_and_kernels_are_the_plain_joins(spark, monkeypatch, blocks):
    if blocks > 1:
        monkeypatch.setattr(scoring, "BLOCK_FLOATS", 60)
        monkeypatch.setattr(scoring, "_blocks", lambda df, dim, floats=0: [df] * blocks)
    (q, qt), (d, dt) = vectors(spark, 20, 1, "q"), vectors(spark, 70, 2, "d")
    plain = scoring.sparse_scores(qt, dt)
    assert ranked(scoring.sparse_topk(qt, dt, 5), 5) == ranked(plain, 5)
    assert ranked(scoring.sparse_topk(dt, dt, 5, exclude_self=True), 5) == ranked(scoring.sparse_scores(dt, dt, exclude_self=True), 5)
    dense = scoring.dense_scores(q, d, dim=8)
    assert dense.count() == 1400 and ranked(scoring.dense_scores(q, d, 5, dim=8), 5) == ranked(dense, 5)
    assert ranked(scoring.hybrid_topk(q, d, qt, dt, 5, 0.3, dim=8), 5) == ranked(scoring.hybrid(dense, plain, 0.3), 5)
    pairs = rank.top_k(dense, 3)
    assert sorted(map(tuple, scoring.dense_relational(q, d, pairs).collect())) == sorted((r[0], r[1], r[2]) for r in pairs.collect())
    assert sorted(map(tuple, scoring.sparse_relational(qt, dt, pairs).collect())) == sorted(map(tuple, plain.join(pairs.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").collect()))
    near = {(r["query_id"], r["doc_id"]) for r in scoring.dense_band(d, (1.0,), 0.5, 8).collect()}
    assert near == {(r["query_id"], r["doc_id"]) for r in scoring.dense_scores(d, d, exclude_self=True, dim=8).where("abs(score - 1) <= 0.500001").collect()}
    for part in (scoring.sparse_topk(qt.limit(0), dt, 5), scoring.sparse_topk(qt, dt.limit(0), 5), scoring.hybrid_topk(q, d.limit(0), qt, dt, 5, dim=8)):
        assert part.count() == 0


@pytest.mark.parametrize("held, block", [(6_000_000, 4_000_000), (20, 4_000_000), (20, 60)])
def test_several_fusions_from_one_scoring(spark, monkeypatch, held, block):
    """In chunks and cells, with many ties, weights of 0 and below, and documents that share only a term without weight."""
    (_, qt), (_, dt) = vectors(spark, 20, 1, "q"), vectors(spark, 300, 2, "d")
    monkeypatch.setattr(scoring, "HELD", held)
    monkeypatch.setattr(scoring, "BLOCK_FLOATS", block)
    for shift in (0.0, 2.0):
        both = dt.select("id", "term", (F.col("weight") - shift).alias("weight"), F.ln("weight").alias("weight2"))
        one, two = scoring.sparse_scores(qt, both.drop("weight2")), scoring.sparse_scores(qt, both.select("id", "term", F.col("weight2").alias("weight")))
        found = scoring.sparse_best(qt, both, [(1.0, 0.0, 7), (1.0, 0.3, 5), (0.0, 1.0, 5), (1.0, 2.0, 70)])
        assert ranked(found.where("want = 0").select("query_id", "doc_id", "score"), 7) == ranked(one, 7)
        for want, alpha, k in ((1, 0.3, 5), (3, 2.0, 70)):
            assert ranked(found.where(F.col("want") == want).select("query_id", "doc_id", "score"), k) == ranked(scoring.hybrid(one, two, alpha), k)
        assert ranked(found.where("want = 2").select("query_id", "doc_id", "score"), 5) == ranked(two, 5)
        assert found.where("want = 0").join(two.withColumnRenamed("score", "other"), ["query_id", "doc_id"], "left").where("second is distinct from other").count() == 0


def test_postings_in_chunks(monkeypatch):
    monkeypatch.setattr(scoring, "HELD", 5)
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, _, v in items(rng, 60, 0, False) if v]
    table = lambda part: pa.RecordBatch.from_arrays([pa.array([i for i, _ in part]), pa.array([list(map(str, v)) for _, v in part]), pa.array([list(v.values()) for _, v in part])], names=["id", "terms", "weights"])
    got: dict[str, list] = {}
    for batch in scoring._ranked(scoring._Asked(table(rows)), (table(rows[i : i + 2]) for i in range(0, len(rows), 2)), ["weights"], [(1.0, 0.0, 4)], 6, True, pa.string()):
        for r in batch.to_pylist():
            got.setdefault(r["query_id"], []).append((-r["score"], r["doc_id"]))
    for q, t in rows:
        assert sorted(got.get(q, []))[:4] == sorted((-sum(w * v.get(x, 0.0) for x, w in t.items()), d) for d, v in rows if d != q and t.keys() & v.keys())[:4]


def test_alphas_write_no_row_per_matching_pair(spark, monkeypatch):
    monkeypatch.setattr(scoring, "sparse_scores", None)
    assert queries.alpha_sensitivity(spark, FOLDER).count() == len(queries.ALPHAS)


def test_overlap_rerank_looks_for_no_more_than_it_reranks(spark, monkeypatch):
    whole, depths, run = sorted(map(tuple, rank.rerank(queries._bm25_run(spark, FOLDER), queries.overlap_rerank(spark, FOLDER), 20, keep_tail=False).collect())), [], queries._bm25_of
    monkeypatch.setattr(queries, "_bm25_of", lambda asked, counts, k: depths.append(k) or run(asked, counts, k))
    assert sorted(map(tuple, queries.overlap_rerank(spark, FOLDER).collect())) == whole and depths == [20]


def items(rng, n, dim, signed):
    """Vectors and terms of ``n`` items with many equal scores, as ``(id, vector, {term: weight})``."""
    low = -2 if signed else 1
    return [(f"i{i:03}", rng.integers(-2, 3, dim).astype(float), {int(t): float(rng.integers(low, 3)) for t in np.unique(rng.integers(0, 40, rng.integers(0, 6)) ** 2 // 40)}) for i in range(n)]


@pytest.mark.parametrize("dim, signed, columns", [(0, False, 3), (0, True, 0), (4, False, 0), (4, True, 40)])
def test_tiles_are_brute_force(monkeypatch, dim, signed, columns):
    monkeypatch.setattr(scoring, "ROWS", 16)
    monkeypatch.setattr(scoring, "COLS", 64)
    rng = np.random.default_rng(dim + signed)
    rows = items(rng, 150, dim, signed)
    part = [rows[i] for i in rng.permutation(150)]
    flat, ids = np.concatenate([r[1] for r in part]) if dim else np.empty(0), pa.array([r[0] for r in part])
    codes, weights = (np.array([x for r in part for x in pick(r[2])]) for pick in (dict.keys, dict.values))
    column = np.where(np.arange(40) < columns, np.arange(40), -1)
    sides = [scoring._Items([(ids, flat, np.array([len(r[2]) for r in part]))], pa.string(), dim) for _ in range(2)]
    for side in sides:
        side.code(codes, weights, column)
    got = sorted(tuple(r.values())[:3] for b in scoring._tiled(*sides, 40, 5, 0.3, True, 6) for r in b.to_pylist())
    want = []
    for q, v, t in rows:
        scores = []
        for d, u, s in rows:
            shared, lex = t.keys() & s.keys(), sum(w * s.get(x, 0.0) for x, w in t.items())
            if d != q and (dim or shared):
                scores.append((-round(v @ u + 0.3 * lex, 9) if dim else -lex, d))
        want += [(q, d, -x) for x, d in sorted(scores)[:5]]
    assert [r[:2] for r in got] == [r[:2] for r in sorted(want)] and [r[2] for r in got] == pytest.approx([r[2] for r in sorted(want)])


@pytest.mark.parametrize("cell", [24_000_000, 1000])
def test_lexical_tiles_are_the_plain_join(spark, monkeypatch, cell):
    monkeypatch.setattr(scoring, "CELL", cell)
    _, dt = vectors(spark, 70, 2, "d")
    low = dt.withColumn("weight", F.col("weight") - 2)
    for t in (dt, low):
        assert ranked(scoring.lexical_topk(t, t, 5, exclude_self=True), 5) == ranked(scoring.sparse_scores(t, t, exclude_self=True), 5)
    assert scoring.lexical_topk(dt.limit(0), dt, 5).count() == scoring.lexical_topk(dt, dt.limit(0), 5).count() == 0


@pytest.mark.parametrize("cell", [24_000_000, 40])
def test_maxsim_of_pairs_is_the_plain_join(spark, monkeypatch, cell):
    monkeypatch.setattr(scoring, "CELL", cell)
    rng = np.random.default_rng(5)
    rows = [(f"d{i}", j, rng.normal(size=8).tolist()) for i in range(30) for j in range(rng.integers(0, 5))]
    stored = spark.createDataFrame(rows, "id string, pos bigint, vec array<float>")
    whole = stored.withColumn("vec", normalise(F.col("vec")))
    pairs = spark.createDataFrame([(f"d{rng.integers(32)}", f"d{i}") for i in range(32) for _ in range(3)], "query_id string, doc_id string").distinct()
    got, want = (sorted(map(tuple, t.collect())) for t in (scoring.maxsim_of_pairs(stored, stored, pairs, unit=True, dim=8), scoring.maxsim_relational(whole, whole, pairs)))
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-6)
    assert scoring.maxsim_of_pairs(stored, stored, pairs.limit(0), dim=8).count() == 0


def test_three_way_scores_no_pair_by_joins(spark, monkeypatch):
    for name in ("dense_relational", "sparse_relational", "maxsim_relational"):
        monkeypatch.setattr(scoring, name, None)
    assert queries.hybrid_three_way(spark, FOLDER).count() > 0


def test_lexical_topk_goes_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(scoring, "sparse_topk", None)
    w = S.sparse_weights(spark, FOLDER)
    assert ranked(queries.lexical_topk(spark, FOLDER).drop("rank"), 10) == ranked(scoring.sparse_scores(w, w, exclude_self=True), 10)


@pytest.mark.parametrize("rows", [queries._scored, queries._routing_rows])
def test_routing_searches_once_and_for_judged_queries(spark, monkeypatch, rows):
    searched, best = [], scoring.sparse_best
    monkeypatch.setattr(scoring, "sparse_best", lambda asked, *rest, **more: searched.append(asked) or best(asked, *rest, **more))
    monkeypatch.setattr(scoring, "sparse_relational", None)
    found = {r[0] for r in rows(spark, FOLDER).select("query_id").collect()}
    asked = {r[0] for r in searched[0].select("id").distinct().collect()}
    assert len(searched) == 1 and found and found <= asked <= {r[0] for r in S.qrels(spark, FOLDER).select("query_id").collect()}


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    met = threading.Barrier(3)
    monkeypatch.setattr(router, "fit_model", lambda train, *_: met.wait(60) and None)
    monkeypatch.setattr(router, "predict", lambda fitted, test: test)
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "i int, fold int")
    assert sorted(r[0] for r in router.out_of_fold(df, ["i"], "i").collect()) == list(range(30))


def test_resampled_auc_is_that_of_the_drawn_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(f"q{i:03}", int(rng.integers(0, 2)), float(rng.integers(0, 6)), float(rng.normal())) for i in range(80)]
    df = spark.createDataFrame(rows, "query_id string, y int, s double, t double")
    for r in router.auc_resamples(df, ["s", "t"], 20, 5).collect():
        pick = np.random.default_rng((5, r[0])).integers(0, 80, 80)
        for name, column in ((1, 2), (2, 3)):
            drawn = [(rows[i][1], rows[i][column]) for i in pick]
            pairs = [(x > z) + (x == z) / 2 for y, x in drawn if y for o, z in drawn if not o]
            assert r[name] == pytest.approx(sum(pairs) / len(pairs))


def test_exact_signed_ranks(spark):
    for values in ([0.1, -0.2, 0.3, 0.4, 0.2], [0.5], [1.0, -1.0, 2.0, 2.0, -3.0, 4.0, 0.0]):
        delta = spark.createDataFrame([(f"q{i}", v) for i, v in enumerate(values)], "query_id string, delta double")
        v = [x for x in values if x]
        size = sorted(abs(x) for x in v)
        ranks = [np.mean([i + 1 for i, s in enumerate(size) if s == abs(x)]) for x in v]
        w = sum(r for r, x in zip(ranks, v) if x > 0)
        sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=len(v))]
        want = min(1.0, 2 * min(np.mean([s <= w + 1e-9 for s in sums]), np.mean([s >= w - 1e-9 for s in sums])))
        assert stats.wilcoxon(delta).first()["p"] == pytest.approx(want)


def test_auc_intervals(spark):
    rng = random.Random(3)
    rows = [(f"q{i}", y := i % 2, y + rng.gauss(0, 0.5), rng.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "query_id string, y int, good double, noise double")
    exact = router.roc_auc(df.withColumn("score", F.col("good"))).first()["auc"]
    one = router.auc_interval(df, "good", 400).first()
    assert one["low"] <= exact <= one["high"] and one["high"] - one["low"] < 0.3
    both = router.paired_auc(df, "good", "noise", 400).first()
    assert both["delta"] > 0.2 and both["low"] > 0 and both["p"] < 0.05
    same = router.paired_auc(df, "good", "good", 100).first()
    assert same["delta"] == 0 and same["p"] == 1
    assert router.auc_interval(df.where("y = 1"), "good", 20).first()["low"] is None


def test_boosted_trees_and_transfer(spark):
    rng = random.Random(4)
    rows = [(i, x := rng.gauss(0, 1), int(abs(x) > 0.7), "a" if i % 3 else "b") for i in range(400)]
    df = spark.createDataFrame(rows, "query_id int, x double, y int, dataset string")
    folded = router.folds(df, "y", "query_id", 2)
    right = lambda rows: sum((r["p"] > 0.5) == r["y"] for r in rows) / len(rows)
    assert right(router.out_of_fold(folded, ["x"], "y", "trees").collect()) > 0.9  # what a line can't do
    moved = router.transfer(df.withColumn("y", (F.col("x") > 0).cast("int")), ["x"], "y", "dataset", "a").collect()
    assert {r["dataset"] for r in moved} == {"b"} and right(moved) > 0.9
    answered = router.out_of_fold(folded, ["x"], "y", "trees").withColumnRenamed("p", "answer").drop("rawPrediction")
    assert right(router.stacked(answered, ["x"], ["answer"], "y").collect()) > 0.9


def test_saved_runs(spark, tmp_path):
    run = spark.createDataFrame([("q1", d, float(9 - i), i + 1) for i, d in enumerate("xay")] + [("q2", "b", 1.0, 1)], "query_id string, doc_id string, score double, rank bigint")
    other = spark.createDataFrame([("q1", "a", 9.0, 1), ("q2", "x", 1.0, 1)], "query_id string, doc_id string, score double, rank bigint")
    qrels = spark.createDataFrame([("q1", "a", 1), ("q2", "b", 1)], "query_id string, doc_id string, rel int")
    folder = str(tmp_path / "runs")
    for name, r in (("one", run), ("two", other)):
        reports.evaluate_and_save(r, qrels, folder, name, 4, {"k": 3}, {"online_seconds": 0.5}, {"bytes": 12}, (1, 10), 10)
    reports.save_scores(run, folder, "one")
    row = reports.read_summaries(spark, folder).where("run = 'one'").first()
    assert (row["n_queries"], row["n_docs"], row["depth"], row["params"], row["timing"], row["index"]) == (2, 4, 10, {"k": "3"}, {"online_seconds": 0.5}, {"bytes": "12"})
    assert row["metrics"]["mrr@10"] == 0.75 and row["metrics"]["ndcg@10"] == round((1 + 1 / math.log2(3)) / 2, 5)
    assert reports.read_runs(spark, folder).count() == 6
    per = reports.read_per_query(spark, folder, (1, 10))
    table = {(r["metric"], r["k"]): r for r in reports.compare_runs(per, "one").collect()}
    assert (table["mrr", 1]["wins"], table["mrr", 1]["losses"], table["mrr", 1]["delta"], table["mrr", 10]["ties"]) == (1, 1, 0.0, 0)
    reports.save_comparison(per, "one", folder)
    assert spark.read.json(f"{folder}/comparison").count() == 10 and spark.read.option("header", True).csv(f"{folder}/comparison_per_query").count() == 20
    means = spark.createDataFrame([("d", "a", 0.5), ("d", "b", 0.7), ("e", "b", 0.1)], "dataset string, method string, value double")
    assert {(r["dataset"], r["method"]): (r["place"], r["headroom"]) for r in reports.headroom(means, "a").collect()} == {("d", "a"): (2, 0.0), ("d", "b"): (1, pytest.approx(0.2)), ("e", "b"): (1, None)}


def test_metrics_by_name(spark):
    per = spark.createDataFrame([("q", 10, 0.5)], "query_id string, k bigint, ndcg double")
    assert metrics.named(per, "ndcg@10").first()["value"] == 0.5
    for bad in ("ndcg", "none@10", "ndcg@x"):
        with pytest.raises(ValueError):
            metrics.named(per, bad)
    df = spark.createDataFrame([([0, 1, 2], [2, 1]), ([1], []), (None, [1])], "g array<int>, i array<int>")
    got = [r[0] for r in df.select(metrics.ndcg_of_gains(F.col("g"), F.col("i"))).collect()]
    assert got[0] == pytest.approx((1 / math.log2(3) + 2 / 2) / (2 + 1 / math.log2(3))) and got[1:] == [None, None]


def test_decision_client(spark, tmp_path):
    asked = spark.createDataFrame([("a", "hello"), ("a", "hello"), ("b", None), ("c", "")], "key string, prompt string")
    cache = str(tmp_path / "cache")
    first = {r["key"]: r for r in scorers.ask_missing(asked.where("key <> 'c'"), cache, lambda p: [float(len(x)) for x in p]).collect()}
    assert {k: r["value"] for k, r in first.items()} == {"a": 5.0, "b": 0.0} and all(r["latency_ms"] >= 0 for r in first.values())
    again = {r["key"]: r["value"] for r in scorers.ask_missing(asked, cache, lambda p: [-1.0] * len(p)).collect()}
    assert again == {"a": 5.0, "b": 0.0, "c": -1.0}
    S.append_missing(asked.select(F.lit("x").alias("key")).limit(1), cache, ["key"], lambda left: left.select(F.lit("a").alias("key"), F.lit(7.0).alias("value"), F.lit(0.0).alias("latency_ms")))
    assert {r["key"]: r["value"] for r in S.read_cache(spark, cache, "key string, value double", form="parquet").collect()}["a"] == 7.0  # a later append wins


def test_one_to_one(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(1, "z")], "k int, b string")
    assert S.merge_one_to_one(a, b, ["k"]).count() == 2
    with pytest.raises(ValueError, match="right"):
        S.merge_one_to_one(a, b.union(b), ["k"])


def test_ordered_subset(spark):
    bags = spark.createDataFrame([("a", 0, [0.0]), ("a", 1, [1.0]), ("b", 0, [2.0]), ("c", 0, [3.0])], "id string, pos int, vec array<double>")
    rows = rank.ordered_subset(bags, spark.createDataFrame([("c", 0), ("a", 1), ("z", 2)], "id string, ord int")).orderBy("row").collect()
    assert [(r["id"], r["pos"], r["row"]) for r in rows] == [("c", 0, 0), ("a", 0, 1), ("a", 1, 2)]


def test_nearest_level(spark):
    df = spark.createDataFrame([(0.04,), (0.05,), (0.26,), (-0.9,), (2.0,)], "c double")
    assert [r[0] for r in df.select(stats.nearest_level(F.col("c"), [0.0, 0.1, 0.3])).collect()] == [0.0, 0.0, 0.3, 0.0, 0.3]


def test_segments_replace_and_count(spark, tmp_path):
    path = str(tmp_path / "segments")
    final = [(1, "red kale"), (2, ""), (3, "oat oat"), (4, None)]
    segments.write_segment(spark.createDataFrame([(1, "old words here"), (2, "more old words"), (4, None)], "id int, text string"), path, 0)
    segments.write_segment(spark.createDataFrame(final[:3], "id int, text string"), path, 1)
    got = {(r["id"], r["term"]): r["weight"] for r in segments.segment_weights(spark, path).collect()}
    want = {(r["id"], r["term"]): r["weight"] for r in encode.bm25_index(spark.createDataFrame(final, "id int, text string")).collect()}
    assert got == pytest.approx(want) and len(got) == 3


def test_retriever_objects(spark):
    texts = spark.createDataFrame([("a", "red kale"), ("b", "oat rice")], "id string, text string")
    found = objects.Bm25().fit(texts).search(spark.createDataFrame([("q", "kale")], "id string, text string"), 3).collect()
    assert [(r["query_id"], r["doc_id"]) for r in found] == [("q", "a")]
    rng = np.random.default_rng(5)
    bags = spark.createDataFrame([(f"d{i}", j, rng.normal(size=16).tolist()) for i in range(6) for j in range(3)], "id string, pos int, vec array<double>")
    for method in (objects.Smve(32, 4, 2, dim=16), objects.Smve(32, 4, dim=16, center=True), objects.Muvera(2, 2, 4, dim=16), objects.MaxSim(16)):
        top = {r["query_id"]: r["doc_id"] for r in method.fit(bags).search(bags, 2).where("rank = 1").collect()}
        assert sum(q == d for q, d in top.items()) >= 5
    assert objects.Muvera().size == 10_240


def test_command_line(spark, tmp_path, capsys):
    from polyvec.__main__ import main

    assert main(["list"]) == 0 and "bm25_topk" in capsys.readouterr().out and main(["nonsense"]) == 2
    assert main(["save", "storage_bytes", FOLDER, str(tmp_path / "out")]) == 0 and spark.read.parquet(str(tmp_path / "out")).count() == 1
    (tmp_path / "run").write_text("q Q0 a 1 2.0 t\nq Q0 b 2 1.0 t\n")
    (tmp_path / "qrels").write_text("query-id\tcorpus-id\tscore\nq\tb\t1\n")
    assert main(["evaluate", str(tmp_path / "run"), str(tmp_path / "qrels"), str(tmp_path / "eval"), "mine"]) == 0
    assert reports.read_summaries(spark, str(tmp_path / "eval")).first()["metrics"]["mrr@3"] == 0.5


def test_generated_pairs_mechanism(spark):
    rows = report_queries.mechanism_generated(spark, FOLDER).collect()
    assert len(rows) == 7 * 8 and all(r["n"] == report_queries.GENERATED for r in rows)
    means = {r["level"]: r["mean"] for r in rows if r["mode"] == "single matrix" and r["budget"] == 8}
    assert [means[x] for x in sorted(means)] == sorted(means.values())  # higher cosine, higher score


@pytest.mark.parametrize("name", ["saved_summaries", "run_comparison", "rerank_depths", "first_stage_costs", "cross_dataset", "nearest_levels", "latency_split", "router_heuristics", "decision_answers", "yes_no_rerank", "routing_questions", "ndcg_explicit", "bag_subset", "bm25_from_segments", "hybrid_three_way", "lexical_topk", "corpus_ranges"])
def test_reports_match_sql(spark, name):
    import __spark_entry__ as e
    from compare import connect, rows_of

    df = e.queries()[name](spark, FOLDER)
    cur = connect(FOLDER).execute(e.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_datasets_and_typed_csv(spark, tmp_path):
    scores = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 1.0)], "query_id string, doc_id string, score double")
    assert S.DATASETS["debatepro"].allowed(scores).count() == 1 and S.DATASETS["nutriqa"].allowed(scores).count() == 2
    assert S.DATASETS["nutriqa"].embeddings("/r", "m") == "/r/nutriqa/m/embeddings" and S.DATASETS["nutriqa"].results("/r", "m") == "/r/nutriqa_m"
    (tmp_path / "t.csv").write_text("name,w,cost\nsmve,64,\n,,1.5\n")
    assert sorted(map(tuple, S.read_typed_csv(spark, str(tmp_path / "t.csv"), "name string, w int, cost double").collect()), key=str) == sorted([("smve", 64, None), (None, None, 1.5)], key=str)


def test_costs(spark):
    row = spark.range(1).select(scorers.dense_flops(64, F.lit(10)).alias("d"), scorers.maxsim_flops(F.lit(3), F.lit(5), 64).alias("m"), router.latency_at(F.lit(10.0), F.lit(100.0), F.lit(0.1), router.decision_charge(F.lit(12.0), F.lit(10.0), True)).alias("p"), router.decision_charge(F.lit(12.0), F.lit(10.0), False).alias("s")).first()
    assert (row["d"], row["m"], row["p"], row["s"]) == (1280, 1920, 22, 12)

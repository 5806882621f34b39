"""Hand-made cases and brute force for the engine's operators."""

import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from polyvec.functions import text as T
from polyvec.functions.vectors import centre, dot, normalise
from polyvec.operators import encode, metrics, rank, router, scorers, scoring, stats
from polyvec.plans import pipeline, queries
from polyvec.sources import tables as S
from polyvec.streaming import segments

BAG = "id string, pos bigint, vec array<double>"


def bags(spark, lengths, dim=16, seed=0, name="b"):
    rng = np.random.default_rng(seed)
    rows = [(f"{name}{i}", j, rng.normal(size=dim).tolist()) for i, n in enumerate(lengths) for j in range(n)]
    return spark.createDataFrame(rows, BAG), {f"{name}{i}": np.array([r[2] for r in rows if r[0] == f"{name}{i}"]) for i in range(len(lengths))}


def run_of(spark, **lists):
    return spark.createDataFrame([(q, d, float(-i), i + 1) for q, ds in lists.items() for i, d in enumerate(ds)], "query_id string, doc_id string, score double, rank bigint")


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0], [1.0, 1.0])], "a array<double>, b array<double>").select(dot(F.col("a"), F.col("b")).alias("d"), normalise(F.col("a")).alias("n"), centre(F.col("a"), F.col("b")).alias("c"), normalise(F.array(F.lit(0.0), F.lit(0.0))).alias("z")).first()
    assert r["d"] == 7 and r["n"] == [0.6, 0.8] and r["c"] == pytest.approx([2 / 13**0.5, 3 / 13**0.5]) and r["z"] == [0, 0]


def test_text(spark):
    assert [T.stem(w) for w in ("proteins", "binding", "caresses", "ponies", "relational", "hopping", "generously", "flies", "dying", "happy", "controlling")] == ["protein", "bind", "caress", "poni", "relat", "hop", "generous", "fli", "die", "happi", "control"]
    df = spark.createDataFrame([("The proteins are binding",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.stems(T.tokens(F.col("t")))).collect()] == [["protein", "bind"], [], []]
    short = spark.createDataFrame([(" a b  c",), ("a",), (None,)], "t string").select(T.shorten(F.col("t"), 2)).collect()
    assert [r[0] for r in short] == ["a b ...", "a", ""]
    titles = spark.createDataFrame([("T", "b"), (" ", "b"), (None, "b"), ("T", None)], "t string, b string").select(T.join_title(F.col("t"), F.col("b"))).collect()
    assert [r[0] for r in titles] == ["T. b", "b", "b", "T. "]


def test_maxsim_is_the_naive_sum(spark):
    q, qs = bags(spark, [3, 1, 7, 4], name="q")
    d, ds = bags(spark, [5, 2, 9, 1, 6, 3, 8], seed=1, name="d")
    want = {(a, b): float((x @ y.T).max(1).sum()) for a, x in qs.items() for b, y in ds.items()}
    for got in (scoring.maxsim_scores(q, d, dim=16), scoring.maxsim_relational(q, d, q.select(F.col("id").alias("query_id")).distinct().crossJoin(d.select(F.col("id").alias("doc_id")).distinct()))):
        rows = {(r["query_id"], r["doc_id"]): r["score"] for r in got.collect()}
        assert rows.keys() == want.keys() and all(rows[k] == pytest.approx(want[k], abs=2e-6) for k in want)
    top = rank.top_k(scoring.maxsim_scores(q, d, k=3, dim=16), 3).collect()
    for a in qs:
        assert [r["doc_id"] for r in sorted((r for r in top if r["query_id"] == a), key=lambda r: r["rank"])] == sorted(ds, key=lambda b: (-round(want[a, b], 6), b))[:3]
    pair = spark.createDataFrame([(qs["q0"].tolist(), ds["d0"].tolist())], "q array<array<double>>, d array<array<double>>").select(scoring.maxsim_pair(F.col("q"), F.col("d"))).first()[0]
    assert pair == pytest.approx(want["q0", "d0"])


def test_query_blocks_change_nothing(spark, monkeypatch):
    q, _ = bags(spark, [2] * 6, name="q")
    d, _ = bags(spark, [3] * 5, seed=1, name="d")
    whole = sorted(scoring.maxsim_scores(q, d, dim=16).collect())
    monkeypatch.setattr(scoring, "_blocks", lambda df, dim, floats=0: [df.where(F.pmod(F.xxhash64("id"), F.lit(3)) == b) for b in range(3)])
    assert sorted(scoring.maxsim_scores(q, d, dim=16).collect()) == whole


def test_top_k_and_rerank(spark):
    s = spark.createDataFrame([("q", d, x) for d, x in zip("abcd", (0.1, 0.9, 0.5, 0.5))], "query_id string, doc_id string, score double")
    assert [r["doc_id"] for r in rank.top_k(s, 3).orderBy("rank").collect()] == ["b", "c", "d"]
    assert [r["doc_id"] for r in rank.top_vector(s, 2).collect()] == ["b", "c"]
    run = run_of(spark, q=list("wxyz"))
    new = spark.createDataFrame([("q", "x", 1.0), ("q", "y", 1.0), ("q", "z", 9.0)], "query_id string, doc_id string, score double")
    order = lambda r: [x["doc_id"] for x in r.orderBy("rank").collect()]
    assert order(rank.rerank(run, new, 3)) == ["x", "y", "w", "z"] and order(rank.rerank(run, new, 2, False)) == ["x", "w"]
    assert rank.exclude_self(run_of(spark, q=["q", "a"])).count() == 1
    assert rank.missing(run, new, ["query_id", "doc_id"]).count() == 1
    assert rank.top_k(s.limit(0), 3).count() == 0


def test_sparse_product_and_index(spark):
    rng = np.random.default_rng(0)
    m = (rng.random((50, 40)) < 0.1) * rng.random((50, 40))
    rows = [(int(i), int(t), float(m[i, t])) for i, t in zip(*np.nonzero(m))]
    df = spark.createDataFrame(rows, "id bigint, term int, weight double")
    got = {(r[0], r[1]): r[2] for r in scoring.sparse_scores(df, df).collect()}
    assert all(got.get((i, j), 0) == pytest.approx((m @ m.T)[i, j], abs=1e-6) for i in range(50) for j in range(50))
    reads = {r[0]: r[1] for r in scoring.postings_read(df, df).collect()}
    assert all(reads[i] == sum((m[:, t] > 0).sum() for t in np.flatnonzero(m[i])) for i in reads)
    one = encode.index_size(df, 50).first()
    assert one["csr_bytes"] == len(rows) * 8 + 51 * 4 and one["index_bytes"] == len(rows) * 8 + ((m > 0).any(0).sum() + 1) * 8
    ranges = spark.createDataFrame([(0, 10, 3), (1, 50, 2), (2, 7, 0)], "id int, start int, len int")
    assert sorted(r["value"] for r in scoring.expand_ranges(ranges).collect()) == [10, 11, 12, 50, 51]


@pytest.mark.parametrize("partitions", [None, 1, 7])
def test_running_offsets_are_of_one_array(spark, partitions):
    rng = random.Random(5)
    lengths = {f"{p}-{i}": rng.randint(1, 9) for p in ("000", "NUT", "deb") for i in range(60)}
    found = scoring.running_offsets(spark.createDataFrame(list(lengths.items()), "id string, len bigint").repartition(3), partitions).collect()
    at = 0
    for r in sorted(found):
        assert (r["len"], r["start"]) == (lengths[r["id"]], at)
        at += r["len"]
    assert len(found) == len(lengths)


def test_corpus_ranges_name_each_token_once(spark):
    rows = queries.corpus_ranges(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["value"] for r in rows) == list(range(len(rows)))
    assert [r["id"] for r in sorted(rows, key=lambda r: r["value"])] == sorted(r["id"] for r in rows)


def test_anchors_are_unit_and_seeded():
    a, b = encode.directions(3, 40, 16), encode.directions(4, 40, 16)
    assert np.linalg.norm(a, axis=1) == pytest.approx(np.ones(40)) and not np.allclose(a, b) and (a == encode.directions(3, 40, 16)).all()


@pytest.mark.parametrize("role", ["query", "document"])
def test_smve(spark, role):
    d, ds = bags(spark, [3, 1, 7, 4])
    anchors = encode.directions(0, 96, 16)
    want = {}
    for i, x in ds.items():
        p = np.round(x @ anchors.T, 9)
        for t in range(len(x)):
            for r in range(3):
                for a in sorted(range(32 * r, 32 * r + 32), key=lambda a: (-p[t, a], a))[:5]:
                    want.setdefault((i, a), []).append(p[t, a])
    want = {k: sum(v) / (len(v) if role == "document" else 1) for k, v in want.items()}
    got = {(r["id"], r["term"]): r["weight"] for r in encode.smve_encode(d, 32, 5, 3, role, dim=16).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    with pytest.raises(ValueError):
        encode.anchor_weights(d, 4, 5)


@pytest.mark.parametrize("role", ["query", "document"])
def test_fde(spark, role):
    d, ds = bags(spark, [5, 1, 9, 3])
    planes, flips = encode.directions(1000, 9, 16, unit=False), [encode.signs(2000 + r, 4, 16) for r in range(3)]
    got = {(r["id"], r["rep"], r["bucket"], r["dim"]): r["value"] for r in encode.fde_encode(d, 3, 3, 4, role, dim=16).collect()}
    count = 0
    for i, x in ds.items():
        for r in range(3):
            codes = ((x @ planes[3 * r : 3 * r + 3].T > 0) * [1, 2, 4]).sum(1)
            psi = x @ flips[r].T
            for b in range(8):
                inside = psi[codes == b]
                if len(inside):
                    want = inside.sum(0) if role == "query" else inside.mean(0)
                elif role == "document":
                    want = psi[min(range(len(x)), key=lambda t: (bin(codes[t] ^ b).count("1"), t))]
                else:
                    assert (i, r, b, 0) not in got
                    continue
                count += 4
                assert [got[i, r, b, k] for k in range(4)] == pytest.approx(want.tolist())
    assert count == len(got)


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "apple banana apple"), (1, "banana cherry"), (2, "cherry cherry cherry date"), (3, ""), (4, None)], "id int, text string")
    got = {(r["id"], r["term"]): r["weight"] for r in encode.bm25_index(docs).collect()}
    mean, idf = 9 / 5, math.log(1 + (5 - 1 + 0.5) / 1.5)
    assert got[0, "apple"] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / mean)))
    q = encode.bm25_queries(spark.createDataFrame([("a", "apple Apple"), ("b", "unknown the")], "id string, text string"))
    scores = scoring.sparse_scores(q, encode.bm25_index(docs)).collect()
    assert [(r["query_id"], r["doc_id"]) for r in scores] == [("a", 0)] and scores[0]["score"] == pytest.approx(2 * got[0, "apple"], abs=1e-6)
    assert encode.bm25_index(docs.limit(0)).count() == 0


def test_metrics_by_hand(spark):
    run = run_of(spark, q1=list("xaycz"))
    qrels = spark.createDataFrame([("q1", "a", 1), ("q1", "c", 1), ("q2", "a", 1), ("q3", "a", 0)], "query_id string, doc_id string, rel int")
    got = {(r["query_id"], r["k"]): r for r in metrics.evaluate(run, qrels, (1, 3, 5)).collect()}
    assert {k[0] for k in got} == {"q1", "q2"} and got["q2", 5]["ndcg"] == 0
    r = got["q1", 5]
    assert r["ndcg"] == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3)))
    assert (r["precision"], r["recall"], r["mrr"], r["map"]) == (0.4, 1.0, 0.5, 0.5)
    assert got["q1", 1]["ndcg"] == 0 and got["q1", 3]["recall"] == 0.5
    three = spark.createDataFrame([("q1", d, 1) for d in "abc"], "query_id string, doc_id string, rel int")
    assert metrics.evaluate(run_of(spark, q1=["a"]), three, (1,)).first()["ndcg"] == 1.0
    assert {r["query_id"]: r["first_rank"] for r in metrics.first_relevant(run, qrels).collect()} == {"q1": 2, "q2": None}
    assert {r["bin"]: r["queries"] for r in metrics.first_relevant_profile(run, qrels).collect()} == {"2-3": 1, ">100": 1}
    values = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,), (2.0,)], "v double")
    assert {r["bin"]: r["n"] for r in metrics.histogram(values, "v", 0, 1, 2).collect()} == {1: 1, 2: 2}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=6, unique=True), st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 3), min_size=1))
def test_ndcg_is_a_share(spark, order, rels):
    qrels = spark.createDataFrame([("q", d, r) for d, r in rels.items()], "query_id string, doc_id string, rel int")
    for r in metrics.evaluate(run_of(spark, q=order), qrels, (1, 3, 6)).collect():
        assert 0 <= r["ndcg"] <= 1 + 1e-12 and 0 <= r["map"] <= 1


def test_statistics(spark):
    delta = spark.createDataFrame([(f"q{i}", x) for i, x in enumerate([0.1, -0.2, 0.3, 0.0, 0.2, 0.2])], "query_id string, delta double")
    s = stats.paired_summary(delta).first()
    assert (s["n"], s["wins"], s["ties"], s["losses"]) == (6, 4, 1, 1) and s["mean_delta"] == pytest.approx(0.1)
    w = stats.wilcoxon(delta).first()
    assert w["n"] == 5 and w["w_plus"] == pytest.approx(1 + 3 + 3 + 5) and w["w_minus"] == 3 and 0 < w["p"] < 1
    assert stats.wilcoxon(delta.where("delta = 0")).first()["p"] == 1.0
    ci = stats.bootstrap_interval(delta, 100).first()
    assert ci["low"] <= 0.1 <= ci["high"]
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (2.0, 5.0), (9.0, 6.0)], "x double, y double")
    assert stats.spearman(pairs, "x", "y").first()["spearman"] == pytest.approx(0.9486833)
    f = stats.fidelity(run_of(spark, a=list("xyz"), b=["p"]), run_of(spark, a=list("zx"), b=["k"])).first()
    assert f["overlap"] == pytest.approx(0.1) and f["median_rank"] == 3 and f["missing"] == 1
    t = spark.createDataFrame([("a", 1.0, 5.0), ("b", 1.0, 6.0), ("c", 2.0, 6.0), ("d", 3.0, 7.0)], "name string, cost double, v double")
    assert {r["name"] for r in stats.pareto(t, "cost", "v").collect()} == {"b", "d"}
    assert {(r["limit"], r["name"]) for r in stats.best_within(t, [], "cost", [2.0, 9.0], "v", "name").collect()} == {(2.0, "b"), (9.0, "d")}
    made = stats.correlated_pairs(spark, [0.2, 0.8], 5, 16).collect()
    assert len(made) == 10 and all(np.dot(r["x"], r["y"]) == pytest.approx(r["level"]) for r in made)
    assert stats.latency_probe(lambda i: None, 3, 10) >= 0


def test_router(spark):
    rows = [("a", 0.9, 0.5, 0.1, 1), ("b", 0.9, -0.2, 0.2, 0), ("c", 0.1, 0.0, 0.3, 0), ("d", 0.5, 0.3, 0.4, 1)]
    df = spark.createDataFrame(rows, "query_id string, score double, gain double, base double, y int")
    curve = [r["value"] for r in router.escalation_curve(df).orderBy("n").collect()]
    assert curve == pytest.approx([0.25, 0.375, 0.325, 0.4, 0.4])
    assert router.roc_auc(df).first()["auc"] == pytest.approx((1 + 0.5 + 1 + 0) / 4)
    assert router.roc_auc(df.where("y = 1")).first()["auc"] is None
    assert router.gain_kept(df.withColumn("score", F.col("gain"))).first()["gain_kept"] == pytest.approx(1)
    p = spark.createDataFrame([(0.95, 1), (0.85, 0), (1.0, 1)], "p double, y int")
    assert router.expected_calibration_error(p).first()["ece"] == pytest.approx((abs(0.975 - 1) * 2 + 0.85) / 3)
    rng = random.Random(0)
    train = spark.createDataFrame([(i, x := rng.gauss(0, 1), int(x + rng.gauss(0, 0.3) > 0), "s") for i in range(120)], "query_id int, x double, y int, s string")
    scored = router.out_of_fold(router.folds(train, "s", "query_id", 3), ["x"], "y").collect()
    assert len(scored) == 120 and sum((r["p"] > 0.5) == r["y"] for r in scored) > 95
    fitted = router.fit_model(train, ["x"], "y")
    assert router.coefficients(fitted, ["x"])[0][1] > 0


def test_scorers(spark):
    pairs = spark.createDataFrame([("q", "a", "red kale", "kale is red"), ("q", "b", "red kale", "oat")], "query_id string, doc_id string, query_text string, doc_text string")
    assert {r["doc_id"]: r["score"] for r in scorers.overlap_scorer(pairs).collect()} == {"a": 1.0, "b": 0.0}
    assert {r["doc_id"]: r["score"] for r in scorers.score_pairs(pairs, lambda q, d: [float(len(x)) for x in d]).collect()} == {"a": 11.0, "b": 3.0}
    answers = spark.createDataFrame([("q", {"A": 0.7})], "query_id string, probs map<string,double>")
    options = spark.createDataFrame([("q", "a", "A"), ("q", "b", "B")], "query_id string, doc_id string, option string")
    assert {r["doc_id"]: r["score"] for r in scorers.choice_scores(answers, options).collect()} == {"a": 0.7, "b": 0.0}


def test_files(spark, tmp_path):
    run = run_of(spark, q1=list("ab"), q2=["c"])
    S.write_trec_run(run, str(tmp_path / "run"), "t")
    back = S.read_trec_run(spark, str(tmp_path / "run"))
    assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in back.collect()) == [("q1", "a", 1), ("q1", "b", 2), ("q2", "c", 1)]
    (tmp_path / "corpus.jsonl").write_text(json.dumps({"_id": "007", "title": "T", "text": "x"}) + "\n" + json.dumps({"_id": "8", "title": "", "text": "y"}) + "\n")
    assert sorted(map(tuple, S.read_beir_corpus(spark, str(tmp_path / "corpus.jsonl")).collect())) == [("007", "T. x"), ("8", "y")]
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\n01\t007\t1\n01\t8\t0\n")
    assert S.read_beir_qrels(spark, str(tmp_path / "q.tsv")).count() == 1 and S.read_beir_qrels(spark, str(tmp_path / "q.tsv"), True).first()["query_id"] == "01"
    (tmp_path / "c.jsonl").write_text('{"key": "a", "v": 1}\n{"key": "a", "v": 2}\n{"key": "b", "v": 3}\n')
    assert {r["key"]: r["v"] for r in S.read_cache(spark, str(tmp_path / "c.jsonl"), "key string, v int").collect()} == {"a": 2, "b": 3}
    todo = run.select("query_id", "doc_id")
    for _ in range(2):
        S.append_missing(todo, str(tmp_path / "cache"), ["query_id", "doc_id"], lambda t: t.withColumn("score", F.lit(1.0)))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 3
    S.write_summary(spark.createDataFrame([("ndcg", 0.1234567)], "metric string, value double"), str(tmp_path / "sum"), w=64)
    got = S.read_summaries(spark, str(tmp_path / "sum"), "params struct<w:int,reps:int>, metrics map<string,double>").first()
    assert got["metrics"]["ndcg"] == 0.12346 and got["params"]["reps"] == 1
    S.write_embeddings(str(tmp_path / "emb"), dense=spark.range(2))
    assert spark.read.parquet(str(tmp_path / "emb/dense")).count() == 2


def test_pipeline_and_report(spark):
    assert pipeline.parse("hybrid > maxsim@10") == [("hybrid", None), ("maxsim", 10)]
    for bad in ("a@3 > b@2", "a > b", "", "a > b@x"):
        with pytest.raises(ValueError):
            pipeline.parse(bad)
    s = spark.createDataFrame([("q", d, x) for d, x in zip("abc", (3.0, 2.0, 1.0))], "query_id string, doc_id string, score double")
    run, per = pipeline.search_and_evaluate("one > two@2", {"one": lambda: s, "two": lambda: s.withColumn("score", -F.col("score"))}, spark.createDataFrame([("q", "b", 1)], "query_id string, doc_id string, rel int"), (1,))
    assert [r["doc_id"] for r in run.orderBy("rank").collect()] == ["b"] and per.count() == 1  # both are reranked, one is kept
    assert len(list(pipeline.grid(lambda x: x["k"] < x["w"], w=[4, 8], k=[4, 6]))) == 2
    assert pipeline.run_name("smve", w=64, k=4, center=True, reps=None) == "smve_w64_k4_center"
    assert pipeline.markdown(spark.createDataFrame([(1, 0.5)], "a int, b double")) == "| a | b |\n|---|---|\n| 1 | 0.5000 |"


def test_rerankers_get_the_depth_they_name(spark):
    ids = [f"d{i}" for i in range(9)]
    scorers = {name: lambda sign=sign: spark.createDataFrame([("q", d, float(sign * i)) for i, d in enumerate(ids)], "query_id string, doc_id string, score double") for name, sign in (("up", 1), ("down", -1))}
    docs = lambda run: [r["doc_id"] for r in sorted(run.collect(), key=lambda r: r["rank"])]
    for tail in (True, False):
        assert docs(pipeline.run_pipeline("down > up@6", scorers, 2, tail)) == ["d5", "d4"]
    assert docs(pipeline.run_pipeline("down > up@6 > down@3", scorers, 4)) == ["d3", "d4", "d5", "d2"]
    assert docs(pipeline.run_pipeline("down > up@2", scorers, 4)) == ["d1", "d0", "d2", "d3"] and docs(pipeline.run_pipeline("down", scorers, 2)) == ["d0", "d1"]
    qrels = spark.createDataFrame([("q", "d5", 1)], "query_id string, doc_id string, rel int")
    run, found = pipeline.search_and_evaluate("down > up@6", scorers, qrels, (1,))
    assert docs(run) == ["d5"] and [r["ndcg"] for r in found.collect()] == [1.0]


def test_stream_of_segments(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "red kale"), (2, "oat")], "id bigint, text string").write.parquet(source)
    read = lambda: spark.readStream.schema("id bigint, text string").parquet(source)
    segments.append_segments(read(), str(tmp_path / "seg"), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(2, "rice rice")], "id bigint, text string").write.mode("append").parquet(source)
    segments.append_segments(read(), str(tmp_path / "seg"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["id"], r["term"], r["tf"]) for r in segments.read_segments(spark, str(tmp_path / "seg")).collect()) == [(1, "kale", 1), (1, "red", 1), (2, "rice", 2)]


def test_plans(spark):
    """Top-k is limited before its shuffle; scans read only the columns they need."""
    from polyvec.plans.queries import bm25_topk, storage_bytes

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(bm25_topk(spark, "/root/testdata/sf0.001")).count("WindowGroupLimit") >= 2
    assert "title" not in plan(storage_bytes(spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("name", ["dense_topk", "maxsim_topk", "smve_topk", "muvera_topk", "bm25_topk", "eval_mean", "run_fidelity", "pareto_frontier", "router_labels"])
def test_queries_match_sql(spark, name):
    import __spark_entry__ as e
    from compare import connect, rows_of

    folder = "/root/testdata/sf0.001"
    df = e.queries()[name](spark, folder)
    cur = connect(folder).execute(e.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize(("name", "twin", "small", "surveyed"), [("paired_bootstrap_surveyed", "paired_bootstrap", "range(200)", "range(10000)"), ("metrics_at_k_surveyed", "metrics_at_k", "range(1, 21)", "range(1, 101)")])
def test_surveyed_settings_match_sql_of_their_size(spark, name, twin, small, surveyed):
    import __spark_entry__ as e
    from compare import connect, rows_of

    folder = "/root/testdata/sf0.001"
    sql = e.oracle_sql()[twin]
    assert small in sql and name not in e.oracle_sql()
    df = e.queries()[name](spark, folder)
    cur = connect(folder).execute(sql.replace(small, surveyed))
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_surveyed_mechanism(spark):
    folder = "/root/testdata/sf0.001"
    pairs = {(r["level"], r["a"], r["b"]): r["cosine"] for r in queries.pair_levels_surveyed(spark, folder).collect()}
    vectors = {r["pos"]: np.array(r["vec"]) for r in S.query_bags(spark, folder).collect()}
    ids = sorted(vectors)
    near = sum(min(1000, sum(abs(round(float(vectors[a] @ vectors[b]) - x, 6)) <= 0.025 for i, a in enumerate(ids) for b in ids[i + 1 :])) for x in queries.SURVEYED_LEVELS)
    assert len(pairs) == near and all(abs(c - level) <= 0.0250005 for (level, _, _), c in pairs.items())
    rows = queries.pair_mechanism_surveyed(spark, folder).collect()
    assert {(r["mode"], r["budget"]) for r in rows} == {("repetitions", 1), *[(m, b) for m in ("repetitions", "single matrix") for b in (2, 4, 8)]}
    assert all(sum(r["n"] for r in rows if (r["mode"], r["budget"]) == v) == len(pairs) for v in {(r["mode"], r["budget"]) for r in rows})
    assert queries.rank_correlation_surveyed(spark, folder).count() == 7

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from polyvec.llm import percentiles as P
from polyvec.llm import split as S
from polyvec.llm import topn as N

BOUNDARY = set(map(chr, S.SPACES + S.MARKS))


def check(text, limit, overlap):
    pieces = S.split_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    run = max((len(r) for r in "".join("\n" if c in BOUNDARY else c for c in text).split("\n")), default=0)
    forced = any(k == S.FORCED for *_, k in pieces)
    assert forced == (run > limit)
    for (a, b, kind), (c, d, _) in zip(pieces, pieces[1:]):
        assert a < c <= b < d
        if kind == S.NATURAL:
            assert text[b - 1] in BOUNDARY or text[b] in BOUNDARY
    assert all(b - a <= limit for a, b, _ in pieces)
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n　。x", max_size=400), st.integers(5, 40), st.integers(0, 4))
def test_split_covers_within_limit(text, limit, overlap):
    check(text, limit, overlap)


def test_split_edges():
    assert S.split_text("", 10, 2) == [(0, 0, "natural")]
    check("a" * 2000 + " " + "b" * 2000, 2000, 200)
    check("a" * 2001 + " b", 2000, 200)
    check("word " * 100_000, 2000, 200)
    text = ". ".join("Sentence %d has some words in it" % i for i in range(400))
    pieces = check(text, 2000, 200)
    shared = [b - c for (_, b, _), (c, _, _) in zip(pieces, pieces[1:])]
    assert all(100 <= s <= 300 for s in shared)
    sizes = [b - a for a, b, _ in pieces]
    assert max(sizes) - min(sizes) < 500  # balanced
    with pytest.raises(ValueError):
        S.split_text("a", 10, 10)


def test_split_long_rows(spark):
    df = spark.createDataFrame([("a", "x " * 30, 1), ("a", "x " * 30, 1), ("b", None, 2), ("c", "", 3), ("d", "y" * 40, 4), (None, "z " * 20, 5)], "key string, text string, piece int")
    out = S.split_long(df, "key", "text", 20, 4)
    assert set(out.columns) == {"key", "piece", "start", "end", "cut", "text"}
    rows = out.collect()
    assert {r["key"] for r in rows} == {"a", "d", None}
    assert all(len(r["text"]) == r["end"] - r["start"] <= 20 for r in rows)
    assert {(r["key"], r["cut"]) for r in S.cut_kinds(df, "key", "text", 20, 4).collect()} == {("a", "natural"), ("d", "forced"), (None, "natural")}
    assert S.cut_kinds(df.limit(0), "key", "text").count() == 0


def test_bits_keep_order(spark):
    special = [0.0, -0.0, 5e-324, 2.2250738585072014e-308, 1.0, np.nextafter(1, 0), np.nextafter(1, 2), 2.0**52, 2.0**53, 1e308, math.inf]
    values = [*special, *(-v for v in special), *(random.Random(1).uniform(-1, 1) * 10.0 ** random.Random(i).randint(-300, 300) for i in range(500))]
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,), (math.nan,)], "x double").select("x", P.ordered_bits(F.col("x")).alias("b")).withColumn("y", P.from_bits(F.col("b"))).collect()
    for r in rows:
        if r["x"] is None or math.isnan(r["x"]):
            assert r["b"] is None
        else:
            want = int(np.float64(abs(r["x"])).view(np.int64))
            assert r["b"] == (-want if r["x"] < 0 else want) and r["y"] == r["x"]


def test_percentiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(1, 3), rng.choice([rng.lognormvariate(0, 3), -1.0, 0.0])) for _ in range(3000)]
    df = spark.createDataFrame([*rows, ("a", 1, None), ("a", 1, math.nan), ("n", 1, None)], "g string, day int, n double")
    days = P.summarise(df, ["g", "day"], "n")
    chosen = P.select(P.combine(days, ["g"]), ["g"], [0.0, 0.5, 0.99, 1.0])
    want = {}
    for g in {r[0] for r in rows}:
        v = sorted(r[2] for r in rows if r[0] == g)
        for q in (0.0, 0.5, 0.99, 1.0):
            want[g, q] = v[max(1, math.ceil(q * len(v) - 1e-9)) - 1]
    bounds = {(r["g"], r["q"]): r for r in P.bounds(chosen).collect()}
    assert bounds.keys() == want.keys()
    for k, v in want.items():
        low, high = bounds[k]["low"], bounds[k]["high"]
        assert low <= v <= high and (v == 0 or abs((low + high) / 2 - v) <= P.error_bound(8) * abs(v) * 1.01)
    exact = {(r["g"], r["q"]): r["value"] for r in P.refine(df, ["g"], "n", chosen).collect()}
    assert exact == want
    assert P.select(P.summarise(df.limit(0), ["g"], "n"), ["g"], [0.5]).count() == 0


def test_top_n(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), f"d{rng.randint(0, 300):03}", float(rng.randint(0, 40))) for _ in range(4000)]
    rows += [("a", "x", None), ("a", "y", math.nan), ("c", None, 1.0), ("c", "z", 1.0)]
    df = spark.createDataFrame(rows, "rank string, part string, n double")
    for n, partitions in ((3, 16), (10, 3), (700, 16)):
        got = {}
        for r in N.top_n(df, "rank", "part", "n", n, partitions).collect():
            got.setdefault(r[0], []).append((r[3], -r[2], r[1]))
        for g in {r[0] for r in rows}:
            best = sorted([(-s, d is not None, d) for x, d, s in rows if x == g and s is not None and s == s])[:n]
            assert [(s, d) for _, s, d in sorted(got[g], key=lambda r: r[0])] == [(s, d) for s, _, d in best]
    assert N.top_n(df.limit(0), "rank", "part", "n", 3).count() == 0


def test_latest_scores(spark):
    df = spark.createDataFrame([("q", "a", 1.0, 1), ("q", "a", 2.0, 2), ("q", "b", 1.0, 2), ("q", "b", None, 3), ("q", "c", 1.0, 1), ("q", "c", math.nan, 1), ("q", "d", 3.0, None)], "q string, d string, s double, at int")
    assert {(r["d"], r["s"]) for r in N.latest_scores(df, "q", "d", "s", "at").collect()} == {("a", 2.0), ("c", 1.0), ("d", 3.0)}


def test_stretches_between_runs_are_balanced():
    sentence = "This is a sentence of some words. "
    text = sentence * 500 + "x" * 2500 + " " + sentence * 500
    pieces = check(text, 2000, 200)
    sizes = [b - a for a, b, _ in pieces]
    lead = [s for s in sizes[:9]]
    assert sum(k == S.FORCED for *_, k in pieces) == 1 and max(lead) - min(lead) < 200
    assert all(100 <= b - c <= 300 for (_, b, _), (c, _, _) in zip(pieces, pieces[1:]))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 1500), min_size=8, max_size=40), st.integers(0, 99))
def test_overlap_is_kept_in_long_words(lengths, seed):
    text = " ".join("w" * n for n in lengths)
    if len(text) <= 2000:
        return
    pieces = check(text, 2000, 200)
    shared = [b - c for (_, b, _), (c, _, _) in zip(pieces, pieces[1:])]
    assert all(100 <= s <= 300 for s in shared)  # no word is so long that the overlap has to shrink


def test_overlap_shrinks_only_for_a_natural_cut():
    text = " ".join("w" * 1950 for _ in range(6))
    pieces = check(text, 2000, 200)
    assert all(k == S.NATURAL for *_, k in pieces) and all(40 <= b - c <= 200 for (_, b, _), (c, _, _) in zip(pieces, pieces[1:]))

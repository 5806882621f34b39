import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from polyvec.llm import neighbours as V
from polyvec.llm import terms as T
from polyvec.llm import tokenizer as B
from polyvec.llm.queries import ranks_path


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab1", max_size=6), max_size=200))
def test_burst_trie_counts(words):
    trie = T.BurstTrie(burst=4)
    for w in words:
        trie.add(w, 1, 1)
    got = {}
    for prefix, leaf in trie.leaves():
        assert all(t.startswith(prefix) for t in leaf)
        got |= {t: c[0] for t, c in leaf.items()}
    assert got == dict(Counter(words)) and trie.size == len(got)


def test_term_frequencies(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "Gamma,", f"x{rng.randint(0, 400)}"]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "İ Kelvin"]
    df = spark.createDataFrame([(t,) for t in texts], "value string").repartition(7)
    for routes, most in ((1, 10**6), (64, 50)):
        got = {(r["field"], r["term"]): (r["occurrences"], r["records"], r["mark"]) for r in T.term_frequencies([("f", df, T.text_terms)], burst=8, most=most, routes=routes).collect()}
        occ, rec = Counter(), Counter()
        for t in texts:
            occ.update(T.text_terms(t))
            rec.update(set(T.text_terms(t)))
        want = {("f", t): (n, rec[t], "rare" if rec[t] <= 2 else "common" if rec[t] * 5 > len(texts) else None) for t, n in occ.items()}
        assert got == want
    assert T.term_frequencies([("f", df.limit(0), T.text_terms)]).count() == 0


def test_routing_table_splits_dense_prefixes(spark):
    leaves = spark.createDataFrame([("f", "", [f"a{i:05}" for i in range(9000)] + ["b"], [1] * 9001, [1] * 9001, 9001)], "field string, prefix string, term array<string>, occurrences array<bigint>, records array<bigint>, size bigint")
    assert {"", "a"} <= T.routing_table(leaves, 512)["f"]
    assert T.term_counts(leaves, 512).count() == 9001


def test_latest_values(spark):
    df = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("a", None, 3), ("b", None, 1), ("c", "", 1)], "k string, v string, at int")
    assert sorted(r["value"] for r in T.latest_values(df, "k", "v", "at").collect()) == ["", "new"]


def brute(rows, k, least):
    want = set()
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    for a, i in enumerate(ids):
        for b in sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-round(s[a, b], 6), ids[b]))[:k]:
            if s[a, b] >= least:
                want.add((min(i, ids[b]), max(i, ids[b])))
    return want


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = {}
    for base in range(60):
        centre = rng.normal(size=8)
        for j in range(rng.integers(1, 9)):
            rows[len(rows) * 7 % 1009] = (centre + 0.12 * rng.normal(size=8)).tolist()
    copy = rng.normal(size=8)
    rows |= {5000 + i: (copy * (1 + i % 3)).tolist() for i in range(200)}  # a third are copies up to scale
    bad = [(9001, None), (9002, [0.0] * 8), (9003, [1.0] * 7 + [math.nan]), (9004, [1.0] * 3), (9005, [1.0] * 7 + [None])]
    data = [*rows.items(), *list(rows.items())[:20], *bad]
    df = spark.createDataFrame(data, "id bigint, vec array<double>").withColumn("cid", F.lit(1)).repartition(5)
    want = brute(rows, 5, 0.92)
    got = {(r["a"], r["b"]) for r in V.similar_pairs(df, "id", "vec", 5, 0.92, dim=8, leaf=50, sample=256, block=40).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    near = V.most_similar(df, "id", "vec", 5, dim=8, query=F.col("id") % 20 == 0, leaf=10**6).collect()
    by = defaultdict(list)
    for r in near:
        by[r["id"]].append((r["rank"], r["neighbour"]))
    assert by.keys() == {i for i in rows if i % 20 == 0} and all(len(v) == 5 and sorted(n for n, _ in v) == [1, 2, 3, 4, 5] for v in by.values())
    assert [n for _, n in sorted(by[5020])] == [5000, 5001, 5002, 5003, 5004]
    assert V.similar_pairs(df.limit(0), "id", "vec", 5, 0.9, dim=8).count() == 0


def test_parts_are_balanced():
    x = np.random.default_rng(2).normal(size=(600, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = V.balanced_parts(x, V.neighbour_graph(x, 6), 7)
    assert np.bincount(label, minlength=7).max() <= math.ceil(1.1 * 600 / 7)


@pytest.fixture(scope="module")
def encoder():
    if not os.path.exists(ranks_path()):
        pytest.skip("no vocabulary here")
    return B.BytePairEncoder(B.read_ranks(ranks_path()))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_round_trip_and_reference(encoder, text):
    ids = encoder.encode(text)
    assert encoder.decode(ids) == text
    import tiktoken

    plain = tiktoken.Encoding("t", pat_str=B.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    assert ids == plain.encode_ordinary(text)


def test_encoder_on_long_words(encoder):
    word = "abcab" * 40_000
    assert encoder.decode(encoder.encode(word)) == word
    assert encoder.encode(None) == encoder.encode("") == []
    assert len(encoder.encode("<|endoftext|>")) > 1


def test_encode_texts(spark, encoder):
    df = spark.createDataFrame([(1, "Hello world", 0), (2, None, 0), (3, "", 0), (1, "Hello world", 0)], "doc_id bigint, text string, ids int")
    rows = B.encode_texts(df, "doc_id", "text", ranks_path()).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in rows) == sorted([(1, encoder.encode("Hello world"))] * 2 + [(2, []), (3, [])])


def nearest(ids, x, of, k, least=None):
    """Exact neighbours of the rows ``of``, by id."""
    out = {}
    for at in range(0, len(of), 1000):
        s = x[of[at : at + 1000]] @ x.T
        s[np.arange(len(s)), of[at : at + 1000]] = -2
        top = np.argpartition(-s, k, axis=1)[:, :k]
        for i, row in enumerate(top):
            out[int(ids[of[at + i]])] = {int(ids[j]) for j in row if least is None or s[i, j] >= least}
    return out


@pytest.mark.parametrize("options", [{"leaf": 20, "sample": 6000}, {"leaf": 20, "sample": 512}, {"leaf": 100, "sample": 1024, "block": 60}], ids=["300 partitions", "two levels", "blocks"])
def test_recall_in_many_partitions(spark, options):
    """Clustered vectors of 64 dimensions: several hundred partitions, in one level and in two, and partitions cut into blocks."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(300, 64))
    x = np.concatenate([c + rng.uniform(0.02, 0.5) * rng.normal(size=(20, 64)) for c in centres])
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = rng.permutation(10**6)[: len(x)]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id bigint, vec array<double>").repartition(6)
    want = {(min(a, b), max(a, b)) for a, near in nearest(ids, x, np.arange(len(x)), 5, 0.92).items() for b in near}
    got = {(r["a"], r["b"]) for r in V.similar_pairs(df, "id", "vec", 5, 0.92, **options).collect()}
    assert len(want) > 5000 and len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.001 * len(want)
    of = np.flatnonzero(ids % 20 == 0)
    near = defaultdict(set)
    for r in V.most_similar(df, "id", "vec", 5, query=F.col("id") % 20 == 0, **options).collect():
        near[r["id"]].add(r["neighbour"])
    exact = nearest(ids, x, of, 5)
    assert near.keys() == exact.keys() and sum(len(near[i] & exact[i]) for i in exact) >= 0.9 * 5 * len(exact)


def test_recall_on_the_whole_table(spark):
    """The queries over sf0.1, with their own settings, against brute force."""
    from polyvec.llm import queries as Q

    folder = "/root/testdata/sf0.1"
    rows = {r["id"]: np.frombuffer(r["vec"], "<f4") for r in V.unit_vectors(spark.read.parquet(f"{folder}/token_embeddings.parquet"), "token_id", "colbert_flat", 64).collect()}
    ids, x = np.array(list(rows)), np.array(list(rows.values()))
    exact = nearest(ids, x, np.flatnonzero(ids % 20 == 0), 5)
    near = defaultdict(set)
    for r in Q.p5_neighbours(spark, folder).collect():
        near[r["token_id"]].add(r["neighbour"])
    # Copies tie; a neighbour as near as the exact ones counts.
    at = {int(i): n for n, i in enumerate(ids)}
    hit = sum(sum(x[at[i]] @ x[at[j]] >= min(x[at[i]] @ x[at[m]] for m in exact[i]) - 1e-6 for j in near[i]) for i in exact)
    assert near.keys() == exact.keys() and hit >= 0.9 * 5 * len(exact)
    want = {(min(a, b), max(a, b)) for a, n in nearest(ids, x, np.arange(len(x)), 5, 0.92).items() for b in n}
    got = {(r["token_a"], r["token_b"]) for r in Q.p5_found(spark, folder).collect()}
    close = lambda p: x[at[p[0]]] @ x[at[p[1]]] < 1 - 1e-6
    assert len({p for p in want if close(p)} & got) >= 0.99 * len({p for p in want if close(p)})


def test_hot_directions_and_changed_ids(spark):
    """A direction of a third of the rows, ids with two vectors, extra columns with the names used inside."""
    rng = np.random.default_rng(12)
    hot = rng.normal(size=8)
    data = [(i, hot.tolist()) for i in range(1000)] + [(1000 + i, rng.normal(size=8).tolist()) for i in range(2000)] + [(1000, rng.normal(size=8).tolist())] * 2
    df = spark.createDataFrame(data, "id int, vec array<float>").withColumns({"cid": F.lit(1), "h1": F.lit("x"), "n": F.lit(None), "asks": F.lit(True)})
    near = V.most_similar(df, "id", "vec", 3, dim=8).collect()
    by = defaultdict(list)
    for r in near:
        by[r["id"]].append((r["rank"], r["neighbour"]))
    assert len(by) == 3000 and all(len(v) == 3 for v in by.values())
    assert sorted(by[0]) == [(1, 1), (2, 2), (3, 3)] and sorted(by[999]) == [(1, 0), (2, 1), (3, 2)]
    assert df.schema["id"].dataType == V.most_similar(df, "id", "vec", 3, dim=8).schema["neighbour"].dataType


def test_routes_with_long_common_prefixes(spark):
    """Terms that differ only after 30 characters, after more than a prefix may have, or not at all soon enough."""
    for lead in (30, T.LONGEST + 10):
        terms = ["x" * lead + f"{i:06}" for i in range(40_000)] + [f"y{i}" for i in range(5_000)]
        rows = [("f", "", terms[at : at + 3000], [1] * 3000, [1] * 3000, 3000) for at in range(0, 45_000, 3000)] * 2
        leaves = spark.createDataFrame(rows, "field string, prefix string, term array<string>, occurrences array<bigint>, records array<bigint>, size bigint")
        table = T.routing_table(leaves, 64, 5000, 8000)["f"]
        sizes = Counter()
        for t in terms:
            sizes[table.of(t)] += 2
        assert all(n / table.ways.get(r, 1) < 3 * 5000 for r, n in sizes.items())
        assert (max(map(len, sizes)) > 30) and bool(table.ways) == (lead > T.LONGEST)
        counted = T.term_counts(leaves, 64, 5000, 8000)
        assert counted.count() == 45_000 and counted.where("occurrences <> 2 or records <> 2").count() == 0


def test_a_million_terms_that_share_thirty_characters(spark):
    df = spark.range(1_000_000, numPartitions=8).select(F.concat(F.lit("k" * 30), F.lpad(F.col("id").cast("string"), 7, "0")).alias("value"))
    got = T.term_frequencies([("f", df, T.text_terms)], share=50_000)
    assert got.agg(F.count(F.lit(1)), F.sum("records"), F.countDistinct("term")).first() == (1_000_000, 1_000_000, 1_000_000)

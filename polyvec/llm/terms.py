"""Occurrences and records of every distinct term, counted in burst tries.

A worker keeps a trie whose leaves are small tables of (term -> occurrences, records). A leaf that
grows over ``burst`` terms bursts into one leaf per next character, so prefixes get as long as the
data ask for. Leaves are written out as rows (prefix, terms, counts). From a bounded hash sample of
their terms a routing table is made: prefixes, longer where terms are dense, until none holds more than
``share`` entries; one that terms don't differ in soon enough is divided by a hash of the term. So a
route has a size of its own that doesn't grow with the data. Leaves follow the table to the worker of
their route, where matching subtrees are merged by adding counts in a hash aggregate, which can spill.
Nothing is dropped: a single term, however common, comes at most once from each worker's trie.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyvec.plans.shared import checkpoint

TERM = re.compile("[a-z0-9]+")


def text_terms(text: str) -> list[str]:
    """The longest runs of a-z and 0-9 in the lower-cased text."""
    return TERM.findall(text.lower())


def id_terms(ids: list) -> list[str]:
    """Ids in decimal; null ids are no terms."""
    return [str(i) for i in ids if i is not None]


class BurstTrie:
    """Counters by term: inner nodes branch on one character, leaves are tables."""

    def __init__(self, burst: int = 2048) -> None:
        self.burst, self.root, self.size = burst, {}, 0
        self.inner: set[int] = set()

    def _leaf(self, term: str) -> tuple[dict, int]:
        node, depth = self.root, 0
        while id(node) in self.inner:
            char = term[depth : depth + 1]
            depth += 1
            if not char:
                return node.setdefault("", {}), depth
            node = node.setdefault(char, {})
        return node, depth

    def add(self, term: str, occurrences: int, records: int) -> None:
        leaf, depth = self._leaf(term)
        if (old := leaf.get(term)) is not None:
            old[0] += occurrences
            old[1] += records
            return
        leaf[term] = [occurrences, records]
        self.size += 1
        if len(leaf) > self.burst:
            self._burst(leaf, depth)

    def _burst(self, leaf: dict, depth: int) -> None:
        held = dict(leaf)
        leaf.clear()
        self.inner.add(id(leaf))
        for term, counts in held.items():
            leaf.setdefault(term[depth : depth + 1], {})[term] = counts

    def leaves(self) -> Iterator[tuple[str, dict]]:
        stack = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if id(node) in self.inner:
                stack += [(prefix + char, child) for char, child in node.items()]
            elif node:
                yield prefix, node


LEAF = pa.schema([("field", pa.string()), ("prefix", pa.string()), ("term", pa.list_(pa.string())), ("occurrences", pa.list_(pa.int64())), ("records", pa.list_(pa.int64())), ("size", pa.int64())])


def _count_leaves(df: DataFrame, field: str, value: str, terms: Callable[[object], list[str]], burst: int, most: int) -> DataFrame:
    """Leaves of the tries of all tasks, and per flush one row with a null prefix that has the number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, records = BurstTrie(burst), 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(trie.leaves())
            for at in range(0, len(rows), 64):
                part = rows[at : at + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([field] * len(part)), pa.array([p for p, _ in part]), pa.array([list(t) for _, t in part], pa.list_(pa.string())),
                     pa.array([[c[0] for c in t.values()] for _, t in part], pa.list_(pa.int64())), pa.array([[c[1] for c in t.values()] for _, t in part], pa.list_(pa.int64())), pa.array([len(t) for _, t in part], pa.int64())], schema=LEAF)
            yield pa.RecordBatch.from_arrays([pa.array([field]), pa.array([None], pa.string()), pa.array([None], pa.list_(pa.string())), pa.array([None], pa.list_(pa.int64())), pa.array([None], pa.list_(pa.int64())), pa.array([records], pa.int64())], schema=LEAF)

        for batch in batches:
            occurrences, holding = Counter(), Counter()
            for value in batch.column(0):
                found = Counter(terms(value.as_py()))
                occurrences.update(found)
                holding.update(found.keys())
            for term, n in occurrences.items():
                trie.add(term, n, holding[term])
            records += batch.num_rows
            if trie.size > most:
                yield from flush()
                trie, records = BurstTrie(burst), 0
        yield from flush()

    return df.select(value).mapInArrow(run, "field string, prefix string, term array<string>, occurrences array<bigint>, records array<bigint>, size bigint")


LONGEST = 64  # characters of a prefix


class Routes(set):
    """The prefixes of one field that are divided by the next character; ``ways`` has those divided by a hash of the term, and in how many."""

    ways: dict[str, int]

    @classmethod
    def grown(cls, terms: list[str], weight: float, share: int) -> Routes:
        """From a sample of the terms, each of which stands for ``weight``."""
        self = cls()
        self.ways = {}
        terms.sort()
        waiting = [("", 0, len(terms))]
        while waiting:
            prefix, a, b = waiting.pop()
            size, depth = (b - a) * weight, len(prefix)
            if size <= share:
                continue
            if depth >= LONGEST or b - a < 8:
                self.ways[prefix] = math.ceil(size / share)
                continue
            self.add(prefix)
            while a < b and len(terms[a]) == depth:
                a += 1  # the prefix itself
            while a < b:
                child = terms[a][: depth + 1]
                end = bisect.bisect_left(terms, child[:-1] + chr(ord(child[-1]) + 1), a, b)
                waiting.append((child, a, end))
                a = end
        return self

    def of(self, term: str) -> str:
        depth = 0
        while depth < len(term) and term[:depth] in self:
            depth += 1
        return term[:depth]

    def of_leaf(self, prefix: str) -> str | None:
        """The route of all terms with a prefix, if it is one."""
        route = self.of(prefix)
        return None if route == prefix and route in self else route


def routing_table(leaves: DataFrame, routes: int = 512, share: int = 1_000_000, sketched: int = 200_000) -> dict[str, Routes]:
    """Per field its ``Routes``, from about ``sketched`` hashed terms a field. Two jobs, whatever the depth.

    A route holds at most about ``share`` entries, and of a smaller field a ``routes``-th, though 4,096 at least.
    """
    filled = leaves.where("prefix is not null")
    total = {r["field"]: r["n"] for r in filled.groupBy("field").agg(F.sum("size").alias("n")).collect()}
    limit = {f: min(share, max(4096, n // routes)) for f, n in total.items()}
    wanted = {f: min(1.0, sketched / n) for f, n in total.items() if n > limit[f]}
    if not wanted:
        return {}
    rate = F.create_map(*[x for f, r in wanted.items() for x in (F.lit(f), F.lit(int(r * 1_000_000)))])
    terms = filled.where(F.col("field").isin(list(wanted))).select("field", F.explode("term").alias("term")).where(F.pmod(F.xxhash64("term"), F.lit(1_000_000)) < rate[F.col("field")])
    drawn: dict[str, list[str]] = {f: [] for f in wanted}
    for r in terms.select("field", F.substring("term", 1, LONGEST + 1).alias("term")).collect():
        drawn[r["field"]].append(r["term"])
    return {f: Routes.grown(found, total[f] / max(1, len(found)), limit[f]) for f, found in drawn.items()}


def term_counts(leaves: DataFrame, routes: int = 512, share: int = 1_000_000, sketched: int = 200_000) -> DataFrame:
    """``(field, term, occurrences, records)``: leaves routed by adaptive prefix, matching subtrees merged."""
    table = routing_table(leaves, routes, share, sketched)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                known = table.get(batch.column(0)[i].as_py())
                columns = [batch.column(c)[i].values for c in (2, 3, 4)]
                n = len(columns[0])
                whole = "" if known is None else known.of_leaf(batch.column(1)[i].as_py())
                names = [whole] * n if whole is not None else [known.of(t) for t in columns[0].to_pylist()]
                ways = [1 if known is None else known.ways.get(r, 1) for r in ([whole] if whole is not None else names)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * n), pa.array(names, pa.string()), pa.array(ways * n if whole is not None else ways, pa.int64()), *columns], names=["field", "route", "ways", "term", "occurrences", "records"])

    routed = leaves.where("prefix is not null").select("field", "prefix", "term", "occurrences", "records").mapInArrow(route, "field string, route string, ways bigint, term string, occurrences bigint, records bigint")
    placed = routed.withColumn("way", F.pmod(F.xxhash64("term"), F.col("ways")))
    keys = ["field", "route", "way"]
    return placed.repartition(*keys).groupBy(*keys, "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).drop("route", "way")


def latest_values(df: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """``(value)`` of every distinct key with a non-null value: the value of the latest row, the greatest of equal times."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("value"), F.col(at).alias("at"))
    return rows.groupBy("key").agg(F.max(F.struct("at", "value")).alias("m")).select(F.col("m.value").alias("value"))


def term_frequencies(fields: list[tuple[str, DataFrame, Callable]], rare: int = 2, common: float = 0.2, burst: int = 2048, most: int = 400_000, routes: int = 512, share: int = 1_000_000, sketched: int = 200_000) -> DataFrame:
    """``(field, term, occurrences, records, mark)`` over several fields.

    ``fields`` has a name, a table with one row ``value`` per record, and a function from a value to its
    terms. ``mark`` is ``rare`` for terms in at most ``rare`` records, ``common`` for others in more
    than the share ``common`` of the field's records, else null. Empty values are records without
    terms; null values must have been left out. A term that a record holds twice counts as two
    occurrences and one record. An empty table gives no row.
    """
    parts = [_count_leaves(df, name, "value", terms, burst, most) for name, df, terms in fields]
    leaves = parts[0]
    for p in parts[1:]:
        leaves = leaves.unionByName(p)
    leaves = checkpoint(leaves)
    total = leaves.where("prefix is null").groupBy("field").agg(F.sum("size").alias("n"))
    counts = {r["field"]: r["n"] for r in total.collect()}  # one number a field
    limit = F.create_map(*[x for f, n in counts.items() for x in (F.lit(f), F.lit(n))]) if counts else F.create_map(F.lit(""), F.lit(0))
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > limit[F.col("field")] * F.lit(common), "common")
    return term_counts(leaves, routes, share, sketched).withColumn("mark", mark)

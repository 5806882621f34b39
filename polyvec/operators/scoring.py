"""Scoring of queries against documents: dense, late interaction, sparse, fusions.

Scores are rounded before anything is ranked by them, so that ties don't depend on the order of
addition. A query side of a counted size up to ``BLOCK_FLOATS`` is broadcast and the documents stream
past it. A larger one meets the documents in cells on the workers: both sides are cut into blocks, every
pair of blocks is one group, and no side comes to the driver. Kernels multiply blocks; with ``k`` a task
keeps only the k best of what it has seen, so that little is shuffled however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from polyvec.operators.ordered import running

BLOCK_FLOATS = 4_000_000  # numbers of one side in one block


def _blocks(queries: DataFrame, dim: int, floats: int = BLOCK_FLOATS) -> list[DataFrame]:
    """The query side in parts of a bounded size, from a count of its vectors; several parts are met in cells."""
    n = queries.count()
    parts = max(1, -(-n * dim // floats))
    return [queries] if parts == 1 else [queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == b) for b in range(parts)]


def _kind(df: DataFrame, name: str = "id") -> str:
    return df.schema[name].dataType.simpleString()


class Best:
    """The k best documents of each query so far, by rounded score, then id. Minus infinity is no score.

    What beats a query's k-th best waits in arrays; these are sorted and cut once they are as many as what is held.
    """

    def __init__(self, queries: pa.Array, k: int) -> None:
        self.queries, self.k = queries, k
        self.docs: list[pa.Array] = []
        self.seen = self.waiting = 0
        self.edge = np.full(len(queries), -np.inf)
        self.held = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))  # query, score, document in order of arrival
        self.more: list[tuple] = []

    def add(self, scores: np.ndarray, ids: pa.Array, exclude_self: bool) -> None:
        if exclude_self and ids.type == self.queries.type:
            own = pc.index_in(ids, value_set=self.queries)
            at = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
            scores[own.take(pa.array(at)).to_numpy(), at] = -np.inf
        edge = self.edge
        if scores.shape[1] > 2 * self.k and np.isneginf(edge).any():
            edge = np.maximum(edge, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])
        q, d = np.nonzero((scores >= edge[:, None]) & (scores != -np.inf))
        self.more.append((q, scores[q, d], d + self.seen))
        self.docs.append(ids)
        self.seen += len(ids)
        self.waiting += len(q)
        if self.waiting > max(500_000, len(self.held[0])):
            self._cut()

    def _cut(self) -> None:
        q, s, d = map(np.concatenate, zip(self.held, *self.more))
        ids = pa.chunked_array(self.docs).combine_chunks() if self.docs else pa.nulls(0, pa.int64())
        place = np.empty(len(ids), np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))  # document ids are different
        order = np.lexsort((place[d], -s, q))
        q, s, d = q[order], s[order], d[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        last = np.flatnonzero(rank == self.k - 1)
        self.edge[q[last]] = s[last]
        self.held, self.more, self.waiting = (q[top], s[top], d[top]), [], 0

    def rows(self, d_type: pa.DataType) -> pa.RecordBatch:
        self._cut()
        q, s, d = self.held
        ids = pa.chunked_array(self.docs, d_type).combine_chunks() if self.docs else pa.nulls(0, d_type)
        return pa.RecordBatch.from_arrays([self.queries.take(pa.array(q)), ids.take(pa.array(d)), pa.array(s + 0.0)], names=["query_id", "doc_id", "score"])


class _Side:
    """Items of a query block: ``id``, and ``flat`` vectors (bags of ``dim`` numbers each), ``terms`` and ``weights``, or both."""

    def __init__(self, table: pa.Table | pa.RecordBatch, dim: int) -> None:
        names = table.schema.names
        column = lambda n: table.column(n).combine_chunks() if isinstance(table, pa.Table) else table.column(n)
        self.ids = column("id")
        if "flat" in names:
            self.matrix, self.sizes = _bags(column("flat"), dim)
            self.starts = np.cumsum(self.sizes) - self.sizes
        if "terms" in names:
            terms, weights = column("terms"), column("weights")
            owner = np.repeat(np.arange(len(terms)), _lengths(terms))
            coded = terms.flatten().dictionary_encode()
            order = np.argsort(coded.indices.to_numpy(), kind="stable")
            self.terms = coded.dictionary
            self.owner, self.weight = owner[order], weights.flatten().to_numpy(zero_copy_only=False)[order]
            self.first = np.searchsorted(coded.indices.to_numpy()[order], np.arange(len(self.terms) + 1))


def _lengths(lists: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), np.int64)


def _bags(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(-1, dim), _lengths(lists) // dim


class Kernel:
    """Scores of a block of queries with some documents, rounded. ``alpha``: of the sparse part where there are both; ``levels``: scores
    farther than ``band`` from all of them are none."""

    def __init__(self, dim: int = 0, sparse: bool = False, alpha: float = 1.0, digits: int = 6, levels: tuple[float, ...] = (), band: float = 0.0) -> None:
        self.dim, self.sparse, self.alpha, self.digits, self.levels, self.band = dim, sparse, alpha, digits, levels, band

    def columns(self) -> list[str]:
        return ["id", *(["flat"] if self.dim else []), *(["terms", "weights"] if self.sparse else [])]

    def scores(self, side: _Side, docs: pa.RecordBatch) -> np.ndarray:
        out = None
        if self.dim:
            flat, sizes = _bags(docs.column(docs.schema.names.index("flat")), self.dim)
            product = side.matrix @ flat.T
            if len(flat) > docs.num_rows:
                product = np.maximum.reduceat(product, np.cumsum(sizes) - sizes, axis=1)
            if len(product) > len(side.ids):
                product = np.add.reduceat(product, side.starts, axis=0)
            out = np.round(product, self.digits)
        if self.sparse:
            lex = self._products(side, docs)
            out = lex if out is None else np.round(out + self.alpha * np.where(lex == -np.inf, 0.0, lex), 9)
        if self.levels:
            near = np.min([np.abs(out - x) for x in self.levels], axis=0)
            out = np.where(near <= self.band + 1e-6, out, -np.inf)
        return out

    def _products(self, side: _Side, docs: pa.RecordBatch) -> np.ndarray:
        """Sums over shared terms by looking a document's terms up among the queries' postings; minus infinity where none is shared."""
        terms, weights = (docs.column(docs.schema.names.index(n)) for n in ("terms", "weights"))
        doc = np.repeat(np.arange(docs.num_rows), _lengths(terms))
        at = pc.fill_null(pc.index_in(terms.flatten(), value_set=side.terms), -1).to_numpy(zero_copy_only=False)
        known = at >= 0
        at, doc, weight = at[known], doc[known], weights.flatten().to_numpy(zero_copy_only=False)[known]
        n, out = len(side.ids), np.full((docs.num_rows, len(side.ids)), -np.inf)
        bounds = np.searchsorted(doc, np.arange(docs.num_rows + 1))
        for d in range(docs.num_rows):
            a, b = bounds[d], bounds[d + 1]
            if a == b:
                continue
            counts = side.first[at[a:b] + 1] - side.first[at[a:b]]
            index = np.repeat(side.first[at[a:b]] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            owner = side.owner[index]
            row = np.bincount(owner, side.weight[index] * np.repeat(weight[a:b], counts), n)
            hit = np.zeros(n, bool)
            hit[owner] = True
            out[d, hit] = np.round(row[hit], self.digits)
        return out.T


def _streamed(kernel: Kernel, side: _Side, batches: Iterator[pa.RecordBatch], k: int | None, exclude_self: bool, d_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    n = len(side.ids)
    if not n:
        return
    best = Best(side.ids, k) if k is not None else None
    step = max(1, min(4096, 4_000_000 // max(n, len(getattr(side, "matrix", ())))))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            scores = kernel.scores(side, piece)
            if best:
                best.add(scores, piece.column(0), exclude_self)
                continue
            q, d = np.nonzero(scores.T != -np.inf)[::-1]
            q_ids, d_ids = side.ids.take(pa.array(q)), piece.column(0).take(pa.array(d))
            out = pa.RecordBatch.from_arrays([q_ids, d_ids, pa.array(scores[q, d] + 0.0)], names=["query_id", "doc_id", "score"])
            yield out.filter(pc.not_equal(q_ids, d_ids)) if exclude_self and q_ids.type == d_ids.type else out
    if best:
        yield best.rows(d_type)


def block_scores(kernel: Kernel, queries: DataFrame, docs: DataFrame, k: int | None = None, exclude_self: bool = False, query_blocks: int = 1, doc_blocks: int = 1) -> DataFrame:
    """``(query_id, doc_id, score)``: the ``k`` best per query and task, or all pairs.

    Both sides have an ``id`` and the kernel's columns. One query block is broadcast; the caller has
    counted it. Several, and as many blocks of documents as asked for, meet in cells.
    """
    schema = f"query_id {_kind(queries)}, doc_id {_kind(docs)}, score double"
    d_type = to_arrow_type(docs.schema["id"].dataType)
    columns = kernel.columns()
    queries, docs = queries.select(*columns), docs.select(*columns)
    if query_blocks == 1:
        held = docs.sparkSession.sparkContext.broadcast(queries.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _streamed(kernel, _Side(held.value, kernel.dim), batches, k, exclude_self, d_type)

        return docs.mapInArrow(run, schema)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.lit(True).alias("asks"), block(query_blocks).alias("q"), every(doc_blocks).alias("d"), F.col("id").alias("q_id"), F.lit(None).cast(_kind(docs)).alias("d_id"), *columns[1:])
    right = docs.select(F.lit(False).alias("asks"), every(query_blocks).alias("q"), block(doc_blocks).alias("d"), F.lit(None).cast(_kind(queries)).alias("q_id"), F.col("id").alias("d_id"), *columns[1:])

    def cell(table: pa.Table) -> pa.Table:
        mine = lambda asks, name: table.filter(table.column("asks") if asks else pc.invert(table.column("asks"))).select([name, *columns[1:]]).rename_columns(columns)
        found = list(_streamed(kernel, _Side(mine(True, "q_id"), kernel.dim), mine(False, "d_id").combine_chunks().to_batches(), k, exclude_self, d_type))
        empty = pa.schema([("query_id", table.schema.field("q_id").type), ("doc_id", table.schema.field("d_id").type), ("score", pa.float64())])
        return pa.Table.from_batches(found, empty) if found else empty.empty_table()

    return left.unionByName(right).groupBy("q", "d").applyInArrow(cell, schema)


def _in_blocks(kernel: Kernel, queries: DataFrame, docs: DataFrame, k: int | None, exclude_self: bool, counted: DataFrame, dim: int) -> DataFrame:
    """``counted`` has a row for each ``dim`` numbers of the query side."""
    parts = len(_blocks(counted, dim))
    return block_scores(kernel, queries, docs, k, exclude_self, parts, parts if parts == 1 else max(1, -(-docs.count() * dim // BLOCK_FLOATS)))


def dense_scores(queries: DataFrame, docs: DataFrame, k: int | None = None, exclude_self: bool = False, digits: int = 6, dim: int = 64) -> DataFrame:
    """Dot products of ``(id, vec)`` with ``(id, vec)``, rounded to ``digits``; the ``k`` best per query and task if given."""
    q, d = (t.select("id", F.col("vec").alias("flat")) for t in (queries, docs))
    return _in_blocks(Kernel(dim, digits=digits), q, d, k, exclude_self, q, dim)


def dense_band(vectors: DataFrame, levels: tuple[float, ...], band: float, dim: int = 64) -> DataFrame:
    """Pairs of ``vectors``, each with each, whose dot product lies within ``band`` of a level; others don't leave the kernel."""
    v = vectors.select("id", F.col("vec").alias("flat"))
    return _in_blocks(Kernel(dim, levels=levels, band=band), v, v, None, True, v, dim)


def bags(vectors: DataFrame) -> DataFrame:
    """``(id, flat)``: the vectors of each bag ``(id, pos, vec)`` in order, gathered once (bags are short)."""
    return vectors.groupBy("id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "vec"))), lambda e: e["vec"])).alias("flat"))


def maxsim_scores(queries: DataFrame, docs: DataFrame, k: int | None = None, digits: int = 6, dim: int = 64, exclude_self: bool = False) -> DataFrame:
    """Sum over a query's vectors of the best dot product with any of a document's; bags are ``(id, pos, vec)``. All of a query's vectors lie in one block."""
    return _in_blocks(Kernel(dim, digits=digits), bags(queries), bags(docs), k, exclude_self, queries, dim)


def term_lists(postings: DataFrame) -> DataFrame:
    """``(id, terms, weights)`` of ``(id, term, weight)``, with ``weights2`` if there is a ``weight2``."""
    names = [c for c in ("weight", "weight2") if c in postings.columns]
    one = postings.groupBy("id").agg(F.collect_list(F.struct("term", *[F.col(c).cast("double").alias(c) for c in names])).alias("p"))
    return one.select("id", F.col("p.term").alias("terms"), *[F.col(f"p.{c}").alias(c.replace("weight", "weights")) for c in names])


HELD = 6_000_000  # postings of documents that a task searches at once


class _Asked:
    """Queries with their terms as numbers of ``terms``."""

    def __init__(self, table: pa.Table | pa.RecordBatch) -> None:
        column = lambda n: table.column(n).combine_chunks() if isinstance(table, pa.Table) else table.column(n)
        lists = column("terms")
        coded = lists.flatten().dictionary_encode()
        self.ids, self.terms, self.codes = column("id"), coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).tolist()
        self.weights = column("weights").flatten().to_numpy(zero_copy_only=False).tolist()
        self.bounds = np.concatenate([[0], np.cumsum(_lengths(lists))]).tolist()


def _best_of(scores: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Places of at least the ``k`` largest of ``scores`` above minus infinity, and of all that lie less than ``slack`` under the ``k``-th.

    The k-th of the maxima of 64 lanes is at most the k-th of all, so that few places are looked at. The length is a multiple of 64.
    """
    lanes = scores.reshape(64, -1).max(0)
    low = np.partition(lanes, len(lanes) - k)[-k] - slack if len(lanes) >= k else -np.inf
    return np.flatnonzero(scores >= low) if low > -np.inf else np.flatnonzero(scores > -np.inf)


def _searched(asked: _Asked, held: list[tuple], wants: list[tuple[float, float, int]], digits: int, exclude_self: bool, d_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The best of what is held, a query at a time along the postings of its terms."""
    ids = pa.chunked_array([h[0] for h in held], d_type).combine_chunks()
    order, n = pc.sort_indices(ids).to_numpy(), len(ids)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    ids = ids.take(pa.array(order))  # documents in order of id, as ties go
    starts = np.cumsum([0, *(len(h[0]) for h in held)])
    doc = place[np.concatenate([h[1] + at for h, at in zip(held, starts)])]
    code = np.concatenate([h[2] for h in held])
    by = np.argsort(code * n + doc)
    doc, first = doc[by], np.searchsorted(code[by], np.arange(len(asked.terms) + 1)).tolist()
    weights = [np.concatenate([h[3][i] for h in held])[by] for i in range(len(held[0][3]))]
    del code, by, place, order
    signed = min([0.0 if not len(w) else w.min() for w in weights]) < 0 or min(asked.weights, default=0.0) < 0 or any((w == 0).any() for w in weights) or 0.0 in asked.weights
    size = -(-n // 64) * 64
    sums, hit, score = [np.zeros(size) for _ in weights], np.zeros(size, bool), np.empty(size)
    own = pc.fill_null(pc.index_in(asked.ids, value_set=ids), -1).to_numpy() if exclude_self and asked.ids.type == ids.type else None
    slack = 4 * 10.0**-digits
    found: list[tuple] = []
    waiting = 0

    def rows() -> pa.RecordBatch:
        q = np.repeat(np.array([f[0] for f in found]), [len(f[2]) for f in found])
        w = np.repeat(np.array([f[1] for f in found], np.int32), [len(f[2]) for f in found])
        parts = [np.concatenate([f[i] for f in found]) for i in (2, 3, 4)]
        return pa.RecordBatch.from_arrays([pa.array(w), asked.ids.take(pa.array(q)), ids.take(pa.array(parts[0])), pa.array(parts[1] + 0.0), pa.array(parts[2] + 0.0)], names=["want", "query_id", "doc_id", "score", "second"])

    for q in range(len(asked.ids)):
        some = False
        for c, w in zip(asked.codes[asked.bounds[q] : asked.bounds[q + 1]], asked.weights[asked.bounds[q] : asked.bounds[q + 1]]):
            lo, hi = first[c], first[c + 1]
            if lo < hi:
                some, at = True, doc[lo:hi]
                for total, weight in zip(sums, weights):
                    np.add.at(total, at, weight[lo:hi] if w == 1.0 else weight[lo:hi] * w)
                if signed:
                    hit[at] = True
        if not some:
            continue
        if own is not None and own[q] >= 0:
            hit[own[q]] = False
            for total in sums:
                total[own[q]] = 0.0
        for want, (x, y, k) in enumerate(wants):
            if y == 0.0:
                mixed = sums[0]
            elif x == 0.0:
                mixed = sums[1]
            else:
                mixed = np.multiply(sums[1], y, out=score)
                mixed += sums[0] if x == 1.0 else x * sums[0]
            if signed:
                at = _best_of(np.where(hit, mixed, -np.inf), k, slack * (1 + abs(x) + abs(y)))
            else:
                at = _best_of(mixed, k, slack * (1 + abs(x) + abs(y)))
                at = at[sums[0][at] > 0]
            parts = [np.round(total[at], digits) for total in sums]
            got = parts[0] if (x, y) == (1.0, 0.0) else np.round(x * parts[0] + y * parts[1], 9)
            if len(at) > k:
                edge = np.partition(got, len(got) - k)[-k]
                over = np.flatnonzero(got > edge)
                pick = np.concatenate([over, np.flatnonzero(got == edge)[: k - len(over)]])
                at, got, parts = at[pick], got[pick], [p[pick] for p in parts]
            found.append((q, want, at, got, parts[-1]))
            waiting += len(at)
        for total in sums:
            total.fill(0.0)
        if signed:
            hit.fill(False)
        if waiting > 200_000:
            yield rows()
            found, waiting = [], 0
    if found:
        yield rows()


def _ranked(asked: _Asked, batches: Iterator[pa.RecordBatch], names: list[str], wants: list[tuple[float, float, int]], digits: int, exclude_self: bool, d_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 10_000):
            piece = batch.slice(start, 10_000)
            lists, *weights = (piece.column(piece.schema.names.index(n)) for n in ["terms", *names])
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=asked.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = at >= 0
            doc = np.repeat(np.arange(piece.num_rows), _lengths(lists))[known]
            held.append((piece.column(0), doc, at[known], [w.flatten().to_numpy(zero_copy_only=False)[known] for w in weights]))
            size += len(doc)
            if size >= HELD:
                yield from _searched(asked, held, wants, digits, exclude_self, d_type)
                held, size = [], 0
    if size:
        yield from _searched(asked, held, wants, digits, exclude_self, d_type)


def sparse_best(queries: DataFrame, docs: DataFrame, wants: list[tuple[float, float, int]], exclude_self: bool = False, digits: int = 6) -> DataFrame:
    """``(want, query_id, doc_id, score, second)``: for each of ``wants`` ``(x, y, k)`` the ``k`` best per query and task by x * the sum of
    ``weight`` products + y * that of ``weight2``, both rounded to ``digits``; ``second`` is the last of these two sums. ``y`` other than 0 needs a ``weight2``.

    Every task holds its share of the documents, as many as there are cores, and goes through all queries: a query costs the
    postings of its terms, and no row is written for other pairs. Postings of terms that no query has are left out before, by a
    broadcast of the terms where the query side is counted as one block; several blocks of queries meet the documents in cells.
    """
    parts = max(1, -(-queries.count() * 2 // BLOCK_FLOATS))
    asked = queries.select("term").distinct()
    kept = docs.join(F.broadcast(asked) if parts == 1 else asked, "term", "left_semi")
    q_kind, d_kind, d_type = _kind(queries), _kind(docs), to_arrow_type(docs.schema["id"].dataType)
    schema = f"want int, query_id {q_kind}, doc_id {d_kind}, score double, second double"
    names = [c.replace("weight", "weights") for c in ("weight", "weight2") if c in docs.columns]
    q = term_lists(queries.select("id", "term", "weight"))
    if parts == 1:
        spread = kept.repartition(docs.sparkSession.sparkContext.defaultParallelism, "id")
        held = docs.sparkSession.sparkContext.broadcast(q.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _ranked(_Asked(held.value), batches, names, wants, digits, exclude_self, d_type)

        return term_lists(spread).mapInArrow(run, schema)
    d, cells = term_lists(kept), max(1, -(-kept.count() * 2 // BLOCK_FLOATS))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select(F.lit(True).alias("asks"), block(parts).alias("q"), every(cells).alias("d"), F.col("id").alias("q_id"), F.lit(None).cast(d_kind).alias("d_id"), "terms", "weights", *[F.lit(None).cast("array<double>").alias(n) for n in names[1:]])
    right = d.select(F.lit(False).alias("asks"), every(parts).alias("q"), block(cells).alias("d"), F.lit(None).cast(q_kind).alias("q_id"), F.col("id").alias("d_id"), "terms", *names)

    def cell(table: pa.Table) -> pa.Table:
        mine = lambda asks, name: table.filter(table.column("asks") if asks else pc.invert(table.column("asks"))).select([name, "terms", *names]).rename_columns(["id", "terms", *names])
        found = list(_ranked(_Asked(mine(True, "q_id")), iter(mine(False, "d_id").combine_chunks().to_batches()), names, wants, digits, exclude_self, d_type))
        empty = pa.schema([("want", pa.int32()), ("query_id", table.schema.field("q_id").type), ("doc_id", table.schema.field("d_id").type), ("score", pa.float64()), ("second", pa.float64())])
        return pa.Table.from_batches(found, empty) if found else empty.empty_table()

    return left.unionByName(right).groupBy("q", "d").applyInArrow(cell, schema)


def sparse_topk(queries: DataFrame, docs: DataFrame, k: int, exclude_self: bool = False, digits: int = 6, alpha: float | None = None) -> DataFrame:
    """The ``k`` best of ``sparse_scores`` per query and task, without a row per matching pair.

    With ``alpha`` the documents have a ``weight2`` too, and the best are those by the one score + ``alpha`` * the other, as ``hybrid`` of both.
    """
    return sparse_best(queries, docs, [(1.0, alpha or 0.0, k)], exclude_self, digits).select("query_id", "doc_id", "score")


# Numbers of one side of a cell, rows and columns of a tile of scores, share of pairs above which a shared term is a column of the product.
CELL, ROWS, COLS, OFTEN = 24_000_000, 1024, 4096, 0.0004


class _Items:
    """One side of a cell in order of id: vectors, and terms as columns of the product (``often``) or postings (``rare``)."""

    def __init__(self, parts: list[tuple[pa.Array, np.ndarray, np.ndarray]], kind: pa.DataType, dim: int) -> None:
        ids = pa.chunked_array([x[0] for x in parts], kind).combine_chunks()
        self.order, self.n, self.dim = pc.sort_indices(ids).to_numpy(), len(ids), dim
        self.ids = ids.take(pa.array(self.order))
        flat = np.concatenate([np.empty(0), *(x[1] for x in parts)]).reshape(self.n, dim)
        self.flat, self.lengths = flat[self.order], np.concatenate([np.empty(0, np.int64), *(x[2] for x in parts)])

    def code(self, codes: np.ndarray, weights: np.ndarray, column: np.ndarray) -> None:
        place = np.empty(self.n, np.int64)
        place[self.order] = np.arange(self.n)
        row = np.repeat(place, self.lengths)
        by = np.argsort(row, kind="stable")
        row, codes, weights = row[by], codes[by], weights[by]
        self.size = np.sqrt((self.flat * self.flat).sum(1)), np.sqrt(np.bincount(row, weights * weights, self.n))
        often = column[codes] >= 0
        self.columns = self.dim + int(column.max(initial=-1)) + 1
        self.often, self.rare = [(r := row[keep], x[keep], weights[keep], np.searchsorted(r, np.arange(self.n + 1))) for keep, x in ((often, column[codes] + self.dim), (column[codes] == -1, codes))]

    def matrix(self, a: int, b: int) -> np.ndarray:
        out = np.zeros((b - a, self.columns))
        out[:, : self.dim] = self.flat[a:b]
        row, column, weight, first = self.often
        at = slice(first[a], first[b])
        out[row[at] - a, column[at]] = weight[at]
        return out

    def postings(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, code, weight, first = self.rare
        at = slice(first[a], first[b])
        by = np.argsort(code[at], kind="stable")
        return row[at][by] - a, code[at][by], weight[at][by]


def _tiled(q: _Items, d: _Items, terms: int, k: int, alpha: float, exclude_self: bool, digits: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of a cell. A product in single precision leaves out what lies below a query's k-th best by more than its error; the rest is scored in double.

    Without vectors only pairs that share a term count; if a weight may be 0 or less, there must be no columns then.
    """
    dim, lexical = q.dim, not q.dim
    signed = lexical and any((w <= 0).any() for w in (q.often[2], q.rare[2], d.often[2], d.rare[2]))
    best, where = np.full((q.n, k), -np.inf), np.full((q.n, k), -1)
    more = np.full((q.n, k), 0.0), np.full((q.n, k), 0.0)
    a = 1.0 if lexical else alpha
    error = 6e-8 * (q.columns + 300) * (q.size[0] * d.size[0].max(initial=0) + abs(a) * q.size[1] * d.size[1].max(initial=0)) + 3 * 10.0**-digits * (1 + abs(a))
    own = pc.fill_null(pc.index_in(d.ids, value_set=q.ids), -1).to_numpy() if exclude_self and q.ids.type == d.ids.type else None
    slot, tile = np.zeros(ROWS * COLS, np.int32), np.empty(ROWS * COLS, np.float32)
    for d0 in range(0, d.n, COLS):
        d1 = min(d0 + COLS, d.n)
        dm, (dr, dc, dw), wide = d.matrix(d0, d1), d.postings(d0, d1), d1 - d0
        right = np.ascontiguousarray(dm.T, np.float32)
        for q0 in range(0, q.n, ROWS):
            q1 = min(q0 + ROWS, q.n)
            qm, (qr, qc, qw), rows = q.matrix(q0, q1), q.postings(q0, q1), q1 - q0
            left = qm.astype(np.float32)
            left[:, dim:] *= a
            s = tile[: rows * wide]
            grid = np.matmul(left, right, out=s.reshape(rows, wide))
            times = np.bincount(qc, minlength=terms)
            start, counts = np.cumsum(times) - times, times[dc]
            at = np.repeat(start[dc] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            pair, both = qr[at] * wide + np.repeat(dr, counts), qw[at] * np.repeat(dw, counts)
            np.add.at(s, pair, (a * both).astype(np.float32))
            if own is not None:
                mine = own[d0:d1] - q0
                c = np.flatnonzero((mine >= 0) & (mine < rows))
                grid[mine[c], c] = -np.inf
            edge = best[q0:q1, -1] - error[q0:q1]
            lanes = wide // 16
            if lanes >= k and not signed and np.isneginf(edge).any():
                most = grid[:, : lanes * 16].reshape(rows, 16, lanes).max(1)
                edge = np.maximum(edge, np.partition(most, lanes - k, axis=1)[:, lanes - k] - 2 * error[q0:q1])
            if lexical and not signed:
                edge = np.maximum(edge, 1e-30)
            found = np.flatnonzero(grid >= np.maximum(edge, -1e30).astype(np.float32)[:, None])
            if not len(found):
                continue
            slot[found] = np.arange(1, len(found) + 1)
            inside = slot[pair]
            lex = np.bincount(inside, both, len(found) + 1)[1:].astype(np.float64)  # of no pair at all it would be integers
            shared = np.bincount(inside, minlength=len(found) + 1)[1:] if signed else None
            slot[found] = 0
            fq, fd = found // wide, found % wide
            dense = np.zeros(len(found))
            for x in range(0, len(found), 8192):
                one, two = qm[fq[x : x + 8192]], dm[fd[x : x + 8192]]
                if dim:
                    dense[x : x + 8192] = np.einsum("ij,ij->i", one[:, :dim], two[:, :dim])
                lex[x : x + 8192] += np.einsum("ij,ij->i", one[:, dim:], two[:, dim:])
            dense, lex = np.round(dense, digits), np.round(lex, digits)
            score = lex if lexical else np.round(dense + alpha * lex, 9)
            good = shared > 0 if signed else score >= best[q0 + fq, -1]
            fq, fd, score, dense, lex = (x[good] for x in (fq, fd, score, dense, lex))
            some = np.unique(fq)
            if not len(some):
                continue
            own_rows = q0 + some
            eq = np.concatenate([np.repeat(some, k), fq])
            es = np.concatenate([best[own_rows].ravel(), score])
            ed = np.concatenate([where[own_rows].ravel(), fd + d0])
            e1, e2 = (np.concatenate([m[own_rows].ravel(), x]) for m, x in zip(more, (dense, lex)))
            by = np.lexsort((ed, -es, eq))
            place = np.arange(len(by)) - np.searchsorted(eq[by], eq[by])
            by = by[place < k]
            best[own_rows], where[own_rows], more[0][own_rows], more[1][own_rows] = (x[by].reshape(-1, k) for x in (es, ed, e1, e2))
    for q0 in range(0, q.n, 10_000):
        r, c = np.nonzero(where[q0 : q0 + 10_000] >= 0)
        r += q0
        yield pa.RecordBatch.from_arrays([q.ids.take(pa.array(r)), d.ids.take(pa.array(where[r, c])), *(pa.array(x[r, c] + 0.0) for x in (best, *more))], names=["query_id", "doc_id", "score", "dense", "lex"])


def tiled_topk(queries: DataFrame, docs: DataFrame, k: int, alpha: float, exclude_self: bool, dim: int, digits: int, counts: tuple[int, int]) -> DataFrame:
    """``(query_id, doc_id, score, dense, lex)``, the ``k`` best per query and cell, of sides ``(id, flat, terms, weights)`` of counted sizes.

    Both sides are cut into blocks of at most ``CELL`` numbers, the documents into as many more as keep all cores busy, and every pair of
    blocks is a cell of one task.
    """
    cores, each = docs.sparkSession.sparkContext.defaultParallelism, dim + 64
    q_blocks, least = (max(1, -(-n * each // CELL)) for n in counts)
    d_blocks = next(n for n in range(least, least + cores) if q_blocks * n % cores == 0)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q_kind, d_kind = _kind(queries), _kind(docs)
    q_type, d_type = (to_arrow_type(t.schema["id"].dataType) for t in (queries, docs))
    columns = ["flat", "terms", "weights"]
    left = queries.select(block(q_blocks).alias("q"), every(d_blocks).alias("d"), F.lit(True).alias("asks"), F.col("id").alias("q_id"), F.lit(None).cast(d_kind).alias("d_id"), *columns)
    right = docs.select(every(q_blocks).alias("q"), block(d_blocks).alias("d"), F.lit(False).alias("asks"), F.lit(None).cast(q_kind).alias("q_id"), F.col("id").alias("d_id"), *columns)
    cells = left.unionByName(right).withColumn("cell", (F.col("q") * d_blocks + F.col("d")).cast("int")).drop("q", "d").repartitionById(q_blocks * d_blocks, "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[bool, list] = {True: [], False: []}
        for batch in batches:
            asks = batch.column("asks")
            for mine, name in ((True, "q_id"), (False, "d_id")):
                rows = batch.filter(asks if mine else pc.invert(asks))
                terms = rows.column("terms")
                sides[mine].append((rows.column(name), rows.column("flat").flatten().to_numpy(zero_copy_only=False), _lengths(terms), terms.flatten(), rows.column("weights").flatten().to_numpy(zero_copy_only=False)))
        if not sides[True]:
            return
        coded = pa.chunked_array([x[3] for side in sides.values() for x in side]).combine_chunks().dictionary_encode()
        terms, codes = len(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        cut = sum(len(x[3]) for x in sides[True])
        q, d = _Items([x[:3] for x in sides[True]], q_type, dim), _Items([x[:3] for x in sides[False]], d_type, dim)
        weights = [np.concatenate([x[4] for x in side]) for side in sides.values()]
        sides.clear()
        asked, has = np.bincount(codes[:cut], minlength=terms), np.bincount(codes[cut:], minlength=terms)
        pairs = asked.astype(np.float64) * has
        column = np.where(pairs > 0, -1, -2)  # -2: a term of one side only
        most = 480 if dim or all((w > 0).all() for w in weights) else 0  # a column doesn't tell a weight of 0 from none
        often = np.argsort(-pairs)[: min(most, int((pairs > OFTEN * q.n * d.n).sum()))]
        column[often] = np.arange(len(often))
        q.code(codes[:cut], weights[0], column)
        d.code(codes[cut:], weights[1], column)
        del codes, weights
        yield from _tiled(q, d, max(1, terms), k, alpha, exclude_self, digits)

    return cells.mapInArrow(run, f"query_id {q_kind}, doc_id {d_kind}, score double, dense double, lex double")


def hybrid_topk(queries: DataFrame, docs: DataFrame, query_terms: DataFrame, doc_terms: DataFrame, k: int, alpha: float = 0.3, exclude_self: bool = False, dim: int = 64, parts: bool = False) -> DataFrame:
    """The ``k`` best per query and cell by dense + ``alpha`` * sparse: vectors ``(id, vec)`` and postings ``(id, term, weight)`` of either side.

    Items without a vector take no part, without terms the sparse part is 0. Both products are made tile
    by tile and ranked there; no pair is written that isn't among the best. With ``parts`` its ``dense`` and ``lex`` come too.
    """
    q, d = (v.select("id", F.col("vec").alias("flat")).join(term_lists(t), "id", "left") for v, t in ((queries, query_terms), (docs, doc_terms)))
    q, d = (t.select("id", "flat", *[F.coalesce(c, F.array().cast(t.schema[c].dataType)).alias(c) for c in ("terms", "weights")]) for t in (q, d))
    found = tiled_topk(q, d, k, alpha, exclude_self, dim, 6, (queries.count(), docs.count()))
    return found if parts else found.drop("dense", "lex")


def lexical_topk(queries: DataFrame, docs: DataFrame, k: int, exclude_self: bool = False, digits: int = 6) -> DataFrame:
    """``sparse_topk`` for two large sides of many shared terms, by tiles."""
    q, d = (term_lists(t).withColumn("flat", F.array().cast("array<double>")) for t in (queries, docs))
    sizes = tuple(t.select("id").distinct().count() for t in (queries, docs))
    return tiled_topk(q, d, k, 1.0, exclude_self, 0, digits, sizes).drop("dense", "lex")


def maxsim_relational(queries: DataFrame, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """MaxSim of the listed ``(query_id, doc_id)`` pairs only: joins and three aggregates, all in the JVM."""
    from polyvec.functions.vectors import dot

    q = queries.select(F.col("id").alias("query_id"), F.col("pos").alias("q_pos"), F.col("vec").alias("q_vec"))
    d = docs.select(F.col("id").alias("doc_id"), F.col("vec").alias("d_vec"))
    products = pairs.select("query_id", "doc_id").join(d, "doc_id").join(q, "query_id").withColumn("p", dot(F.col("q_vec"), F.col("d_vec")))
    best = products.groupBy("query_id", "doc_id", "q_pos").agg(F.max("p").alias("p"))
    return best.groupBy("query_id", "doc_id").agg(F.round(F.sum("p"), 6).alias("score"))


def maxsim_of_pairs(queries: DataFrame, docs: DataFrame, pairs: DataFrame, unit: bool = False, digits: int = 6, dim: int = 64) -> DataFrame:
    """``maxsim_relational`` for many pairs: a bag goes once to each cell of a block of queries and one of documents, not once to each of its pairs.

    ``unit``: vectors are brought to unit length in the kernel, so that they may come in single precision. Pairs without both bags give no row.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    q_blocks, least = (max(int(cores**0.5), -(-t.count() * dim // (2 * CELL))) for t in (queries, docs))
    d_blocks = next(n for n in range(least, least + cores) if q_blocks * n % cores == 0)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q, d, p = bags(queries), bags(docs), pairs.select("query_id", "doc_id")
    q_kind, d_kind, flat = _kind(queries), _kind(docs), q.schema["flat"].dataType
    left = q.select(block("id", q_blocks).alias("q"), every(d_blocks).alias("d"), F.lit(0).alias("part"), F.col("id").alias("q_id"), F.lit(None).cast(d_kind).alias("d_id"), "flat")
    right = d.select(every(q_blocks).alias("q"), block("id", d_blocks).alias("d"), F.lit(1).alias("part"), F.lit(None).cast(q_kind).alias("q_id"), F.col("id").alias("d_id"), "flat")
    both = p.select(block("query_id", q_blocks).alias("q"), block("doc_id", d_blocks).alias("d"), F.lit(2).alias("part"), F.col("query_id").alias("q_id"), F.col("doc_id").alias("d_id"), F.lit(None).cast(flat).alias("flat"))
    cells = left.unionByName(right).unionByName(both).select((F.col("q") * d_blocks + F.col("d")).cast("int").alias("cell"), "part", "q_id", "d_id", "flat").repartitionById(q_blocks * d_blocks, "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: list[list] = [[], [], []]
        for batch in batches:
            for part in range(3):
                sides[part].append(batch.filter(pc.equal(batch.column("part"), part)))
        if not sides[2]:
            return
        ids, numbers, sizes, starts = [], [], [], []
        for part, name in ((0, "q_id"), (1, "d_id")):
            ids.append(pa.chunked_array([b.column(name) for b in sides[part]]).combine_chunks())
            numbers.append(np.concatenate([b.column("flat").flatten().to_numpy(zero_copy_only=False) for b in sides[part]]).reshape(-1, dim))
            sizes.append(np.concatenate([_lengths(b.column("flat")) for b in sides[part]]) // dim)
            starts.append(np.cumsum(sizes[-1]) - sizes[-1])
            sides[part] = []
        for batch in sides[2]:
            at = [pc.fill_null(pc.index_in(batch.column(n), value_set=v), -1).to_numpy(zero_copy_only=False) for n, v in zip(("q_id", "d_id"), ids)]
            there = np.flatnonzero((at[0] >= 0) & (at[1] >= 0))
            there = there[(sizes[0][at[0][there]] > 0) & (sizes[1][at[1][there]] > 0)]
            if not len(there):
                continue
            every_size = sizes[0][at[0][there]] * sizes[1][at[1][there]]
            cuts = np.flatnonzero(np.diff(np.cumsum(every_size) // 32_768, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(there)]):
                q, d = at[0][there[a:b]], at[1][there[a:b]]
                n, m = sizes[0][q], sizes[1][d]
                first, wide = np.repeat(starts[0][q], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(m, n)  # a row a query's vector
                begin = np.cumsum(wide) - wide
                second = np.repeat(np.repeat(starts[1][d], n) - begin, wide) + np.arange(wide.sum())
                one, two = numbers[0][first].astype(np.float64), numbers[1][second].astype(np.float64)
                if unit:
                    one, two = (x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None] for x in (one, two))
                best = np.maximum.reduceat(np.einsum("ij,ij->i", np.repeat(one, wide, axis=0), two), begin)
                score = np.round(np.add.reduceat(best, np.cumsum(n) - n), digits) + 0.0
                pick = pa.array(there[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("q_id").take(pick), batch.column("d_id").take(pick), pa.array(score)], names=["query_id", "doc_id", "score"])

    return cells.mapInArrow(run, f"query_id {q_kind}, doc_id {d_kind}, score double")


def dense_relational(queries: DataFrame, docs: DataFrame, pairs: DataFrame, digits: int = 6) -> DataFrame:
    """Dot products of the listed pairs."""
    from polyvec.functions.vectors import dot

    q, d = queries.select(F.col("id").alias("query_id"), F.col("vec").alias("q_vec")), docs.select(F.col("id").alias("doc_id"), F.col("vec").alias("d_vec"))
    both = pairs.select("query_id", "doc_id").join(d, "doc_id").join(q, "query_id")
    return both.select("query_id", "doc_id", F.round(dot(F.col("q_vec"), F.col("d_vec")), digits).alias("score"))


def sparse_relational(queries: DataFrame, docs: DataFrame, pairs: DataFrame, digits: int = 6) -> DataFrame:
    """Sparse products of the listed pairs; those that share no term give no row. A pair meets the terms of its two items only."""
    q = pairs.select("query_id", "doc_id").join(queries.select(F.col("id").alias("query_id"), "term", F.col("weight").alias("q_weight")), "query_id")
    both = q.join(docs.select(F.col("id").alias("doc_id"), "term", F.col("weight").alias("d_weight")), ["doc_id", "term"])
    return both.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("q_weight") * F.col("d_weight")), digits).alias("score"))


def maxsim_pair(query_vecs, doc_vecs):
    """MaxSim of two arrays of vectors, as one column expression."""
    from polyvec.functions.vectors import dot

    best = F.transform(query_vecs, lambda q: F.array_max(F.transform(doc_vecs, lambda d: dot(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)


def sparse_scores(queries: DataFrame, docs: DataFrame, exclude_self: bool = False, digits: int = 6) -> DataFrame:
    """Sum over shared terms of weight products, both sides ``(id, term, weight)``: an equi-join on the
    term and a partial, then final sum. A frequent term spreads by AQE's splitting of skewed partitions."""
    q = queries.select(F.col("id").alias("query_id"), "term", F.col("weight").alias("q_weight"))
    d = docs.select(F.col("id").alias("doc_id"), "term", F.col("weight").alias("d_weight"))
    joined = q.join(d, "term")
    if exclude_self:
        joined = joined.where(F.col("query_id") != F.col("doc_id"))
    return joined.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("q_weight") * F.col("d_weight")), digits).alias("score"))


def postings_read(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``(query_id, postings)``: lengths of the posting lists of a query's terms, summed; 0 if it has none."""
    df = docs.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return queries.join(df, "term", "left").groupBy(F.col("id").alias("query_id")).agg(F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))


def running_offsets(lengths: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(id, len)`` with ``start``, the sum of ``len`` over all smaller ids."""
    rows = running(lengths.select("id", "len"), [F.col("id")], ["len"], partitions=partitions)
    return rows.select("id", "len", (F.col("len_upto") - F.col("len")).alias("start"))


def expand_ranges(ranges: DataFrame) -> DataFrame:
    """``(id, value)``: every integer of ``[start, start + len)``; lengths of 0 give nothing."""
    return ranges.where("len > 0").select("id", F.explode(F.expr("sequence(start, start + len - 1)")).alias("value"))


def hybrid(dense: DataFrame, lexical: DataFrame, alpha: float = 0.3, digits: int = 9) -> DataFrame:
    """``dense + alpha * lexical``; a pair without a lexical score has 0 there."""
    lex = lexical.withColumnRenamed("score", "lex")
    fused = dense.join(lex, ["query_id", "doc_id"], "left")
    return fused.select("query_id", "doc_id", F.round(F.col("score") + F.lit(alpha) * F.coalesce("lex", F.lit(0.0)), digits).alias("score"))


def weighted_fusion(parts: list[tuple[float, DataFrame]], digits: int = 9) -> DataFrame:
    """Weighted sum of several scores; the pairs are those of the first, others count 0 where missing."""
    (weight, first), *rest = parts
    out = first.select("query_id", "doc_id", (F.lit(weight) * F.col("score")).alias("score"))
    for weight, part in rest:
        out = out.join(part.withColumnRenamed("score", "s"), ["query_id", "doc_id"], "left").select("query_id", "doc_id", (F.col("score") + F.lit(weight) * F.coalesce("s", F.lit(0.0))).alias("score"))
    return out.withColumn("score", F.round("score", digits))

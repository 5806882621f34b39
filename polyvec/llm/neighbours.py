"""The k most similar vectors (cosine) of every vector, by learned partitions.

1. Vectors are normalised; exact copies, found by a 128-bit hash, become one class, so that a direction
   that a third of all rows share is searched once.
2. On a bounded sample: the neighbour graph, a balanced partitioning of it (recursive halving, then
   moves that cut fewer edges while no part outgrows its share), and a softmax classifier that
   learns in which parts a vector's neighbours lie. Above ``sample // 16`` partitions each of them is
   partitioned again, on a sample of its own and by a classifier of its own, fitted on the workers.
3. Every vector lies in its most probable partition; every query goes to its most probable ones and
   is compared with all vectors there. Large partitions are cut into blocks on both sides. Where all
   vectors are queries and a least cosine is given, a pair is found if either goes to the other's home.
4. The best of all partitions are merged, and classes are expanded into their members.

Bounds: a classifier is fitted on at most ``sample`` vectors; the classifiers (partitions x dimensions
floats) are broadcast, at most ``router_bytes`` of them, beyond which partitions grow; sizes of partitions
are counted on at most ``counted`` hashed vectors. All vectors are indexed and compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyvec.plans.shared import checkpoint


class Router:
    """A linear softmax classifier over partitions."""

    def __init__(self, weight: np.ndarray, bias: np.ndarray) -> None:
        self.weight, self.bias = weight, bias

    @property
    def apart(self) -> np.ndarray:
        """Distances of the partitions' weights."""
        gram = self.weight @ self.weight.T
        square = np.diag(gram)
        return np.sqrt(np.maximum(square[None, :] + square[:, None] - 2 * gram, 0)).astype(np.float32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight.T + self.bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        s = self.scores(x)
        s -= s.max(1, keepdims=True)
        np.exp(s, out=s)
        return s / s.sum(1, keepdims=True)

    def probes(self, x: np.ndarray, min_cosine: float | None, mass: float, spread: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The home partition of each row, and ``(row, partition)`` of those to search for it, home included.

        Without ``min_cosine`` these are the most probable ones with a share ``mass`` of the
        probability. With it they are those that a vector at that cosine, in a random direction from
        the row, falls into with its score up to ``spread`` standard deviations off.
        """
        scores = self.scores(x)
        home = scores.argmax(1)
        if min_cosine is None:
            p = self.probabilities(x)
            order = np.argsort(-p, axis=1, kind="stable")
            before = np.cumsum(np.take_along_axis(p, order, 1), axis=1) - np.take_along_axis(p, order, 1)
            chosen = np.zeros(p.shape, bool)
            np.put_along_axis(chosen, order, before < mass, 1)
        else:
            # score of the neighbour: min_cosine * (score - bias) + bias, give or take spread * sd * |w - w_home|
            scores -= self.bias
            scores *= np.float32(min_cosine)
            scores += self.bias
            sd = math.sqrt(max(0.0, 1 - min_cosine**2) / max(1, x.shape[1] - 1))
            scores += (spread * sd * self.apart)[home]
            chosen = scores >= (scores[np.arange(len(x)), home])[:, None]
        chosen[np.arange(len(x)), home] = True
        return home, *np.nonzero(chosen)


class Forest:
    """A classifier over partitions, and one within each of them that is partitioned again."""

    def __init__(self, top: Router, below: dict[int, Router] | None = None) -> None:
        self.top, self.below = top, below or {}
        sizes = [len(self.below[p].bias) if p in self.below else 1 for p in range(len(top.bias))]
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.parts = int(self.first[-1])

    def probes(self, x: np.ndarray, min_cosine: float | None, mass: float, spread: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mass = math.sqrt(mass) if self.below else mass
        top_home, row, part = self.top.probes(x, min_cosine, mass, spread)
        if not self.below:
            return top_home, row, part
        home, rows, parts = self.first[top_home], [], []
        order = np.argsort(part, kind="stable")
        row, part = row[order], part[order]
        edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        for a, b in zip(edges, edges[1:]):
            p, own = int(part[a]), row[a:b]
            if p in self.below:
                sub_home, r, sub = self.below[p].probes(x[own], min_cosine, mass, spread)
                here = top_home[own] == p
                home[own[here]] += sub_home[here]
                own, sub = own[r], sub + self.first[p]
            else:
                sub = np.full(len(own), self.first[p])
            rows.append(own)
            parts.append(sub)
        return home, np.concatenate(rows), np.concatenate(parts)


def neighbour_graph(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """The ``k`` nearest other rows of each row by cosine."""
    out = np.empty((len(x), k), np.int32)
    for at in range(0, len(x), block):
        s = x[at : at + block] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        out[at : at + block] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.1, seed: int = 7) -> np.ndarray:
    """A partition of the graph's nodes with at most ``slack`` times the mean in any part."""
    rng = np.random.default_rng(seed)
    label = np.zeros(len(x), np.int32)

    def halve(rows: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            label[rows] = first
            return
        left = count // 2
        axis = x[rows[rng.integers(len(rows))]] - x[rows].mean(0)
        for _ in range(4):  # towards the widest direction
            centred = x[rows] - x[rows].mean(0)
            axis = centred.T @ (centred @ axis)
            axis /= max(np.linalg.norm(axis), 1e-12)
        order = rows[np.argsort(x[rows] @ axis, kind="stable")]
        cut = len(rows) * left // count
        halve(order[:cut], first, left)
        halve(order[cut:], first + left, count - left)

    halve(np.arange(len(x)), 0, parts)
    most = max(1, math.ceil(slack * len(x) / parts))
    size = np.bincount(label, minlength=parts)
    # every edge is seen from both ends
    src = np.concatenate([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()])
    dst = np.concatenate([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])
    for _ in range(rounds):
        key, links = np.unique(src.astype(np.int64) * parts + label[dst], return_counts=True)
        node, part = key // parts, (key % parts).astype(np.int32)
        own = np.zeros(len(x), np.int64)
        here = part == label[node]
        own[node[here]] = links[here]
        gain = links - own[node]
        moved = 0
        for at in np.argsort(-gain, kind="stable"):
            if gain[at] <= 0:
                break
            n, p = node[at], part[at]
            if label[n] != p and size[p] < most and gain[at] > 0 and own[n] >= 0:
                size[label[n]] -= 1
                size[p] += 1
                label[n] = p
                own[n] = -1  # moved in this round
                moved += 1
        if moved < len(x) // 200:
            break
    return label


def fit_router(x: np.ndarray, parts: int, graph_k: int = 10, epochs: int = 12, seed: int = 7) -> Router:
    """Partition the neighbour graph of ``x`` and learn to route to the parts of a row's neighbours."""
    rng = np.random.default_rng(seed)
    if parts == 1 or len(x) <= graph_k + 1:
        return Router(np.zeros((1, x.shape[1]), np.float32), np.zeros(1, np.float32))
    graph = neighbour_graph(x, graph_k)
    label = balanced_parts(x, graph, parts, seed=seed)
    near = np.concatenate([label[:, None], label[:, None], label[graph]], 1)  # itself counts double
    weight = np.zeros((parts, x.shape[1]), np.float32)
    np.add.at(weight, label, x)
    weight = 8 * weight / np.maximum(np.linalg.norm(weight, axis=1, keepdims=True), 1e-12)
    bias = np.zeros(parts, np.float32)
    m = [np.zeros_like(weight), np.zeros_like(bias)]
    v = [np.zeros_like(weight), np.zeros_like(bias)]
    step, rate, batch = 0, 0.05, 512
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            router = Router(weight, bias)
            error = router.probabilities(x[rows])
            np.subtract.at(error, (np.repeat(np.arange(len(rows)), near.shape[1]), near[rows].ravel()), np.float32(1 / near.shape[1]))
            error /= len(rows)
            step += 1
            for i, g in enumerate((error.T @ x[rows] + 1e-6 * weight, error.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                move = rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
                if i:
                    bias = (bias - move).astype(np.float32)
                else:
                    weight = (weight - move).astype(np.float32)
        rate *= 0.75
    return Router(weight.astype(np.float32), bias.astype(np.float32))


def unit_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``(id, vec, h1, h2)``: the packed unit vector of every row that has one, and its hashes.

    Null vectors, vectors with a null, NaN or infinite element, all-zero vectors, vectors of another
    length than ``dim`` and null ids take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            rows = np.flatnonzero(np.diff(lists.offsets.to_numpy()) == dim) if len(lists) else np.empty(0, int)
            rows = rows[lists.take(pa.array(rows)).is_valid().to_numpy(zero_copy_only=False)]
            flat = lists.take(pa.array(rows)).flatten().cast(pa.float64())
            x = np.asarray(flat.fill_null(np.nan).to_numpy(zero_copy_only=False)).reshape(-1, dim)
            norm = np.sqrt((x * x).sum(1))
            good = np.isfinite(norm) & (norm > 0)
            unit = np.round(x[good] / norm[good][:, None], 7).astype("<f4") + np.float32(0)  # copies up to scale get the same bytes
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[good])), _packed(unit)], names=["id", "vec"])

    kind = df.schema[vector].dataType.simpleString()
    column = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    plain = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), column.alias("v"))
    return plain.mapInArrow(run, "id bigint, vec binary").withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})


def _packed(x: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer((np.arange(len(x) + 1) * 4 * x.shape[1]).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(np.ascontiguousarray(x, "<f4").tobytes())])


def _matrix(packed: pa.Array, dim: int) -> np.ndarray:
    if isinstance(packed, pa.ChunkedArray):
        packed = packed.combine_chunks()
    if not len(packed):
        return np.empty((0, dim), np.float32)
    start = int(np.frombuffer(packed.buffers()[1], np.int32)[packed.offset])
    return np.frombuffer(packed.buffers()[2], "<f4", len(packed) * dim, start).reshape(-1, dim)


def _foremost(row: np.ndarray, near: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the ``k`` with the highest cosine, ties by ``near``."""
    order = np.lexsort((near, -cos, row))
    row, near, cos = row[order], near[order], cos[order]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[top], near[top], cos[top]


def _above(ids: np.ndarray, x: np.ndarray, both: int, guests: np.ndarray, g: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of at least ``least``, from either end the ``k`` best: the first ``both`` rows of ``x`` with each other and with all, guests with all."""
    held: list[tuple] = []
    size = 0

    def add(a_ids: np.ndarray, b_ids: np.ndarray, cos: np.ndarray) -> None:
        nonlocal held, size
        other = a_ids != b_ids
        a_ids, b_ids, cos = a_ids[other], b_ids[other], cos[other]
        held += [_foremost(a_ids, b_ids, cos, k), _foremost(b_ids, a_ids, cos, k)]
        size += 2 * len(a_ids)
        if size > 4_000_000:
            held, size = [_foremost(*map(np.concatenate, zip(*held)), k)], 0

    tile = max(16, 8_000_000 // max(1, len(x)))
    for at in range(0, both, tile):
        end = min(both, at + tile)
        row, col = np.divmod(np.flatnonzero((s := x[at:end] @ x[at:].T) >= least - 1e-6), len(x) - at)
        later = col > row
        row, col = row[later], col[later]
        add(ids[at + row], ids[at + col], s[row, col])
    for at in range(0, len(g), tile):
        s = g[at : at + tile] @ x.T
        row, col = np.divmod(np.flatnonzero(s >= least - 1e-6), max(1, len(x)))
        add(guests[at + row], ids[col], s[row, col])
    return _foremost(*map(np.concatenate, zip(*held)), k) if held else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))


def _nearest(ids: np.ndarray, x: np.ndarray, asking: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of ``x`` for each of ``q``."""
    outs = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
    tile = max(16, 8_000_000 // max(1, len(x)))
    for at in range(0, len(q), tile):
        s = q[at : at + tile] @ x.T
        take = min(k + 1, len(x))
        col = np.argpartition(-s, take - 1, axis=1)[:, :take] if take < len(x) else np.broadcast_to(np.arange(len(x)), s.shape)
        row, col = np.repeat(np.arange(len(s)), col.shape[1]), col.ravel()
        other = asking[at + row] != ids[col]
        row, col = row[other], col[other]
        outs.append((asking[at + row], ids[col], s[row, col]))
    return tuple(map(np.concatenate, zip(*outs)))


def _sampled(df: DataFrame, share: float, seed: int) -> DataFrame:
    return df.where(F.pmod(F.xxhash64("cid", F.lit(seed)), F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000)) if share < 1 else df


def fit_forest(classes: DataFrame, total: int, dim: int, leaf: int, sample: int, router_bytes: int, seed: int) -> Forest:
    """Classifiers for about ``total / leaf`` partitions."""
    wanted = max(min(8, total // 32), -(-total // leaf), 1)
    fan = max(1, sample // 16)
    drawn = _sampled(classes, 1.3 * sample / max(1, total), seed).select("vec").limit(sample).collect() if wanted > 1 else []
    top = fit_router(np.array([np.frombuffer(r["vec"], "<f4") for r in drawn], np.float32).reshape(-1, dim), min(wanted, fan), seed=seed)
    parts = len(top.bias)
    each = min(-(-wanted // parts), fan, router_bytes // (4 * (dim + 1) * parts))
    if each < 2:
        return Forest(top)
    model = classes.sparkSession.sparkContext.broadcast((top.weight, top.bias))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = Router(*model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(router.scores(_matrix(batch.column(0), dim)).argmax(1), pa.int64()), batch.column(0)], names=["part", "vec"])

    def fit(table: pa.Table) -> pa.Table:
        own = fit_router(_matrix(table.column("vec"), dim)[:sample], each, seed=seed)
        return pa.table({"part": table.column("part").slice(0, 1), "weight": pa.array([own.weight.astype("<f4").tobytes()]), "bias": pa.array([own.bias.astype("<f4").tobytes()])})

    lines = _sampled(classes, sample * parts / max(1, total), seed + 1).select("vec").mapInArrow(home, "part bigint, vec binary")  # about ``sample`` of each partition
    fitted = lines.groupBy("part").applyInArrow(fit, "part bigint, weight binary, bias binary").collect()
    return Forest(top, {r["part"]: Router(np.frombuffer(r["weight"], "<f4").reshape(-1, dim), np.frombuffer(r["bias"], "<f4")) for r in fitted})


def most_similar(
    df: DataFrame, key: str, vector: str, k: int = 5, dim: int = 64, min_cosine: float | None = None, query: Column | None = None,
    leaf: int = 2048, sample: int = 16384, mass: float = 0.95, spread: float = 2.0, block: int = 8192, counted: int = 50_000, router_bytes: int = 64_000_000, seed: int = 7,
) -> DataFrame:
    """``(<key>, neighbour, cosine, rank)``: the ``k`` other ids most similar to each id, ties by id ascending.

    ``query`` is a condition on ``id`` that says which ids are queries (all by default); all are
    searched. With ``min_cosine`` neighbours below it are left out and fewer partitions searched.
    Ids must be integers. See ``unit_vectors`` for rows that take no part; repeated rows count once; of
    several different vectors of an id one counts, that with the least hash. The result is
    approximate: a neighbour is missed if it lies in a partition that the query isn't sent to.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = unit_vectors(df, key, vector, dim)
    ids = checkpoint(rows.groupBy("id").agg(F.min("h1").alias("h1"), F.min_by("h2", "h1").alias("h2")))
    asks = F.lit(True) if query is None else F.coalesce(F.max(query), F.lit(False))
    sets = ids.groupBy("h1", "h2").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("n"), asks.alias("asks"))
    # The vector of a class is that of its least id.
    own = (F.col("h1") <= F.col("g1")) & (F.col("h1") >= F.col("g1"))  # not an equality, so that the join is partitioned by cid alone, as dropping repeats is
    heads = rows.select(F.col("id").alias("cid"), F.col("h1").alias("g1"), "vec").join(sets, "cid").where(own)
    classes = checkpoint(heads.dropDuplicates(["cid"]).select("cid", "vec", "asks", "n", "h1", "h2"))
    total, queries, members, heaviest = classes.agg(F.count(F.lit(1)), F.count_if("asks"), F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
    forest = fit_forest(classes, total, dim, leaf, sample, router_bytes, seed)
    model = df.sparkSession.sparkContext.broadcast(forest)
    mutual = min_cosine is not None and queries == total  # a pair that either end looks for is found
    parts = forest.parts

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        forest = model.value
        step = max(64, min(2048, 8_000_000 // len(forest.top.bias)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                asks = piece.column(2).to_numpy(zero_copy_only=False)
                home, row, part = forest.probes(_matrix(piece.column(1), dim), min_cosine, mass, spread)
                keep = asks[row]
                yield piece, asks, home, row[keep], part[keep]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored, sent = np.zeros(parts, np.int64), np.zeros(parts, np.int64)
        for _, _, home, _, part in route(batches):
            stored += np.bincount(home, minlength=parts)
            sent += np.bincount(part, minlength=parts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts), pa.int64()), pa.array(stored), pa.array(sent)], names=["part", "stored", "sent"])

    vectors = classes.select("cid", "vec", "asks")
    share = min(1.0, counted / max(1, total))
    sizes = _sampled(vectors, share, seed + 2).mapInArrow(count, "part bigint, stored bigint, sent bigint").groupBy("part").agg(F.sum("stored").alias("stored"), F.sum("sent").alias("sent")).where(F.greatest("stored", "sent") > block * share).collect()
    v_blocks, q_blocks = np.ones(parts, np.int64), np.ones(parts, np.int64)
    for r in sizes:  # only those that are cut
        v_blocks[r["part"]] = max(1, math.ceil(r["stored"] / share / block))
        q_blocks[r["part"]] = max(1, math.ceil(r["sent"] / share / (2 * block)))

    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, asks, home, q_row, q_part in route(batches):
            ids = piece.column(0).to_numpy()
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            n = len(ids)
            # A vector stored in its home, in every query block; a query in every block of the stored. Where both meet it goes once.
            row, part = np.arange(n), home
            copies = q_blocks[part]
            row, part = np.repeat(row, copies), np.repeat(part, copies)
            q_at = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            v_at = (mixed[row] % v_blocks[part].astype(np.uint64)).astype(np.int64)
            role = np.where(asks[row] & (q_at == (mixed[row] % q_blocks[part].astype(np.uint64)).astype(np.int64)), 3, 1)
            copies = v_blocks[q_part]
            g_row, g_part = np.repeat(q_row, copies), np.repeat(q_part, copies)
            g_v = np.arange(len(g_row)) - np.repeat(np.cumsum(copies) - copies, copies)
            g_q = (mixed[g_row] % q_blocks[g_part].astype(np.uint64)).astype(np.int64)
            met = (home[g_row] == g_part) & (g_v == (mixed[g_row] % v_blocks[g_part].astype(np.uint64)).astype(np.int64))
            g_row, g_part, g_v, g_q = g_row[~met], g_part[~met], g_v[~met], g_q[~met]
            row, part = np.concatenate([row, g_row]), np.concatenate([part, g_part])
            cell = (part.astype(np.int64) << 32) + (np.concatenate([v_at, g_v]) << 16) + np.concatenate([q_at, g_q])
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.concatenate([role, np.full(len(g_row), 2)]), pa.int8()), piece.column(0).take(index), piece.column(1).take(index)], names=["cell", "role", "cid", "vec"])

    def search(table: pa.Table) -> pa.Table:
        role = table.column("role").combine_chunks().to_numpy()
        order = np.argsort(-role, kind="stable")  # both, guests, only stored
        table = table.take(pa.array(order))
        ids, x, role = table.column("cid").to_numpy(), _matrix(table.column("vec"), dim), role[order]
        both, asked = int((role == 3).sum()), int((role >= 2).sum())
        stored = np.concatenate([np.arange(both), np.arange(asked, len(ids))])
        if mutual:
            a, b, cos = _above(ids[stored], x[stored], both, ids[both:asked], x[both:asked], k, min_cosine)
        else:
            a, b, cos = _nearest(ids[stored], x[stored], ids[:asked], x[:asked], k)
            if min_cosine is not None:
                keep = cos >= min_cosine - 1e-6
                a, b, cos = a[keep], b[keep], cos[keep]
        return pa.table({"cid": a, "near": b, "cosine": np.round(cos.astype(np.float64), 7)})

    cells = vectors.mapInArrow(spread_out, "cell bigint, role tinyint, cid bigint, vec binary")
    found = cells.groupBy("cell").applyInArrow(search, "cid bigint, near bigint, cosine double")
    if mutual:  # from both ends, or from two cells
        found = found.groupBy("cid", "near").agg(F.max("cosine").alias("cosine"))
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("cid").orderBy(F.col("cosine").desc(), "near"))).where(F.col("place") <= k)
    best = checkpoint(best.select("cid", "near", "cosine"))  # several branches read it; the search is made once

    # Classes of several members. At most 1,000 hold more than a thousandth of all ids: those are broadcast.
    several = classes.where("n > 1").select("cid", "h1", "h2", "n")

    def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        """``left`` join ``right``, which has one row a class with ``n``."""
        heavy = F.col("n") > members / 1000
        light = left.join(right.where(~heavy).drop("n"), on)
        return light.unionByName(left.join(F.broadcast(right.where(heavy).drop("n")), on)) if heaviest and heaviest > members / 1000 else light

    shared = joined(ids, several, ["h1", "h2"]).select("id", "cid")
    heads = shared.withColumn("place", F.row_number().over(Window.partitionBy("cid").orderBy("id"))).where(F.col("place") <= k + 1)
    heads = heads.groupBy("cid").agg(F.sort_array(F.collect_list("id")).alias("heads"))
    named = best.join(heads.withColumnRenamed("cid", "near"), "near", "left")
    others = named.select("cid", "cosine", F.explode(F.coalesce("heads", F.array("near"))).alias("neighbour"))
    own = heads.select("cid", F.lit(1.0).alias("cosine"), F.explode("heads").alias("neighbour"))
    lists = others.unionByName(own).groupBy("cid").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("away"), "neighbour"))).alias("list"))
    alone = lists.join(several, "cid", "left_anti").withColumn("id", F.col("cid"))
    mine = alone.select("id", "list").unionByName(joined(shared, lists.join(several.select("cid", "n"), "cid"), ["cid"]).select("id", "list"))
    mine = mine if query is None else mine.where(query)
    kept = mine.select("id", F.posexplode(F.slice(F.filter("list", lambda e: e["neighbour"] != F.col("id")), 1, k)).alias("at", "e"))
    out = kept.select(F.col("id").cast(kind).alias(key), F.col("e.neighbour").cast(kind).alias("neighbour"), (-F.col("e.away")).alias("cosine"), (F.col("at") + 1).alias("rank"))
    return out if min_cosine is None else out.where(F.col("cosine") >= min_cosine)


def similar_pairs(df: DataFrame, key: str, vector: str, k: int, min_cosine: float, dim: int = 64, **options) -> DataFrame:
    """``(a, b)``, ``a < b``: pairs of ids of which one is among the other's ``k`` most similar, at ``min_cosine`` or more."""
    near = most_similar(df, key, vector, k, dim, min_cosine, **options)
    return near.select(F.least(key, "neighbour").alias("a"), F.greatest(key, "neighbour").alias("b")).distinct()

"""Splitting of long texts into overlapping pieces at natural boundaries.

Balanced targets: the least number of pieces that can hold the text, equal-length targets, each
target moved to the strongest boundary near it, one more round with more pieces whenever a limit
fails. Runs without any boundary that are longer than a piece divide the text: each of them is cut
inside at equal targets, each stretch between them is balanced by itself. A stretch of such uneven
boundaries that no balanced plan holds goes through a left-to-right pass, which is exact.

The overlap is kept at about its size: the next piece begins at the boundary nearest the wanted place
or, where there is none within half an overlap, inside the word. It shrinks only as far as the next
natural cut would else be out of reach.

Only texts over the limit leave the JVM. One text is split in one task; time and memory are linear
in its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Natural boundaries (space, tab, line feed, carriage return, U+00A0, U+3000, and the
# ideographic full stop, full-width exclamation mark and full-width question mark).
SPACES = (0x20, 0x09, 0x0A, 0x0D, 0xA0, 0x3000)
MARKS = (0x3002, 0xFF01, 0xFF1F)

NATURAL, FORCED = "natural", "forced"


def boundary_strength(codes: np.ndarray) -> np.ndarray:
    """Strength of a cut before each code point: 0 none, 1 before white space, 2 after white space,
    3 sentence end, 4 line end, 5 blank line."""
    n = len(codes)
    space = np.isin(codes, SPACES)
    mark = np.isin(codes, MARKS)
    out = np.zeros(n + 1, np.int8)
    if n < 2:
        return out
    here, prev = slice(1, n), slice(0, n - 1)
    inner = out[1:n]
    inner[space[here] | mark[here]] = 1
    after = space[prev] & ~space[here]
    inner[after] = 2
    inner[mark[prev]] = 3
    index = np.arange(n)
    last_solid = np.maximum.accumulate(np.where(space, -1, index))
    last_line = np.maximum.accumulate(np.where(codes == 0x0A, index, -1))
    solid_before, line_before = last_solid[prev], last_line[prev]
    stop = np.isin(codes, (0x2E, 0x21, 0x3F))
    inner[after & (solid_before >= 0) & stop[np.maximum(solid_before, 0)]] = 3
    inner[after & (line_before > solid_before)] = 4
    lines = np.concatenate(([0], np.cumsum(codes == 0x0A)))
    inner[after & (lines[1:n] - lines[np.maximum(solid_before + 1, 0)] >= 2)] = 5
    return out


class _Plan:
    """One text under division: its boundaries and the limits."""

    def __init__(self, n: int, strength: np.ndarray, limit: int, overlap: int) -> None:
        self.n, self.strength, self.limit, self.overlap = n, strength, limit, overlap
        self.at = np.flatnonzero(strength)
        self.edges = np.concatenate(([0], self.at, [n]))
        # The next natural cut behind each, not one beside it in the same white space.
        apart = np.append(np.diff(self.edges) > 1, True)
        last = np.flatnonzero(apart)
        self.ahead = self.edges[np.minimum(last[np.searchsorted(last, np.arange(len(self.edges)))] + 1, len(self.edges) - 1)]

    def restart(self, start: int, cut: int) -> int:
        """Where the piece after ``cut`` begins."""
        overlap, limit = self.overlap, self.limit
        if not overlap:
            return cut
        ahead = int(self.ahead[np.searchsorted(self.edges, cut)])
        lowest = ahead - limit if ahead - cut <= limit else cut - limit + 1
        want = max(cut - overlap, lowest, start + 1)
        a, b = np.searchsorted(self.at, (max(want - overlap // 2, lowest, start + 1), min(want, cut - overlap) + overlap // 2 + 1))
        near = self.at[a:b]
        if len(near):
            return int(near[np.lexsort((np.abs(near - want), self.strength[near] <= 1))[0]])
        return min(want, cut)

    def balanced(self, first: int, last: int, count: int) -> list[tuple[int, int, str]] | None:
        """``count`` pieces from ``first`` to ``last``, or none if a limit fails."""
        step = (last - first - self.overlap) / count
        reach = max(1, int(min(step / 3, self.limit / 6)))
        pieces, start, end = [], first, first
        for i in range(1, count):
            target = int(first + self.overlap + i * step)
            lo, hi = max(end + 1, target - reach), min(start + self.limit, target + reach, last - 1)
            a, b = np.searchsorted(self.at, (lo, hi + 1))
            if a < b:
                near = self.at[a:b]
                cut = int(near[np.lexsort((np.abs(near - target), -self.strength[near]))[0]])
            else:
                a, b = np.searchsorted(self.at, (end + 1, min(start + self.limit, last - 1) + 1))
                if a >= b:
                    return None
                cut = int(self.at[a:b][np.argmin(np.abs(self.at[a:b] - target))])
            pieces.append((start, cut, NATURAL))
            start, end = self.restart(start, cut), cut
        return [*pieces, (start, last, NATURAL)] if last - start <= self.limit else None

    def in_order(self, first: int, last: int) -> list[tuple[int, int, str]]:
        """Farthest boundary each time; there always is one, since ``restart`` keeps the next one in reach."""
        pieces, start, end = [], first, first
        while last - start > self.limit:
            a, b = np.searchsorted(self.at, (end + 1, min(start + self.limit, last - 1) + 1))
            cut = int(self.at[b - 1])
            pieces.append((start, cut, NATURAL))
            start, end = self.restart(start, cut), cut
        return [*pieces, (start, last, NATURAL)]

    def stretch(self, first: int, last: int) -> list[tuple[int, int, str]]:
        """Text with natural cuts enough."""
        fewest = max(1, -(-(last - first - self.overlap) // (self.limit - self.overlap)))
        count = fewest
        while count <= 2 * fewest + 8:
            if plan := self.balanced(first, last, count):
                return plan
            count += max(1, count // 8)
        return self.in_order(first, last)

    def run(self, first: int, last: int) -> list[tuple[int, int, str]]:
        """Text without a natural cut before ``last``: equal pieces."""
        count = -(-(last - first - self.overlap) // (self.limit - self.overlap))
        step = (last - first - self.overlap) / count
        cuts = [int(first + self.overlap + i * step) for i in range(1, count)]
        starts = [first, *(c - self.overlap for c in cuts)]
        return list(zip(starts, [*cuts, last], [*[FORCED] * len(cuts), NATURAL]))

    def pieces(self) -> list[tuple[int, int, str]]:
        out: list[tuple[int, int, str]] = []
        lengths = np.diff(self.edges)
        bounds, at = [], 0
        for i in np.flatnonzero(lengths > self.limit):
            a, b = int(self.edges[i]), int(self.edges[i + 1])
            if at < a - (2 * self.overlap if 3 * self.overlap <= self.limit else 0):
                bounds.append((at, a, False))
                at = a
            bounds.append((at, b, True))  # with a stretch before it that is little longer than an overlap
            at = b
        if at < self.n:
            bounds.append((at, self.n, False))
        for a, b, forced in bounds:
            first = self.restart(*out[-1][:2]) if out else a
            if forced:
                out += self.run(first, b)
            elif out and b - out[-1][0] <= self.limit:
                out[-1] = (out[-1][0], b, out[-1][2])  # the last piece of the run holds it too
            else:
                out += self.stretch(first, b)
        return out


def split_text(text: str, limit: int = 2000, overlap: int = 200) -> list[tuple[int, int, str]]:
    """Pieces ``(start, end, cut)`` in code points; ``cut`` says how the end of a piece was made.

    A text within the limit is one piece. An empty text is one empty piece. The ends of successive
    pieces grow and together the pieces cover the text.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and below the limit")
    n = len(text)
    if n <= limit:
        return [(0, n, NATURAL)]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    strength = boundary_strength(codes)
    return _Plan(n, strength, limit, overlap).pieces()


def split_long(df: DataFrame, key: str, text: str, limit: int = 2000, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """Rows ``(<key>, piece, start, end, cut[, text])`` for every text over ``limit`` code points.

    Null and empty texts and those within the limit give no row. Each input row is split by itself,
    so repeated rows give repeated pieces; other columns are ignored whatever their names.
    """
    kind = df.schema[key].dataType.simpleString()
    long = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.char_length(F.col("text")) > limit)
    body = ", text string" if with_text else ""
    fields = [pa.field("piece", pa.int32()), pa.field("start", pa.int64()), pa.field("end", pa.int64()), pa.field("cut", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([pa.field("key", batch.schema.field(0).type), *fields, *([pa.field("text", pa.string())] if with_text else [])])
            for row in range(batch.num_rows):
                whole = batch.column(1)[row].as_py()
                plan = split_text(whole, limit, overlap)
                starts, ends, cuts = zip(*plan)
                columns = [pa.array([batch.column(0)[row].as_py()] * len(plan), schema.field(0).type), pa.array(range(len(plan)), pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(cuts, pa.string())]
                if with_text:
                    columns.append(pa.array([whole[a:b] for a, b in zip(starts, ends)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    out = long.mapInArrow(run, f"key {kind}, piece int, start bigint, end bigint, cut string{body}")
    return out.withColumnRenamed("key", key)


def cut_kinds(df: DataFrame, key: str, text: str, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """One row ``(<key>, cut)`` per key with a text over the limit: ``forced`` if any of its cuts had to be."""
    pieces = split_long(df, key, text, limit, overlap, with_text=False)
    return pieces.groupBy(key).agg(F.when(F.max(F.col("cut") == FORCED), F.lit(FORCED)).otherwise(F.lit(NATURAL)).alias("cut"))

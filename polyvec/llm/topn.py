"""The N best items of every group, by one global sort.

Rows are range-partitioned and sorted on group, descending score and identifier, so that one huge
group spreads over as many partitions as it fills. A partition knows the position of each of its
rows among its own rows of the group; the counts of earlier partitions, summed up per group, turn
these into exact positions, and positions up to N stay. A partition passes on at most N rows a
group: a row beyond that has N better ones before it in the same partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_scores(df: DataFrame, group: str, item: str, score: str, at: str) -> DataFrame:
    """``(<group>, <item>, <score>)`` of the row with the latest ``at`` per pair.

    Of rows with the same time the one with the higher score counts, one with a score before one
    without. A null time is older than any. Pairs whose score is then null or NaN are left out.
    """
    valid = F.col(score).isNotNull() & ~F.isnan(score)
    best = F.max(F.struct(F.col(at), valid.alias("valid"), F.when(valid, F.col(score)).alias("score")))
    return (
        df.groupBy(group, item).agg(best.alias("_best"))
        .where("_best.valid").select(group, item, F.col("_best.score").alias(score))
    )


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, partitions: int | None = None) -> DataFrame:
    """``(<group>, <item>, <score>, rank)``: the ``n`` rows of highest score per group, ties by ``item`` ascending.

    Rows with a null or NaN score take no part. Null is a group of its own; a null item comes before
    others. Repeated rows each count; drop them first where they should not. Infinite scores are ordinary.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(F.col(group).alias("grp"), F.col(item).alias("item"), F.col(score).cast("double").alias("score"))
    rows = rows.where(F.col("score").isNotNull() & ~F.isnan("score"))
    order = [F.col("grp").asc(), F.col("score").desc(), F.col("item").asc()]
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    ordered = ranged.sortWithinPartitions(*order)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        open_group, seen = None, 0  # the group at the end of the last batch, as an array of one

        def closed(groups: pa.Array, counts: np.ndarray, like: pa.RecordBatch) -> pa.RecordBatch:
            m = len(groups)
            return pa.RecordBatch.from_arrays(
                [groups, pa.nulls(m, like.schema.field(1).type), pa.nulls(m, pa.float64()), pa.array(np.full(m, part), pa.int32()), pa.array(np.full(m, 2**62), pa.int64()), pa.array(counts, pa.int64())],
                names=["grp", "item", "score", "part", "place", "n"],
            )

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            last, m = batch, batch.num_rows
            groups = batch.column(0)
            starts = _run_starts(groups)
            if open_group is not None and groups.slice(0, 1).equals(open_group):
                carried = seen
            else:
                if open_group is not None:
                    yield closed(open_group, np.array([seen]), batch)
                carried = 0
            place = np.arange(m) - np.repeat(starts, np.diff(np.append(starts, m))) + 1
            first_end = starts[1] if len(starts) > 1 else m
            place[:first_end] += carried
            ends = np.append(starts[1:], m) - 1
            keep = np.flatnonzero(place <= n)
            if len(ends) > 1:
                yield closed(groups.take(pa.array(ends[:-1])), place[ends[:-1]], batch)
            open_group, seen = groups.slice(m - 1, 1), int(place[-1])
            if len(keep):
                kept = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(np.full(len(keep), part), pa.int32()), pa.array(place[keep], pa.int64()), pa.array(np.zeros(len(keep), np.int64))],
                    names=["grp", "item", "score", "part", "place", "n"],
                )
        if open_group is not None:
            yield closed(open_group, np.array([seen]), last)

    marked = ordered.mapInArrow(run, f"grp {types['grp']}, item {types['item']}, score double, part int, place bigint, n bigint")
    before = F.sum("n").over(Window.partitionBy("grp").orderBy("part", "place").rowsBetween(Window.unboundedPreceding, 0))
    placed = marked.withColumn("rank", F.col("place") + before).where((F.col("n") == 0) & (F.col("rank") <= n))
    return placed.select(F.col("grp").alias(group), F.col("item").alias(item), F.col("score").alias(score), F.col("rank"))


def _run_starts(values: pa.Array) -> np.ndarray:
    """Where runs of equal values begin; null equals null."""
    m = len(values)
    if m == 1:
        return np.array([0])
    a, b = values.slice(0, m - 1), values.slice(1)
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    nulls = values.is_null().to_numpy(zero_copy_only=False)
    return np.append(0, np.flatnonzero(differ | (nulls[1:] != nulls[:-1])) + 1)

"""Runs as text: a first stage and rerankers, as ``bm25 > maxsim@20``; grids of settings; tables for people."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyvec.operators import metrics
from polyvec.operators.rank import rerank, top_k

Scores = Callable[[], DataFrame]


def parse(text: str) -> list[tuple[str, int | None]]:
    """``"hybrid > maxsim@10"`` to ``[("hybrid", None), ("maxsim", 10)]``."""
    stages: list[tuple[str, int | None]] = []
    for part in text.split(">"):
        name, _, depth = part.strip().partition("@")
        if not name.strip() or (depth and not depth.strip().isdigit()):
            raise ValueError(f"not a pipeline: {text!r}")
        stages.append((name.strip(), int(depth) if depth else None))
    if stages[0][1] is not None or any(d is None for _, d in stages[1:]):
        raise ValueError("the first stage has no depth, each reranker has one")
    return stages


def run_pipeline(text: str, scorers: dict[str, Scores], depth: int = 100, keep_tail: bool = True) -> DataFrame:
    """``(query_id, doc_id, score, rank)`` to ``depth``; ``scorers`` has a table of scores for each stage by name.

    The first stage gives as many documents as the deepest reranker wants, if those are more.
    """
    (first, _), *rest = parse(text)
    run = top_k(scorers[first](), max([depth, *(d for _, d in rest)]))
    for name, d in rest:
        run = rerank(run, scorers[name](), d, keep_tail)
    return run.where(F.col("rank") <= depth)


def search_and_evaluate(text: str, scorers: dict[str, Scores], qrels: DataFrame, ks: tuple[int, ...] = metrics.KS) -> tuple[DataFrame, DataFrame]:
    """The run and its metrics per judged query."""
    run = run_pipeline(text, scorers, max(ks))
    return run, metrics.evaluate(run, qrels, ks)


def grid(keep: Callable[[dict], bool] = lambda s: True, **options: list) -> Iterator[dict]:
    """Every combination of options that ``keep`` lets through, such as ``k < w``."""
    for values in itertools.product(*options.values()):
        setting = dict(zip(options, values))
        if keep(setting):
            yield setting


def run_name(family: str, **params: object) -> str:
    """``smve`` with w=64, k=4, center=True: ``smve_w64_k4_center``; what is false or None is left out."""
    return "_".join([family, *(k if v is True else f"{k}{v}" for k, v in params.items() if v is not None and v is not False)])


def markdown(table: DataFrame, most: int = 1000, digits: int = 4) -> str:
    """A small result as a Markdown table; more than ``most`` rows are an error, not cut off."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; a table for people is smaller")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])

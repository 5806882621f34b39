"""python -m polyvec list | show QUERY FOLDER | save QUERY FOLDER OUT | evaluate RUN QRELS OUT NAME

``evaluate`` reads a run in TREC form and judgments as tab-separated values, and saves metrics per query,
curves and a summary under OUT.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession


def main(args: list[str]) -> int:
    from polyvec.plans import queries, report_queries, reports
    from polyvec.sources import tables

    known = queries.queries() | report_queries.queries()
    if args == ["list"]:
        print("\n".join(known))
        return 0
    spark = SparkSession.builder.getOrCreate()
    match args:
        case ["show", name, folder] if name in known:
            known[name](spark, folder).show(50, truncate=80)
        case ["save", name, folder, out] if name in known:
            known[name](spark, folder).write.mode("overwrite").parquet(out)
        case ["evaluate", run, qrels, out, name]:
            rows = tables.read_trec_run(spark, run)
            reports.evaluate_and_save(rows, tables.read_beir_qrels(spark, qrels), out, name, rows.agg({"doc_id": "count"}).first()[0])
        case _:
            print(__doc__, file=sys.stderr)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

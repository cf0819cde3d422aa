"""python -m sluicebox [QUERY] FOLDER: runs a named query over a folder of tables and shows it; without a name, lists the queries."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession


def main(words: list[str]) -> int:
    from .plans import catalogue

    if len(words) != 2 or words[0] not in catalogue.QUERIES:
        print(__doc__, *sorted(catalogue.QUERIES), sep="\n")
        return 0 if not words else 2
    spark = SparkSession.builder.appName(f"sluicebox {words[0]}").getOrCreate()
    catalogue.QUERIES[words[0]](spark, words[1]).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))

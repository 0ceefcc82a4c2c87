"""Command line: similar lines of a text file, for one or more thresholds."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from pairloom.functions.text import text_vectors
from pairloom.operators.assign import assignment, balance_report
from pairloom.operators.join import similar_pairs
from pairloom.operators.layers import layered, partition_sizes, static_tie
from pairloom.operators.stats import observed, sweep
from pairloom.sources.files import read_lines, write_pairs


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="pairloom", add_help=False)
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-t", "--threshold", type=lambda s: [float(x) for x in s.split(",")], default=[0.9])
    p.add_argument("-s", "--inv-size", type=int, default=100)
    p.add_argument("-n", "--numLayers", type=int, default=21)
    p.add_argument("-o", "--output")
    p.add_argument("-m", "--max-weight", type=int, default=500)
    p.add_argument("-h", "--histogram-title", default="histogram")
    p.add_argument("-u", "--uniform", action="store_true")
    p.add_argument("-d", "--debug", action="store_true")
    p.add_argument("--strategy", choices=("auto", "plain", "layered", "prefix", "brute"), default="auto")
    p.add_argument("--help", action="help")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    """Print the report; with -o, write pairs by threshold, too. -d adds what balancing does for indexes of -s vectors."""
    a = arguments(argv)
    spark = SparkSession.builder.appName("pairloom").getOrCreate()
    vectors = text_vectors(read_lines(spark, a.input), limit=a.max_weight)
    print(a.histogram_title)
    sweep(vectors, a.threshold, a.numLayers, a.uniform).orderBy("threshold").show(truncate=False)
    for t in a.threshold:
        if a.debug:
            sizes = partition_sizes(static_tie(layered(vectors, a.numLayers, a.uniform), t))
            print(f"threshold {t}")
            balance_report(assignment(sizes, a.numLayers), sizes, spark.sparkContext.defaultParallelism, a.inv_size).show(truncate=False)
        if a.output:
            pairs, seen = observed(similar_pairs(vectors, t, a.strategy, a.numLayers, a.uniform, assume_normalized=True), f"threshold {t}")
            start = time.perf_counter()
            write_pairs(pairs, f"{a.output.rstrip('/')}/pairs-{t}")
            print(f"threshold {t}: {seen.get['returned']} pairs in {time.perf_counter() - start:.0f} seconds")


if __name__ == "__main__":
    main()

"""``python -m graphloom.cli``: edge list to community features."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph, queues, walk
from graphloom.sources import readers, writers


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-s", "--separator", default="\t")
    p.add_argument("-u", "--undirected", action="store_true")
    p.add_argument("-r", "--restart-probability", type=float, default=0.1)
    p.add_argument("-e", "--epsilon", type=float, default=1e-5)
    p.add_argument("--order", choices=("fifo", "frontier"), default="fifo", help="order of the pushes: a queue for each seed, or rounds over a frontier")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    edges, nodes = readers.edge_list(spark, a.input, a.separator, a.undirected)
    edges = graph.symmetrized(edges)
    local = (queues if a.order == "fifo" else walk).communities(edges, a.restart_probability, a.epsilon)
    n = nodes.count()
    found = walk.features(edges, local).withColumn("community", F.col("community") + F.when(F.col("kind") == "local", n).otherwise(0))
    writers.features_text(found, nodes, a.output, a.separator)


if __name__ == "__main__":
    main()

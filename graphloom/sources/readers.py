"""Readers of edge lists, label matrices, communities and embeddings. Text files, read by Spark alone."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import graph


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(``line``, ``pos``): stripped lines; positions rise within a file and from one file of a folder to the next."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"))


def fields(spark: SparkSession, path: str, separator: str, least: int, comments: bool = True) -> DataFrame:
    """(``pos``, ``f``): split lines without comments; a line of fewer than ``least`` fields raises when it is read."""
    rows = lines(spark, path)
    if comments:
        rows = rows.filter(~F.col("line").startswith("#"))
    f = F.split("line", re.escape(separator))
    short = F.raise_error(F.concat(F.lit(f"line with fewer than {least} fields: "), F.col("line")))
    return rows.select("pos", F.when(F.size(f) >= least, f).otherwise(short.cast("array<string>")).alias("f"))


def edge_list(spark: SparkSession, path: str, separator: str = "\t", undirected: bool = False) -> tuple[DataFrame, DataFrame]:
    """(``edges``, ``nodes(node, node_id)``): source, target and weight on a line; nodes numbered by first appearance.

    Parallel edges are summed; ``undirected`` adds reverses but of self-loops.
    """
    rows = fields(spark, path, separator, 3).select("pos", F.col("f")[0].cast("long").alias("a"), F.col("f")[1].cast("long").alias("b"), F.col("f")[2].cast("double").alias("w"))
    ends = F.explode(F.array(F.struct((F.col("pos") * 2).alias("at"), F.col("a").alias("id")), F.struct((F.col("pos") * 2 + 1).alias("at"), F.col("b").alias("id"))))
    first = rows.select(ends.alias("e")).groupBy(F.col("e.id").alias("node_id")).agg(F.min("e.at").alias("at"))
    nodes = numbered(first, "at").select(F.col("number").alias("node"), "node_id")
    mapped = rows.join(nodes.select(F.col("node").alias("src"), F.col("node_id").alias("a")), "a").join(nodes.select(F.col("node").alias("dst"), F.col("node_id").alias("b")), "b")
    edges = mapped.select("src", "dst", "w")
    return (graph.with_reverse(edges) if undirected else graph.summed(edges)), nodes


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``number`` 0, 1, ... by ``order``: ranks within ranges, plus the rows of the ranges before.

    The ranges are cut at quantiles, so no task ranks the whole table.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx(order, F.array(*[F.lit(i / parts) for i in range(1, parts)] or [F.lit(0.5)]), F.lit(1000))).first()[0] or []
    bucket = F.lit(0)
    for i, cut in enumerate(sorted(set(cuts))):
        bucket = F.when(F.col(order) > cut, i + 1).otherwise(bucket)
    rows = rows.withColumn("_b", bucket)
    sizes = dict(rows.groupBy("_b").count().collect())
    before, total = {}, 0
    for b in sorted(sizes):
        before[b], total = total, total + sizes[b]
    start = F.lit(0)
    for b, n in before.items():
        start = F.when(F.col("_b") == b, n).otherwise(start)
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1
    return rows.withColumn("number", (rank + start).cast("long")).drop("_b")


def unweighted_edges(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Two columns, numbered from 1; weight 1; the reverse is always added, also of self-loops (which get 2)."""
    rows = fields(spark, path, separator, 2)
    e = rows.select((F.col("f")[0].cast("long") - 1).alias("src"), (F.col("f")[1].cast("long") - 1).alias("dst"), F.lit(1.0).alias("w"))
    return graph.with_reverse(e, loops=True)


def label_matrix(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(``node``, ``label``), numbered from 1 in the file; repeated lines count once."""
    f = fields(spark, path, separator, 2)
    return f.select((F.col("f")[0].cast("long") - 1).alias("node"), (F.col("f")[1].cast("long") - 1).alias("label")).distinct()


def header(spark: SparkSession, path: str, separator: str = "\t") -> dict:
    """Rows, columns and direction from the first line of a headered file."""
    f = [x.strip() for x in spark.read.text(path).first()[0].strip().split(separator)]
    return {"n_rows": int(f[1]), "n_columns": int(f[3]), "directed": len(f) > 7 and f[7] == "True"}


def _body(spark, path, separator, least, numbering) -> DataFrame:
    if numbering not in ("matlab", "c"):
        raise RuntimeError(f"unknown numbering: {numbering}")
    base = 1 if numbering == "matlab" else 0
    rows = lines(spark, path).filter(~F.col("line").startswith("n_rows:"))
    f = F.split("line", re.escape(separator))
    return rows.select((f[0].cast("long") - base).alias("a"), (f[1].cast("long") - base).alias("b"), (f[2].cast("double") if least > 2 else F.lit(1.0)).alias("w"))


def headered_edges(spark: SparkSession, path: str, separator: str = "\t", numbering: str = "matlab") -> tuple[DataFrame, int]:
    """(edges, number of nodes) of a headered edge list; reverses are added if the header says undirected."""
    head = header(spark, path, separator)
    e = _body(spark, path, separator, 3, numbering).select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")
    return (graph.summed(e) if head["directed"] else graph.with_reverse(e)), head["n_rows"]


def headered_labels(spark: SparkSession, path: str, separator: str = "\t", numbering: str = "matlab") -> tuple[DataFrame, int]:
    """((``node``, ``label``), number of labels) of a headered file."""
    rows = _body(spark, path, separator, 2, numbering)
    return rows.select(F.col("a").alias("node"), F.col("b").alias("label")).distinct(), header(spark, path, separator)["n_columns"]


def community_lines(spark: SparkSession, path: str, separator: str = "\t", base: int = 0) -> DataFrame:
    """(``node``, ``community``, ``value``): a line lists a community's nodes; communities numbered by line."""
    rows = numbered(lines(spark, path).filter("line <> '' and not startswith(line, '#')"), "pos")
    members = rows.select(F.explode(F.split("line", re.escape(separator))).alias("m"), F.col("number").alias("community"))
    return members.select((F.col("m").cast("long") - base).alias("node"), "community").groupBy("node", "community").agg(F.count("*").cast("double").alias("value"))


def hierarchy(spark: SparkSession, folder: str, levels: int) -> DataFrame:
    """(``node``, ``level``, ``community``, ``value``) of the files tp, tp1, ... : space-separated nodes from 1, each once."""
    out = None
    for level in range(levels):
        part = community_lines(spark, f"{folder}/tp{level or ''}", " ", 1).select("node", F.lit(level).alias("level"), "community", F.lit(1.0).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def matlab_triples(spark: SparkSession, data: str, row: str, column: str) -> DataFrame:
    """(``node``, ``community``, ``value``) of three one-column files matched by line; numbered from 1, maybe as floats."""
    part = lambda path, name: numbered(lines(spark, path), "pos").select("number", F.col("line").cast("double").alias(name))
    joined = part(data, "value").join(part(row, "r"), "number").join(part(column, "c"), "number")
    return joined.select((F.col("r").cast("long") - 1).alias("node"), (F.col("c").cast("long") - 1).alias("community"), "value")


def word_vectors(spark: SparkSession, path: str, n_nodes: int) -> DataFrame:
    """(``node``, ``vec``) of a header line and lines of a node (from 1) and its vector; nodes without one get zeros."""
    size = int(spark.read.text(path).first()[0].split()[1])
    f = F.split("line", " +")
    rows = lines(spark, path).filter(F.size(f) == size + 1)
    vectors = rows.select((f[0].cast("long") - 1).alias("node"), F.slice(f, 2, size).cast("array<double>").alias("vec"))
    return spark.range(n_nodes).withColumnRenamed("id", "node").join(vectors, "node", "left").select("node", F.coalesce("vec", F.array_repeat(F.lit(0.0), size)).alias("vec"))


def dense_rows(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(``node``, ``vec``): line i is the vector of node i."""
    return numbered(lines(spark, path), "pos").select(F.col("number").alias("node"), F.split("line", re.escape(separator)).cast("array<double>").alias("vec"))


#: Methods whose features are sparse, and those whose features are vectors.
SPARSE = ("lapple", "apple", "arcte", "basecomm", "mroc", "edgecluster", "louvain", "oslom", "bigclam")
DENSE = ("lapeig", "deepwalk", "rwmodmax", "repeig", "line")


def features(spark: SparkSession, method: str, path: str) -> DataFrame:
    """Stored features of a method: sparse rows (``node``, ``community``, ``value``) or vectors (``node``, ``vec``)."""
    kind = {m: sparse_features for m in SPARSE} | {m: vector_features for m in DENSE}
    if method.lower() not in kind:
        raise RuntimeError(f"unknown method: {method}")
    return kind[method.lower()](spark, path)


def sparse_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("node", "community", F.col("value").cast("double").alias("value"))


def vector_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("node", F.col("vec").cast("array<double>").alias("vec"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(``node``, ``label``, ``score``) as ``writers.table_once`` keeps them."""
    return spark.read.parquet(path).select("node", "label", "score")


def results(spark: SparkSession, path: str) -> DataFrame:
    """(``pct``, ``measure``, ``mean``, ``std``) of a report that ``writers.results_text`` made."""
    text = [r.line for r in lines(spark, path).filter("line <> ''").orderBy("pos").collect()]  # a report is a few lines
    percentages, out = text[1].split("\t"), []
    for i, line in enumerate(text):
        if line.startswith("--"):
            out += [(float(p), line.strip("-"), float(m), float(d)) for p, m, d in zip(percentages, text[i + 1].split("\t"), text[i + 2].split("\t"), strict=True)]
    return spark.createDataFrame(out, "pct double, measure string, mean double, std double")


#: The files of each dataset's folder, and the field separator.
DATASETS = {
    "snow2014": ("men_ret_graph.tsv", "user_label_matrix.tsv", "\t"),
    "politicsuk": ("men_ret_graph.tsv", "user_label_matrix.tsv", "\t"),
    "flickr": ("edges.csv", "group-edges.csv", ","),
    "youtube": ("edges.csv", "group-edges.csv", ","),
}


def dataset(spark: SparkSession, name: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(``edges``, ``labels``) of a dataset's folder."""
    if name not in DATASETS:
        raise ValueError(f"unknown dataset: {name}")
    graph_file, label_file, separator = DATASETS[name]
    if separator == ",":
        return unweighted_edges(spark, f"{folder}/{graph_file}", separator), label_matrix(spark, f"{folder}/{label_file}", separator)
    return headered_edges(spark, f"{folder}/{graph_file}", separator)[0], headered_labels(spark, f"{folder}/{label_file}", separator)[0]

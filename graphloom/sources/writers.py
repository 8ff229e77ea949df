"""Writers. Tables go to Parquet, interchange formats to text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def features_text(features: DataFrame, nodes: DataFrame, path: str, separator: str = "\t") -> None:
    """Original node id, community and whole part of the value on a line, without a header."""
    rows = features.join(nodes, "node").select("node_id", "community", F.col("value").cast("long"))
    rows.write.csv(path, sep=separator)


def features_table(features: DataFrame, path: str) -> None:
    features.write.parquet(path)


def matrix_text(edges: DataFrame, path: str, n_rows: int, n_columns: int, separator: str = ",", directed: bool = False, numbering: str = "matlab") -> None:
    """A line of shape and direction, then the entries; of an undirected matrix those on and above the diagonal.

    The header counts the entries of the whole matrix. It is the first line of the first part file.
    """
    base = 1 if numbering == "matlab" else 0
    head = separator.join(map(str, ["n_rows:", n_rows, "n_cols:", n_columns, "nnz:", edges.count(), "directed:", directed]))
    rows = edges if directed else edges.filter("dst >= src")
    text = rows.select(F.concat_ws(separator, F.col("src") + base, F.col("dst") + base, F.col("w")).alias("value"))
    first = edges.sparkSession.createDataFrame([(head,)], "value string").coalesce(1)
    first.unionByName(text).write.text(path)


def names_to_topics(labels: DataFrame, nodes: DataFrame, names: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(``name``, ``lemmas``): ``names(node_id, name)`` and ``lemmas(label, lemma)`` looked up, each lemma once, in order."""
    joined = labels.join(nodes, "node").join(names, "node_id").join(lemmas, "label")
    return joined.groupBy("name").agg(F.sort_array(F.collect_set("lemma")).alias("lemmas"))


def table_once(rows: DataFrame, path: str) -> None:
    """Scores, folds and predictions: written unless they are there."""
    rows.write.mode("ignore").parquet(path)


def results_text(stats: DataFrame, path: str) -> None:
    """``stats(pct, <measure>_mean, <measure>_std, ...)`` as a report: the percentages, then two lines for each measure."""
    names = [c[: -len("_mean")] for c in stats.columns if c.endswith("_mean")]
    rows = stats.orderBy("pct").collect()  # a row for each percentage
    text = ["*** Percentages:", "\t".join(f"{r.pct:g}" for r in rows)]
    for name in names:
        text += ["", "", f"--{name}--", *("\t".join(str(r[f"{name}_{part}"]) for r in rows) for part in ("mean", "std"))]
    stats.sparkSession.createDataFrame([(line,) for line in text], "value string").coalesce(1).write.text(path)


def names_to_topics_text(labels: DataFrame, nodes: DataFrame, names: DataFrame, lemmas: DataFrame, path: str, separator: str = "\t") -> None:
    """A line for each name: it and its lemmas in order."""
    found = names_to_topics(labels, nodes, names, lemmas)
    found.select(F.concat_ws(separator, "name", "lemmas").alias("value")).write.text(path)

"""Stationary distributions and fusion of several views of one graph: ``views(view, src, dst, w)``."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import blocks, graph
from graphloom.session import discard, map_arrow, written


def stationary_distribution(edges: DataFrame, rho: float, iterations: int = 50, tolerance: float | None = None, every: int = 10, change: float | None = None) -> DataFrame:
    """(``node``, ``pi``): PageRank with teleport probability ``rho``; dangling mass is spread evenly.

    Stops after ``iterations`` or, with a ``tolerance``, once the L1 change of a round is below nodes * tolerance, or with
    ``change`` once it is below that. With either the first round is mixed with the start by 1 to 1 - rho, which leaves what the rounds
    go to as it is but takes out what would swing between the sides of a bipartite graph for 1 / rho times as long as the rest.
    A graph of more than one block (``blocks``) is cut once, and a round exchanges arrays of a block. The change is looked at each
    ``every`` rounds, and rounds of rows are cut in the shared folder then.
    """
    own = None if hasattr(edges, "_graphloom_path") else written(edges.select("src", "dst", "w"), once=True)
    edges = edges if own is None else own
    end = lambda node, w, leaves: F.struct(F.col(node).alias("node"), w.alias("d"), F.lit(leaves).alias("leaves"))
    ends = edges.select(F.explode(F.array(end("src", F.col("w"), 1), end("dst", F.lit(0.0), 0))).alias("e")).groupBy("e.node").agg(F.sum("e.d").alias("d"), F.max("e.leaves").alias("leaves"))
    # The out-degree that shares are made with; 0 where nothing leaves.
    all_nodes = written(ends.select("node", F.when(F.col("leaves") == 0, 0.0).when(F.col("d") == 0, 1.0).otherwise(F.col("d")).alias("d")), once=True)
    n, has_dangling = all_nodes.count(), not all_nodes.filter("d = 0").isEmpty()
    limit = n * tolerance if tolerance is not None else change
    mix = 0.0 if limit is None else 1 - rho
    size = blocks.count_for(n, edges.count())
    if size == 1:
        walk = written(graph.transitions(edges), once=True)
        discard(own)
        return _by_rows(walk, all_nodes, n, has_dangling, rho, iterations, limit, every, mix)
    ids = blocks.numbered(all_nodes, size, "d")
    matrix = blocks.Matrix(edges.select(F.col("dst").alias("row"), F.col("src").alias("col"), "w"), ids, ids, size, size)
    discard(own)
    state = written(map_arrow(ids, partial(_start, n=n), _PI))
    for turn in range(iterations):
        lost = (state.agg(F.sum("lost")).first()[0] or 0.0) / n if has_dangling else 0.0
        before, state = state, written(matrix.times(state, 1, state, partial(_next, rho=rho, n=n, lost=lost, mix=mix if turn == 0 else 0.0), _PI, "sent"), once=True)
        discard(before)
        if limit is not None and not (turn + 1) % every and state.agg(F.sum("change")).first()[0] < limit:
            break
    else:
        if limit is not None:
            raise RuntimeError(f"no convergence in {iterations} iterations")
    matrix.drop()
    pi = written(blocks.rows_of(ids, state, 1).select("node", F.col("x")[0].alias("pi")))
    discard(all_nodes, ids, state)
    return pi


def _by_rows(walk: DataFrame, all_nodes: DataFrame, n: int, has_dangling: bool, rho: float, iterations: int, limit: float | None, every: int, mix: float) -> DataFrame:
    """The same for a graph of one block, on which a job for each round would take longer than rows do."""
    pi = all_nodes.select("node", F.lit(1.0 / n).alias("pi"))
    for turn in range(iterations):
        moved = pi.join(walk.withColumnRenamed("src", "node"), "node").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("pi") * F.col("p")).alias("m"))
        lost = F.lit(0.0)
        if has_dangling:
            lost = F.lit(pi.join(all_nodes.filter("d = 0"), "node").agg(F.sum("pi")).first()[0] / n)
        before, share = pi, mix if turn == 0 else 0.0
        pi = all_nodes.join(moved, "node", "left").select("node", (((1 - rho) * (F.coalesce("m", F.lit(0.0)) + lost) + rho / n + share / n) / (1 + share)).alias("pi"))
        if (turn + 1) % every and (limit is None or (turn + 2) % every):
            continue
        pi = written(pi)  # with a limit also the round before it is looked at, which is not made anew then
        if limit is not None and not (turn + 1) % every and pi.join(before.withColumnRenamed("pi", "q"), "node").agg(F.sum(F.abs(F.col("pi") - F.col("q")))).first()[0] < limit:
            return pi
    if limit is not None:
        raise RuntimeError(f"no convergence in {iterations} iterations")
    return pi


_PI = "block int, d binary, x binary, sent binary, lost double, change double"


def _row(row: dict, x: np.ndarray, change: float) -> dict:
    """A block's row with ``x``, what each of its nodes sends for a unit of weight, and what nothing leaves with."""
    d = np.frombuffer(row["d"])
    stays = d == 0
    return {"block": row["block"], "d": row["d"], "x": x.tobytes(), "sent": np.where(stays, 0.0, x / np.where(stays, 1.0, d)).tobytes(), "lost": float(x[stays].sum()), "change": change}


def _start(batches, n):
    schema = pa.schema([("block", pa.int32()), *((c, pa.binary()) for c in ("d", "x", "sent")), ("lost", pa.float64()), ("change", pa.float64())])
    for batch in batches:
        yield pa.RecordBatch.from_pylist([_row(b, np.full(len(b["d"]) // 8, 1 / n), 0.0) for b in batch.to_pylist()], schema)


def _next(y: np.ndarray | None, row: dict, rho: float, n: int, lost: float, mix: float = 0.0) -> dict:
    """A block's row after a round, with ``mix`` times what was there before."""
    before = np.frombuffer(row["x"])
    x = ((1 - rho) * ((0.0 if y is None else y) + lost) + rho / n + mix * before) / (1 + mix)
    return _row(row, x, float(np.abs(x - before).sum()))


def implicit_combinatorial(pi: DataFrame, walk: DataFrame) -> DataFrame:
    """(Pi W + its transpose) / 2."""
    flow = walk.join(pi.withColumnRenamed("node", "src"), "src").select("src", "dst", (F.col("pi") * F.col("p")).alias("w"))
    return graph.symmetrized(flow)


def implicit_directed(pi: DataFrame, walk: DataFrame) -> DataFrame:
    """Q = sqrt(Pi) W / sqrt(Pi); (Q + its transpose) / 2."""
    flow = walk.join(pi.select(F.col("node").alias("src"), F.col("pi").alias("a")), "src").join(pi.select(F.col("node").alias("dst"), F.col("pi").alias("b")), "dst")
    return graph.symmetrized(flow.select("src", "dst", (F.sqrt("a") * F.col("p") / F.sqrt("b")).alias("w")))


def view_transitions(views: DataFrame) -> DataFrame:
    sums = views.groupBy("view", "src").agg(F.sum("w").alias("d"))
    return views.join(sums, ["view", "src"]).select("view", "src", "dst", (F.col("w") / F.when(F.col("d") == 0, 1.0).otherwise(F.col("d"))).alias("p"))


def fuse_views(views: DataFrame, weights: dict) -> DataFrame:
    """Convex combination of the views' transitions; weights are normalised to sum 1."""
    total = sum(weights.values())
    a = F.lit(0.0)
    for view, w in weights.items():
        a = F.when(F.col("view") == view, F.lit(w / total)).otherwise(a)
    return view_transitions(views).groupBy("src", "dst").agg(F.sum(a * F.col("p")).alias("p"))


def fuse_stationary(pis: DataFrame, weights: dict) -> DataFrame:
    """``pis(view, node, pi)`` -> their weighted sum; zeros become half the smallest positive value."""
    total = sum(weights.values())
    a = F.lit(0.0)
    for view, w in weights.items():
        a = F.when(F.col("view") == view, F.lit(w / total)).otherwise(a)
    fused = pis.groupBy("node").agg(F.sum(a * F.col("pi")).alias("pi"))
    least = fused.agg((F.min(F.when(F.col("pi") > 0, F.col("pi"))) / 2).alias("half"))
    return fused.crossJoin(F.broadcast(least)).select("node", F.when(F.col("pi") > 0, F.col("pi")).otherwise(F.col("half")).alias("pi"))


def fuse_addition(views: DataFrame, weights: dict) -> DataFrame:
    """Sum of the weighted views, each averaged with its transpose."""
    total = sum(weights.values())
    a = F.lit(0.0)
    for view, w in weights.items():
        a = F.when(F.col("view") == view, F.lit(w / total)).otherwise(a)
    return graph.symmetrized(views.select("src", "dst", (a * F.col("w")).alias("w")))


def entropy(values: DataFrame, column: str, norm: bool = False) -> DataFrame:
    """One row (``entropy``) of a column's shares, natural logarithm; ``norm``: the smallest share is taken off first."""
    total = values.agg(F.sum(column).alias("total"))
    shares = values.crossJoin(F.broadcast(total)).select((F.col(column) / F.col("total")).alias("share"))
    if norm:
        ends = shares.agg(F.min("share").alias("least"), (F.sum("share") - F.min("share") * F.count("*")).alias("left"))
        shares = shares.crossJoin(F.broadcast(ends)).select(((F.col("share") - F.col("least")) / F.col("left")).alias("share"))
    return shares.filter("share > 0").agg(F.coalesce(F.sum(-F.col("share") * F.log("share")), F.lit(0.0)).alias("entropy"))


def safe_convex_weights(views: DataFrame, weights: dict | None = None) -> DataFrame:
    """(``node``, ``view``, ``a``): at each node the weights of the views in which it has an out-degree, summing to 1."""
    present = views.groupBy("view", F.col("src").alias("node")).agg(F.sum("w").alias("d")).filter("d > 0").select("node", "view")
    return _shared_out(present.withColumn("x", _weight_of(weights)))


def entropy_view_weights(views: DataFrame) -> DataFrame:
    """(``node``, ``view``, ``a``): at each node the entropies of its rows of the views' transitions, summing to 1.

    Where all of a node's rows have entropy 0 (one neighbour in each view), its views count alike.
    """
    rows = view_transitions(views).filter("p > 0").groupBy("view", F.col("src").alias("node")).agg(F.sum(-F.col("p") * F.log("p")).alias("x"))
    some = rows.groupBy("node").agg(F.max("x").alias("most"))
    return _shared_out(rows.join(some, "node").select("node", "view", F.when(F.col("most") > 1e-12, F.col("x")).otherwise(1.0).alias("x")))


def _weight_of(weights: dict | None):
    if weights is None:
        return F.lit(1.0)
    a = F.lit(0.0)
    for view, w in weights.items():
        a = F.when(F.col("view") == view, F.lit(float(w))).otherwise(a)
    return a


def _shared_out(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("node").agg(F.sum("x").alias("all"))
    return rows.join(sums, "node").filter(F.col("all") > 0).select("node", "view", (F.col("x") / F.col("all")).alias("a"))


def graph_fusion(views: DataFrame, weights: dict | None = None, method: str = "zhou") -> DataFrame:
    """(``src``, ``dst``, ``p``): the views' transitions, each row by its node's own weights of the views."""
    if method not in ("zhou", "entropy"):
        raise ValueError(f"unknown method: {method}")
    a = safe_convex_weights(views, weights) if method == "zhou" else entropy_view_weights(views)
    joined = view_transitions(views).join(a.withColumnRenamed("node", "src"), ["src", "view"])
    return joined.groupBy("src", "dst").agg(F.sum(F.col("a") * F.col("p")).alias("p")).filter("p <> 0")


def graph_fusion_directed(views: DataFrame, weights: dict | None = None, fusion: str = "zhou", laplacian: str = "combinatorial", rho: float = 0.15, tolerance: float = 1e-7) -> tuple[DataFrame, DataFrame]:
    """(adjacency, Laplacian) of several directed views, both (``src``, ``dst``, ``w``).

    ``zhou`` and ``entropy`` mix the views' walks by their stationary distributions and the nodes' weights of the
    views, and build the implicit matrix that ``laplacian`` names; ``addition`` adds the weighted views.
    """
    if fusion not in ("zhou", "entropy", "addition") or laplacian not in ("combinatorial", "directed"):
        raise ValueError(f"unknown fusion or Laplacian: {fusion}, {laplacian}")
    views = written(views.select("view", "src", "dst", "w"), once=True)
    a = entropy_view_weights(views) if fusion == "entropy" else safe_convex_weights(views, weights)
    if fusion == "addition":
        own = views.join(a.withColumnRenamed("node", "src"), ["src", "view"])
        adjacency = graph.symmetrized(own.select("src", "dst", (F.col("a") * F.col("w")).alias("w")))
        degree = adjacency.groupBy(F.col("dst").alias("node")).agg(F.sum("w").alias("d"))
    else:
        every = graph.nodes(views)
        pis = None
        for row in views.select("view").distinct().orderBy("view").collect():  # views are a few names
            one = views.filter(F.col("view") == row.view)
            pi = stationary_distribution(one.select("src", "dst", "w"), rho, 200, tolerance)
            pi = every.join(pi, "node", "left").select(F.lit(row.view).alias("view"), "node", F.coalesce("pi", F.lit(0.0)).alias("pi"))
            pis = pi if pis is None else pis.unionByName(pi)
        flow = written(pis.join(a, ["node", "view"], "left").select("view", "node", (F.col("pi") * F.coalesce("a", F.lit(0.0))).alias("flow")))
        fused = flow.groupBy("node").agg(F.sum("flow").alias("pi"))
        least = fused.agg((F.min(F.when(F.col("pi") > 0, F.col("pi"))) / 2).alias("half"))
        pi = written(fused.crossJoin(F.broadcast(least)).select("node", F.when(F.col("pi") > 0, F.col("pi")).otherwise(F.col("half")).alias("pi")))
        share = flow.join(pi, "node").select("view", F.col("node").alias("src"), (F.col("flow") / F.col("pi")).alias("share"))
        walk = view_transitions(views).join(share, ["view", "src"]).groupBy("src", "dst").agg(F.sum(F.col("share") * F.col("p")).alias("p"))
        adjacency = implicit_combinatorial(pi, walk) if laplacian == "combinatorial" else implicit_directed(pi, walk)
        degree = pi.select("node", (F.col("pi") if laplacian == "combinatorial" else F.lit(1.0)).alias("d"))
    adjacency = adjacency.filter("w <> 0")
    return adjacency, _minus(degree, adjacency)


def _minus(degree: DataFrame, adjacency: DataFrame) -> DataFrame:
    diagonal = degree.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.col("d").alias("w"))
    return graph.summed(diagonal.unionByName(adjacency.select("src", "dst", (-F.col("w")).alias("w")))).filter("w <> 0")


def implicit_adjacencies(edges: DataFrame, rho: float = 0.2, iterations: int = 200, tolerance: float | None = 1e-7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(combinatorial adjacency, directed adjacency, stationary distribution) of a directed graph."""
    edges = written(edges.select("src", "dst", "w"), once=True)
    pi = stationary_distribution(edges, rho, iterations, tolerance)
    walk = graph.transitions(edges)
    return implicit_combinatorial(pi, walk), implicit_directed(pi, walk), pi


def combinatorial_laplacian(edges: DataFrame, rho: float = 0.2, iterations: int = 200, tolerance: float | None = 1e-7) -> DataFrame:
    """Diagonal of the stationary distribution less the implicit combinatorial adjacency."""
    combinatorial, _, pi = implicit_adjacencies(edges, rho, iterations, tolerance)
    return _minus(pi.select("node", F.col("pi").alias("d")), combinatorial)


def directed_laplacian(edges: DataFrame, rho: float = 0.2, iterations: int = 200, tolerance: float | None = 1e-7) -> DataFrame:
    """Identity less the implicit directed adjacency."""
    _, directed, pi = implicit_adjacencies(edges, rho, iterations, tolerance)
    return _minus(pi.select("node", F.lit(1.0).alias("d")), directed)

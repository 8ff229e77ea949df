"""Rows that exchanges carry, on graphs in which hubs or copies made them many; results against plain loops."""

import zlib

import pytest
from pyspark.sql import functions as F

from graphloom import session
from graphloom.operators import graph, quality
from graphloom.plans import registry

HUB, N = 0, 150


@pytest.fixture
def shuffled(spark):
    """How many rows the exchanges of a DataFrame's run carry, and its rows; no join is by broadcast."""
    sc = spark.sparkContext

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    def run(make):
        before = total()
        rows = make().collect()
        return total() - before, rows

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield run
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture
def hub(spark):
    """A hub joined to N nodes that form a ring; N communities of the hub, a node and the next."""
    pairs = [(HUB, i) for i in range(1, N + 1)] + [(i, i % N + 1) for i in range(1, N + 1)]
    edges = [(a, b, 1.0) for x, y in pairs for a, b in ((x, y), (y, x))]
    members = [(i, x) for i in range(1, N + 1) for x in (HUB, i, i % N + 1)]
    return edges, members, spark.createDataFrame(edges, "src long, dst long, w double"), spark.createDataFrame(members, "community long, node long")


def test_internal_entries_do_not_list_a_hub_for_each_community(shuffled, hub):
    edges, members, e, m = hub
    of = {}
    for c, x in members:
        of.setdefault(c, set()).add(x)
    n, rows = shuffled(lambda: quality.conductance(e, m))
    for r in rows:
        inside = sum(a in of[r.community] and b in of[r.community] for a, b, _ in edges)
        touched = sum(a in of[r.community] or b in of[r.community] for a, b, _ in edges)
        assert r.conductance == (touched - inside) / 2 / min(inside, len(edges) - touched)
    assert len(rows) == N and n < 60 * len(edges)  # N * 2 * N rows of hub and community before, 4 N of edges
    n, rows = shuffled(lambda: quality.fast_conductance(e, m))
    for r in rows:
        inside = sum(a in of[r.community] and b in of[r.community] for a, b, _ in edges)
        assert (r.volume, r.cut) == (inside, sum(a in of[r.community] for a, _, _ in edges) - inside)


def test_pairs_of_communities_travel_as_arrays(spark, shuffled):
    members = [(20 * x + i, x) for x in range(60) for i in range(20)]
    n, rows = shuffled(lambda: quality.jaccard_pairs(spark.createDataFrame(members, "community long, node long")))
    assert sorted(tuple(r) for r in rows) == [(20 * x + i, 20 * x + j, 1.0) for x in range(60) for i in range(20) for j in range(i + 1, 20)]
    assert n < 25_000  # 39,000 when each pair was a row at each node, 16,200 now


def test_alike_communities_are_counted_at_their_nodes(spark, monkeypatch):
    members = [(c, x) for c in range(60) for x in range(80) if zlib.crc32(f"{c}:{x}".encode()) % 2]
    of = {c: {x for d, x in members if d == c} for c in range(60)}
    at_nodes = sum(f * (f - 1) // 2 for f in (sum(x in m for m in of.values()) for x in range(80)))
    looked_up, shared = [], quality._shared

    def counted(pairs, posts):
        looked_up.append(pairs.agg(F.sum(F.least("nx", "ny"))).first()[0] or 0)
        return shared(pairs, posts)

    monkeypatch.setattr(quality, "_shared", counted)
    rows = quality.best_partner(spark.createDataFrame(members, "community long, node long")).collect()
    for r in rows:
        like = {d: round(len(of[r.community] & of[d]) / len(of[r.community] | of[d]), 12) for d in of if d != r.community}
        assert (r.partner, r.jaccard) == min(((d, j) for d, j in like.items()), key=lambda x: (-x[1], x[0]))
    assert len(rows) == 60 and sum(looked_up) <= at_nodes


def test_exchanges_have_partitions_for_all_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ROWS", 50, raising=False)
    spark.range(1000).selectExpr("id as l_orderkey", "id % 7 as l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1000).selectExpr("id as o_orderkey", "id % 11 as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    old, adaptive = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = registry.symmetrized(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() == 20 and found.count() == 2 * 77
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_a_task_takes_a_bounded_share_of_files_and_exchanges(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    before = {key: spark.conf.get(key) for key in session.SETTINGS}
    try:
        session.dealt(spark.read.parquet(str(tmp_path / "t")))
        bytes_ = {key: spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) for key in session.SETTINGS}
        assert bytes_["spark.sql.files.maxPartitionBytes"] <= 16 << 20  # 128 MB before
        assert bytes_["spark.sql.adaptive.advisoryPartitionSizeInBytes"] <= 8 << 20  # 64 MB before
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_a_node_sends_its_communities_once_to_each_range(spark, shuffled):
    """Two far groups of 30 nodes, each in the same 40 communities: a node's list goes to few ranges, not to 40 communities."""
    members = [(1000 * g + c, 100 * g + x) for g in range(2) for c in range(40) for x in range(30)]
    n, rows = shuffled(lambda: quality._met(spark.createDataFrame([(*x, 30) for x in members], "community long, node long, n long")))
    assert sorted((r.c1, r.c2, r.n1, r.n2, r.k) for r in rows) == [(1000 * g + c, 1000 * g + d, 30, 30, 30) for g in range(2) for c in range(40) for d in range(c + 1, 40)]
    assert n < 2 * len(members)  # and 39 more for each of the 60 nodes before


def test_quality_queries_read_lineitem_once(spark, tmp_path, monkeypatch):
    spark.range(300).selectExpr("id as l_orderkey", "id % 7 as l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(300).selectExpr("id as o_orderkey", "id % 11 as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    for query in (registry.conductance, registry.incremental_conductance, registry.decremental_conductance, registry.jaccard_pairs):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan and "o_orderkey" not in plan  # read and written before, once


def test_both_directions_exchange_each_entry_once(spark, shuffled):
    rows = [(a, b, 1.0 + a) for a in range(40) for b in range(a % 7, 40, 7)]
    e = spark.createDataFrame(rows, "src long, dst long, w double")
    of = {(a, b): w for a, b, w in rows}
    n, found = shuffled(lambda: graph.symmetrized(e))
    assert {(r.src, r.dst): r.w for r in found} == {x: (of.get(x, 0.0) + of.get(x[::-1], 0.0)) / 2 for x in of.keys() | {(b, a) for a, b in of}}
    assert n <= len(rows)  # twice as many before
    for loops in (False, True):
        found = {(r.src, r.dst): r.w for r in graph.with_reverse(e, loops).collect()}
        assert found == {(a, b): of.get((a, b), 0.0) + (of.get((b, a), 0.0) if a != b or loops else 0.0) for x in of for a, b in (x, x[::-1])}

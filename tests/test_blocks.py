import numpy as np
import pytest

from graphloom.operators import blocks, fusion
from graphloom.plans import registry


def test_rounds_exchange_blocks_and_not_entries(spark, monkeypatch):
    monkeypatch.setattr(blocks, "NODES", 20)
    monkeypatch.setattr(blocks, "PIECE", 7)
    rng = np.random.default_rng(1)
    n = 60
    a = (rng.random((n, n)) < 0.2) * rng.integers(1, 5, (n, n)).astype(float)
    a[:, 0] += 1.0
    a[[3, 17]] = 0.0  # nothing leaves
    e = spark.createDataFrame([(int(i) * 7, int(j) * 7, float(a[i, j])) for i, j in zip(*np.nonzero(a))], "src long, dst long, w double")
    assert blocks.count_for(n, len(a)) == 3
    x = np.full(n, 1 / n)
    for _ in range(6):
        sums = a.sum(1)
        x = 0.85 * (a.T @ np.where(sums == 0, 0, x / np.where(sums == 0, 1, sums)) + x[sums == 0].sum() / n) + 0.15 / n
    written = []
    times = blocks.Matrix.times

    def counted(self, block, k, state, finish, schema, column="x"):
        written.append(spark.table(self.name).count())
        return times(self, block, k, state, finish, schema, column)

    monkeypatch.setattr(blocks.Matrix, "times", counted)
    got = {r.node: r.pi for r in fusion.stationary_distribution(e, 0.15, 6).collect()}
    assert [got[7 * i] for i in range(n)] == pytest.approx(x.tolist(), abs=1e-12)
    assert len(written) == 6 and written[0] < np.count_nonzero(a) / 4  # pieces, not entries
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("pieces_")]


def _small(spark):
    """Two bipartite graphs and a triangle, so that one eigenvalue -1 is there twice."""
    rng = np.random.default_rng(5)
    weight = {(a, 20 + int(b)): float(w) for a, b, w in zip(range(20), rng.integers(0, 9, 20), rng.integers(1, 5, 20))}
    weight |= {(int(a), 20 + int(b)): 1.0 + int(a + b) % 3 for a, b in rng.integers(0, 9, (40, 2))} | {(50, 51): 1.0, (51, 52): 2.0, (60, 61): 1.0, (61, 62): 1.0, (60, 62): 3.0}
    weight |= {(b, a): w for (a, b), w in weight.items()}
    ids = sorted({a for a, _ in weight})
    m = np.zeros((len(ids), len(ids)))
    for (a, b), w in weight.items():
        m[ids.index(a), ids.index(b)] = w
    p = m / m.sum(1)[:, None]
    pi = np.linalg.solve(np.eye(len(ids)) - 0.85 * p.T, np.full(len(ids), 0.15 / len(ids)))
    return spark.createDataFrame([(a, b, w) for (a, b), w in weight.items()], "src long, dst long, w double"), ids, p, pi


@pytest.mark.parametrize("entries", [10**9, 20])
def test_stationary_distribution_goes_on_to_its_end(spark, monkeypatch, entries):
    """Twenty rounds leave a few hundredths of the difference between the sides of a bipartite graph."""
    e, ids, p, pi = _small(spark)
    monkeypatch.setattr(registry, "edges", lambda spark, sf_dir: e)
    monkeypatch.setattr(blocks, "ENTRIES", entries)
    got = {r.node: r.pi for r in registry.stationary_distribution(spark, "").collect()}
    assert np.abs(np.array([got[x] for x in ids]) - pi).max() < 1e-11


def test_implicit_matrix_of_the_whole_distribution(spark, monkeypatch):
    e, ids, p, pi = _small(spark)
    monkeypatch.setattr(registry, "edges", lambda spark, sf_dir: e)
    flow = pi[:, None] * p
    want = {(a, b): (flow[i, j] + flow[j, i]) / 2 for i, a in enumerate(ids) for j, b in enumerate(ids) if p[i, j]}
    got = {(r.src, r.dst): r.w for r in registry.implicit_combinatorial(spark, "").collect()}
    assert got.keys() == want.keys() and max(abs(got[x] - want[x]) for x in want) < 1e-11


def test_views_are_made_once_and_mixed_as_a_dense_matrix(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(v, int(a), int(b), float(w)) for v, n in (("F", 7), ("O", 6)) for a, b, w in zip(rng.integers(0, n, 30), rng.integers(0, n, 30), rng.integers(1, 5, 30)) if a < b]
    rows += [(v, b, a, w) for v, a, b, w in rows] + [("F", x, x + 1, 1.0) for x in range(6)] + [("O", x + 1, x, 1.0) for x in range(5)] + [("F", 6, 0, 1.0), ("O", 0, 5, 1.0)]
    spark.createDataFrame(rows, "view string, src long, dst long, w double").groupBy("view", "src", "dst").agg({"w": "sum"}).toDF("view", "src", "dst", "w").write.parquet(str(tmp_path / "views"))
    found = fusion.graph_fusion_directed(spark.read.parquet(str(tmp_path / "views")), {"F": 2.0, "O": 1.0}, "zhou", "directed", 0.15, 1e-14)[0]
    assert str(tmp_path) not in found._jdf.queryExecution().optimizedPlan().toString() + "".join(found.inputFiles())
    p, pi, has = {}, {}, {}
    for v in "FO":
        m = np.zeros((7, 7))
        for u, a, b, w in rows:
            m[a, b] += w * (u == v)
        has[v], ids = m.sum(1) > 0, np.flatnonzero(m.sum(0) + m.sum(1))
        p[v] = np.divide(m, m.sum(1)[:, None], out=np.zeros_like(m), where=m.sum(1)[:, None] > 0)
        pi[v] = np.zeros(7)
        pi[v][ids] = np.linalg.solve(np.eye(len(ids)) - 0.85 * p[v][np.ix_(ids, ids)].T, np.full(len(ids), 0.15 / len(ids)))
    all_a = 2.0 * has["F"] + has["O"]
    flow = {"F": pi["F"] * 2.0 * has["F"] / all_a, "O": pi["O"] * has["O"] / all_a}
    total = flow["F"] + flow["O"]
    walk = sum((flow[v] / total)[:, None] * p[v] for v in "FO")
    q = np.sqrt(total)[:, None] * walk / np.sqrt(total)[None, :]
    want = (q + q.T) / 2
    got = np.zeros((7, 7))
    for r in found.collect():
        got[r.src, r.dst] = r.w
    assert np.abs(got - want).max() < 1e-9

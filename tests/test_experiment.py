import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import experiment, folds, fusion, learn, louvain, weighting
from graphloom.sources import readers, writers

EDGE = "src long, dst long, w double"


def cliques(spark):
    pairs = [(a, b) for g in (0, 10) for a in range(g, g + 6) for b in range(g, g + 6) if a != b] + [(0, 10), (10, 0)]
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], EDGE)


def test_folds_against_brute_force(spark):
    rows = [(i, f"l{(i + j) % 4}") for i in range(40) for j in range(1 + i % 2)]
    found = {(r.trial, r.node): r.role for r in folds.folds(spark.createDataFrame(rows, "node long, label string"), 33, 3).collect()}
    for trial in range(3):
        order = sorted({n for n, _ in rows}, key=lambda n: (hashlib.md5(f"{trial}:{n}".encode()).hexdigest(), n))
        have = lambda n, lab: (n, lab) in set(rows)
        labels = sorted({lab for _, lab in rows})
        train = {next(n for n in order if have(n, lab)) for lab in labels}
        test = {next(n for n in order if have(n, lab) and n not in train) for lab in labels}
        rest = [n for n in order if n not in train | test]
        train |= set(rest[: max(0, math.ceil(33 * 40 / 100) - len(train))])
        assert {n for n in order if found[trial, n] == "train"} == train


def test_kept_folds_do_not_change(spark, tmp_path):
    lab = spark.createDataFrame([(i, i % 2) for i in range(12)], "node long, label long")
    first = folds.folds_once(lab, str(tmp_path), 50, 2).collect()
    assert sorted(folds.folds_once(lab.limit(3), str(tmp_path), 50, 2).collect()) == sorted(first)


def test_louvain_parts_two_cliques(spark):
    e = cliques(spark)
    found = louvain.louvain(e)
    top = found.filter(F.col("level") == found.agg(F.max("level")).first()[0])
    sides = {r.node: r.community for r in top.collect()}
    assert len({sides[i] for i in range(6)}) == len({sides[i] for i in range(10, 16)}) == 1 and sides[0] != sides[10]
    got = louvain.modularity(e, top.select("node", "community"))
    assert got == pytest.approx(60 / 62 - 2 * (31 / 62) ** 2)


def test_experiment_on_separable_labels(spark):
    e = cliques(spark)
    lab = spark.createDataFrame([(i, "a" if i < 10 else "b") for i in (*range(6), *range(10, 16))], "node long, label string")
    plain = {"community_weighting": "ivf"}
    row = experiment.run_experiment(e, lab, "basecomm", (50,), 2, plain).first()
    assert row.macro_f1_mean == row.micro_f1_mean == 1.0 and row.macro_f1_std == 0.0
    with pytest.raises(ValueError):
        experiment.feature_parameters("unknown")


def _table(spark, x):
    return spark.createDataFrame([(i, c, float(v)) for i, r in enumerate(x) for c, v in enumerate(r)], "node long, community long, value double")


def test_logistic_and_counts_reach_small_gradients(spark):
    x = np.random.default_rng(4).random((12, 2)) + 0.1
    y = np.where(x[:, 0] > x[:, 1], 1.0, -1.0)
    lab = spark.createDataFrame([(i, "p" if v > 0 else "n") for i, v in enumerate(y)], "node long, label string")
    got = {r.community: r.w for r in learn.fit_linear(_table(spark, x), lab, 1.0, 200, 1e-3, "logistic").filter("label = 'p'").collect()}
    w = np.array([got[0], got[1]])
    slope = lambda w: np.linalg.norm(w - x.T @ (y / (1 + np.exp(y * (x @ w)))))
    assert slope(w) <= 5e-3 * slope(np.zeros(2))
    ones = learn.with_intercept(_table(spark, x))
    assert ones.filter("community = -1 and value = 1").count() == 12


def test_entropies(spark):
    views = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 0, 2, 1.0), ("b", 0, 1, 3.0), ("b", 1, 0, 1.0)], "view string, src long, dst long, w double")
    found = {(r.node, r.view): r.a for r in fusion.entropy_view_weights(views).collect()}
    assert found == {(0, "a"): 1.0, (0, "b"): 0.0, (1, "b"): 1.0}
    convex = {(r.node, r.view): r.a for r in fusion.safe_convex_weights(views, {"a": 3.0, "b": 1.0}).collect()}
    assert convex == {(0, "a"): 0.75, (0, "b"): 0.25, (1, "b"): 1.0}
    values = spark.createDataFrame([(1.0,), (3.0,), (4.0,)], "x double")
    p = np.array([1, 3, 4]) / 8
    assert fusion.entropy(values, "x").first()[0] == pytest.approx(-(p * np.log(p)).sum())
    q = (p - p.min()) / (p - p.min()).sum()
    assert fusion.entropy(values, "x", norm=True).first()[0] == pytest.approx(-(q[q > 0] * np.log(q[q > 0])).sum())


def test_reports_come_back(spark, tmp_path):
    stats = spark.createDataFrame([(1.0, 0.5, 0.1, 0.6, 0.2), (2.0, 0.7, 0.0, 0.8, 0.0)], "pct double, macro_f1_mean double, macro_f1_std double, micro_f1_mean double, micro_f1_std double")
    writers.results_text(stats, f"{tmp_path}/report")
    back = {(r.pct, r.measure): (r.mean, r.std) for r in readers.results(spark, f"{tmp_path}/report").collect()}
    assert back == {(1.0, "macro_f1"): (0.5, 0.1), (2.0, "macro_f1"): (0.7, 0.0), (1.0, "micro_f1"): (0.6, 0.2), (2.0, "micro_f1"): (0.8, 0.0)}
    with pytest.raises(ValueError):
        readers.dataset(spark, "unknown", str(tmp_path))



def test_all_folds_are_weighted_as_each_one_alone(spark):
    rng = np.random.default_rng(12)
    x = spark.createDataFrame([(i, c, float(rng.integers(1, 4))) for i in range(24) for c in range(8) if rng.random() < 0.4], "node long, community long, value double")
    lab = spark.createDataFrame([(i, int(c)) for i in range(24) for c in {i % 3, int(rng.integers(0, 3))}], "node long, label long")
    roles = folds.folds(lab, 40, 3).withColumn("pct", F.lit(40.0))
    got = {(r.trial, r.role, r.node, r.community): r.value for r in experiment._fold_features(x, lab, roles, True).collect()}
    want = {}
    for trial in range(3):
        parts = {role: roles.filter((F.col("trial") == trial) & (F.col("role") == role)).select("node") for role in ("train", "test")}
        train = x.join(parts["train"], "node")
        weights = weighting.psnr_weights(weighting.chi2_contingency(train, lab.join(parts["train"], "node"), parts["train"].count()))
        for role, nodes in parts.items():
            want |= {(trial, role, r.node, r.community): r.value for r in weighting.community_weighting(x.join(nodes, "node"), weights).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("method", ["arcte", "louvain", "mroc", "lapeig", "repeig"])
def test_experiment_with_every_method(spark, method):
    e = cliques(spark)
    lab = spark.createDataFrame([(i, "a" if i < 10 else "b") for i in (*range(6), *range(10, 16))], "node long, label string")
    parameters = experiment.feature_parameters(method) | ({"dimensionality": 4} if method in experiment.DENSE else {"rho": 0.4} if method == "arcte" else {})
    row = experiment.run_experiment(e, lab, method, (50,), 2, parameters).first()
    assert 0.4 <= row.macro_f1_mean <= 1.0
    assert row.macro_f1_mean == 1.0 or method in ("repeig", "arcte")

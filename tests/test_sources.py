"""Readers and writers on small files."""

import pytest

from graphloom import cli
from graphloom.operators import queues
from graphloom.sources import readers, writers


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_edge_list(spark, tmp_path):
    path = put(tmp_path, "e.tsv", "# comment\n30\t10\t1.5\n10\t20\t2\n30\t10\t0.5\n20\t20\t1\n")
    edges, nodes = readers.edge_list(spark, path, "\t", undirected=True)
    assert rows(nodes) == [(0, 30), (1, 10), (2, 20)]
    assert rows(edges) == [(0, 1, 2.0), (1, 0, 2.0), (1, 2, 2.0), (2, 1, 2.0), (2, 2, 1.0)]
    with pytest.raises(Exception, match="fewer than 3"):
        readers.edge_list(spark, put(tmp_path, "bad.tsv", "1\t2\n"), "\t")[0].collect()


def test_numbered_from_one(spark, tmp_path):
    assert rows(readers.unweighted_edges(spark, put(tmp_path, "a.csv", "1,2\n3,3\n"))) == [(0, 1, 1.0), (1, 0, 1.0), (2, 2, 2.0)]
    assert rows(readers.label_matrix(spark, put(tmp_path, "l.csv", "1,1\n1,1\n2,2\n"))) == [(0, 0), (1, 1)]


def test_headered(spark, tmp_path):
    text = "n_rows:\t3\tn_cols:\t3\tnnz:\t3\tdirected:\tFalse\n1\t2\t0.5\n3\t3\t1\n"
    edges, n = readers.headered_edges(spark, put(tmp_path, "h.tsv", text))
    assert n == 3 and rows(edges) == [(0, 1, 0.5), (1, 0, 0.5), (2, 2, 1.0)]
    with pytest.raises(RuntimeError):
        readers.headered_edges(spark, str(tmp_path / "h.tsv"), numbering="x")


def test_communities_and_vectors(spark, tmp_path):
    assert rows(readers.community_lines(spark, put(tmp_path, "c", "0\t1\n2\n"))) == [(0, 0, 1.0), (1, 0, 1.0), (2, 1, 1.0)]
    (tmp_path / "tp").write_text("# x\n1 2\n")
    (tmp_path / "tp1").write_text("1 2 3\n")
    assert len(rows(readers.hierarchy(spark, str(tmp_path), 2))) == 5
    vectors = readers.word_vectors(spark, put(tmp_path, "w.txt", "1 2\n2 0.5 1\n"), 2)
    assert rows(vectors) == [(0, [0.0, 0.0]), (1, [0.5, 1.0])]
    assert rows(readers.dense_rows(spark, put(tmp_path, "d.csv", "1,2\n3,4\n"))) == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    paths = [put(tmp_path, n, t) for n, t in (("x", "0.5\n1\n"), ("y", "1.0\n2\n"), ("z", "3\n1\n"))]
    assert rows(readers.matlab_triples(spark, *paths)) == [(0, 2, 0.5), (1, 0, 1.0)]


def test_writers_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src long, dst long, w double")
    writers.matrix_text(edges, str(tmp_path / "m"), 2, 2, "\t")
    assert rows(readers.headered_edges(spark, str(tmp_path / "m"))[0]) == rows(edges)
    with pytest.raises(RuntimeError):
        readers.features(spark, "unknown", "x")


def test_command_line(spark, tmp_path):
    path = put(tmp_path, "g.tsv", "10\t13\t5\n11\t13\t5\n10\t14\t1\n12\t14\t3\n")
    cli.main(["-i", path, "-o", str(tmp_path / "out"), "-u"])
    got = {tuple(map(int, r[0].split("\t"))) for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert {(n, c) for n, c, _ in got if c >= 5} == {(10, 5), (11, 5), (13, 5), (14, 5)}


def test_queue_order_path(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "src long, dst long, w double")
    got = {r.node: r.s for r in queues.similarity_state(e, 0.1, 1e-5).filter("seed = 1").collect()}
    assert [got[v] for v in range(4)] == pytest.approx([1.216426, 2.935735, 1.868781, 0.840952], abs=1e-6)


@pytest.mark.parametrize("name", sorted(readers.DATASETS))
def test_every_dataset_comes_from_its_folder(spark, tmp_path, name):
    graph_file, label_file, separator = readers.DATASETS[name]
    if separator == ",":
        (tmp_path / graph_file).write_text("1,2\n2,3\n3,3\n")
        (tmp_path / label_file).write_text("1,1\n3,2\n3,2\n")
        want = {(0, 1): 1.0, (1, 0): 1.0, (1, 2): 1.0, (2, 1): 1.0, (2, 2): 2.0}
    else:
        (tmp_path / graph_file).write_text("n_rows:\t3\tn_columns:\t3\tnnz:\t3\tdirected:\tTrue\n1\t2\t1.5\n2\t3\t1\n2\t3\t2\n")
        (tmp_path / label_file).write_text("n_rows:\t3\tn_columns:\t2\tnnz:\t2\n1\t1\n3\t2\n3\t2\n")
        want = {(0, 1): 1.5, (1, 2): 3.0}
    edges, labels = readers.dataset(spark, name, str(tmp_path))
    found = edges.collect()
    assert {(r.src, r.dst): r.w for r in found} == want and len(found) == len(want)
    assert sorted(map(tuple, labels.select("node", "label").collect())) == [(0, 0), (2, 1)]


def test_predictions_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 0.5), (2, 1, -0.25)], "node long, label long, score double")
    path = f"{tmp_path}/predictions"
    writers.table_once(rows, path)
    writers.table_once(rows.limit(0), path)
    assert sorted(map(tuple, readers.predictions(spark, path).collect())) == [(1, 0, 0.5), (2, 1, -0.25)]


def test_topics_of_names(spark, tmp_path):
    labels = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2)], "node long, label long")
    nodes = spark.createDataFrame([(0, 70), (1, 71), (2, 72)], "node long, node_id long")
    names = spark.createDataFrame([(70, "ann"), (71, "bo"), (99, "no one")], "node_id long, name string")
    lemmas = spark.createDataFrame([(0, "tea"), (1, "sea"), (1, "tea"), (2, "sky")], "label long, lemma string")
    writers.names_to_topics_text(labels, nodes, names, lemmas, f"{tmp_path}/topics")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/topics").collect()) == ["ann\tsea\ttea", "bo\tsea\ttea"]

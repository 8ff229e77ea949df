"""Query names -> callables over the driver's tables, and their DuckDB SQL.

The graph is customer-supplier, whole in every query: an edge's weight is its number of lineitems,
customers get even and suppliers odd node ids. The second graph, with triangles, is that of users
whose events follow each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import evaluation, experiment, folds, fusion, graph, kernels, learn, louvain as modular, quality, queues, spectral, text_graph, walk, weighting
from graphloom.session import dealt, table, written

FLAGSHIP = "arcte_local_communities"
RHO, EPSILON, ALPHA = 0.1, 1e-5, 0.2

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def customer_supplier(spark: SparkSession, sf_dir: str, extra: list = ()) -> DataFrame:
    """Directed customer -> supplier edges."""
    li, o = dealt(table(spark, sf_dir, "lineitem")), table(spark, sf_dir, "orders")
    pairs = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    keys = [(F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"), *extra]
    return pairs.groupBy(*keys).agg(F.count("*").cast("double").alias("w"))


def edges(spark, sf_dir) -> DataFrame:
    return graph.with_reverse(customer_supplier(spark, sf_dir))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges between users whose events follow each other within a day, weighted by how often."""
    e = table(spark, sf_dir, "events").withColumn("next", F.lead("user_id").over(Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")))
    pairs = e.filter("next <> user_id").groupBy(F.least("user_id", "next").alias("src"), F.greatest("user_id", "next").alias("dst"))
    return graph.with_reverse(pairs.agg(F.count("*").cast("double").alias("w")))


_ONE = """base AS (SELECT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst, CAST(count(*) AS DOUBLE) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
_E = f"""{_ONE},
edges AS (SELECT src, dst, w FROM base UNION ALL SELECT dst, src, w FROM base),
outd AS (SELECT src AS node, sum(w) AS d FROM edges GROUP BY 1),
walk AS (SELECT src, dst, w / d AS p FROM edges JOIN outd ON src = node)"""
_U = f"""{_E.replace(_ONE, """base AS (SELECT least(user_id, nx) AS src, greatest(user_id, nx) AS dst, CAST(count(*) AS DOUBLE) AS w
  FROM (SELECT user_id, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS nx FROM events) WHERE nx <> user_id GROUP BY 1, 2)""")}"""


@query(f"WITH {_ONE} SELECT node, CASE WHEN sum(o) = 0 THEN 1.0 ELSE sum(o) END AS out_deg, sum(i) AS in_deg FROM (SELECT src AS node, w AS o, 0.0 AS i FROM base UNION ALL SELECT dst, 0.0, w FROM base) GROUP BY 1")
def degrees(spark, sf_dir):
    return graph.degrees(customer_supplier(spark, sf_dir))


@query(f"WITH {_ONE} SELECT src, dst, sum(w) / 2 AS w FROM (SELECT src, dst, w FROM base UNION ALL SELECT dst, src, w FROM base) GROUP BY 1, 2")
def symmetrized(spark, sf_dir):
    return graph.symmetrized(customer_supplier(spark, sf_dir))


@query(f"WITH {_E} SELECT src, dst, p FROM walk")
def transition_natural(spark, sf_dir):
    return graph.transitions(edges(spark, sf_dir))


@query(f"""WITH {_E}, marked AS (SELECT c_custkey * 2 AS node FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT src, dst, sum(p) AS p FROM (
  SELECT src, dst, CASE WHEN node IS NULL THEN p ELSE p * (1 - {ALPHA}) END AS p FROM walk LEFT JOIN marked ON src = node
  UNION ALL SELECT node, node, {ALPHA} FROM marked) GROUP BY 1, 2""")
def transition_label_absorbing(spark, sf_dir):
    marked = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") * 2).alias("node"))
    return graph.absorbing_transitions(edges(spark, sf_dir), marked, ALPHA)


_EPS = f"""stats AS (SELECT e.src AS seed, any_value(a.d) AS ds, avg(b.d) AS mean, min(b.d) AS lo, max(b.d) AS hi
  FROM edges e JOIN outd a ON e.src = a.node JOIN outd b ON e.dst = b.node GROUP BY 1),
raw AS (SELECT seed, {EPSILON} * ln(1 + ds) / ln(1 + mean) AS x, 1 / (ds * lo) AS high, 1 / (ds * hi) AS low FROM stats),
eps AS (SELECT seed, CASE WHEN x > high THEN high WHEN x < low THEN (low + x) / 2 ELSE x END AS eps FROM raw)"""


@query(f"WITH {_E}, {_EPS} SELECT seed, eps FROM eps")
def epsilon_effective(spark, sf_dir):
    return graph.epsilon_effective(edges(spark, sf_dir), EPSILON)


@query(f"WITH {_E} SELECT dst AS node, src AS community FROM edges UNION SELECT src, src FROM edges UNION SELECT dst, dst FROM edges")
def base_communities(spark, sf_dir):
    return graph.base_communities(edges(spark, sf_dir))


@query(f"""WITH {_E}, m AS (SELECT dst AS node, src AS community FROM edges UNION SELECT src, src FROM edges UNION SELECT dst, dst FROM edges),
g AS (SELECT community, list_sort(list(node)) AS members FROM m GROUP BY 1)
SELECT min(community) AS community, CAST(len(members) AS BIGINT) AS size FROM g GROUP BY members""")
def base_communities_dedup(spark, sf_dir):
    return graph.base_communities_dedup(edges(spark, sf_dir))


_LAPLACE = f"""WITH {_E}, ind AS (SELECT dst AS node, sum(w) AS d FROM edges GROUP BY 1),
lap AS (SELECT src, dst, sum(w) AS w FROM (SELECT node AS src, node AS dst, d AS w FROM ind UNION ALL SELECT src, dst, -w FROM edges) GROUP BY 1, 2)
SELECT src, dst, {{}} AS w FROM lap JOIN ind a ON src = a.node JOIN ind b ON dst = b.node"""


@query(_LAPLACE.format("w"))
def laplacian_unnormalized(spark, sf_dir):
    return graph.laplacian_unnormalized(edges(spark, sf_dir))


@query(_LAPLACE.format("w / sqrt(a.d) / sqrt(b.d)"))
def laplacian_normalized(spark, sf_dir):
    return graph.laplacian_normalized(edges(spark, sf_dir))


@query(_LAPLACE.format("w / a.d"))
def laplacian_random_walk(spark, sf_dir):
    return graph.laplacian_random_walk(edges(spark, sf_dir))


def _push(spark, sf_dir, kind):
    e = edges(spark, sf_dir)
    start = graph.seeds(e).select("seed", F.col("seed").alias("node"), F.lit(1.0 if kind == "cumulative" else 0.0).alias("s"), F.lit(1.0).alias("r"))
    return graph.push_step(start, graph.transitions(e), F.lit(True), RHO, kind)


_PUSH = f"""WITH {_E}, seeds AS (SELECT dst AS seed FROM edges GROUP BY 1 HAVING count(*) > 1)
SELECT seed, node, sum(s) AS s, sum(r) AS r FROM (SELECT seed, seed AS node, {{}} AS s, {{}} AS r FROM seeds
  UNION ALL SELECT seed, dst, {{}} * p, {{}} * p FROM seeds JOIN walk ON seed = src) GROUP BY 1, 2"""


@query(_PUSH.format(RHO, 0.0, 0.0, 1 - RHO))
def push_step_limit(spark, sf_dir):
    return _push(spark, sf_dir, "limit")


@query(_PUSH.format(RHO, (1 - RHO) / 2, 0.0, (1 - RHO) / 2))
def push_step_lazy(spark, sf_dir):
    return _push(spark, sf_dir, "lazy")


@query(_PUSH.format(1.0, 0.0, 1 - RHO, 1 - RHO))
def push_step_cumulative(spark, sf_dir):
    return _push(spark, sf_dir, "cumulative")


def _state_sql(kind: str) -> str:
    """State after all rounds; a round's rows carry s, r and the number of the round."""
    gain = f"{RHO} * r" if kind == "pagerank" else "0.0"
    moved = "0.0" if kind == "pagerank" else f"{1 - RHO} * r * p"
    first = 0.0 if kind == "pagerank" else 1.0
    return f"""WITH RECURSIVE {_E}, {_EPS},
seeds AS (SELECT dst AS seed FROM edges GROUP BY 1 HAVING count(*) > 1),
ind AS (SELECT dst AS node, sum(w) AS d FROM edges GROUP BY 1),
st(turn, seed, node, s, r) AS (
  SELECT 0, CAST(seed AS BIGINT), CAST(seed AS BIGINT), CAST({first} AS DOUBLE), CAST(1.0 AS DOUBLE) FROM seeds
  UNION ALL (
  WITH x AS (SELECT st.turn, st.seed, st.node, s, r, turn = 0 OR r / d >= eps AS open FROM st JOIN ind USING (node) JOIN eps ON st.seed = eps.seed),
  y AS (SELECT turn, seed, node, s + CASE WHEN open THEN {gain} ELSE 0 END AS s, CASE WHEN open THEN 0.0 ELSE r END AS r FROM x
    UNION ALL SELECT turn, seed, dst, {moved}, {1 - RHO} * r * p FROM x JOIN walk ON x.node = src WHERE open)
  SELECT turn + 1, seed, node, sum(s), sum(r) FROM y WHERE (SELECT bool_or(open) FROM x) GROUP BY 1, 2, 3)),
sims AS (SELECT seed, st.node, round(s / d, 12) AS sim, s / d AS exact FROM st JOIN ind USING (node) WHERE turn = (SELECT max(turn) FROM st) AND s <> 0),
basec AS (SELECT src AS seed, dst AS node FROM edges UNION ALL SELECT seed, seed FROM seeds),
size AS (SELECT seed, count(*) AS n FROM basec GROUP BY 1),
cut AS (SELECT basec.seed, min(sim) AS least, count(*) AS reached FROM basec JOIN sims USING (seed, node) GROUP BY 1),
kept AS (SELECT seed, node FROM sims JOIN cut USING (seed) JOIN size USING (seed) WHERE sim >= least {'AND reached = n' if kind == 'pagerank' else ''}),
loc AS (SELECT seed, node FROM kept WHERE seed IN (SELECT seed FROM kept JOIN size USING (seed) GROUP BY seed HAVING count(*) > any_value(n)))"""


_FEATURES = """
SELECT node, 'base' AS kind, community, CAST(count(*) AS DOUBLE) AS value FROM (SELECT src AS node, src AS community FROM (SELECT DISTINCT src FROM edges) UNION ALL SELECT src, dst FROM edges) GROUP BY 1, 3
UNION ALL SELECT node, 'local', seed, 1.0 FROM loc"""


@query(_state_sql("cumulative") + " SELECT seed, node FROM loc")
def arcte_local_communities(spark, sf_dir):
    e = edges(spark, sf_dir)
    return walk.communities(e, RHO, EPSILON)


@query(_state_sql("cumulative") + _FEATURES)
def arcte_features(spark, sf_dir):
    e = edges(spark, sf_dir)
    return walk.features(e, walk.communities(e, RHO, EPSILON))


@query(_state_sql("pagerank") + _FEATURES)
def arcte_pagerank_features(spark, sf_dir):
    e = edges(spark, sf_dir)
    return walk.features(e, walk.communities(e, RHO, EPSILON, "limit", guard=True))


@query(_state_sql("cumulative") + " SELECT n.node, coalesce(sum(exact), 1.0) AS centrality FROM (SELECT DISTINCT src AS node FROM edges) n LEFT JOIN sims USING (node) GROUP BY 1")
def arcte_centrality(spark, sf_dir):
    e = edges(spark, sf_dir)
    return walk.centrality(e, RHO, EPSILON)


# Features of the weighting queries: customers over suppliers, values are weights; labels: market segments.
def _features(spark, sf_dir):
    return customer_supplier(spark, sf_dir).select(F.col("src").alias("node"), F.col("dst").alias("community"), F.col("w").alias("value"))


def _segments(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select((F.col("c_custkey") * 2).alias("node"), "c_mktsegment")


_F = f"{_ONE}, f AS (SELECT src AS node, dst AS community, w AS value FROM base)"
_COLS = f"{_F}, df AS (SELECT community, count(*) AS df FROM f GROUP BY 1), nc AS (SELECT node, community, CASE WHEN df > 1 THEN value / sqrt(ln(df)) ELSE value END AS value FROM f JOIN df USING (community))"


@query(f"WITH {_COLS} SELECT * FROM nc")
def normalize_columns(spark, sf_dir):
    return weighting.normalize_columns(_features(spark, sf_dir))


@query(f"WITH {_F} SELECT node, community, value / sqrt(sum(value * value) OVER (PARTITION BY node)) AS value FROM f")
def normalize_rows(spark, sf_dir):
    return weighting.normalize_rows(_features(spark, sf_dir))


@query(f"WITH {_COLS} SELECT node, community, value / sqrt(sum(value * value) OVER (PARTITION BY node)) AS value FROM nc")
def normalize_community(spark, sf_dir):
    return weighting.normalize_community_features(_features(spark, sf_dir))


@query(f"""WITH {_F}, n AS (SELECT count(*) AS n FROM customer), s AS (SELECT community, sum(value * value) / n - (sum(value) / n) ** 2 AS v FROM f, n GROUP BY community, n)
SELECT node, community, value / CASE WHEN v > 1e-15 THEN sqrt(v) ELSE 1 END AS value FROM f JOIN s USING (community)""")
def scale_columns(spark, sf_dir):
    return weighting.scale_columns(_features(spark, sf_dir), table(spark, sf_dir, "customer").count())


_CHI = f"""{_F}, lab AS (SELECT c_custkey * 2 AS node, c_mktsegment AS label FROM customer), n AS (SELECT count(*) AS n FROM customer),
obs AS (SELECT label, community, count(*) AS obs FROM f JOIN lab USING (node) GROUP BY 1, 2),
share AS (SELECT label, count(*) / any_value(n) AS share FROM lab, n GROUP BY 1), cols AS (SELECT community, count(*) AS k FROM f GROUP BY 1),
chi AS (SELECT label, community, (coalesce(obs, 0) - share * k) ** 2 / (share * k) AS v FROM cols CROSS JOIN share LEFT JOIN obs USING (label, community))"""
_SNR = f"""{_CHI}, sigma AS (SELECT sqrt(avg(v)) AS sigma FROM (SELECT var_pop(v) AS v FROM chi GROUP BY label)),
snr AS (SELECT community, CASE WHEN count(*) FILTER (v > 0) > 1 THEN (max(v) FILTER (v > 0) - min(v) FILTER (v > 0)) / any_value(sigma)
  WHEN count(*) FILTER (v > 0) = 1 THEN max(v) FILTER (v > 0) / any_value(sigma) ELSE 0 END AS weight FROM chi, sigma GROUP BY 1)"""


def _chi(spark, sf_dir):
    labels = _segments(spark, sf_dir).select("node", F.col("c_mktsegment").alias("label"))
    return weighting.chi2_contingency(_features(spark, sf_dir), labels, table(spark, sf_dir, "customer").count())


@query(f"WITH {_CHI} SELECT label, community, v FROM chi")
def chi2_contingency(spark, sf_dir):
    return _chi(spark, sf_dir)


@query(f"WITH {_SNR} SELECT community, weight FROM snr")
def psnr_weights(spark, sf_dir):
    return weighting.psnr_weights(_chi(spark, sf_dir))


@query(f"""WITH {_SNR}, d AS (SELECT community, count(*) AS df FROM f GROUP BY 1),
x AS (SELECT node, community, value * CASE WHEN df > 1 THEN ln(1 + weight) ELSE 1 END AS value FROM f JOIN d USING (community) JOIN snr USING (community))
SELECT node, community, value / sqrt(sum(value * value) OVER (PARTITION BY node)) AS value FROM x WHERE value <> 0""")
def community_weighting(spark, sf_dir):
    return weighting.community_weighting(_features(spark, sf_dir), weighting.psnr_weights(_chi(spark, sf_dir)))


@query(f"""WITH {_F}, n AS (SELECT count(DISTINCT node) AS n FROM f), d AS (SELECT community, count(*) AS df FROM f GROUP BY 1), t AS (SELECT node, max(value) AS top FROM f GROUP BY 1)
SELECT node AS doc, community AS term, 0.5 + 0.5 * value / (top * CASE WHEN df > 1 THEN ln(n / df) ELSE 1 END) AS value FROM f JOIN d USING (community) JOIN t USING (node), n""")
def augmented_tf_idf(spark, sf_dir):
    return weighting.augmented_tf_idf(_features(spark, sf_dir).select(F.col("node").alias("doc"), F.col("community").alias("term"), F.col("value").alias("tf")))


@query(f"""WITH {_F} SELECT node, community, part, CASE part WHEN 0 THEN sqrt(value * 0.5) WHEN 1 THEN sqrt(value / cosh(pi() * 0.5)) * cos(0.5 * ln(value)) ELSE sqrt(value / cosh(pi() * 0.5)) * sin(0.5 * ln(value)) END AS value
FROM f, (SELECT unnest([0, 1, 2]) AS part)""")
def chi2_projection(spark, sf_dir):
    return weighting.chi2_projection(_features(spark, sf_dir))


# Communities of the quality queries: each supplier with its customers.
def _members(spark, sf_dir, e: DataFrame | None = None):
    e = written(customer_supplier(spark, sf_dir), once=True) if e is None else e
    own = e.select(F.col("dst").alias("community"), F.col("dst").alias("node")).distinct()
    return own.unionByName(e.select(F.col("dst").alias("community"), F.col("src").alias("node")))


def _edges_and_members(spark, sf_dir):
    """Both from one pass over lineitem and orders."""
    e = written(customer_supplier(spark, sf_dir), once=True)
    return written(graph.with_reverse(e), once=True), _members(spark, sf_dir, e)


_M = f"{_E}, m AS (SELECT dst AS community, src AS node FROM base UNION SELECT dst, dst FROM base)"
_FAST = f"""{_M}, v AS (SELECT count(*) AS v FROM edges),
fast AS (SELECT m.community, count(i.node) AS volume, count(*) - count(i.node) AS cut FROM m JOIN edges ON m.node = src LEFT JOIN m i ON i.community = m.community AND i.node = dst GROUP BY 1)"""


@query(f"""WITH {_M}, k AS (SELECT community, src, dst, count(*) AS k FROM (SELECT community, src, dst FROM m JOIN edges ON node = src UNION ALL SELECT community, src, dst FROM m JOIN edges ON node = dst) GROUP BY 1, 2, 3),
s AS (SELECT community, sum(CASE WHEN k = 2 THEN 1 ELSE 0 END) AS i, count(*) AS t FROM k GROUP BY 1), n AS (SELECT count(*) AS n FROM edges)
SELECT community, CASE WHEN least(i, n - t) = 0 THEN CAST('inf' AS DOUBLE) ELSE (t - i) / 2 / least(i, n - t) END AS conductance FROM s, n""")
def conductance(spark, sf_dir):
    return quality.conductance(*_edges_and_members(spark, sf_dir))


@query(f"""WITH {_U}, r AS (SELECT src AS community, dst AS node FROM edges), z AS (SELECT community, count(*) AS m FROM r GROUP BY 1),
i AS (SELECT a.community, count(*) AS n FROM edges JOIN r a ON src = a.node JOIN r b ON dst = b.node AND a.community = b.community GROUP BY 1)
SELECT community, coalesce(n, 0) / (m * m) AS clustering FROM z LEFT JOIN i USING (community)""")
def conductance_clustering(spark, sf_dir):
    """Users with those whose events come next to theirs."""
    e = users(spark, sf_dir)
    own = graph.nodes(e).select(F.col("node").alias("community"), "node")
    return quality.clustering(e, own.unionByName(e.select(F.col("src").alias("community"), F.col("dst").alias("node"))))


@query(f"""WITH {_FAST} SELECT community, volume, cut, CASE WHEN least(volume, v - volume - 2 * cut) <= 0 THEN CAST('inf' AS DOUBLE) ELSE cut / least(volume, v - volume - 2 * cut) END AS conductance FROM fast, v""")
def fast_conductance(spark, sf_dir):
    return quality.fast_conductance(*_edges_and_members(spark, sf_dir))


_DELTA = f"""WITH {_FAST}, mv AS (SELECT community, {{0}}(node) AS node FROM m GROUP BY 1),
st AS (SELECT mv.community, mv.node, count(i.node) AS common, count(*) AS degree FROM mv JOIN edges ON mv.node = src LEFT JOIN m i ON i.community = mv.community AND i.node = dst GROUP BY 1, 2)
SELECT community, node, volume {{1}} common AS volume, cut + {{2}} AS cut FROM st JOIN fast USING (community)"""


@query(_DELTA.format("max", "+", "degree - common"))
def incremental_conductance(spark, sf_dir):
    e, m = _edges_and_members(spark, sf_dir)
    return quality.conductance_delta(e, m, m.groupBy("community").agg(F.max("node").alias("node")), 1)


@query(_DELTA.format("min", "-", "common - degree"))
def decremental_conductance(spark, sf_dir):
    e, m = _edges_and_members(spark, sf_dir)
    return quality.conductance_delta(e, m, m.groupBy("community").agg(F.min("node").alias("node")), -1)


_J = f"""{_M}, z AS (SELECT community, count(*) AS n FROM m GROUP BY 1),
j AS (SELECT a.community AS c1, b.community AS c2, count(*) AS k FROM m a JOIN m b ON a.node = b.node AND a.community < b.community GROUP BY 1, 2),
jac AS (SELECT c1, c2, k / (x.n + y.n - k) AS jaccard FROM j JOIN z x ON c1 = x.community JOIN z y ON c2 = y.community)"""


@query(f"WITH {_J} SELECT c1, c2, jaccard FROM jac")
def jaccard_pairs(spark, sf_dir):
    return quality.jaccard_pairs(_members(spark, sf_dir))


@query(f"""WITH {_J}, b AS (SELECT c1 AS community, c2 AS partner, round(jaccard, 12) AS jaccard FROM jac UNION ALL SELECT c2, c1, round(jaccard, 12) FROM jac)
SELECT community, partner, jaccard FROM b QUALIFY row_number() OVER (PARTITION BY community ORDER BY jaccard DESC, partner) = 1""")
def best_partner(spark, sf_dir):
    return quality.best_partner(_members(spark, sf_dir))


# Views of the fusion queries: the order status.
WEIGHTS = {"F": 2.0, "O": 1.0, "P": 1.0}


def _views(spark, sf_dir):
    e = customer_supplier(spark, sf_dir, [F.col("o_orderstatus").alias("view")])
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "view", "w"))


_V = """vb AS (SELECT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst, o_orderstatus AS view, CAST(count(*) AS DOUBLE) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
ve AS (SELECT * FROM vb UNION ALL SELECT dst, src, view, w FROM vb), a AS (SELECT unnest(['F', 'O', 'P']) AS view, unnest([0.5, 0.25, 0.25]) AS a)"""


@query(f"""WITH {_V}, d AS (SELECT view, src, sum(w) AS d FROM ve GROUP BY 1, 2)
SELECT src, dst, sum(a * w / d) AS p FROM ve JOIN d USING (view, src) JOIN a USING (view) GROUP BY 1, 2""")
def fuse_views(spark, sf_dir):
    return fusion.fuse_views(_views(spark, sf_dir), WEIGHTS)


@query(f"WITH {_V} SELECT src, dst, sum(w) / 2 AS w FROM (SELECT src, dst, a * w AS w FROM ve JOIN a USING (view) UNION ALL SELECT dst, src, a * w FROM ve JOIN a USING (view)) GROUP BY 1, 2")
def fuse_addition(spark, sf_dir):
    return fusion.fuse_addition(_views(spark, sf_dir), WEIGHTS)


TURNS, TELEPORT = 20, 0.15
_PI = f"""WITH RECURSIVE {_E}, nn AS (SELECT DISTINCT src AS node FROM edges), cnt AS (SELECT count(*) AS n FROM nn),
it(turn, node, pi) AS (SELECT 0, node, 1.0 / n FROM nn, cnt UNION ALL (
  SELECT any_value(turn) + 1, dst, {1 - TELEPORT} * sum(pi * p) + {TELEPORT} / (SELECT n FROM cnt) FROM it JOIN walk ON node = src WHERE turn < {TURNS} GROUP BY dst)),
pi AS (SELECT node, pi FROM it WHERE turn = {TURNS})"""


# Until a round changes less than this in sum, whatever the number of rounds (at most about 190, as one leaves 85 % of a change).
CHANGE, MOST_TURNS = 1e-12, 400
_PI_END = f"""WITH RECURSIVE {_E}, nn AS (SELECT DISTINCT src AS node FROM edges), cnt AS (SELECT count(*) AS n FROM nn),
it(turn, node, pi, change) AS (SELECT 0, node, 1.0 / n, CAST(1 AS DOUBLE) FROM nn, cnt UNION ALL (
  SELECT turn, node, x, sum(abs(x - pi)) OVER () FROM (SELECT any_value(turn) + 1 AS turn, dst AS node, {1 - TELEPORT} * sum(pi * p) + {TELEPORT} / (SELECT n FROM cnt) AS x
    FROM it JOIN walk ON node = src WHERE change >= {CHANGE} GROUP BY dst) JOIN (SELECT node, pi FROM it) USING (node))),
pi AS (SELECT node, pi FROM it WHERE turn = (SELECT max(turn) FROM it))"""


def _stationary(e: DataFrame) -> DataFrame:
    return fusion.stationary_distribution(e, TELEPORT, MOST_TURNS, change=CHANGE)


@query(_PI_END + " SELECT node, pi FROM pi")
def stationary_distribution(spark, sf_dir):
    return _stationary(edges(spark, sf_dir))


@query(_PI_END + ", q AS (SELECT src, dst, pi * p AS w FROM walk JOIN pi ON src = node) SELECT src, dst, sum(w) / 2 AS w FROM (SELECT * FROM q UNION ALL SELECT dst, src, w FROM q) GROUP BY 1, 2")
def implicit_combinatorial(spark, sf_dir):
    e = written(edges(spark, sf_dir), once=True)
    return fusion.implicit_combinatorial(_stationary(e), graph.transitions(e))


@query(_PI + ", q AS (SELECT src, dst, sqrt(x.pi) * p / sqrt(y.pi) AS w FROM walk JOIN pi x ON src = x.node JOIN pi y ON dst = y.node) SELECT src, dst, sum(w) / 2 AS w FROM (SELECT * FROM q UNION ALL SELECT dst, src, w FROM q) GROUP BY 1, 2")
def implicit_directed(spark, sf_dir):
    e = written(edges(spark, sf_dir), once=True)
    return fusion.implicit_directed(fusion.stationary_distribution(e, TELEPORT, TURNS), graph.transitions(e))


# Scores of the evaluation queries: lineitems of a customer by brand; true labels: brands bought at least three times.
def _scores(spark, sf_dir):
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    bought = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return bought.groupBy(F.col("o_custkey").alias("node"), F.col("p_brand").alias("label")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("score"))


_S = """s AS (SELECT o_custkey AS node, p_brand AS label, count(*) AS n, round(sum(l_extendedprice), 2) AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
t AS (SELECT node, label FROM s WHERE n >= 3), k AS (SELECT node, count(*) AS k FROM t GROUP BY 1),
top AS (SELECT node, label FROM (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY score DESC, label DESC) AS r FROM s) JOIN k USING (node) WHERE r <= k)"""


def _truth_and_top(spark, sf_dir):
    s = _scores(spark, sf_dir)
    truth = s.filter("n >= 3").select("node", "label")
    return truth, evaluation.topk_labels(s, truth.groupBy("node").agg(F.count("*").alias("k")))


@query(f"WITH {_S} SELECT node, label FROM top")
def topk_labels(spark, sf_dir):
    return _truth_and_top(spark, sf_dir)[1]


@query(f"""WITH {_S}, c AS (SELECT node, greatest(2, least(5, round_even(sum(n) / 10, 0) + 1)) AS k FROM s GROUP BY 1)
SELECT node, label FROM (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY score DESC, label DESC) AS r FROM s) JOIN c USING (node) WHERE r <= k""")
def classify_topk(spark, sf_dir):
    s = _scores(spark, sf_dir)
    meta = s.groupBy("node").agg((F.sum("n") / 10).alias("value"))
    return evaluation.topk_labels(s, evaluation.predicted_counts(meta, 5))


@query(f"""WITH {_S}, b AS (SELECT label, count(*) FILTER (x AND y) AS tp, count(*) FILTER (x AND y IS NULL) AS fp, count(*) FILTER (x IS NULL AND y) AS fn
  FROM (SELECT node, label, true AS x FROM top) FULL JOIN (SELECT node, label, true AS y FROM t) USING (node, label) GROUP BY 1),
q AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f FROM b)
SELECT avg(r) AS macro_recall, sum(tp) / (sum(tp) + sum(fn)) AS micro_recall, avg(p) AS macro_precision, sum(tp) / (sum(tp) + sum(fp)) AS micro_precision, avg(f) AS macro_f1, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS micro_f1 FROM q""")
def f1_measures(spark, sf_dir):
    truth, top = _truth_and_top(spark, sf_dir)
    return evaluation.f1_measures(top, truth)


@query("""WITH lab AS (SELECT c_custkey AS node, c_mktsegment AS label FROM customer), o AS (SELECT node, label, md5('0:' || node) AS pos FROM lab),
a AS (SELECT DISTINCT arg_min(node, (pos, node)) AS node FROM o GROUP BY label), b AS (SELECT DISTINCT arg_min(node, (pos, node)) AS node FROM o WHERE node NOT IN (SELECT node FROM a) GROUP BY label),
r AS (SELECT node, row_number() OVER (ORDER BY pos, node) AS i FROM o WHERE node NOT IN (SELECT node FROM a) AND node NOT IN (SELECT node FROM b))
SELECT node, 'train' AS role FROM a UNION ALL SELECT node, 'test' FROM b UNION ALL SELECT node, CASE WHEN i <= 100 - (SELECT count(*) FROM a) THEN 'train' ELSE 'test' END FROM r""")
def valid_train_test(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return evaluation.valid_train_test(c.select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("label")), 100)


@query("""SELECT o_orderpriority AS pct, avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std FROM orders GROUP BY 1""")
def fold_stats(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return evaluation.fold_stats(o.select(F.col("o_orderpriority").alias("pct"), F.col("o_orderkey").alias("trial"), F.col("o_totalprice").alias("value")))


@query(ORACLE_SQL["arcte_local_communities"])
def arcte_fifo(spark, sf_dir):
    """Queue order; on this bipartite graph the same communities as with a frontier."""
    return queues.communities(edges(spark, sf_dir), RHO, EPSILON)


@query()
def arcte_lazy_fifo(spark, sf_dir):
    return queues.communities(edges(spark, sf_dir), RHO, EPSILON, "lazy")


@query(_state_sql("cumulative").replace(_E, _U) + " SELECT seed, node, sim FROM sims")
def arcte_users(spark, sf_dir):
    """On a graph with triangles, over a frontier. (It is too dense for local communities.)"""
    return _rounded(walk.similarities(users(spark, sf_dir), RHO, EPSILON))


def _rounded(sims: DataFrame) -> DataFrame:
    return sims.select("seed", "node", F.round("sim", walk.DIGITS).alias("sim"))


@query(_state_sql("pagerank").replace(_E, _U) + " SELECT seed, node, sim FROM sims")
def pagerank_users(spark, sf_dir):
    return _rounded(walk.similarities(users(spark, sf_dir), RHO, EPSILON, "limit"))


@query()
def arcte_users_fifo(spark, sf_dir):
    """On a graph with triangles, where queue order and frontier differ."""
    return _rounded(queues.similarities(users(spark, sf_dir), RHO, EPSILON))


@query()
def mroc(spark, sf_dir):
    return kernels.merged_communities(edges(spark, sf_dir), 1000)


@query()
def arcte_rank_cut(spark, sf_dir):
    return walk.rank_cut(edges(spark, sf_dir), RHO, EPSILON)


@query()
def iterative_stratification(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return kernels.iterative_stratification(c.select(F.col("c_custkey").alias("node"), F.crc32("c_mktsegment").alias("label")), 0.5)


def _terms(spark, sf_dir) -> DataFrame:
    """(``doc``, ``term``, ``tf``) of all documents' lower-cased words, but those that every document with words holds (their idf is 0)."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    tf = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), word.alias("term")).groupBy("doc", "term").agg(F.count("*").cast("double").alias("tf"))
    n = tf.agg(F.count_distinct("doc").alias("n"))
    kept = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).filter("df = 1 or df < n").select("term")  # n is one row
    return tf.join(kept, "term")


@query()
def text_neighbours(spark, sf_dir):
    """The graph of all documents: each one's 5 nearest by augmented tf-idf in 16 dimensions, from a forest."""
    return text_graph.text_graph(_terms(spark, sf_dir), 16, "angular", 5)


@query()
def forest_graph(spark, sf_dir):
    """Every vector's 5 nearest, from a forest of projections."""
    return text_graph.forest_neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 5)


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_distance(a.e, b.e), 9) AS w FROM v a CROSS JOIN v b WHERE a.vec_id % 50 = 0)
SELECT src, dst, w FROM d QUALIFY row_number() OVER (PARTITION BY src ORDER BY w, dst) <= 5""")
def knn_graph(spark, sf_dir):
    """Neighbours of every vector whose id is divisible by 50, against all vectors."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return text_graph.nearest(v, v.filter("vec_id % 50 = 0"), 5)


@query(f"""WITH {_V}, d AS (SELECT view, src, sum(w) AS d FROM ve GROUP BY 1, 2), x AS (SELECT view, src, d, a / sum(a) OVER (PARTITION BY src) AS a FROM d JOIN a USING (view))
SELECT src, dst, sum(a * w / d) AS p FROM ve JOIN x USING (view, src) GROUP BY 1, 2""")
def graph_fusion_convex(spark, sf_dir):
    return fusion.graph_fusion(_views(spark, sf_dir), WEIGHTS)


@query(f"""WITH {_V}, d AS (SELECT view, src, sum(w) AS d FROM ve GROUP BY 1, 2), p AS (SELECT view, src, dst, w / d AS p FROM ve JOIN d USING (view, src)),
h AS (SELECT view, src, -sum(p * ln(p)) AS h FROM p GROUP BY 1, 2), g AS (SELECT view, src, CASE WHEN max(h) OVER (PARTITION BY src) > 1e-12 THEN h ELSE 1 END AS x FROM h),
x AS (SELECT view, src, x / sum(x) OVER (PARTITION BY src) AS a FROM g)
SELECT src, dst, sum(a * p) AS p FROM p JOIN x USING (view, src) GROUP BY 1, 2 HAVING sum(a * p) <> 0""")
def graph_fusion_entropy(spark, sf_dir):
    return fusion.graph_fusion(_views(spark, sf_dir), method="entropy")


@query(f"""WITH {_V}, d AS (SELECT view, src, sum(w) AS d FROM ve GROUP BY 1, 2), x AS (SELECT view, src, a / sum(a) OVER (PARTITION BY src) AS a FROM d JOIN a USING (view)),
f AS (SELECT src, dst, a * w AS w FROM ve JOIN x USING (view, src)), s AS (SELECT src, dst, sum(w) / 2 AS w FROM (SELECT * FROM f UNION ALL SELECT dst, src, w FROM f) GROUP BY 1, 2)
SELECT src, dst, sum(w) AS w FROM (SELECT dst AS src, dst, w FROM s UNION ALL SELECT src, dst, -w FROM s) GROUP BY 1, 2 HAVING sum(w) <> 0""")
def graph_fusion_laplacian(spark, sf_dir):
    return fusion.graph_fusion_directed(_views(spark, sf_dir), WEIGHTS, "addition")[1]


@query()
def graph_fusion_walks(spark, sf_dir):
    return fusion.graph_fusion_directed(_views(spark, sf_dir), WEIGHTS, "zhou", "directed")[0]


@query(f"WITH {_E}, t AS (SELECT d / sum(d) OVER () AS p FROM outd) SELECT -sum(p * ln(p)) AS entropy FROM t")
def degree_entropy(spark, sf_dir):
    return fusion.entropy(graph.out_degrees(edges(spark, sf_dir)), "out_deg")


@query(_PI + """, q AS (SELECT src, dst, pi * p AS w FROM walk JOIN pi ON src = node), c AS (SELECT src, dst, sum(w) / 2 AS w FROM (SELECT * FROM q UNION ALL SELECT dst, src, w FROM q) GROUP BY 1, 2)
SELECT src, dst, sum(w) AS w FROM (SELECT node AS src, node AS dst, pi AS w FROM pi UNION ALL SELECT src, dst, -w FROM c) GROUP BY 1, 2""")
def laplacian_combinatorial(spark, sf_dir):
    return fusion.combinatorial_laplacian(edges(spark, sf_dir), TELEPORT, TURNS, None)


@query(_PI + """, q AS (SELECT src, dst, sqrt(x.pi) * p / sqrt(y.pi) AS w FROM walk JOIN pi x ON src = x.node JOIN pi y ON dst = y.node), c AS (SELECT src, dst, sum(w) / 2 AS w FROM (SELECT * FROM q UNION ALL SELECT dst, src, w FROM q) GROUP BY 1, 2)
SELECT src, dst, sum(w) AS w FROM (SELECT node AS src, node AS dst, 1.0 AS w FROM pi UNION ALL SELECT src, dst, -w FROM c) GROUP BY 1, 2""")
def laplacian_directed(spark, sf_dir):
    return fusion.directed_laplacian(edges(spark, sf_dir), TELEPORT, TURNS, None)


@query("""WITH lab AS (SELECT c_custkey AS node, c_mktsegment AS label FROM customer), tr AS (SELECT unnest(range(0, 3)) AS trial),
o AS (SELECT trial, node, label, md5(trial || ':' || node) AS pos FROM lab, tr),
a AS (SELECT DISTINCT trial, arg_min(node, (pos, node)) AS node FROM o GROUP BY trial, label),
b AS (SELECT DISTINCT trial, arg_min(node, (pos, node)) AS node FROM o ANTI JOIN a USING (trial, node) GROUP BY trial, label),
r AS (SELECT trial, node, row_number() OVER (PARTITION BY trial ORDER BY pos, node) AS i FROM o ANTI JOIN a USING (trial, node) ANTI JOIN b USING (trial, node)),
q AS (SELECT trial, (SELECT ceil(10 * count(*) / 100) FROM lab) - count(*) AS q FROM a GROUP BY 1)
SELECT trial, node, 'train' AS role FROM a UNION ALL SELECT trial, node, 'test' FROM b UNION ALL SELECT trial, node, CASE WHEN i <= q THEN 'train' ELSE 'test' END FROM r JOIN q USING (trial)""")
def label_folds(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return folds.folds(c.select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("label")), 10, 3)


@query()
def louvain(spark, sf_dir):
    return modular.louvain(edges(spark, sf_dir))


@query()
def experiment_base_communities(spark, sf_dir):
    """Market segments of customers from the suppliers they buy from: mean F-scores by share of training nodes."""
    lab = _segments(spark, sf_dir).select("node", F.col("c_mktsegment").alias("label"))
    e = edges(spark, sf_dir)
    return experiment.run_experiment(e, lab.join(e.select(F.col("src").alias("node")).distinct(), "node"), "basecomm", (20, 50), 2)


@query()
def laplacian_eigenmaps(spark, sf_dir):
    return spectral.laplacian_eigenmaps(edges(spark, sf_dir), 4)


@query()
def replicator_eigenmaps(spark, sf_dir):
    return spectral.replicator_eigenmaps(edges(spark, sf_dir), 3)


@query()
def ovr_linear(spark, sf_dir):
    """Market segments of customers from the suppliers they buy from: scores of all labels."""
    f = weighting.normalize_rows(_features(spark, sf_dir))
    lab = _segments(spark, sf_dir).select("node", F.col("c_mktsegment").alias("label"))
    trained = lab.filter("node % 4 <> 0")
    weights = learn.fit_linear(f.join(trained.select("node"), "node"), trained, iterations=1000, tolerance=1e-4)
    return learn.decision_values(f, weights)

"""Near-duplicate documents: a signature-coordinate inverted join, confirmed on full shingle sets.

1. A document's set is the distinct ``k``-word shingles of its lower-cased text. Documents with
   the same set are one node from then on, so exact copies cost one row each.
2. A node has ``coordinates`` MinHash values. It is posted under every coordinate-value pair;
   pairs with one posting can never collide and go.
3. Two nodes of the wanted similarity agree in at least ``matches`` coordinates but with
   probability ``MISS``. Of its shared pairs, from the rarest to the commonest, a node therefore
   needs only its first ``size - matches + 1`` (prefix); its ``matches - 1`` longest posting
   lists are skipped, and a node with fewer shared pairs than ``matches`` drops out.
4. Merging: in two rounds the nodes of each posting list are compared with one pivot, the node
   whose lists are longest altogether (then such a one outside the first pivot's component). A
   list whose nodes are all in one component is done. Of a list still open, the nodes outside
   the pivot's component are compared with all nodes of other components.
5. A compared pair must be of like size, differ in no more bits of an odd sketch than the
   similarity allows (each shingle flips one bit of ``BITS``, so the bits that differ never
   outnumber the shingles that do), collide in ``matches`` coordinates, and pass the exact test
   on full sets. Sizes and sketches are compared inside the join, so that only pairs that are
   nearly always links leave it.

A list of n copies of one text costs about n comparisons. In a list of n texts of which m differ
too much from the pivot, m * n sketches are compared; no link between components is lost.

Defined results: a null or empty text, or one of spaces, has an empty set, is linked with
nothing and is its own component. A null id is never linked; its component is null and it is
kept. Rows with the same id are compared by their texts like any others. Columns beside id and
text are ignored, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import partial, reduce
from math import comb
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.llm import arrays
from graphloom.session import discard, map_arrow, written

COORDINATES = 48
#: Chance that a pair exactly at the threshold agrees in fewer coordinates than asked for.
MISS = 1e-6
#: Bits of the odd sketch of a set.
BITS = 2048

_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 1 << 63, 512, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, 512, dtype=np.uint64) | np.uint64(1)


def least_matches(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """Largest number of agreeing coordinates that a pair at the threshold reaches but with chance ``miss``."""
    p, total = percent / 100, 0.0
    for t in range(coordinates):
        total += comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if total > miss:
            return max(1, t)
    return coordinates


def _sets(batch, text_col: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts of a batch, and where each text's begin."""
    data, offsets = arrays.text_bytes(batch.column(text_col))
    data = arrays.LOWER[data]
    starts, ends, firsts = arrays.word_bounds(data, offsets)
    words = arrays.word_hashes(data, starts, ends)
    hashes, bounds = arrays.windows(words, firsts, k)
    few = np.flatnonzero((np.diff(firsts) > 0) & (np.diff(firsts) < k))
    if len(few):  # the whole sequence is the one shingle
        whole = np.array([xxhash.xxh3_64_intdigest(words[firsts[i] : firsts[i + 1]].tobytes(), seed=1) for i in few], np.uint64)
        hashes = np.insert(hashes, bounds[few], whole)
        extra = np.zeros(len(bounds), np.int64)
        extra[few + 1] = 1
        bounds = bounds + np.cumsum(extra)
    for a, b in zip(bounds[:-1], bounds[1:]):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    return hashes[new], np.concatenate(([0], np.cumsum(new)))[bounds]


def _digest(part: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(part.tobytes())


def _signatures(batches, id_col: str, text_col: str, k: int, coordinates: int):
    for batch in arrays.blocks(batches, text_col):
        hashes, bounds = _sets(batch, text_col, k)
        sizes = np.diff(bounds)
        full = np.flatnonzero(sizes)
        keys = np.zeros((len(full), coordinates), np.uint64)
        for c in range(coordinates if len(full) else 0):
            least = np.minimum.reduceat((hashes ^ _XOR[c]) * _MUL[c], bounds[:-1][full])
            keys[:, c] = arrays.mixed(least + np.uint64(c))
        lists = np.zeros(len(sizes) + 1, np.int32)
        lists[1:] = np.cumsum(np.where(sizes > 0, coordinates, 0))
        yield pa.record_batch(
            [
                batch.column(id_col),
                pa.array(sizes.astype(np.int64)),
                pa.array([_digest(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                pa.ListArray.from_arrays(pa.array(lists), pa.array(keys.reshape(-1).astype(np.uint32).view(np.int32))),
            ],
            names=["id", "n", "node", "keys"],
        )


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """Of each of ``BITS`` bits, whether an odd number of the hashes falls on it (as 64-bit integers)."""
    odd = np.bincount((arrays.mixed(hashes) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _full_sets(batches, k: int):
    for batch in arrays.blocks(batches, "text"):
        hashes, bounds = _sets(batch, "text", k)
        parts = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        same = [_digest(p) == node for p, node in zip(parts, batch.column("node").to_pylist())]
        columns = [pa.array([len(p) for p in parts], pa.int64()), pa.array([odd_sketch(p) for p in parts], pa.list_(pa.int64())), pa.array([p.tobytes() for p in parts], pa.binary())]
        out = pa.record_batch([batch.column("nid"), *columns], names=["nid", "n", "odd", "hashes"])
        yield out.filter(pa.array(same, pa.bool_()))


def _similar(batches, percent: int):
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("ha"), batch.column("hb")):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _can_link(na: Column, nb: Column, oa: Column, ob: Column, percent: int) -> Column:
    """Sizes and odd sketches allow the similarity: 100 * both >= percent * union means that no more than
    (100 - percent) / (100 + percent) of the sets' sizes together differs."""
    differ = reduce(add, [F.bit_count(oa[i].bitwiseXOR(ob[i])) for i in range(BITS // 64)])
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (differ * (100 + percent) <= (na + nb) * (100 - percent))


def components(links: DataFrame) -> DataFrame:
    """(``nid``, ``comp``): the smallest id reachable over links (``a``, ``b``), by large-star and small-star rounds."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        seen = Observation()
        starred = small.select("u", F.col("m").alias("v")).union(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after = written(starred.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        discard(edges)
        edges, now = after, tuple(seen.get.values())
        if now == before:
            out = edges.select(F.col("u").alias("nid"), F.col("v").alias("comp"))
            out._graphloom_path = edges._graphloom_path
            return out
        before = now


def merged(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of all nodes, from those before (``nid``, ``comp``) and new links."""
    if comps is None:
        return components(links)
    of = lambda x: comps.select(F.col("nid").alias(x), F.col("comp").alias(f"c{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    new = components(ends)
    moved = comps.join(new.select(F.col("nid").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("nid", F.coalesce("to", "comp").alias("comp"))
    out = written(moved.union(new.join(comps, "nid", "left_anti")))
    discard(comps, new)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 85, coordinates: int = COORDINATES) -> DataFrame:
    """Per row of ``docs``: its id, ``n_shingles``, ``component_id`` and ``kept``."""
    matches = least_matches(percent, coordinates)
    id_type = docs.schema[id_col].dataType.simpleString()
    mine = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sig = written(map_arrow(mine, partial(_signatures, id_col="id", text_col="text", k=k, coordinates=coordinates), f"id {id_type}, n long, node binary, keys array<int>"))
    linkable = sig.filter("n > 0 and id is not null")
    nodes = written(linkable.dropDuplicates(["node"]).select(F.monotonically_increasing_id().alias("nid"), "id", "node", "keys"))

    posts = nodes.select("nid", F.posexplode("keys").alias("at", "value"))
    posts = posts.select("nid", F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
    # Joins of postings are merges by name: Spark takes an exploded table to be as large as its file and would broadcast millions of postings.
    shared = posts.join(posts.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").hint("merge"), "key")
    lists = shared.groupBy("nid").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("ks")).filter(F.size("ks") >= matches)
    central = F.aggregate("ks", F.lit(0).cast("long"), lambda a, x: a + x["c"])
    involved = written(lists.select("nid", F.transform("ks", lambda x: x["key"]).alias("ks"), central.alias("central")))
    wanted = involved.select("nid").join(nodes.select("nid", "id", "node"), "nid")
    sets = written(map_arrow(mine.join(wanted, "id").select("nid", "node", "text"), partial(_full_sets, k=k), "nid long, n long, odd array<long>, hashes binary").dropDuplicates(["nid"]))
    prefix = involved.select("nid", "central", F.explode(F.slice("ks", F.lit(1), F.size("ks") - (matches - 1))).alias("key"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of pairs (``a``, ``b``) those that are links."""
        side = lambda x: sets.select(F.col("nid").alias(x), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"o{x}"))
        like = pairs.join(side("a"), "a").join(side("b"), "b").filter(_can_link(F.col("na"), F.col("nb"), F.col("oa"), F.col("ob"), percent)).select("a", "b")
        keys = lambda x: involved.select(F.col("nid").alias(x), F.col("ks").alias(f"k{x}"))
        close = like.join(keys("a"), "a").join(keys("b"), "b").filter(F.size(F.array_intersect("ka", "kb")) >= matches).select("a", "b")
        full = lambda x: sets.select(F.col("nid").alias(x), F.col("hashes").alias(f"h{x}"))
        both = close.join(full("a"), "a").join(full("b"), "b").select("a", "b", "ha", "hb")
        return map_arrow(both, partial(_similar, percent=percent), "a long, b long")

    def open_lists() -> DataFrame:
        """Postings of the lists that span several components, with each list's pivot and its component (``main``)."""
        rows = prefix.withColumn("comp", F.col("nid")) if comps is None else prefix.join(comps, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
        rows = rows.select("key", "comp", F.struct("central", "nid", "comp").alias("node"))
        wide = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("node").alias("pivot")).filter("lo <> hi")
        return rows.join(wide.select("key", "pivot").hint("merge"), "key").select("key", "node.nid", "comp", "node", "pivot", F.col("pivot.comp").alias("main"))

    comps = None
    for outside in (False, True):
        lists = open_lists()
        if outside:  # the pivot is the most central node of another component
            second = lists.filter("comp <> main").groupBy("key").agg(F.max("node").alias("pivot"))
            lists = lists.select("key", "nid", "comp").join(second.hint("merge"), "key")
        pairs = lists.filter("comp <> pivot.comp").select(F.least("nid", "pivot.nid").alias("a"), F.greatest("nid", "pivot.nid").alias("b"))
        comps = merged(comps, confirmed(pairs.distinct()))
    lists = written(open_lists().select("key", "nid", "comp", "main").join(sets.select("nid", "n", "odd"), "nid"))
    one, two = lists.filter("comp <> main").alias("p"), lists.hint("merge").alias("q")
    near = (F.col("p.key") == F.col("q.key")) & (F.col("p.comp") != F.col("q.comp")) & ((F.col("q.comp") == F.col("q.main")) | (F.col("p.nid") < F.col("q.nid")))
    near &= _can_link(F.col("p.n"), F.col("q.n"), F.col("p.odd"), F.col("q.odd"), percent)
    rest = one.join(two, near).select(F.least("p.nid", "q.nid").alias("a"), F.greatest("p.nid", "q.nid").alias("b")).distinct()
    comps = merged(comps, confirmed(rest))
    discard(lists, sets, involved)

    placed = nodes.select("nid", "id", "node").join(comps, "nid", "left").select("node", F.coalesce("comp", "nid").alias("comp"))
    least = linkable.groupBy("node").agg(F.min("id").alias("least")).join(placed, "node")
    smallest = least.groupBy("comp").agg(F.min("least").alias("component_id"))
    found = least.join(smallest, "comp").select("node", "component_id")
    lone = sig.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    out = linkable.select("id", "n", "node").join(found, "node").select("id", "n", "component_id").union(lone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def first_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but near copies of a row with a smaller id; of rows equal in id, one stays if its set is not empty."""
    gone = near_duplicates(docs, id_col, text_col, k, percent).filter("not kept").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("_gone"), "left_anti")

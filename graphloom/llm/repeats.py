"""Repeated windows over a whole corpus: what suffix-array and substring dedup share.

A text is a row of units (bytes or words); a window is ``window`` consecutive units of it. The
hash of every ``gram`` consecutive units is computed, and of each window the smallest such hash
is its anchor. Equal windows have equal anchors at equal places, so only anchors, about two in
``window - gram + 2`` units, are exchanged and sorted; they are the sparse suffixes.

Around an anchor lies its context: all windows that hold it. Of occurrences with one context
(equal in 96 bits of hashes) all but the first are covered throughout. Where an anchor has several
contexts, the first occurrence of each (an edge of a repeat) is sent in full, as the text itself,
and looked at window by window in a second exchange.

Rows between tasks are (bucket, bytes of NumPy arrays); a bucket is a range of what anchors are
dealt by (``lead``), and there are so many that each belongs to about ``BUCKET_BYTES`` of text.
All of it is one lazy plan over one exchange of the texts by id, which Spark reuses.
"""

from __future__ import annotations

import io
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays
from graphloom.session import map_arrow

_B = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))


#: Bytes of text to a bucket, about.
BUCKET_BYTES = 24 << 20


@dataclass(frozen=True)
class Windows:
    """``units``: (data, offsets) -> a 64-bit value per unit, each text's first unit (with the total), and its bytes' begin and end."""

    units: Callable
    window: int
    gram: int
    #: Whether an earlier occurrence in the same document covers a later one.
    within: bool
    #: (scan, anchors) -> 64-bit values by whose ranges anchors are dealt to buckets; equal for equal anchors.
    lead: Callable

    @property
    def grams(self) -> int:
        """Grams in a window."""
        return self.window - self.gram + 1


def byte_units(data, offsets):
    return arrays.BYTE_VALUE[data], offsets


def word_units(data, offsets):
    starts, ends, firsts = arrays.word_bounds(data, offsets)
    return arrays.word_hashes(data, starts, ends), firsts


def leading_words(data: np.ndarray) -> np.ndarray:
    """At each byte the eight from there on as one number, the first the highest (zeros after the end): a view that takes no room."""
    return np.ndarray((len(data),), ">u8", data.tobytes() + bytes(8), 0, (1,))


def leading_bytes(scan, at: np.ndarray) -> np.ndarray:
    """The first eight bytes of the suffixes at anchors, in byte order."""
    out = np.zeros(len(at), np.uint64)
    for k in range(min(8, scan.spec.gram)):
        out |= scan.data[at + k].astype(np.uint64) << np.uint64(8 * (7 - k))
    return out


def leading_hash(scan, at: np.ndarray) -> np.ndarray:
    """Anchor hashes spread evenly again (the smallest of a window are not)."""
    return arrays.mixed(scan.gram[at] ^ _B)


def pack(**parts) -> bytes:
    out = io.BytesIO()
    for a in parts.values():
        out.write(np.int64(a.nbytes).tobytes())
        out.write(np.ascontiguousarray(a).tobytes())
    return out.getvalue()


def unpack(blob: memoryview, *types) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        n = int(np.frombuffer(blob[at : at + 8], np.int64)[0])
        out.append(np.frombuffer(blob[at + 8 : at + 8 + n], t))
        at += 8 + n
    return out


def powers_of(base: np.uint64, n: int) -> np.ndarray:
    """base to the power 0, 1, ... n (modulo 2 to the power 64)."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Scan:
    """Anchors and windows of the texts of one block."""

    def __init__(self, spec: Windows, data, offsets):
        self.spec, self.data, self.offsets = spec, data, offsets
        self.values, self.firsts = spec.units(data, offsets)
        n, w = len(self.values), spec.window
        self.text_of = np.repeat(np.arange(len(self.firsts) - 1), np.diff(self.firsts))
        if n < w:
            self.anchors = np.zeros(0, np.int64)
            return
        # Hash of units [i, j) from sums of powers: the same wherever the units stand.
        powers = powers_of(_B, n)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.values * powers[:-1])))
        self.back = powers_of(_B_INV, n)
        del powers
        self.gram = self.of(np.arange(n - spec.gram + 1), spec.gram) | np.uint64(1)
        least = arrays.slid(self.gram, spec.grams, np.minimum)
        self.least = np.where(self.text_of[: n - w + 1] == self.text_of[w - 1 :], least, np.uint64(0))
        pad = np.zeros(spec.grams - 1, np.uint64)
        most = arrays.slid(np.concatenate((pad, self.least, pad)), spec.grams, np.maximum)
        self.anchors = np.flatnonzero(most == self.gram)

    def of(self, at: np.ndarray, size) -> np.ndarray:
        return arrays.mixed((self.sums[at + size] - self.sums[at]) * self.back[at])

    def contexts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the contexts of anchors begin and end."""
        t = self.text_of[at]
        return np.maximum(self.firsts[t], at - self.spec.grams + 1), np.minimum(self.firsts[t + 1], at + self.spec.window)

    def context_hashes(self, at: np.ndarray) -> np.ndarray:
        begin, end = self.contexts(at)
        return arrays.mixed(self.of(begin, end - begin) + (at - begin).astype(np.uint64) * np.uint64(1000) + (end - at).astype(np.uint64))


def _strings(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of byte strings, and the strings on end."""
    return np.array([len(x) for x in column], np.uint32), np.frombuffer(b"".join(column), np.uint8)


def _by_bucket(bucket: np.ndarray, text: np.ndarray, ids: np.ndarray, tags: np.ndarray, columns: list[np.ndarray]):
    """(bucket, blob) rows: a table of texts and their counts, then the columns."""
    order = np.lexsort((text, bucket))
    bucket, text = bucket[order], text[order]
    columns = [c[order] for c in columns]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a < b:
            part = text[a:b]
            new = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1))
            rows = part[new]
            counts = np.diff(np.concatenate((new, [b - a]))).astype(np.uint32)
            sent = [x for c in columns for x in (_strings(c[a:b]) if c.dtype == object else (c[a:b],))]
            yield int(bucket[a]), pack(ids=ids[rows], tags=tags[rows], counts=counts, **{str(k): c for k, c in enumerate(sent)})


def _rows(rows, names, types):
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


BLOBS = (["bucket", "blob"], [pa.int32(), pa.binary()])
HITS = (["doc", "tag", "kind", "places"], [pa.int64(), pa.int64(), pa.int32(), pa.binary()])


def _anchors(batches, spec: Windows, splitters: np.ndarray):
    for batch in arrays.blocks(batches, "text"):
        scan = Scan(spec, *arrays.text_bytes(batch.column("text")))
        at = scan.anchors
        if not len(at):
            continue
        text = scan.text_of[at]
        ids, tags = batch.column("doc").to_numpy(), batch.column("tag").to_numpy().astype(np.uint32)
        bucket = np.searchsorted(splitters, spec.lead(scan, at), "right")
        columns = [arrays.mixed(scan.gram[at] ^ _B).astype(np.uint32), scan.context_hashes(at), (at - scan.firsts[text]).astype(np.uint32)]
        yield _rows(_by_bucket(bucket, text, ids, tags, columns), *BLOBS)


def _gathered(batches, *types):
    """All blobs of each bucket of a partition (rows come sorted by bucket): bucket, ids, tags, columns."""
    now, held = None, []

    def joined():
        parts = list(zip(*held))
        ids, tags = (np.concatenate([np.repeat(x, c) for x, c in zip(parts[k], parts[2])]) for k in (0, 1))
        return now, ids, tags, [np.concatenate(p) for p in parts[3:]]

    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
            if bucket != now and held:
                yield joined()
                held = []
            now = bucket
            held.append(unpack(memoryview(blob.as_buffer()), np.int64, np.uint32, np.uint32, *types))
    if held:
        yield joined()


def _hits(ids, tags, places, kinds):
    """(doc, tag, kind, places) rows, one for each document and kind."""
    order = np.lexsort((places, kinds, tags, ids))
    ids, tags, kinds, places = ids[order], tags[order], kinds[order], places[order].astype(np.uint32)
    new = np.flatnonzero((np.diff(ids) != 0) | (np.diff(tags) != 0) | (np.diff(kinds) != 0)) + 1
    cuts = np.concatenate(([0], new, [len(ids)])) if len(ids) else np.zeros(1, int)
    return _rows([(int(ids[a]), int(tags[a]), int(kinds[a]), places[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])], *HITS)


#: Kinds of places: anchors covered throughout, anchors at edges, first units of covered windows.
FULL, EDGE, WINDOW = 0, 1, 2


def _sorted_anchors(batches, spec: Windows):
    """Sort a bucket's suffixes by anchor, context, document and place, and compare neighbours."""
    for _, ids, tags, (key, context, place) in _gathered(batches, np.uint32, np.uint64, np.uint32):
        # An anchor that occurs once needs no further sorting.
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        order = order[np.lexsort((place[order], ids[order], context[order], key[order]))]
        key, context, place, ids, tags = key[order], context[order], place[order], ids[order], tags[order]
        n = len(order)
        if not n:
            continue
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        new_context = new_key | np.concatenate(([True], context[1:] != context[:-1]))
        first = np.maximum.accumulate(np.where(new_context, np.arange(n), 0))
        later = ids > ids[first]
        if spec.within:
            later |= (ids == ids[first]) & (tags == tags[first]) & (place > place[first])
        group = np.cumsum(new_key) - 1
        several = np.bincount(group, weights=new_context)[group] > 1
        edge = ~later & several
        keep = later | edge
        yield _hits(ids[keep], tags[keep], place[keep], np.where(later, FULL, EDGE)[keep])


def _wanted(batch, kind: int):
    """For each row that has places of ``kind``: its index and the places."""
    tags = batch.column("tag").to_pylist()
    for i, hits in enumerate(batch.column("hits").to_pylist()):
        parts = [np.frombuffer(h["places"], np.uint32) for h in hits or () if h["kind"] == kind and h["tag"] == tags[i] & 0xFFFFFFFF]
        if parts:
            yield i, np.concatenate(parts).astype(np.int64)


def _edge_scans(batches, spec: Windows):
    """(batch, scan, text index of each edge anchor, its unit) for blocks that have edges."""
    for batch in arrays.blocks(batches, "text"):
        found = dict(_wanted(batch, EDGE))
        if not found:
            continue
        part = batch.take(pa.array(sorted(found)))
        scan = Scan(spec, *arrays.text_bytes(part.column("text")))
        places = [found[i] for i in sorted(found)]
        text = np.repeat(np.arange(len(places)), [len(p) for p in places])
        yield part, scan, text, np.concatenate(places) + scan.firsts[text]


def edge_contexts(scan: Scan, at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor: ``values`` of its context (padded with 0), begin, size, and a bit for each window that it is the anchor of."""
    spec = scan.spec
    begin, end = scan.contexts(at)
    index = begin[:, None] + np.arange(spec.window + spec.grams - 1)[None, :]
    inside = index < end[:, None]
    context = np.where(inside, values[np.where(inside, index, 0)], values.dtype.type(0))
    mine = np.zeros(len(at), np.uint64)
    for k in range(spec.grams):
        start = begin + k
        ok = start + spec.window <= end
        ok[ok] = scan.least[start[ok]] == scan.gram[at[ok]]
        mine |= ok.astype(np.uint64) << np.uint64(k)
    return context, begin, end - begin, mine


def _edge_texts(batches, spec: Windows, splitters: np.ndarray):
    """The contexts of edges, to buckets by anchor (bytes as units)."""
    for batch, scan, text, at in _edge_scans(batches, spec):
        data = arrays.text_bytes(batch.column("text"))[0]
        context, begin, _, mine = edge_contexts(scan, at, data)
        ids, tags = batch.column("doc").to_numpy(), batch.column("tag").to_numpy().astype(np.uint32)
        bucket = np.searchsorted(splitters, spec.lead(scan, at), "right")
        yield _rows(_by_bucket(bucket, text, ids, tags, [context, (begin - scan.firsts[text]).astype(np.uint32), mine]), *BLOBS)


def equal_strings(words: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the strings of ``length`` bytes that begin at places ``at``: (which, group).

    A character is eight bytes (``words``: see ``leading_words``). Strings are parted by their first character,
    each part that is not a single string by its second one, and so on; what is left is ``which`` strings
    have an equal one, in order, and equal ones share a ``group``.
    """
    which, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for depth in range(0, length, 8):
        key = words[at[which] + depth].astype(np.uint64)
        if length - depth < 8:
            key = key >> np.uint64(8 * (8 - length + depth))
        order = np.lexsort((key, group)) if depth else np.argsort(key, kind="stable")
        which, group, key = which[order], group[order], key[order]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))[: len(which)]
        several = ~(new & np.concatenate((new[1:], [True]))[: len(which)])
        which, group = which[several], np.cumsum(new)[several]
    return which, group


#: Strings that are sorted at once, about.
AT_ONCE = 1 << 18


def _sorted_windows(batches, spec: Windows):
    """Sort the windows of a bucket's edges byte by byte, compare neighbours, and find those that a smaller document has.

    Windows are taken in shares by their first bytes, so that a large bucket needs no more room to sort.
    """
    width, size = spec.window + spec.grams - 1, spec.window
    for _, ids, tags, (context, begin, mine) in _gathered(batches, np.uint8, np.uint32, np.uint64):
        words = leading_words(context)
        every, offset = (x.astype(np.int32) for x in np.nonzero(mine[:, None] >> np.arange(spec.grams, dtype=np.uint64)[None, :] & np.uint64(1)))
        shares = 1 + len(every) // AT_ONCE
        share = (arrays.mixed(words[every.astype(np.int64) * width + offset].astype(np.uint64)) % np.uint64(shares)).astype(np.int32)
        for turn in range(shares):
            mine_now = np.flatnonzero(share == turn)
            row, k = every[mine_now].astype(np.int64), offset[mine_now]
            which, group = equal_strings(words, row * width + k, size)
            row, k = row[which], k[which]
            place, owner, tag = begin[row] + k.astype(np.uint32), ids[row], tags[row]
            order = np.lexsort((place, owner, group))
            group, place, owner, tag = group[order], place[order], owner[order], tag[order]
            if not len(group):
                continue
            first = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), np.arange(len(group)), 0))
            later = owner > owner[first]
            if spec.within:
                later |= (owner == owner[first]) & (tag == tag[first]) & (place > place[first])
            yield _hits(owner[later], tag[later], place[later], np.full(later.sum(), WINDOW))


def covered(spec: Windows, n_units: int, hits, tag: int) -> np.ndarray:
    """Which units of a text are covered, from its hits."""
    edge = np.zeros(n_units + 1, np.int32)
    for h in hits or ():
        if h["tag"] != tag & 0xFFFFFFFF:
            continue
        p = np.frombuffer(h["places"], np.uint32).astype(np.int64)
        if h["kind"] == FULL:
            np.add.at(edge, np.maximum(0, p - spec.grams + 1), 1)
            np.add.at(edge, np.minimum(n_units, p + spec.window), -1)
        elif h["kind"] == WINDOW:
            np.add.at(edge, p, 1)
            np.add.at(edge, p + spec.window, -1)
    return np.cumsum(edge[:-1]) > 0


_HITS = "array<struct<tag:bigint,kind:int,places:binary>>"


#: Stands for a null id, so that no filter on nulls sets one exchange of the texts apart from another.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``doc``, ``tag``, ``text``): the tag tells rows with one id but different texts apart."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))


def later_copies(rows: DataFrame) -> DataFrame:
    """(``doc``, ``copy_tag``) of rows whose whole text is also that of a smaller id, and of rows without an id."""
    whole = rows.select("doc", "tag", F.xxhash64(F.lit(7), "text").alias("tag2"))
    least = whole.filter(f"doc > {NO_ID}").groupBy("tag", "tag2").agg(F.min("doc").alias("least"))
    later = whole.join(least, ["tag", "tag2"]).filter("doc > least")
    return later.union(whole.filter(f"doc = {NO_ID}").withColumn("least", F.col("doc")).select(*later.columns)).select("doc", F.col("tag").alias("copy_tag")).distinct()


def bucket_count(docs: DataFrame, text_col: str) -> int:
    """Buckets for the bytes of all texts, at least one for each shuffle partition."""
    total = docs.agg(F.sum(F.octet_length(f"`{text_col}`"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))


def even_splitters(buckets: int) -> np.ndarray:
    return np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)


def repeated(docs: DataFrame, spec: Windows, id_col: str, text_col: str, splitters: np.ndarray, copies: DataFrame, edges=None) -> DataFrame:
    """(``doc``, ``tag``, ``text``, ``copy``, ``hits``) for every row of ``docs``.

    ``copy``: the whole text also belongs to a smaller id (such rows have no hits). ``edges``:
    the two functions of the second exchange (for byte units unless given).
    """
    spark = docs.sparkSession
    buckets = len(splitters) + 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed(docs, id_col, text_col).repartition(parts, "doc")
    rows = texts.join(copies.groupBy("doc").agg(F.collect_set("copy_tag").alias("copy_tags")).hint("shuffle_hash"), "doc", "left")
    rows = rows.select("doc", "tag", "text", F.coalesce(F.array_contains("copy_tags", F.col("tag")), F.lit(False)).alias("copy"))
    once = rows.filter("not copy").select("doc", "tag", "text")
    blob, hit = "bucket int, blob binary", "doc long, tag long, kind int, places binary"

    def exchanged(blobs: DataFrame) -> DataFrame:
        return blobs.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")

    def by_doc(hits: DataFrame) -> DataFrame:
        return hits.groupBy("doc").agg(F.collect_list(F.struct("tag", "kind", "places")).alias("hits")).hint("shuffle_hash")

    hits = by_doc(map_arrow(exchanged(map_arrow(once, partial(_anchors, spec=spec, splitters=splitters), blob)), partial(_sorted_anchors, spec=spec), hit))
    emit, settle = edges or (partial(_edge_texts, spec=spec, splitters=splitters), partial(_sorted_windows, spec=spec))
    at_edges = once.join(hits, "doc").filter(F.exists("hits", lambda h: h["kind"] == EDGE))
    more = by_doc(map_arrow(exchanged(map_arrow(at_edges, emit, blob)), settle, hit)).withColumnRenamed("hits", "more")
    both = F.concat(F.coalesce("hits", F.array().cast(_HITS)), F.coalesce("more", F.array().cast(_HITS)))
    return rows.join(hits, "doc", "left").join(more, "doc", "left").select(
        F.nullif("doc", F.lit(NO_ID)).alias("doc"), "tag", "text", (F.col("copy") & (F.col("doc") > NO_ID)).alias("copy"), both.alias("hits")
    )

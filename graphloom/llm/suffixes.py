"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a smaller document.

The suffixes are sparse: of every window of 50 bytes the one at its anchor (``repeats``). They are
range-partitioned by their leading bytes at splitters taken from a sample, so that buckets are
ranges of the suffix array. A first sort by hashes finds which suffixes occur again; of those whose
contexts differ, all 50-byte strings around them go to the bucket of their suffix, are sorted byte
by byte by multikey quicksort, and neighbours are compared. Equal strings have equal anchors with
equal leading bytes, so no match lies across the boundary of two buckets. Matches never cross
documents and are judged on the input.

Removals of strings at edges of repeats rest on their bytes. Two hashes stand for equality besides:
of whole texts (128 bits), and of whole contexts (96 bits, within one range of leading bytes).

Ids are integers (or null); cast others first, as they are ordered by value.

Defined results: a null or empty text has no bytes. A row with a null id keeps its whole text
and covers nothing. Rows that share an id never cover each other. Columns beside id and text are
ignored, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays, repeats
from graphloom.session import map_arrow, written

LENGTH = 50
GRAM = 20

#: Rows whose suffixes set the splitters: for each bucket, and at least.
SAMPLE_PER_BUCKET, SAMPLE_ROWS = 4, 400


def _sampled_keys(batches, spec):
    for batch in arrays.blocks(batches, "text"):
        scan = repeats.Scan(spec, *arrays.text_bytes(batch.column("text")))
        keys = repeats.leading_bytes(scan, scan.anchors[::16])
        yield pa.record_batch([pa.array([np.ascontiguousarray(keys).tobytes()], pa.binary())], names=["keys"])


def splitters(docs: DataFrame, spec, text_col: str, buckets: int) -> np.ndarray:
    """Up to ``buckets - 1`` quantiles of the leading bytes of a sample's suffixes; even ones if it is small."""
    n, rows = docs.count(), max(SAMPLE_ROWS, SAMPLE_PER_BUCKET * buckets)
    sample = docs.select(F.col(f"`{text_col}`").alias("text")).sample(min(1.0, 1.2 * rows / max(n, 1)), 11).limit(rows)
    keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r.keys, np.uint64) for r in map_arrow(sample, partial(_sampled_keys, spec=spec), "keys binary").collect())])
    if len(keys) < 20 * buckets:
        return repeats.even_splitters(buckets)
    keys.sort()
    return np.unique(keys[np.arange(1, buckets) * len(keys) // buckets])


def _cut(batches, spec):
    for batch in arrays.blocks(batches, "text"):
        out = []
        for text, tag, copy, hits in zip(batch.column("text"), batch.column("tag").to_pylist(), batch.column("copy").to_pylist(), batch.column("hits").to_pylist()):
            data = text.as_buffer().to_pybytes()
            n = len(data)
            if copy and n >= spec.window:
                gone = np.ones(n, bool)
            elif hits:
                gone = repeats.covered(spec, n, hits, tag)
            else:
                out.append((n, 0, 0, hashlib.sha256(data).hexdigest(), []))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out.append((n, int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), edges.tolist()))
        columns = list(zip(*out))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        yield pa.record_batch([batch.column("doc"), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "edges"])


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row: its id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``edges``.

    ``edges`` holds begin and end of each removed run of bytes, in turn.
    """
    spec = repeats.Windows(repeats.byte_units, length, min(gram, length), within=False, lead=repeats.leading_bytes)
    copies = written(repeats.later_copies(repeats.keyed(docs, id_col, text_col)))
    buckets = repeats.bucket_count(docs, text_col)
    rows = repeats.repeated(docs, spec, id_col, text_col, splitters(docs, spec, text_col, buckets), copies)
    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, edges array<long>"
    return map_arrow(rows, partial(_cut, spec=spec), schema).withColumnRenamed("doc", id_col)

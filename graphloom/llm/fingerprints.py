"""Document fingerprints by content-defined chunking.

A 16-bit gear hash of the last 16 bytes marks boundaries. Chunking is normalised: before
``NORMAL`` bytes a boundary needs six zero bits, after it four, and ``MOST`` bytes end a chunk in
any case. A fingerprint is the set of the chunks' digests with their lengths. The likeness of a text
to another one is how far the other contains it: the bytes of its distinct chunks that the other has
too, of the bytes of all of them. A text wholly inside another is so found again, but for the chunks
at its two ends; an insertion only changes the chunks around it, as the boundaries after it are
found again.

Documents are compared with the next one by id. They are range-partitioned by ids of the table
that split it evenly, and the row at each border also goes to the partition before it, so that
no task looks further than its own rows.

Ids are integers (or null); cast others first, as they are ordered by value.

Defined results: a null or empty text has the empty fingerprint; two empty fingerprints are
alike (1), an empty and another one are not (0). Null ids come before all others, rows with one
id in order of their texts; after the last row comes the first. Other columns are ignored,
whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays
from graphloom.session import map_arrow

LEAST, NORMAL, MOST = 16, 40, 128
GEAR = np.random.default_rng(5).integers(0, 1 << 16, 256, dtype=np.uint16)
HARD, EASY = np.uint16(0xFC00), np.uint16(0xF000)
#: Digest bytes of a chunk; one more holds its length.
DIGEST = 5


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of it and the 15 before, by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    return h


def cuts(hard: list[int], easy: list[int], begin: int, end: int) -> list[int]:
    """Chunk boundaries of the bytes [begin, end); ``hard`` and ``easy`` are sorted places of possible ends."""
    out, i, j = [begin], bisect_left(hard, begin), bisect_left(easy, begin)
    n_hard, n_easy = len(hard), len(easy)
    while begin < end:
        if end - begin <= LEAST:
            begin = end
        else:
            i = bisect_left(hard, begin + LEAST, i)
            if i < n_hard and hard[i] < begin + NORMAL:
                begin = hard[i]
            else:
                j = bisect_left(easy, begin + NORMAL, j)
                begin = easy[j] if j < n_easy and easy[j] < begin + MOST else begin + MOST
            begin = min(begin, end)
        out.append(begin)
    return out


def chunked(texts: list[bytes]) -> list[dict[bytes, int]]:
    """Each text's chunks: digest to length."""
    joined = b"".join(texts)
    h = gear_hashes(np.frombuffer(joined, np.uint8)) if joined else np.zeros(0, np.uint16)
    easy = np.flatnonzero((h & EASY) == 0)
    hard = (easy[(h[easy] & HARD) == 0] + 1).tolist()
    easy = (easy + 1).tolist()
    out, at, digest = [], 0, xxhash.xxh3_64_digest
    for t in texts:
        c = cuts(hard, easy, at, at + len(t))
        at += len(t)
        out.append({digest(joined[a:b])[:DIGEST]: b - a for a, b in zip(c, c[1:])})
    return out


def fingerprint(chunks: dict[bytes, int]) -> str:
    return base64.b64encode(b"".join(d + bytes([n]) for d, n in sorted(chunks.items()))).decode()


def likeness(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """How far ``b`` contains ``a``, by length (0 to 1)."""
    if not a or not b:
        return float(not a and not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def _bucketed(batches, borders: np.ndarray, first: int):
    """Each row to the bucket of its id; rows at a bucket's lower border also to the bucket before (``halo``)."""
    for batch in batches:
        keys = batch.column("key").to_numpy()
        bucket = np.searchsorted(borders, keys, "right")
        yield pa.record_batch([*batch.columns, pa.array(bucket.astype(np.int32)), pa.array(np.zeros(len(keys), np.int32))], names=[*batch.schema.names, "bucket", "halo"])
        edge = np.flatnonzero(np.isin(keys, borders) | (keys == first))
        if len(edge):
            part = batch.take(pa.array(edge))
            before = (bucket[edge] - 1) % (len(borders) + 1)
            yield pa.record_batch([*part.columns, pa.array(before.astype(np.int32)), pa.array(np.ones(len(edge), np.int32))], names=[*part.schema.names, "bucket", "halo"])


def _printed(batches):
    held: list[tuple] = []  # the last row waits for the next one

    def rows(part):
        """Results of all rows of ``part`` but the last, which is only looked at."""
        texts = [t or "" for _, t, _ in part]
        quarter = [len(t) // 4 for t in texts]
        edited = [t[: len(t) - q] + n[:q] for t, n, q in zip(texts, texts[1:], quarter)]
        plain = [t.encode() for t in texts]
        changed = [t.encode() for t in edited]
        own = chunked(plain)
        other = chunked(changed)
        out = [
            (part[i][0], len(texts[i]), hashlib.sha256(changed[i]).hexdigest(), fingerprint(own[i]), fingerprint(other[i]), likeness(own[i], other[i]), likeness(own[i], own[i + 1]))
            for i in range(len(edited))
        ]
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=names)

    names = ["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = None
    ended = False
    for batch in arrays.blocks(batches, "text"):
        kinds = kinds or [batch.schema.field("doc").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "halo"))):
            if not ended:
                held.append(row)
                ended = bool(row[2])
        if len(held) > 1:
            yield rows(held)
            held = held[-1:]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``."""
    kind = docs.schema[id_col].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"), key.alias("key"))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5))
    first, borders = rows.agg(F.min("key"), F.percentile_approx("key", shares, F.lit(20 * parts))).first()
    borders = np.array(sorted({b for b in borders or () if b > first}) if parts > 1 else [], np.int64)
    schema = f"doc {kind}, text string, key long, bucket int, halo int"
    placed = map_arrow(rows, partial(_bucketed, borders=borders, first=first or 0), schema)
    placed = placed.repartitionById(len(borders) + 1, F.col("bucket")).sortWithinPartitions("halo", "key", "text")
    out = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(placed.select("doc", "text", "halo"), _printed, f"doc {kind}, {out}").withColumnRenamed("doc", id_col)

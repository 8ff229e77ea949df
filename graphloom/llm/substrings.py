"""Substring dedup by repeated-phrase automata: words covered by a 20-word window seen earlier.

Candidates come from ``repeats``. At the edges of repeats the contexts, as text, are sent to shards
by their anchor phrase; a shard numbers their words, confirms which windows recur, compiles an
Aho-Corasick automaton of them over the word numbers, and streams every context of the shard
through it to find all occurrences, word by word. Of each phrase every occurrence but the first
(smallest id, then smallest start) is removed. Of equal contexts (96 bits of hashes) and equal whole
texts (128 bits) the first alone is streamed: what is found in it is in all of them.

Ids are integers (or null); cast others first, as they are ordered by value.

Defined results: a null or empty text has no words. A row with a null id keeps its whole text
and covers nothing. Of rows that share an id but not the text, none comes first, so they do not
cover each other; equal rows have equal results. Columns beside id and text do not matter,
whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays, repeats
from graphloom.session import map_arrow, written

WORDS = 20
GRAM = 8

#: Fixed value: a word.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _contexts(batches, spec, splitters: np.ndarray):
    """The texts of contexts at edges, to shards by anchor."""
    for part, scan, text, at in repeats._edge_scans(batches, spec):
        begin, end = scan.contexts(at)
        starts, ends, _ = arrays.word_bounds(scan.data, scan.offsets)
        raw = scan.data.tobytes()
        words = np.empty(len(at), object)
        words[:] = [raw[a:b] for a, b in zip(starts[begin].tolist(), ends[end - 1].tolist())]
        ids, tags = part.column("doc").to_numpy(), part.column("tag").to_numpy().astype(np.uint32)
        bucket = np.searchsorted(splitters, spec.lead(scan, at), "right")
        yield repeats._rows(repeats._by_bucket(bucket, text, ids, tags, [words, (begin - scan.firsts[text]).astype(np.uint32)]), *repeats.BLOBS)


def _automata(batches, spec):
    width, size = spec.window + spec.grams - 1, spec.window
    for _, ids, tags, (sizes, raw, begin) in repeats._gathered(batches, np.uint32, np.uint8, np.uint32):
        ends = np.cumsum(sizes.astype(np.int64))
        raw = raw.tobytes()
        known: dict[bytes, int] = {}
        rows = [[known.setdefault(w, len(known) + 1) for w in raw[a:b].split()] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
        count = np.array([len(r) for r in rows])
        numbers = np.zeros((len(rows), width), np.int64)
        numbers[np.arange(width)[None, :] < count[:, None]] = [n for r in rows for n in r]
        row, offset = np.nonzero(np.arange(spec.grams)[None, :] + size <= count[:, None])
        whole = np.zeros((len(rows), spec.grams), np.uint64)
        for i in range(size):
            whole = arrays.mixed(whole + numbers[:, i : i + spec.grams].astype(np.uint64))
        # Confirm: a phrase recurs if two places have it.
        hashes, place = whole[row, offset], begin[row].astype(np.int64) + offset
        order = np.lexsort((place, tags[row], ids[row], hashes))
        h, r, p = hashes[order], row[order], place[order]
        same = h[1:] == h[:-1]
        apart = same & ((ids[r[1:]] != ids[r[:-1]]) | (tags[r[1:]] != tags[r[:-1]]) | (p[1:] != p[:-1]))
        recurring = np.unique(h[1:][apart])
        if not len(recurring):
            continue
        sample = np.flatnonzero(np.isin(hashes, recurring))
        sample = sample[np.unique(hashes[sample], return_index=True)[1]]
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for n, i in enumerate(sample):
            machine.add_word(tuple(numbers[row[i], offset[i] : offset[i] + size].tolist()), n)
        machine.make_automaton()
        found = [(n, i, end) for i, c in enumerate(count) for end, n in machine.iter(tuple(rows[i]))]
        phrase, i, end = np.array(found, np.int64).reshape(-1, 3).T
        start = begin[i].astype(np.int64) + end - size + 1
        order = np.lexsort((start, ids[i], phrase))
        phrase, start, ids_, tags_ = phrase[order], start[order], ids[i][order], tags[i][order]
        first = np.maximum.accumulate(np.where(np.concatenate(([True], phrase[1:] != phrase[:-1])), np.arange(len(phrase)), 0))
        later = (ids_ > ids_[first]) | ((ids_ == ids_[first]) & (tags_ == tags_[first]) & (start > start[first]))
        yield repeats._hits(ids_[later], tags_[later], start[later], np.full(later.sum(), repeats.WINDOW))


def _gone(spec, n: int, copy: bool, hits, tag) -> np.ndarray:
    return np.ones(n, bool) if copy and n >= spec.window else repeats.covered(spec, n, hits, tag)


def _cut(batches, spec):
    for batch in arrays.blocks(batches, "text"):
        out = []
        for text, tag, copy, hits in zip(batch.column("text"), batch.column("tag").to_pylist(), batch.column("copy").to_pylist(), batch.column("hits").to_pylist()):
            words = text.as_buffer().to_pybytes().split()
            n, edges = len(words), np.zeros(0, np.int64)
            if copy or hits:
                gone = _gone(spec, n, copy, hits, tag)
                words = [w for w, g in zip(words, gone) if not g]
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
            out.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest(), edges.tolist()))
        columns = list(zip(*out))
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        yield pa.record_batch([batch.column("doc"), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=["doc", "n_words", "n_removed", "kept_sha256", "edges"])


def _texts(batches, spec):
    """The changed texts: removed words go with the space after them."""
    for batch in arrays.blocks(batches, "text"):
        out = []
        for text, tag, copy, hits in zip(batch.column("text"), batch.column("tag").to_pylist(), batch.column("copy").to_pylist(), batch.column("hits").to_pylist()):
            data = text.as_buffer().to_pybytes()
            begins = [m.start() for m in WORD.finditer(data)]
            gone = _gone(spec, len(begins), copy, hits, tag)
            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).tolist()
            at, parts = 0, []
            for a, b in zip(edges[::2], edges[1::2]):
                parts.append(data[at : begins[a]])
                at = begins[b] if b < len(begins) else len(data)
            out.append(b"".join([*parts, data[at:]]).decode() if edges else None)
        yield pa.record_batch([batch.column("doc"), batch.column("tag"), pa.array(out, pa.string())], names=["doc", "tag", "new"]).filter(pa.array([x is not None for x in out]))


def _found(docs, id_col, text_col, spec):
    copies = written(repeats.later_copies(repeats.keyed(docs, id_col, text_col)))
    splitters = repeats.even_splitters(repeats.bucket_count(docs, text_col))
    edges = partial(_contexts, spec=spec, splitters=splitters), partial(_automata, spec=spec)
    return repeats.repeated(docs, spec, id_col, text_col, splitters, copies, edges)


def _spec(words: int, gram: int):
    return repeats.Windows(repeats.word_units, words, min(gram, words), within=True, lead=repeats.leading_hash)


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """Per row: its id, ``n_words``, ``n_removed``, ``kept_sha256`` and ``edges``.

    ``edges`` holds first and end of each removed run of words, in turn.
    """
    spec = _spec(words, gram)
    schema = "doc long, n_words long, n_removed long, kept_sha256 string, edges array<long>"
    return map_arrow(_found(docs, id_col, text_col, spec), partial(_cut, spec=spec), schema).withColumnRenamed("doc", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated words cut out of the texts; rows of which no word is left go."""
    spec = _spec(words, gram)
    changed = _found(docs, id_col, text_col, spec).filter("copy or size(hits) > 0").select("doc", "tag", "text", "copy", "hits")
    new = written(map_arrow(changed, partial(_texts, spec=spec), "doc long, tag long, new string").dropDuplicates(["doc", "tag"]))
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tag"))
    joined = rows.join(new, ["doc", "tag"], "left").filter(F.col("new").isNull() | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
    return joined.select(*[(F.coalesce("new", F.col(f"_row.`{c}`")) if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])

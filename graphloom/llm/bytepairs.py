"""Byte-pair encoding and decoding by tree concatenation.

A text is cut by the vocabulary's own splitting rule. What the rule leaves unsplit and is longer
than ``LEAF`` bytes is halved until the parts are short; the parts are encoded apart and joined as
a tree. At a join, the last tokens of the left side and the first of the right one are encoded
again as one window. The window grows on each side that does not agree, until its first token is
the left side's and its last one the right side's; then no merge reaches across either end, and the
join is exact. (In a vocabulary whose ids follow the order of its merges, a sequence is the encoding
of its bytes if each two neighbours are the encoding of theirs.)

An unsplit part of ``SPREAD`` bytes or more is cut into leaf rows that tasks encode in parallel;
one row gathers a part's leaves for its joins, so it holds no more than the text's own row does.

Defined results: a null or empty text has no ids. Strings of added tokens become their ids if
``special``, else they are ordinary text. Decoding joins the tokens' bytes; bytes that are no UTF-8
become U+FFFD, ids outside the vocabulary nothing, null ids an empty text. Rows may repeat, with any
ids or none; other columns are ignored, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays
from graphloom.session import map_arrow

#: Parts of this many bytes are encoded without halving.
LEAF = 32
#: Unsplit parts of this many bytes are encoded by several tasks, in rows of half as many.
SPREAD = 1 << 14
#: Parts that a task remembers, at most, and the longest one that it does.
REMEMBERED, LONGEST = 400_000, 64
#: A code point without a class in any version of Unicode.
UNASSIGNED = "\u0378"


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """A byte-level vocabulary file (None: the public one of 50,257 tokens)."""

    def __init__(self, path: str | None = None, special: bool = True):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("byte_bpe_50k.json")
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        byte, vocab = byte_of_symbol(), data["model"]["vocab"]
        if data["normalizer"] or data["pre_tokenizer"]["type"] != "ByteLevel" or data["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level vocabularies without normalisation and prefix are known")
        self.bytes = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in data["added_tokens"])]))
        for symbols, i in vocab.items():
            self.bytes[i] = bytes(map(byte.__getitem__, symbols))
        of = {b: vocab[s] for s, b in byte.items()}
        self.single = [of[b] for b in range(256)]
        #: Rank of a merge by its pair, and its token by rank; the last rank stands for no merge.
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        for content, i in self.added.items():
            self.bytes[i] = content.encode()
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if special and self.added else None
        self.rule = regex.compile(public_tokenizers.PATTERN)
        self.strangers = self._strangers(Tokenizer.from_file(path).pre_tokenizer, regex)
        self.table = arrays.Strings(self.bytes)
        self.known = _Known(self)

    def _strangers(self, own, regex):
        """Code points that only a newer Unicode than the vocabulary library's calls letters or numbers."""
        every, out = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000)))), set()
        for kind, like in (("L", "a"), ("N", "1")):
            newer = [c for c in regex.findall(rf"\p{{{kind}}}", every) if unicodedata.category(c)[0] != kind]
            out |= {c for c in newer if len(own.pre_tokenize_str(like + c)) > 1}
        return frozenset(out)

    def units(self, text: str) -> list[str]:
        """What the splitting rule leaves together."""
        if text.isascii() or self.strangers.isdisjoint(text):
            return self.rule.findall(text)
        out, at = [], 0
        for u in self.rule.findall("".join(UNASSIGNED if c in self.strangers else c for c in text)):
            out.append(text[at : at + len(u)])
            at += len(u)
        return out

    def parts(self, text: str) -> list:
        """Units of ``text``, and ids where it names added tokens."""
        if self.cuts is None or not self.cuts.search(text):
            return self.units(text)
        out = []
        for k, piece in enumerate(self.cuts.split(text)):
            out += [self.added[piece]] if k % 2 else self.units(piece)
        return out

    def merged(self, data: bytes) -> list[int]:
        """Apply the first merge in rank, leftmost first, until none applies."""
        ids = list(map(self.single.__getitem__, data))
        if len(ids) > 8 * LEAF:
            return self._merged_long(ids)
        get, none = self.ranks.get, len(self.made)
        ranks = [get(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) < none:
            i = ranks.index(rank)
            ids[i] = self.made[rank]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of merges and linked neighbours."""
        n, get = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(rank, i) for i in range(n - 1) if (rank := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(waiting)
        while waiting:
            rank, i = heapq.heappop(waiting)
            j = after[i]
            if ids[i] < 0 or j >= n or get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j], after[i] = self.made[rank], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (rank := get((ids[i], ids[after[j]]))) is not None:
                    heapq.heappush(waiting, (rank, i))
            if before[i] >= 0 and (rank := get((ids[before[i]], ids[i]))) is not None:
                heapq.heappush(waiting, (rank, before[i]))
        return [i for i in ids if i >= 0]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of two encoded neighbours' bytes together."""
        if not left or not right:
            return left + right
        a = b = 1
        while True:
            window = self.merged(b"".join(map(self.bytes.__getitem__, left[-a:] + right[:b])))
            grow_left = a < len(left) and window[0] != left[-a]
            grow_right = b < len(right) and window[-1] != right[b - 1]
            if not grow_left and not grow_right:
                return left[: max(len(left) - a, 0)] + window + right[b:]
            a, b = min(2 * a, len(left)) if grow_left else a, min(2 * b, len(right)) if grow_right else b

    def tree(self, encoded: list[list[int]]) -> list[int]:
        """Neighbours joined, then neighbours of these, until one is left."""
        while len(encoded) > 1:
            encoded = [self.joined(*encoded[i : i + 2]) if i + 1 < len(encoded) else encoded[i] for i in range(0, len(encoded), 2)]
        return encoded[0] if encoded else []

    def unit(self, data: bytes) -> list[int]:
        """Ids of one unsplit part."""
        if len(data) <= LEAF:
            return self.merged(data)
        half = len(data) // 2
        return self.joined(self.unit(data[:half]), self.unit(data[half:]))

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit values."""
        return b"".join(map(self.known.__getitem__, self.parts(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, one after another."""
        ids = ids[(ids >= 0) & (ids < len(self.bytes))]
        return self.table.joined(ids).tobytes()


class _Known(dict):
    """Ids of parts, remembered in two halves: when the newer is full, the older goes, but for what was asked for since."""

    def __init__(self, own: BytePairs):
        self.own, self.older = own, {}

    def __missing__(self, part) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = array("i", [part] if isinstance(part, int) else self.own.unit(part.encode())).tobytes()
        if isinstance(part, int) or len(part) <= LONGEST:
            if len(self) >= REMEMBERED // 2:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids


_loaded: dict = {}


def vocabulary(path: str | None = None, special: bool = True) -> BytePairs:
    if (path, special) not in _loaded:
        _loaded[path, special] = BytePairs(path, special)
    return _loaded[path, special]


def lists(values: list[bytes]) -> pa.ListArray:
    """An Arrow list of 32-bit values for each byte string."""
    offsets = np.concatenate(([0], np.cumsum([len(v) // 4 for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(values), np.int32)))


def _encoded(batches, path, special):
    own = vocabulary(path, special)
    for batch in arrays.blocks(batches, "text"):
        ids = [own.encode(t) for t in batch.column("text").fill_null("").to_pylist()]
        yield pa.record_batch([batch.column("doc"), lists(ids)], names=["doc", "ids"])


def _cut(batches, path, special, spread):
    """Rows with long unsplit parts, in pieces: ``ids``, or one leaf of an unsplit part and its hash."""
    own = vocabulary(path, special)
    for batch in arrays.blocks(batches, "text"):
        for at, text in enumerate(batch.column("text").to_pylist()):
            out, ids = [], []
            for part in own.parts(text):
                data = b"" if isinstance(part, int) else part.encode()
                if len(data) < spread:
                    ids.append(own.known[part])
                    continue
                out.append((b"".join(ids), None, 0, None))
                ids = []
                name = xxhash.xxh3_128_digest(data)
                out += [(None, name, k, data[x : x + spread // 2]) for k, x in enumerate(range(0, len(data), spread // 2))]
            out.append((b"".join(ids), None, 0, None))
            done, names, leaf, data = zip(*out)
            part_no = np.cumsum([0, *(1 if a is None or k == 0 else 0 for a, k in zip(names[1:], leaf[1:]))])
            own_row = [batch.column(c).take(pa.array(np.full(len(out), at))) for c in ("row", "doc")]
            cols = [pa.array(part_no, pa.int64()), lists([x or b"" for x in done]), pa.array(names, pa.binary()), pa.array(leaf, pa.int64()), pa.array(data, pa.binary())]
            yield pa.record_batch([*own_row, *cols], names=["row", "doc", "part", "ids", "unit", "leaf", "bytes"])


def _leaves(batches, path):
    own = vocabulary(path)
    for batch in batches:
        ids = [array("i", own.unit(b)).tobytes() for b in batch.column("bytes").to_pylist()]
        yield pa.record_batch([batch.column("unit"), batch.column("leaf"), lists(ids)], names=["unit", "leaf", "ids"])


def _trees(batches, path):
    own = vocabulary(path)
    for batch in batches:
        ids = [array("i", own.tree([leaf["ids"] for leaf in x])).tobytes() for x in batch.column("leaves").to_pylist()]
        yield pa.record_batch([batch.column("unit"), lists(ids)], names=["unit", "whole"])


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, special: bool = True, spread: int = SPREAD) -> DataFrame:
    """Per row: id and ``ids`` (an array of integers)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    # A part of that many bytes has a quarter as many characters at least, all white or all not.
    least = spread // 4
    may_be_long = F.coalesce((F.octet_length("text") >= spread) & F.col("text").rlike(rf"(?U)\S{{{least}}}|\s{{{least}}}"), F.lit(False))
    plain = map_arrow(rows.filter(~may_be_long), partial(_encoded, path=path, special=special), f"doc {kind}, ids array<int>")

    long = rows.filter(may_be_long).withColumn("row", F.monotonically_increasing_id())
    cut = map_arrow(long, partial(_cut, path=path, special=special, spread=spread), f"row long, doc {kind}, part long, ids array<int>, unit binary, leaf long, bytes binary")
    leaves = cut.filter("unit is not null").groupBy("unit", "leaf").agg(F.first("bytes").alias("bytes"))
    leaves = map_arrow(leaves, partial(_leaves, path=path), "unit binary, leaf long, ids array<int>")
    units = map_arrow(leaves.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("leaf", "ids"))).alias("leaves")), partial(_trees, path=path), "unit binary, whole array<int>")
    parts = cut.filter("leaf = 0").join(units, "unit", "left").select("row", "doc", F.struct("part", F.coalesce("whole", "ids").alias("ids")).alias("part"))
    texts = parts.groupBy("row").agg(F.first("doc").alias("doc"), F.sort_array(F.collect_list("part")).alias("parts"))
    return plain.unionByName(texts.select("doc", F.flatten("parts.ids").alias("ids"))).withColumnRenamed("doc", id_col)


def _decoded(batches, path):
    own = vocabulary(path)
    for batch in batches:
        ids = batch.column(batch.schema.names.index("ids"))
        values, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        texts = []
        for k, there in enumerate(ids.is_valid().to_pylist()):
            texts.append(own.decode(values[offsets[k] : offsets[k + 1]]).decode(errors="replace") if there else "")
        yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """``ids`` (rows with an array of integers in a column of that name) with the column ``decoded``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ids.schema.fields)
    return map_arrow(ids, partial(_decoded, path=path), f"{schema}, decoded string")

"""Alignment of two tokenizers over the same texts, segment by segment.

``A`` is a byte-level vocabulary of the tokenizers library, ``B`` a SentencePiece model. Texts are
cut before runs of white space, at characters before which neither vocabulary can merge: A's
splitting rule never puts white space after something else, and no piece of B holds that character
behind another one (looked up when the model is loaded). Blocks of documents number their distinct
segments; the segments of all blocks are sorted together, each is tokenised and aligned once, and
the alignments go back to the blocks by their numbers. A block is a few megabytes of text, so what a
task holds follows the block. Links never leave a segment, since both tokenizers' tokens end there.

An alignment is the path along all token ends: at each step a token of A ends (1), of B (2), or one
of both (3). Between two ends lies one token of each, so steps are links, and steps of 3 close groups.
How many documents hold a pair of linked ids is counted by block and summed over the corpus; the sums
go back to the blocks that hold the pair.

Defined results: a text that is null, empty, or that either tokenizer's tokens do not give back
byte for byte has no tokens. Repeated rows count as documents each, with any ids or none. Other
columns are ignored, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from array import array
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays
from graphloom.llm.bytepairs import byte_of_symbol
from graphloom.session import discard, map_arrow, shipped, written

SPACE = "▁"
#: White space and control characters: what any version of any library could take for white space.
WHITE = r"\s\x00-\x20\x7f-\xa0 ᠎ -‏ -  -⁤　﻿▁"


class Aligner:
    """Both tokenizers, and where texts may be cut for them."""

    def __init__(self, a: str | None = None, b: str | None = None):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        a, b = a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        with open(a, encoding="utf-8") as f:
            data = json.load(f)
        if data["normalizer"] or data["pre_tokenizer"]["type"] != "ByteLevel" or not data["pre_tokenizer"]["use_regex"] or data["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("A must be a byte-level vocabulary that splits texts and adds no space")
        byte, vocab = byte_of_symbol(), data["model"]["vocab"]
        of_a = {i: bytes(map(byte.__getitem__, symbols)) for symbols, i in vocab.items()}
        self.a_table = arrays.Strings([of_a.get(i, b"") for i in range(1 + max([*of_a, *(t["id"] for t in data["added_tokens"])]))])
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        special = [self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i) for i in range(len(pieces))]
        self.b_table = arrays.Strings([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)])
        #: Ids take two bytes where both vocabularies allow it.
        self.kind = "H" if max(len(self.a_table.sizes), len(pieces)) <= 1 << 16 else "i"
        own = [p.replace(SPACE, " ") for i, p in enumerate(pieces) if not self.b.is_byte(i) and not special[i]]
        inside = {c for p in own for before, c in zip(p, p[1:]) if not re.match(f"[{WHITE}]", before)}
        after_space = {p[1] for p in own if len(p) > 1 and p[0] == " "}
        #: Cuts lie before these; a space before any but a space must stay a piece of its own, as B adds one to every text.
        self.cuts = "".join(c for c in " \n\t" if c not in inside and (c == " " or c not in after_space))
        glue = rf"(?:(?![{re.escape(self.cuts)}])[{WHITE}])" if self.cuts else rf"[{WHITE}]"
        self.pattern = re.compile(rf"[{WHITE}]+[^{WHITE}]*(?:{glue}[{WHITE}]*[^{WHITE}]*)*")

    def segments(self, text: str) -> list[str]:
        """Segments of a space and the text."""
        return self.pattern.findall(" " + text)

    def b_ids(self, segments: list[str]) -> list[list[int]]:
        """B puts a space before what it encodes."""
        led = [x[0] == " " for x in segments]
        found = self.b.encode([x[1:] if y else x for x, y in zip(segments, led)], num_threads=1)
        single = [self.b.piece_to_id(SPACE)]
        return [ids if y and len(x) > 1 else single if y else ids[1:] for x, y, ids in zip(segments, led, found)]

    def align(self, segments: list[str]) -> tuple[list, list]:
        """For each segment the ids of A and then of B, and the steps; None where a tokenizer does not give it back."""
        raw = [x.encode() for x in segments]
        sizes = np.array([len(x) for x in raw])
        sides = [(self.a_table, [x.ids for x in self.a.encode_batch_fast(segments, add_special_tokens=False)]), (self.b_table, self.b_ids(segments))]
        fits = np.ones(len(raw), bool)
        for of, ids in sides:
            flat, starts = _flat(ids)
            whole = _sums(of.sizes[flat], starts) == sizes
            fits &= whole
            at = np.flatnonzero(whole)
            if len(at):  # where the lengths agree, the bytes can be held against each other
                there = np.concatenate(([0], np.cumsum(sizes[at])))
                differ = of.joined(flat[np.repeat(whole, np.diff(starts))]) != np.frombuffer(b"".join(raw[k] for k in at), np.uint8)
                fits[at] &= _sums(differ, there) == 0
        at = np.flatnonzero(fits)
        if not len(at):
            return [None] * len(raw), [None] * len(raw)
        (end_a, _), (end_b, _) = ((np.cumsum(of.sizes[x[0]]), x[1]) for of, ids in sides for x in [_flat([ids[k] for k in at])])
        ends = np.union1d(end_a, end_b)
        steps = (np.isin(ends, end_a) + 2 * np.isin(ends, end_b)).astype(np.uint8)
        cuts = np.searchsorted(ends, np.cumsum(sizes[at]), "right")
        tokens, path, before = [None] * len(raw), [None] * len(raw), 0
        for k, cut in zip(at.tolist(), cuts.tolist()):
            tokens[k] = array(self.kind, sides[0][1][k] + sides[1][1][k]).tobytes()
            path[k] = steps[before:cut].tobytes()
            before = cut
        return tokens, path


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists one after another, and where each list's begin (with the total)."""
    starts = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, starts[-1]), starts


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[starts])


_loaded: dict = {}


def _aligner(a, b) -> Aligner:
    if (a, b) not in _loaded:
        _loaded[a, b] = Aligner(a, b)
    return _loaded[a, b]


class _Numbers(dict):
    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        return number


#: Bytes of text in a block.
BLOCK = 8 << 20


def _numbered(batches, a, b):
    """Blocks: a row for each document with the numbers of its segments, and one for each distinct segment."""
    own, task = _aligner(a, b), TaskContext.get().partitionId()
    names = ["block", "doc", "numbers", "no", "segment"]
    numbers, held, block = _Numbers(), 0, task << 32

    def segments():
        n = len(numbers)
        blank = pa.nulls(n, kind)
        return pa.record_batch([pa.array(np.full(n, block)), blank, pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(list(numbers), pa.string())], names=names)

    kind = pa.null()
    for batch in arrays.blocks(batches, "text"):
        kind = batch.column("doc").type
        texts, out = batch.column("text").to_pylist(), []
        for text in texts:
            out.append(array("i", map(numbers.__getitem__, own.segments(text))).tobytes() if text else b"")
            held += len(text or "")
        n = len(texts)
        yield pa.record_batch([pa.array(np.full(n, block)), batch.column("doc"), pa.array(out, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=names)
        if held >= BLOCK:
            yield segments()
            numbers, held, block = _Numbers(), 0, block + 1
    if numbers:
        yield segments()


def _aligned(batches, a, b):
    """Rows sorted by segment: each segment is aligned when it comes up first."""
    own, last = _aligner(a, b), (None, None, None)
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            coded = part.column("segment").dictionary_encode()
            segments = coded.dictionary.to_pylist()
            if segments[0] == last[0]:
                found = own.align(segments[1:]) if len(segments) > 1 else ([], [])
                tokens, path = [last[1], *found[0]], [last[2], *found[1]]
            else:
                tokens, path = own.align(segments)
            last = segments[-1], tokens[-1], path[-1]
            columns = [pa.array(x, pa.binary()).take(coded.indices) for x in (tokens, path)]
            yield pa.record_batch([part.column("block"), part.column("no"), *columns], names=["block", "no", "tokens", "path"])


class _Block:
    """Documents of a block as segment numbers, and its segments' alignments one after another."""

    def __init__(self, docs: pa.Table, segments: pa.Table):
        numbers, offsets = arrays.flat_bytes(docs.column("numbers"))
        self.numbers, self.starts = numbers.view(np.int32), offsets // 4
        order = pa.array(np.argsort(segments.column("no").to_numpy()))
        path = segments.column("path").take(order)
        self.steps, self.link_starts = arrays.flat_bytes(path)
        fits = path.is_valid().to_numpy()
        #: Documents that have tokens: some segments, all of which fit.
        self.fit = (np.diff(self.starts) > 0) & (_sums(~fits[self.numbers], self.starts) == 0)
        a_ends, b_ends = self.steps & 1, self.steps >> 1
        self.n_a, self.n_b, self.n_groups = (_sums(x, self.link_starts) for x in (a_ends, b_ends, self.steps == 3))
        flat = arrays.flat_bytes(segments.column("tokens").take(order))[0]
        flat = flat.view(np.int32 if len(flat) > 2 * (self.n_a.sum() + self.n_b.sum()) else np.uint16)
        of_a = np.repeat(np.tile([True, False], len(path)), np.stack((self.n_a, self.n_b), 1).ravel())
        self.a, self.b = flat[of_a], flat[~of_a]
        # A step's tokens are those of which as many as before it have ended.
        self.links = self.a[np.cumsum(a_ends, dtype=np.int64) - a_ends].astype(np.int64) << 32 | self.b[np.cumsum(b_ends, dtype=np.int64) - b_ends]

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs, and how many documents hold each."""
        codes, places = np.unique(self.links, return_inverse=True)
        held = np.zeros(len(codes), np.int64)
        for k in np.flatnonzero(self.fit):
            own = np.unique(self.numbers[self.starts[k] : self.starts[k + 1]])
            sizes = self.link_starts[own + 1] - self.link_starts[own]
            shift = self.link_starts[own] - np.concatenate(([0], np.cumsum(sizes[:-1])))
            held[np.unique(places[np.repeat(shift, sizes) + np.arange(sizes.sum())])] += 1
        return codes[held > 0], held[held > 0]

    def groups(self) -> list[bytes]:
        """Groups of each segment as text that ends in a semicolon."""
        bounds = [np.concatenate(([0], np.cumsum(x))) for x in (self.n_a, self.n_b)]
        out = []
        for x in range(0, len(self.n_a), 16_384):  # so many segments at once
            y = min(x + 16_384, len(self.n_a))
            a, b = (ids[at[x] : at[y]].astype(np.int64) for ids, at in zip((self.a, self.b), bounds))
            out += _group_texts(self.steps[self.link_starts[x] : self.link_starts[y]], a, b, (self.n_a + self.n_b)[x:y])
        return out


def _group_texts(steps: np.ndarray, a: np.ndarray, b: np.ndarray, tokens: np.ndarray) -> list[bytes]:
    both = steps == 3
    group = np.cumsum(both) - both
    which = np.concatenate((group[steps & 1 > 0] * 2, group[steps & 2 > 0] * 2 + 1))
    order = np.argsort(which, kind="stable")
    ids, which = np.concatenate((a, b))[order], which[order]
    last = np.append(which[1:] != which[:-1], True)[: len(which)]
    mark = np.where(last, 1 + which % 2, 0)  # a comma within a side, a bar behind A's, a semicolon behind B's
    known, place = np.unique(ids * 3 + mark, return_inverse=True)
    strings = arrays.Strings([b"%d%c" % (x // 3, b",|;"[x % 3]) for x in known.tolist()])
    text = strings.joined(place).tobytes()
    ends = np.concatenate(([0], np.cumsum(strings.sizes[place])))[np.cumsum(tokens)].tolist()
    return [text[x:y] for x, y in zip([0, *ends], ends)]


def _held_pairs(docs: pa.Table, segments: pa.Table) -> pa.Table:
    codes, held = _Block(docs, segments).held()
    block = (docs if docs.num_rows else segments).column("block")[0].as_py()
    return pa.table({"block": np.full(len(codes), block), "link": codes, "held": held})


def _composed(rows: pa.Table, pairs: pa.Table) -> pa.Table:
    """Totals and groups of a block's documents; ``pairs`` has the counts of its pairs."""
    is_doc = pc.is_valid(rows.column("numbers"))
    docs = rows.filter(is_doc)
    own = _Block(docs, rows.filter(pc.invert(is_doc)))
    links = pairs.column("link").to_numpy()
    order = np.argsort(links)
    at = np.searchsorted(links[order], own.links)
    # A pair that no document with tokens holds has no count, and nothing asks for it.
    known = np.append(links[order], -1)[at] == own.links
    count, best = (np.where(known, np.append(pairs.column(c).to_numpy()[order], 0)[at], 0) for c in ("count", "best"))
    groups = own.groups()
    texts = [b"".join(map(groups.__getitem__, own.numbers[own.starts[k] : own.starts[k + 1]].tolist()))[:-1].decode() if ok else "" for k, ok in enumerate(own.fit)]
    values = {"n_a": own.n_a, "n_b": own.n_b, "n_groups": own.n_groups, "n_links": np.diff(own.link_starts)}
    values |= {"n_best": _sums(best, own.link_starts), "count_sum": _sums(count, own.link_starts)}
    sums = {name: np.where(own.fit, _sums(x[own.numbers], own.starts), 0) for name, x in values.items()}
    return pa.table({"doc": docs.column("doc"), **sums, "groups": pa.array(texts, pa.string())})


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """Per row: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups`` as text.

    A link's count: how many rows hold its pair of ids linked. ``n_best``: links whose count is the highest of
    all pairs with their A id; ``count_sum``: the counts of all links.
    """
    shipped(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    shape = f"block long, doc {kind}, numbers binary, no int, segment string"
    blocks = written(map_arrow(rows, partial(_numbered, a=a, b=b), shape), codec="zstd")
    named = blocks.filter("no is not null").select("block", "no", "segment").repartition("segment").sortWithinPartitions("segment")
    back = written(map_arrow(named, partial(_aligned, a=a, b=b), "block long, no int, tokens binary, path binary"), once=True, codec="zstd")
    texts = blocks.filter("numbers is not null").select("block", "doc", "numbers")

    held = written(texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_held_pairs, "block long, link long, held long"), once=True)
    counts = written(held.groupBy("link").agg(F.sum("held").alias("count")))
    top = counts.groupBy(F.shiftright("link", 32).alias("a_id")).agg(F.max("count").alias("top"))
    rated = counts.join(top, F.shiftright("link", 32) == F.col("a_id")).select("link", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))
    pairs = written(held.select("block", "link").join(rated, "link").select("block", "link", "count", "best"), once=True)
    discard(held, counts)

    whole = texts.select("*", F.lit(None).cast("int").alias("no"), F.lit(None).cast("binary").alias("tokens"), F.lit(None).cast("binary").alias("path"))
    whole = whole.unionByName(back.select("*", F.lit(None).cast(kind).alias("doc"), F.lit(None).cast("binary").alias("numbers")))
    composed = whole.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(
        _composed, f"doc {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    )
    return composed.withColumnRenamed("doc", id_col)

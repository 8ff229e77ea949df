"""Lexical retrieval packing: a sharded BM25 index fills each document's window with its neighbours.

1. Every text is tokenized; an end id closes each document. The ids are written once.
2. Document frequencies of the ids, over all documents, give the BM25 weights (a table no larger
   than the vocabulary).
3. A document's signature is its hash-smallest id that is not common. Signatures are laid out in
   order and cut into shards of about ``SHARD_TOKENS`` ids, so that documents which share a rarer
   id meet in one shard; a signature too large for a shard is split by document.
4. A shard builds its inverted index. In order of ids each unused document seeds a window: whole
   windows first, then its rest is joined by the unused neighbours that BM25 ranks highest for
   its terms and that fit, block by block down the ranking; the best one of a block that does not
   fit is cut to close the window, and what is left of it stays unused. Only when no unused
   document of the shard shares a term do the next ones by id follow. The shard's last ids go to
   sequences of powers of two.

Defined results: a null or empty text is the end id alone. A null id is a value like any other.
Repeated rows are packed each for itself. Other columns are ignored, whatever their names. An
empty table gives an empty table.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays
from graphloom.session import map_arrow, written

WINDOW = 4096
END = 2
VOCABULARY = 49_408
SHARD_TOKENS = 3 << 20
#: BM25's constants, and the neighbours in the first block of a ranking; each further block is twice as long.
K1, B = 1.2, 0.75
NEIGHBOURS = 48
#: An id in more than this share of documents is not a signature.
COMMON = 0.05

#: Words whose ids a task remembers, at most; then it forgets all and starts anew.
REMEMBERED = 1_500_000
#: Words that are tokenized at once, and marks that a word may end with.
AT_ONCE, MARKS = 2000, b".,;:!?"
#: Letters and ASCII signs but the apostrophe, with which the tokenizer's own units may begin.
_SIGNED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
_tokenizers: dict = {}
_memories: dict = {}


def _tokenizer(path: str | None):
    """The tokenizer, its model alone for ASCII letters and for others, and which ids end a word."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        if path is None:
            import public_tokenizers

            whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        else:
            whole = Tokenizer.from_file(path)
        model, byte_model = Tokenizer(whole.model), Tokenizer(whole.model)
        model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        byte_model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = whole.model.end_of_word_suffix
        last = np.zeros(VOCABULARY, bool)
        last[[i for piece, i in whole.get_vocab().items() if piece.endswith(suffix)]] = True
        _tokenizers[path] = whole, model, byte_model, last
    return _tokenizers[path]


class Memory:
    """Ids of words met before, in arrays sorted by the words' hashes.

    A word is known by a 64-bit hash, its size and its first eight bytes; texts in which these disagree are
    tokenized as a whole.
    """

    def __init__(self, path: str | None):
        self.whole, self.model, self.byte_model, self.last = _tokenizer(path)
        mark = {m: self.whole.encode(chr(m), add_special_tokens=False).ids for m in MARKS}
        self.mark_id = np.zeros(256, np.uint16)
        for m, ids in mark.items():
            if len(ids) == 1:
                self.mark_id[m] = ids[0]
        self.forget()

    def forget(self) -> None:
        self.keys, self.marks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)
        self.signs: dict[str, np.ndarray] = {}

    def learn(self, keys: np.ndarray, marks: np.ndarray, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        """Remember lower-case words of ``data``.

        Most are letters, perhaps with a mark after them, and the tokenizer would part them there: the letters go
        through its model alone, many at once, and the last id of each is one that ends a word.
        """
        size = ends - begins
        letters = np.concatenate(([0], np.cumsum((data >= 97) & (data <= 122))))
        letters = letters[ends] - letters[begins]
        tail = self.mark_id[data[ends - 1]]
        marked = (letters == size - 1) & (size > 1) & (tail > 0)
        plain = np.flatnonzero((letters == size) | marked)
        other = np.flatnonzero(~((letters == size) | marked))
        # ASCII letters, each followed by a space, as lines.
        n = (size - marked)[plain] + 1
        at = np.repeat(begins[plain] - np.cumsum(n) + n, n) + np.arange(n.sum())
        text = data[np.minimum(at, len(data) - 1)]
        text[np.cumsum(n) - 1] = 32
        text, cuts = text.tobytes().decode(), np.concatenate(([0], np.cumsum(n)))
        cuts = [*cuts[:-1:AT_ONCE].tolist(), int(cuts[-1])] if len(plain) else [0]
        ids, sizes = self._lines(self.model, [text[a:b] for a, b in zip(cuts, cuts[1:])], len(plain))
        with_mark = marked[plain]
        ids = np.insert(ids, np.cumsum(sizes)[with_mark], tail[plain][with_mark])
        sizes = sizes + with_mark
        words = [data[a:b].tobytes().decode() for a, b in zip(begins[other].tolist(), ends[other].tolist())]
        # Letters of any script, perhaps with signs after them, which are a unit of their own.
        parted = [(w, "") if w.isalpha() else m.groups() if (m := _SIGNED.fullmatch(w)) and m[1].isalpha() else None for w in words]
        alpha = np.array([x is not None for x in parted], bool)
        known = [x[0] for x in parted if x]
        more, more_sizes = self._lines(self.byte_model, [" ".join(known[a : a + AT_ONCE]) for a in range(0, len(known), AT_ONCE)], len(known))
        signs = [self._signs(x[1]) for x in parted if x]
        extra = np.array([len(x) for x in signs], np.int64)
        more = np.insert(more, np.repeat(np.cumsum(more_sizes), extra), np.concatenate([np.zeros(0, np.uint16), *signs]))
        more_sizes = more_sizes + extra
        rest = [e.ids for e in self.whole.encode_batch_fast([w for w, x in zip(words, parted) if x is None], add_special_tokens=False)]
        all_sizes = np.concatenate((sizes, more_sizes, np.array([len(x) for x in rest], np.int64)))
        starts = len(self.pool) + np.cumsum(all_sizes) - all_sizes
        self.pool = np.concatenate((self.pool, ids, more, np.array([i for x in rest for i in x], np.uint16)))
        order = np.concatenate((plain, other[alpha], other[~alpha])) if len(other) else plain
        keys, marks = keys[order], marks[order]
        order = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[order])
        self.keys, self.marks, self.starts, self.sizes = (np.insert(x, place, y[order]) for x, y in ((self.keys, keys), (self.marks, marks), (self.starts, starts), (self.sizes, all_sizes)))

    def _signs(self, signs: str) -> np.ndarray:
        if signs not in self.signs:
            self.signs[signs] = np.array(self.whole.encode(signs, add_special_tokens=False).ids if signs else [], np.uint16)
        return self.signs[signs]

    def _lines(self, tokenizer, lines: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``n`` words on lines, and how many each has."""
        found = [np.array(e.ids, np.uint16) for e in tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint16), *found])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != n:
            raise ValueError("the tokenizer's words must end with pieces that carry its end-of-word suffix")
        return ids, np.diff(np.concatenate(([0], ends)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, an end id after each, and where each text's begin (with the total)."""
        simple = [_simple(t) for t in texts]
        low = [t.lower().encode() if ok else b"" for t, ok in zip(texts, simple)]
        data = np.frombuffer(b"".join(low), np.uint8)
        begins, ends, firsts = arrays.word_bounds(data, np.concatenate(([0], np.cumsum([len(x) for x in low]))))
        keys = arrays.word_hashes(data, begins, ends)
        marks = (ends - begins).astype(np.uint64)
        for k in range(8):
            marks = marks * np.uint64(257) + np.where(begins + k < ends, data[np.minimum(begins + k, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint64)
        own, first, which = np.unique(keys, return_index=True, return_inverse=True)
        missing = ~np.isin(own, self.keys, assume_unique=True)
        if len(self.keys) + missing.sum() > REMEMBERED:
            self.forget()
            missing[:] = True
        if missing.any():
            new = first[missing]
            self.learn(own[missing], marks[new], data, begins[new], ends[new])
        at = np.searchsorted(self.keys, own)[which]
        clash = np.flatnonzero(self.marks[at] != marks) if len(at) else at
        sizes = np.insert(self.sizes[at] if len(at) else np.zeros(0, np.int64), firsts[1:], 1)
        end = len(self.pool)
        starts = np.insert(self.starts[at] if len(at) else np.zeros(0, np.int64), firsts[1:], end)
        ids = np.append(self.pool, np.uint16(END))[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        bounds = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], firsts[1:] + np.arange(1, len(texts) + 1)))]
        odd = {*(np.searchsorted(firsts, clash, "right") - 1).tolist(), *(i for i, ok in enumerate(simple) if not ok)}
        if odd:
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            for i in odd:
                parts[i] = np.array([*self.whole.encode(texts[i], add_special_tokens=False).ids, END], np.uint16)
            ids, bounds = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return ids, bounds


def _simple(text: str) -> bool:
    """Whether the text's words can go to the tokenizer one by one and in lower case.

    It normalises to NFC, lowers each character by itself, and keeps four control characters at which
    ``str.split`` parts.
    """
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return False
    return text.isascii() or not ("\u0130" in text or "\u03a3" in text) and unicodedata.is_normalized("NFC", text)


def _memory(path: str | None) -> Memory:
    if path not in _memories:
        _memories[path] = Memory(path)
    return _memories[path]


def _tokenized(batches, path):
    memory = _memory(path)
    for batch in arrays.blocks(batches, "text"):
        ids, bounds = memory.encode(batch.column("text").fill_null("").to_pylist())
        blob = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((bounds * 2).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
        yield pa.record_batch([batch.column("doc"), blob, pa.array(np.diff(bounds))], names=["doc", "ids", "n"])


def _of(column):
    for x in column:
        yield np.frombuffer(x.as_buffer(), np.uint16)


def _frequencies(batches):
    total = np.zeros(VOCABULARY, np.int64)
    for batch in batches:
        for ids in _of(batch.column("ids")):
            total[np.unique(ids)] += 1
    seen = np.flatnonzero(total)
    yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "df"])


def _hash_order() -> np.ndarray:
    return arrays.mixed(np.arange(VOCABULARY, dtype=np.uint64)).argsort().argsort()


def _signed(batches, common: np.ndarray):
    rank = np.where(common, VOCABULARY, _hash_order())
    for batch in batches:
        out = [int(rank[ids].min()) for ids in _of(batch.column("ids"))]
        yield pa.record_batch([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "sig"])


def _powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; documents are indices of ``docs``."""
    sizes = np.array([len(d) for d in docs])
    terms, counts = zip(*(np.unique(d[d != END], return_counts=True) for d in docs))  # the end id is no term
    first = np.concatenate(([0], np.cumsum([len(t) for t in terms])))
    owner = np.repeat(np.arange(len(docs)), np.diff(first))
    norm = K1 * (1 - B + B * sizes / mean)
    flat, tf = np.concatenate(terms).astype(np.int64), np.concatenate(counts).astype(np.float32)
    weight = idf[flat] * tf * (K1 + 1) / (tf + norm[owner])
    order = np.argsort(flat, kind="stable")
    posted, posted_weight = owner[order], weight[order]
    begins = np.searchsorted(flat[order], np.arange(VOCABULARY + 1))
    indexed = len(docs)
    left = sizes.copy()
    out, sequence, at, rest = [], 0, 0, int(sizes.sum())

    def put(d: int, room: int) -> None:
        """What is left of a document, as far as there is room."""
        nonlocal at, rest
        length = min(int(left[d]), room)
        out.append((d, int(sizes[d] - left[d]), length, sequence, at))
        left[d] -= length
        at += length
        rest -= length

    def neighbours(d: int):
        """Blocks of the unused documents that share a term with ``d``, best first, smaller index on ties."""
        nonlocal posted, posted_weight, begins, indexed
        unused = left > 0
        if unused.sum() * 2 < indexed:  # used documents leave the index
            keep, indexed = unused[posted], int(unused.sum())
            begins = np.concatenate(([0], np.cumsum(keep)))[begins]
            posted, posted_weight = posted[keep], posted_weight[keep]
        mine = slice(first[d], first[d + 1])
        begin, size = begins[flat[mine]], np.diff(begins)[flat[mine]]
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        score = np.bincount(posted[at], np.repeat(weight[mine], size) * posted_weight[at], len(docs))
        score[left == 0] = 0
        score[d] = 0
        near, size = np.flatnonzero(score), NEIGHBOURS
        while len(near):
            mark = np.partition(score[near], -size)[-size] if len(near) > size else 0
            best, near = near[score[near] >= mark], near[score[near] < mark]
            yield best[np.lexsort((best, -score[best]))]
            size *= 2

    for seed in range(len(docs)):
        while left[seed] and rest >= window:
            blocks = neighbours(seed) if left[seed] < window else ()
            put(seed, window)
            for near in blocks:
                cut = None
                for d in near:
                    if left[d] <= window - at:
                        put(int(d), window)
                    elif cut is None:
                        cut = int(d)
                    if at == window:
                        break
                if at < window and cut is not None:
                    put(cut, window - at)
                if at == window:
                    break
            after = seed + 1
            while at < window:  # no unused document shares a term: the next ones by id
                if left[after]:
                    put(after, window - at)
                after += 1
            sequence, at = sequence + 1, 0
    # Less than a window is left: sequences of powers of two, which need no padding.
    d = 0
    for size in _powers(rest):
        while at < size:
            if left[d]:
                put(d, size - at)
            d += not left[d]
        sequence, at = sequence + 1, 0
    return out


PIECES = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _packed(batches, idf, mean, window):
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not len(table):
        return
    table = table.sort_by([("doc", "ascending"), ("ids", "ascending")]).combine_chunks()
    shard = table.column("shard")[0].as_py()
    docs = list(_of(table.column("ids")))
    pieces = pack_shard(docs, idf, mean, window)
    for a in range(0, len(pieces), 4096):
        part = pieces[a : a + 4096]
        doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*part))
        ids = [docs[d][s : s + n].astype("<u4").tobytes() for d, s, n, *_ in part]
        tokens = np.array([len(docs[d]) for d in doc], np.int64)
        columns = [start, length, tokens, (shard << 32) + sequence, offset]
        yield pa.record_batch([table.column("doc").take(pa.array(doc)).combine_chunks(), *map(pa.array, columns), pa.array(ids, pa.binary())], names=["doc", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces: id, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` and ``ids``.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit values. ``tokenizer`` is the path of
    a tokenizer file (None: the public word BPE of 49,408 ids; another one must be of its kind, with a suffix at word ends).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    ids = written(map_arrow(rows, partial(_tokenized, path=tokenizer), f"doc {kind}, ids binary, n long"))
    frequency = map_arrow(ids.select("ids"), _frequencies, "id int, df long").groupBy("id").agg(F.sum("df").alias("df")).collect()
    count, tokens = ids.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(VOCABULARY, np.int64)
    for r in frequency:
        df[r.id] = r.df
    idf = np.log1p((count - df + 0.5) / (df + 0.5)).astype(np.float32)
    signed = map_arrow(ids, partial(_signed, common=df > COMMON * max(count, 1)), f"doc {kind}, ids binary, n long, sig int")
    # Signatures in order, cut to shards; both tables have a row for each id of the vocabulary at most.
    per = sorted((r.sig, r.n) for r in signed.groupBy("sig").agg(F.sum("n").alias("n")).collect())
    begin, places = 0, {}
    for sig, n in per:
        places[sig] = (begin // shard_tokens, (begin + n - 1) // shard_tokens - begin // shard_tokens + 1)
        begin += n
    shards = max(1, -(-begin // shard_tokens))
    layout = docs.sparkSession.createDataFrame([(s, a, n) for s, (a, n) in places.items()], "sig int, first int, spread int")
    spread = F.col("first") + F.pmod(F.xxhash64("doc", "ids"), F.col("spread")).cast("int")
    placed = signed.join(F.broadcast(layout), "sig").select("doc", "ids", spread.alias("shard"))
    sharded = placed.repartitionById(shards, F.col("shard"))
    out = map_arrow(sharded, partial(_packed, idf=idf, mean=tokens / max(count, 1) if tokens else 1.0, window=window), f"doc {kind}, {PIECES}")
    return out.withColumnRenamed("doc", id_col)

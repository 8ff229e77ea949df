"""SentencePiece encoding and decoding by a streaming Viterbi search.

A byte-pair model has no score for a whole segmentation, so the trellis decides by feasibility:
a piece may follow another if merging the two pieces' characters by the model gives just these
two. A segmentation whose neighbours all may follow each other is the model's own one, and each
prefix has exactly one, so every place of the trellis keeps one back pointer. Only the places
within the longest piece of the end can still be pointed at; they are the window. When the paths
of all of them meet in one boundary, the ids before it are committed and forgotten.

No piece holds a space after another character, so paths always meet where a word begins. A word
longer than the window is streamed. One that lies within it is a window of its own: its ids are
committed at its end and answered from a bounded memory when it is met again, and the new ones of
a block are taken in order, so that each goes on from the places that it shares with the one before.

Whether two pieces may follow each other is told from how each is merged: along the end of the
first and the beginning of the second, no merge across may ever be better than the next of either.

Defined results: a null or empty text has no ids. A character that is no piece becomes its UTF-8
bytes. Decoding gives the text back but for the character U+2581, which stands for a space.
Repeated rows get equal ids. Other columns are ignored, whatever their names. An empty table
gives an empty table.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays
from graphloom.session import map_arrow

SPACE = "▁"
#: Words and pairs of pieces that a task remembers, at most; then it forgets all and starts anew.
REMEMBERED = 500_000

_UNIT = re.compile(f"{SPACE}*[^{SPACE}]*")


class Pieces:
    """Vocabulary of a model file (None: the public one of 32,000 pieces)."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        self.texts = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        byte = {i: int(p[3:5], 16) for i, p in enumerate(self.texts) if model.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.texts) if i not in byte and not special(i)}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.own = {p: p for p in self.ids}  # one object for each piece
        self.byte_ids = {b: i for i, b in byte.items()}
        self.bytes = [bytes([byte[i]]) if i in byte else b"" if special(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.texts)]
        self.longest = max(map(len, self.ids))
        #: Sizes of the pieces that end with two characters, the longest first.
        self.sizes: dict[str, list[int]] = {}
        for p in self.ids:
            if len(p) > 1:
                self.sizes.setdefault(p[-2:], []).append(len(p))
        self.sizes = {tail: sorted({*sizes}, reverse=True) for tail, sizes in self.sizes.items()}
        self.packed = {p: array("H", [i]).tobytes() for p, i in self.ids.items()}
        self.follows: dict[tuple[str, str], bool] = {}
        self.parted: dict[str, list[str]] = {}
        self.sides: dict[tuple[str, bool], list[tuple[str, float]]] = {}
        self.uneven: set[str] = set()
        self.words: dict[str, bytes] = {}

    def merged(self, text: str, down_to: int = 1) -> list[str]:
        """Merge the best-scored neighbours, leftmost first, until none is left or there are ``down_to`` parts."""
        parts = list(text)
        while len(parts) > down_to:
            best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, piece: str) -> list[str]:
        """The two parts that a piece of several characters is merged from last; none if its characters merge otherwise.

        Scores fall from the parts to the whole as a rule; ``uneven`` has the pieces in which they somewhere do not.
        """
        known = self.parted.get(piece)
        if known is None:
            known = self.merged(piece, 2)
            if len(known) > 2 or any(len(x) > 1 and not self.halves(x) for x in known):
                known = []
            if any(len(x) > 1 and (x in self.uneven or self.scores[x] <= self.scores[piece]) for x in known):
                self.uneven.add(piece)
            self.parted[piece] = known
        return known

    def side(self, piece: str, last: bool) -> list[tuple[str, float]]:
        """What stands at a piece's end (or its beginning) as it is merged, each with the score of the merge that takes it up."""
        known = self.sides.get((piece, last))
        if known is None:
            known, part, above = [], piece, -np.inf
            while len(part) > 1 and (parts := self.halves(part)):
                known.append((part, above))
                part, above = parts[-last], self.scores[part]
            known = [*known, (part, above)][::-1] if len(part) == 1 else []
            self.sides[piece, last] = known
        return known

    def may_follow(self, a: str, b: str) -> bool:
        """Whether ``b`` may stand after ``a``, or at the beginning if ``a`` is empty."""
        known = self.follows.get((a, b))
        if known is None:
            if len(self.follows) > REMEMBERED:
                self.follows.clear()
            known = self.follows[a, b] = self._stay_apart(a, b) if a else self.merged(b) == [b]
        return known

    def _stay_apart(self, a: str, b: str) -> bool:
        """Whether the characters of both merge to just these two.

        Both grow towards their whole, the better merge first, the left one on equal scores; a merge across
        must never be better than the next of either.
        """
        ends, begins = self.side(a, True), self.side(b, False)
        if a in self.uneven or b in self.uneven:
            return self.merged(a + b) == [a, b]
        if not ends or not begins:
            return False
        i = j = 0
        while True:
            (x, up), (y, other) = ends[i], begins[j]
            across = self.scores.get(x + y)
            if across is not None and across > up and across >= other:
                return False
            if up == other == -np.inf:
                return True
            if up >= other:
                i += 1
            else:
                j += 1

    def last_piece(self, text: str, end: int, before, least: int) -> str:
        """The one piece that can end the text's first ``end`` characters.

        ``before(begin)`` is the piece that ends at ``begin``; places before ``least`` are out of reach.
        """
        own, known = self.own, self.follows
        for size in self.sizes.get(text[end - 2 : end], ()):
            begin = end - size
            if begin >= least and (piece := own.get(text[begin:end])):
                ok = known.get((a := before(begin), piece))
                if ok or ok is None and self.may_follow(a, piece):
                    return piece
        return text[end - 1]  # a prefix has one segmentation, so nothing else is left

    def segments(self, text: str):
        """Pieces (or single characters that are none) of ``text``, as soon as they are certain."""
        # The window: [end, piece that ends there, place before it] of the last places.
        committed = [0, "", None]
        window = deque([committed], maxlen=self.longest + 1)
        for end in range(1, len(text) + 1):
            first = window[0][0]
            piece = self.last_piece(text, end, lambda begin: window[begin - first][1], max(first, committed[0]))
            window.append([end, piece, window[end - len(piece) - first]])
            if not end % self.longest:  # all paths that end in the window step back until they meet
                live = {place[0]: place for place in window if place[0] > end - self.longest and place[0] >= committed[0]}
                while len(live) > 1:
                    place = live.pop(max(live))[2]
                    live[place[0]] = place
                (meet,) = live.values()
                yield from self._path(meet, committed)
                committed, meet[2] = meet, None  # what lies before is forgotten
        yield from self._path(window[-1], committed)

    @staticmethod
    def _path(place, until) -> list[str]:
        out = []
        while place[0] > until[0]:
            out.append(place[1])
            place = place[2]
        return out[::-1]

    def ids_of(self, piece: str) -> bytes:
        """Unsigned 16-bit ids of a piece, or of the bytes of a character that is none."""
        known = self.packed.get(piece)
        return known if known is not None else array("H", [self.byte_ids[b] for b in piece.encode()]).tobytes()

    def learn(self, words) -> None:
        """Ids of new words: those within the window in order, going on from shared beginnings, longer ones streamed."""
        before, last, done = "", [""], [b""]
        for word in sorted(words):
            if len(word) > self.longest:
                self.words[word] = b"".join(map(self.ids_of, self.segments(word)))
                continue
            same = 0
            while same < len(before) and same < len(word) and before[same] == word[same]:
                same += 1
            del last[same + 1 :], done[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                piece = self.last_piece(word, end, last.__getitem__, 0)
                last.append(piece)
                done.append(done[end - len(piece)] + self.ids_of(piece))
            before = word
            self.words[word] = done[-1]

    def encode(self, texts: list[str]) -> list[bytes]:
        units = [_UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        known, every = self.words, set().union(*units)
        missing = every - known.keys()
        if len(known) + len(missing) > REMEMBERED:
            known.clear()
            missing = every
        self.learn(missing)
        out = [b"".join(map(known.__getitem__, u)) for u in units]
        for word in missing:
            if len(word) > self.longest:
                del known[word]
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode(errors="replace")[1:]


_loaded: dict[str | None, Pieces] = {}


def _pieces(path: str | None) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _encoded(batches, path):
    pieces = _pieces(path)
    for batch in arrays.blocks(batches, "text"):
        ids = pieces.encode(batch.column("text").fill_null("").to_pylist())
        yield pa.record_batch([batch.column("doc"), batch.column("text"), pa.array(ids, pa.binary())], names=["doc", "text", "ids"])


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Per row: id, text and ``ids`` (unsigned 16-bit little-endian values)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = map_arrow(rows, partial(_encoded, path=model), f"doc {kind}, text string, ids binary")
    return out.select(F.col("doc").alias(id_col), F.col("text").alias(text_col), "ids")


def _decoded(batches, path):
    pieces = _pieces(path)
    for batch in batches:
        texts = [pieces.decode(np.frombuffer(x.as_buffer(), np.uint16).tolist()) for x in batch.column("ids")]
        yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])


def decoded(ids: DataFrame, model: str | None = None) -> DataFrame:
    """``ids`` (rows with a column of that name, not null) with the column ``decoded``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ids.schema.fields)
    return map_arrow(ids, partial(_decoded, path=model), f"{schema}, decoded string")

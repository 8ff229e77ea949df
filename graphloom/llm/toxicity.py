"""Toxicity by compression distance: windows under a toxic and under an ordinary zstandard dictionary.

Fitting takes a bounded sample of labelled rows, one half for the dictionaries and one for the
calibration. The ordinary dictionary is trained on all windows of ordinary texts. The toxic one is
trained on passages of toxic texts: a toxic text is ordinary but for a few words, so the passages
are those around strings of ``GRAM`` bytes that significantly more toxic texts than ordinary ones
have (signed root of the likelihood ratio above ``SIGNIFICANT``; no share is asked for, so a rarer
word counts once the sample shows it often enough). The toxic dictionary is laid before the
ordinary one, so that ordinary words cost the same with both. A window that compresses better by
``d`` bytes with the toxic dictionary speaks for toxicity; a text is judged by its largest ``d``,
its second largest and its number of windows, and a logistic curve fitted to the calibration half
turns these into a score, calibrated so that 0.5 is the threshold.

Defined results: a null or empty text is one empty window. With no toxic or no ordinary row to
learn from every score is the share of toxic rows (0 without any). Rows of the labels without a
value are not learned from. Repeated rows get equal scores. Other columns are ignored,
whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays
from graphloom.session import map_arrow

#: Rows of each label that are learned from, at most (about).
SAMPLE_ROWS = 1500
WINDOW, STRIDE = 40, 24
LEVEL = 7
#: Bytes of a telling string, the log ratio of shares and the significance that make it telling.
GRAM, RATIO, SIGNIFICANT = 6, 1.0, 5.0
#: Two texts of the sample are near copies if so many of their ``SKETCH`` smallest string hashes agree.
SKETCH, SAME = 24, 12
ORDINARY_BYTES, TOXIC_BYTES = 8000, 1500
#: Bytes of the segments that make up a trained toxic dictionary, and of the strings it counts.
SEGMENT, COUNTED = 24, 6


def windows(text: bytes) -> list[bytes]:
    """Overlapping windows of a text's lower-cased bytes."""
    text = text.lower()
    return [text[i : i + WINDOW] for i in range(0, max(1, len(text) - (WINDOW - STRIDE)), STRIDE)]


def _grams(text: bytes) -> np.ndarray:
    a = np.frombuffer(text.lower(), np.uint8).astype(np.uint64)
    h = np.zeros(max(0, len(a) - GRAM + 1), np.uint64)
    for i in range(GRAM if len(h) else 0):
        h = h << np.uint64(8) | a[i : len(a) - GRAM + 1 + i]
    return h


def _shares(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(_grams(t)) for t in texts)]), return_counts=True)


def _compressor(content: bytes):
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=dictionary, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def _trained(size: int, samples: list[bytes], **parameters) -> bytes:
    """A trained dictionary's content; the samples' end if they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **parameters).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def _apart(texts: list[bytes]) -> list[bytes]:
    """The sample without near copies of an earlier text, as a group of copies would make its own strings telling."""
    seen: dict[int, int] = {}
    out = []
    for t in texts:
        sketch = np.sort(arrays.mixed(np.unique(_grams(t))))[:SKETCH].tolist()
        met = Counter(seen[h] for h in sketch if h in seen)
        if not met or met.most_common(1)[0][1] < SAME:
            seen.update((h, len(out)) for h in sketch)
            out.append(t)
    return out


def telling_passages(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Every passage of the toxic texts that consists of telling strings, with a byte on either side."""
    grams, seen = _shares(toxic)
    others, n_ordinary = _shares(ordinary)
    at = np.minimum(np.searchsorted(others, grams), max(0, len(others) - 1))
    base = np.where(others[at] == grams, n_ordinary[at], 0) if len(others) else np.zeros(len(grams))
    share = len(toxic) / (len(toxic) + len(ordinary))
    both = seen + base
    fit = seen * np.log(seen / (both * share)) + np.where(base > 0, base * np.log(np.maximum(base, 1) / (both * (1 - share))), 0)
    ratio = np.log((seen + 0.5) / len(toxic)) - np.log((base + 0.5) / len(ordinary))
    telling = grams[(ratio > RATIO) & (2 * fit > SIGNIFICANT**2)]
    found = []
    for t in toxic:
        edge = np.flatnonzero(np.diff(np.concatenate(([0], np.isin(_grams(t), telling), [0]))))
        low = t.lower()
        found += [low[max(0, a - 1) : b + GRAM] for a, b in zip(edge[::2], edge[1::2])]
    return found


class Scorer:
    """``content`` of the two dictionaries and the weights of the logistic curve."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray):
        self.ordinary, self.toxic = _compressor(ordinary), _compressor(toxic)
        self.weights = weights

    def measures(self, text: bytes) -> tuple[float, float, float, float]:
        a, b = self.ordinary.compress, self.toxic.compress
        d = [len(a(w)) - len(b(w)) for w in windows(text)]
        best = max(d)
        d.remove(best)
        return 1.0, float(best), float(max(d, default=0)), float(np.log1p(len(d)))

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.dot(self.weights, self.measures(text)))))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton's method, a little drawn to 0."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
    return w


def fitted(rows: list[tuple[bytes, int]]) -> tuple[bytes, bytes, np.ndarray]:
    """Dictionary contents and weights from (text, label) rows; even rows make the dictionaries, odd ones the curve."""
    toxic, ordinary = (_apart([t for t, y in rows if y == k]) for k in (1, 0))
    share = len(toxic) / len(rows) if rows else 0.0
    if len(toxic) < 2 or len(ordinary) < 2:
        return b" ", b" ", np.array([np.log((share + 1e-9) / (1 - share + 1e-9)), 0, 0, 0])
    common = _trained(ORDINARY_BYTES, [w for t in ordinary[::2] for w in windows(t)])
    passages = telling_passages(toxic[::2], ordinary[::2])
    content = _trained(TOXIC_BYTES, passages, k=SEGMENT, d=COUNTED, f=20, accel=1) + b" " + common
    scorer = Scorer(common, content, np.zeros(4))
    kept = [*toxic[1::2], *ordinary[1::2]]
    x = np.array([scorer.measures(t) for t in kept])
    y = np.concatenate((np.ones(len(toxic[1::2])), np.zeros(len(ordinary[1::2]))))
    return common, content, _logistic(x, y)


_scorers: dict = {}


def _scored(batches, model, name):
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(*model)
    scorer = _scorers[name]
    for batch in arrays.blocks(batches, "text"):
        scores = [scorer.score(t.as_buffer().to_pybytes()) for t in batch.column("text")]
        yield pa.record_batch([batch.column("doc"), pa.array(scores)], names=["doc", "score"])


def toxicity(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of ``docs``: id, ``score``, ``predicted``.

    ``labelled`` has ``id_col`` and ``label_col`` (1 toxic, 0 not): about ``sample_rows`` ids of each label are
    picked by a hash of the id and broadcast, and their texts are brought to the driver; nothing else is.
    """
    rows = labelled.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{label_col}`").alias("label")).filter("label in (0, 1)")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, F.lit(sample_rows / max(1, sizes.get(1, 1)))).otherwise(F.lit(sample_rows / max(1, sizes.get(0, 1))))
    picked = F.xxhash64("doc", F.lit(5))
    ids = rows.filter(F.pmod(picked, F.lit(1_000_000)) < share * 1_000_000).select("doc", "label", picked.alias("h"))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    some = texts.join(F.broadcast(ids), "doc").select("text", "label", "h").collect()
    model = fitted([(r.text.encode(), int(r.label)) for r in sorted(some, key=lambda r: (r.h, r.text))])
    kind = docs.schema[id_col].dataType.simpleString()
    all_rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    out = map_arrow(all_rows, partial(_scored, model=model, name=uuid.uuid4().hex), f"doc {kind}, score double")
    return out.select(F.col("doc").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

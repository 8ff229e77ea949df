"""Language identification by prediction by partial matching over bytes.

For each language a tree of byte contexts up to ``ORDER`` bytes counts what follows. A byte seen
after a context costs -log2(c / (n + d)) bits (c times of n, d different bytes); one not seen costs
the escape -log2(d / (n + d)) and is looked up after the context without its first byte, at last
with one of 256. Counts are frozen after training, so a byte's cost depends on the ``ORDER`` bytes
before it alone: a block of texts asks each language's tree once for each of its distinct strings of
``ORDER`` + 1 bytes, and a text's code length in a language is the sum of its bytes' costs. The
shortest code names the language.

Training reads whole texts of about ``SAMPLE_ROWS`` labelled rows for each language (all rows if
fewer), picked by a hash of the id.

Defined results: a null text or one without a letter is ``und`` with score 0, as is any text if
no row has a language. Ties go to the first language in order. Repeated rows get equal results.
Other columns are ignored, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays
from graphloom.session import map_arrow

ORDER = 3
SAMPLE_ROWS = 1500
#: What stands before a text's first byte.
BEFORE = 10
#: Bits of difference that make a language half as likely (neighbouring bytes are not independent).
SOFTNESS = 8.0


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with ``ORDER`` leading ones before each text, and the places of the texts' own bytes."""
    n = len(offsets) - 1
    place = np.arange(len(data)) + ORDER * (1 + np.repeat(np.arange(n), np.diff(offsets)))
    out = np.full(len(data) + ORDER * n, BEFORE, np.uint8)
    out[place] = data
    return out, place


def _gram_counts(batches):
    for batch in arrays.blocks(batches, "text"):
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            data, place = _padded(*arrays.text_bytes(batch.column("text").slice(i, 1)))
            if not len(place):
                continue
            key = np.zeros(len(place), np.int64)
            for k in range(ORDER + 1):
                key = key << 8 | data[place - ORDER + k]
            grams, counts = np.unique(key, return_counts=True)
            yield pa.record_batch([pa.array([lang] * len(grams), pa.int32()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])


class Tree:
    """One language's contexts: for each order the strings seen, sorted, with their costs, and the contexts with their escapes.

    ``gram`` are strings of ``ORDER`` + 1 bytes as numbers; a tree is as large as the strings that were seen.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.levels = []
        for order in range(ORDER + 1):
            seen, which = np.unique(gram & (256 ** (order + 1) - 1), return_inverse=True)
            count = np.bincount(which, n, len(seen))
            contexts, of = np.unique(seen >> 8, return_inverse=True)
            total, different = np.bincount(of, count, len(contexts)), np.bincount(of, minlength=len(contexts))
            space = np.log2(total + different)
            self.levels.append((seen, space[of] - np.log2(count), contexts, space - np.log2(different)))

    def costs(self, asked: list[np.ndarray], shorter: list[np.ndarray]) -> np.ndarray:
        """Bits of the last byte of each of ``asked[ORDER]``.

        ``asked[k]``: distinct strings of k + 1 bytes; ``shorter[k]``: where each is without its first byte in the order below.
        """
        bits = np.full(1, 8.0)
        for (seen, cost, contexts, escape), strings, less in zip(self.levels, asked, shorter):
            bits = _looked_up(seen, cost, strings, _looked_up(contexts, escape, strings >> 8, 0.0) + bits[less])
        return bits


def _looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, missing) -> np.ndarray:
    """The value of each asked key, or what ``missing`` says."""
    if not len(keys):
        return np.broadcast_to(missing, asked.shape)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], missing)


class Model:
    """The trees of all languages, from (language, gram, count) rows."""

    def __init__(self, names: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.names = names
        self.trees = [Tree(gram[lang == k], n[lang == k]) for k in range(len(names))]

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(offsets) - 1, len(self.names)))
        full = np.flatnonzero(np.diff(offsets))
        if not len(full):
            return out
        padded, place = _padded(data, offsets)
        key = np.zeros(len(place), np.uint32)
        for k in range(ORDER + 1):
            key = key << np.uint32(8) | padded[place - ORDER + k]
        strings, which = np.unique(key, return_inverse=True)
        asked, shorter = [strings.astype(np.int64)], []
        for order in range(ORDER, 0, -1):
            below, at = np.unique(asked[0] & (256**order - 1), return_inverse=True)
            asked, shorter = [below, *asked], [at, *shorter]
        shorter = [np.zeros(len(asked[0]), np.int64), *shorter]
        for k, tree in enumerate(self.trees):  # one language at a time, so that memory follows the block alone
            out[full, k] = np.add.reduceat(tree.costs(asked, shorter)[which], offsets[:-1][full])
        return out


_models: dict = {}


def _named(batches, counts, name):
    if name not in _models:  # built once in each Python process
        _models.clear()
        _models[name] = Model(*counts.value)
    model = _models[name]
    for batch in arrays.blocks(batches, "text"):
        bits = model.bits(*arrays.text_bytes(batch.column("text")))
        letters = np.array(batch.column("letters").to_pylist(), bool)
        if model.names:
            best = bits.argmin(1)
            score = 1 / np.exp2((bits.min(1)[:, None] - bits) / SOFTNESS).sum(1)
            names = [model.names[b] if ok else "und" for b, ok in zip(best, letters)]
            score = np.where(letters, score, 0.0)
        else:
            names, score = ["und"] * len(letters), np.zeros(len(letters))
        yield pa.record_batch([batch.column("doc"), pa.array(names, pa.string()), pa.array(score)], names=["doc", "lang_pred", "score"])


def trained(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int = SAMPLE_ROWS) -> tuple:
    """(names, language, gram, count) of a sample of the rows of ``labelled`` that have a language."""
    rows = labelled.select(F.col(f"`{id_col}`").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.col(f"`{lang_col}`").alias("name")).filter("name is not null")
    sizes = {r["name"]: r["count"] for r in rows.groupBy("name").count().collect()}
    names = sorted(sizes)
    if not names:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    share, index = F.lit(None), F.lit(None)
    for i, x in enumerate(names):
        share = F.when(F.col("name") == x, F.lit(sample_rows / sizes[x])).otherwise(share)
        index = F.when(F.col("name") == x, F.lit(i)).otherwise(index)
    some = rows.filter(F.pmod(F.xxhash64("doc", F.lit(3)), F.lit(1_000_000)) < share * 1_000_000)
    grams = map_arrow(some.select(index.cast("int").alias("lang"), "text"), _gram_counts, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    return names, *(grams.column(c).to_numpy().astype(np.int64) for c in ("lang", "gram", "n"))


def languages(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, ``lang_pred``, ``score``. Only rows for which ``learn`` holds are learned from."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(trained(docs.filter(learn), id_col, text_col, lang_col))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), text.alias("text"), text.rlike(r"\p{L}").alias("letters"))
    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(rows, partial(_named, counts=counts, name=uuid.uuid4().hex), f"doc {kind}, lang_pred string, score double").withColumnRenamed("doc", id_col)

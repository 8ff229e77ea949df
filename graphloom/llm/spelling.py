"""Spelling variants: words one edit apart, found by merging subtrees of a trie.

The trie is a table of prefixes. Heavy-path decomposition marks at each node the child with the most
words below (the smallest character on ties); every other child is light, and a word has at most
log2(words) light edges on its way. Only words below light edges move, small to large:

* one character replaced: below a node, the light words with one remainder after the edge coincide
  with each other and with the word that takes the heavy edge instead;
* one character skipped: a light word without its edge's character coincides with a word of the
  node; a light word with the heavy character put before its edge, with one below the heavy child;
  and a word that ends at a node, with the one that its heavy edge continues.

A skip within a run of one character counts at the run's last place, so each pair of words meets
exactly once. Terminals that coincide send each other their number and their best one only: a
place of the trie has no more children than the alphabet has characters.

Defined results: a word is a maximal run of letters, A-Z in lower case; rarer or shorter ones than
asked for are left out. Null or empty texts have no words. Repeated rows count again; null ids are
empty. Ties go to the smallest word in code-point order. Other columns are ignored, whatever their
names. An empty table gives an empty table.
"""

from __future__ import annotations

from itertools import count
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import discard, written

LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
#: Nodes of up to this depth are few (the alphabet to that power) and broadcast: all words pass them.
TOP = 2


def lower(run: Column) -> Column:
    """Only A-Z in lower case."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, ascii_uppercase, ascii_lowercase))


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, times: int = 3, dropped: int = 97) -> DataFrame:
    """(``word``, ``n``): words of at least ``least`` code points and ``times`` occurrences.

    Where ``dropped`` divides the crc32 of ``<id>:<word>``, one character of the occurrence is left out.
    """
    ids = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    runs = docs.select(ids.alias("doc"), F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(LETTERS), F.lit(0))).alias("run"))
    hashed = runs.select(lower(F.col("run")).alias("run"), "doc").select("run", F.crc32(F.concat_ws(":", "doc", "run")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    found = hashed.select(F.when(F.col("h") % dropped == 0, without).otherwise(F.col("run")).alias("word"))
    return found.filter(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= times)


def heavy_children(vocabulary: DataFrame) -> DataFrame:
    """(``node``, ``heavy``): for each prefix that goes on, its child with the most words."""
    child = _places(vocabulary).groupBy("node", "c").agg(F.count("*").alias("below"))
    return child.groupBy("node").agg(F.min_by("c", F.struct(-F.col("below"), "c")).alias("heavy"))


def _places(vocabulary: DataFrame) -> DataFrame:
    """Every word at every node on its way: the prefix, the next character and the remainder."""
    at = vocabulary.select("word", "n", F.explode(F.sequence(F.lit(0), F.char_length("word") - 1)).alias("i"))
    return at.select("word", "n", "i", F.substring("word", F.lit(1), F.col("i")).alias("node"), F.substring("word", F.col("i") + 1, F.lit(1)).alias("c"), F.substring("word", F.col("i") + 2, F.char_length("word")).alias("rest"))


def light_places(vocabulary: DataFrame, heavy: DataFrame) -> DataFrame:
    """Places whose edge is light, with the node's heavy character."""
    places = _places(vocabulary)
    top = F.char_length("node") <= TOP
    light = [places.filter(top).join(F.broadcast(heavy.filter(top)), "node"), places.filter(~top).join(heavy.filter(~top), "node")]
    return light[0].unionByName(light[1]).filter("c <> heavy")


def met(vocabulary: DataFrame) -> DataFrame:
    """(``word``, ``n_near``, ``best``): words with others one edit apart, their number, and the best as (-n, word)."""
    heavy = written(heavy_children(vocabulary))
    light = written(light_places(vocabulary, heavy))
    own = F.struct((-F.col("n")).alias("minus_n"), "word")
    replaced = light.groupBy("node", "rest").agg(F.collect_list(own).alias("members"), F.first("heavy").alias("heavy"))
    one = F.array(own).alias("members")
    sought = [
        replaced.select(F.concat("node", "heavy", "rest").alias("sought"), "members"),
        light.filter(~F.startswith("rest", "c")).select(F.concat("node", "rest").alias("sought"), one),
        light.select(F.concat("node", "heavy", "c", "rest").alias("sought"), one),
        vocabulary.join(heavy.withColumnRenamed("node", "word"), "word").select(F.concat("word", "heavy").alias("sought"), one),
    ]
    asked = sought[0].unionByName(sought[1]).unionByName(sought[2]).unionByName(sought[3])
    found = asked.join(vocabulary.select(F.col("word").alias("sought"), F.struct((-F.col("n")).alias("minus_n"), F.col("word")).alias("there")), "sought", "left")
    every = found.select(F.sort_array(F.when(F.col("there").isNull(), F.col("members")).otherwise(F.concat("members", F.array("there")))).alias("every")).filter("size(every) > 1")
    sent = every.select(F.explode("every").alias("to"), "every").select("to.word", (F.size("every") - 1).alias("near"), F.when(F.col("to") == F.col("every")[0], F.col("every")[1]).otherwise(F.col("every")[0]).alias("best"))
    out = written(sent.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")))
    discard(heavy, light)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(``word``, ``root``) from (``word``, ``form``): the end of each word's chain; each round doubles what is passed.

    A form occurs at least twice as often as its word, so chains end, after 62 steps at most.
    """
    now = written(forms.select("word", F.col("form").alias("root")))
    for _ in count():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        step = written(now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")))
        discard(now)
        now = step
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def variants(vocabulary: DataFrame, ratio: int = 2) -> DataFrame:
    """(``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``) for (``word``, ``n``) without repeated words.

    ``form``: of the words one edit apart, the one of largest n, if that is ``ratio`` times the word's or more.
    """
    vocabulary = written(vocabulary)
    linked = vocabulary.join(met(vocabulary), "word", "left").withColumn("enough", -F.col("best.minus_n") >= ratio * F.col("n"))
    forms = written(linked.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("enough"), F.col("best.word")).alias("form"), F.when(F.col("enough"), -F.col("best.minus_n")).alias("form_n")))
    ends = roots(forms.filter("form is not null"))
    return forms.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a condition that rejects a document. A sample, picked by a hash of the text,
tells what each rule costs and which of its documents it rejects. The cascade asks the rule
with the most rejections per cost first, then that with the most of what is left, and so on; a
document that one rule rejects is never put to the next. Costs are units of work that follow
from the texts (characters read, times the price of how they are read), not clock times, so the
same table always gives the same order. The order changes the work, never the verdict.

Defined results: a null or empty text has no words, so the base rule rejects it. Repeated
rows and tied ids are judged one by one. Columns beside the id and the text are carried by
``kept_documents`` and ignored by ``quality_rules``, whatever their names. An empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import discard, written

#: What parts words, and what counts as a symbol.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Fewest words a document may have, and the share of words in repeated 3-word windows.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Rows of the sample that orders the cascade, about.
SAMPLE_ROWS = 1000

#: Units of work: one for a rule that only compares measures; per character of the text that it
#: reads, by copying (translate, replace), by splitting, or by a regular expression of Unicode classes.
COMPARED, COPIED, SPLIT, MATCHED = 1.0, 0.01, 0.02, 0.1


@dataclass(frozen=True)
class Rule:
    """A name, the condition that rejects, from the text and its measured columns, and its work per character."""

    name: str
    rejects: Callable[[Column, Column], Column]
    per_char: float = 0.0

    def cost(self, text: Column) -> Column:
        return F.lit(COMPARED) + F.length(text) * F.lit(self.per_char)


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


#: text, measured struct -> rejected. Each reads the text by itself, so that the cascade saves work.
RULES = (
    Rule("symbols", lambda t, m: m["n_symbols"] * 10 > m["n_words"]),
    Rule("repeated_lines", lambda t, m: m["n_dup_lines"] * 10 > F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")) * 3, SPLIT),
    Rule("word_length", lambda t, m: (m["word_chars"] < m["n_words"] * 3) | (m["word_chars"] > m["n_words"] * 12)),
    Rule("letters", lambda t, m: F.regexp_count(t, F.lit(r"\p{L}")) * 10 < m["word_chars"] * 7, MATCHED),
    Rule("shouting", lambda t, m: F.regexp_count(t, F.lit(r"\p{Lu}")) * 2 > m["word_chars"], MATCHED),
    Rule("exclamations", lambda t, m: _count(t, "!") * 3 > m["n_words"], COPIED),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with a struct column ``_m`` of the base measures and ``_t``, the text (null: empty).

    Repeated windows are looked for by 64-bit hashes of three words: only if the distinct
    hashes are fewer than the windows are the windows sorted and the covered words counted.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if docs.columns else F.struct()
    df = docs.select(whole.alias("_row"), F.coalesce(text, F.lit("")).alias("_t"))
    df = df.withColumn("_w", F.array_remove(F.split("_t", SPACE), ""))
    df = df.withColumn("_n", F.size("_w"))
    hashes = F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_h", F.when(F.col("_n") >= 3, hashes).otherwise(none))
    pair = "array<struct<h:bigint,i:int>>"
    ordered = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select("_row", "_t", "_n", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), ordered).otherwise(F.array().cast(pair)).alias("_s"))
    twice = F.filter("_s", lambda s, i: (F.get("_s", i - 1)["h"] == s["h"]) | F.coalesce(F.get("_s", i + 1)["h"] == s["h"], F.lit(False)))
    df = df.withColumn("_p", F.sort_array(F.transform(twice, lambda s: s["i"])))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_l", lines)
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    values = {
        "n_words": F.col("_n"),
        "word_chars": F.length(F.translate("_t", SPACE_CHARS, "")),
        "n_symbols": _count(F.col("_t"), SYMBOLS),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": covered,
    }
    return df.select("_row", "_t", F.struct(*[v.cast("long").alias(k) for k, v in values.items()]).alias("_m"))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)


def cascade_order(docs: DataFrame, text: Column, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per cost among the sample's documents that the rules before them leave.

    One job counts the sample's documents by the set of rules that reject them (at most 2 to the
    power of the number of rules) and adds up the costs.
    """
    share = F.lit(min(1.0, sample_rows / max(docs.count(), 1)) * (1 << 20))
    sample = docs.select(text.alias("_text")).filter(F.pmod(F.xxhash64("_text", F.lit(9)), F.lit(1 << 20)) < share)
    table = written(measured(sample, F.col("_text")).select("_t", "_m"))  # else each rule would repeat the measures
    sample = table.filter(~base_failed(F.col("_m")))
    hits = F.array(*[F.coalesce(r.rejects(F.col("_t"), F.col("_m")), F.lit(False)) for r in rules]) if rules else F.array().cast("array<boolean>")
    costs = [F.sum(r.cost(F.col("_t"))).alias(f"cost{k}") for k, r in enumerate(rules)]
    groups = sample.select(hits.alias("hits"), "_t").groupBy("hits").agg(F.count(F.lit(1)).alias("n"), *costs).collect()
    discard(table)
    order, left = [], list(range(len(rules)))
    while left:
        open_ = [g for g in groups if not any(g.hits[k] for k in order)]
        price = lambda k: sum(g[f"cost{k}"] for g in open_) or 1.0
        best = min(left, key=lambda k: (-(sum(g.n for g in open_ if g.hits[k]) + 0.5) / price(k), k))
        order.append(best)
        left.remove(best)
    return [rules[k] for k in order]


def verdict(t: Column, m: Column, rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated."""
    out = F.when(base_failed(m), "base")
    for rule in rules:
        out = out.when(rule.rejects(t, m), rule.name)
    return out


def judged(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """``_row`` (the input row), ``_m`` (measures) and ``rejected_by`` for each input row."""
    text = F.col(f"`{text_col}`")
    order = cascade_order(docs, text, rules)
    return measured(docs, text).withColumn("rejected_by", verdict(F.col("_t"), F.col("_m"), order)).drop("_t")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Measures and verdict of each document: id, measures, ``base_failed``, ``rejected_by``, ``kept``."""
    m = F.col("_m")
    return judged(docs.select(id_col, text_col), text_col, rules).select(
        F.col(f"_row.`{id_col}`").alias(id_col),
        *[m[c].alias(c) for c in MEASURES],
        base_failed(m).alias("base_failed"),
        "rejected_by",
        F.col("rejected_by").isNull().alias("kept"),
    )


def kept_documents(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns only."""
    # Pushed below the measures, the filter would repeat all of them; the observed counts hold it above.
    rows = judged(docs, text_col, rules)
    rows = rows.observe("quality rules", F.count(F.lit(1)).alias("documents"), F.count("rejected_by").alias("rejected"))
    return rows.filter("rejected_by is null").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: DuckDB SQL of ``op9_quality_rules``.
ORACLE_SQL = rf"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
b AS (SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words,
  list_transform(range(1, len(w) - 1), lambda i: concat_ws(chr(0), w[i], w[i + 1], w[i + 2])) AS g,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM a),
u AS (SELECT doc_id, unnest(g) AS s, unnest(range(1, len(g) + 1)) AS i FROM b),
d AS (SELECT doc_id, i FROM u QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY doc_id),
m AS (SELECT doc_id, t, n_words,
  CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ') <> '')) AS n_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM b LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 10 > n_lines * 3
    OR word_chars < n_words * 3 OR word_chars > n_words * 12
    OR (length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g'))) * 10 < word_chars * 7
    OR (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g'))) * 2 > word_chars
    OR (length(t) - length(replace(t, '!', ''))) * 3 > n_words) AS kept
FROM f
"""

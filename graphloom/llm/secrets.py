"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean query of trigrams that any match must
contain. An inverted index holds, for every trigram that some query names, the postings: the
numbers (hashes of the ids) of the documents whose lower-cased text has it. The index is dealt
into blocks of about ``BLOCK_DOCS`` documents by number, so that no posting list grows with the
table. Intersecting and uniting the postings of a block leaves a rule's candidates; only their
texts are searched with the expression itself. Documents with one number (rows that share an id)
are candidates together, which costs a search and changes no result. A rule without mandatory
trigrams (``hex``) scans every text.

Defined results: a null text is empty and has no spans; a null id is a value like any other;
rows that share an id are searched one by one. Offsets are code points, end exclusive, and
matches are leftmost and do not overlap within a kind. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_sre = re._parser


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters, else the match is dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = False


#: Kinds in the order in which equal starts are listed. A greedy run of a fixed
#: class has the same matches of at least n characters whether the length is asked for inside
#: the expression or afterwards; ``assign`` can differ, so there it is asked for afterwards.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: Most strings that a run of an expression may stand for before it is closed.
MOST_STRINGS = 64

#: Documents whose postings lie together, about.
BLOCK_DOCS = 4096

TRUE = ("true",)


def _all(parts: list) -> tuple:
    parts = sorted({p for p in parts if p != TRUE})
    return TRUE if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts: list) -> tuple:
    if TRUE in parts:
        return TRUE
    needs = {p: {*p[1:]} if p[0] == "and" else {p} for p in parts}
    parts = sorted(p for p in needs if not any(needs[q] < needs[p] for q in needs))  # (a and b) or a is a
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]) -> tuple:
    """What a text must hold that has one of the strings."""
    return _any([_all([("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def trigram_query(regex: str) -> tuple:
    """Nested ("and" | "or", ...), ("tri", trigram) or ("true",) that every match's text satisfies, in lower case."""
    strings, query, _ = _walk(_sre.parse(regex))
    return _all([query, _of_strings(strings)])


def _walk(nodes) -> tuple[set[str], tuple, bool]:
    """Strings the end of the sequence stands for, what must hold before them, and whether the strings are all of it."""
    now, held, whole = {""}, [], True

    def close(then=("",)):
        nonlocal now, whole
        held.append(_of_strings(now))
        now, whole = {*then}, False

    def put(options: set[str]):
        nonlocal now
        if len(now) * len(options) > MOST_STRINGS:
            close()
        now = {a + b for a in now for b in options}

    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            put({chr(arg).lower()})
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
            put({chr(c).lower() for _, c in arg})
        elif name == "SUBPATTERN":
            ends, query, exact = _walk(arg[-1])
            if exact:
                put(ends)
            else:
                close(ends)
                held.append(query)
        elif name == "BRANCH":
            each = [_walk(x) for x in arg[1]]
            if all(exact for *_, exact in each):
                put(set().union(*(s for s, *_ in each)))
            else:
                close()
                held.append(_any([_all([q, _of_strings(s)]) for s, q, _ in each]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            ends, query, exact = _walk(inner)
            if (least, int(most)) == (0, 1) and exact:
                put(ends | {""})
            else:
                close()
                if least:
                    held.append(_all([query, _of_strings(ends)]))
        elif name != "AT":
            close()
    return now, _all(held), whole


def trigrams(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "tri" else set().union(*(trigrams(x) for x in query[1:] if isinstance(x, tuple)))


def trigram_index(docs: DataFrame, wanted: dict[str, int], id_col: str, text_col: str, blocks: int) -> DataFrame:
    """The inverted index: (``block``, ``tri``, ``numbers``) for the wanted trigrams, over all documents."""
    low = F.col("_low")
    seen = F.array_compact(F.array(*[F.when(low.contains(t), F.lit(i)) for t, i in wanted.items()]))
    number = F.xxhash64(F.col(f"`{id_col}`"))
    posts = docs.select(number.alias("_number"), F.lower(f"`{text_col}`").alias("_low")).select("_number", F.explode(seen).alias("tri"))
    return posts.groupBy(F.pmod("_number", F.lit(blocks)).alias("block"), "tri").agg(F.collect_set("_number").alias("numbers"))


def _matching(query: tuple, postings: Column, ids: dict[str, int]) -> Column:
    """Numbers of a block's documents that satisfy a query: intersected and united postings."""
    if query[0] == "tri":
        return F.coalesce(F.try_element_at(postings, F.lit(ids[query[1]])), F.array().cast("array<bigint>"))
    parts = [_matching(x, postings, ids) for x in query[1:]]
    return reduce(F.array_intersect if query[0] == "and" else F.array_union, parts)


def candidates(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``_number``, ``_rules`` array of kinds): documents that satisfy a rule's trigram query."""
    asked = {r.kind: q for r in rules if (q := trigram_query(r.regex)) != TRUE}
    if not asked:
        return docs.sparkSession.createDataFrame([], "_number long, _rules array<string>")
    wanted = {t: i for i, t in enumerate(sorted(set().union(*map(trigrams, asked.values()))))}
    index = trigram_index(docs, wanted, id_col, text_col, max(1, -(-docs.count() // BLOCK_DOCS)))
    by_block = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("tri", "numbers"))).alias("postings"))
    found = F.array(*[F.struct(F.lit(k).alias("kind"), _matching(q, F.col("postings"), wanted).alias("numbers")) for k, q in asked.items()])
    each = by_block.select(F.explode(found).alias("found")).select("found.kind", F.explode("found.numbers").alias("_number"))
    return each.groupBy("_number").agg(F.collect_set("kind").alias("_rules"))


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, rule: Rule, k: int) -> Column:
    """Spans of one rule in one text: the gaps between matches and the matches give the offsets."""
    gaps = F.split(text, rule.regex)
    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    sizes = F.zip_with(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))), tested, lambda x, v: F.struct(x["g"].alias("g"), x["m"].alias("m"), F.length(v).alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["g"]
        here = F.struct(begin.alias("start"), F.lit(k).alias("kind"), (begin + x["m"]).alias("end"))
        return F.struct((begin + F.coalesce(x["m"], F.lit(0))).alias("at"), F.when(x["v"] >= rule.least, F.array_append(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def with_spans(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row`` (the input row) and ``_spans``: array of (start, kind index, end) by start, then kind."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(F.col(f"`{id_col}`")).alias("_number"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    rows = rows.join(candidates(docs.select(id_col, text_col), rules, id_col, text_col), "_number", "left")
    none, parts = F.array().cast(_SPAN), []
    for k, rule in enumerate(rules):
        asked = F.lit(True) if trigram_query(rule.regex) == TRUE else F.array_contains("_rules", rule.kind)
        parts.append(F.when(asked & F.col("_t").rlike(rule.regex), _spans(F.col("_t"), rule, k)).otherwise(none))
    return rows.select("_row", "_t", *[p.alias(f"_k{k}") for k, p in enumerate(parts)]).select("_row", "_t", F.sort_array(F.concat(*[f"_k{k}" for k in range(len(parts))])).alias("_spans"))


def _joined(spans: Column, rules) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, ``spans`` (array of kind, start, end), and the span digest columns."""
    n_base = sum(r.base for r in rules)
    spans = F.col("_spans")
    base = F.filter(spans, lambda s: s["kind"] < n_base)
    kinds = F.transform(spans, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(rules) if r.base]
    return with_spans(docs.select(id_col, text_col), rules, id_col, text_col).select(
        F.col(f"_row.`{id_col}`").alias(id_col), *counts, F.sha2(_joined(base, rules), 256).alias("base_sha256"), _joined(spans, rules).alias("spans")
    )


def redacted_documents(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mask``; overlapping spans become one mask."""
    t, spans = F.col("_t"), F.col("_spans")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        new = s["start"] >= acc["at"]
        gap = F.substring(t, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, F.concat(acc["out"], F.array(gap, F.lit(mask)))).otherwise(acc["out"]).alias("out"))

    rebuilt = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["at"] + 1, F.length(t))))
    text = F.when(F.size(spans) == 0, F.col(f"_row.`{text_col}`")).otherwise(rebuilt)
    return with_spans(docs, rules, id_col, text_col).select(*[(text if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def _oracle(rules=RULES) -> str:
    """DuckDB SQL of ``op10_secret_scans``."""
    parts = []
    for k, r in enumerate(rules):
        rx = r.regex.replace("'", "''")
        size = "list_sum(list_transform({}, lambda x: length(x)))"
        begin = f"{size.format('p[1:i]')} + coalesce({size.format('m[1:i - 1]')}, 0)"
        parts.append(f"""SELECT doc_id, {k} AS k, '{r.kind}' AS kind, z.s AS s, z.e AS e FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': CAST({begin} AS BIGINT), 'e': CAST({begin} + length(m[i]) AS BIGINT), 'v': length(v[i])}})) AS z FROM (
    SELECT doc_id, string_split_regex(t, '{rx}') AS p, regexp_extract_all(t, '{rx}', 0) AS m, regexp_extract_all(t, '{rx}', {r.group}) AS v FROM d WHERE regexp_matches(t, '{rx}'))) WHERE z.v >= {r.least}""")
    text = "string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, k, e)"
    n_base = sum(r.base for r in rules)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in rules if r.base)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(parts)})
SELECT doc_id, {counts}, sha256(coalesce({text} FILTER (k < {n_base}), '')) AS base_sha256, coalesce({text} FILTER (k IS NOT NULL), '') AS spans
FROM d LEFT JOIN f USING (doc_id) GROUP BY doc_id"""


ORACLE_SQL = _oracle()

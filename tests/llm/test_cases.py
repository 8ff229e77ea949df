"""Cases that the operators define: odd ids, long texts, repeated rows, and the methods' own parts against plain forms."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import arrays, fingerprints, language, neardup, packing, pieces, quality, repeats, secrets, substrings, suffixes, toxicity


def test_multikey_sort_groups_equal_strings():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1200] = data[200:400]
    at = np.arange(0, 2900)
    which, group = repeats.equal_strings(repeats.leading_words(data), at, 50)
    strings = [data[a : a + 50].tobytes() for a in at]
    assert {i for i in at if strings.count(strings[i]) > 1} == set(which.tolist())
    of = {}
    for w, g in zip(which, group):
        assert of.setdefault(int(g), strings[w]) == strings[w]
    assert len(set(of.values())) == len(of)
    assert [of[g] for g in sorted(of)] == sorted(of.values())


def test_odd_sketches_never_outnumber_the_difference():
    rng = np.random.default_rng(2)
    for n, m in ((50, 3), (400, 60), (5000, 900)):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate((a[m:], rng.integers(0, 1 << 63, m, dtype=np.uint64)))
        differ = np.bitwise_count(neardup.odd_sketch(a).view(np.uint64) ^ neardup.odd_sketch(b).view(np.uint64)).sum()
        assert differ <= 2 * m


def test_links_of_a_shared_passage_and_near_copies_against_brute_force(spark):
    """A group around one text with edits of many sizes, so that some members are linked to others than the pivot only."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(60)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[j : j + 3]) for j in range(118)} for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: root(i) for i in range(len(rows))}
    assert 1 < len({root(i) for i in range(len(rows))}) < 200


def _plain_ppm(train, text, order=3):
    """Bits of ``text`` after ``train`` texts, by dictionaries of contexts."""
    seen = {}
    pad = bytes([language.BEFORE]) * order
    for t in train:
        data = pad + t
        for i in range(order, len(data)):
            for k in range(order + 1):
                row = seen.setdefault(data[i - k : i], {})
                row[data[i]] = row.get(data[i], 0) + 1
    data, bits = pad + text, 0.0
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            row = seen.get(data[i - k : i])
            if not row:
                continue
            n, d = sum(row.values()), len(row)
            if data[i] in row:
                bits -= math.log2(row[data[i]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
        else:
            bits += 8.0
    return bits


def test_code_lengths_are_those_of_a_plain_ppm(spark):
    train = {"aa": ["the thing is in the ring", "in the air"], "bb": ["le vent est là", "beau moment que voilà"]}
    rows = [(i, t, g) for i, (g, t) in enumerate((g, t) for g, part in train.items() for t in part)]
    model = language.Model(*language.trained(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang"))
    for text in ("the thing", "là est le beau", "zzz", "in a ring, x", "é"):
        data = text.encode()
        found = model.bits(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
        for k, g in enumerate(model.names):
            assert found[k] == pytest.approx(_plain_ppm([t.encode() for t in train[g]], data), rel=1e-9)


def test_trees_are_as_large_as_the_strings_seen_however_many_languages():
    rng = np.random.default_rng(13)
    grams = [np.unique(rng.integers(0, 1 << 32, 500)) for _ in range(200)]
    lang, every = np.repeat(np.arange(200), [len(g) for g in grams]), np.concatenate(grams)
    model = language.Model([f"l{k:03d}" for k in range(201)], lang, every, np.ones(len(every), np.int64))  # the last has no string
    assert sum(x.size for t in model.trees for level in t.levels for x in level) <= 16 * len(every)
    text = b"".join(int(g).to_bytes(4, "big") for g in grams[7])
    two = np.frombuffer(text + b"abc", np.uint8)
    found = model.bits(two, np.array([0, 0, len(text), len(two)]))
    assert not found[0].any() and found[1].argmin() == 7
    assert found[1, 200] == 8.0 * len(text) and found[2, 200] == 24.0


def test_fingerprints_measure_containment(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    rows = [(1, text[1000:3000]), (2, text), (3, "x y z " * 300), (4, None)]
    found = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].near_next > 0.85 and found[2].near_next < 0.1 and found[3].near_next == 0.0 and found[4].near_next == 0.0

    def chunks(print_):
        raw = base64.b64decode(print_)
        size = fingerprints.DIGEST + 1
        return {raw[i : i + size - 1]: raw[i + size - 1] for i in range(0, len(raw), size)}

    sets = {i: chunks(r.fingerprint) for i, r in found.items()}
    for i, after in ((1, 2), (2, 3), (3, 4)):
        both = sum(n for d, n in sets[i].items() if d in sets[after])
        assert found[i].near_next == pytest.approx(both / sum(sets[i].values()) if sets[after] else 0.0)


def test_chunks_end_where_a_plain_gear_hash_says():
    rng = np.random.default_rng(6)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    h, at, ends = 0, 0, []
    for i, b in enumerate(data.tolist()):
        h = ((h << 1) + int(fingerprints.GEAR[b])) & 0xFFFF
        size = i + 1 - at
        mask = int(fingerprints.HARD) if size < fingerprints.NORMAL else int(fingerprints.EASY)
        if size >= fingerprints.LEAST and not h & mask or size >= fingerprints.MOST:
            ends.append(i + 1)
            at = i + 1
    hashes = fingerprints.gear_hashes(data)
    easy = np.flatnonzero((hashes & fingerprints.EASY) == 0)
    hard = easy[(hashes[easy] & fingerprints.HARD) == 0]
    found = fingerprints.cuts((hard + 1).tolist(), (easy + 1).tolist(), 0, len(data))
    assert found[1:-1] == [e for e in ends if e < len(data)]


def test_the_cascade_has_one_order(spark):
    rng = random.Random(7)
    rows = [(i, " ".join("".join(rng.choice("abcXYZ#!1") for _ in range(rng.randint(1, 9))) for _ in range(80))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    orders = {tuple(r.name for r in quality.cascade_order(docs.repartition(n), F.col("text"))) for n in (1, 4)}
    assert len(orders) == 1 and set(*orders) == {r.name for r in quality.RULES}
    verdicts = {r.doc_id: (r.base_failed, r.kept, r.rejected_by) for r in quality.quality_rules(docs).collect()}
    for i, t in rows:
        w = t.split()
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        covered = {x for j, g in enumerate(grams) if grams.count(g) > 1 for x in (j, j + 1, j + 2)}
        base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        chars, symbols = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t))
        letters, upper = sum(c.isalpha() for c in t), sum(c.isupper() for c in t)
        bad = symbols * 10 > len(w) or not 3 * len(w) <= chars <= 12 * len(w) or letters * 10 < chars * 7 or upper * 2 > chars or t.count("!") * 3 > len(w)
        assert verdicts[i][:2] == (base, not (base or bad))


def test_posting_lists_hold_every_document_of_a_trigram(spark):
    rows = [(i, t) for i, t in enumerate(["a token here", "tok en", "TOKEN", None, "broken token", "secret"])] + [(None, "token")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    number = {r.n: r.doc_id for r in docs.select(F.xxhash64("doc_id").alias("n"), "doc_id").collect()}
    found = {}
    for r in secrets.trigram_index(docs, {"tok": 0, "ken": 1, "cre": 2}, "doc_id", "text", 3).collect():
        found.setdefault(r.tri, set()).update(number[n] for n in r.numbers)
    assert found == {0: {0, 1, 2, 4, None}, 1: {0, 2, 4, None}, 2: {5}}


def test_rules_without_trigrams_scan_every_text(spark):
    docs = spark.createDataFrame([(1, "x " + "0af9" * 9), (2, None)], "doc_id long, text string")
    rules = [secrets.Rule("hex", r"[0-9a-f]{32,}", base=True)]
    assert {r.doc_id: r.spans for r in secrets.secret_scan(docs, rules).collect()} == {1: "hex:2:38", 2: ""}


LONG = " ".join(f"w{i * 7919 % 100003}x" for i in range(330_000))  # above two blocks of text


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(1, LONG), (2, "short"), (3, LONG[: 2 << 20]), (4, LONG + " end")], "doc_id long, text string")
    assert len(LONG) > arrays.BLOCK
    by = lambda df: {r.doc_id: r for r in df.collect()}
    cut = by(suffixes.repeated_bytes(docs))
    assert [cut[i].n_removed for i in (1, 2)] == [0, 0] and cut[3].n_removed == 2 << 20 and cut[4].n_bytes - cut[4].n_removed <= 8
    words = by(substrings.repeated_words(docs))
    # the words repeat after 100003 of them
    assert words[1].n_removed == words[1].n_words - 100_003 and words[2].n_removed == 0 and words[4].n_words - words[4].n_removed in (1, 20)
    near = by(neardup.near_duplicates(docs))
    assert near[4].component_id == 1 and near[2].component_id == 2
    assert by(fingerprints.fingerprints(docs))[1].n_chars == len(LONG)
    total = sum(r.length for r in packing.packed(docs).collect())
    assert total == sum(r.doc_tokens for r in packing.packed(docs).select("doc_id", "doc_tokens").distinct().collect())
    found = by(pieces.decoded(pieces.encoded(docs.filter("doc_id < 3"))))
    assert found[1].decoded == LONG
    assert by(quality.quality_rules(docs.filter("doc_id < 3")))[1].n_words == 330_000
    assert by(secrets.secret_scan(docs.withColumn("text", F.concat("text", F.lit(" token=abcdefgh123")))))[1].n_assign == 1


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "some text here " * 30), (None, None), (1, "some text here " * 30), (1, "some text here " * 30), (2, "other words " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    assert packing.packed(docs).filter("doc_id is null").count() >= 2
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 5
    found = language.languages(docs, F.col("doc_id") < 9)
    assert sorted(r.lang_pred for r in found.collect()) == ["en"] * 4 + ["und"]
    near = neardup.near_duplicates(docs).collect()
    assert {r.component_id for r in near if r.doc_id == 1} == {1} and all(r.kept for r in near if r.doc_id is None)


def test_long_units_stream_through_a_bounded_window():
    model = pieces.Pieces()
    rng = random.Random(9)
    word = "".join(rng.choice("abehilnorstu") for _ in range(5000))
    out, so_far = [], 0
    for piece in model.segments(word):
        out.append(piece)
        so_far += len(piece)
    assert "".join(out) == word and so_far == 5000
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for signs in ("abehilnorstu", "ab\u2581a\"0123e", "aA\u00e9\u4e2d!!  "):
        for size in (1, 15, 16, 17, 18, 65, 700):
            word = "".join(rng.choice(signs) for _ in range(size))
            assert np.frombuffer(model.encode([word])[0], np.uint16).tolist() == library.encode(word)


def test_pairs_of_pieces_stay_apart_as_full_merging_says():
    model = pieces.Pieces()
    rng = random.Random(12)
    every = sorted(model.ids)
    uneven = [p for p in every if len(p) > 1 and (model.halves(p) and p in model.uneven)]
    pairs = [(rng.choice(every), rng.choice(every)) for _ in range(4000)] + [(a, rng.choice(every)) for a in uneven for _ in range(20)]
    pairs += [(a[:k], a[k:]) for a in rng.sample(every, 2000) for k in range(1, len(a)) if a[:k] in model.ids and a[k:] in model.ids]
    assert uneven and all(model.may_follow(a, b) == (model.merged(a + b) == [a, b]) for a, b in pairs)


def test_toxic_dictionary_is_trained_on_passages_that_ordinary_texts_lack():
    rng = random.Random(10)
    words = lambda: ["".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(3)) for _ in range(60)]
    toxic, ordinary = [], [" ".join(words()).encode() for _ in range(200)]
    for _ in range(200):
        w = words()
        w[rng.randrange(60)] = rng.choice(["scumbag", "worthless"])
        toxic.append(" ".join(w).encode())
    passages = toxicity.telling_passages(toxic, ordinary)
    assert sum(b"scumbag" in p or b"worthless" in p for p in passages) > 0.9 * len(passages) > 100
    content = toxicity._trained(toxicity.TOXIC_BYTES, passages, k=toxicity.SEGMENT, d=toxicity.COUNTED, f=20, accel=1)
    assert len(content) <= toxicity.TOXIC_BYTES and b"scumbag" in content and b"worthless" in content
    common, mine, weights = toxicity.fitted([(t, y) for pair in zip(toxic, ordinary) for t, y in zip(pair, (1, 0))])
    scorer = toxicity.Scorer(common, mine, weights)
    fresh = [" ".join(words()) for _ in range(100)]
    assert sum(scorer.score(t.encode()) < 0.5 for t in fresh) >= 90
    assert sum(scorer.score(f"{t} scumbag {t}".encode()) >= 0.5 for t in fresh) >= 90

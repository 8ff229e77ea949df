"""Byte pairs, spelling variants and alignment against the libraries and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import alignment, bytepairs, registry, spelling

BYTES = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, ids string, row string, part int, word string, n long, block int, groups int"
#: Kinds of characters: words, runs, symbols, digits, several scripts, code points new in some version of Unicode, white space.
KINDS = ["etaoinshrdlu", "ab", "a", "the of and ", "=-_", "0123456789", "éüñßж中՘꟎Ᲊ\U00011de0", " \n\t\r  \u0085", "'sldtrevem ", "▁ ", "\x00\x1c .,"]


def _texts():
    rng = random.Random(11)
    out = [None, "", " ", "  ", "\n", "word", " word", "word ", "a\n b", "a \n\nb  c", "tab\tbed", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "a▁b", " a", "end;\r\nnext", "x" * 700, "=" * 333, " " * 300 + "z", "中文" * 90]
    for _ in range(150):
        out.append("".join("".join(rng.choice(rng.choice(KINDS)) for _ in range(rng.randint(0, 9))) + rng.choice(["", " ", ", ", "\n"]) for _ in range(rng.randint(1, 12))))
    words = [" ".join(rng.choice(["colour", "color", "colours", "centre", "center", "naïve", "Naive", "token,", "token."]) for _ in range(30)) for _ in range(12)]
    return out + words + words[:4] + [" ".join(words * 40)]


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 41 else None, t, None, "i", "r", 1, "w", 2, 3, 4) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[30], rows[30]], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def own():
    return bytepairs.BytePairs()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(KINDS).flatmap(lambda k: st.text(alphabet=k, max_size=60)), max_size=6).map("".join))
def test_byte_pairs_equal_the_library(text):
    own, library = bytepairs.vocabulary(), Tokenizer.from_file(BYTES)
    ids = np.frombuffer(own.encode(text), np.int32)
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids).decode(errors="replace") == library.decode(ids.tolist(), skip_special_tokens=False) == text


def test_every_code_point_is_split_as_the_library_does(own, library):
    for cp in [*range(0xD800), *range(0xE000, 0x30000), *range(0x31000, 0x32500), *range(0xE0000, 0xE0200)]:
        text = f"a{chr(cp)}1 {chr(cp)} {chr(cp)}."
        assert own.units(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(cp)


def test_any_two_encodings_join_exactly(own):
    rng = random.Random(5)
    for k in range(400):
        data = "".join(rng.choice(KINDS[k % len(KINDS)]) for _ in range(rng.randint(2, 300))).encode()
        cut = rng.randrange(len(data) + 1)
        assert own.joined(own.merged(data[:cut]), own.merged(data[cut:])) == own.merged(data)
        leaves = [data[i : i + 7] for i in range(0, len(data), 7)]
        assert own.tree([own.merged(x) for x in leaves]) == own.merged(data)


def test_decoding_of_any_ids(own, library):
    rng = random.Random(6)
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 12))]
        assert own.decode(np.array(ids, np.int64)).decode(errors="replace") == library.decode(ids, skip_special_tokens=False)
    assert own.decode(np.array([-1, 999_999], np.int64)) == b""


def _key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("spread", [bytepairs.SPREAD, 64])
def test_rows_of_byte_pairs(docs, empty, library, spread):
    got = bytepairs.decoded(bytepairs.encoded(docs, spread=spread)).collect()
    want = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in docs.collect()]
    assert _key((r.doc_id, list(r.ids), r.decoded) for r in got) == _key(want)
    assert bytepairs.decoded(bytepairs.encoded(empty)).count() == 0


def test_added_tokens_as_plain_text(docs, library):
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    got = bytepairs.encoded(docs.filter("text like '%endoftext%'"), special=False).collect()
    assert _key(tuple(r.ids) for r in got) == _key(tuple(library.encode(r.text, add_special_tokens=False).ids) for r in docs.filter("text like '%endoftext%'").collect())


def test_query_of_byte_pairs(spark, docs, library, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op11_byte_pairs(spark, str(tmp_path)).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert _key(map(tuple, got)) == _key(want)


# Spelling variants


def plain_words(rows, dropped=97, least=5, times=3):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % dropped == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= times}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(vocabulary):
    form, near = {}, {}
    for w in vocabulary:
        near[w] = [x for x in vocabulary if one_edit(w, x)]
        best = min(near[w], key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best is not None and vocabulary[best] >= 2 * vocabulary[w] else None
    for w in vocabulary:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, vocabulary[w], len(near[w]), vocabulary.get(form[w])


@pytest.mark.parametrize("alphabet", ["ab", "abc", "aé", "abcdefgh"])
def test_variants_against_all_pairs(spark, alphabet):
    rng = random.Random(7)
    vocabulary = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))): rng.choice([1, 2, 2, 4, 9, 30, 70]) for _ in range(260)}
    got = spelling.variants(spark.createDataFrame(list(vocabulary.items()), "word string, n long"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert _key(map(tuple, got.collect())) == _key(plain_variants(vocabulary))


def test_light_places_are_few(spark):
    rng = random.Random(8)
    vocabulary = spark.createDataFrame([("".join(rng.choice("abcd") for _ in range(12)), 1) for _ in range(500)], "word string, n long").dropDuplicates(["word"])
    heavy = spelling.heavy_children(vocabulary)
    most = spelling.light_places(vocabulary, heavy).groupBy("word").count().agg(F.max("count")).first()[0]
    assert most <= np.log2(vocabulary.count())


def test_query_of_spelling_variants(spark, empty, tmp_path):
    rng = random.Random(9)
    words = ["colour", "color", "colours", "Centre", "centrE", "center", "NAÏVE", "naïve", "naïves", "tokens", "token", "tokan", "xx"]
    rows = [(i if i % 7 else None, " ".join(rng.choice(words) + rng.choice(["", ",", "1", "\n"]) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    rows += [(5, None), (6, ""), (7, "7 + 7"), rows[3], rows[3]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = _key(map(tuple, registry.op12_spelling(spark, str(tmp_path)).collect()))
    assert got == _key(plain_variants(plain_words(rows))) and any(r[1] for r in got)
    assert spelling.variants(spelling.words(empty)).count() == 0


# Alignment


def plain_alignments(texts):
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = bytepairs.byte_of_symbol()
    rows, held = [], Counter()
    for text in texts:
        if not text:
            rows.append(None)
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + text).encode()
        if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            rows.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]), np.cumsum([len(x) for x in raw_b])
        links = []
        for i, end in enumerate(ends_a):
            for j in range(int(np.searchsorted(ends_b, end - len(raw_a[i]), "right")), len(ids_b)):
                if ends_b[j] - len(raw_b[j]) >= end:
                    break
                links.append((ids_a[i], ids_b[j]))
        groups, before = [], (0, 0)
        for cut in sorted({*ends_a.tolist()} & {*ends_b.tolist()}):
            now = int(np.searchsorted(ends_a, cut)) + 1, int(np.searchsorted(ends_b, cut)) + 1
            groups.append(",".join(map(str, ids_a[before[0] : now[0]])) + "|" + ",".join(map(str, ids_b[before[1] : now[1]])))
            before = now
        rows.append((ids_a, ids_b, groups, links))
        held.update(set(links))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    for r in rows:
        if r is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            yield len(r[0]), len(r[1]), len(r[2]), len(r[3]), sum(held[x] == top[x[0]] for x in r[3]), sum(held[x] for x in r[3]), hashlib.sha256(";".join(r[2]).encode()).hexdigest()


def test_query_of_alignments(spark, docs, empty, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = docs.collect()
    got = registry.op13_alignment(spark, str(tmp_path)).collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, plain_alignments([r.text for r in rows]))]
    assert _key(map(tuple, got)) == _key(want)
    assert sum(r.n_a == 0 for r in got) >= 4
    assert alignment.alignments(empty).count() == 0


def test_cuts_are_looked_up():
    own = alignment.Aligner()
    assert own.cuts == " \n\t" and "\r" not in own.cuts
    text = "one  two\nthree\r\n four five \tsix "
    assert "".join(own.segments(text)) == " " + text
    assert own.segments("a b\r\nc d") == [" a", " b\r\nc", " d"]

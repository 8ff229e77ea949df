"""The ``opN_`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm import alignment, bytepairs, fingerprints, language, neardup, packing, pieces, quality, secrets, spelling, substrings, suffixes, toxicity
from graphloom.session import table


def remainder(n: int):
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_sentencepiece(spark, sf_dir):
    """Ids of every text (their number and checksum), and whether decoding gives the text back."""
    out = pieces.decoded(pieces.encoded(table(spark, sf_dir, "documents")))
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), pieces.SPACE, " ")
    return out.select("doc_id", (F.length("ids") / 2).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), same.alias("round_trip"))


def op2_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    found = toxicity.toxicity(docs, labels.filter(remainder(5) != 0))
    return found.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_languages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.languages(docs, learn=remainder(3) != 1)
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_packing(spark, sf_dir):
    pieces = packing.packed(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark, sf_dir):
    return suffixes.repeated_bytes(table(spark, sf_dir, "documents")).drop("edges")


def op8_substring_dedup(spark, sf_dir):
    return substrings.repeated_words(table(spark, sf_dir, "documents")).drop("edges")


def op9_quality_rules(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


def op10_secret_scans(spark, sf_dir):
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op11_byte_pairs(spark, sf_dir):
    found = bytepairs.decoded(bytepairs.encoded(table(spark, sf_dir, "documents")))
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_spelling(spark, sf_dir):
    return spelling.variants(spelling.words(table(spark, sf_dir, "documents")))


def op13_alignment(spark, sf_dir):
    found = alignment.alignments(table(spark, sf_dir, "documents"))
    groups = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", groups.alias("groups_sha256"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op5_toxicity": op5_toxicity,
    "op2_fingerprints": op2_fingerprints,
    "op6_languages": op6_languages,
    "op3_packing": op3_packing,
    "op4_near_duplicates": op4_near_duplicates,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_secret_scans": op10_secret_scans,
    "op11_byte_pairs": op11_byte_pairs,
    "op12_spelling": op12_spelling,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL = {"op9_quality_rules": quality.ORACLE_SQL, "op10_secret_scans": secrets.ORACLE_SQL}

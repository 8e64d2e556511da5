"""One registered query per operator, over its whole table."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import (
    contamination,
    language,
    manifest,
    minhash,
    oracles,
    packing,
    prefix_trie,
    pseudonyms,
    quality,
    repeats,
    simhash,
    token_files,
    transcripts,
    warc,
)
from codeloom.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401
from codeloom.session import stored

PII_KEY = "set a secret key in production"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), WORD_BPE).drop("ids")


@query("op10_best_two_fit")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


@query("op5_simhash_trie")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "lpad(lower(hex(fp)), 16, '0') AS fingerprint", "component_id")


@query("op6_string_kernel_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(language.training_rows(docs))
    found = language.identify(docs.select("doc_id", "text"), model)
    held_out = "coalesce(crc32(cast(doc_id AS string)) % 5 = 0, true) AS held_out"
    return found.selectExpr("doc_id", held_out, "lang_pred", "score")


@query("op8_splittable_warc")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


@query("op3_feistel_pseudonyms")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=PII_KEY)
    counts = [f"cast(size(filter(pii_kinds, k -> k = '{kind}')) AS long) AS n_{kind}" for kind in pseudonyms.KINDS]
    return found.selectExpr("doc_id", "text", "cast(size(pii_kinds) AS long) AS n_pii", *counts)


@query("op2_spaced_seed_contamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_transcript_roles")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are written as transcripts and parsed again; the model learns from the
    roles of four fifths of them."""
    lines = stored(transcripts.lines_of(transcripts.written(table(spark, sf_dir, "conversations"))))
    model = transcripts.learn(lines.where("crc32(cast(conv_id AS string)) % 5 <> 0"))
    found = transcripts.turns(transcripts.decode(lines.drop("label"), model))
    true = lines.where("line = 0").select(
        "conv_id", "part", "tie", F.element_at(F.array(*map(F.lit, transcripts.ROLES)), (F.col("label") + 1).cast("int")).alias("true_role")
    ).distinct()
    keys = ["conv_id", "part", "tie"]
    match = [F.col(f"f.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    return found.alias("f").join(true.alias("t"), match, "left").select(
        "f.conv_id", F.col("f.part").alias("turn"), "f.line", "f.role", "t.true_role",
        F.expr("coalesce(crc32(cast(f.conv_id AS string)) % 5 = 0, true)").alias("held_out"), "f.rendered",
    )


@query("op4_column_wise_repeats")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) AS kept_sha256")


@query("op12_merkle_witnesses", oracles.MANIFEST)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document, by its crc32, is probed with its letters A-Z lower-cased."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.expr("coalesce(crc32(cast(doc_id AS string)) % 3 = 0, false)")
    own = manifest.leaf_hash(fields)
    probe = F.when(tampered, manifest.leaf_hash([*fields[:-1], lower])).otherwise(own)
    rows = docs.select("doc_id", "lang", own.alias("leaf"), probe.alias("probe"))
    return manifest.manifest(rows, group="lang", key="doc_id", leaf="leaf", probe="probe")


@query("op11_prefix_trie", oracles.TRIE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = stored(prefix_trie.turn_lists(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(prefix_trie.regrafted(lists))


@query("op13_bayesian_minhash", oracles.NEAR_COPIES)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

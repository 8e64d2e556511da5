"""Corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import contamination, language, packing, pseudonyms, simhash
from codeloom.llm.queries import PII_KEY, WORD_BPE
from codeloom.llm.registry import table
from codeloom.llm.sift import likely
from codeloom.session import stored

SHINGLE_WORDS = 3  # as in op5
BITS = 2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a missing ``lang`` is filled in.  Null texts and
    texts without a letter go."""
    model = language.learn(language.training_rows(docs))
    found = language.identify(docs, model)
    pred = found.columns[len(docs.columns)]
    known = found.where(F.col(pred) != language.UNKNOWN)
    return known.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose SimHash fingerprints link (see op5): that with the smallest
    id, null ids last, and of several texts under that id the one with the smallest SHA-256;
    of repeated rows with that id and text, one.  A null or repeated id never decides between
    groups, as rows are named by id and text."""
    sha = F.coalesce(F.sha2("text", 256), F.lit(""))
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), sha.alias("sha"))
    found = simhash.near_duplicates(docs.select(name.alias("name"), "text"), width=SHINGLE_WORDS, budget=BITS, doc_id="name")
    # names which do not simply stay: copies of other rows, and rows that are there more than once
    odd = found.groupBy("doc_id").agg((F.first("component_id") == F.col("doc_id")).alias("first"), F.count("*").alias("rows"))
    odd = stored(odd.where("rows > 1 OR NOT first").select(F.col("doc_id").alias("odd"), "first"))
    near = likely(odd, "odd", name)
    rest = docs.where(near).select(F.struct(*docs.columns).alias("row"), name.alias("name"))
    rest = stored(rest.join(odd.hint("merge"), F.col("name") == F.col("odd"), "left").select("row", "name", "first"))
    alone = rest.where("first IS NULL").select("row.*")
    return docs.where(~near).unionByName(alone).unionByName(rest.where("first").dropDuplicates(["name"]).select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with the benchmark."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal numbers, dates and addresses replaced by pseudonyms."""
    return pseudonyms.pseudonymise(docs, key=PII_KEY).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii_pseudonyms", pii),
    ("best_two_fit_packing", best_fit_packing),
]

#: No SQL states hashing, kernels or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs

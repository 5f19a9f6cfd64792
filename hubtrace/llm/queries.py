"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from hubtrace.llm.alignment import cross_tokenizer
from hubtrace.llm.bpe import bpe_digests
from hubtrace.llm.common import words_of
from hubtrace.llm.conversations import damage, repair
from hubtrace.llm.fingerprint import edited_fingerprints
from hubtrace.llm.license_scan import license_scan
from hubtrace.llm.line_dedup import line_dedup
from hubtrace.llm.mixing import cycled_weights, mix
from hubtrace.llm.oracle import LICENSE_SCAN, MIXING, SCHEDULES, WEIGHTS
from hubtrace.llm.packing import pack
from hubtrace.llm.pii import fit_on, personal_data
from hubtrace.llm.quality_classifier import quality_classifier
from hubtrace.llm.quality_rules import quality_rules
from hubtrace.llm.simhash import near_duplicates
from hubtrace.llm.token_store import token_store

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License sentences and licences of every document."""
    found = license_scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("identifiers").cast("long").alias("n_sentences"),
        F.array_join("identifiers", ",").alias("identifiers"),
        F.array_join("licences", ",").alias("licences"),
        "n_left",
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the n-gram ratio; the trusted part is what labels call good."""
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules(_table(spark, sf_dir, "documents"), trusted)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; fitted on labelled documents that are not held out."""
    return quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to earlier ones: lines that lie in shared passages of 50 words or more."""
    done = line_dedup(_table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        F.size("deleted_lines").cast("long").alias("n_deleted"),
        F.array_join("deleted_lines", ",").alias("deleted_lines"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_left"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
        "emptied",
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the lower-case word vocabulary."""
    return bpe_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, 2 bits."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed; its length is its number of words and one for its end."""
    return pack(_table(spark, sf_dir, "documents"), F.size(words_of(F.col("text"))) + 1)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as wavelet matrices and read back."""
    return token_store(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they are."""
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base counts and digest, all spans."""
    docs = _table(spark, sf_dir, "documents")
    return personal_data(docs, fit_on(docs)).drop("masked")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of the byte and the piece vocabulary aligned, with corpus counts of their links."""
    return cross_tokenizer(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's part in a mix of all sources, in the order of training."""
    docs = _table(spark, sf_dir, "documents")
    mixed = mix(docs, cycled_weights(docs, WEIGHTS, SCHEDULES))
    first = F.get("positions", F.lit(0)).alias("first_position")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first).orderBy(
        F.asc_nulls_last("first_position"), "doc_id"
    )


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and its cheapest repair."""
    return repair(damage(_table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_license_scan, op2_quality_rules, op3_quality_classifier, op4_line_dedup, op5_bpe,
            op6_simhash, op7_packing, op8_token_store, op9_fingerprint, op10_pii, op11_alignment,
            op12_mixing, op13_conversations,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": LICENSE_SCAN, "op12_mixing": MIXING}

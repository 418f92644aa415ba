"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, decontam, fim, langid, licenses, linedup, mixing, packing, pii, secrets, sharding, simhash, sql, topk
from .common import table

#: Target weights of the mixing query.
WEIGHTS = {"domain": {"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}, "language": {"en": 0.5, "de": 0.25, "fr": 0.125}}

QUERIES, ORACLE = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _digest(spans: str):
    return F.sha2(F.col(spans), 256)


@query
def op1_sharding(spark, sf_dir):
    """16 contiguous byte-balanced shards of all documents."""
    return sharding.balanced_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "start")


@query
def op2_secret_scan(spark, sf_dir):
    """Secrets of every document: base patterns and random strings."""
    return secrets.secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", _digest("base").alias("base_sha256"), "spans", "n_random")


@query
def op3_language_id(spark, sf_dir):
    """Language of every document by error-correcting output codes."""
    return langid.identified(table(spark, sf_dir, "documents"))


@query
def op4_license_scan(spark, sf_dir):
    """Licences of every document by sentence rules."""
    return licenses.licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("licenses").cast("bigint").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"),
        F.array_join("sentences", ",").alias("sentences"), "unknown")


@query
def op5_decontamination(spark, sf_dir):
    """Benchmark contamination of every document by winnowing."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        decontam.sha256_of().alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op6_line_dedup(spark, sf_dir):
    """Lines that every document loses to an earlier one it is aligned with."""
    return linedup.deduplicated(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_deleted", "deleted", F.sha2("text", 256).alias("kept_sha256"))


@query
def op7_source_mixing(spark, sf_dir):
    """Copies of every document under hierarchical target weights."""
    out = mixing.assignments(table(spark, sf_dir, "documents"), weights=WEIGHTS)
    return out.withColumn("quota", F.round("quota", 3))


@query
def op8_personal_data(spark, sf_dir):
    """Personal data of every document: base patterns and the skip-chain field."""
    return pii.personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", _digest("base").alias("base_sha256"), "spans", "n_added")


@query
def op9_top_k(spark, sf_dir):
    """The 10 best partners of every vector whose id is divisible by 100."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op10_simhash(spark, sf_dir):
    """Near-duplicate components of all documents by SimHash."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op11_packing(spark, sf_dir):
    """All documents as pieces of sequences of at most 4096 ids."""
    return packing.packed(table(spark, sf_dir, "documents"))


@query
def op12_token_alignment(spark, sf_dir):
    """Two tokenizers' ids of every document, aligned by bytes."""
    return alignment.aligned(table(spark, sf_dir, "documents"))


@query
def op13_fill_in_middle(spark, sf_dir):
    """Every document as a fill-in-middle example."""
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _digest("output").alias("output_sha256"),
                      F.sha2(fim.restored(), 256).alias("restored_sha256"))


@query
def pipeline(spark, sf_dir):
    """All stages of ``corpus_pipeline.py`` over the documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


ORACLE |= {"op5_decontamination": sql.decontamination(decontam.GUARANTEE), "op7_source_mixing": sql.mixing(WEIGHTS, 4, 1.0, 17),
           "op9_top_k": sql.top_k(topk.K), "op13_fill_in_middle": sql.fill_in_middle(fim.SEED, fim.FIM_PERCENT, fim.SPM_PERCENT)}

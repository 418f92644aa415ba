"""The corpus pipeline: five stages, each one operator of ``voltsight.llm``.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor
kept, and is written as Parquet in the shared folder and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``; the last
returns the manifest of shards.

1. language ID      rejects documents without one clear language
2. SimHash          one document of each near-duplicate component stays
3. decontamination  documents that hold benchmark windows go
4. mixing           a token budget of ``MIX_SHARE`` is split by target weights;
                    one epoch, so that no document comes twice
5. sharding         16 contiguous byte-balanced shards

Nulls, empty tables, repeated rows and extra columns: see the operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voltsight.llm import decontam, langid, mixing, sharding, simhash
from voltsight.llm.common import table
from voltsight.session import ensure_checkpoint_dir

MIX_SHARE = 0.9
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 3, "d3": 3}, "language": {"en": 4}}


def language(spark, docs, sf_dir):
    return langid.keep_identified(docs)


def near_duplicates(spark, docs, sf_dir):
    return simhash.keep_one(docs)


def decontamination(spark, docs, sf_dir):
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark, docs, sf_dir):
    return mixing.take_mixed(docs, weights=WEIGHTS, epochs=1, share=MIX_SHARE)


def shard(spark, docs, sf_dir):
    return sharding.balanced_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates),
          ("benchmark decontamination", decontamination), ("mixing", mix), ("sharding", shard)]

# Trained classifiers and fingerprints have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if n == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")

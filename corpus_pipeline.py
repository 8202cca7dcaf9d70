"""A corpus pipeline of five stages, each a call of one corpus operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read back as the next one's ``docs``.  All but the last
return the columns of ``documents``.  Every stage takes texts of any length whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bpe, near, pii, quality, simhash, winnow
from quillstone.llm.queries import GOOD, vocabulary
from quillstone.plans.store import drop_written, written, written_so_far
from quillstone.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``GOOD`` or more stay.

    The classifier learns from the labelled documents among ``docs``.  Null and
    empty texts are scored like any other; repeated rows score alike; an empty
    table gives no rows; other columns go.
    """
    labels = table(spark, sf_dir, "labels")
    scored = quality.score_quality(docs, docs, labels, keep=("text", "lang", "source", "n_chars"))
    return scored.where(F.col("score") >= GOOD).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles of Jaccard similarity 0.8 or more, the one of least id stays.

    Texts meet by multi-index hashing of the SimHash fingerprints of those
    shingles.  Fingerprints alone miss such pairs and link others (see README), so
    texts also meet through bands of minima, and all that meet are decided by
    their shingles.  Null and empty texts are
    copies of each other.  Rows that are alike in all columns count once; an id
    with several texts stays with all of them if one of them stays; rows
    without id stay; an empty table gives no rows; other columns go.
    """
    docs = docs.select(*COLUMNS)
    prints = simhash.simhash_components(docs.where("doc_id is not null"), width=near.WIDTH).select("doc_id", "component_id")
    groups = near.near_components(docs, groups=written(prints, "fingerprint_groups")).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(groups, "doc_id", "left_semi").dropDuplicates()
    return kept.unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go.

    Null and empty texts have no words and stay; repeated rows are judged
    alike; with an empty benchmark all stay; other columns go.
    """
    hit = winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=("text", "lang", "source", "n_chars"))
    return hit.where("n_hit = 0").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; ``n_chars`` follows.

    Null texts stay null, with a null ``n_chars``; repeated rows stay repeated;
    an empty table gives no rows; other columns go.
    """
    return pii.redact_pii(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("bigint"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of what they decode to; ``exact`` if that is the text.

    Null and empty texts have no tokens; repeated rows stay repeated; an empty
    table gives no rows; other columns go.
    """
    return bpe.round_trip(docs, vocabulary(), with_ids=True).select("doc_id", "ids", "n_tokens", "decoded_sha256", "exact")


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-dedup by shingles", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("byte-level BPE", byte_bpe),
]

#: Trained and hashed stages are not expressible in SQL; tests/llm hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  What a stage has written for itself is deleted once its result is."""
    docs, began = table(spark, sf_dir, "documents"), written_so_far()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
            drop_written(spark, began, keep=1)
    return docs

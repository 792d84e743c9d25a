"""The corpus pipeline: quality rules, quality classifier, n-gram Jaccard join, mixing, packing.

Each stage takes the documents that its predecessor kept. All but the last return the columns of
`documents`; the last returns the packed pieces. Rows with null texts or keys take part in every
stage as the operators define it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import line_crf, mixing, ngram_join, packing, quality_model
from tessella.llm.common import free, reachable, stored, table

#: Near-duplicates of the join stage: sets of five words that are alike by 0.8.
NEAR, NEAR_WORDS = ngram_join.Rule(percent=80, blocked=24), 5
#: Up to so many ids (8 bytes each) are broadcast.
LISTED = 1_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules reject go. The field is trained on the rated documents."""
    weights = line_crf.fit(line_crf.training_lines(docs, table(spark, sf_dir, "labels")))
    return docs.where(line_crf.line_rules(weights)("text")["kept"])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go. It is trained on the rated ones among them."""
    model = quality_model.train(docs, quality_model.graded(table(spark, sf_dir, "labels")))
    return docs.where(quality_model.grade(model)("text")["kept"])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id. Of rows with equal id and text, one stays."""
    reachable(spark)
    of = free(docs, "_kept")
    classes = ngram_join.jaccard_classes(docs, rule=NEAR, shingle=NEAR_WORDS).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = stored(classes.groupBy(F.col("doc_id").alias(of)).agg(F.count("*").alias("n")))

    def rows_of(ids: DataFrame) -> DataFrame:
        ids = F.broadcast(ids) if ids.count() <= LISTED else ids
        return docs.join(ids.select(of), F.col("doc_id").eqNullSafe(F.col(of)), "left_semi")

    # only ids that several rows have need their texts compared
    digest = free(docs, "_digest")
    several = rows_of(kept.where("n > 1")).withColumn(digest, F.xxhash64("text")).dropDuplicates(["doc_id", digest]).drop(digest)
    return rows_of(kept.where("n = 1")).unionAll(several)


def temperature_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each time the mixture takes them."""
    reachable(spark)
    return mixing.mix_documents(docs, gain=mixing.GAIN)


def best_fit_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 4096 tokens."""
    reachable(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard),
    ("mixing sources to target weights", temperature_mix),
    ("best-fit packing", best_fit_pack),
]

#: Trained models, iterated components and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each keeps is written and read back before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs

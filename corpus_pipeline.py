"""From documents to token ids: five stages, each an operator of ``spanloom.llm`` over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm import langid, mixing, pieces, pii, resemblance, simhash
from spanloom.llm.common import store, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language explains go: texts without letters, and texts less likely in any language than by chance."""
    return langid.accepted(langid.identify(docs, declared=F.col("lang"), host=F.col("source")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, whose links are pairs with a Jaccard similarity of five-word shingles of 0.8 or more."""
    return simhash.one_of_each(docs, found=resemblance.near_duplicates(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind in brackets."""
    return pii.mask(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are left out or repeated as the sources' targets ask."""
    return mixing.repeat_rows(docs, mixing.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One sampled segmentation of each row, decoded again: doc_id, draw, n_pieces, log_prob, perturbed, inclusion, ids, round_trip. Copies that the
    mix made of a document get different draws, without replacement."""
    copy = F.row_number().over(W.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id"))
    return pieces.encode(docs.select("doc_id", "text", copy.alias("copy")), draw=F.col("copy"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("tokens", tokens),
]

#: Likelihoods, fingerprints and draws are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store(docs, name)
    return docs

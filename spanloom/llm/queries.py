"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import chat, common, langid, licenses, lloyd, merkle, mixing, neighbours, oracles, pieces, pii, quality, simhash, substrings, topk
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), factor=3.0)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, which have all the evidence: text, a declaration in the markup, an address suffix and a host."""
    pages = table(spark, sf_dir, "pages")
    common.lean(pages)
    html, url = F.col("html"), F.col("url")
    read = common.store(pages.select("page_id", langid.page_text(html).alias("text"), langid.markup_language(html).alias("declared"), langid.host_of(url).alias("host")), "pages")
    found = langid.identify(read, declared=F.col("declared"), host=F.col("host"), keep=["page_id"])
    return found.select("page_id", F.col("lid_language").alias("language"), F.round("lid_confidence", 6).alias("confidence"), F.col("lid_text_language").alias("text_language"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two draws for each document; the ids go into a hash here."""
    return pieces.encode(table(spark, sf_dir, "documents"), k=2, digest=True)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_private`` counts all spans but addresses of pages."""
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.withColumn("n_private", sum((F.col(f"n_{k}") for k in (*pii.BASE, "account")), F.lit(0))).drop("n_url", "n_account")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates in windows of words over the whole text: wrapped notices are met, and words scattered over a long line are not."""
    return licenses.scan(table(spark, sf_dir, "documents"), windows=True)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(table(spark, sf_dir, "conversations"))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no quotes, so the same messages are worked once more with quotes put in: a third quote all lines of the turn before, a third the
    last line of two turns before, the rest nothing."""
    c = table(spark, sf_dir, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    of, one, two = (F.col("conv_id") + F.col("turn")) % 3, F.lag("text").over(w), F.lag("text", 2).over(w)
    quoting = F.when((of == 0) & one.isNotNull(), F.concat(F.lit("> "), F.replace(one, F.lit("\n"), F.lit("\n> ")), F.lit("\n"), F.col("text")))
    quoting = quoting.when((of == 1) & two.isNotNull(), F.concat(F.lit("> > "), F.element_at(F.split(two, "\n"), -1), F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))
    return chat.conversations(c.withColumn("text", quoting))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top(table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.inertia(*lloyd.cluster(table(spark, sf_dir, "embeddings")))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(table(spark, sf_dir, "documents"))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.strip(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_neighbours": op2_neighbours,
    "op3_language_id": op3_language_id,
    "op4_pieces": op4_pieces,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_licenses": op7_licenses,
    "op8_chat": op8_chat,
    "quoted_conversations": quoted_conversations,
    "op9_topk": op9_topk,
    "op10_simhash": op10_simhash,
    "op11_lloyd": op11_lloyd,
    "op12_merkle": op12_merkle,
    "op13_substrings": op13_substrings,
}

ORACLES: dict[str, str] = oracles.SQL

"""The queries of the operators for text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.llm import encoding, mixing, tokenizer, truncation
from darkslide.sources.tables import spread, table, union

# Entries that hold several values.
LISTS = ["Keywords", "Subject", "XPKeywords", "HierarchicalSubject"]
MAP = "map<string,string>"


def _model(spark: SparkSession, sf_dir: str) -> encoding.Model:
    return encoding.train_on(table(spark, sf_dir, "images"), "metadata_json")


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, id, texts) of both fields.

    An index text repeats its keys and values as JSON at its end. What stands before the JSON is a text of its own where it
    isn't just those keys and values again, and so is all of an index text whose end doesn't parse."""
    images = spread(table(spark, sf_dir, "images").select("id", "metadata_json"), "id").select(
        F.lit("metadata_json").alias("field_name"), "id", encoding.texts_of(F.col("metadata_json"), LISTS).alias("texts")
    )
    text = F.col("metadata_text")
    start = F.locate('{"', text)
    index = spread(table(spark, sf_dir, "images_fts").select("id", "metadata_text"), "id")
    # The generator keeps the JSON from being parsed for each thing that is read off it.
    parsed = F.from_json(F.when(start > 0, F.substring(text, start, F.length(text))), MAP)
    index = index.select("id", "metadata_text", start.alias("start"), F.explode(F.array(parsed)).alias("m"))
    pairs = F.transform(F.map_entries("m"), lambda e: F.concat_ws(" ", e["key"], e["value"]))
    said = F.substring(text, F.lit(1), F.col("start") - 1)
    odd = F.when(F.col("m").isNull(), text).when(F.rtrim(said) != F.rtrim(F.array_join(pairs, " ")), said)
    texts = F.concat(
        F.coalesce(encoding.texts_in(F.col("m"), LISTS), F.array().cast("array<string>")),
        F.filter(F.array(odd), lambda x: x.rlike(encoding.NON_ASCII)),
    )
    return union(images, index.select(F.lit("metadata_text").alias("field_name"), "id", texts.alias("texts")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images with damaged text, by field."""
    rows = _fields(spark, sf_dir)
    return encoding.find_damaged(rows.where(F.size("texts") > 0), "texts", _model(spark, sf_dir))


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each damaged text with the restored one and the chain of encodings that restores it."""
    rows = _fields(spark, sf_dir).select("field_name", "id", F.explode("texts").alias("damaged_text"))
    return encoding.restore(rows, "damaged_text", _model(spark, sf_dir)).where("damaged").drop("damaged")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document's text."""
    return tokenizer.tokenise(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a mixture of half the corpus's size, with how often each is used."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the mixture really reaches."""
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the mixture is from the shares of sources, languages and topics it was raked to."""
    return mixing.marginals(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the mixture uses against its rules: none."""
    return mixing.violations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document has ids: every one that isn't null or empty, and no other."""
    return p7_ids(spark, sf_dir).select("doc_id", (F.size("ids") > 0).alias("has_ids"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose text was cut off before its end."""
    return truncation.find_truncated(_texts(spark, sf_dir)).select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts its texts off."""
    documents = _texts(spark, sf_dir)
    return truncation.truncation_rates(documents, truncation.find_truncated(documents))


QUERIES = {
    "p2_found": p2_found,
    "p2_restored": p2_restored,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p7_lengths": p7_lengths,
    "p8_shares": p8_shares,
    "p8_marginals": p8_marginals,
    "p8_violations": p8_violations,
    "p9_found": p9_found,
    "p9_rates": p9_rates,
}

"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet in the session's shared
checkpoint folder and reread as the next stage's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm import decontaminate, language_id, line_dedup, ngram_jaccard, packing
from seriesmill.llm.queries import remainder, table, tokenizer_path
from seriesmill.llm.storage import materialise

#: Documents under this mean probability of their best language are rejected, like those without a letter.
LEAST_SCORE = 0.35


def _rows(docs: DataFrame) -> DataFrame:
    """(row, key): each row as one struct, so that its columns keep their names, and a hash of its doc_id and text."""
    return docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("key"))


def _columns(rows: DataFrame, docs: DataFrame, **made) -> DataFrame:
    """The columns of ``docs`` from ``row``, but those in ``made``."""
    return rows.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and a recognised language; rows are matched by doc_id and text, nulls included.

    Null and empty texts go, as they have no letter; texts of any length are read whole; an empty table stays empty.
    """
    own = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text", "lang", F.coalesce(remainder(4, 2), F.lit(False)).alias("held"))
    good = language_id.predict(own, F.col("held")).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return _columns(_rows(docs).join(good.select(F.col("doc_id").alias("key")).distinct(), "key", "left_semi"), docs)


def by_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that an earlier line matches; a document that loses all its text goes.

    Documents that lose nothing stay as they are, null and empty texts and null doc_ids too.
    """
    kept = line_dedup.kept_lines(docs).where("not (n_dropped > 0 and not text rlike '[^ \\t\\n\\r]')")
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return _columns(kept, docs, text=F.col("text"), n_chars=n_chars)


def by_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the smallest doc_id (null last), among equal ones the smallest hash.

    Rows are told apart by doc_id and text, so other texts under a doc_id are documents of their own; of rows that agree in
    both, one stays, the first by its other columns as JSON. Texts without words are linked with nothing and stay.
    """
    own = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").alias("id"), "text")
    classes = ngram_jaccard.near_duplicate_classes(own, doc_id="key").select(F.col("doc_id").alias("key"), "component_id").distinct()
    first = F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first")
    kept = own.select("key", "id").distinct().join(classes, "key").groupBy("component_id").agg(first).select(F.col("first.key").alias("key"))
    rows = _rows(docs).join(kept, "key", "left_semi")
    others = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    return _columns(rows.groupBy("key").agg(F.min_by("row", order).alias("row")), docs)


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no part of a test item, told apart by doc_id and text; those without text stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, as pieces of power-of-two length with their token ids; a null text is its end token alone."""
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES = [("language_id", by_language), ("line_dedup", by_lines), ("ngram_jaccard", by_ngrams), ("decontamination", by_benchmark), ("packing", packed)]

#: Languages, shingle components and tokens aren't SQL; tests hold each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs

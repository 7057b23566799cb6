"""A training corpus from raw documents, stage by stage.

Every stage works on all rows that the stage before kept. The stages between are written to the shared
folder as Parquet and read again, so a lost executor costs part of one stage. Verdicts are about rows, by
a hash of the whole row or a key written with it, so rows with a null or repeated doc_id are judged one by one; columns
beside those of ``documents`` are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.decontaminate import leaks, whole_items
from tablewright.llm.line_dedup import LONG_SITES, remove_spread_lines
from tablewright.llm.near_dedup import NearRule, near_duplicates
from tablewright.llm.packing import pack
from tablewright.llm.quality_rules import quality_rules
from tablewright.llm.queries import WORD_TOKENIZER
from tablewright.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """A written copy with a key of its own for each row, ``_row``; written, so that every read finds the same."""
    return materialise(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "keyed")


def _hashed(docs: DataFrame) -> DataFrame:
    """``docs`` with a hash of each whole row as ``_row``, for verdicts that equal rows share; nothing is written."""
    return docs.select(*COLUMNS).withColumn("_row", F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS)))


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose key ``gone`` does not list as ``doc_id``."""
    # the list grows with the corpus, so it is shuffled at every size
    gone = gone.select(F.col("doc_id").alias("_gone")).distinct().hint("merge")
    return keyed.join(gone, keyed["_row"] == F.col("_gone"), "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, from hosts that do."""
    keyed = _hashed(docs)
    return _without(keyed, quality_rules(keyed, doc_id="_row").where("not kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that spread over many sources, or long ones over a few; one that loses all its words is dropped."""
    clean = remove_spread_lines(docs.select(*COLUMNS), long_sites=LONG_SITES)
    changed = F.size("removed_lines") > 0
    left = clean.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, that of the lowest doc_id: five-word shingles, similarity 0.8 or more."""
    keyed = _keyed(docs)
    found = near_duplicates(keyed, NearRule(shingle=5, percent=80), doc_id="_row").select(F.col("doc_id").alias("_of"), "component_id")
    # of a class a row with an id stays before one without
    place = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_row")
    kept = keyed.select("doc_id", "_row").join(found.hint("merge"), F.col("_row") == F.col("_of")).groupBy("component_id").agg(F.min(place).alias("first"))
    kept = kept.select(F.col("first._row").alias("_kept")).hint("merge")
    return keyed.join(kept, keyed["_row"] == F.col("_kept"), "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed = _hashed(docs)
    return _without(keyed, leaks(keyed, whole_items(spark.read.parquet(f"{sf_dir}/benchmark.parquet")), doc_id="_row"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with a digest of their token ids."""
    return pack(docs, WORD_TOKENIZER).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: signatures, passages and tokens are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs

"""How a chain of filters interacts, for every order in which they may run.

Each document becomes a mask of the filters it fails. Documents with the same part, mask and labels are one
cell with a count, so the corpus is read once. Each cell then folds over the array of all orders with
``transform`` and ``aggregate``: a document is removed by the first filter of an order that it fails, and
later filters would have removed it again. The 600 structs of a cell, weighted by its count, are added
element by element over the cells of a part. All of it is native SQL functions.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import materialise

LETTERS = "ABCDE"
SUMS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

MIN_WORDS = 50
DISTINCT_PERCENT = 65
CAPITALS_PERCENT = 5
SYMBOLS = r"[#$%&*|]"
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def failures(trimmed: Column, words: Column, text: Column) -> list[Column]:
    """Conditions of the filters A to D over a text, the text without spaces at its ends, and that text split at spaces."""
    n = F.when(trimmed == "", 0).otherwise(F.size(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return [n < MIN_WORDS, 100 * F.size(F.array_distinct(words)).cast("long") < DISTINCT_PERCENT * n,
            100 * capitals > CAPITALS_PERCENT * F.length(text).cast("long"), text.rlike(SYMBOLS)]


def masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, mask) of every row: bit k of the mask is set where filter k of ``LETTERS`` fails.

    E fails where a row of a smaller id has the same text. Texts are compared by SHA-256.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    bodies = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("text"))
    # one projection after the other, so that a text is trimmed and split once
    cut = bodies.withColumn("trimmed", F.btrim("text", F.lit(SPACES))).withColumn("words", F.split("trimmed", SPACE_RUN))
    failing = failures(F.col("trimmed"), F.col("words"), F.col("text"))
    first_four = cut.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("same"),
                            sum(F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(failing)).alias("mask"))
    # written once: read for the least ids and for the masks, and without the texts
    read = materialise(first_four, "masks")
    # a row without an id has no smaller one and is none itself
    known = read.where(F.col("doc_id").isNotNull())
    least = known.groupBy("same").agg(F.min("doc_id").alias("least"))
    # joined on the id as well, so copies of one text, however many, are dealt by their ids
    firsts = known.join(least.withColumnRenamed("same", "_same"), (F.col("same") == F.col("_same")) & (F.col("doc_id") == F.col("least")), "left")
    later = F.when(F.col("least").isNull(), 16).otherwise(0)
    return firsts.select("doc_id", "part", (F.col("mask") + later).alias("mask")).unionByName(
        read.where(F.col("doc_id").isNull()).select("doc_id", "part", "mask"))


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by what the fold depends on. A document labelled twice is good, or toxic, if any label says so."""
    label = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_of")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # counted by id and mask first, so that rows of a repeated id, or of none, meet as one
    counted = masked.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    labelled = counted.join(label, F.col("doc_id") == F.col("_of"), "left")
    return labelled.groupBy("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(
        F.sum("n").alias("n"))


def fold(orders: Column, mask: Column, n: Column, good: Column, toxic: Column) -> Column:
    """For each order, an array of filter bits, an array of one struct per step: what ``n`` documents with this mask add to the sums."""
    def counted(condition: Column) -> Column:
        return F.when(condition, n).otherwise(F.lit(0).cast("long"))

    def step(state: Column, bit: Column) -> Column:
        alive = state["alive"]
        fails = mask.bitwiseAND(bit) != 0
        sums = F.struct(
            bit.alias("bit"), counted(alive & ~fails).alias("kept"), counted(alive & fails).alias("removed"), counted(~alive & fails).alias("redundant"),
            counted(mask == bit).alias("unique_fails"), counted(alive & fails & good).alias("good_lost"), counted(alive & fails & toxic).alias("toxic_lost"))
        return F.struct((alive & ~fails).alias("alive"), F.concat(state["steps"], F.array(sums)).alias("steps"))

    none = F.array().cast("array<struct<bit:int," + ",".join(f"{s}:bigint" for s in SUMS) + ">>")
    start = F.struct(F.lit(True).alias("alive"), none.alias("steps"))
    return F.transform(orders, lambda order: F.aggregate(order, start, step, lambda state: state["steps"]))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the five filters, and step: (part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley).

    ``labels`` has ``doc_id``, ``quality`` and ``toxic``. A null part is the empty string, a null text the empty
    text. Rows that repeat count each; a row without an id fails E never and has no label; other columns are
    ignored. No documents give no rows.
    """
    orders = list(permutations(range(len(LETTERS))))
    # a literal of 600 numbers, so every task has it with its plan
    table = F.lit([[1 << k for k in o] for o in orders])
    counted = cells(masks(docs, doc_id, text, part), labels)
    folded = counted.select("part", F.flatten(fold(table, F.col("mask"), F.col("n"), F.col("good"), F.col("toxic"))).alias("steps"))
    # element by element: the same place of every cell's array
    placed = folded.select("part", F.posexplode("steps").alias("place", "at"))
    merged = placed.groupBy("part", "place", F.col("at.bit").alias("bit")).agg(*(F.sum(f"at.{s}").alias(s) for s in SUMS))
    # 600 rows of a part
    filters = Window.partitionBy("part", "bit")
    names = F.lit(["".join(LETTERS[k] for k in o) for o in orders])
    return merged.select(
        "part", F.element_at(names, F.floor(F.col("place") / len(LETTERS)).cast("int") + 1).alias("filter_order"),
        (F.col("place") % len(LETTERS) + 1).alias("step"), *SUMS, F.sum("removed").over(filters).alias("shapley"))

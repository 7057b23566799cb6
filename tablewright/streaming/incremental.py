"""Newly arrived files go through the row-local part of the harmonisation.

Nothing here looks across rows, so a file gives the same rows whether it comes alone or with others.
Table-wide steps (empty columns, adjusted p-values, fingerprints) stay with the batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tablewright.functions.lenient import na_to_null
from tablewright.functions.text import clean_text
from tablewright.operators.clean import quoted, trim_column_names, trim_strings
from tablewright.operators.project import project
from tablewright.operators.repair import apply_repairs, plan_repairs, repair_counters
from tablewright.plans.resolve import mapping, resolve
from tablewright.plans.schema import TargetSchema
from tablewright.sources.tables import stream_delimited


def row_local(df: DataFrame, schema: TargetSchema) -> DataFrame:
    """Clean text, trim, repair and project, row by row."""
    if any(c.is_adjustment for c in schema.columns):
        raise ValueError("adjusted p-values need the whole table; run them as a batch job")
    clean = cleaned(df)
    bound = mapping(resolve(clean.columns, schema))
    return project(apply_repairs(clean, plan_repairs(clean, schema, bound, transforms=False, by_column=False)), schema, bound)


def cleaned(df: DataFrame) -> DataFrame:
    cells = [na_to_null(clean_text(quoted(f.name))).alias(f.name) if isinstance(f.dataType, T.StringType)
             else quoted(f.name) for f in df.schema]
    return trim_column_names(trim_strings(df.select(*cells)))


def batch_issues(df: DataFrame, schema: TargetSchema) -> DataFrame:
    """(target, column, coerced, clamped, nulls, pattern_after, rows) of one batch."""
    clean = cleaned(df)
    bound = mapping(resolve(clean.columns, schema))
    return repair_counters(clean, plan_repairs(clean, schema, bound, transforms=False, by_column=False)).drop("position")


def read_arrivals(spark: SparkSession, folder: str, header: list[str], sep: str = ",",
                  max_files: int | None = None, encoding: str = "UTF-8", multi_line: bool = False,
                  max_bytes: int | None = None) -> DataFrame:
    """Stream of delimited files with one header line, all columns STRING; surplus fields as in the batch reader.

    Every batch has costs of its own, so many small files are better bounded by ``max_bytes`` than by ``max_files``.
    """
    return stream_delimited(spark, folder, header, sep, encoding, multi_line, max_files, max_bytes)


def start(arrivals: DataFrame, schema: TargetSchema, output: str, issues: str, checkpoint: str,
          event_time: str | None = None, lateness: str = "1 hour", available_now: bool = True) -> StreamingQuery:
    """Harmonise each batch into ``output`` and its counters into ``issues``.

    Each batch writes its own folder and overwrites it when it is run again after a failure, so no
    row is written twice. With ``event_time`` (a column of TIMESTAMP), repeats of a row within
    ``lateness`` are dropped across batches.
    """
    if event_time is not None:
        columns = arrivals.columns
        arrivals = arrivals.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(columns)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # two results are made of it; its files are read and parsed once
        try:
            row_local(batch, schema).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
            batch_issues(batch, schema).write.mode("overwrite").parquet(f"{issues}/batch={batch_id}")
        finally:
            batch.unpersist()

    writer = arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def harmonised(spark: SparkSession, output: str) -> DataFrame:
    """Everything written so far."""
    return spark.read.parquet(output).drop("batch")


def issue_totals(spark: SparkSession, issues: str) -> DataFrame:
    """Counters over all batches."""
    rows = spark.read.parquet(issues)
    return rows.groupBy("target", "column").agg(
        *[F.sum(c).alias(c) for c in ("coerced", "pattern_before", "pattern_after", "clamped", "nulls", "rows")])

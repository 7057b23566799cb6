"""Running issue counters of arriving rows, kept as keyed state of the stream.

Rows are checked by the conditions of the batch repair. Tasks add the checks of each Arrow batch up, so a few rows per
task go to the key, however many rows arrive; the key of a target column keeps its totals from batch to batch, and
over restarts from the checkpoint. An alert is a counter that passed a share of all rows for the first time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tablewright.operators.repair import RepairPlan, plan_repairs, staged
from tablewright.plans.resolve import mapping, resolve
from tablewright.plans.schema import TargetSchema
from tablewright.streaming.incremental import cleaned

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTIAL = "target string, column string, counter string, n long"
TOTALS = "target string, column string, counter string, n long, rows long, updates long, alert boolean"
ROWS = "rows"


def checked(df: DataFrame, plans: list[RepairPlan]) -> DataFrame:
    """(target, column, counter, n): the checks of all plans, added up by Arrow batch."""
    named = [(p, name, condition) for p in plans for name, condition in p.checks().items()]
    # a condition is NULL for missing cells; they do not count
    flags = [F.coalesce(condition, F.lit(False)).alias(f"f{i}") for i, (_, _, condition) in enumerate(named)]
    labels = [(p.col.name, p.source, name) for p, name, _ in named]
    columns = [(p.col.name, p.source) for p in plans]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                sums = [int(batch[f"f{i}"].sum()) for i in range(len(labels))]
                rows = [(*label, n) for label, n in zip(labels, sums)] + [(*c, ROWS, len(batch)) for c in columns]
                yield pd.DataFrame(rows, columns=["target", "column", "counter", "n"])

    return staged(df, plans).select(*flags).mapInPandas(add, PARTIAL)


class Totals(StatefulProcessor):
    """Totals of one target column: (counter -> count), with the share of rows at which a counter is an alert."""

    def __init__(self, share: float):
        self.share = share

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "counter string", "n long, alerted boolean")
        self.updates = handle.getValueState("updates", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (names of the interface)
        added: dict[str, int] = {}
        for part in rows:
            for counter, n in part.groupby("counter")["n"].sum().items():
                added[counter] = added.get(counter, 0) + int(n)
        before = {k[0]: v for k, v in self.counts.iterator()}
        totals = {c: (before[c][0] if c in before else 0) + added.get(c, 0) for c in {*before, *added}}
        updates = (self.updates.get()[0] if self.updates.exists() else 0) + 1
        self.updates.update((updates,))
        out = []
        for counter, n in sorted(totals.items()):
            had = bool(before[counter][1]) if counter in before else False
            over = counter != ROWS and n > self.share * totals[ROWS]
            self.counts.updateValue((counter,), (n, had or over))
            out.append((*key, counter, n, totals[ROWS], updates, over and not had))
        yield pd.DataFrame(out, columns=["target", "column", "counter", "n", "rows", "updates", "alert"])

    def close(self) -> None:
        pass


def start_issue_state(arrivals: DataFrame, schema: TargetSchema, output: str, checkpoint: str, share: float = 0.5,
                      available_now: bool = True) -> StreamingQuery:
    """Keep the counters of every bound column of ``schema`` while rows arrive; each batch writes the totals it changed."""
    spark = arrivals.sparkSession
    rows = cleaned(arrivals)
    plans = plan_repairs(rows, schema, mapping(resolve(rows.columns, schema)), transforms=False, by_column=False)
    totals = checked(rows, plans).groupBy("target", "column").transformWithStateInPandas(
        statefulProcessor=Totals(share), outputStructType=TOTALS, outputMode="Update", timeMode="None")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # the store that keyed state of several variables needs; the query keeps it
    try:
        writer = totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start() if available_now else writer.start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def current_issues(spark: SparkSession, output: str) -> DataFrame:
    """(target, column, counter, n, rows): the newest totals of every counter."""
    written = spark.read.schema(TOTALS + ", batch int").parquet(output)
    newest = written.groupBy("target", "column", "counter").agg(F.max_by(F.struct("n", "rows"), "updates").alias("at"))
    return newest.select("target", "column", "counter", "at.n", "at.rows")


def alerts(spark: SparkSession, output: str) -> DataFrame:
    """(batch, target, column, counter, n, rows): counters in the batch in which they first passed the share."""
    return spark.read.schema(TOTALS + ", batch int").parquet(output).where("alert").select("batch", "target", "column", "counter", "n", "rows")

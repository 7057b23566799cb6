"""Stage snapshots: a parquet copy of a table per stage, and a manifest with one row each."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablewright.sources.paths import delete_path, path_exists, tree_size

# Stage names.
STAGES = ["idle", "preprocessing", "diagnosing", "fix_attempt", "validating", "complete", "error"]
MANIFEST_SCHEMA = ("id string, stage string, timestamp timestamp, metadata string, has_data boolean, "
                   "rows bigint, columns int")


#: names, in the metadata of a snapshot, the stage and id whose data it shares
DATA_OF = "data_of"


class SnapshotStore:
    """Snapshots below a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def refer(self, stage: str, to: str, metadata: dict | None = None) -> str:
        """A snapshot whose data is that of an earlier one; nothing is written again."""
        known = self.manifest().where(F.col("id") == to).first()
        if known is None:
            raise ValueError(f"unknown snapshot {to!r}")
        owner = json.loads(known.metadata).get(DATA_OF, f"{known.stage}/{to}")
        return self._note(stage, datetime.now(timezone.utc), (metadata or {}) | {DATA_OF: owner},
                          known.has_data, known.rows, known["columns"])

    def create(self, stage: str, df: DataFrame | None = None, metadata: dict | None = None) -> str:
        """Write a snapshot and its manifest row; the data is complete before the row appears."""
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage!r}")
        now = datetime.now(timezone.utc)
        snapshot_id = now.strftime("%Y%m%d_%H%M%S_%f")
        rows = None
        if df is not None:
            path = self._data_path(stage, snapshot_id)
            df.write.parquet(path)
            rows = self.spark.read.parquet(path).count()  # footers only
        return self._note(stage, now, metadata or {}, df is not None, rows, len(df.columns) if df is not None else None)

    def _note(self, stage: str, now: datetime, metadata: dict, has_data: bool, rows: int | None, columns: int | None) -> str:
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage!r}")
        snapshot_id = now.strftime("%Y%m%d_%H%M%S_%f")
        line = [(snapshot_id, stage, now, json.dumps(metadata), has_data, rows, columns)]
        self.spark.createDataFrame(line, MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(self._manifest)
        return snapshot_id

    @property
    def _manifest(self) -> str:
        return f"{self.root}/manifest"

    def _data_path(self, stage: str, snapshot_id: str) -> str:
        return f"{self.root}/data/stage={stage}/id={snapshot_id}"

    def manifest(self) -> DataFrame:
        if not path_exists(self.spark, self._manifest):
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(self._manifest)

    def load(self, snapshot_id: str) -> tuple[dict, DataFrame | None] | None:
        """(info, data) of a snapshot; None when unknown."""
        return self._open(self.manifest().where(F.col("id") == snapshot_id))

    def latest(self) -> tuple[dict, DataFrame | None] | None:
        return self._open(latest(self.manifest()))

    def latest_of(self, stage: str) -> tuple[dict, DataFrame | None] | None:
        return self._open(latest_by_stage(self.manifest()).where(F.col("stage") == stage))

    def _open(self, found: DataFrame) -> tuple[dict, DataFrame | None] | None:
        row = found.first()
        if row is None:
            return None
        info = row.asDict()
        info["metadata"] = json.loads(info["metadata"])
        stage, owner = info["metadata"].get(DATA_OF, f"{row.stage}/{row.id}").split("/")
        data = self.spark.read.parquet(self._data_path(stage, owner)) if row.has_data else None
        return info, data

    def totals(self) -> dict:
        """Snapshot count and bytes on storage."""
        return {"count": self.manifest().count(), "bytes": tree_size(self.spark, self.root)}

    def clear(self) -> None:
        delete_path(self.spark, self.root)


def latest(manifest: DataFrame) -> DataFrame:
    """The newest row."""
    return manifest.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(1)


def latest_by_stage(manifest: DataFrame) -> DataFrame:
    """The newest row of every stage."""
    order = Window.partitionBy("stage").orderBy(F.col("timestamp").desc(), F.col("id").desc())
    return (manifest.withColumn("__at", F.row_number().over(order)).where(F.col("__at") == 1).drop("__at"))


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """(stage, snapshots, rows)."""
    return manifest.groupBy("stage").agg(F.count(F.lit(1)).alias("snapshots"), F.sum("rows").alias("rows"))


def log_totals(log: DataFrame) -> DataFrame:
    """(phase, entries, tokens) of an event log with (phase, token_count)."""
    return log.groupBy("phase").agg(F.count(F.lit(1)).alias("entries"), F.sum("token_count").alias("tokens"))


def attempt_numbers(attempts: DataFrame, run: str = "run_id", order: str = "iteration") -> DataFrame:
    """Number the attempts of each run; execution errors keep NULL and are not counted."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counts = F.col("error_kind").isNull() | (F.col("error_kind") != "execution")
    running = F.count_if(counts).over(w)
    return attempts.withColumn("attempt", F.when(counts, running))

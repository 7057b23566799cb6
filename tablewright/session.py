"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tablewright.sources.paths import delete_path, qualified

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: what a task that takes several small splits reads
TASK_BYTES = 8 << 20
_made: list[str] = []


def build_session(app_name: str = "tablewright", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library relies on; cluster settings stay untouched."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        # local mode runs everything in the driver's JVM
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can see: the cluster's checkpoint folder, with its file system named.

    Only where the cluster names none (local tests) is a fresh local folder used.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return qualified(spark, named).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="tablewright-")
    spark.sparkContext.setCheckpointDir(local)
    return qualified(spark, local)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this process has put below the shared folder; returns how many paths that were.

    For the end of a job: tables that still read those paths can no longer be used.
    """
    n = sum(delete_path(spark, path) for path in _made)
    _made.clear()
    return n


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Cuts lineage with a replicated copy, so a lost executor costs a re-read, not a recompute.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(scan: DataFrame) -> DataFrame:
    """Let a task take several splits of a plain scan, one after the other, where they are many and far smaller than TASK_BYTES.

    What a task costs of its own, and to start its Python, is then not paid for every split. Rows stay in the order of their splits.
    """
    named = re.fullmatch(r"\s*(\d+)\s*([bkmgtp]?)b?\s*", scan.sparkSession.conf.get("spark.sql.files.maxPartitionBytes").lower())
    most = int(named[1]) * 1024 ** "bkmgtp".index(named[2] or "b")
    splits, cores = scan.rdd.getNumPartitions(), scan.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-splits // max(1, TASK_BYTES // max(1, most))), 4 * cores)
    return scan.coalesce(tasks) if tasks < splits else scan


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a plain scan over all cores when its files give too few splits.

    Files of few row groups leave most cores idle in work that is heavy per row. A scan with at
    least one split per core is returned as it is, so large inputs are never shuffled for this.
    Only for plain scans: asking a plan with shuffles for its partitions would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)

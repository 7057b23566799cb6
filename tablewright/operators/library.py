"""The fix library: a table of fix attempts with vectors, kept as versioned parquet.

Every write makes a new version directory; readers take the highest version whose write finished.
Versions are never changed, so a reader is not disturbed and a failed write leaves no trace.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablewright.functions.text import head_with_dots
from tablewright.functions.vectors import VECTOR_SIZE, fit_length
from tablewright.operators.clean import quoted
from tablewright.operators.similarity import nearest
from tablewright.sources import archives
from tablewright.sources.paths import child_names, claim, delete_path, path_exists

LIBRARY_SCHEMA = (
    "id string, script_content string, status string, error_type string, source_file string, "
    "created_at string, execution_time double, error_message string, token_count int, "
    "fingerprint_tokens string, vector array<double>, vocab_id string")
STATUSES = ["SUCCESS", "FAILURE", "PENDING"]
_COLUMNS = [c.strip().split(" ")[0] for c in LIBRARY_SCHEMA.split(", ")]


def entries(attempts: DataFrame, size: int = VECTOR_SIZE, stored_tokens: int | None = None) -> DataFrame:
    """Library rows from attempts.

    Needs ``script_content``, ``status``, ``error_type``, ``source_file`` and ``tokens``; the rest is
    filled in: the id from the content, the vector padded to ``size``. All tokens are stored, as vectors
    are made anew from them after a refit, unless ``stored_tokens`` limits them.
    """
    have = set(attempts.columns)

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    vector = fit_length(F.col("vector").cast("array<double>") if "vector" in have
                        else F.lit(None).cast("array<double>"), size)
    tokens = F.coalesce("tokens", F.array().cast("array<string>"))
    created = given("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    made_id = F.sha2(F.concat_ws(
        "|", "script_content", "status", "error_type", "source_file", F.array_join(tokens, " "), created,
        given("variant", F.lit("")).cast("string")), 256)
    return attempts.select(
        given("id", F.substring(made_id, 1, 32)).alias("id"), "script_content", "status", "error_type",
        "source_file", created.alias("created_at"),
        given("execution_time", F.lit(0.0)).alias("execution_time"),
        given("error_message", F.lit("")).alias("error_message"),
        F.size(tokens).alias("token_count"),
        F.array_join(F.slice(tokens, 1, stored_tokens) if stored_tokens else tokens, " ").alias("fingerprint_tokens"),
        vector.alias("vector"), given("vocab_id", F.lit("")).alias("vocab_id"))


# operators on a library table

def with_status(library: DataFrame, status: str | None) -> DataFrame:
    return library if status is None else library.where(F.col("status") == status)


def add_new(library: DataFrame, new: DataFrame) -> DataFrame:
    """Entries whose id is not there yet are added; of several new rows with one id one is kept."""
    return library.unionByName(only_new(library, new))


def only_new(library: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of unknown ids; of several with one id the newest, ties by content."""
    order = Window.partitionBy("id").orderBy(F.desc("created_at"), "script_content", "status") if "created_at" in new.columns \
        else Window.partitionBy("id").orderBy(*[c for c in new.columns if c != "id"])
    one = new.withColumn("__order", F.row_number().over(order)).where("__order = 1").drop("__order")
    return one.join(library.select("id"), "id", "left_anti")


def update_status(library: DataFrame, updates: DataFrame) -> DataFrame:
    """Rows of ``updates`` (id, status, execution_time, error_message) change their entries; NULL keeps.

    Of several updates of an entry the last counts: by ``updated_at`` where there is one, ties by value.
    """
    have = set(updates.columns)
    fields = [c for c in ("status", "execution_time", "error_message") if c in have]
    order = [F.col("updated_at")] if "updated_at" in have else []
    last = updates.groupBy("id").agg(F.max(F.struct(*order, *[F.col(c).alias(f"__{c}") for c in fields])).alias("__last"))
    u = last.select("id", *[F.col(f"__last.__{c}").alias(f"__{c}") for c in fields])
    joined = library.join(u, "id", "left")
    return joined.select(*[
        F.coalesce(f"__{c}", quoted(c)).alias(c) if c in fields else quoted(c) for c in library.columns])


def delete(library: DataFrame, ids: DataFrame) -> DataFrame:
    return library.join(ids.select("id"), "id", "left_anti")


def lookup(library: DataFrame, ids: DataFrame) -> DataFrame:
    return library.join(ids.select("id").distinct(), "id", "left_semi")


def stats(library: DataFrame) -> DataFrame:
    """(kind, name, entries): the total, and counts by status and by error type, in one pass.

    The three statuses are always listed.
    """
    grouped = library.select(
        F.coalesce("status", F.lit("PENDING")).alias("status"), F.coalesce("error_type", F.lit("unknown")).alias("error_type")
    ).groupingSets([[F.col("status")], [F.col("error_type")], []], "status", "error_type").agg(
        F.count(F.lit(1)).alias("entries"), F.grouping_id().alias("level"))
    # grouping_id: bit 1 is set where the status, bit 0 where the error type is not a key
    kind = F.when(F.col("level") == 1, "status").when(F.col("level") == 2, "error_type").otherwise("total")
    counted = grouped.select(kind.alias("kind"), F.coalesce("status", "error_type", F.lit("")).alias("name"), "entries")
    listed = library.sparkSession.createDataFrame([("status", s) for s in STATUSES], "kind string, name string")
    return listed.join(counted, ["kind", "name"], "full").select(
        "kind", "name", F.coalesce("entries", F.lit(0).cast("bigint")).alias("entries"))


def nearest_entries(queries: DataFrame, library: DataFrame, k: int = 5, status: str | None = None,
                    vocab_id: str | None = None) -> DataFrame:
    """(query_id, id, distance, rank, script_content, status, error_type) by squared distance.

    With ``vocab_id`` only entries vectorised with that vocabulary are compared.
    """
    corpus = with_status(library, status)
    if vocab_id is not None:
        corpus = corpus.where(F.col("vocab_id") == vocab_id)
    hits = nearest(queries, corpus, k, metric="squared_l2").withColumnRenamed("score", "distance")
    details = corpus.select("id", "script_content", "status", "error_type")
    return hits.join(details, "id").select(
        "query_id", "id", "distance", "rank", "script_content", "status", "error_type")


def successful_scripts(queries: DataFrame, library: DataFrame, k: int = 3) -> DataFrame:
    return nearest_entries(queries, library, k, "SUCCESS").select("query_id", "rank", "id", "script_content")


def failed_scripts(queries: DataFrame, library: DataFrame, k: int = 3) -> DataFrame:
    return nearest_entries(queries, library, k, "FAILURE").select("query_id", "rank", "id", "script_content")


def advice(queries: DataFrame, library: DataFrame, avoid: int = 5, reuse: int = 3) -> DataFrame:
    """(query_id, advice, rank, id, text): near failures, shortened, to avoid and near successes to reuse."""
    bad = failed_scripts(queries, library, avoid).select(
        "query_id", F.lit("avoid").alias("advice"), "rank", "id", head_with_dots(F.col("script_content")).alias("text"))
    good = successful_scripts(queries, library, reuse).select(
        "query_id", F.lit("reuse").alias("advice"), "rank", "id", F.col("script_content").alias("text"))
    return bad.unionByName(good)


# export and import

def export_json(library: DataFrame, path: str) -> None:
    library.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LIBRARY_SCHEMA).json(path)


def read_bundles(spark: SparkSession, paths: list[str], size: int = VECTOR_SIZE) -> DataFrame:
    """Library rows from zip bundles with one folder per entry.

    A folder holds ``embedding.json``, ``script.py`` and ``metadata.json``; each may be missing.
    """
    members = archives.read_members(spark, paths)
    at = F.split("member", "/")
    parts = members.where(F.size(at) >= 2).select(
        F.element_at(at, -2).alias("id"), F.element_at(at, -1).alias("file"),
        F.decode("content", "UTF-8").alias("text"))
    # three files per folder: the pivot gathers three short texts per entry
    wide = parts.groupBy("id").pivot("file", ["embedding.json", "script.py", "metadata.json"]).agg(F.first("text"))
    meta = F.from_json("`metadata.json`", "status string, error_type string, source_file string, "
                       "created_at string, execution_time double, error_message string, token_count int, "
                       "fingerprint_tokens string, vocab_id string")
    rows = wide.select("id", F.coalesce("`script.py`", F.lit("")).alias("script_content"), meta.alias("m"),
                       fit_length(F.from_json("`embedding.json`", "array<double>"), size).alias("vector"))
    return rows.select(
        "id", "script_content", F.coalesce("m.status", F.lit("PENDING")).alias("status"), "m.error_type",
        "m.source_file", "m.created_at", "m.execution_time", "m.error_message", "m.token_count",
        "m.fingerprint_tokens", "vector", F.coalesce("m.vocab_id", F.lit("")).alias("vocab_id"))


def bundle_errors(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(archive, member, error) of what ``read_bundles`` could not read: bundles that are broken or cut off, members that are, and
    entries whose vector or metadata is no JSON. Its rows are those of the other entries and members."""
    members = archives.read_members(spark, paths)
    broken = members.where(F.col("error").isNotNull()).select("archive", "member", "error")
    text, file = F.decode("content", "UTF-8"), F.element_at(F.split("member", "/"), -1)
    vector, facts = F.from_json(text, "array<double>"), F.try_parse_json(text)
    bad = F.when(file == "embedding.json", vector.isNull()).when(file == "metadata.json", facts.isNull())
    malformed = members.where(F.col("error").isNull() & (F.size(F.split("member", "/")) >= 2) & F.coalesce(bad, F.lit(False)))
    return broken.unionByName(malformed.select("archive", "member", F.lit("not the JSON that is expected").alias("error")))


class FixLibrary:
    """A library at a path: full versions, and additions on top of them.

    Adding writes the new rows only; changing and deleting write a new full version. A reader takes
    the last full version and the additions after it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _finished(self) -> dict[int, str]:
        """Directory of each finished version, oldest first."""
        found = {}
        for name in child_names(self.spark, self.root):
            hit = re.fullmatch(r"v(\d{8})-(full|add)", name)
            if hit and path_exists(self.spark, f"{self.root}/{name}/_SUCCESS"):
                found[int(hit.group(1))] = name
        return dict(sorted(found.items()))

    def versions(self) -> list[int]:
        return list(self._finished())

    def read(self, version: int | None = None) -> DataFrame:
        parts: list[str] = []
        for number, name in self._finished().items():
            if version is not None and number > version:
                break
            parts = [name] if name.endswith("full") else [*parts, name]
        if not parts:
            return self.spark.createDataFrame([], LIBRARY_SCHEMA)
        return self.spark.read.schema(LIBRARY_SCHEMA).parquet(*[f"{self.root}/{p}" for p in parts])

    def _commit(self, make: Callable[[DataFrame], DataFrame], kind: str) -> int:
        """Write ``make(newest state)`` as the next version.

        A version number is claimed before writing by a file that can be made only once. Whoever finds it
        claimed starts again from the newer state, so no writer overwrites another's rows.
        """
        claimed = -1
        for _ in range(1000):
            known = self.versions()
            version = max(known[-1] if known else 0, claimed) + 1
            if not claim(self.spark, f"{self.root}/v{version:08d}-claim"):
                # taken: finished by now, still being written, or left by a writer that died
                claimed = version if version not in self.versions() and self._abandoned(version) else -1
                continue
            try:
                rows = make(self.read(version - 1))
                rows.select(*_COLUMNS).write.mode("errorifexists").parquet(f"{self.root}/v{version:08d}-{kind}")
            except BaseException:
                delete_path(self.spark, f"{self.root}/v{version:08d}-claim")
                raise
            return version
        raise RuntimeError(f"no version of {self.root} could be claimed")

    def _abandoned(self, version: int, patience: float = 600.0) -> bool:
        """Wait for the writer of a claimed version; true if it does not finish in time."""
        end = time.time() + patience
        while time.time() < end:
            if version in self.versions():
                return False
            time.sleep(0.2)
        return True

    def write(self, library: DataFrame) -> int:
        """A new full version."""
        return self._commit(lambda _: library, "full")

    def add(self, attempts: DataFrame) -> int:
        return self._commit(lambda known: only_new(known, entries(attempts)), "add")

    def import_rows(self, rows: DataFrame) -> int:
        """Add unknown entries; returns how many were new."""
        version = self._commit(lambda known: only_new(known, rows.select(*_COLUMNS)), "add")
        return self.spark.read.parquet(f"{self.root}/v{version:08d}-add").count()

    def update(self, updates: DataFrame) -> int:
        return self._commit(lambda known: update_status(known, updates), "full")

    def delete(self, ids: DataFrame) -> int:
        return self._commit(lambda known: delete(known, ids), "full")

    def compact(self) -> int:
        """Fold the additions into one full version."""
        return self._commit(lambda known: known, "full")

    def clear(self) -> int:
        return self.write(self.spark.createDataFrame([], LIBRARY_SCHEMA))

    def stats(self) -> DataFrame:
        return stats(self.read())

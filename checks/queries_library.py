"""The fix library: search, edits, statistics, export and import."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from checks.catalog import query, table
from checks.fixtures import LIBRARY, library
from tablewright.operators import library as lib
from tablewright.session import scratch_path
from tablewright.sources.files import open_path


def _queries(spark, sf_dir):
    """Every entry asks for its neighbours."""
    return library(spark, sf_dir).select("id", "vector")


def _near_sql(status: str | None, k: int) -> str:
    keep = f"WHERE c.status = '{status}'" if status else ""
    return f"""SELECT query_id, id, distance, rank, script_content, status, error_type FROM (
    SELECT q.id AS query_id, c.id AS id, round(list_distance(q.vector, c.vector) ** 2, 6) AS distance, c.script_content, c.status,
      c.error_type, CAST(row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.vector, c.vector), c.id) AS INTEGER) AS rank
    FROM lib q, lib c {keep}) WHERE rank <= {k}"""


@query(f"WITH {LIBRARY} {_near_sql(None, 5)}")
def library_nearest(spark, sf_dir):
    found = lib.nearest_entries(_queries(spark, sf_dir), library(spark, sf_dir), 5, vocab_id="v1")
    return found.withColumn("distance", F.round("distance", 6))


@query(f"WITH {LIBRARY} SELECT query_id, rank, id, script_content FROM ({_near_sql('SUCCESS', 3)})")
def library_topk_success(spark, sf_dir):
    return lib.successful_scripts(_queries(spark, sf_dir), library(spark, sf_dir))


@query(f"WITH {LIBRARY} SELECT query_id, rank, id, script_content FROM ({_near_sql('FAILURE', 3)})")
def library_topk_failure(spark, sf_dir):
    return lib.failed_scripts(_queries(spark, sf_dir), library(spark, sf_dir))


@query(f"""WITH {LIBRARY} SELECT query_id, 'avoid' AS advice, rank, id, left(script_content, 200) || '...' AS text FROM ({_near_sql('FAILURE', 5)})
UNION ALL SELECT query_id, 'reuse', rank, id, script_content FROM ({_near_sql('SUCCESS', 3)})""")
def library_advice(spark, sf_dir):
    return lib.advice(_queries(spark, sf_dir), library(spark, sf_dir))


@query(f"WITH {LIBRARY} SELECT id, script_content, status FROM lib WHERE status = 'FAILURE'")
def library_by_status(spark, sf_dir):
    return lib.with_status(library(spark, sf_dir), "FAILURE").select("id", "script_content", "status")


@query(f"""WITH {LIBRARY}, c AS (SELECT 'total' AS kind, '' AS name, count(*) AS entries FROM lib
  UNION ALL SELECT 'status', s, (SELECT count(*) FROM lib WHERE status = s) FROM (VALUES ('SUCCESS'), ('FAILURE'), ('PENDING')) v(s)
  UNION ALL SELECT 'error_type', error_type, count(*) FROM lib GROUP BY error_type) SELECT * FROM c""")
def library_stats(spark, sf_dir):
    return lib.stats(library(spark, sf_dir))


def _new_rows(spark, sf_dir):
    """Half of the ids are known, half are not."""
    return library(spark, sf_dir).withColumn(
        "id", F.when(F.substring("script_content", -1, 1).isin("0", "2", "4", "6", "8"), F.concat(F.lit("x"), "id")).otherwise(F.col("id")))


@query(f"WITH {LIBRARY} SELECT 'x' || id AS id, script_content FROM lib WHERE vec_id % 2 = 0")
def library_import_new(spark, sf_dir):
    return lib.only_new(library(spark, sf_dir), _new_rows(spark, sf_dir)).select("id", "script_content")


@query(f"WITH {LIBRARY} SELECT id, status FROM lib UNION ALL SELECT 'x' || id, status FROM lib WHERE vec_id % 2 = 0")
def library_add(spark, sf_dir):
    return lib.add_new(library(spark, sf_dir), _new_rows(spark, sf_dir)).select("id", "status")


@query(f"""WITH {LIBRARY} SELECT id, CASE WHEN vec_id % 3 = 2 THEN 'SUCCESS' ELSE status END AS status,
CASE WHEN vec_id % 3 = 2 THEN 9.5 ELSE execution_time END AS execution_time, error_message FROM lib""")
def library_update(spark, sf_dir):
    pending = library(spark, sf_dir).where(F.col("status") == "PENDING")
    updates = pending.select("id", F.lit("SUCCESS").alias("status"), F.lit(9.5).alias("execution_time"),
                             F.lit(None).cast("string").alias("error_message"))
    return lib.update_status(library(spark, sf_dir), updates).select("id", "status", "execution_time", "error_message")


@query(f"""WITH {LIBRARY} SELECT id, CASE WHEN vec_id % 2 = 0 THEN 'FAILURE' ELSE status END AS status,
CASE WHEN vec_id % 2 = 0 THEN 2.0 ELSE execution_time END AS execution_time FROM lib""")
def library_update_repeated(spark, sf_dir):
    """Each second entry is updated three times; the latest counts, and no entry is multiplied."""
    even = library(spark, sf_dir).where(F.pmod(F.regexp_extract("script_content", r"(\d+)$", 1).cast("bigint"), F.lit(2)) == 0)
    times = F.explode(F.array(*[F.struct(F.lit(at).alias("updated_at"), F.lit(s).alias("status"), F.lit(float(at)).alias("execution_time"))
                                for at, s in ((1, "SUCCESS"), (2, "FAILURE"), (0, "PENDING"))]))
    updates = even.select("id", times.alias("u")).select("id", "u.*")
    return lib.update_status(library(spark, sf_dir), updates).select("id", "status", "execution_time")


@query(f"WITH {LIBRARY} SELECT id FROM lib WHERE vec_id % 3 <> 1")
def library_delete(spark, sf_dir):
    whole = library(spark, sf_dir)
    return lib.delete(whole, whole.where(F.col("status") == "FAILURE")).select("id")


@query(f"WITH {LIBRARY} SELECT id, script_content, status, error_type FROM lib")
def library_lookup(spark, sf_dir):
    ids = library(spark, sf_dir).select(F.explode(F.array("id", F.concat(F.lit("x"), "id"))).alias("id"))  # half are unknown
    return lib.lookup(library(spark, sf_dir), ids).select("id", "script_content", "status", "error_type")


@query(f"""WITH {LIBRARY} SELECT id, script_content, status, error_type, CAST(k - 1 AS INTEGER) AS pos, vector[k] AS element
FROM lib, range(1, len(vector) + 1) r(k)""")
def library_json_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "library-json")
    lib.export_json(library(spark, sf_dir), path)
    return lib.read_json(spark, path).select("id", "script_content", "status", "error_type", F.posexplode("vector").alias("pos", "element"))


@query(f"""WITH {LIBRARY} SELECT id, CASE WHEN vec_id % 3 = 2 THEN 'FAILURE' ELSE status END AS status FROM lib WHERE vec_id % 3 <> 1""")
def library_versions(spark, sf_dir):
    """Written, updated and thinned out through the versioned table."""
    store = lib.FixLibrary(spark, scratch_path(spark, "library"))
    whole = library(spark, sf_dir)
    store.import_rows(whole)
    store.import_rows(whole)  # nothing new
    store.update(whole.where(F.col("status") == "PENDING").select("id", F.lit("FAILURE").alias("status")))
    store.delete(whole.where(F.col("status") == "FAILURE"))
    return store.read().select("id", "status")


@query(f"""WITH {LIBRARY} SELECT script_content, status, 2::INTEGER AS token_count, 'COL_0_INT DF_CLEAN' AS fingerprint_tokens,
len(vector) AS dims, 1000::BIGINT AS stored_dims, vector[1] AS first FROM lib""")
def library_entries(spark, sf_dir):
    attempts = library(spark, sf_dir).select(
        "script_content", "status", "error_type", "source_file", "created_at", "vector",
        F.split("fingerprint_tokens", " ").alias("tokens"), F.size("vector").cast("bigint").alias("dims"))
    widths = attempts.select("script_content", "dims").distinct()
    stored = lib.entries(attempts)
    return stored.join(widths, "script_content").select("script_content", "status", "token_count", "fingerprint_tokens", "dims",
                         F.size("vector").cast("bigint").alias("stored_dims"), F.col("vector")[0].alias("first"))


@query(f"""WITH {LIBRARY} SELECT id, script_content, status, error_type, CAST(k - 1 AS INTEGER) AS pos,
CASE WHEN vec_id % 5 = 0 THEN 0.0 ELSE coalesce(vector[k], 0.0) END AS element FROM lib, range(1, 1001) r(k)""")
def library_bundle_import(spark, sf_dir):
    """Entries packed as zip bundles, some without a vector, and imported again."""
    folder = scratch_path(spark, "bundles")

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in batch.itertuples(index=False):
                if r.number % 5:
                    z.writestr(f"{r.id}/embedding.json", json.dumps([float(x) for x in r.vector]))
                z.writestr(f"{r.id}/script.py", r.script_content)
                z.writestr(f"{r.id}/metadata.json", json.dumps({"status": r.status, "error_type": r.error_type}))
        path = f"{folder}/bundle{int(batch['bundle'].iloc[0])}.zip"
        system, inner = open_path(path)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(inner, compression=None) as stream:
            stream.write(out.getvalue())
        return pd.DataFrame({"path": [path]})

    number = F.regexp_extract("script_content", r"(\d+)$", 1).cast("bigint")
    rows = library(spark, sf_dir).withColumn("number", number).withColumn("bundle", F.floor(F.col("number") / 100))
    # a bundle takes a hundred entries, however many there are
    rows.groupBy("bundle").applyInPandas(pack, "path string").count()
    return lib.read_bundles(spark, [folder]).select(
        "id", "script_content", "status", "error_type", F.posexplode("vector").alias("pos", "element"))


@query("""SELECT 'bundle' || (c_custkey // 50) || '.zip' AS archive, 'entry' || c_custkey || '/embedding.json' AS member, 'not the JSON that is expected' AS error
FROM customer WHERE c_custkey % 11 = 0 AND (c_custkey // 50) % 3 <> 1
UNION ALL SELECT DISTINCT 'bundle' || (c_custkey // 50) || '.zip', '', 'cannot be read' FROM customer WHERE (c_custkey // 50) % 3 = 1""")
def library_bundle_errors(spark, sf_dir):
    """Bundles of which some are cut off and some hold a malformed vector: each is told."""
    folder = scratch_path(spark, "bundles")

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for key in batch["key"]:
                z.writestr(f"entry{key}/embedding.json", "[1.0, 2.0" if key % 11 == 0 else "[1.0, 2.0]")
                z.writestr(f"entry{key}/script.py", f"step {key}")
        number = int(batch["bundle"].iloc[0])
        data = out.getvalue()[:-40] if number % 3 == 1 else out.getvalue()
        path = f"{folder}/bundle{number}.zip"
        system, inner = open_path(path)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(inner, compression=None) as stream:
            stream.write(data)
        return pd.DataFrame({"path": [path]})

    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.floor(F.col("c_custkey") / 50).alias("bundle"))
    rows.groupBy("bundle").applyInPandas(pack, "path string").count()
    found = lib.bundle_errors(spark, [folder])
    # what the reader of the archive says is its own; that it says it is what counts
    whole = F.col("error").startswith("not the JSON")
    return found.select(F.element_at(F.split("archive", "/"), -1).alias("archive"), F.coalesce(F.when(whole, F.col("member")), F.lit("")).alias("member"),
                        F.when(whole, F.col("error")).otherwise("cannot be read").alias("error"))

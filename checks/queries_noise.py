"""Synthetic noise: chosen cells, corruptions, logs, variants and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.catalog import query, table
from tablewright.operators import exact_noise
from tablewright.operators import noise
from tablewright.operators.noise import NoiseSettings
from tablewright.plans import sweep

COLUMNS = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
NUMERIC = {"p_size": True, "p_retailprice": False}  # column: whole numbers


def _part(spark, sf_dir):
    """Texts with gaps and gene symbols, a whole and a fractional number."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("row_id"), "p_name", F.when(k % 11 == 0, "tp53").otherwise(F.col("p_brand")).alias("p_brand"),
        F.when(k % 13 != 0, F.col("p_type")).alias("p_type"), "p_size", "p_retailprice")


PART = """
prt AS (SELECT p_partkey AS row_id, p_name, CASE WHEN p_partkey % 11 = 0 THEN 'tp53' ELSE p_brand END AS p_brand,
  CASE WHEN p_partkey % 13 <> 0 THEN p_type END AS p_type, p_size, p_retailprice FROM part)
"""


def _lane(h: str, i: int) -> str:
    return f"('0x' || substr({h}, {8 * i + 1}, 8))::BIGINT"


def _unit(h: str, i: int) -> str:
    return f"({_lane(h, i)} / 4294967296.0::DOUBLE)"


def _cells(source: str, key: str, variants: str = "") -> str:
    """One row per cell: column, text, and the two digests of its address."""
    var = "CAST(variant AS VARCHAR) || '|' || " if variants else ""
    keep = "variant, ratio, " if variants else ""
    return " UNION ALL ".join(
        f"""SELECT {keep}row_id, '{c}' AS c, CAST({c} AS VARCHAR) AS s,
        {f'CAST({c} AS DOUBLE)' if c in NUMERIC else 'CAST(NULL AS DOUBLE)'} AS x, {str(NUMERIC.get(c, False)).lower()} AS whole,
        md5('{key}|' || {var}CAST(row_id AS VARCHAR) || '|{c}') AS h,
        md5('{key}|' || {var}CAST(row_id AS VARCHAR) || '|{c}|more') AS h2 FROM {source}""" for c in COLUMNS)


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
NEAR = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in noise.NEIGHBOUR_KEYS.items()) + "}"
CONFUSED = "map {" + ", ".join(f"'{k}': {v}" for k, v in noise.SYMBOL_CONFUSIONS.items()) + "}"
NUMBER = r"'^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$'"


def _changes(hits: str, kinds: list[str]) -> str:
    """CTEs that corrupt the chosen cells ``hits`` (c, s, x, whole, h, h2, ...), ending in ``changed``."""
    kind = f"({kinds})[({_lane('h', 1)} % {len(kinds)}) + 1]"
    return f"""
d AS (SELECT *, {kind} AS noise_type, length(s) AS n, {_lane('h', 2)} AS a, {_lane('h', 3)} AS b, {_lane('h2', 0)} AS e FROM {hits}),
g AS (SELECT *, b % greatest(n - 1, 1) AS swp, b % greatest(n, 1) AS pos, b % (n + 1) AS ins,
  substr('{LETTERS}', (e % 52 + 1)::INTEGER, 1) AS letter, ({noise.PREFIXES})[b % 4 + 1] AS prefix,
  ({noise.PLACEHOLDERS})[b % 7 + 1] AS placeholder, replace(left(s, 5), ',', '.') AS head,
  {CONFUSED}[upper(s)] AS conf FROM d),
k AS (SELECT *, substr(s, (pos + 1)::INTEGER, 1) AS here, {NEAR}[lower(substr(s, (pos + 1)::INTEGER, 1))] AS near FROM g),
m AS (SELECT *, substr(near, (e % length(near) + 1)::INTEGER, 1) AS near1 FROM k),
z AS (SELECT *, CASE WHEN here <> lower(here) THEN upper(near1) ELSE near1 END AS key2,
  CASE WHEN regexp_matches(head, {NUMBER}) THEN TRY_CAST(trim(head) AS DOUBLE) END AS num FROM m),
changed AS (SELECT *, CASE noise_type
  WHEN 'typo' THEN CASE WHEN s IS NULL OR n < 2 THEN s
    WHEN a % 4 = 0 THEN substr(s, 1, swp::INTEGER) || substr(s, (swp + 2)::INTEGER, 1) || substr(s, (swp + 1)::INTEGER, 1) || substr(s, (swp + 3)::INTEGER)
    WHEN a % 4 = 1 THEN substr(s, 1, pos::INTEGER) || substr(s, (pos + 2)::INTEGER)
    WHEN a % 4 = 2 THEN substr(s, 1, ins::INTEGER) || letter || substr(s, (ins + 1)::INTEGER)
    WHEN near IS NULL THEN s ELSE substr(s, 1, pos::INTEGER) || key2 || substr(s, (pos + 2)::INTEGER) END
  WHEN 'semantic' THEN CASE WHEN s IS NULL THEN s WHEN conf IS NOT NULL THEN conf[b % len(conf) + 1]
    WHEN x IS NOT NULL AND whole THEN CAST(x::BIGINT + ([-2, -1, 1, 2])[b % 4 + 1] AS VARCHAR)
    WHEN x IS NOT NULL THEN 'drift'
    WHEN a % 3 = 0 THEN array_to_string(list_transform(string_split(s, ''), lambda ch: CASE WHEN ch = upper(ch) THEN lower(ch) ELSE upper(ch) END), '')
    WHEN a % 3 = 1 AND n > 3 THEN left(s, (n - 1 - b % 2)::INTEGER) ELSE prefix || s END
  ELSE CASE a % 4 WHEN 0 THEN NULL
    WHEN 1 THEN CASE WHEN x IS NOT NULL THEN 'VALUE_' || s WHEN num IS NOT NULL THEN CAST(num AS VARCHAR) ELSE '99999' END
    WHEN 2 THEN '' ELSE placeholder END END AS modified,
  CASE noise_type
  WHEN 'typo' THEN CASE WHEN s IS NULL THEN 'skipped_nan' WHEN n < 2 THEN 'too_short'
    WHEN a % 4 = 0 THEN 'swapped chars at ' || swp WHEN a % 4 = 1 THEN 'deleted char at ' || pos
    WHEN a % 4 = 2 THEN 'inserted ''' || letter || ''' at ' || ins WHEN near IS NULL THEN 'no_adjacent_found'
    ELSE 'adjacent key ''' || lower(here) || ''' -> ''' || key2 || '''' END
  WHEN 'semantic' THEN CASE WHEN s IS NULL THEN 'skipped_nan'
    WHEN conf IS NOT NULL THEN 'gene_confusion: ' || upper(s) || ' -> ' || conf[b % len(conf) + 1]
    WHEN x IS NOT NULL AND whole THEN 'int_drift: ' || s || ' -> ' || CAST(x::BIGINT + ([-2, -1, 1, 2])[b % 4 + 1] AS VARCHAR)
    WHEN x IS NOT NULL THEN 'float_drift: ' || s || ' -> ' || printf('%.4f', x + ((b / 4294967296.0::DOUBLE) * 0.2::DOUBLE - 0.1::DOUBLE) *
      CASE WHEN x <> 0 THEN abs(x) ELSE 1.0 END)
    WHEN a % 3 = 0 THEN 'case_swap' WHEN a % 3 = 1 AND n > 3 THEN 'truncated' ELSE 'added_prefix: ''' || prefix || '''' END
  ELSE CASE a % 4 WHEN 0 THEN 'injected_nan'
    WHEN 1 THEN CASE WHEN x IS NOT NULL THEN 'num_to_str' WHEN num IS NOT NULL THEN 'str_to_num' ELSE 'forced_num' END
    WHEN 2 THEN 'empty_string' ELSE 'placeholder: ' || placeholder END END AS modification FROM z)
"""


def _log_rows(log):
    """Drifted floats are compared by their 4-digit note: the engines print doubles differently."""
    drifted = F.startswith("modification", F.lit("float_drift"))
    return log.withColumn("modified", F.when(drifted, "drift").otherwise(F.col("modified")))


@query(f"""WITH {PART}, cells AS ({_cells("prt", "11")}), hits AS (SELECT * FROM cells WHERE {_unit("h", 0)} < 0.2), {_changes("hits", noise.KINDS)}
SELECT row_id, c AS "column", s AS original, modified, noise_type, modification FROM changed""")
def noise_log(spark, sf_dir):
    return _log_rows(noise.noise_log(_part(spark, sf_dir), NoiseSettings(0.2, seed=11)))


@query(f"""WITH {PART}, cells AS ({_cells("prt", "12")}),
hits AS (SELECT * FROM cells WHERE {_unit("h", 0)} < 0.3 AND c IN ('p_name', 'p_brand', 'p_type')), {_changes("hits", ["typo", "structural"])}
SELECT prt.row_id, CASE WHEN a.h IS NOT NULL THEN a.modified ELSE p_name END AS p_name,
  CASE WHEN b.h IS NOT NULL THEN b.modified ELSE p_brand END AS p_brand,
  CASE WHEN t.h IS NOT NULL THEN t.modified ELSE p_type END AS p_type
FROM prt LEFT JOIN (SELECT * FROM changed WHERE c = 'p_name') a ON a.row_id = prt.row_id
LEFT JOIN (SELECT * FROM changed WHERE c = 'p_brand') b ON b.row_id = prt.row_id
LEFT JOIN (SELECT * FROM changed WHERE c = 'p_type') t ON t.row_id = prt.row_id""")
def noise_table(spark, sf_dir):
    df = _part(spark, sf_dir).drop("p_size", "p_retailprice")
    return noise.inject(df, NoiseSettings(0.3, kinds=["typo", "structural"], seed=12))


@query(f"""WITH {PART}, cells AS ({_cells("prt", "13")}), hits AS (SELECT * FROM cells WHERE
  {_unit("h", 0)} < CASE c WHEN 'p_name' THEN 0.25::DOUBLE WHEN 'p_type' THEN 0.25::DOUBLE ELSE 0.0 END), {_changes("hits", ["typo"])}
SELECT row_id, c AS "column", s AS original, modified, noise_type, modification FROM changed""")
def noise_targeted(spark, sf_dir):
    """Two of five columns take the noise meant for all five."""
    _, log = noise.test_noise(_part(spark, sf_dir), 0.1, ["typo"], ["p_name", "p_type"], seed=13)
    return log


@query(f"""WITH {PART}, cells AS ({_cells("prt", "14")}), hits AS (SELECT * FROM cells WHERE
  {_unit("h", 0)} < CASE c WHEN 'p_brand' THEN least(1.0::DOUBLE, 0.1::DOUBLE * 5 * 6.0::DOUBLE / 10.0::DOUBLE)
    ELSE 0.1::DOUBLE * 5 * 1.0::DOUBLE / 10.0::DOUBLE END), {_changes("hits", ["structural"])}
SELECT c AS "column", modification, count(*) AS cells FROM changed GROUP BY ALL""")
def noise_weighted(spark, sf_dir):
    settings = NoiseSettings(0.1, "weighted", weights={"p_brand": 6.0}, kinds=["structural"], seed=14)
    log = noise.noise_log(_part(spark, sf_dir), settings)
    return log.groupBy("column", "modification").agg(F.count(F.lit(1)).alias("cells"))


@query(f"""WITH {PART}, cells AS ({_cells("prt", "11")}) SELECT count(*) AS cells_modified,
round(count(*) / ((SELECT count(*) FROM prt) * 5.0::DOUBLE), 9) AS ratio_actual, array_to_string(list_sort(list(DISTINCT c)), ',') AS columns_affected
FROM cells WHERE {_unit("h", 0)} < 0.2""")
def noise_summary(spark, sf_dir):
    df = _part(spark, sf_dir)
    log = noise.noise_log(df, NoiseSettings(0.2, seed=11))
    return noise.noise_summary(log, df.count(), 5).select(
        "cells_modified", F.round("ratio_actual", 9).alias("ratio_actual"), F.array_join("columns_affected", ",").alias("columns_affected"))


RATIOS = noise.variation_ratios(NoiseSettings(0.1, seed=15), 5)
GRID = noise.sweep_grid(2, 10, 2, 3)


def _variant_rows(pairs):
    return "(VALUES " + ", ".join(f"({v}, {r!r}::DOUBLE)" for v, r, *_ in pairs) + ") v(variant, ratio)"


@query(f"""WITH {PART}, many AS (SELECT prt.*, variant, ratio FROM prt, {_variant_rows(RATIOS)}),
cells AS ({_cells("many", "15", "v")}), hits AS (SELECT * FROM cells WHERE {_unit("h", 0)} < ratio), {_changes("hits", ["typo"])}
SELECT variant, many.row_id, coalesce(t.modified, p_type) AS p_type FROM many
LEFT JOIN (SELECT * FROM changed WHERE c = 'p_type') t USING (variant, row_id)""")
def noise_variations(spark, sf_dir):
    """Five variants of one table; the text column is compared."""
    settings = NoiseSettings(0.1, kinds=["typo"], seed=15)
    return noise.noisy_variations(_part(spark, sf_dir), settings, 5).select("variant", "row_id", "p_type")


@query(f"""WITH {PART}, many AS (SELECT prt.*, variant, ratio FROM prt, {_variant_rows(GRID)}),
cells AS ({_cells("many", "16", "v")}) SELECT variant, count(*) AS cells_modified FROM cells WHERE {_unit("h", 0)} < ratio GROUP BY variant""")
def noise_sweep_counts(spark, sf_dir):
    return sweep.variant_changes(_part(spark, sf_dir), GRID, NoiseSettings(seed=16))


@query(f"""WITH {PART}, many AS (SELECT prt.*, variant, ratio FROM prt, {_variant_rows(GRID)}),
cells AS ({_cells("many", "16", "v")}), n AS (SELECT variant, ratio, count(*) AS hits FROM cells WHERE {_unit("h", 0)} < ratio GROUP BY ALL)
SELECT variant, 'noise_typo_' || CAST(round(ratio * 100) AS INTEGER) || '%' AS error_type, 'PENDING' AS status,
'# Synthetic variant. Table: 5 columns; noise ratio ' || printf('%.4f', ratio) || '; kinds typo, semantic, structural; cells modified ' || hits AS script_content
FROM n""")
def noise_sweep(spark, sf_dir):
    attempts, _ = sweep.noise_sweep(_part(spark, sf_dir), GRID, NoiseSettings(seed=16))
    return attempts.select("variant", "error_type", "status", "script_content")


def noise_sweep_fingerprints(spark, sf_dir):
    """Tokens of every variant; token rules have SQL of their own."""
    return sweep.variant_fingerprints(_part(spark, sf_dir), GRID, NoiseSettings(seed=16)).select("variant", "token_string")


query()(noise_sweep_fingerprints)


_CELLS = """SELECT c_custkey AS row_id, unnest(['c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS "column" FROM customer"""
_DIGEST = """('0x' || substr(md5(concat_ws('|', '7', row_id, "column", 'choice')), 1, 13))::BIGINT"""


@query(f"""WITH cells AS ({_CELLS}), ranked AS (SELECT *, {_DIGEST} AS d FROM cells),
n AS (SELECT CAST(floor(round(0.03 * count(*), 6)) AS BIGINT) AS n FROM cells)
SELECT 'uniform' AS mode, row_id, "column", n AS touched FROM (SELECT *, row_number() OVER (ORDER BY d DESC) AS k FROM ranked), n WHERE k <= n
UNION ALL SELECT 'targeted', row_id, "column", n FROM (SELECT *, row_number() OVER (ORDER BY d DESC) AS k FROM ranked WHERE "column" IN ('c_name', 'c_acctbal')), n WHERE k <= n""")
def noise_exact(spark, sf_dir):
    """The wanted number of cells to the cell, and which: those of the least digests."""
    df = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "row_id")
    kinds = [NoiseSettings(ratio=0.03, seed=7), NoiseSettings(ratio=0.03, seed=7, mode="targeted", targets=["c_name", "c_acctbal"])]
    out = None
    for settings in kinds:
        log = exact_noise.exact_log(df, settings)
        one = log.select(F.lit(settings.mode).alias("mode"), "row_id", "column").join(F.broadcast(log.agg(F.count("*").alias("touched"))))
        out = one if out is None else out.unionByName(one)
    return out

"""Dirty tables derived from the given ones by arithmetic on their keys, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.catalog import table
from tablewright.plans.schema import STANDARD, TargetColumn, TargetSchema

SYMBOLS = ["BRCA1", "BRCA2", "TP53", "EGFR", "KRAS", "MYC", "AKT1"]
TEXT_COLUMNS = ["Gene_ID", "log2FC", "adj_p", "is_sig", "visit", "note", "blank", " site "]


def every(n: int):
    return F.col("event_id") % n == 0


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expression table: every column but the key is text, as read from a file."""
    ev = table(spark, sf_dir, "events")
    e, value = F.col("event_id"), F.col("value").cast("string")
    symbol = F.element_at(F.array(*[F.lit(s) for s in SYMBOLS]), (e % 7 + 1).cast("int"))
    return ev.select(
        e.alias("row_id"),
        F.when(every(41), F.lit(None)).when(every(37), "NA").when(every(31), F.concat(F.lit("_"), symbol))
        .when(every(29), F.concat(symbol, F.lit("!!")))
        .when(every(23), F.concat(F.lit("  "), symbol, F.lit("  "))).when(every(19), F.lower(symbol))
        .when(every(17), F.concat(symbol, F.lit("\t"))).otherwise(symbol).alias("Gene_ID"),
        F.when(every(43), "N/A").when(every(39), F.concat(F.lit("VALUE_"), e.cast("string")))
        .when(every(33), "1d").when(every(27), F.concat(F.lit("-"), value)).otherwise(value).alias("log2FC"),
        F.when(every(47), "").when(every(50), "1.5").when(every(53), "-0.1")
        .otherwise(F.format_string("%.4f", F.round(F.col("value") / 500, 4))).alias("adj_p"),
        F.when(every(11), "T").when(every(13), "0").when(every(59), "maybe")
        .otherwise(F.when(every(2), "yes").otherwise("no")).alias("is_sig"),
        F.when(every(61), "31/02/2024").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("visit"),
        F.when(every(2), "").otherwise(" ").alias("note"),
        F.lit(None).cast("string").alias("blank"),
        F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")).alias(" site "),
    )


MESSY = """
messy AS (
  SELECT event_id AS row_id,
    CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 37 = 0 THEN 'NA'
         WHEN event_id % 31 = 0 THEN '_' || sym WHEN event_id % 29 = 0 THEN sym || '!!'
         WHEN event_id % 23 = 0 THEN '  ' || sym || '  ' WHEN event_id % 19 = 0 THEN lower(sym)
         WHEN event_id % 17 = 0 THEN sym || chr(9) ELSE sym END AS "Gene_ID",
    CASE WHEN event_id % 43 = 0 THEN 'N/A' WHEN event_id % 39 = 0 THEN 'VALUE_' || event_id
         WHEN event_id % 33 = 0 THEN '1d' WHEN event_id % 27 = 0 THEN '-' || CAST(value AS VARCHAR)
         ELSE CAST(value AS VARCHAR) END AS "log2FC",
    CASE WHEN event_id % 47 = 0 THEN '' WHEN event_id % 50 = 0 THEN '1.5' WHEN event_id % 53 = 0 THEN '-0.1'
         ELSE printf('%.4f', round(value / 500, 4)) END AS adj_p,
    CASE WHEN event_id % 11 = 0 THEN 'T' WHEN event_id % 13 = 0 THEN '0' WHEN event_id % 59 = 0 THEN 'maybe'
         WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS is_sig,
    CASE WHEN event_id % 61 = 0 THEN '31/02/2024' ELSE strftime(ts, '%Y-%m-%d') END AS visit,
    CASE WHEN event_id % 2 = 0 THEN '' ELSE ' ' END AS note,
    CAST(NULL AS VARCHAR) AS blank,
    'S' || (user_id % 3) AS " site "
  FROM (SELECT *, (['BRCA1','BRCA2','TP53','EGFR','KRAS','MYC','AKT1'])[(event_id % 7) + 1] AS sym FROM events))
"""


def messy_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expression table without its key, some rows repeated."""
    base = messy(spark, sf_dir)
    return base.unionByName(base.where(F.col("row_id") % 101 == 0)).drop("row_id")


MESSY_TWICE = MESSY + """,
twice AS (
  SELECT * EXCLUDE (row_id) FROM messy UNION ALL
  SELECT * EXCLUDE (row_id) FROM messy WHERE row_id % 101 = 0)
"""

# the same table after missing-value literals, trimming and name cleaning, SQL side
NA_LIST = ("('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', "
           "'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')")


def _sql_null(c: str) -> str:
    return f"""CASE WHEN "{c}" NOT IN {NA_LIST} THEN "{c}" END"""


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
NULLED = MESSY + ",\nnulled AS (SELECT row_id, " + ", ".join(
    f'{_sql_null(c)} AS "{c}"' for c in TEXT_COLUMNS) + " FROM messy)"
# only the columns that are kept; copies of a row keep the lowest key
CLEANED = NULLED + """,
cleaned AS (
  SELECT min(row_id) AS row_id, "Gene_ID", "log2FC", adj_p, is_sig, visit, site FROM (
    SELECT row_id, """ + ", ".join(
    f'trim("{c}", {SPACES}) AS "{c.strip()}"' for c in ["Gene_ID", "log2FC", "adj_p", "is_sig", "visit", " site "]
) + """ FROM nulled) GROUP BY ALL)
"""

NUMBER = r"'^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$'"


def sql_number(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, {NUMBER}) THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def sql_bool(c: str) -> str:
    return (f"CASE WHEN lower({c}) IN ('true','yes','1','t','y') THEN true "
            f"WHEN lower({c}) IN ('false','no','0','f','n') THEN false END")


def sql_repair(c: str) -> str:
    """Repair of a symbol that breaks the builtin pattern."""
    return (f"CASE WHEN regexp_matches({c}, '^[A-Za-z][A-Za-z0-9-]*$') THEN {c} ELSE "
            f"regexp_replace(regexp_replace(trim({c}, {SPACES}), '^[^A-Za-z]+', ''), '[^A-Za-z0-9-]+$', '') END")


# schemas

FULL = TargetSchema(
    name="full", columns=[
        *STANDARD.columns,
        TargetColumn("Significant", "bool", source="is_sig", required=False),
        TargetColumn("Visit", "date", required=False),
        TargetColumn("Site", "string", required=False, default_value="S0"),
        TargetColumn("FC_log2", "float", source="log2FC", required=False, transform="log2"),
        TargetColumn("P_bh", "float", required=False, transform="fdr_benjamini_hochberg",
                     stat_test_source_column="adj_p"),
        TargetColumn("P_by", "float", required=False, transform="fdr_benjamini_yekutieli",
                     stat_test_source_column="adj_p"),
        TargetColumn("P_bonf", "float", required=False, transform="bonferroni", stat_test_source_column="adj_p"),
        TargetColumn("P_holm", "float", required=False, transform="holm_bonferroni",
                     stat_test_source_column="adj_p"),
        TargetColumn("Batch", "int", required=False, default_value=7),
    ])

STRICT = TargetSchema(
    name="strict", columns=[
        TargetColumn("GeneSymbol", "string", validation_regex=r"^[A-Z][A-Z0-9]*$"),
        TargetColumn("Dose", "float", required=True),
        TargetColumn("Batch", "int", required=False),
        TargetColumn("FoldChange", "int", required=False, min_value=1.0, max_value=300.0),
        TargetColumn("PValue", "float", min_value=0.0, max_value=1.0),
    ])


def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, p): many ties, some NULL, some outside [0, 1]."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("row_id"),
        F.when(every(47), F.lit(None).cast("double")).when(every(50), F.lit(1.5)).when(every(53), F.lit(-0.1))
        .otherwise(F.round(F.col("value") / 500, 4)).alias("p"))


P_VALUES = """
raw_p AS (
  SELECT event_id AS row_id, CASE WHEN event_id % 47 = 0 THEN NULL WHEN event_id % 50 = 0 THEN 1.5
    WHEN event_id % 53 = 0 THEN -0.1 ELSE round(value / 500, 4) END AS p FROM events),
pv AS (SELECT row_id, CASE WHEN p < 0 THEN 0.0 WHEN p > 1 THEN 1.0 ELSE p END AS p FROM raw_p)
"""


def adjusted_sql(source: str = "pv") -> str:
    """CTEs that adjust column p of ``source`` over the whole table, ending in ``adjusted``."""
    return f"""
tests AS (SELECT p, n, sum(n) OVER (ORDER BY p) AS upto, CAST(sum(n) OVER () AS DOUBLE) AS m
          FROM (SELECT p, count(*) AS n FROM {source} WHERE p IS NOT NULL GROUP BY p)),
har AS (SELECT sum(1.0::DOUBLE / k) AS h FROM range(1, (SELECT CAST(max(m) AS BIGINT) + 1 FROM tests)) t(k)),
steps AS (SELECT p, m, min(p * m / upto) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS low,
                 max(p * (m - (upto - n))) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS high FROM tests),
adjusted AS (SELECT p, round(least(low, 1.0), 9) AS bh, round(least(low * h, 1.0), 9) AS "by",
                    round(least(p * m, 1.0), 9) AS bonferroni, round(least(high, 1.0), 9) AS holm FROM steps, har)
"""


# the fix library

def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("e"), F.lpad(v.cast("string"), 6, "0")).alias("id"),
        F.concat(F.lit("script "), v.cast("string")).alias("script_content"),
        F.element_at(F.array(F.lit("SUCCESS"), F.lit("FAILURE"), F.lit("PENDING")), (v % 3 + 1).cast("int")).alias("status"),
        F.concat(F.lit("error_"), F.col("label").cast("string")).alias("error_type"),
        F.lit("fixture").alias("source_file"), F.lit("2024-01-01T00:00:00").alias("created_at"),
        (v % 10 / 10.0).alias("execution_time"), F.lit("").alias("error_message"),
        (v % 50).cast("int").alias("token_count"), F.lit("COL_0_INT DF_CLEAN").alias("fingerprint_tokens"),
        F.col("embedding").cast("array<double>").alias("vector"), F.lit("v1").alias("vocab_id"))


LIBRARY = """
lib AS (
  SELECT 'e' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS id, 'script ' || vec_id AS script_content,
    (['SUCCESS','FAILURE','PENDING'])[(vec_id % 3) + 1] AS status, 'error_' || label AS error_type,
    vec_id, CAST(embedding AS DOUBLE[]) AS vector, (vec_id % 10) / 10.0::DOUBLE AS execution_time, '' AS error_message
  FROM embeddings)
"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(resp_id, text): model answers of five shapes around the given texts."""
    d = F.col("doc_id")
    quoted_text = F.regexp_replace(F.col("text"), r'[\\"\x00-\x1f{}`]', " ")
    body = F.concat(F.lit('{"is_valid": true, "overall_quality_score": 0.75, "issues": [{"column": "c'), (d % 7).cast("string"),
                    F.lit('", "issue_type": "null_values", "severity": "warning", "description": "'), quoted_text,
                    F.lit('", "affected_rows": "'), (d % 100).cast("string"), F.lit('", "suggested_fix": "fill"}]}'))
    return table(spark, sf_dir, "documents").select(
        d.alias("resp_id"),
        F.when(d % 5 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(d % 5 == 1, F.concat(F.lit("Result "), body, F.lit(" end")))
        .when(d % 5 == 2, F.concat(F.lit("I see an issue: "), quoted_text))
        .when(d % 5 == 3, F.concat(F.lit('{"is_valid": tru, "summary": "'), quoted_text))
        .otherwise(F.concat(F.lit("```python\n"), quoted_text, F.lit("\n```"))).alias("text"))


RESPONSES = r"""
resp0 AS (SELECT doc_id AS d, regexp_replace(text, '[\\"\x00-\x1f{}`]', ' ', 'g') AS q FROM documents),
resp1 AS (SELECT d, q, '{"is_valid": true, "overall_quality_score": 0.75, "issues": [{"column": "c' || (d % 7) ||
    '", "issue_type": "null_values", "severity": "warning", "description": "' || q ||
    '", "affected_rows": "' || (d % 100) || '", "suggested_fix": "fill"}]}' AS body FROM resp0),
resp AS (SELECT d AS resp_id, q, CASE
    WHEN d % 5 = 0 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || body || chr(10) || '```' || chr(10) || 'Done.'
    WHEN d % 5 = 1 THEN 'Result ' || body || ' end'
    WHEN d % 5 = 2 THEN 'I see an issue: ' || q
    WHEN d % 5 = 3 THEN '{"is_valid": tru, "summary": "' || q
    ELSE '```python' || chr(10) || q || chr(10) || '```' END AS text FROM resp1)
"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest with one row per order."""
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), F.lpad(o.cast("string"), 9, "0")).alias("id"),
        F.element_at(F.array(F.lit("preprocessing"), F.lit("diagnosing"), F.lit("fix_attempt"), F.lit("complete")),
                     (o % 4 + 1).cast("int")).alias("stage"),
        F.col("o_orderdate").alias("timestamp"), (o % 1000).alias("rows"))


SNAPSHOTS = """
snap AS (SELECT 's' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS id,
    (['preprocessing','diagnosing','fix_attempt','complete'])[(o_orderkey % 4) + 1] AS stage,
    o_orderdate AS timestamp, o_orderkey % 1000 AS rows FROM orders)
"""

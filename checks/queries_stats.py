"""Profiles, quality checks, adjusted p-values, structural facts and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.catalog import query, table
from checks.fixtures import (
    MESSY, MESSY_TWICE, P_VALUES, SNAPSHOTS, TEXT_COLUMNS, adjusted_sql, messy, messy_twice, p_values, snapshots,
)
from tablewright.operators import profile_state
from tablewright.operators import fingerprint as fp
from tablewright.operators import padjust, profile
from tablewright.operators import snapshots as snap
from tablewright.session import scratch_path

LINEITEM_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}
LINEITEM_NUMBERS = [c for c, t in LINEITEM_TYPES.items() if t in ("bigint", "int", "double")]


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {i} AS position, '{t}' AS dtype, count(*) AS rows, count(*) - count({c}) AS nulls,
    count(DISTINCT {c}) AS distinct_values FROM lineitem""" for i, (c, t) in enumerate(LINEITEM_TYPES.items())))
def column_profile(spark, sf_dir):
    return profile.column_profile(table(spark, sf_dir, "lineitem"))


def column_profile_sketched(spark, sf_dir):
    """Distinct counts by sketch: no exact SQL."""
    return profile.column_profile(table(spark, sf_dir, "lineitem"), exact=False)


query()(column_profile_sketched)


def _describe_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 7) AS mean, round(stddev_samp({c}), 6) AS std,
        CAST(min({c}) AS DOUBLE) AS "min", round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25,
        round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75,
        CAST(max({c}) AS DOUBLE) AS "max" FROM {source}""" for c in columns)


def _rounded(df, names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


@query(_describe_sql("lineitem", LINEITEM_NUMBERS))
def numeric_describe(spark, sf_dir):
    described = profile.numeric_describe(table(spark, sf_dir, "lineitem"))
    return _rounded(described, ["std", "q25", "q50", "q75"]).withColumn("mean", F.round("mean", 7))


@query("""
WITH v AS (SELECT 'o_orderstatus' AS c, o_orderstatus AS v FROM orders
  UNION ALL SELECT 'o_orderdate', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') FROM orders
  UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
r AS (SELECT c, v, count(*) AS n, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, v) AS k FROM v GROUP BY c, v)
SELECT c AS "column", v AS value, n, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 3""")
def top_values(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "orders"))


@query("SELECT event_id AS row_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 5")
def head_rows(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), "user_id", "event_type", "value")
    return profile.head_rows(df, 5)


@query(f"WITH {MESSY} SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count("{c}") AS nulls FROM messy""" for c in TEXT_COLUMNS)
    + ") WHERE nulls > 0")
def null_columns(spark, sf_dir):
    return profile.null_columns(messy(spark, sf_dir))


@query(f"WITH {MESSY} SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ("{c}" = '') AS empty FROM messy""" for c in TEXT_COLUMNS)
    + ") WHERE empty > 0")
def empty_strings(spark, sf_dir):
    return profile.empty_strings(messy(spark, sf_dir))


@query(f"WITH {MESSY_TWICE} SELECT (SELECT count(*) FROM twice) - (SELECT count(*) FROM (SELECT DISTINCT * FROM twice)) AS duplicates")
def duplicate_rows(spark, sf_dir):
    return profile.duplicate_rows(messy_twice(spark, sf_dir))


def _outlier_sql(source, columns):
    return "SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) AS outliers
        FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {source}), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a,
        quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b FROM {source})""" for c in columns) + ") WHERE outliers > 0"


@query(_outlier_sql("events", ["event_id", "user_id", "value"]))
def outliers(spark, sf_dir):
    return profile.outliers(table(spark, sf_dir, "events"))


def _check_table(spark, sf_dir):
    """Numbers with gaps and outliers, texts with empty values, and repeated rows."""
    ev = table(spark, sf_dir, "events")
    e = F.col("event_id")
    base = ev.select(
        F.when(e % 37 != 0, F.col("value")).alias("value"), (F.col("user_id") * F.col("user_id")).alias("squared"),
        F.when(e % 23 == 0, "").otherwise(F.col("event_type")).alias("event_type"), e)
    return base.unionByName(base.where(e % 101 == 0))


CHECK = """
chk0 AS (SELECT CASE WHEN event_id % 37 <> 0 THEN value END AS value, user_id * user_id AS squared,
  CASE WHEN event_id % 23 = 0 THEN '' ELSE event_type END AS event_type, event_id FROM events),
chk AS (SELECT * FROM chk0 UNION ALL SELECT * FROM chk0 WHERE event_id % 101 = 0)
"""
QUICK = f"""
quick AS (SELECT * FROM (
  SELECT 'value' AS "column", 'null_values' AS issue_type, 'warning' AS severity, 'null values' AS words,
    count(*) - count(value) AS affected_rows FROM chk
  UNION ALL SELECT 'event_type', 'empty_strings', 'warning', 'empty strings', count(*) FILTER (event_type = '') FROM chk
  UNION ALL SELECT "column", 'outliers', 'info', 'outliers', outliers FROM
    ({_outlier_sql("chk", ["value", "squared", "event_id"])})
  UNION ALL SELECT '*', 'duplicates', 'info', 'duplicate rows',
    (SELECT count(*) FROM chk) - (SELECT count(*) FROM (SELECT DISTINCT * FROM chk))) WHERE affected_rows > 0)
"""


@query(f"""WITH {CHECK}, {QUICK} SELECT "column", issue_type, severity, affected_rows || ' ' || words AS description,
affected_rows FROM quick""")
def quick_check(spark, sf_dir):
    return profile.quick_check(_check_table(spark, sf_dir)).drop("suggested_fix")


@query(f"""WITH {CHECK}, {QUICK} SELECT (SELECT count(*) FROM chk) AS total_rows, 4::BIGINT AS total_columns,
count(*) AS issues, count(*) > 0 AS has_issues FROM quick""")
def quick_summary(spark, sf_dir):
    df = _check_table(spark, sf_dir)
    return profile.quick_summary(df, profile.quick_check(df))


# adjusted p-values

def _adjust_query(method: str):
    @query(f"""WITH {P_VALUES}, {adjusted_sql()} SELECT row_id, pv.p AS p, a."{method}" AS adjusted
    FROM pv LEFT JOIN adjusted a ON a.p = pv.p""", name=f"adjust_{method}")
    def run(spark, sf_dir):
        df = padjust.adjust(p_values(spark, sf_dir), "p", {"adjusted": method})
        p = F.when(F.col("p") < 0, 0.0).when(F.col("p") > 1, 1.0).otherwise(F.col("p"))
        return df.select("row_id", p.alias("p"), F.round("adjusted", 9).alias("adjusted"))

    return run


for _method in padjust.METHODS:
    _adjust_query(_method)


@query(f"""WITH {P_VALUES}, {adjusted_sql()} SELECT row_id, a.bh AS bh, a.bh <= 0.05 AS bh_reject,
a.bonferroni AS bonferroni, a.bonferroni <= 0.05 AS bonferroni_reject FROM pv LEFT JOIN adjusted a ON a.p = pv.p""")
def adjust_with_decision(spark, sf_dir):
    df = padjust.adjust(p_values(spark, sf_dir), "p", {"bh": "bh", "bonferroni": "bonferroni"}, reject_at=0.05)
    return _rounded(df.drop("p"), ["bh", "bonferroni"], 9)


@query(f"""WITH pv AS (SELECT l_orderkey, l_partkey, l_linenumber, l_discount * 10 AS p FROM lineitem), {adjusted_sql()}
SELECT l_orderkey, l_partkey, l_linenumber, bh, "by", bonferroni, holm FROM pv LEFT JOIN adjusted a ON a.p = pv.p""")
def adjust_many_ties(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", (F.col("l_discount") * 10).alias("p"))
    out = padjust.adjust(df, "p", {m: m for m in padjust.METHODS})
    return _rounded(out.drop("p"), padjust.METHODS, 9)


@query(f"""WITH pv AS (SELECT o_orderkey, round(o_totalprice / 1000000, 9) AS p FROM orders), {adjusted_sql()}
SELECT o_orderkey, bh, "by", bonferroni, holm FROM pv LEFT JOIN adjusted a ON a.p = least(pv.p, 1.0)""")
def adjust_in_buckets(spark, sf_dir):
    """Small buckets, so that the carry across buckets is exercised on this data."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 1000000, 9).alias("p"))
    out = padjust.adjust(df, "p", {m: m for m in padjust.METHODS}, bucket_rows=200)
    return _rounded(out.drop("p"), padjust.METHODS, 9)


# structural facts and tokens

def _number_facts_sql(source, columns, by=""):
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return " UNION ALL ".join(f"""SELECT {key}{i} AS position, count(*) AS rows, count({c}) AS n,
        round((count(*) - count({c}))::DOUBLE / count(*), 9) AS null_ratio, count(DISTINCT {c}) AS distinct_values,
        round(count(DISTINCT {c})::DOUBLE / nullif(count({c}), 0), 9) AS unique_ratio,
        CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max", round(avg({c}), 7) AS mean,
        round(stddev_samp({c}), 6) AS std, round(skewness({c}), 6) AS skew,
        round(avg(CASE WHEN {c} IS NULL THEN NULL WHEN {c} < 0.05 THEN 1.0 ELSE 0.0 END), 9) AS small_share
        FROM {source} {group}""" for i, c in columns)


FACTS = ["position", "rows", "n", "null_ratio", "distinct_values", "unique_ratio", "min", "max", "mean", "std", "skew",
         "small_share"]


def _facts(df, by=()):
    out = fp.column_facts(df, list(by)).select(*by, *FACTS)
    return out.withColumns({
        **{c: F.round(c, 9) for c in ("null_ratio", "unique_ratio", "small_share")},
        "mean": F.round("mean", 7), **{c: F.round(c, 6) for c in ("std", "skew")}})


@query(_number_facts_sql("lineitem", list(enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]))))
def number_facts(spark, sf_dir):
    return _facts(table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"))


@query(_number_facts_sql("lineitem", list(enumerate(["l_quantity", "l_discount"])), by="l_returnflag"))
def number_facts_by_group(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    return _facts(df, ["l_returnflag"])


PART = """
part0 AS (SELECT p_partkey AS row_id, p_name, upper(p_brand) AS brand,
  CASE WHEN p_partkey % 7 <> 0 THEN 'ABC' || (p_partkey % 50) END AS symbol, p_type FROM part)
"""


def _part(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("row_id"), "p_name", F.upper("p_brand").alias("brand"),
        F.when(k % 7 != 0, F.concat(F.lit("ABC"), (k % 50).cast("string"))).alias("symbol"), "p_type")


PART_TEXTS = ["p_name", "brand", "symbol", "p_type"]


@query(f"WITH {PART} " + " UNION ALL ".join(
    f"""SELECT {i} AS position, (SELECT round(avg(length({c})), 9) FROM part0) AS mean_length,
    round(avg(CASE WHEN {c} = upper({c}) AND {c} <> lower({c}) THEN 1.0 ELSE 0.0 END), 9) AS upper_share,
    round(avg(CASE WHEN regexp_matches({c}, '\\d') THEN 1.0 ELSE 0.0 END), 9) AS digit_share,
    round(avg(CASE WHEN regexp_matches({c}, '[^A-Za-z0-9\\s]') THEN 1.0 ELSE 0.0 END), 9) AS special_share,
    round(avg(CASE WHEN regexp_matches({c}, '^[A-Z][A-Z0-9]{{1,10}}$') THEN 1.0 ELSE 0.0 END), 9) AS symbol_share
    FROM (SELECT {c} FROM part0 WHERE {c} IS NOT NULL)""" for i, c in enumerate(PART_TEXTS)))
def text_facts(spark, sf_dir):
    names = ["mean_length", "upper_share", "digit_share", "special_share", "symbol_share"]
    facts = fp.column_facts(_part(spark, sf_dir)).select("position", *names)
    return facts.withColumns({c: F.round(c, 9) for c in names})


def _exploded(tokens):
    return tokens.select("column", F.posexplode("tokens").alias("pos", "token"))


def _null_sql(r):
    return (f"CASE WHEN {r} = 0 THEN 'NO_NULLS' WHEN {r} < 0.1 THEN 'FEW_NULLS' WHEN {r} < 0.5 THEN 'SOME_NULLS' "
            "ELSE 'MANY_NULLS' END")


def _card_sql(r):
    return (f"CASE WHEN {r} IS NULL THEN NULL WHEN {r} < 0.01 THEN 'CONSTANT' WHEN {r} < 0.1 THEN 'LOW_CARD' "
            f"WHEN {r} < 0.5 THEN 'MED_CARD' WHEN {r} < 0.95 THEN 'HIGH_CARD' ELSE 'UNIQUE' END")


TOKEN_NUMBERS = [("l_quantity", "FLOAT"), ("l_extendedprice", "FLOAT"), ("l_discount", "FLOAT"), ("l_linenumber", "INT"),
                 ("l_orderkey", "INT")]


def _name_list(c):
    return "[" + ", ".join(f"'{t}'" for t in fp.name_tokens(c)) + "]::VARCHAR[]"


@query("WITH f AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS c, {i} AS i, '{k}' AS kind, (count(*) - count({c}))::DOUBLE / count(*) AS nr,
    count(DISTINCT {c})::DOUBLE / count({c}) AS ur, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi,
    stddev_samp({c}) AS sd, skewness({c}) AS sk, avg(CASE WHEN {c} < 0.05 THEN 1.0 ELSE 0.0 END) AS small,
    {_name_list(c)} AS names FROM lineitem""" for i, (c, k) in enumerate(TOKEN_NUMBERS)) + f"""),
t AS (SELECT c, i, list_concat(list_filter([kind, {_null_sql('nr')}, {_card_sql('ur')},
  CASE WHEN lo >= 0 AND hi <= 1 THEN 'RANGE_0_1' WHEN lo >= 0 THEN 'POSITIVE' WHEN hi <= 0 THEN 'NEGATIVE' ELSE 'MIXED_SIGN' END,
  CASE WHEN hi - lo > 1000000 THEN 'LARGE_RANGE' WHEN hi - lo < 1 THEN 'SMALL_RANGE' END,
  CASE WHEN sd > 0 THEN CASE WHEN abs(sk) < 0.5 THEN 'SYMMETRIC' WHEN sk > 0 THEN 'RIGHT_SKEW' ELSE 'LEFT_SKEW' END END,
  CASE WHEN lo >= 0 AND hi <= 1 AND small > 0.1 THEN 'PVALUE_PATTERN' END], lambda x: x IS NOT NULL), names) AS ts FROM f)
SELECT c AS "column", CAST(k AS INTEGER) - 1 AS pos, 'COL_' || i || '_' || ts[k] AS token
FROM t, LATERAL (SELECT unnest(range(1, len(ts) + 1)) AS k)""")
def number_tokens(spark, sf_dir):
    names = [c for c, _ in TOKEN_NUMBERS]
    facts = fp.column_facts(table(spark, sf_dir, "lineitem").select(*names))
    return _exploded(fp.column_tokens(facts, names))


@query(f"WITH {PART}, f AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS c, {i} AS i, nr, ur, ml, up, dg, sp, sy, {_name_list(c)} AS names FROM
    (SELECT (count(*) - count({c}))::DOUBLE / count(*) AS nr, count(DISTINCT {c})::DOUBLE / count({c}) AS ur,
       avg(length({c})) AS ml FROM part0),
    (SELECT avg(CASE WHEN {c} = upper({c}) AND {c} <> lower({c}) THEN 1.0 ELSE 0.0 END) AS up,
       avg(CASE WHEN regexp_matches({c}, '\\d') THEN 1.0 ELSE 0.0 END) AS dg,
       avg(CASE WHEN regexp_matches({c}, '[^A-Za-z0-9\\s]') THEN 1.0 ELSE 0.0 END) AS sp,
       avg(CASE WHEN regexp_matches({c}, '^[A-Z][A-Z0-9]{{1,10}}$') THEN 1.0 ELSE 0.0 END) AS sy
     FROM (SELECT {c} FROM part0 WHERE {c} IS NOT NULL))""" for i, c in enumerate(PART_TEXTS))
    + f"""), t AS (SELECT c, i, list_concat(list_filter(['STRING', {_null_sql('nr')}, {_card_sql('ur')},
  CASE WHEN ml < 5 THEN 'SHORT_STR' WHEN ml < 20 THEN 'MED_STR' ELSE 'LONG_STR' END,
  CASE WHEN up > 0.8 THEN 'UPPERCASE' WHEN up < 0.2 THEN 'LOWERCASE' ELSE 'MIXEDCASE' END,
  CASE WHEN dg > 0.5 THEN 'HAS_NUMBERS' END, CASE WHEN sp > 0.3 THEN 'HAS_SPECIAL' END,
  CASE WHEN sy > 0.5 THEN 'GENE_PATTERN' END], lambda x: x IS NOT NULL), names) AS ts FROM f)
SELECT c AS "column", CAST(k AS INTEGER) - 1 AS pos, 'COL_' || i || '_' || ts[k] AS token
FROM t, LATERAL (SELECT unnest(range(1, len(ts) + 1)) AS k)""")
def text_tokens(spark, sf_dir):
    return _exploded(fp.column_tokens(fp.column_facts(_part(spark, sf_dir)), PART_TEXTS))


@query(f"""WITH {MESSY}, s AS (SELECT count(*) AS n, {'+'.join(f'count(*) - count("{c}")' for c in TEXT_COLUMNS)} AS nulls FROM messy)
SELECT 'DF_' || CASE WHEN n < 100 THEN 'SMALL' WHEN n < 10000 THEN 'MED' ELSE 'LARGE' END || '_ROWS DF_MED_COLS DF_MOSTLY_STRING ' ||
  CASE WHEN nulls / (n * 8.0) < 0.01 THEN 'DF_CLEAN' WHEN nulls / (n * 8.0) < 0.1 THEN 'DF_SOME_MISSING' ELSE 'DF_MANY_MISSING' END AS tokens
FROM s""")
def table_tokens(spark, sf_dir):
    tokens = fp.table_tokens(fp.column_facts(messy(spark, sf_dir)))
    return tokens.select(F.array_join("tokens", " ").alias("tokens"))


@query(f"""WITH {MESSY} SELECT count(*) AS rows, 8::BIGINT AS "columns", 0.0::DOUBLE AS numeric_ratio,
round(({'+'.join(f'count(*) - count("{c}")' for c in TEXT_COLUMNS)}) / (count(*) * 8.0::DOUBLE), 9) AS null_ratio FROM messy""")
def table_shape(spark, sf_dir):
    return _rounded(fp.table_shape(fp.column_facts(messy(spark, sf_dir))), ["null_ratio"], 9)


def fingerprint_lineitem(spark, sf_dir):
    """The whole fingerprint of one table; its parts have SQL of their own."""
    return fp.fingerprint(table(spark, sf_dir, "lineitem"), key="")


query()(fingerprint_lineitem)


# snapshot and attempt logs

@query(f"""WITH {SNAPSHOTS} SELECT id, stage, rows FROM snap
QUALIFY row_number() OVER (PARTITION BY stage ORDER BY timestamp DESC, id DESC) = 1""")
def latest_by_stage(spark, sf_dir):
    return snap.latest_by_stage(snapshots(spark, sf_dir)).select("id", "stage", "rows")


@query(f"WITH {SNAPSHOTS} SELECT id, stage, rows FROM snap ORDER BY timestamp DESC, id DESC LIMIT 1")
def latest_snapshot(spark, sf_dir):
    return snap.latest(snapshots(spark, sf_dir)).select("id", "stage", "rows")


@query(f"WITH {SNAPSHOTS} SELECT stage, count(*) AS snapshots, CAST(sum(rows) AS BIGINT) AS rows FROM snap GROUP BY stage")
def snapshot_totals(spark, sf_dir):
    return snap.manifest_totals(snapshots(spark, sf_dir))


@query("""SELECT user_id AS run_id, event_id AS iteration, CASE WHEN event_type <> 'error' THEN
CAST(count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) END AS attempt FROM events""")
def attempt_numbers(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("iteration"),
        F.when(F.col("event_type") == "error", "execution").when(F.col("event_type") == "click", "logical").alias("error_kind"))
    return snap.attempt_numbers(ev).drop("error_kind")


@query("""SELECT role AS phase, count(*) AS entries, CAST(sum(length(text) // 4) AS BIGINT) AS tokens
FROM conversations GROUP BY role""")
def log_totals(spark, sf_dir):
    log = table(spark, sf_dir, "conversations").select(
        F.col("role").alias("phase"), F.floor(F.length("text") / 4).cast("bigint").alias("token_count"))
    return snap.log_totals(log)


MERGED = ["l_suppkey", "l_quantity", "l_discount", "l_linenumber", "l_returnflag"]
POINTS = (0.055, 0.255, 0.755)
_NUMBERS = """round(avg(v), 8) AS mean, round(stddev_samp(v), 6) AS std, round(skewness(v), 4) AS skew,
  quantile_disc(v::DOUBLE, 0.055) AS low, quantile_disc(v::DOUBLE, 0.255) AS mid, quantile_disc(v::DOUBLE, 0.755) AS high"""
_TEXTS = "NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS skew, NULL::DOUBLE AS low, NULL::DOUBLE AS mid, NULL::DOUBLE AS high"
_COLUMNS = " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) AS rows, count(*) - count(v) AS nulls, count(DISTINCT v) AS distinct_values, min(v)::VARCHAR AS least, max(v)::VARCHAR AS largest,
  {_TEXTS if c == 'l_returnflag' else _NUMBERS},
  (SELECT string_agg(t || ':' || n, ' ' ORDER BY n DESC, t) FROM (
    SELECT v::VARCHAR AS t, count(*) AS n FROM (SELECT {c} AS v FROM lineitem WHERE l_orderkey % 7 <> 0 OR '{c}' <> 'l_quantity') WHERE v IS NOT NULL GROUP BY v ORDER BY n DESC, t LIMIT 3)) AS top_values
FROM (SELECT CASE WHEN l_orderkey % 7 = 0 AND '{c}' = 'l_quantity' THEN NULL ELSE {c} END AS v FROM lineitem)""" for c in MERGED)


@query(_COLUMNS)
def profile_merged(spark, sf_dir):
    """The states of seven parts, stored one by one and merged twice over, without reading rows again."""
    path, key = scratch_path(spark, "states"), F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.when(key % 7 != 0, F.col("l_quantity")))
    for k in range(7):
        profile_state.profile_state(rows.where(key % 7 == k), f"part {k}", MERGED, precision=18).write.mode("append").parquet(path)
    states = spark.read.parquet(path)
    first = profile_state.merge_states(states.where("part < 'part 3'"), "first")
    last = profile_state.merge_states(states.where("part >= 'part 3'"), "last")
    shown = profile_state.read_profile(profile_state.merge_states(first.unionByName(last)), POINTS)
    tops = F.array_join(F.transform("top_values", lambda x: F.concat_ws(":", x["item"], x["count"].cast("string"))), " ")
    return shown.select("column", "rows", "nulls", "distinct_values", "least", "largest", F.round("mean", 8).alias("mean"), F.round("std", 6).alias("std"),
                        F.round("skew", 4).alias("skew"), *(F.col("quantiles")[i].alias(q) for i, q in enumerate(("low", "mid", "high"))), tops.alias("top_values"))

"""Text functions, TF-IDF, contexts and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.catalog import query, table
from checks.fixtures import MESSY, RESPONSES, messy, responses
from tablewright.functions import files as ff
from tablewright.functions import text
from tablewright.operators.names import mentions_anywhere
from tablewright.operators import context, terms, tfidf
from tablewright.operators import responses as resp

TERMS = """
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS term FROM w
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
top AS (SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS documents FROM c GROUP BY term
        ORDER BY total DESC, term LIMIT 1000),
vocab AS (SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS position, term, total, documents,
          ln((1 + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + documents)) + 1 AS idf FROM top)
"""


@query(f"WITH {TERMS} SELECT position, term, total, documents, round(idf, 9) AS idf FROM vocab")
def vocabulary(spark, sf_dir):
    model = tfidf.fit(table(spark, sf_dir, "documents"), "text")
    return model.vocabulary(spark).withColumn("idf", F.round("idf", 9))


@query(f"""WITH {TERMS}, r AS (SELECT doc_id, term, tf * idf AS x FROM c JOIN vocab USING (term))
SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM r""")
def tfidf_weights(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = tfidf.fit(docs, "text")
    return model.weights(docs, "text", ["doc_id"]).withColumn("weight", F.round("weight", 6))


@query(f"WITH {TERMS} SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS documents FROM c GROUP BY term")
def term_statistics(spark, sf_dir):
    return tfidf.term_statistics(tfidf.with_terms(table(spark, sf_dir, "documents"), "text"))


@query(r"""SELECT doc_id, md5(replace(regexp_replace(nfc_normalize(raw), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{E000}-\x{F8FF}]', '', 'g'),
  chr(65533), '?')) AS cleaned, length(raw) AS raw_length FROM (SELECT doc_id,
  replace(replace(text, 'e', 'e' || chr(769)), 'a', chr(7) || 'a' || chr(65533) || chr(57345)) AS raw FROM documents)""")
def text_clean(spark, sf_dir):
    raw = F.replace(F.replace(F.col("text"), F.lit("e"), F.lit("é")), F.lit("a"), F.lit("\x07a�"))
    docs = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    return docs.select("doc_id", F.md5(text.clean_text(F.col("raw"))).alias("cleaned"),
                       F.length("raw").cast("bigint").alias("raw_length"))


@query("SELECT doc_id, length(text) // 4 AS tokens, CAST(2000 + least(n_chars, 10) * 5 * 10 AS BIGINT) AS table_tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.token_estimate(F.col("text")).alias("tokens"),
        text.table_token_estimate(F.col("n_chars"), F.lit(5)).alias("table_tokens"))


@query("""SELECT p_partkey, upper(p_name) AS up, lower(p_name) AS low,
  CASE WHEN length(p_name) > 10 THEN left(p_name, 7) || '...' ELSE p_name END AS short, left(p_type, 200) || '...' AS head,
  left(p_brand, 15) AS label, regexp_replace(lower(p_brand), '[^a-z0-9_]', '_', 'g') AS safe_name,
  replace(trim(regexp_replace(p_brand, '[^A-Za-z0-9 _-]', '', 'g')), ' ', '_') AS export_name,
  CAST(p_retailprice AS VARCHAR) || '!' AS as_text FROM part""")
def text_functions(spark, sf_dir):
    name, brand = F.col("p_name"), F.col("p_brand")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper(name).alias("up"), F.lower(name).alias("low"), text.shorten(name, 10, 7).alias("short"),
        text.head_with_dots(F.col("p_type")).alias("head"), F.substring(brand, 1, 15).alias("label"),
        text.file_safe(brand).alias("safe_name"), text.export_safe(brand).alias("export_name"),
        F.concat(F.col("p_retailprice").cast("string"), F.lit("!")).alias("as_text"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(mixed, ''),
  lambda ch: CASE WHEN ch = upper(ch) THEN lower(ch) ELSE upper(ch) END), '') AS swapped
FROM (SELECT p_partkey, p_brand || p_name AS mixed FROM part)""")
def swap_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.swap_case(F.concat("p_brand", "p_name")).alias("swapped"))


@query("""SELECT doc_id, CASE WHEN s < 1024 THEN printf('%.1f B', s::DOUBLE) WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0::DOUBLE)
  WHEN s < 1073741824 THEN printf('%.1f MB', s / 1048576.0::DOUBLE) WHEN s < 1099511627776 THEN printf('%.1f GB', s / 1073741824.0::DOUBLE)
  ELSE printf('%.1f TB', s / 1099511627776.0::DOUBLE) END AS size_human
FROM (SELECT doc_id, n_chars * (CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 997 WHEN 2 THEN 1000003 ELSE 1000000007 END) AS s FROM documents)""")
def human_size(spark, sf_dir):
    k = F.col("doc_id") % 4
    factor = F.when(k == 0, F.lit(1)).when(k == 1, F.lit(997)).when(k == 2, F.lit(1000003)).otherwise(F.lit(1000000007))
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.human_size(F.col("n_chars") * factor.cast("bigint")).alias("size_human"))


@query("""SELECT page_id, lower(left(hex(encode(html)), 512)) AS hex_head,
  regexp_replace(left(regexp_replace(html, '[^\\x00-\\x7F]', '', 'g'), 256), '[^ -~]', '.', 'g') AS printable FROM pages""")
def header_rendering(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    whole, ascii_only = F.col("html").cast("binary"), F.regexp_replace("html", r"[^\x00-\x7F]", "").cast("binary")
    return pages.select("page_id", text.hex_head(whole).alias("hex_head"), text.printable_head(ascii_only).alias("printable"))


# file typing on contents derived from the texts
_MAGIC = {0: ("504B0304", ".bin"), 1: ("1F8B0800", ".tar.gz"), 2: ("1F8B0800", ".csv.gz"), 3: ("", ".csv"), 4: ("", ".tsv"),
          5: ("", ".txt"), 6: ("50415231", ".parquet"), 7: ("377ABCAF271C", ".dat"), 8: ("", ".zip"), 9: ("7B22", ".json"),
          10: ("0001", ".bin")}


@query("""
WITH f AS (SELECT doc_id, doc_id % 11 AS k, length(text) = 0 AS none FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN 'zip' WHEN 1 THEN 'tar.gz' WHEN 2 THEN 'gzip' WHEN 6 THEN 'parquet' WHEN 7 THEN '7z'
    WHEN 8 THEN 'zip' ELSE 'plain' END AS kind,
  CASE k WHEN 0 THEN 'application/zip' WHEN 1 THEN 'application/gzip' WHEN 2 THEN 'application/gzip'
    WHEN 6 THEN 'application/x-parquet' WHEN 7 THEN 'application/x-7z-compressed' WHEN 8 THEN 'application/zip'
    WHEN 3 THEN 'text/csv' WHEN 4 THEN 'text/tab-separated-values' WHEN 5 THEN 'text/plain'
    WHEN 9 THEN 'application/json' ELSE 'application/octet-stream' END AS mime,
  k IN (3, 4, 5, 6, 9) AS tabular,
  CASE k WHEN 3 THEN 'csv' WHEN 4 THEN 'tsv' WHEN 5 THEN 'sniff' WHEN 6 THEN 'parquet' WHEN 9 THEN 'json' END AS reader
FROM f""")
def file_typing(spark, sf_dir):
    k = (F.col("doc_id") % 11).cast("int")
    magic = F.element_at(F.create_map(*[x for i, (m, _) in _MAGIC.items() for x in (F.lit(i), F.lit(m))]), k)
    suffix = F.element_at(F.create_map(*[x for i, (_, s) in _MAGIC.items() for x in (F.lit(i), F.lit(s))]), k)
    # plain texts start with a letter, whatever the document starts with
    body = F.concat(F.lit("t"), F.regexp_replace("text", r"[\x00-\x08\x0E-\x1F]", "")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("file"), F.col("doc_id").cast("string"), suffix).alias("name"),
        F.concat(F.unhex(magic), body).alias("head"))
    name, head = F.col("name"), F.col("head")
    return docs.select("doc_id", ff.file_kind(name, head).alias("kind"), ff.media_type(name, head).alias("mime"),
                       ff.is_tabular(name, head).alias("tabular"), ff.reader_of(name, head).alias("reader"))


@query("""SELECT page_id, url, regexp_matches(url, '(^|/)\\.') AS hidden, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages""")
def member_names(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", "url", ff.is_hidden(url).alias("hidden"), ff.base_name(url).alias("base"))


# contexts

@query(f"""WITH {MESSY}, h AS (SELECT *, row_number() OVER (ORDER BY row_id) AS k FROM messy ORDER BY row_id LIMIT 20)
SELECT CAST(k AS INTEGER) AS position, 'Row ' || k || ':' || chr(10) || '  Gene_ID: ' || coalesce("Gene_ID", '') || chr(10) ||
  '  adj_p: ' || coalesce(adj_p, '') AS block FROM h""")
def row_blocks(spark, sf_dir):
    return context.row_blocks(messy(spark, sf_dir).select("row_id", "Gene_ID", "adj_p"), 20)


@query(f"""WITH {MESSY}, h AS (SELECT *, row_number() OVER (ORDER BY row_id) AS k FROM messy ORDER BY row_id LIMIT 20)
SELECT 'CSV Data:' || chr(10) || repeat('=', 50) || chr(10) || 'Columns: Gene_ID' || chr(10) || chr(10) ||
  string_agg('Row ' || k || ':' || chr(10) || '  Gene_ID: ' || coalesce("Gene_ID", ''), chr(10) || chr(10) ORDER BY k) ||
  CASE WHEN (SELECT count(*) FROM messy) > 20 THEN chr(10) || chr(10) || '... (' || ((SELECT count(*) FROM messy) - 20) || ' more rows)' ELSE '' END AS text
FROM h""")
def table_text(spark, sf_dir):
    return context.table_text(messy(spark, sf_dir).select("row_id", "Gene_ID"), 20)


@query("""SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || chr(10) || chr(10) || '... (file truncated, ' ||
  length(text) || ' total chars)' ELSE text END AS text FROM documents""")
def cut_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", context.cut_text(F.col("text"), 500).alias("text"))


def _requests(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    word = F.regexp_extract("text", r"([A-Za-z]{3,})", 1)
    requests = conv.where("turn = 0").select(F.col("conv_id").alias("request_id"), "text")
    files = conv.where("turn > 0").select(
        F.col("conv_id").alias("request_id"), F.col("turn").alias("position"),
        F.when(F.col("turn") % 2 == 1, F.concat(word, F.lit(".csv"))).otherwise(
            F.concat(F.lit("part"), F.col("turn").cast("string"), F.lit(".txt"))).alias("name"),
        F.lit("csv").alias("kind"), F.col("text").alias("content"))
    return requests, files


REQUESTS = r"""
req AS (SELECT conv_id AS request_id, text FROM conversations WHERE turn = 0),
fil AS (SELECT conv_id AS request_id, turn AS position, CASE WHEN turn % 2 = 1 THEN regexp_extract(text, '([A-Za-z]{3,})', 1) || '.csv'
    ELSE 'part' || turn || '.txt' END AS name, 'csv' AS kind, text AS content FROM conversations WHERE turn > 0),
both_ AS (SELECT coalesce(f.request_id, r.request_id) AS request_id, r.text, f.position, f.name, f.kind, f.content,
    coalesce(contains(r.text, f.name) OR contains(r.text, regexp_replace(f.name, '\.[^.]*$', '')), false) AS named
  FROM req r FULL JOIN fil f ON r.request_id = f.request_id)
"""


@query(f"""WITH {REQUESTS}, g AS (SELECT request_id, any_value(text) AS text,
  string_agg(name, chr(10) ORDER BY position) FILTER (named) AS named,
  string_agg('## file ' || name || ' (' || kind || ')' || chr(10) || content, chr(10) || chr(10) ORDER BY position) AS held FROM both_ GROUP BY request_id)
SELECT request_id, CASE WHEN coalesce(text, '') <> '' OR held IS NOT NULL THEN array_to_string(list_filter([
  CASE WHEN coalesce(text, '') <> '' THEN '## request' || chr(10) || text END, '## named in the request' || chr(10) || named, held],
  lambda x: x IS NOT NULL), chr(10) || chr(10)) END AS context FROM g""")
def build_contexts(spark, sf_dir):
    return context.build_contexts(*_requests(spark, sf_dir))


@query("""WITH words AS (SELECT DISTINCT doc_id AS request_id, regexp_replace(w, '\\.+$', '') AS word FROM
  (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_.-]+')) AS w FROM documents)),
names AS (SELECT DISTINCT regexp_extract(text, '([A-Za-z]{3,})', 1) || '.csv' AS name FROM benchmark),
forms AS (SELECT name, name AS word FROM names UNION SELECT name, regexp_replace(name, '\\.[^.]*$', '') FROM names)
SELECT DISTINCT request_id, name FROM words JOIN forms USING (word) WHERE word <> ''""")
def name_mentions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), "text")
    names = table(spark, sf_dir, "benchmark").select(
        F.concat(F.regexp_extract("text", r"([A-Za-z]{3,})", 1), F.lit(".csv")).alias("name")).distinct()
    return context.mentions(docs, names)


@query("""WITH names AS (SELECT DISTINCT regexp_extract(text, '([A-Za-z]{2,} [A-Za-z]{2,})', 1) || CASE WHEN item_id % 2 = 0 THEN '.csv' ELSE '' END AS name FROM benchmark)
SELECT DISTINCT doc_id AS request_id, name FROM documents JOIN names ON contains(text, name) OR contains(text, regexp_replace(name, '\\.[^.]*$', '')) WHERE name <> ''""")
def name_mentions_blanks(spark, sf_dir):
    """Names of two words, found anywhere in whole texts by automata over shards of a few names."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), "text")
    two = F.regexp_extract("text", r"([A-Za-z]{2,} [A-Za-z]{2,})", 1)
    names = table(spark, sf_dir, "benchmark").select(F.concat(two, F.when(F.col("item_id") % 2 == 0, ".csv").otherwise("")).alias("name"))
    return mentions_anywhere(docs, names, shard_bytes=256)


# responses

@query(f"""WITH {RESPONSES} SELECT resp_id, resp_id % 5 IN (0, 1) AS parsed, resp_id % 5 IN (0, 1) AS is_valid,
CASE WHEN resp_id % 5 IN (0, 1) THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS quality_score, 1 AS issues,
CASE WHEN resp_id % 5 IN (0, 1) THEN 'Analysis completed' ELSE 'Analysis failed: JSON parse error' END AS summary FROM resp""")
def parse_responses(spark, sf_dir):
    return resp.parse_responses(responses(spark, sf_dir)).drop("text").withColumn("issues", F.size("issues"))


@query(f"""WITH {RESPONSES} SELECT resp_id, CASE WHEN resp_id % 5 IN (0, 1) THEN 'c' || (resp_id % 7) ELSE 'unknown' END AS "column",
CASE WHEN resp_id % 5 IN (0, 1) THEN 'null_values' ELSE 'parse_error' END AS issue_type,
CASE WHEN resp_id % 5 IN (0, 1) THEN 'warning' ELSE 'critical' END AS severity,
CASE WHEN resp_id % 5 IN (0, 1) THEN q
     WHEN contains(lower(text), 'issue') OR contains(lower(text), 'problem') THEN 'Response could not be parsed as JSON; it may hold the analysis as text.'
     ELSE 'Response could not be parsed as JSON.' END AS description,
CASE WHEN resp_id % 5 IN (0, 1) THEN CAST(resp_id % 100 AS VARCHAR) ELSE 'unknown' END AS affected_rows FROM resp""")
def response_issues(spark, sf_dir):
    parsed = resp.parse_responses(responses(spark, sf_dir))
    return resp.response_issues(parsed, "resp_id").drop("suggested_fix")


@query(f"""WITH {RESPONSES} SELECT resp_id, trim(CASE WHEN resp_id % 5 = 4 THEN q WHEN resp_id % 5 = 0 THEN
  regexp_extract(text, '(?s)```\\s*(.*?)```', 1) ELSE text END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS code FROM resp""")
def extract_code(spark, sf_dir):
    return resp.extract_code(responses(spark, sf_dir)).select("resp_id", "code")


@query("""SELECT p_partkey, md5(concat_ws('|', '5', CAST(p_partkey AS VARCHAR), p_name)) AS digest,
  ('0x' || substr(md5(concat_ws('|', '5', CAST(p_partkey AS VARCHAR), p_name)), 9, 8))::BIGINT / 4294967296.0::DOUBLE AS draw FROM part""")
def digest_draws(spark, sf_dir):
    from tablewright.functions.draws import digest, unit

    h = digest(5, F.col("p_partkey"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", h.alias("digest"), unit(h, 1).alias("draw"))




ALL_TERMS = TERMS.replace("ORDER BY total DESC, term LIMIT 1000", "HAVING count(*) >= 2")


@query(f"""WITH {ALL_TERMS}, r AS (SELECT doc_id, term, position, tf * idf AS x FROM c JOIN vocab USING (term))
SELECT doc_id, term, CAST(position AS BIGINT) AS position, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM r""")
def tfidf_unbounded(spark, sf_dir):
    """Every term of two texts or more, without a limit on their number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = terms.fit_terms(docs, "text", min_documents=2)
    return model.weights(docs, "text", ["doc_id"]).withColumn("weight", F.round("weight", 6))

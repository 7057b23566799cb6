"""Texts for people and models: tables as text, documents joined into one context per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.operators.clean import quoted
from tablewright.plans.schema import ROW_ID


def row_blocks(df: DataFrame, n: int = 20, key: str = ROW_ID) -> DataFrame:
    """(position, block): the first n rows as "Row i:" with one "  key: value" line per column."""
    names = [c for c in df.columns if c != key]
    lines = [F.concat(F.lit(f"  {c}: "), F.coalesce(quoted(c).cast("string"), F.lit(""))) for c in names]
    first = df.orderBy(key).limit(n)
    # at most n rows are left here
    numbered = first.withColumn("position", F.row_number().over(Window.orderBy(key)))
    return numbered.select("position", F.concat_ws(
        "\n", F.concat(F.lit("Row "), F.col("position").cast("string"), F.lit(":")), *lines).alias("block"))


def table_text(df: DataFrame, n: int = 20, key: str = ROW_ID) -> DataFrame:
    """One row ``text``: column names, the first n rows, and how many rows were left out."""
    names = [c for c in df.columns if c != key]
    blocks = row_blocks(df, n, key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "block"))),
                                 lambda s: s["block"]), "\n\n").alias("body"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    both = blocks.unionByName(total, allowMissingColumns=True).agg(
        F.max("body").alias("body"), F.max("total").alias("total"))
    head = "\n".join(["CSV Data:", "=" * 50, "Columns: " + ", ".join(names), "", ""])
    more = F.when(F.col("total") > n, F.format_string("\n\n... (%d more rows)", F.col("total") - n)).otherwise("")
    return both.select(F.when(F.col("total") == 0, F.lit("Empty CSV file")).otherwise(
        F.concat(F.lit(head), "body", more)).alias("text"))


def cut_text(c: Column, limit: int | None = None) -> Column:
    """Texts longer than ``limit`` cut for display, with a note of their full length; no limit, no cut."""
    if limit is None:
        return c
    note = F.format_string("\n\n... (file truncated, %d total chars)", F.length(c))
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), note)).otherwise(c)


def stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def mentioned(text: Column, name: Column) -> Column:
    """True when the text names the file, with or without its extension."""
    return F.contains(text, name) | F.contains(text, stem(name))


def context_parts(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(request_id, part, position, title, text): what belongs to each request, one row per part.

    From requests (request_id, text) and files (request_id, position, name, kind, content). ``part`` is
    request, named (the files that the request names, one per line) or file. Parts stay rows, so a
    request may have any number of files; empty texts of requests give no row.
    """
    said = requests.where(F.coalesce("text", F.lit("")) != "")
    asked = said.select("request_id", F.lit("request").alias("part"), F.lit(None).cast("bigint").alias("position"),
                        F.lit("request").alias("title"), "text")
    named = files.join(said, "request_id").where(mentioned(F.col("text"), F.col("name"))).groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "name"))).alias("names"))
    listed = named.select("request_id", F.lit("named").alias("part"), F.lit(None).cast("bigint").alias("position"),
                          F.lit("named in the request").alias("title"), F.array_join(F.transform("names", lambda n: n["name"]), "\n").alias("text"))
    held = files.select("request_id", F.lit("file").alias("part"), F.col("position").cast("bigint").alias("position"),
                        F.format_string("file %s (%s)", "name", "kind").alias("title"), F.col("content").alias("text"))
    return asked.unionByName(listed).unionByName(held)


def build_contexts(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(request_id, context): the parts of each request joined into one text, NULL where there are none.

    For requests whose parts fit in one row; ``context_parts`` has no such limit.
    """
    order = F.array_position(F.array(F.lit("request"), F.lit("named"), F.lit("file")), F.col("part"))
    block = F.concat(F.lit("## "), "title", F.lit("\n"), F.coalesce("text", F.lit("")))
    joined = context_parts(requests, files).groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct(order.alias("order"), "position", block.alias("block")))).alias("parts"))
    joined = joined.select("request_id", F.array_join(F.transform("parts", lambda p: p["block"]), "\n\n").alias("context"))
    return requests.select("request_id").join(joined, "request_id", "full")


def mentions(texts: DataFrame, names: DataFrame, text_key: str = "request_id", text_col: str = "text",
             name_col: str = "name") -> DataFrame:
    """(text key, name): which of the names each text mentions, as whole words with or without extension.

    Texts are split into words and joined by equality, so the work grows with the words, not with
    texts times names.
    """
    word = F.explode(F.array_distinct(F.split(F.col(text_col), r"[^A-Za-z0-9_.\-]+")))
    # a full stop that ends a sentence is no part of a name
    words = texts.select(text_key, word.alias("word")).select(
        text_key, F.regexp_replace("word", r"\.+$", "").alias("word")).where("word <> ''").distinct()
    forms = names.select(F.col(name_col).alias("name"), F.explode(F.array_distinct(F.array(
        F.col(name_col), stem(F.col(name_col))))).alias("word"))
    return words.join(forms, "word").select(text_key, "name").distinct()

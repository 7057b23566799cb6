import random

from pyspark.sql import functions as F

from tablewright.operators.names import mentions_anywhere
from tablewright.operators.unmatched import column_fates


def test_names_with_blanks_anywhere(spark):
    names = ["my file.csv", "b.csv", "data", "a b c.tar.gz", ".hidden", "ünï côde.txt", "my file.tsv", "", "x"]
    texts = [(1, "see my file.csv, and b.csv."), (2, "my file is open"), (3, "metadata"), (4, None), (5, ""), (6, "a b c.tar is near; .hidden too"), (7, "ünï côde" * 1000), (1, "x again")]
    want = {(k, n) for k, t in texts for n in names if n and t and (n in t or (n[:n.rindex(".")] if "." in n[1:] else n) in t)}
    df, listed = spark.createDataFrame(texts, "request_id long, text string"), spark.createDataFrame([(n,) for n in names] * 2, "name string")
    for limit in (1 << 20, 8):
        got = mentions_anywhere(df, listed, shard_bytes=limit)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert (1, "my file.csv") in want and (1, "b.csv") in want and (2, "my file.tsv") in want
    assert mentions_anywhere(df, listed.where("false")).count() == 0 == mentions_anywhere(df.where("false"), listed).count()


def test_fates_of_columns(spark):
    rng = random.Random(3)
    rows = [(i, i % 25, f"name {i}", rng.random(), None if i % 7 == 0 else f"g{i % 5}", i * 2, "same", f"u{i}") for i in range(400)]
    before = spark.createDataFrame(rows, "row_id long, nation int, label string, amount double, seg string, twice long, fixed string, gone string")
    moved = before.select(F.col("row_id") + 1000, F.when(F.col("nation") < 5, F.col("nation") + 100).otherwise(F.col("nation")).cast("string").alias("nation"),
                          F.col("label").alias("full name"), F.concat(F.lit(" "), F.col("amount").cast("string")).alias("amount"),
                          F.when(F.col("seg") != "g1", F.col("seg")).alias("group"), "twice", F.lit("same").alias("fixed"), F.rand(1).alias("noise"))
    after = moved.orderBy(F.rand(2)).withColumnRenamed("(row_id + 1000)", "row_id")
    got = {r["column"]: (r.fate, r.found, round(r.share, 6)) for r in column_fates(before, after).collect()}
    assert got == {"nation": ("changed", "nation", 0.8), "label": ("renamed", "full name", 1.0), "amount": ("kept", "amount", 1.0), "seg": ("changed", "group", 0.8),
                   "twice": ("kept", "twice", 1.0), "fixed": ("kept", "fixed", 1.0), "gone": ("missing", None, 0.0), "noise": ("new", "noise", 0.0)}


def test_one_row_less_or_one_value_twice_is_no_equal_column(spark):
    a = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "row_id long, x string")
    twice = a.withColumn("x", F.when(F.col("row_id") == 3, "v4").otherwise(F.col("x")))
    assert [tuple(r) for r in column_fates(a, twice).collect()] == [("x", "changed", "x", 0.98)]
    assert [r.fate for r in column_fates(a, a.where("row_id < 49")).collect()] == ["changed"]
    assert [r.fate for r in column_fates(a, a.where("false")).collect()] == ["missing", "new"]


def test_shares_from_sketches(spark):
    a = spark.range(40_000).select(F.col("id").alias("row_id"), F.col("id").alias("x"))
    b = a.select("row_id", (F.col("x") + 10_000).alias("y"))
    (r, *_) = column_fates(a, b).where("column = 'x'").collect()
    assert r.fate == "changed" and abs(r.share - 0.75) < 0.06
    assert column_fates(a, b, least=0.9).where("column = 'x'").first().fate == "missing"

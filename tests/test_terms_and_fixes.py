import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.operators import terms, tfidf
from tablewright.plans.table_function import Contract, call_fix, register_fix


@pytest.mark.parametrize("heavy", [10_000, 5])
def test_sparse_vectors_of_all_terms(spark, monkeypatch, heavy):
    monkeypatch.setattr(terms, "HEAVY", heavy)
    rng = random.Random(2)
    texts = [(i, " ".join(["the", *rng.choices([f"w{k}" for k in range(60)], k=rng.randint(0, 25))])) for i in range(80)] + [(80, None), (81, ""), (82, "Ä ö!"), (83, "THE the")]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    model = terms.fit_terms(df, "text")
    counts = {i: Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for i, t in texts for w in [re.findall("[a-z0-9_]+", (t or "").lower())]}
    documents = Counter(t for c in counts.values() for t in c)
    listed = model.terms.orderBy("position").collect()
    assert [(r.position, r.term, r.documents) for r in listed] == [(i, t, documents[t]) for i, t in enumerate(sorted(documents))]
    assert [r.total for r in listed] == [sum(c[t] for c in counts.values()) for t in sorted(documents)]
    place = {t: i for i, t in enumerate(sorted(documents))}
    got = {r.id: dict(zip(r.positions, r.weights)) for r in model.vectors(df, "text", ["id"]).collect()}
    assert set(got) == {i for i, c in counts.items() if c}
    for i, vector in got.items():
        x = {place[t]: n * (math.log(85 / (1 + documents[t])) + 1) for t, n in counts[i].items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        assert vector == pytest.approx({p: v / length for p, v in x.items()}) and list(vector) == sorted(vector)
    few = tfidf.fit(df, "text", max_features=10 ** 6)
    assert few.terms == sorted(documents)
    assert terms.fit_terms(df.where("false"), "text").terms.count() == 0


CONTRACT = Contract("name string, age string", "name string, age double", keep=("row_id",), required=("name",), ranges={"age": (0, 120)}, patterns={"name": "[A-Z].*"})


def a_fix():
    """A function of its own, so that workers need not import this file."""
    def fix(row):
        if row["name"] == "skip":
            return None
        if row["name"] == "two":
            return [{"name": "One", "age": 1.0}, {"name": "two", "age": 2.0}]
        return {"name": row["name"], "age": float(row["age"])}

    return fix


def test_table_function_keeps_to_its_contract(spark):
    register_fix(spark, "fix_people", a_fix(), CONTRACT)
    rows = [(1, "Ann", "30"), (2, None, "3"), (3, "Bob", "300"), (4, "cid", "4"), (5, "Dan", "x"), (6, "skip", "1"), (7, "two", "1"), (8, "Eve", None)]
    df = spark.createDataFrame(rows, "row_id long, name string, age string")
    result = call_fix(df, "fix_people")
    assert result.success and result.df.columns == ["row_id", "name", "age", "contract_error"] and result.changes
    got = sorted(((r.row_id, r.name, r.age, (r.contract_error or "").split(":")[0]) for r in result.df.collect()), key=str)
    assert got == sorted([(1, "Ann", 30.0, ""), (2, None, 3.0, "name is missing"), (3, "Bob", 300.0, "age is out of range"), (4, "cid", 4.0, "name does not match"),
                          (5, None, None, "ValueError"), (7, "One", 1.0, ""), (7, "two", 2.0, "name does not match"), (8, None, None, "TypeError")], key=str)
    df.createOrReplaceTempView("people_to_fix")
    assert spark.sql("SELECT name FROM fix_people(TABLE(SELECT * FROM people_to_fix WHERE row_id = 1))").collect()[0][0] == "Ann"


def test_tables_that_are_refused(spark):
    register_fix(spark, "fix_people", a_fix(), CONTRACT)
    for df, words in ((spark.createDataFrame([(1, "a")], "row_id long, name string"), "column age is missing"),
                      (spark.createDataFrame([(1, "a", 2)], "row_id long, name string, age int"), "column age is int"),
                      (spark.createDataFrame([("a", "1")], "name string, age string"), "column row_id is missing")):
        result = call_fix(df, "fix_people")
        assert not result.success and result.error_kind == "execution" and words in result.error
    bad = call_fix(spark.createDataFrame([(1, "low", "1")], "row_id long, name string, age string"), "fix_people")
    assert not bad.success and bad.error_kind == "logical" and "name does not match" in bad.error
    none = call_fix(spark.createDataFrame([(1, "skip", "1")], "row_id long, name string, age string"), "fix_people")
    assert not none.success and none.error == "Result is empty"


def test_terms_are_exchanged_by_chunk_and_not_by_text(spark, monkeypatch):
    monkeypatch.setattr(tfidf, "CHUNK_BYTES", 500)
    texts = [(i, 0, "the same words again") for i in range(400)] + [(7, 1, "the"), (7, 1, "words, words"), (None, 1, "the")]
    df = spark.createDataFrame(texts, "id long, part int, text string").repartition(3)
    model = terms.fit_terms(df, "text", min_documents=2)
    assert {r.term: (r.total, r.documents) for r in model.terms.collect()} == {
        "again": (400, 400), "same": (400, 400), "same words": (400, 400), "the": (402, 402), "the same": (400, 400), "words": (402, 401), "words again": (400, 400)}
    dealt, parts = terms.chunked(df, "text", ["id", "part"])
    chunks = dealt.select("__chunk").distinct().count()
    listed = terms.placed_terms(dealt, model.terms, parts, 1, 2).selectExpr("sum(size(at))").first()[0]
    assert 10 < chunks < 20 and listed <= 7 * chunks
    got = {(r.id, r.part): [] for r in df.where("id is not null").collect()}
    for r in model.weights(df, "text", ["id", "part"]).collect():
        got[r.id, r.part].append((r.term, r.weight))
    idf = {t: math.log(404 / (1 + n)) + 1 for t, n in (("the", 402), ("words", 401))}
    # rows of one key share a length, and a row without a key has none
    length = math.hypot(idf["the"], 2 * idf["words"])
    assert sorted(got.pop((7, 1))) == [("the", pytest.approx(idf["the"] / length)), ("words", pytest.approx(2 * idf["words"] / length))]
    assert len(got) == 400 and all(len(v) == 7 and sum(w * w for _, w in v) == pytest.approx(1) for v in got.values())


def test_lists_of_terms_take_few_bytes(spark, monkeypatch):
    """What is exchanged holds a few bytes a term; counts are not kept beside the terms."""
    import os

    from tablewright import session

    monkeypatch.setattr(tfidf, "CHUNK_BYTES", 40_000)
    rng = random.Random(6)
    words = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(4_000)]
    df = spark.createDataFrame([(i, " ".join(rng.choices(words, k=200))) for i in range(400)], "id long, text string").repartition(3)
    stats = tfidf.text_statistics(df, "text")[0]
    model = terms.fit_terms(df, "text")
    assert [os.path.exists(p.removeprefix("file:")) for p in session._made if "/counts-" in p][-1] is False
    assert model.terms.count() == stats.count() > 50_000
    dealt, parts = terms.chunked(df, "text", ["id"])
    answers = terms._answers(dealt, model.terms, parts, 1, 2)
    asked = terms.placed_terms(dealt, model.terms, parts, 1, 2).agg(F.sum(F.size("at"))).first()[0]
    assert answers.agg(F.sum(F.octet_length("answer"))).first()[0] < 3 * asked and asked > 80_000
    plan = model.weights(df, "text", ["id"])._jdf.queryExecution().analyzed().toString()
    assert "array<" not in plan and not re.search(r"\b(at|position|idf)#\d+\[", plan)
    listed = model.weights(df, "text", ["id"]).groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert len(listed) == 400 and all(r.n == pytest.approx(1) for r in listed)


def test_packed_lists_come_back():
    import numpy as np
    import pyarrow as pa

    texts = pa.array(["cut", "", "a", "zwei w\u00f6rter", "a" * 70_000, ""])
    numbers = np.array([1, 0, 2 ** 32 - 1, 70_000, 5, 3])
    parts, blobs = tfidf.packed_by(np.array([9, 2, 9, 2, 9, 7]), texts, numbers)
    assert parts.tolist() == [2, 7, 9]
    back, (sizes, held) = tfidf.unpacked(blobs, 1)
    assert back.to_pylist() == [texts[i].as_py() for i in (1, 3, 5, 0, 2, 4)] and tfidf.joined(held).tolist() == [0, 70_000, 3, 1, 2 ** 32 - 1, 5]
    assert [len(s) for s in sizes] == [2, 1, 3]
    assert tfidf.unpacked([tfidf.packed(texts[2:4])], 0)[0].to_pylist() == ["a", "zwei w\u00f6rter"]
    assert tfidf.unpacked([], 2)[0].to_pylist() == [] and tfidf.unpacked([tfidf.packed(pa.array([], pa.string()))], 0)[0].to_pylist() == []


def test_words_are_split_as_by_the_pattern():
    import pyarrow as pa

    texts = ["", "a", "b_1 ", None, "ü ä9x", "x--y\n", " ", "z"]
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall(tfidf.TOKEN_PATTERN, t or "")]
    for whole in (pa.array(texts), pa.array(["cut", *texts]).slice(1), pa.array([], pa.string())):
        row, word = tfidf.split_words(whole)
        assert list(zip(row.tolist(), word.to_pylist())) == (want if len(whole) else [])

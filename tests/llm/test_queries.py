"""The registered queries on the smallest tables: every column that their contract fixes, computed anew; and the models behind two of them."""

import itertools
import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import rule_ensemble, toxic_spans
from tablewright.llm.queries import PIECES, QUERIES, WORD_TOKENIZER
from tablewright.llm.wordpiece import pieces_of_model
from tests.llm.test_documents import classes, longest_match, measures, shingles

SF_DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


@needs_data
def test_op1(spark, docs):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r for r in QUERIES["op1_decontamination"](spark, SF_DIR).collect()}
    tokens = {k: re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for k, t in items.items()}
    for (d, i), r in got.items():
        text = re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), docs[d]["text"]))
        runs = {tuple(text[k:k + 3]) for k in range(len(text) - 2)}
        w = tokens[i]
        held = {k + j for k in range(len(w) - 2) if tuple(w[k:k + 3]) in runs for j in range(3)}
        long = {tuple(text[k:k + 13]) for k in range(len(text) - 12)}
        assert 2 * len(held) >= len(w) or any(tuple(w[k:k + 13]) in long for k in range(len(w) - 12))
        assert r["score"] >= 0.4 and r["answer_overlap"] == 1
    whole = {(d, i) for d, r in docs.items() for i, t in items.items() if t in r["text"]}
    assert whole and whole <= set(got)


@needs_data
@pytest.mark.parametrize("name, parts, out, limit, label", [("op2_rule_ensemble", 5, 0, 0.3, "quality"), ("op7_toxic_spans", 3, 1, 0.7, "toxic")])
def test_op2_and_op7(spark, docs, tmp_path, name, parts, out, limit, label):
    rows = QUERIES[name](spark, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == out)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit)
    # what is held out is not learned from: other labels there give the same scores
    for t in ("documents", "labels"):
        table = spark.read.parquet(f"{SF_DIR}/{t}.parquet")
        if t == "labels":
            away = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == out
            table = table.withColumn(label, F.when(away, 1 - F.col(label)).otherwise(F.col(label)))
        table.write.parquet(str(tmp_path / f"{t}.parquet"))
    again = {r["doc_id"]: r["score"] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], abs=1e-6) for r in rows)


@needs_data
def test_op3(spark, docs):
    rows = [(i, r["text"], r["source"]) for i, r in sorted(docs.items())]
    low = classes(rows, 3, 85)
    got = {r["doc_id"]: r for r in QUERIES["op3_near_dedup"](spark, SF_DIR).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == low
    assert all(r["n_shingles"] == len(shingles(docs[i]["text"], 3)) and r["kept"] == (low[i] == i) for i, r in got.items())


@needs_data
def test_op4(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_TOKENIZER)
    pieces, sequences = {}, {}
    for r in QUERIES["op4_packing"](spark, SF_DIR).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(docs)
    for i, some in pieces.items():
        ids = np.array(tokenizer.encode(docs[i]["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(some, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    total = padded = 0
    for some in sequences.values():
        some.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in some] == list(itertools.accumulate([r["length"] for r in some[:-1]], initial=0))
        n = sum(r["length"] for r in some)
        assert n <= 2048
        total, padded = total + n, padded + (n if n & (n - 1) == 0 else 2048)
    assert padded == total


@needs_data
def test_op5(spark, docs):
    rows = QUERIES["op5_sharding"](spark, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs) and {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    shards, texts = {}, {}
    for r in rows:
        raw = (docs[r["doc_id"]]["text"] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw)
        shards.setdefault(r["shard"], []).append(r)
        texts.setdefault(raw, set()).add(r["shard"])
    assert set(shards) == set(range(24)) and all(len(s) == 1 for s in texts.values())
    groups = [sum(r["size"] for r in rows if (docs[r["doc_id"]]["text"] or "").encode() == t) for t in texts]
    sizes = [sum(r["size"] for r in some) for some in shards.values()]
    assert max(sizes) <= sum(sizes) / 24 + max(groups)
    assert all(sorted(r["slot"] for r in some) == list(range(len(some))) for some in shards.values())


@needs_data
def test_op10(spark, docs):
    initial, inner = pieces_of_model(PIECES)
    initial, inner = set(initial), set(inner)
    known = {}

    def count(word):
        if word not in known:
            known[word] = longest_match(initial, inner, word)
        return known[word]

    for r in QUERIES["op10_token_counts"](spark, SF_DIR).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]]["text"] or "")
        counts = [count(w) for w in words]
        assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (len(words), sum(c for c, _ in counts), sum(u for _, u in counts))


def test_statistics(messy, messy_rows):
    punctuation = set(np.flatnonzero(rule_ensemble.PUNCTUATION))

    def of(text):
        text = text or ""
        n_words, chars, symbols, dup_lines, repeats = measures(text)
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if x]
        upper, lower = (sum(a <= c <= z for c in text) for a, z in (("A", "Z"), ("a", "z")))

        def ratio(a, b):
            return a / b if b else 0.0

        return [math.log(1 + n_words), ratio(chars, n_words), ratio(symbols, chars), ratio(upper, upper + lower), ratio(sum("0" <= c <= "9" for c in text), chars),
                ratio(sum(c in "!?" for c in text), n_words), ratio(sum(b in punctuation for b in text.encode()), n_words), ratio(len(set(words)), n_words),
                ratio(repeats, n_words), ratio(sum(a == b for a, b in zip(words, words[1:])), n_words), ratio(dup_lines, len(lines)), ratio(n_words, len(lines))]

    got = rule_ensemble.statistics(messy).collect()
    want = sorted(([i is not None, i or 0, *of(t)] for i, t, _ in messy_rows))
    assert sorted([r["doc_id"] is not None, r["doc_id"] or 0, *(r[s] for s in rule_ensemble.STATISTICS)] for r in got) == [pytest.approx(w, abs=1e-9) for w in want]


def test_score_of_a_rule_model(spark):
    inf = float("inf")
    rules = [(rule_ensemble.Rule((("a", -inf, 0.5), ("b", 2.0, inf))), 1.5), (rule_ensemble.Rule((("a", 0.2, 0.7),)), -0.4), (rule_ensemble.Rule((("b", -inf, 2.0),)), 0.9)]
    points = [(a / 10, b / 2) for a in range(11) for b in range(9)]
    got = spark.createDataFrame(points, "a double, b double").select("a", "b", rule_ensemble.RuleModel(-0.3, rules).score().alias("s")).collect()
    for r in got:
        total = -0.3 + 1.5 * (r["a"] <= 0.5 and r["b"] > 2) - 0.4 * (0.2 < r["a"] <= 0.7) + 0.9 * (r["b"] <= 2)
        assert r["s"] == pytest.approx(1 / (1 + math.exp(-total)))


def test_gradient_of_the_chain():
    """Differences of the log likelihood, added up over all state sequences of small chains, in every number the fit moves."""
    rng = np.random.default_rng(3)
    for _ in range(10):
        sentence = np.concatenate([[0], np.cumsum(rng.integers(1, 6, 4))])
        n = sentence[-1]
        emission, moves, label = rng.normal(size=n), rng.normal(size=(2, 2)), rng.integers(0, 2, n)

        def likelihood(emission, moves):
            total = 0.0
            for a, z in zip(sentence[:-1], sentence[1:]):
                def weight(states):
                    return sum(emission[a + k] * s + moves[states[k - 1] if k else 0, s] for k, s in enumerate(states))

                total += weight(label[a:z].tolist()) - np.log(sum(np.exp(weight(s)) for s in itertools.product((0, 1), repeat=int(z - a))))
            return total

        p = toxic_spans.marginals(emission, sentence, moves)
        step = 1e-5
        for k in range(n):
            moved = emission.copy()
            moved[k] += step
            back = emission.copy()
            back[k] -= step
            assert label[k] - p[k] == pytest.approx((likelihood(moved, moves) - likelihood(back, moves)) / (2 * step), abs=1e-6)
        slope = toxic_spans.pair_expectations(emission, sentence, moves, p, label)
        for i, j in itertools.product((0, 1), repeat=2):
            up, down = moves.copy(), moves.copy()
            up[i, j] += step
            down[i, j] -= step
            assert slope[i, j] == pytest.approx((likelihood(emission, up) - likelihood(emission, down)) / (2 * step), abs=1e-6)


def test_documents_labelled_twice(spark):
    """Each label counts as a row of its own to learn from; every document is scored once."""
    texts = [(i, f"word{i} " * (3 + i % 5)) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, 1) for i in range(10)], "doc_id long, quality int")
    assert rule_ensemble.quality_scores(docs, labels).count() == 40

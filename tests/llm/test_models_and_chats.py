"""Classifiers by held-out results, decontamination and chats by brute force and round trips."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import chat, decontaminate, rule_ensemble, toxic_spans
from tests.llm.conftest import words

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# --- benchmark decontamination

@pytest.fixture(scope="module")
def bench_rows():
    rng = random.Random(8)
    return [(k, words(rng, rng.choice([6, 14, 30, 80]), "klmnopq")) for k in range(25)] + [(90, ""), (91, None), (92, "one"), (3, "again " + words(rng, 20, "klmnopq"))]


def test_leaks(spark, messy, bench_rows):
    rng = random.Random(9)
    by_id = dict(bench_rows[:25])
    leaked = {(500 + k, k): words(rng, rng.choice([0, 5, 90, 700])) + "\n" + by_id[k].upper() + "! " + words(rng, rng.choice([0, 40, 300])) for k in range(25) if k != 3}
    half = " ".join(by_id[9].split()[: len(by_id[9].split()) // 2])  # the question without its answer
    rows = [(d, t) for (d, _), t in leaked.items()] + [(600, half), (601, words(rng, 500, "klmnopq"))]
    docs = messy.select("doc_id", "text", "score").unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    items = decontaminate.split_items(spark.createDataFrame(bench_rows, "item_id long, text string"))
    got = decontaminate.leaks(docs, items).collect()
    # three documents hold the item of one word
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(leaked) | {(306, 92), (307, 92), (308, 92)}
    assert all(r["score"] > 0.99 and r["question_overlap"] == 1 == r["answer_overlap"] for r in got)


def test_leaks_with_many_shards(spark, bench_rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_POSTINGS", 100)
    docs = spark.createDataFrame([(k, t) for k, t in bench_rows[:25]], "doc_id long, text string")
    items = decontaminate.split_items(spark.createDataFrame(bench_rows[:25], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()} == {(k, k) for k in range(25)}


def test_leaks_of_items_that_stand_several_times(spark, bench_rows):
    docs = spark.createDataFrame(bench_rows[:10], "doc_id long, text string")
    items = spark.createDataFrame(bench_rows[:10] + bench_rows[:6] + bench_rows[:3], "item_id long, text string")
    got = decontaminate.leaks(docs, decontaminate.split_items(items)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(k, k) for k in range(10)]
    assert all(r["score"] > 0.99 for r in got)


@pytest.mark.parametrize("shards", [20_000, 100])
def test_parts_of_whole_items_leak(spark, monkeypatch, shards):
    """Half of the words in runs of three, or thirteen in a row; brute force on the words."""
    monkeypatch.setattr(decontaminate, "SHARD_POSTINGS", shards)
    rng = random.Random(21)
    # words of a small set, so that items and documents share most words but few runs
    bag = [words(rng, 1) + str(k) for k in range(150)]
    items = [(k, [rng.choice(bag) for _ in range(rng.choice([5, 8, 15, 40, 59, 70]))]) for k in range(60)]
    docs = []
    for k, w in items:
        n = len(w)
        changed = w.copy()
        changed[-2 if n < 15 else n // 2] = "changed"
        for part in (w[: -(-n * 4 // 5)], w[: -(-n * 2 // 3)], w[n // 2:], w[n // 4: n // 4 + -(-n // 2)], w[n // 3: n // 3 + 13], w[n // 3: n // 3 + 12], changed, w[: n // 3]):
            around = [[rng.choice(bag) for _ in range(rng.choice([0, 3, 80, 300]))] for _ in range(2)]
            docs.append((len(docs), around[0] + part + around[1]))

    def leaked(w, d):
        runs = {tuple(d[k:k + 3]) for k in range(len(d) - 2)}
        held = {k + j for k in range(len(w) - 2) if tuple(w[k:k + 3]) in runs for j in range(3)}
        long = {tuple(d[k:k + 13]) for k in range(len(d) - 12)}
        return 2 * len(held) >= len(w) or any(tuple(w[k:k + 13]) in long for k in range(len(w) - 12))

    # retrieval, by adding BM25 up for every window and item
    own_terms = [Counter(w) for _, w in items]
    df = Counter(t for c in own_terms for t in c)
    mean = sum(len(w) for _, w in items) / len(items)

    def weight(t, k):
        tf = own_terms[k][t]
        return np.log1p((len(items) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(items[k][1]) / mean))

    weights = [{t: weight(t, k) for t in own_terms[k]} for k in range(len(items))]
    longest = {}
    for _, w in items:
        kind = int(np.log(len(w)) / np.log(4))
        longest[kind] = max(longest.get(kind, 0), len(w))
    retrieved, want = set(), set()
    for i, d in docs:
        for kind, step in longest.items():
            for begin in range(0, max(1, len(d) - step), step):
                held = set(d[begin:begin + 2 * step])
                for k, w in items:
                    if int(np.log(len(w)) / np.log(4)) == kind and sum(x for t, x in weights[k].items() if t in held) >= 0.4 * sum(weights[k].values()):
                        retrieved.add((i, k))
                        if leaked(w, d[max(0, begin - step):begin + 3 * step]):
                            want.add((i, k))
    overlap = {(i, k) for i, d in docs for k, w in items if leaked(w, d)}
    # what the threshold leaves out of all that the words alone would verify, and the parts that no threshold may leave out
    assert want <= overlap and len(want) >= 0.9 * len(overlap) and len(retrieved) > 2 * len(want)
    assert {(8 * k + j, k) for k in range(60) for j in (0, 1)} <= want
    # retrieval decides: some documents hold thirteen words of an item in a row, and too little of its score
    assert overlap - want
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame, decontaminate.whole_items(bench)).collect()}
    if shards == 20_000:
        assert got == want
    else:  # items of a shard have windows of their own longest item
        assert got <= overlap and len(got) >= 0.9 * len(overlap)


def test_retrieval_decides(spark, monkeypatch):
    """Thirteen words of a long item in a row would verify it, but are too little of its score; a search that gives all items finds it."""
    item = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20, 33))), (2, item)], "doc_id long, text string")
    items = decontaminate.whole_items(spark.createDataFrame([(1, item), (2, "some other words " * 9)], "item_id long, text string"))
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()] == [(2, 1)]
    rows = decontaminate.postings(items).collect()
    shard = decontaminate.Shard(rows, 0.4)
    words, first = decontaminate.term_hashes(pa.array([" ".join(f"w{k}" for k in range(20, 33))]))
    assert not list(shard.passages(words, first)) and shard.wand(np.unique(shard.look_up(words))) == []
    # the words alone would have verified it
    at = next(k for k, w in enumerate(shard.words) if len(w) == 60)
    assert decontaminate.verified(shard.words[at], shard.split[at], words, decontaminate.LeakRule())[2]


def test_short_items_match_as_phrases(spark):
    docs = spark.createDataFrame([(1, "so Ten times ten, it is"), (2, "ten it times ten"), (3, "times ten"), (4, "what was asked: ten times ten")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ten times ten"), (2, "was"), (3, "!")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, decontaminate.whole_items(items)).collect()}
    assert got == {(1, 1), (4, 1), (4, 2)}
    parts = spark.createDataFrame([(1, "was asked", "ten times")], "item_id long, question string, answer string")
    assert [r["doc_id"] for r in decontaminate.leaks(docs, parts).collect()] == [4]


def test_question_and_answer_in_the_stage(spark):
    """Items with both parts: a document needs both of them."""
    rng = random.Random(5)
    items = [(k, words(rng, 20), words(rng, 12)) for k in range(12)]
    docs = [(3 * k + j, words(rng, 60) + " " + part) for k, q, a in items for j, part in enumerate((f"{q} {a}", q, a))]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, question string, answer string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(3 * k, k) for k in range(12)}
    assert all(r["question_overlap"] == r["answer_overlap"] == 1 for r in got)


def test_wand_finds_what_adding_up_finds():
    rng = np.random.default_rng(4)
    for _ in range(60):
        rows = []
        for i in range(30):
            terms = rng.choice(60, rng.integers(3, 15), replace=False)
            scores = rng.random(len(terms)) + 0.01
            rows.append({"item": i, "item_id": i, "length": len(terms), "words": terms.astype(np.uint64).tobytes(), "split": 1, "own": scores.sum(),
                         "postings": [{"term": int(t), "score": float(s)} for t, s in zip(terms, scores)]})
        shard = decontaminate.Shard(rows, 0.45)
        query = np.unique(rng.choice(len(shard.terms), 25))
        total = np.zeros(len(shard.ids))
        for t in query:
            for p in range(shard.first[t], shard.first[t + 1]):
                total[shard.item[p]] += shard.weight[p]
        assert [i for i, _ in shard.wand(query)] == list(np.flatnonzero(total >= 0.45))
        # the bounds of a passage of these words never rule out what the search finds
        hashes = shard.terms[query]
        opened = list(shard.passages(hashes, np.array([0, len(hashes)])))
        assert opened or not (total >= 0.45).any()


def test_no_items_or_documents(spark, messy, nothing, bench_rows):
    items = spark.createDataFrame(bench_rows, "item_id long, text string")
    assert decontaminate.leaks(nothing, decontaminate.split_items(items)).count() == 0
    assert decontaminate.leaks(messy, decontaminate.split_items(items.limit(0))).count() == 0


# --- rule ensemble

def test_rules_of_a_tree():
    text = "\n".join(["Model", "  Tree 0 (weight 1.0):", "    If (feature 0 <= 0.5)", "     If (feature 1 <= 2.0)", "      Predict: 0.0",
                      "     Else (feature 1 > 2.0)", "      Predict: 1.0", "    Else (feature 0 > 0.5)", "     Predict: 1.0"])
    inf = float("inf")
    assert rule_ensemble.tree_rules(text, ["a", "b"]) == {
        rule_ensemble.Rule((("a", -inf, 0.5),)), rule_ensemble.Rule((("a", -inf, 0.5), ("b", -inf, 2.0))),
        rule_ensemble.Rule((("a", -inf, 0.5), ("b", 2.0, inf))), rule_ensemble.Rule((("a", 0.5, inf),))}


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        good = rng.random() < 0.75
        body = words(rng, rng.randint(20, 120))
        rows.append((i, body if good else rng.choice([body.upper() + "!!", " ".join(f"{w}%%%" for w in body.split()), (body.split()[0] + " ") * 40]), int(good)))
    return rows


def test_quality_held_out(spark, messy, graded):
    docs = messy.select("doc_id", "text", "score").unionByName(
        spark.createDataFrame([(1000 + i, t) for i, t, _ in graded], "doc_id long, text string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(1000 + i, q) for i, _, q in graded[:600]] + [(None, 1), (7, None), (999_999, 0)], "doc_id long, quality int")
    scored = rule_ensemble.quality_scores(docs, labels)
    got = scored.collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    wrong = sum((score[1000 + i] >= 0.5) != bool(q) for i, _, q in graded[600:])
    assert wrong <= 6


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, 0)]])
def test_quality_without_two_classes(spark, messy, labels):
    got = rule_ensemble.quality_scores(messy, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == messy.count() and len({r["score"] for r in got}) == 1


def test_no_quality(spark, nothing):
    assert rule_ensemble.quality_scores(nothing, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


# --- toxic spans

def test_marginals_and_steps_against_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(1, 6, 4)
        sentence = np.concatenate([[0], np.cumsum(sizes)])
        emission, moves = rng.normal(0, 2, sentence[-1]), rng.normal(0, 1, (2, 2))
        got = toxic_spans.marginals(emission, sentence, moves)
        for a, z in zip(sentence[:-1], sentence[1:]):
            total, marked = 0.0, np.zeros(z - a)
            for code in range(1 << (z - a)):
                states = [code >> k & 1 for k in range(z - a)]
                weight = np.exp(sum(emission[a + k] for k, s in enumerate(states) if s) + sum(moves[p, s] for p, s in zip([0, *states], states)))
                total += weight
                marked += weight * np.array(states)
            assert np.allclose(got[a:z], marked / total)


def test_toxic_held_out_and_spans(spark, messy):
    rng = random.Random(6)
    rude = ["zzgrumf", "zzgrol", "zzgrank"]
    rows = []
    for i in range(900):
        body = words(rng, rng.randint(15, 80)).split()
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(1, 4)):
                body.insert(rng.randrange(len(body)), rng.choice(rude) + rng.choice(["", "s", "en", "."]))
        rows.append((1000 + i, "É. " + " ".join(body), int(toxic)))
    docs = messy.select("doc_id", "text", "score").unionByName(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows[:600]] + [(None, 1), (8, None)], "doc_id long, toxic int")
    got = toxic_spans.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    found = {r["doc_id"]: r for r in got}
    wrong = [i for i, _, x in rows[600:] if (found[i]["score"] >= 0.7) != bool(x)]
    assert len(wrong) <= 6
    texts = {i: t for i, t, _ in rows}
    spans = [texts[i][s["start"]:s["end"]] for i in texts for s in found[i]["spans"]]
    assert spans and sum("zzgr" in s for s in spans) > 0.95 * len(spans)
    assert found[300]["score"] == 0 and found[301]["score"] == 0 and not found[302]["spans"]


def test_no_toxic_labels(spark, messy, nothing):
    none = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert all(r["score"] < 0.1 for r in toxic_spans.toxicity(messy, none).collect())
    assert toxic_spans.toxicity(nothing, none).count() == 0


# --- chats

def test_escapes_are_reversible():
    template = chat.Template()
    for text in ["", "\\", "### User:", "\\### User:", "\\\\</turn>\\", "a </turn></turn> ### Role:\\### Text: <|endoftext|>", "### Use r: </turn"]:
        shown = template.escape(text)
        assert template.unescape(shown) == text
        assert all(shown[m.start()] == "\\" for m in template.controls().finditer(shown))


def test_chats_read_back(spark):
    rng = random.Random(2)
    parts = ["### Assistant:", "</turn>", "\\", "\n", "é\U0001f600", "<|endoftext|>", "word ", " ", "́", "### Text:"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool </turn>", None]), rng.choice([None, "", "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))]))
            for c in [1, 2, None, 4] for t in [None, 0, 1, 1, 2, 3]]
    rows += [rows[0], rows[0], (5, 0, "user", "long " * 60_000)] + [(6, t, "assistant", f"turn {t}") for t in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "conv_id long, turn long, role string, text string, ids string, start int")
    got = {r["conv_id"]: r for r in chat.formatted_and_read(df, TOKENIZER).collect()}
    template = chat.Template()
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        sha, loss, chars = hashlib.sha256(), "", 0
        for _, _, role, text in turns:
            sha.update(f"{role}\n{text}\n".encode())
            loss += text if role == "assistant" else ""
            head = template.printed[template.roles.index(role)] if role in template.roles else template.printed[-3] + template.escape(role) + template.printed[-2]
            chars += len(head) + len(template.escape(text)) + len(template.printed[-1])
        assert (r["n_turns"], r["turns_sha256"], r["formatted_chars"]) == (len(turns), sha.hexdigest(), chars)
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_masks_are_spans_of_the_assembled_conversation(spark):
    df = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "good day"), (1, 2, "user", "x"), (1, 3, "assistant", "")],
                               "conv_id long, turn long, role string, text string")
    turns = chat.format_chats(df, TOKENIZER).orderBy("turn_no").collect()
    tokenizer = chat.load_tokenizer(TOKENIZER)
    whole = [i for r in turns for i in r["ids"]]
    masked = [whole[r["loss_start"]:r["loss_end"]] for r in turns if r["loss_start"] is not None]
    assert [tokenizer.decode(m) for m in masked] == ["good day", ""]
    assert [r["start"] for r in turns] == [sum(len(x["ids"]) for x in turns[:k]) for k in range(4)]


def test_no_chats(spark):
    assert chat.formatted_and_read(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), TOKENIZER).count() == 0

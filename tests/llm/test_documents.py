"""Document operators against brute force, on rows with nulls, long texts, ties and clashing columns."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tablewright.llm import line_dedup, near_dedup, packing, quality_rules, sharding, wordpiece

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def classes(rows, size, percent):
    """doc_id -> smallest reachable id, by comparing all pairs."""
    sets = [(i, shingles(t, size)) for i, t, _ in rows if i is not None]
    low = {i: i for i, _ in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(i), find(j)
                low[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in sets}


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates(messy, messy_rows, size, percent):
    got = near_dedup.near_duplicates(messy, near_dedup.NearRule(size, percent)).collect()
    assert len(got) == len(messy_rows)
    want = classes(messy_rows, size, percent)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = {(i, len(shingles(t, size))) for i, t, _ in messy_rows}
    assert {(r["doc_id"], r["n_shingles"]) for r in got} == sizes


def test_near_duplicates_in_small_blocks(messy, messy_rows, monkeypatch):
    """Buckets and neighbourhoods that are split into many pairs of blocks give the same classes."""
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 3)
    monkeypatch.setattr(near_dedup, "CHECK_BLOCK", 2)
    got = near_dedup.near_duplicates(messy, near_dedup.NearRule(3, 85)).where("doc_id is not null").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == classes(messy_rows, 3, 85)


def test_keys_keep_the_guarantee():
    """Signatures within the distance agree on some chunk up to its share of errors."""
    rule = near_dedup.NearRule(3, 85)
    rng = np.random.default_rng(0)
    assert sum(e + 1 for _, e in rule.chunks) == rule.errors + 1
    for _ in range(500):
        wrong = np.zeros(rule.size, bool)
        wrong[rng.choice(rule.size, rule.errors, replace=False)] = True
        assert any(wrong[p].sum() <= e for p, e in rule.chunks)


def test_nothing_near(nothing):
    assert near_dedup.near_duplicates(nothing).count() == 0


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    marked = {i + k for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked))


def test_quality_measures(spark, messy, messy_rows):
    more = [(900, "a b c d e f a b c d e g\nx y\nx y\n x y", "s"), (901, "q " * 300, "s")]
    df = messy.select("doc_id", "text", "source", "score", "kept").unionByName(
        spark.createDataFrame(more, "doc_id long, text string, source string"), allowMissingColumns=True)
    got = quality_rules.quality_rules(df).collect()
    assert Counter((r["doc_id"], *(r[m] for m in quality_rules.MEASURES)) for r in got) == Counter((i, *measures(t)) for i, t, _ in messy_rows + more)
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and not r["host_rejected"])


def test_bad_hosts_go_and_small_ones_are_shrunk(spark):
    good, bad = "a b c d e f g h i j k l m", "no"
    rows = [(i, good, f"h{i % 20}") for i in range(2000)]
    rows += [(5000 + i, bad if i % 10 else good, "spam") for i in range(200)]
    rows += [(9000, bad, "tiny"), (9001, good, "tiny"), (9002, good, None)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[5010]["kept"] and got[5010]["host_rejected"] and not got[5010]["base_failed"]
    assert got[9001]["kept"] and got[9002]["kept"] and got[3]["kept"]


def test_quality_of_nothing(nothing):
    assert quality_rules.quality_rules(nothing).count() == 0


def removed_lines(rows, min_sites):
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for k, line in enumerate((t or "").split("\n")):
            body = line.strip(" \t\n\x0b\x0c\r")
            if len(WORD.findall(body)) >= line_dedup.MIN_WORDS:
                sites[body].add(s)
                place = (-1 if i is None else i, k)
                first[body] = min(first.get(body, place), place)
    out = {}
    for i, t, _ in rows:
        gone = []
        for k, line in enumerate((t or "").split("\n")):
            body = line.strip(" \t\n\x0b\x0c\r")
            if len(sites[body]) >= min_sites and first[body] != (-1 if i is None else i, k):
                gone.append(k)
        out[i] = gone
    return out


def test_line_dedup(messy, messy_rows):
    got = line_dedup.remove_spread_lines(messy, min_sites=8)
    assert sorted(got.columns) == sorted(messy.columns)
    got = got.collect()
    want = removed_lines(messy_rows, 8)
    assert len(got) == len(messy_rows) and any(want.values())
    texts = {i: t for i, t, _ in messy_rows}
    for r in got:
        assert r["removed_lines"] == want[r["doc_id"]]
        kept = [x for k, x in enumerate((texts[r["doc_id"]] or "").split("\n")) if k not in set(want[r["doc_id"]])]
        assert (r["text"] or "") == "\n".join(kept) and (r["text"] is None) == (texts[r["doc_id"]] is None)


def test_sketch_and_exact_count_agree_far_from_and_near_the_limit(spark):
    """Lines on 100 to 300 sites, limit 200: the sketch decides the far ones, the exact count the near ones."""
    rows = [(k * 1000 + s, f"line number {k} here", f"site{s}") for k in range(100, 301, 10) for s in range(k)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lines = line_dedup.line_table(df)
    found = {r["first"]["doc_id"] // 1000 for r in line_dedup.spread_lines(lines, min_sites=200).collect()}
    assert found == set(range(200, 301, 10))


def test_long_lines_have_a_lower_limit(spark):
    """Shared passages of otherwise different documents; the sites of short lines are as many as before."""
    long, edge = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("p", 51), ("q", 50)))
    rows = [(i, f"own text {i} here\n{long}\na short shared line", f"s{i}") for i in range(3)]
    rows += [(10 + i, f"own text {i} there\n{edge}", f"s{i}") for i in range(7)]
    rows += [(20 + i, f"more text {i}\n{long} end", f"s{i % 2}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["removed_lines"] for r in line_dedup.remove_spread_lines(df, long_sites=line_dedup.LONG_SITES).collect()}
    assert {i: x for i, x in got.items() if x} == {1: [1], 2: [1]}


def test_pipeline_removes_shared_passages(spark):
    import corpus_pipeline

    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, f"own text {i} here\n{passage}", "en", f"s{i}", 0) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert got == {0: rows[0][1], 1: "own text 1 here", 2: "own text 2 here"}


def test_no_lines(nothing):
    assert line_dedup.remove_spread_lines(nothing).count() == 0


def test_sharding(messy, messy_rows):
    got = sharding.shard_by_bytes(messy, 7).toPandas()
    assert len(got) == len(messy_rows)
    sizes = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in messy_rows)
    assert Counter(zip([None if x != x else int(x) for x in got.doc_id], got["size"], got.text_crc32)) == sizes
    assert got.groupby("text_crc32").shard.nunique().max() == 1
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    digests = {zlib.crc32((r["text"] or "").encode()): r["d"] for r in messy.select("text", sharding.digest(F.col("text")).alias("d")).collect()}
    groups = got.groupby("text_crc32")["size"].sum()
    order = [groups[c] for c in sorted(groups.index, key=digests.get)]

    def fits(capacity):
        used, room = 1, capacity
        for v in order:
            if v > capacity:
                return False
            if v > room:
                used, room = used + 1, capacity
            room -= v
        return used <= 7

    largest = got.groupby("shard")["size"].sum().max()
    assert fits(largest) and not fits(largest - 1)


@pytest.mark.parametrize("first", [0, 2, 4])
def test_cuts_found_by_opening_pieces(spark, monkeypatch, first):
    """With very few first pieces the search has to open them, and still finds the least capacity."""
    monkeypatch.setattr(sharding, "DIGEST_BITS", 20)
    monkeypatch.setattr(sharding, "FIRST_BITS", first)
    monkeypatch.setattr(sharding, "PIECES", 60)
    rng = np.random.default_rng(first)
    rows = [(int(d), int(s)) for d, s in zip(rng.choice(1 << 20, 400, replace=False), rng.integers(1, 100, 400))]
    capacity, cuts = sharding.minimax_cuts(spark.createDataFrame(rows, "digest long, size long"), 9)
    sizes = [s for _, s in sorted(rows)]

    def fits(c):
        used, at = 1, 0
        for s in sizes:
            used, at = (used + 1, s) if at + s > c else (used, at + s)
        return used <= 9

    assert max(sizes) <= capacity and fits(capacity) and not fits(capacity - 1)
    shards = np.bincount(np.searchsorted(cuts, [d for d, _ in rows], side="right"), [s for _, s in rows])
    assert len(shards) == 9 and shards.max() == capacity


def test_no_shards(nothing):
    assert sharding.shard_by_bytes(nothing, 5).count() == 0


def longest_match(initial, inner, word):
    n = at = 0
    while at < len(word):
        pieces = inner if at else initial
        to = next((j for j in range(len(word), at, -1) if word[at:j] in pieces), None)
        if to is None:
            return 1, 1
        at, n = to, n + 1
    return n, 0


def test_token_counts(messy, messy_rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    initial, inner = map(set, wordpiece.pieces_of_model(path))
    got = wordpiece.token_counts(messy, path).collect()
    want = Counter()
    for i, t, _ in messy_rows:
        found = [longest_match(initial, inner, w) for w in WORD.findall(t or "") if len(w) < 1000]
        if t and len(t) == 200_000:  # too long for the slow way
            found = [wordpiece.Automaton(initial, inner).count(t)]
        want[i, len(found), sum(n for n, _ in found), sum(u for _, u in found)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_tokens"], r["n_unknown"]) for r in got) == want


def test_automaton_against_longest_match():
    import random

    rng = random.Random(1)
    for _ in range(400):
        initial, inner = ({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 8))} for _ in range(2))
        automaton = wordpiece.Automaton(initial, inner)
        for _ in range(20):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
            assert automaton.count(word) == longest_match(initial, inner, word)


def test_packing(messy, messy_rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [(i, t) for i, t, _ in messy_rows] + [(400, "a <|endoftext|> b'll don't À̀ \x1c\x1d x y 123İ")]
    extra = messy.sparkSession.createDataFrame(texts[-1:], "doc_id long, text string")
    got = packing.pack(messy.select("doc_id", "text", "ids").unionByName(extra, allowMissingColumns=True), path, length=256).toPandas()
    want = Counter((i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t in texts)
    found = Counter()
    for doc, part in got.fillna({"doc_id": -1}).sort_values(["sequence_id", "offset"]).groupby("doc_id"):
        whole, at = b"", 0
        for start, ids, total in zip(part.start, part.ids, part.doc_tokens):
            assert start == at and len(ids) % 4 == 0
            whole, at = whole + ids, at + len(ids) // 4
            if at == total:
                found[None if doc == -1 else int(doc), whole] += 1
                whole, at = b"", 0
        assert at == 0
    assert found == want
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert list(part.offset) == [0, *np.cumsum(part.length)[:-1]]
        size = part.length.sum()
        assert size == 256 or size < 256 and size & (size - 1) == 0


def test_nothing_packed(nothing):
    assert packing.pack(nothing, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_hilbert_curve_visits_every_cell_by_single_steps():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(cells, bits=3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_count_cache_keeps_no_long_words():
    """Texts without spaces leave nothing behind, and many new words stay within the bound and a step."""
    from tablewright.llm import wordpiece

    known = wordpiece._Counts(wordpiece.Automaton(["a", "b"], ["a", "b"]))
    for k in range(200):
        assert known.total(["ab" * (2_000 + k)]) == 2 * (2_000 + k)
    assert not known
    many = [format(k, "b").replace("0", "a").replace("1", "b") for k in range(400_000)]
    assert known.total(many) == sum(map(len, many)) and len(known) <= wordpiece.CACHE_WORDS + wordpiece.CACHE_STEP

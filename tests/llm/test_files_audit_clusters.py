"""Id files, the audit of filter orders and centroid clusters, against brute force; odd rows; the registered queries."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import centroids, filter_audit, idfiles
from tablewright.llm.packing import WordIds
from tablewright.llm.queries import QUERIES, WORD_TOKENIZER
from tablewright.session import scratch_path

SF_DIR = "/root/testdata/sf0.001"


def encoded(rows):
    """(doc_id, start, n_tokens, crc32) of (doc_id, text) rows in order."""
    from tokenizers import Tokenizer

    tokenizer, at, out = Tokenizer.from_file(WORD_TOKENIZER), 0, []
    for i, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("width", range(1, 33))
def test_bits_round_trip(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 7, 8, 9, 4097):
        ids = rng.integers(0, 1 << width, n).astype("<u4")
        packed = idfiles.pack_bits(ids, width)
        assert len(packed) == (n * width + 7) // 8
        assert np.array_equal(idfiles.unpack_bits(packed, n, width), ids)
        bits = "".join(format(x, f"0{width}b")[::-1] for x in ids.tolist())
        assert packed == bytes(int(bits[k:k + 8][::-1], 2) for k in range(0, len(bits), 8))


def test_least_bits():
    assert [idfiles.bits_for(n) for n in (1, 2, 3, 256, 257, 32_000, 49_408, 65_537)] == [1, 1, 2, 8, 9, 15, 16, 17]
    with pytest.raises(ValueError):
        idfiles.pack_bits(np.array([4]), 2)


def test_random_access():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 40, 200)
    ids = rng.integers(0, 32_000, counts.sum()).astype("<u4")
    raw = idfiles.image(pa.array([f"d{k}" for k in range(200)]), counts, ids, 15, 3, 7, block=64)
    file = idfiles.IdFile(raw + b"\n")
    ends = np.cumsum(counts)
    assert (file.part, file.ordinal, file.n_docs, file.n_ids) == (3, 7, 200, len(ids))
    assert all(np.array_equal(file.document(k), ids[e - c:e]) for k, (c, e) in enumerate(zip(counts, ends)))
    for a, z in ((0, 0), (63, 65), (64, 128), (100, 1000), (len(ids) - 1, len(ids) + 50), (-5, 3)):
        assert np.array_equal(file.ids(a, z), ids[max(a, 0):max(z, 0)])
    for broken in (raw[:-1], b"x" * 100):
        with pytest.raises(ValueError):
            idfiles.IdFile(broken)


def test_files_of_odd_rows(spark, messy, messy_rows, nothing):
    path = scratch_path(spark, "ids")
    idfiles.write_id_files(messy, path, WORD_TOKENIZER, file_bytes=5_000, block=512)
    files = spark.read.parquet(f"{path}/manifest").orderBy("first").collect()
    assert len(files) > 5 and [f["first"] for f in files] == list(itertools.accumulate([f["n_ids"] for f in files[:-1]], initial=0))
    got = sorted(idfiles.read_digests(spark, path).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == sorted((i is not None, i or 0) for i, _, _ in messy_rows)
    # rows of one id may come in any order, so starts are held against the counts
    want = {}
    for i, text, _ in messy_rows:
        want.setdefault(i, []).append(encoded([(i, text)])[0][2:])
    at = 0
    for r in got:
        assert r["start"] == at
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        at += r["n_tokens"]
    whole = b"".join(r["ids"] for r in sorted(idfiles.read_documents(spark, path).collect(), key=lambda r: r["start"]))
    for a, z in ((0, 10), (2_000, 9_000), (at - 3, at + 3), (at, at + 5)):
        parts = idfiles.read_range(spark, path, a, z).orderBy("start").collect()
        assert b"".join(p["ids"] for p in parts) == whole[4 * a:4 * z]
    empty = scratch_path(spark, "ids")
    idfiles.write_id_files(nothing, empty, WORD_TOKENIZER)
    assert idfiles.read_digests(spark, empty).collect() == []


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "two words"), ("a", "one"), ("ab", None)], "doc_id string, text string")
    path = scratch_path(spark, "ids")
    idfiles.write_id_files(docs, path, WORD_TOKENIZER)
    assert sorted(map(tuple, idfiles.read_digests(spark, path).collect())) == sorted(encoded([("a", "one"), ("ab", None), ("b", "two words")]))


def test_word_cache_keeps_its_bound():
    """Texts without spaces, of new characters each: nothing of them is kept; many new words keep within the bound."""
    rng = random.Random(2)
    known = WordIds(WORD_TOKENIZER, cache_bytes=1 << 20)
    for _ in range(50):
        text = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(3_000)).encode()
        known.of(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 1)
    assert not known and not known.older and not known.held
    for _ in range(5):
        text = " ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(20_000)).encode()
        ids = known.of(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 1)
    # half the bound, and what one step of 10 000 words adds
    assert known.held < (1 << 19) + 10_000 * 600 and len(known) <= 20_000
    assert ids == [np.array(known.tokenizer.encode(text.decode(), add_special_tokens=False).ids + [1], known.dtype).tobytes()]


def audited(rows, labels):
    """The audit by walking through every order, document by document."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = {}
    for (i, t, source), ws in zip(rows, words):
        text = t or ""
        fails = {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
                 "D": any(c in "#$%&*|" for c in text), "E": i is not None and i > least[text]}
        good, toxic = (any(row[k] == 1 for row in labels if row[0] == i is not None) for k in (1, 2))
        for order in itertools.permutations("ABCDE"):
            alive = True
            for step, x in enumerate(order, 1):
                cell = out.setdefault((source or "", "".join(order), step), [0] * 7)
                cell[0] += alive and not fails[x]
                cell[1] += alive and fails[x]
                cell[2] += not alive and fails[x]
                cell[3] += fails[x] and sum(fails.values()) == 1
                cell[4] += alive and fails[x] and good
                cell[5] += alive and fails[x] and toxic
                alive = alive and not fails[x]
    for (source, order, step), cell in out.items():
        x = order[step - 1]
        cell[6] = sum(c[1] for (s, o, k), c in out.items() if s == source and o[k - 1] == x)
    return {k: tuple(map(int, v)) for k, v in out.items()}


def test_audit_of_odd_rows(spark, messy, nothing):
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 60)] + [(5, 0, 1), (7, None, None), (None, 1, 1), (104, 1, 1), (104, 0, 0)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in messy.collect()]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS part", "1 AS mask", "2 AS n")
    got = filter_audit.audit(messy.selectExpr("*", "1 AS part", "2 AS mask", "'z' AS same"), table).collect()
    want = audited(rows, labels)
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == want and len(got) == len(want)
    assert filter_audit.audit(nothing, table).collect() == []


def test_audit_text_spaces(spark):
    """Only the six ASCII spaces part words; other white space belongs to them."""
    rows = [(1, " " + " a" * 49 + "  b\x0bc\x0cd\r", "s"), (2, "\t\n ", "s"), (3, " ".join(f"w{k}" for k in range(50)), None), (4, "É" * 19 + "A", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == audited(rows, [])


def clustered(rows, k=8, rounds=10):
    """Lloyd's rounds over Python numbers, every centroid measured."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    cs = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for j in range(len(cs)):
            mine = [v for (_, v), (_, c) in zip(kept, near) if c == j]
            if mine:
                cs[j] = [sum(x) // len(mine) for x in zip(*mine)]
    near = assign()
    each = [sum(d for d, c in near if c == j) for j in range(len(cs))]
    return [(i, c, d, each[c], sum(each), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, near)]


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "2L AS distance", "array(1) AS v").repartition(3)


def test_clusters_of_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice((-0.1, 0.05, 0.1)) + c for _ in range(64)]) for i, c in enumerate(itertools.islice(itertools.cycle((0, 0.2, -0.4)), 60))]
    rows += [(100 + i, rows[3][1]) for i in range(40)] + [(7, rows[8][1]), (7, rows[8][1]), (None, rows[9][1])]
    rows += [(200, None), (201, []), (202, [0.1] * 63), (203, [0.1] * 65), (204, [None] + [0.1] * 63), (205, [float("nan")] + [0.1] * 63),
             (206, [float("inf")] + [0.1] * 63), (207, [-0.0] * 64), (208, [1e-12, -1e-12] * 32)]
    got = sorted(map(tuple, centroids.cluster(vectors_of(spark, rows)).collect()), key=str)
    assert got == sorted(clustered(rows), key=str) and len(got) == 105


def test_few_vectors_ties_and_none(spark):
    few = [(1, [0.0] * 64), (2, [0.5] * 64), (3, [0.25] * 64)]
    assert sorted(map(tuple, centroids.cluster(vectors_of(spark, few)).collect())) == sorted(clustered(few))
    tied = [(i, [0.25] * 64) for i in range(12)]  # every centroid is the same, number 0 takes all
    got = sorted(map(tuple, centroids.cluster(vectors_of(spark, tied)).collect()))
    assert got == sorted(clustered(tied)) and {r[1] for r in got} == {0}
    assert centroids.cluster(vectors_of(spark, [(1, [0.5] * 3)])).collect() == []


def test_numbers_beyond_64_bits(spark):
    far = [(1, [3e6] + [0.0] * 63), (2, [-3e6] + [0.0] * 63), (3, [0.0] * 64)] + [(10 + i, [2e6 + i] * 64) for i in range(12)]
    want = [(i, c, *(x if x < 1 << 63 else None for x in (d, e, n)), s) for i, c, d, e, n, s in clustered(far)]
    assert sorted(map(tuple, centroids.cluster(vectors_of(spark, far)).collect()), key=str) == sorted(want, key=str)
    vast = centroids.cluster(vectors_of(spark, [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64), *((10 + i, [1e300] * 64) for i in range(12))]))
    assert len(vast.collect()) == 15


def test_sign_tests_are_one_less_than_centroids():
    """Each vector meets the planes of the centroid that is ahead, and a tie leaves the smaller number ahead."""
    rng = np.random.default_rng(0)
    cs = rng.integers(-5, 6, (8, 4)).tolist()
    planes = centroids.Planes.of(cs)
    grid = np.array(list(itertools.product(range(-5, 6, 2), repeat=4)), np.int64)
    best, away = planes.nearest(grid)
    all_away = ((grid[:, None, :] - np.array(cs)[None]) ** 2).sum(axis=2)
    assert np.array_equal(best, all_away.argmin(axis=1)) and np.array_equal(away, all_away.min(axis=1))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_query_of_id_files(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    got = QUERIES["op11_id_files"](spark, SF_DIR)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == encoded(sorted((r["doc_id"], r["text"]) for r in docs))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_query_of_clusters(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op13_centroids"](spark, SF_DIR).collect())) == sorted(clustered(rows))

"""Toxic spans by a linear-chain conditional random field.

Documents carry labels, tokens do not. Words and word beginnings that stand almost only in toxic
documents are found by counting over the labelled rows; their tokens in toxic documents are the labelled
tokens. A two-state chain over sentences learns from them: a token's features are its word, its
beginnings and its end, hashed to a fixed number of weights. Forward-backward marginals mark spans, and
the spans give the score of a document and the offsets that offend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import bytewords as bw
from tablewright.llm.near_dedup import shingle_hashes
from tablewright.llm.rule_ensemble import sample_rows
from tablewright.llm.streams import bounded_batches
from tablewright.session import materialise

#: labelled documents that are counted, and those the chain is fitted on, at most
COUNT_DOCS = 20_000
CHAIN_DOCS = 3_000
WEIGHT_BITS = 18
#: bytes of the beginnings and of the end that are features of a word
PARTS = (4, 6, -3)
STEPS = 60
SPAN_AT = 0.5
SENTENCE_ENDS = bw.byte_table(b".!?\n")


@dataclass
class Tokens:
    """Words of a slice with their sentences; ``keys[j]`` are the hashes of feature j."""

    words: bw.Runs
    keys: list[np.ndarray]
    sentence: np.ndarray  # first word of each sentence, and the number of words

    @property
    def buckets(self) -> list[np.ndarray]:
        return [(k >> np.uint64(64 - WEIGHT_BITS)).astype(np.int64) for k in self.keys]


def tokens(data: np.ndarray, bounds: np.ndarray) -> Tokens:
    """Words are runs of letters and digits, ASCII case folded; sentences end at . ! ? and line breaks."""
    words = bw.runs(data, bounds, bw.ALNUM_BYTES, bw.LOWER_ASCII)
    keys = [words.hashes()]
    for j, size in enumerate(PARTS):
        start = words.start if size > 0 else np.maximum(words.start, words.end + size)
        end = np.minimum(words.end, words.start + size) if size > 0 else words.end
        part = bw.Runs(data, bounds, start, end, words.first, words.case).hashes()
        # the kind of part belongs to the key; a word that is no longer than the part has no such feature
        part = bw.mix(part + np.uint64(j + 1))
        keys.append(np.where(words.end - words.start > abs(size), part, np.uint64(j + 1)))
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SENTENCE_ENDS[data], out=ends[1:])
    n = len(words.start)
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        new[1:] = ends[words.start[1:]] != ends[words.start[:-1]]
        firsts = words.first[:-1]
        new[firsts[firsts < n]] = True
    return Tokens(words, keys, np.append(np.flatnonzero(new), n))


def marginals(emission: np.ndarray, sentence: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of the toxic state for every word, by forward-backward over all sentences at once.

    ``emission`` is the log weight of toxic against clean; ``moves[i, j]`` of the step from state i to j.
    """
    start, size = sentence[:-1], np.diff(sentence)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    odds = np.exp(np.clip(emission, -40, 40))
    step = np.exp(moves)
    forward, backward = np.empty(len(emission)), np.empty(len(emission))
    longest = int(size[0]) if len(size) else 0
    alive = len(size) - np.searchsorted(size[::-1], np.arange(longest), side="right")
    last = np.ones(0)
    for t in range(longest):
        at = start[:alive[t]] + t
        if t:
            r = last[:alive[t]]
            now = odds[at] * (r * step[1, 1] + step[0, 1]) / (r * step[1, 0] + step[0, 0])
        else:
            now = odds[at] * step[0, 1] / step[0, 0]  # a sentence begins after clean text
        forward[at] = last = np.clip(now, 1e-30, 1e30)
    ahead = np.ones(len(size))
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        at = start[:k] + t
        more = alive[t + 1] if t + 1 < longest else 0
        back = np.ones(k)
        if more:
            nxt = at[:more] + 1
            r = odds[nxt] * ahead[:more]
            back[:more] = (step[1, 1] * r + step[1, 0]) / (step[0, 1] * r + step[0, 0])
        backward[at] = ahead[:k] = back
    both = forward * backward
    return both / (1 + both)


def pair_expectations(emission: np.ndarray, sentence: np.ndarray, moves: np.ndarray, p: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Observed minus expected counts of the steps between states; steps into a sentence come from clean."""
    first = np.zeros(len(p), bool)
    first[sentence[:-1]] = True
    seen = np.zeros((2, 2))
    before = np.where(first, 0, np.roll(label, 1))
    np.add.at(seen, (before, label), 1)
    q = np.where(first, 0.0, np.roll(p, 1))
    # the pair weights given both ends' marginals, by the odds ratio of the step matrix
    odds = np.exp(moves[1, 1] + moves[0, 0] - moves[0, 1] - moves[1, 0])
    s = 1 + (q + p) * (odds - 1)
    both = q * p if abs(odds - 1) < 1e-9 else (s - np.sqrt(np.maximum(s * s - 4 * odds * (odds - 1) * q * p, 0))) / (2 * (odds - 1))
    both = np.where(first, 0.0, both)
    hoped = np.array([[np.sum(1 - q - p + both), np.sum(p - both)], [np.sum(q - both), np.sum(both)]])
    return seen - hoped


def fit_chain(features: list[np.ndarray], sentence: np.ndarray, label: np.ndarray, steps: int = STEPS, ridge: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, bias, moves) that maximise the penalised likelihood of the labelled tokens, by scaled gradient steps."""
    weights, bias, moves = np.zeros(1 << WEIGHT_BITS), -3.0, np.zeros((2, 2))
    if not len(label):
        return weights, bias, moves
    squares = np.full(1 << WEIGHT_BITS, 1e-2)
    bias_square, move_square = 1e-2, np.full((2, 2), 1e-2)
    free = np.array([[0, 1], [1, 1]])  # the step from clean to clean is the yardstick
    for _ in range(steps):
        emission = bias + sum(weights[f] for f in features)
        p = marginals(emission, sentence, moves)
        pull = label - p
        gradient = sum(np.bincount(f, pull, 1 << WEIGHT_BITS) for f in features) - ridge * weights
        squares += gradient**2
        weights += gradient / np.sqrt(squares)
        bias_square += pull.sum() ** 2
        bias += pull.sum() / np.sqrt(bias_square)
        slope = pair_expectations(emission, sentence, moves, p, label) * free
        move_square += slope**2
        moves = np.clip(moves + 0.3 * slope / np.sqrt(move_square), -6, 6)
    return weights, bias, moves


def _counted(train: DataFrame) -> DataFrame:
    """(key, n, toxic): labelled documents that hold a feature key; counted map-side per batch first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in bw.slices(batch, "text"):
                found = tokens(data, bounds)
                toxic = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                owner = found.words.owner()
                for keys in found.keys:
                    values, place = np.unique(keys, return_inverse=True)
                    held = np.unique(place * np.int64(part.num_rows) + owner)
                    place, doc = held // part.num_rows, held % part.num_rows
                    n = np.bincount(place, minlength=len(values))
                    t = np.bincount(place, toxic[doc], len(values)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(n), pa.array(t)], names=["key", "n", "toxic"])

    return train.select("text", "label").mapInArrow(count, "key long, n long, toxic long").groupBy("key").agg(
        F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def _families(train: DataFrame, candidates: np.ndarray) -> DataFrame:
    """(key, n, toxic): families of documents that hold a candidate key.

    A family shares the least hash of its word triples, as copies and near copies mostly do; so the words of
    a text that was copied often do not pass for words of many texts.
    """
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in bw.slices(batch, "text"):
                found = tokens(data, bounds)
                first = found.words.first
                triples, at = shingle_hashes(found.keys[0], first, 3)
                family = np.zeros(part.num_rows, np.uint64)
                worded = np.flatnonzero(np.diff(at))
                if len(worded):
                    family[worded] = np.minimum.reduceat(triples, at[:-1][worded])
                toxic, owner = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64), found.words.owner()
                for keys in found.keys:
                    hit = np.flatnonzero(candidates[np.minimum(np.searchsorted(candidates, keys), len(candidates) - 1)] == keys)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[hit].astype(np.int64)), pa.array(family[owner[hit]].astype(np.int64)),
                                                      pa.array(toxic[owner[hit]])], names=["key", "family", "toxic"])

    seen = train.select("text", "label").mapInArrow(look, "key long, family long, toxic long")
    return seen.groupBy("key", "family").agg(F.max("toxic").alias("toxic")).groupBy("key").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("toxic"))


def toxic_marks(train: DataFrame) -> list[int]:
    """Keys of features that stand almost only in toxic documents, the surest first.

    They are found by document counts, and confirmed by the families of documents that hold them. The statistics alone
    decide how many there are; as each stands in four documents or more of a sample of bounded size, so is their number bounded.
    """
    n, toxic = train.agg(F.count("*"), F.sum("label")).first()
    if not n or not toxic or toxic == n:
        return []

    def surest(counted: DataFrame) -> list[int]:
        hoped = F.col("n") * (toxic / n)
        surety = (F.col("toxic") - hoped) / F.sqrt(hoped)
        found = counted.where((F.col("toxic") >= 4) & (F.col("toxic") >= 0.9 * F.col("n")))
        return [r["key"] for r in found.select("key", surety.alias("z")).where("z > 5").orderBy(F.desc("z"), "key").collect()]

    candidates = np.sort(np.array(surest(_counted(train)), np.int64).astype(np.uint64))
    return surest(_families(train, candidates)) if len(candidates) else []


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        count_docs: int = COUNT_DOCS, chain_docs: int = CHAIN_DOCS) -> dict:
    """Weights of the chain, learned from at most ``count_docs`` labelled documents, in one task of ``chain_docs``."""
    bounded_batches(docs.sparkSession)
    chosen = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label")).where("_id is not null and label is not null")
    chosen = F.broadcast(sample_rows(chosen, count_docs, "_id"))  # bounded by count_docs
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    train = materialise(rows.join(chosen, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label"), "train")
    marks = np.sort(np.array(toxic_marks(train), np.int64).astype(np.uint64))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features: list[list[np.ndarray]] = [[] for _ in range(len(PARTS) + 1)]
        sentences, labels_, words = [np.zeros(1, np.int64)], [], 0
        for batch in batches:
            for part, data, bounds in bw.slices(batch, "text"):
                found = tokens(data, bounds)
                toxic = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                hit = np.zeros(len(found.words.start), bool)
                for keys in found.keys:
                    if len(marks):
                        hit |= marks[np.minimum(np.searchsorted(marks, keys), len(marks) - 1)] == keys
                labels_.append((hit & (toxic[found.words.owner()] == 1)).astype(np.int64))
                for kept, new in zip(features, found.buckets):
                    kept.append(new.astype(np.int32))
                sentences.append(found.sentence[1:] + words)
                words += len(hit)
        flat = [np.concatenate(f) if f else np.zeros(0, np.int32) for f in features]
        sentence = np.unique(np.concatenate(sentences))
        found_labels = np.concatenate(labels_) if labels_ else np.zeros(0, np.int64)
        if not words or not found_labels.any():
            weights, bias, moves = np.zeros(1 << WEIGHT_BITS), -12.0, np.zeros((2, 2))
        else:
            weights, bias, moves = fit_chain(flat, sentence, found_labels)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([float(bias)]),
                                          pa.array([moves.ravel().tolist()], pa.list_(pa.float64()))], names=["weights", "bias", "moves"])

    # toxic documents are few: take a third of the chain's documents from them
    toxic_part = sample_rows(train.where("label = 1"), chain_docs // 3)
    clean_part = sample_rows(train.where("label = 0"), chain_docs - chain_docs // 3)
    one = toxic_part.union(clean_part).select("text", "label").repartition(1)  # bounded by chain_docs
    row = one.mapInArrow(learn, "weights binary, bias double, moves array<double>").first()
    if row is None:
        return {"weights": np.zeros(1 << WEIGHT_BITS, np.float32), "bias": -12.0, "moves": np.zeros((2, 2))}
    return {"weights": np.frombuffer(row["weights"], np.float32).copy(), "bias": row["bias"], "moves": np.array(row["moves"]).reshape(2, 2)}


def tag(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text", span_at: float = SPAN_AT) -> DataFrame:
    """(doc_id, score, spans) for every row; spans are (start, end, p) in code points of the text.

    A span is a run of words of one sentence whose marginals reach ``span_at``; p is their mean. The score is
    the probability that at least one span is toxic, or the largest marginal where there is no span. Null
    and empty texts have no words and score 0. Repeated rows are all tagged; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    id_type = dict(docs.dtypes)[doc_id]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^WEIGHT_BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, moves = shared.value["weights"], shared.value["bias"], shared.value["moves"]
        for batch in batches:
            for part, data, bounds in bw.slices(batch, "text"):
                found = tokens(data, bounds)
                emission = np.full(len(found.words.start), bias)
                for b in found.buckets:
                    emission += weights[b]
                p = marginals(emission, found.sentence, moves)
                first, rows = found.words.first, part.num_rows
                score = np.zeros(rows)
                worded = np.flatnonzero(found.words.counts)
                if len(worded):
                    score[worded] = np.maximum.reduceat(p, first[:-1][worded])
                spans: list[list] = [[] for _ in range(rows)]
                hit = np.flatnonzero(p >= span_at)
                if len(hit):
                    points = bw.code_points(data)
                    owner = np.searchsorted(first, hit, "right") - 1
                    inside = np.searchsorted(found.sentence, hit, "right")
                    new = np.ones(len(hit), bool)
                    new[1:] = (np.diff(hit) > 1) | (np.diff(inside) > 0)
                    begin = np.flatnonzero(new)
                    clean = np.ones(rows)
                    for a, z in zip(begin, np.append(begin[1:], len(hit))):
                        low, high, doc = hit[a], hit[z - 1], owner[a]
                        sure = float(p[low:high + 1].mean())
                        clean[doc] *= 1 - sure
                        origin = points[bounds[doc]]
                        spans[doc].append({"start": int(points[found.words.start[low]] - origin), "end": int(points[found.words.end[high]] - origin), "p": sure})
                    marked = np.unique(owner)
                    score[marked] = 1 - clean[marked]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, score double, spans array<struct<start:long,end:long,p:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Fit on ``labels`` (rows to learn from) and tag all of ``docs``. Without toxic labels no text is toxic."""
    return tag(docs, fit(docs, labels, doc_id, text, label), doc_id, text)

"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items.

The index holds, per term, the items it occurs in with their BM25 weights, as shares of the score that an
item reaches with its own terms. So one threshold holds for items of any length. Items of similar length
form a class, in blocks that keep the largest weight of each term. Passages are windows of twice the
longest item of the class, moved on by half, so that an item always lies whole in some passage.

Retrieval is block-max WAND. For a whole batch of passages at once the sums of the term maxima, then of
the block maxima, are compared with the threshold: below it there is no pivot, and nothing is opened.
What remains goes item by item through cursors over the posting lists: the pivot is the first item at
which the maxima of the lists reach the threshold, blocks that cannot reach it are skipped whole.
The threshold is ``share`` of the item's own score, whatever verification asks for, so retrieval decides what is looked at:
every passage queries the index, and nothing but the bounds of the index keeps it from being searched.
Retrieved items are verified on the words: the question and the answer must both be covered by runs of
words that stand in the passage. An item without an answer of its own is verified as a whole, by the share
of its words or by one long run.

The index is built by aggregation and cut into shards of at most about ``SHARD_POSTINGS`` postings. A pass
over the documents broadcasts and searches ``PASS_SHARDS`` of them, so what is broadcast is bounded
however many test items there are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import bytewords as bw
from tablewright.llm.near_dedup import shingle_hashes
from tablewright.llm.streams import bounded_batches
from tablewright.session import materialise

SHARD_POSTINGS = 20_000
#: shards that one pass over the documents searches
PASS_SHARDS = 8
BLOCK_ITEMS = 2
#: items of a class differ in length by less than this factor
CLASS_FACTOR = 4
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class LeakRule:
    """``share``: of an item's own BM25 score, for a passage to retrieve it; ``overlap``: of the words of question and of answer,
    each; ``run``: words in a row that must agree for a word to count. An item that is one text matches by ``overlap``
    of all its words or by ``streak`` words in a row. Fewer than ``least`` words cannot be told from ordinary text by a
    part of them: such an item matches where all its words stand in a row."""

    share: float = 0.4
    overlap: float = 0.5
    run: int = 3
    least: int = 5
    streak: int = 13


def split_items(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, question, answer) of items that are one text: its last third, in words, stands for the answer."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    cut = F.ceil(F.size(words) * 2 / 3).cast("int")
    return items.select(F.col(item_id).alias("item_id"), F.array_join(F.slice(words, F.lit(1), cut), " ").alias("question"),
                        F.array_join(F.slice(words, cut + 1, F.greatest(F.size(words) - cut, F.lit(0))), " ").alias("answer"))


def whole_items(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, question, answer) of items that are one text without an answer of its own: the answer is null."""
    return items.select(F.col(item_id).alias("item_id"), F.col(text).alias("question"), F.lit(None).cast("string").alias("answer"))


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters and digits, ASCII case folded) of all texts, and their bounds."""
    data, bounds = bw.text_buffer(column)
    found = bw.runs(data, bounds, bw.ALNUM_BYTES, bw.LOWER_ASCII)
    return found.hashes(), found.first


def postings(items: DataFrame) -> DataFrame:
    """(item_id, words, split, term, tf, score): weights are shares of the item's own score.

    ``words`` are the term hashes of question and answer in order, ``split`` is the place of the answer.
    Items without a word are left out. Of items that repeat an id all count;
    rows that repeat id, question and answer are one item.
    """
    id_type = dict(items.dtypes)["item_id"]

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (q, qf), (a, af) = term_hashes(batch.column(1)), term_hashes(batch.column(2))
            rows = []
            for i in range(batch.num_rows):
                words = np.concatenate([q[qf[i]:qf[i + 1]], a[af[i]:af[i + 1]]])
                split = qf[i + 1] - qf[i]
                values, tf = np.unique(words, return_counts=True)
                rows.append((words.tobytes(), int(split), len(words), values.astype(np.int64), tf.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                 pa.array([r[4] for r in rows], pa.list_(pa.int64()))], names=["item_id", "words", "split", "length", "terms", "tfs"])

    read = items.select("item_id", "question", "answer").mapInArrow(
        terms, f"item_id {id_type}, words binary, split long, length long, terms array<long>, tfs array<long>")
    # a row that stands twice is one item: its terms would count twice in its own score
    read = read.where("length > 0").dropDuplicates(["item_id", "words", "split"])
    read = materialise(read.withColumn("item", F.xxhash64("item_id", "words", "split")), "items")
    flat = read.select("item", "length", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("item", "length", "p.terms", "p.tfs")
    df = flat.groupBy("terms").agg(F.count("*").alias("df"))
    corpus = read.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    bm25 = idf * F.col("tfs") * (K1 + 1) / (F.col("tfs") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = flat.join(df, "terms").crossJoin(F.broadcast(corpus))  # corpus is one row
    scored = scored.select("item", F.struct(F.col("terms").alias("term"), bm25.alias("score")).alias("p"))
    scored = scored.groupBy("item").agg(F.collect_list("p").alias("postings"), F.sum("p.score").alias("own"))  # an item's own terms
    return read.drop("terms", "tfs").join(scored, "item")


class Shard:
    """The index of some items of one length class, as arrays."""

    def __init__(self, rows: list, share: float):
        rows = sorted(rows, key=lambda r: (r["length"], r["item"]))
        self.ids = [r["item_id"] for r in rows]
        self.words = [np.frombuffer(r["words"], np.uint64) for r in rows]
        self.split = [r["split"] for r in rows]
        self.longest = max(r["length"] for r in rows)
        self.share = share
        item = np.repeat(np.arange(len(rows)), [len(r["postings"]) for r in rows])
        term = np.array([p["term"] for r in rows for p in r["postings"]], np.int64).astype(np.uint64)
        weight = np.array([p["score"] / r["own"] for r in rows for p in r["postings"]])
        self.terms, place = np.unique(term, return_inverse=True)
        order = np.lexsort((item, place))
        # lists: cursors step through single numbers
        self.item, self.weight = item[order].tolist(), weight[order].tolist()
        self.first = np.searchsorted(place[order], np.arange(len(self.terms) + 1)).tolist()
        self.blocks = -(-len(rows) // BLOCK_ITEMS)
        self.block_max = np.zeros((len(self.terms), self.blocks), np.float32)
        np.maximum.at(self.block_max, (place, item // BLOCK_ITEMS), weight.astype(np.float32))
        self.block_max *= np.float32(1 + 1e-5)  # a bound also after rounding, of sums too
        self.term_max = self.block_max.max(axis=1)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """The term number of each word, -1 for words outside the index."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def wand(self, query: np.ndarray, live: np.ndarray | None = None) -> list[tuple[int, float]]:
        """(item, score) of all items that the distinct terms of ``query`` give the threshold, by block-max WAND.

        ``live`` are the blocks whose maxima reach it, where they are known.
        """
        if live is None:
            live = np.flatnonzero(self.block_max[query].sum(axis=0) >= self.share)
        items, share, last, blocks = self.item, self.share, len(self.ids), live.tolist()
        most = self.term_max[query].tolist()
        cursors = [[items[self.first[t]], self.first[t], self.first[t + 1], m] for t, m in zip(query.tolist(), most)]
        found = []

        def advance(some: list[list], item: int) -> None:
            for c in some:
                if c[0] < item:
                    c[1] = at = bisect_left(items, item, c[1], c[2])
                    c[0] = items[at] if at < c[2] else last

        place = 0
        while True:
            cursors.sort()
            while cursors and cursors[-1][0] == last:
                cursors.pop()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[3]
                if bound >= share:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            place = bisect_left(blocks, item // BLOCK_ITEMS, place)
            if place == len(blocks):
                return found
            ahead = cursors[:pivot + 1]
            if blocks[place] * BLOCK_ITEMS > item:
                advance(cursors, blocks[place] * BLOCK_ITEMS)  # nothing of the blocks before can reach it
            elif ahead[0][0] == item:
                score = sum(self.weight[c[1]] for c in ahead)
                if score >= share:
                    found.append((item, score))
                advance(ahead, item + 1)
            else:
                advance(ahead, item)

    def passages(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(text, from word, to word, term numbers, blocks) of the passages that some blocks could answer."""
        step = self.longest
        counts = np.diff(first)
        segments = -(-counts // step)
        base = np.concatenate([[0], np.cumsum(segments)])
        if not base[-1]:
            return
        term = self.look_up(hashes)
        known = np.flatnonzero(term >= 0)
        term = term[known]
        owner = np.searchsorted(first, known, side="right") - 1
        segment = base[owner] + (known - first[owner]) // step
        pair = np.unique(segment * np.int64(len(self.terms)) + term)
        segment, term = pair // len(self.terms), pair % len(self.terms)
        bounds = np.searchsorted(segment, np.arange(base[-1] + 1))
        text_of = np.repeat(np.arange(len(counts)), segments)
        follows = np.zeros(base[-1], bool)  # is the next segment of the same text
        follows[:-1] = text_of[1:] == text_of[:-1]

        def reach(most: np.ndarray) -> np.ndarray:
            """Bounds of each window: its segment and the next, summed over their terms."""
            total = np.zeros((len(term) + 1, *most.shape[1:]), np.float64)
            np.cumsum(most[term], axis=0, out=total[1:])
            own = total[bounds[1:]] - total[bounds[:-1]]
            own[:-1][follows[:-1]] += (total[bounds[2:]] - total[bounds[1:-1]])[follows[:-1]]
            return own

        alive = reach(self.term_max) >= self.share
        # a text of several segments is covered by the windows that start at all but its last one
        starts = follows | (segments[text_of] == 1)
        alive &= starts
        tested = np.flatnonzero(alive)
        for at in range(0, len(tested), 2048):
            some = tested[at:at + 2048]
            ends = np.where(follows[some], bounds[np.minimum(some + 2, base[-1])], bounds[some + 1])
            sizes = ends - bounds[some]
            to = np.cumsum(sizes)
            rows = np.arange(to[-1]) - np.repeat(to - sizes, sizes) + np.repeat(bounds[some], sizes)
            sums = np.add.reduceat(self.block_max[term[rows]], to - sizes, axis=0)
            for k in np.flatnonzero(sums.max(axis=1) >= self.share):
                s = some[k]
                text = int(text_of[s])
                begin = int(first[text] + (s - base[text]) * step)
                yield text, begin, min(begin + 2 * step, int(first[text + 1])), np.unique(term[bounds[s]:ends[k]]), np.flatnonzero(sums[k] >= self.share)


def covered(part: np.ndarray, passage: np.ndarray, run: int) -> float:
    """Share of the words of ``part`` that stand in runs of ``run`` words (all, if it has fewer) of the passage."""
    if not len(part):
        return 1.0
    n = min(run, len(part))
    if len(passage) < n:
        return 0.0
    mine, _ = shingle_hashes(part, np.array([0, len(part)]), n)
    theirs, _ = shingle_hashes(passage, np.array([0, len(passage)]), n)
    hit = np.isin(mine, theirs)
    mark = np.zeros(len(part), bool)
    for k in range(n):
        mark[k:k + len(hit)] |= hit
    return float(mark.mean())


def streak_stands(part: np.ndarray, passage: np.ndarray, streak: int) -> bool:
    """Do ``streak`` words in a row of ``part`` stand in the passage."""
    if min(len(part), len(passage)) < streak:
        return False
    mine, theirs = (shingle_hashes(x, np.array([0, len(x)]), streak)[0] for x in (part, passage))
    return bool(np.isin(mine, theirs).any())


def verified(words: np.ndarray, split: int, passage: np.ndarray, rule: LeakRule) -> tuple[float, float, bool]:
    """(overlap of the question, of the answer, do they make a match) of an item and a passage that retrieved it."""
    question, answer = covered(words[:split], passage, rule.run), covered(words[split:], passage, rule.run)
    if len(words) < rule.least:
        return question, answer, streak_stands(words, passage, len(words))
    whole = split in (0, len(words))
    return question, answer, min(question, answer) >= rule.overlap or whole and streak_stands(words, passage, rule.streak)


def leaks(docs: DataFrame, items: DataFrame, rule: LeakRule = LeakRule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): every verified match of a document and an item.

    ``items`` has item_id, question and answer (see ``whole_items`` and ``split_items``); an empty or null question
    or answer counts as covered, and the item is verified as a whole: by ``rule.overlap`` of its words or
    ``rule.streak`` of them in a row. An item of fewer than ``rule.least`` words matches where all of them stand in a row. ``score`` is the share of the item's own BM25 score in the best passage. Null and empty
    texts match nothing; an empty table of either kind gives no rows. Rows that repeat a doc_id are one
    document. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    doc_type, item_type = dict(docs.dtypes)[doc_id], dict(items.dtypes)["item_id"]
    schema = f"doc_id {doc_type}, item_id {item_type}, score double, question_overlap double, answer_overlap double"
    index = postings(items).withColumn("class", F.floor(F.log(F.col("length")) / F.log(F.lit(float(CLASS_FACTOR)))))
    total = index.agg(F.sum(F.size("postings"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_POSTINGS))
    index = materialise(index.withColumn("shard", F.pmod("item", F.lit(shards))), "index")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = None
    for low in range(0, shards, PASS_SHARDS):
        held: dict[tuple, list] = {}
        for r in index.where(F.col("shard").between(low, low + PASS_SHARDS - 1)).collect():  # bounded, see above
            held.setdefault((r["shard"], r["class"]), []).append(r)
        shared = spark.sparkContext.broadcast([Shard(own, rule.share) for own in held.values()])
        part = rows.mapInArrow(_search(shared, rule), schema)
        found = part if found is None else found.union(part)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct(
        F.least("question_overlap", "answer_overlap").alias("least"), "score", "question_overlap", "answer_overlap")).alias("best")).select(
        "doc_id", "item_id", "best.score", "best.question_overlap", "best.answer_overlap")


def _search(shared, rule: LeakRule):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, data, bounds in bw.slices(batch, "text"):
                found = bw.runs(data, bounds, bw.ALNUM_BYTES, bw.LOWER_ASCII)
                hashes = found.hashes()
                for shard in shared.value:
                    for text, begin, end, query, live in shard.passages(hashes, found.first):
                        for item, score in shard.wand(query, live):
                            # an item may reach over the edge of the passage
                            low = max(begin - shard.longest, int(found.first[text]))
                            passage = hashes[low:min(end + shard.longest, int(found.first[text + 1]))]
                            question, answer, matches = verified(shard.words[item], shard.split[item], passage, rule)
                            if matches:
                                out.append((part.column(0)[text].as_py(), shard.ids[item], score, question, answer))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return search

"""Token counts of greedy longest-match word pieces, by a linear automaton.

The vocabulary is a trie with two kinds of pieces: those that begin a word and those that continue one.
Where the longest match cannot go on, a failure link leads to the node for what is left after popping
the matched pieces, and the number of pieces popped on the way is stored with the link. Counting a word
takes one step per character plus the links, never a retry, and no piece is ever built.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.streams import bounded_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: counts kept per Python worker, and the characters of a word beyond which its count is not kept; the cache starts anew when full
CACHE_WORDS = 300_000
LONG_WORD = 64
#: words looked up between two looks at the bound
CACHE_STEP = 10_000


class Automaton:
    """Counts greedy longest-match pieces of a word.

    ``initial`` are pieces that begin a word, ``inner`` those that continue one. ``count`` gives
    (pieces, 1 if the word cannot be cut into pieces): such a word is one unknown token.
    """

    def __init__(self, initial: Iterable[str], inner: Iterable[str]):
        self.children: list[dict[str, int]] = [{}, {}]  # 0: start of a word, 1: start of a continuation
        self.piece = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for p in pieces:
                if p:
                    self._insert(root, p)
        n = len(self.children)
        self.fail, self.pops = [-1] * n, [0] * n
        self._link()

    def _insert(self, root: int, piece: str) -> None:
        at = root
        for c in piece:
            to = self.children[at].get(c)
            if to is None:
                to = len(self.children)
                self.children[at][c] = to
                self.children.append({})
                self.piece.append(False)
            at = to
        self.piece[at] = True

    def _link(self) -> None:
        """Failure links, breadth first: a link leads to a node of fewer characters."""
        queue = [0, 1]
        for at in queue:
            for c, to in self.children[at].items():
                queue.append(to)
                if self.piece[to]:
                    self.fail[to], self.pops[to] = 1, 1  # the whole is a piece: pop it
                    continue
                back, popped = self.fail[at], self.pops[at]
                while back >= 0 and c not in self.children[back]:
                    popped += self.pops[back]
                    back = self.fail[back]
                if back >= 0:
                    self.fail[to], self.pops[to] = self.children[back][c], popped

    def count(self, word: str) -> tuple[int, int]:
        children, fail, pops = self.children, self.fail, self.pops
        at, total = 0, 0
        for c in word:
            to = children[at].get(c)
            while to is None:
                total += pops[at]
                at = fail[at]
                if at < 0:
                    return 1, 1
                to = children[at].get(c)
            at = to
        while at != 1:  # the rest of the word is popped the same way
            total += pops[at]
            at = fail[at]
            if at < 0:
                return 1, 1
        return total, 0


def pieces_of_model(path: str) -> tuple[list[str], list[str]]:
    """(initial, inner) pieces of a SentencePiece model: its mark of a word's begin tells them apart."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    mark = "▁"
    initial, inner = [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or piece == mark:
            continue
        if piece.startswith(mark):
            initial.append(piece[1:])
        else:
            inner.append(piece)
    return initial, inner


class _Counts(dict):
    """Counts by word; a missing word is counted when it is asked for."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        pieces, unknown = self.automaton.count(word)
        value = pieces | unknown << 40
        if len(word) <= LONG_WORD:
            self[word] = value
        return value

    def total(self, words: list[str]) -> int:
        """The sum over the words, in steps, so that a text of many new words cannot outgrow the bound."""
        out = 0
        for k in range(0, len(words), CACHE_STEP):
            if len(self) > CACHE_WORDS:
                self.clear()
            out += sum(map(self.__getitem__, words[k:k + CACHE_STEP]))
        return out


_loaded: dict[str, _Counts] = {}


def token_counts(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for every row of ``docs``.

    ``vocabulary`` is the path of a SentencePiece model that every worker can open. Words are runs of
    ``[^\\x20\\x09-\\x0D]+``. A word that the pieces cannot spell counts as one token, and as unknown.
    Null and empty texts count 0. Repeated rows are counted each; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    id_type = dict(docs.dtypes)[doc_id]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _loaded:
            _loaded[vocabulary] = _Counts(Automaton(*pieces_of_model(vocabulary)))
        known = _loaded[vocabulary]
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = WORD.findall(text) if text else []
                out.append((len(words), known.total(words)))
            tokens = [t & (1 << 40) - 1 for _, t in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in out], pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([t >> 40 for _, t in out], pa.int64())], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(count, f"doc_id {id_type}, n_words long, n_tokens long, n_unknown long")

"""Chat formatting by assembling token segments.

Every turn is encoded on its own. The marks of the template are reserved ids beyond the vocabulary and
are spliced between the segments, so no text can forge one. In the text form of the template the marks
are strings; where such a string (or a special token of the tokenizer) stands in a content, one backslash
is put before it and before the backslashes that already precede it, which reading back takes off again.
Prefix sums of segment lengths give each turn's place and the spans that the loss looks at.

A conversation is a sequence of rows, one per turn, so one of any length is never gathered; reading back
streams over the rows in order.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.streams import bounded_batches
from tablewright.session import materialise


@dataclass(frozen=True)
class Template:
    """Marks in the order of their reserved ids. A role without a mark of its own is written out."""

    roles: tuple[str, ...] = ("system", "user", "assistant")
    trained: tuple[str, ...] = ("assistant",)
    specials: tuple[str, ...] = ("<|endoftext|>",)

    @property
    def marks(self) -> list[str]:
        return [f"### {r.capitalize()}:" for r in self.roles] + ["### Role:", "### Text:", "</turn>"]

    @property
    def printed(self) -> list[str]:
        """The marks as the text form shows them."""
        return [f"{m}\n" for m in self.marks[:-1]] + [f"\n{self.marks[-1]}\n"]

    def controls(self) -> re.Pattern:
        return re.compile(r"(\\*)(" + "|".join(map(re.escape, [*self.marks, *self.specials])) + ")")

    def escape(self, text: str) -> str:
        return self.controls().sub(r"\\\1\2", text)

    def unescape(self, text: str) -> str:
        return self.controls().sub(lambda m: m[0][1:] if m[1] else m[0], text)


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a content are ordinary text
    return tokenizer


def encode_turns(turns: DataFrame, tokenizer: str, template: Template = Template()) -> DataFrame:
    """Each row's ids with its marks: adds ``ids``, ``head`` (ids before the text) and ``n_ids``."""
    bounded_batches(turns.sparkSession)
    types = dict(turns.dtypes)
    columns = turns.columns

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load_tokenizer(tokenizer)
        base = known.get_vocab_size()
        other, body, end = (base + len(template.roles) + i for i in range(3))
        own = {r: base + i for i, r in enumerate(template.roles)}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [template.escape(t) for t in part.column(columns.index("text")).to_pylist()]
                roles = part.column(columns.index("role")).to_pylist()
                found = [e.ids for e in known.encode_batch(texts, add_special_tokens=False)]
                heads = [[own[r]] if r in own else [other, *known.encode(template.escape(r), add_special_tokens=False).ids, body] for r in roles]
                ids = [[*h, *f, end] for h, f in zip(heads, found)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([len(h) for h in heads], pa.int64()),
                     pa.array([len(i) for i in ids], pa.int64())], names=[*columns, "ids", "head", "n_ids"])

    return turns.mapInArrow(encode, ", ".join(f"{c} {types[c]}" for c in columns) + ", ids array<int>, head long, n_ids long")


def format_chats(turns: DataFrame, tokenizer: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", template: Template = Template()) -> DataFrame:
    """One row per turn: (conv_id, turn_no, role, ids, start, loss_start, loss_end).

    ``start`` is the place of the turn's first id in its conversation; ids ``loss_start`` (inclusive) to
    ``loss_end`` (exclusive) of the conversation are those under the loss mask, null for a turn that is not
    trained on. Turns are ordered by ``turn`` (null first), ties by role and text; repeated rows are
    repeated turns. Null texts and roles are empty ones; rows with a null conv_id are one conversation.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    coded = encode_turns(rows, tokenizer, template)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = coded.withColumn("turn_no", F.row_number().over(order) - 1).withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    trained = F.col("role").isin(*template.trained)
    return placed.select("conv_id", "turn_no", "role", "ids", "start",
                         F.when(trained, F.col("start") + F.col("head")).alias("loss_start"),
                         F.when(trained, F.col("start") + F.col("n_ids") - 1).alias("loss_end"))


def read_back(formatted: DataFrame, tokenizer: str, template: Template = Template()) -> DataFrame:
    """What the ids and masks of ``format_chats`` say: one row of digests per conversation."""
    id_type = dict(formatted.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load_tokenizer(tokenizer)
        base = known.get_vocab_size()
        other, body, end = (base + len(template.roles) + i for i in range(3))
        current, state = None, None

        def plain(ids: list[int]) -> tuple[str, str]:
            shown = known.decode(ids, skip_special_tokens=False) if ids else ""
            return shown, template.unescape(shown)

        def closed() -> list:
            n, turns, loss_chars, loss, chars = state
            return [n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars]

        for batch in batches:
            done = []
            for conv, ids, start, low, high in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if state is None or conv != current:
                    if state is not None:
                        done.append([current, *closed()])
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if ids[-1] != end:
                    raise ValueError("a turn is not closed")
                if ids[0] == other:
                    cut = ids.index(body)
                    shown, role = plain(ids[1:cut])
                    state[4] += len(template.printed[-3]) + len(shown) + len(template.printed[-2])
                else:
                    cut, role = 0, template.roles[ids[0] - base]
                    state[4] += len(template.printed[ids[0] - base])
                shown, text = plain(ids[cut + 1:-1])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[4] += len(shown) + len(template.printed[-1])
                if low is not None:
                    masked = plain(ids[low - start:high - start])[1]
                    state[2] += len(masked)
                    state[3].update(masked.encode())
            if done:
                yield rows(done)
        if state is not None:
            yield rows([[current, *closed()]])

    def rows(done: list[list]) -> pa.RecordBatch:
        types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no").select("conv_id", "ids", "start", "loss_start", "loss_end")
    return ordered.mapInArrow(read, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted_and_read(turns: DataFrame, tokenizer: str, template: Template = Template()) -> DataFrame:
    """Format all conversations, write them, and read them back."""
    return read_back(materialise(format_chats(turns, tokenizer, template=template), "chats"), tokenizer, template)

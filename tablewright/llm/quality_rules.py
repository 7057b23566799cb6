"""Document rules, and the verdicts they give about hosts.

Each document is measured in one pass over its bytes. Failures of every rule are counted by host, the
rates are shrunk towards the corpus by a beta prior estimated from all hosts, and a host whose shrunk
rate of any rule reaches the limit is rejected with all its documents. Small hosts stay near the prior,
so a few bad pages do not condemn them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm import bytewords as bw
from tablewright.llm.near_dedup import shingle_hashes
from tablewright.llm.streams import bounded_batches
from tablewright.session import materialise

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = bw.byte_table(b"#*$%&|<>")
REPEAT_WINDOW = 5

#: name -> SQL condition of failure over the measures; these two fail a document by themselves
BASE_RULES = {
    "few_words": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
}
#: counted for the verdict about the host only
HOST_RULES = {
    "symbols": "10 * n_symbols > word_chars",
    "long_words": "word_chars > 40 * n_words",
    "dup_lines": "10 * n_dup_lines > n_words",
}
REJECT_RATE = 0.5
#: strength of the prior where hosts tell nothing about their spread
DEFAULT_STRENGTH = 20.0


def repeated(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: does its text hold it twice or more, and is this not the first time."""
    key = bw.mix(values + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[1:] = key[order][1:] == key[order][:-1]
    again, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order] = same
    twice[order] = same | np.append(same[1:], False)
    return twice, again


def measure_slice(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The measures of every text of a slice, in the order of MEASURES."""
    words = bw.runs(data, bounds)
    points = bw.code_points(data)
    word_chars = bw.per_text(points[words.end] - points[words.start], words.first)
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SYMBOLS[data], out=symbols[1:])
    n_symbols = symbols[bounds[1:]] - symbols[bounds[:-1]]

    lines = bw.runs(data, bounds, bw.LINE_BYTES)
    starts = np.zeros(len(data) + 1, np.int64)  # words that begin before a byte
    starts[words.start + 1] = 1
    np.cumsum(starts, out=starts)
    worded = starts[lines.end] > starts[lines.start]
    _, again = repeated(lines.hashes()[worded], lines.owner()[worded])
    n_dup = np.bincount(lines.owner()[worded][again], minlength=len(bounds) - 1)

    windows, at = shingle_hashes(words.hashes(), words.first, REPEAT_WINDOW)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
    twice, _ = repeated(windows, owner)
    begin = (np.arange(len(windows)) - at[owner] + words.first[owner])[twice]
    cover = np.zeros(len(words.start) + REPEAT_WINDOW + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + REPEAT_WINDOW, -1)
    n_repeat = bw.per_text(np.cumsum(cover)[:len(words.start)] > 0, words.first)
    return [words.counts, word_chars, n_symbols, n_dup, n_repeat]


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and the measures of ``text``; a null text measures as an empty one."""
    bounded_batches(docs.sparkSession)
    # own names, so that columns called like a measure do no harm
    plain = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text).alias("_text"))
    types = dict(plain.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in bw.slices(batch, "_text"):
                found = [pa.array(x.astype(np.int64)) for x in measure_slice(data, bounds)]
                yield pa.RecordBatch.from_arrays(part.columns[:-1] + found, names=part.schema.names[:-1] + MEASURES)

    schema = ", ".join([f"_k{i} {types[f'_k{i}']}" for i in range(len(keep))] + [f"{m} long" for m in MEASURES])
    out = plain.mapInArrow(run, schema)
    return out.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), *MEASURES)


def prior_strength(n: Column, hosts: Column, squares: Column, scatter: Column, rate: Column) -> Column:
    """a + b of the beta prior, by moments: the scatter of host rates beyond what counting explains.

    ``scatter`` is the sum of n_i (r_i - rate)^2 and ``squares`` that of n_i^2 over the hosts.
    """
    spread = rate * (1 - rate)
    inner = (scatter / spread - (hosts - 1)) / (n - squares / n - (hosts - 1))
    inner = F.least(F.greatest(inner, F.lit(1e-4)), F.lit(0.9))
    usable = (spread > 0) & (hosts > 1) & (n - squares / n - (hosts - 1) > 0)
    return F.when(usable, 1 / inner - 1).otherwise(F.lit(DEFAULT_STRENGTH))


def host_verdicts(measured: DataFrame, host: str, rules: dict[str, str], reject_rate: float = REJECT_RATE) -> DataFrame:
    """One row per host: documents, the shrunk failure rate of every rule, and ``rejected``."""
    names = list(rules)
    counted = measured.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), *(F.count_if(F.expr(rules[r])).alias(r) for r in names))
    totals = counted.agg(F.sum("n").alias("all_n"), F.count("*").alias("hosts"), F.sum(F.col("n") * F.col("n")).alias("squares"),
                         *(F.sum(r).alias(f"all_{r}") for r in names))
    both = counted.crossJoin(F.broadcast(totals))  # one row
    scatter = both.agg(*(F.sum(F.col("n") * F.pow(F.col(r) / F.col("n") - F.col(f"all_{r}") / F.col("all_n"), F.lit(2.0))).alias(f"scatter_{r}") for r in names))
    both = both.crossJoin(F.broadcast(scatter))  # one row
    for r in names:
        rate = F.col(f"all_{r}") / F.col("all_n")
        strength = prior_strength(F.col("all_n"), F.col("hosts"), F.col("squares"), F.col(f"scatter_{r}"), rate)
        both = both.withColumn(f"rate_{r}", (F.col(r) + strength * rate) / (F.col("n") + strength))
    worst = F.greatest(*(F.col(f"rate_{r}") for r in names)) if len(names) > 1 else F.col(f"rate_{names[0]}")
    return both.select("host", "n", *(f"rate_{r}" for r in names), (worst >= reject_rate).alias("rejected"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                  base: dict[str, str] = BASE_RULES, more: dict[str, str] = HOST_RULES,
                  reject_rate: float = REJECT_RATE) -> DataFrame:
    """(doc_id, the measures, base_failed, host_rejected, kept) for every row of ``docs``.

    Null and empty texts have no words and fail ``few_words``. Documents without a host form a host of
    their own (null equals null). Repeated rows count as often as they stand and are all returned.
    Columns beside the three named ones are ignored. An empty table gives no rows.
    """
    measured = measure(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("host")), ["doc_id", "host"])
    measured = materialise(measured, "measured")  # both the verdicts and the result read it
    verdicts = host_verdicts(measured, "host", base | more, reject_rate)
    rejected = verdicts.where("rejected").select(F.col("host").alias("bad"), F.lit(True).alias("host_rejected"))
    failed = F.expr(" or ".join(f"({rule})" for rule in base.values()))
    out = measured.join(rejected, F.col("host").eqNullSafe(F.col("bad")), "left")
    out = out.select("doc_id", *MEASURES, failed.alias("base_failed"), F.coalesce("host_rejected", F.lit(False)).alias("host_rejected"))
    return out.withColumn("kept", ~(F.col("base_failed") | F.col("host_rejected")))

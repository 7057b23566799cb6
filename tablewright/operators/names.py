"""Which of many names stand anywhere in texts: an automaton over all names at once, in shards of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablewright.operators.context import stem

#: bytes of names in one automaton
SHARD_BYTES = 4 << 20


def _finder(forms):
    """Distinct names that a text holds, by the automaton of the broadcast names; built once in a Python worker."""
    held: dict = {}

    def found(text: str) -> list[str]:
        if "automaton" not in held:
            import ahocorasick

            held["automaton"] = automaton = ahocorasick.Automaton()
            for form in forms.value:
                automaton.add_word(form, form)
            automaton.make_automaton()
        return list({form for _, form in held["automaton"].iter(text)})

    return found


def mentions_anywhere(texts: DataFrame, names: DataFrame, text_key: str = "request_id", text_col: str = "text", name_col: str = "name",
                      shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(text key, name): the names that a text holds, with or without their extension, blanks and all, also inside words.

    Every text is read once for ``shard_bytes`` of names: one pass finds all names of a shard. Texts are never
    multiplied by names; a form that several names share is found once and joined to them. Empty names are not looked for.
    """
    spark = texts.sparkSession
    given = names.select(F.col(name_col).alias("name")).where("name <> ''").distinct()
    forms = given.select("name", F.explode(F.array_distinct(F.array("name", stem(F.col("name"))))).alias("form")).where("form <> ''")
    single = forms.select("form").distinct()
    size = single.agg(F.sum(F.octet_length("form"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    key_type = texts.schema[text_key].dataType.simpleString()
    asked = texts.where(F.col(text_col).isNotNull()).select(F.col(text_key).alias("key"), F.col(text_col).alias("text"))
    parts = []
    for s in range(shards):
        # about ``shard_bytes``, as names are dealt by hash
        mine = [r.form for r in single.where(F.pmod(F.xxhash64("form"), F.lit(shards)) == s).collect()]
        if not mine:
            continue
        find = _finder(spark.sparkContext.broadcast(mine))

        def search(batches: Iterator[pd.DataFrame], find=find) -> Iterator[pd.DataFrame]:
            for batch in batches:
                hits = [find(t) for t in batch["text"]]
                out = pd.DataFrame({"key": batch["key"], "form": hits}).explode("form").dropna(subset=["form"])
                yield out

        parts.append(asked.mapInPandas(search, f"key {key_type}, form string"))
    if not parts:
        return spark.createDataFrame([], f"{text_key} {key_type}, name string")
    return reduce(DataFrame.unionByName, parts).join(forms, "form").select(F.col("key").alias(text_key), "name").distinct()

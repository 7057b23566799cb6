"""A user's fix as a table function that SQL calls on a table, with a contract for what goes in and what comes out.

The columns that a fix takes are checked when a statement is analysed; so a table that lacks one is refused before
anything runs. Rows that come out are checked one by one, and a row that breaks the contract, or on which the fix fails,
is kept with the reason in ``contract_error``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tablewright.plans.harmonise import FixResult, apply_fix

ERROR = "contract_error"


@dataclass(frozen=True)
class Contract:
    """``takes`` and ``gives`` are schemas as text; rules hold for columns of the result. ``keep`` are columns passed on unchanged."""

    takes: str
    gives: str
    keep: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    patterns: dict[str, str] = field(default_factory=dict)

    def broken_by(self, row: dict) -> str | None:
        """The first rule that a result breaks."""
        for c in self.required:
            if row.get(c) is None:
                return f"{c} is missing"
        for c, (low, high) in self.ranges.items():
            v = row.get(c)
            if v is not None and not ((low is None or v >= low) and (high is None or v <= high)):
                return f"{c} is out of range"
        for c, pattern in self.patterns.items():
            v = row.get(c)
            if v is not None and not re.fullmatch(pattern, v):
                return f"{c} does not match"
        return None


def register_fix(spark: SparkSession, name: str, fix: Callable[[dict], dict | Iterable[dict] | None], contract: Contract) -> None:
    """Make ``SELECT * FROM name(TABLE(...))`` apply ``fix`` to every row, given as a dictionary.

    A fix gives one row, several, or none for a row. Its result has the columns kept, those of ``gives``, and ``contract_error``.
    """
    takes, gives = T.StructType.fromDDL(contract.takes), T.StructType.fromDDL(contract.gives)
    made = [f.name for f in gives]

    class Fix:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError("the argument is no table")
            given = {f.name: f.dataType for f in table.dataType}
            for f in takes:
                if f.name not in given:
                    raise ValueError(f"column {f.name} is missing")
                if given[f.name] != f.dataType:
                    raise ValueError(f"column {f.name} is {given[f.name].simpleString()}, not {f.dataType.simpleString()}")
            for c in contract.keep:
                if c not in given:
                    raise ValueError(f"column {c} is missing")
            kept = [T.StructField(c, given[c]) for c in contract.keep]
            return AnalyzeResult(schema=T.StructType([*kept, *gives, T.StructField(ERROR, T.StringType())]))

        def eval(self, row) -> Iterator[tuple]:
            given = row.asDict()
            kept = [given[c] for c in contract.keep]
            try:
                out = fix(given)
                out = [] if out is None else [out] if isinstance(out, dict) else list(out)
            except Exception as exc:  # the row tells what the user's function said
                yield (*kept, *[None] * len(made), f"{type(exc).__name__}: {exc}")
                return
            for r in out:
                yield (*kept, *[r.get(c) for c in made], contract.broken_by(r))

    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(Fix, useArrow=True))


def call_fix(df: DataFrame, name: str) -> FixResult:
    """The registered fix over a table, by its whole contract: a result without rows that keep to it is no success."""
    spark = df.sparkSession

    def called(given: DataFrame) -> DataFrame:
        return spark.sql(f"SELECT * FROM {name}(TABLE({{given}}))", given=given)

    result = apply_fix(df, called)
    if result.success and result.df.where(F.col(ERROR).isNull()).isEmpty():
        first = result.df.select(ERROR).first()[0]
        return FixResult(False, result.df, result.seconds, f"No row keeps to the contract: {first}", "logical")
    return result

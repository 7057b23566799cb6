"""Column repairs: transforms, types, patterns, ranges, nulls. Each is a Column; counters share one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions import lenient, numbers, text
from tablewright.operators.dates import column_formats
from tablewright.operators.clean import quoted
from tablewright.plans.schema import TargetColumn, TargetSchema


def transform_value(c: Column, dtype: T.DataType, name: str) -> Column:
    """One of the value transforms; numeric ones convert leniently first."""
    if name == "uppercase":
        return F.upper(c.cast("string"))
    if name == "lowercase":
        return F.lower(c.cast("string"))
    if name == "trim":
        return text.strip(c.cast("string"))
    if name == "none":
        return c
    x = lenient.to_number(c, dtype)
    return {
        "log2": numbers.log2, "log10": numbers.log10, "abs": F.abs,
        "round": numbers.round_half_even, "negate": F.negative,
    }[name](x)


def transformed_type(dtype: T.DataType, name: str) -> T.DataType:
    if name in ("uppercase", "lowercase", "trim"):
        return T.StringType()
    return dtype if name == "none" else T.DoubleType()


def repair_pattern(c: Column, col: TargetColumn) -> Column:
    """Values that break the pattern are stripped, symbols also of stray characters at the ends."""
    fixed = text.repair_symbol(c) if col.holds_symbols else text.strip(c)
    return F.when(text.matches_from_start(c, col.validation_regex), c).otherwise(fixed)


def clamp_range(c: Column, col: TargetColumn) -> Column:
    return numbers.clamp(c, col.min_value, col.max_value)


def fill_null(c: Column, col: TargetColumn) -> Column:
    if col.default_value is None:
        return c
    return F.coalesce(c, F.lit(col.default_value).try_cast(col.spark_type))


@dataclass(frozen=True)
class RepairPlan:
    """The stages of one source column. Each stage is a column of the staged table, so that a stage
    refers to the one before by name and never repeats its expression."""

    index: int
    col: TargetColumn
    source: str
    start: str  # column the plan starts from: the source, or the end of an earlier plan on it
    start_type: T.DataType
    round: int  # 0 for the first plan on a source, 1 for the second, ...
    transforms: bool
    formats: tuple[str, ...] | None = None  # of dates; None tries all formats on every value

    def at(self, stage: str) -> str:
        return f"__{self.index}_{stage}"

    @property
    def transform(self) -> str:
        return self.col.transform if self.transforms and not self.col.is_adjustment else "none"

    @property
    def checks_pattern(self) -> bool:
        return bool(self.col.validation_regex) and self.col.type == "string"

    @property
    def checks_range(self) -> bool:
        return self.col.is_numeric and (
            self.col.min_value is not None or self.col.max_value is not None)

    def stages(self) -> list[tuple[str, Column]]:
        """(stage, expression over the stage before), in order."""
        moved_type = transformed_type(self.start_type, self.transform)
        typed = F.col(self.at("typed"))
        if self.checks_pattern:
            ranged = repair_pattern(typed, self.col)
        elif self.checks_range:
            ranged = clamp_range(typed, self.col)
            ranged = ranged.try_cast("bigint") if self.col.type == "int" else ranged
        else:
            ranged = typed
        return [
            ("moved", transform_value(quoted(self.start), self.start_type, self.transform)),
            ("typed", lenient.convert(F.col(self.at("moved")), moved_type, self.col.type, None if self.formats is None else list(self.formats))),
            ("ranged", ranged),
            ("filled", fill_null(F.col(self.at("ranged")), self.col)),
        ]

    def checks(self) -> dict[str, Column]:
        """Named conditions over a row of the staged table."""
        moved, typed, ranged = (F.col(self.at(x)) for x in ("moved", "typed", "ranged"))
        out = {"coerced": moved.isNotNull() & typed.isNull(), "nulls": ranged.isNull()}
        if self.transform != "none":
            out["transformed"] = ~moved.cast("string").eqNullSafe(quoted(self.start).cast("string"))
        if self.col.type == "int":
            x = moved.try_cast("double")
            out["fractional"] = x != F.rint(x)
        if self.checks_pattern:
            rule = self.col.validation_regex
            out["pattern_before"] = ~text.matches_from_start(typed, rule)
            out["pattern_after"] = ~text.matches_from_start(ranged, rule)
        if self.checks_range:
            out["clamped"] = _outside(typed, self.col.min_value, self.col.max_value)
        return out

    def counters(self) -> dict[str, Column]:
        """Named aggregates over the staged table; all of them fit in one ``agg``."""
        return {name: F.count_if(condition) for name, condition in self.checks().items()}


def _outside(c: Column, low: float | None, high: float | None) -> Column:
    tests = []
    if low is not None:
        tests.append(c < F.lit(float(low)))
    if high is not None:
        tests.append(c > F.lit(float(high)))
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def plan_repairs(df: DataFrame, schema: TargetSchema, mapping: dict[str, str],
                 transforms: bool, by_column: bool = True) -> list[RepairPlan]:
    """Plans in schema order. A source bound twice continues from its earlier plan.

    ``by_column``: dates of a text column all have the format that fits most of its values, found in a pass over
    such columns; else each value takes the first format that fits it, as it must where a column is never seen whole.
    """
    types = {f.name: f.dataType for f in df.schema}
    dated = [mapping[c.name] for c in schema.columns if c.type in ("date", "datetime") and isinstance(types.get(mapping.get(c.name)), T.StringType)]
    formats = column_formats(df, dated) if by_column and dated else {}
    last: dict[str, RepairPlan] = {}
    plans = []
    for col in schema.columns:
        source = mapping.get(col.name)
        if source is None or source not in types:
            continue
        earlier = last.get(source)
        if earlier is None:
            start, dtype, turn = source, types[source], 0
        else:
            start, dtype, turn = earlier.at("filled"), earlier.col.spark_type, earlier.round + 1
        known = (formats[source],) if formats.get(source) else () if source in formats else None
        plan = RepairPlan(len(plans), col, source, start, dtype, turn, transforms, known if earlier is None else None)
        plans.append(plan)
        last[source] = plan
    return plans


def staged(df: DataFrame, plans: list[RepairPlan]) -> DataFrame:
    """``df`` with a column per plan and stage, one projection per stage for all plans together."""
    for turn in range(max((p.round for p in plans), default=-1) + 1):
        layers = [p.stages() for p in plans if p.round == turn]
        current = [p for p in plans if p.round == turn]
        for layer in zip(*layers):
            df = df.withColumns({p.at(stage): value for p, (stage, value) in zip(current, layer)})
    return df


def apply_repairs(df: DataFrame, plans: list[RepairPlan]) -> DataFrame:
    """Every bound source column replaced by its last repaired form."""
    final = {p.source: p.at("filled") for p in plans}
    return staged(df, plans).select(*[
        F.col(final[c]).alias(c) if c in final else quoted(c) for c in df.columns])


def repair_counters(df: DataFrame, plans: list[RepairPlan]) -> DataFrame:
    """One pass over ``df``: a row per target column with all its counters (NULL where not checked)."""
    names = ["transformed", "coerced", "fractional", "pattern_before", "pattern_after", "clamped", "nulls"]
    rows = []
    for p in plans:
        counts = p.counters()
        rows.append(F.struct(
            F.lit(p.index).alias("position"), F.lit(p.col.name).alias("target"), F.lit(p.source).alias("column"),
            *[counts.get(n, F.lit(None).cast("bigint")).alias(n) for n in names],
            F.count(F.lit(1)).alias("rows")))
    return staged(df, plans).agg(F.array(*rows).alias("all")).select(F.inline("all"))


# the single-step operators, each usable on its own

def apply_transforms(df: DataFrame, schema: TargetSchema, mapping: dict[str, str]) -> DataFrame:
    """Value transforms in place."""
    types = {f.name: f.dataType for f in df.schema}
    for col in schema.columns:
        source = mapping.get(col.name)
        if source in types and col.transform != "none" and not col.is_adjustment:
            df = df.withColumn(source, transform_value(quoted(source), types[source], col.transform))
            types[source] = transformed_type(types[source], col.transform)
    return df


def convert_types(df: DataFrame, schema: TargetSchema, mapping: dict[str, str]) -> DataFrame:
    """Lenient type conversion in place."""
    types = {f.name: f.dataType for f in df.schema}
    changed = {}
    for col in schema.columns:
        source = mapping.get(col.name)
        if source in types:
            base, dtype = changed.get(source, (quoted(source), types[source]))
            changed[source] = (lenient.convert(base, dtype, col.type), col.spark_type)
    return df.select(*[changed[c][0].alias(c) if c in changed else quoted(c) for c in df.columns])


def auto_fix(df: DataFrame, schema: TargetSchema, mapping: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Type, pattern, range and null repairs without transforms; returns (fixed, counters)."""
    plans = plan_repairs(df, schema, mapping, transforms=False)
    return apply_repairs(df, plans), repair_counters(df, plans)

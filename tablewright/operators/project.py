"""Projection of a table onto a target schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.functions import lenient
from tablewright.operators import padjust
from tablewright.operators.clean import quoted
from tablewright.operators.repair import transform_value, transformed_type
from tablewright.plans.resolve import p_value_source
from tablewright.plans.schema import ADJUSTMENTS, ROW_ID, TargetSchema


def project(df: DataFrame, schema: TargetSchema, mapping: dict[str, str],
            keep_row_id: bool = True) -> DataFrame:
    """Output columns in schema order: mapped, transformed once, converted.

    Unmapped columns take their default or NULL. Adjusted p-values are computed from their source
    column whether or not the target's own name resolves; all methods on one source share a scan.
    """
    types = {f.name: f.dataType for f in df.schema}
    data_names = [c for c in df.columns if c != ROW_ID]
    by_source: dict[str, dict[str, str]] = {}
    for i, col in enumerate(schema.columns):
        if col.is_adjustment:
            source = p_value_source(data_names, col) or mapping.get(col.name)
            if source is not None:
                by_source.setdefault(source, {})[f"__adjusted_{i}"] = ADJUSTMENTS[col.transform]
    for source, outputs in by_source.items():
        df = padjust.adjust(df, source, outputs)

    out = [quoted(ROW_ID)] if keep_row_id and ROW_ID in types else []
    ready = set(df.columns)
    for i, col in enumerate(schema.columns):
        if col.is_adjustment:
            made = f"__adjusted_{i}"
            value = quoted(made) if made in ready else F.lit(None)
            value = value.try_cast(col.spark_type)
        elif col.name in mapping:
            source = mapping[col.name]
            moved = transform_value(quoted(source), types[source], col.transform)
            value = lenient.convert(moved, transformed_type(types[source], col.transform), col.type)
        else:
            value = F.lit(col.default_value).try_cast(col.spark_type)
        out.append(value.alias(col.name))
    return df.select(*out)


def restructure(df: DataFrame, schema: TargetSchema, mapping: dict[str, str]) -> DataFrame:
    """Rename and reorder only: mapped columns first under their target names, the rest after.

    A source bound to several targets is copied for each. No value and no row changes.
    """
    bound = set(mapping.values())
    picked = [quoted(mapping[c.name]).alias(c.name) for c in schema.columns if c.name in mapping]
    taken = {c.name for c in schema.columns if c.name in mapping}
    rest = [quoted(c) for c in df.columns if c not in bound and c not in taken]
    return df.select(*picked, *rest)

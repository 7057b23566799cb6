"""Noise sweep: many noisy variants of a table, fingerprinted and vectorised together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.operators import fingerprint as fp
from tablewright.operators import library as lib
from tablewright.operators import noise, tfidf
from tablewright.operators.clean import data_columns
from tablewright.plans.schema import ROW_ID
from tablewright.session import materialise


def noisy_variants(df: DataFrame, grid: list[tuple[int, float, int]], settings: noise.NoiseSettings,
                   key: str = ROW_ID) -> DataFrame:
    """All variants of the grid in one table with a ``variant`` column."""
    variants = df.sparkSession.createDataFrame([(v, r) for v, r, _ in grid], "variant int, ratio double")
    return noise.inject(noise.with_variants(df, variants), settings, key, "variant", "ratio")


def variant_changes(df: DataFrame, grid: list[tuple[int, float, int]], settings: noise.NoiseSettings,
                    key: str = ROW_ID) -> DataFrame:
    """(variant, cells_modified)."""
    variants = df.sparkSession.createDataFrame([(v, r) for v, r, _ in grid], "variant int, ratio double")
    return noise.hit_counts(noise.with_variants(df, variants), settings, key, "variant", "ratio")


def variant_fingerprints(df: DataFrame, grid: list[tuple[int, float, int]], settings: noise.NoiseSettings,
                         key: str = ROW_ID) -> DataFrame:
    """(variant, tokens, token_string)."""
    # written once: the facts look at the variants more than once
    return fp.fingerprint(materialise(noisy_variants(df, grid, settings, key), "variants"), by=["variant"], key=key)


def noise_sweep(df: DataFrame, grid: list[tuple[int, float, int]], settings: noise.NoiseSettings,
                library: lib.FixLibrary | None = None, key: str = ROW_ID) -> tuple[DataFrame, tfidf.TfidfModel]:
    """Fingerprint every variant, fit one vocabulary over all of them, and store the entries as pending.

    Variants share all jobs: rows are multiplied by the grid, then reduced to one row per variant.
    """
    prints = variant_fingerprints(df, grid, settings, key)
    model, vectors = tfidf.fit_transform(prints, "token_string")
    first_kind = settings.kinds[0] if settings.kinds else "mixed"
    labels = df.sparkSession.createDataFrame(
        [(v, r, f"noise_{first_kind}_{p}%") for v, r, p in grid], "variant int, ratio double, error_type string")
    changed = variant_changes(df, grid, settings, key)
    shape = f"{len(data_columns(df))} columns"
    script = F.format_string(
        f"# Synthetic variant. Table: {shape}; noise ratio %.4f; kinds {', '.join(settings.kinds)}; cells modified %d",
        F.col("ratio"), F.coalesce("cells_modified", F.lit(0)))
    attempts = (vectors.join(F.broadcast(labels), "variant").join(changed, "variant", "left")
                .select("variant", "tokens", "vector", "error_type", script.alias("script_content"),
                        F.lit("PENDING").alias("status"), F.lit("noise_sweep").alias("source_file")))
    if library is not None:
        library.add(attempts)
    return attempts, model

"""Synthetic noise: repeatable corruption of cells, with a log of every touched cell.

Each cell is decided on its own from a digest of (seed, variant, row key, column): whether it is
touched, which kind of noise it gets, and every choice inside that kind. So the job is one
projection, and a rerun or another partitioning gives the same result.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.draws import SPAN, pick, unit
from tablewright.functions.lenient import NUMBER_PATTERN
from tablewright.functions.text import swap_case
from tablewright.operators.clean import quoted
from tablewright.plans.schema import ROW_ID

# Neighbours of each key on a QWERTY keyboard.
NEIGHBOUR_KEYS = {
    "a": "sqwz", "b": "vghn", "c": "xdfv", "d": "serfcx", "e": "wsdr", "f": "drtgvc", "g": "ftyhbv",
    "h": "gyujnb", "i": "ujko", "j": "huikmn", "k": "jiolm", "l": "kop", "m": "njk", "n": "bhjm",
    "o": "iklp", "p": "ol", "q": "wa", "r": "edft", "s": "awedxz", "t": "rfgy", "u": "yhji",
    "v": "cfgb", "w": "qase", "x": "zsdc", "y": "tghu", "z": "asx",
}
# Gene symbols and what they are mistaken for.
SYMBOL_CONFUSIONS = {
    "BRCA1": ["BRCA2", "BRAC1", "BRCA"],
    "BRCA2": ["BRCA1", "BRAC2", "BRCA"],
    "TP53": ["TP52", "TP54", "P53", "TRP53"],
    "EGFR": ["EFGR", "EGF", "EGRF"],
    "KRAS": ["KARS", "HRAS", "NRAS"],
    "MYC": ["MYCC", "C-MYC", "MIC"],
    "AKT1": ["AKT2", "AKT3", "ATK1"],
}
# Placeholders for missing data, prefixes, and integer drifts.
PLACEHOLDERS = ["N/A", "NULL", "-", "#N/A", "???", "MISSING", "NA"]
PREFIXES = ["_", "-", " ", "X"]
DRIFTS = [-2, -1, 1, 2]
FORCED_NUMBER = "99999"

KINDS = ["typo", "semantic", "structural"]
MODES = ["uniform", "weighted", "targeted"]
HITS = ("array<struct<position int, column string, original string, "
        "change struct<noise_type string, modified string, modification string>>>")


@dataclass
class NoiseSettings:
    ratio: float = 0.1
    mode: str = "uniform"
    weights: dict[str, float] = field(default_factory=dict)
    targets: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=lambda: list(KINDS))
    seed: int = 0

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        unknown = set(self.kinds) - set(KINDS)
        if unknown or not self.kinds:
            raise ValueError(f"kinds must be some of {KINDS}")

    def chances(self, columns: list[str]) -> dict[str, float]:
        """Chance per cell of each column; the expected number of touched cells is ratio x cells."""
        if self.mode == "targeted":
            hit = [c for c in columns if c in self.targets]
            if not hit:
                return {}
            return {c: min(1.0, self.ratio * len(columns) / len(hit)) for c in hit}
        if self.mode == "weighted":
            weights = {c: self.weights.get(c, 1.0) for c in columns}
            total = sum(weights.values())
            if not total:
                return {}
            return {c: min(1.0, self.ratio * len(columns) * w / total) for c, w in weights.items()}
        return {c: self.ratio for c in columns}


def _choice(options: list[str], hexed: Column, i: int) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), pick(len(options), hexed, i) + 1)


def _splice(s: Column, at: Column, new: Column, dropped: int) -> Column:
    """Put ``new`` at 0-based position ``at``, replacing ``dropped`` characters."""
    return F.concat(F.substr(s, F.lit(1), at), new, F.substr(s, at + 1 + dropped))


# Fixed values, here and below: the notes that a modification log holds for each kind of change.
def _change(kind: str, modified: Column, note: Column) -> Column:
    return F.struct(F.lit(kind).alias("noise_type"), modified.cast("string").alias("modified"),
                    note.alias("modification"))


def typo(s: Column, h1: Column, h2: Column) -> Column:
    """Swap two neighbours, drop, insert or mistype one character. Lanes: h1[2] which, h1[3] where."""
    length = F.length(s)
    at = pick(length, h1, 3)
    swap_at = pick(F.greatest(length - 1, F.lit(1)), h1, 3)
    insert_at = pick(length + 1, h1, 3)
    letter = _choice(list(string.ascii_letters), h2, 0)
    here = F.substr(s, at + 1, F.lit(1))
    near = F.element_at(F.create_map(*[F.lit(x) for kv in NEIGHBOUR_KEYS.items() for x in kv]), F.lower(here))
    mistyped = F.substr(near, pick(F.length(near), h2, 0) + 1, F.lit(1))
    mistyped = F.when(here != F.lower(here), F.upper(mistyped)).otherwise(mistyped)
    swapped = F.concat(F.substr(s, swap_at + 2, F.lit(1)), F.substr(s, swap_at + 1, F.lit(1)))
    which = pick(4, h1, 2)

    def made(modified: Column, note: Column) -> Column:
        return _change("typo", modified, note)

    return (
        F.when(s.isNull(), made(s, F.lit("skipped_nan")))
        .when(length < 2, made(s, F.lit("too_short")))
        .when(which == 0, made(_splice(s, swap_at, swapped, 2), F.format_string("swapped chars at %d", swap_at)))
        .when(which == 1, made(_splice(s, at, F.lit(""), 1), F.format_string("deleted char at %d", at)))
        .when(which == 2, made(_splice(s, insert_at, letter, 0),
                               F.format_string("inserted '%s' at %d", letter, insert_at)))
        .when(near.isNull(), made(s, F.lit("no_adjacent_found")))
        .otherwise(made(_splice(s, at, mistyped, 1),
                        F.format_string("adjacent key '%s' -> '%s'", F.lower(here), mistyped))))


def semantic(s: Column, x: Column, numeric: Column, whole: Column, h1: Column) -> Column:
    """A similar but wrong value. ``x`` is the number behind ``s`` for numeric columns."""
    confusions = F.element_at(F.create_map(*[
        v for k, options in SYMBOL_CONFUSIONS.items()
        for v in (F.lit(k), F.array(*[F.lit(o) for o in options]))]), F.upper(s))
    confused = F.element_at(confusions, pick(F.size(confusions), h1, 3) + 1)
    # from the text, as a double would lose the last digits of large whole numbers
    stepped = F.try_add(s.try_cast("bigint"), F.element_at(
        F.array(*[F.lit(d).cast("bigint") for d in DRIFTS]), pick(len(DRIFTS), h1, 3) + 1))
    drifted = x + (unit(h1, 3) * 0.2 - 0.1) * F.when(x != 0, F.abs(x)).otherwise(F.lit(1.0))
    which = pick(3, h1, 2)
    cut = F.substr(s, F.lit(1), F.length(s) - 1 - pick(2, h1, 3))
    prefix = _choice(PREFIXES, h1, 3)

    def made(modified: Column, note: Column) -> Column:
        return _change("semantic", modified, note)

    return (
        F.when(s.isNull(), made(s, F.lit("skipped_nan")))
        .when(confusions.isNotNull(), made(
            confused, F.format_string("gene_confusion: %s -> %s", F.upper(s), confused)))
        .when(whole, made(stepped, F.format_string("int_drift: %s -> %s", s, stepped.cast("string"))))
        .when(numeric, made(drifted, F.format_string("float_drift: %s -> %.4f", s, drifted)))
        .when(which == 0, made(swap_case(s), F.lit("case_swap")))
        .when((which == 1) & (F.length(s) > 3), made(cut, F.lit("truncated")))
        .otherwise(made(F.concat(prefix, s), F.format_string("added_prefix: '%s'", prefix))))


def structural(s: Column, numeric: Column, h1: Column) -> Column:
    """A missing value, a change of type, an empty string or a placeholder."""
    which = pick(4, h1, 2)
    placeholder = _choice(PLACEHOLDERS, h1, 3)
    head = F.replace(F.substr(s, F.lit(1), F.lit(5)), F.lit(","), F.lit("."))
    number = F.when(head.rlike(NUMBER_PATTERN), F.trim(head).try_cast("double"))

    def made(modified: Column, note: Column) -> Column:
        return _change("structural", modified, note)

    return (
        F.when(which == 0, made(F.lit(None), F.lit("injected_nan")))
        .when((which == 1) & numeric, made(
            F.concat(F.lit("VALUE_"), F.coalesce(s, F.lit("nan"))), F.lit("num_to_str")))
        .when((which == 1) & number.isNotNull(), made(number, F.lit("str_to_num")))
        .when(which == 1, made(F.lit(FORCED_NUMBER), F.lit("forced_num")))
        .when(which == 2, made(F.lit(""), F.lit("empty_string")))
        .otherwise(made(placeholder, F.format_string("placeholder: %s", placeholder))))


def _corrupt(cell: Column, prefix: Column, kinds: list[str]) -> Column:
    """The change of one touched cell."""
    s, h1, numeric = cell["s"], cell["h"], cell["numeric"]
    h2 = F.md5(F.concat_ws("|", prefix, cell["column"], F.lit("more")))
    changes = {
        "typo": lambda: typo(s, h1, h2),
        "semantic": lambda: semantic(s, cell["x"], numeric, cell["whole"], h1),
        "structural": lambda: structural(s, numeric, h1),
    }
    which = pick(len(kinds), h1, 1)
    out = changes[kinds[-1]]()
    for i, kind in reversed(list(enumerate(kinds[:-1]))):
        out = F.when(which == i, changes[kind]()).otherwise(out)
    return out


def _limit(chance: Column) -> Column:
    """A chance as the first digest lane has to stay below it, in the digest's own spelling."""
    scaled = F.ceil(chance * float(SPAN)).cast("bigint")
    return F.when(scaled >= SPAN, F.lit("g")).otherwise(F.lower(F.lpad(F.hex(scaled), 8, "0")))


def touched_cells(df: DataFrame, settings: NoiseSettings, key: str = ROW_ID, variant: str | None = None,
                  ratio_col: str | None = None, chosen: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """``df`` with ``__hits``, an array of the touched cells of each row with their changes.

    ``variant`` names a column that gives each variant of the table its own draws; ``ratio_col``
    takes the ratio from a column instead of the settings (uniform mode). The corruption is written
    once, over the cells of a row, so the plan does not grow with the number of columns. ``chosen`` tells, from
    the key's text, the column and its position, which cells are touched; without it each cell draws.
    """
    columns = noisy_columns(df, key, variant, ratio_col)
    chances = settings.chances(columns)
    cells = []
    for i, name in enumerate(columns):
        if name not in chances:
            continue
        dtype = df.schema[name].dataType
        numeric = isinstance(dtype, T.NumericType)
        number = quoted(name).cast("double") if numeric else F.lit(None).cast("double")
        cells.append(F.struct(
            F.lit(i).alias("position"), F.lit(name).alias("column"), quoted(name).cast("string").alias("s"),
            number.alias("x"), F.lit(numeric).alias("numeric"),
            F.lit(isinstance(dtype, T.IntegralType)).alias("whole"),
            _limit(F.col(ratio_col) if ratio_col else F.lit(float(chances[name]))).alias("limit")))
    base = [quoted(c) for c in df.columns]
    if not cells:
        return df.select(*base, F.array().cast(HITS).alias("__hits"))
    parts = [F.lit(str(settings.seed)), *([F.col(variant).cast("string")] if variant else []), F.col(key).cast("string")]
    work = df.select(*base, F.concat_ws("|", *parts).alias("__prefix"), F.array(*cells).alias("__cells"))
    prefix = F.col("__prefix")
    fields = ("position", "column", "s", "x", "numeric", "whole", "limit")
    drawn = F.transform("__cells", lambda c: F.struct(
        *[c[f].alias(f) for f in fields], F.md5(F.concat_ws("|", prefix, c["column"])).alias("h")))
    def taken(c: Column) -> Column:
        return chosen(prefix, c["column"], c["position"]) if chosen else F.substring(c["h"], 1, 8) < c["limit"]

    work = work.select(*base, prefix, F.filter(drawn, taken).alias("__drawn"))
    hits = F.transform("__drawn", lambda c: F.struct(
        c["position"].alias("position"), c["column"].alias("column"), c["s"].alias("original"),
        _corrupt(c, prefix, settings.kinds).alias("change")))
    return work.select(*base, hits.alias("__hits"))


def noisy_columns(df: DataFrame, key: str, variant: str | None, ratio_col: str | None) -> list[str]:
    return [c for c in df.columns if c not in (key, variant, ratio_col)]


def inject(df: DataFrame, settings: NoiseSettings, key: str = ROW_ID, variant: str | None = None,
           ratio_col: str | None = None, chosen: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """The corrupted table. Columns that may be touched become STRING."""
    columns = noisy_columns(df, key, variant, ratio_col)
    eligible = settings.chances(columns)
    base = [quoted(c) for c in df.columns]
    changed = F.map_from_entries(F.transform(
        "__hits", lambda h: F.struct(h["position"].alias("key"), h["change"]["modified"].alias("value"))))
    touched = touched_cells(df, settings, key, variant, ratio_col, chosen).select(*base, changed.alias("__new"))
    out = [F.col(c) for c in (variant, key) if c]
    for i, name in enumerate(columns):
        if name in eligible:
            c = F.when(F.map_contains_key("__new", i), F.element_at("__new", F.lit(i))).otherwise(
                quoted(name).cast("string"))
            out.append(c.alias(name))
        else:
            out.append(quoted(name))
    return touched.select(*out)


def noise_log(df: DataFrame, settings: NoiseSettings, key: str = ROW_ID, variant: str | None = None,
              ratio_col: str | None = None, chosen: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """([variant,] row_id, column, original, modified, noise_type, modification) of every touched cell,
    cells the noise left as they were included."""
    touched = touched_cells(df, settings, key, variant, ratio_col, chosen)
    keys = [F.col(c) for c in (variant,) if c] + [F.col(key).alias("row_id")]
    return touched.select(*keys, F.explode("__hits").alias("h")).select(
        *[c for c in (variant,) if c], "row_id", "h.column", "h.original", "h.change.modified",
        "h.change.noise_type", "h.change.modification")


def hit_counts(df: DataFrame, settings: NoiseSettings, key: str = ROW_ID, variant: str | None = None,
               ratio_col: str | None = None) -> DataFrame:
    """([variant,] cells_modified): touched cells, without making their changes."""
    touched = touched_cells(df, settings, key, variant, ratio_col)
    return touched.groupBy(*[c for c in (variant,) if c]).agg(F.sum(F.size("__hits")).alias("cells_modified"))


def noise_summary(log: DataFrame, rows: int, columns: int) -> DataFrame:
    """One row: cells_modified, ratio_actual, columns_affected."""
    cells = float(max(rows * columns, 1))
    return log.agg(F.count(F.lit(1)).alias("cells_modified"),
                   (F.count(F.lit(1)) / F.lit(cells)).alias("ratio_actual"),
                   F.sort_array(F.collect_set("column")).alias("columns_affected"))


def with_variants(df: DataFrame, variants: DataFrame) -> DataFrame:
    """Every row once per variant: the small variant list is carried in the plan and exploded."""
    rows = [r.asDict() for r in variants.collect()]
    if not rows:
        raise ValueError("no variants given")
    names = variants.columns
    listed = F.array(*[F.struct(*[F.lit(r[n]).cast(variants.schema[n].dataType).alias(n) for n in names])
                       for r in rows])
    return df.select(*[quoted(c) for c in df.columns], F.inline(listed))


def variation_ratios(settings: NoiseSettings, k: int = 5) -> list[tuple[int, float]]:
    """(variant, ratio): the ratio times a draw from [0.5, 1.5), limited to [0.01, 1]."""
    import hashlib

    out = []
    for v in range(k):
        hexed = hashlib.md5(f"{settings.seed}|variation|{v}".encode()).hexdigest()
        factor = 0.5 + int(hexed[:8], 16) / float(1 << 32)
        out.append((v, min(1.0, max(0.01, settings.ratio * factor))))
    return out


def noisy_variations(df: DataFrame, settings: NoiseSettings, k: int = 5, key: str = ROW_ID) -> DataFrame:
    """k corrupted variants in one table with a ``variant`` column."""
    variants = df.sparkSession.createDataFrame(variation_ratios(settings, k), "variant int, ratio double")
    return inject(with_variants(df, variants), settings, key, "variant", "ratio")


def test_noise(df: DataFrame, ratio: float = 0.1, kinds: list[str] | None = None,
               targets: list[str] | None = None, seed: int = 0, key: str = ROW_ID) -> tuple[DataFrame, DataFrame]:
    """(noisy table, log) by plain arguments."""
    settings = NoiseSettings(ratio=ratio, mode="targeted" if targets else "uniform", targets=list(targets or []),
                             kinds=list(kinds or KINDS), seed=seed)
    return inject(df, settings, key), noise_log(df, settings, key)


def sweep_grid(low_percent: int = 1, high_percent: int = 10, step_percent: int = 1,
               per_step: int = 10) -> list[tuple[int, float, int]]:
    """(variant, ratio, percent): ratios in whole percent steps, ``per_step`` variants of each."""
    grid = [p for p in range(low_percent, high_percent + 1, step_percent) for _ in range(per_step)]
    return [(v, p / 100.0, p) for v, p in enumerate(grid)]

"""String expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove whitespace of every kind from both ends (``trim`` alone removes spaces only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def matches_from_start(c: Column, pattern: str) -> Column:
    """True when ``pattern`` matches at the start of the value, as Python's ``re.match``."""
    return c.rlike(f"^(?:{java_pattern(pattern)})")


def java_pattern(pattern: str) -> str:
    """Translate a user's Python pattern where the dialects differ, or refuse it."""
    if r"\Z" in pattern:
        pattern = pattern.replace(r"\Z", r"\z")
    for construct in ("(?P<", "(?P=", "(?(", "(?#"):
        if construct in pattern:
            raise ValueError(f"pattern uses {construct!r}, which Spark's regex engine does not accept")
    return pattern


def repair_symbol(c: Column) -> Column:
    """Drop leading non-letters and trailing characters other than letters, digits and hyphens."""
    return F.regexp_replace(F.regexp_replace(strip(c), "^[^A-Za-z]+", ""), r"[^A-Za-z0-9\-]+$", "")


def swap_case(c: Column) -> Column:
    letters = F.split(c, "")
    flipped = F.transform(
        letters, lambda ch: F.when(ch == F.upper(ch), F.lower(ch)).otherwise(F.upper(ch)))
    return F.array_join(flipped, "")


@F.pandas_udf(T.StringType())
def _compose(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


# Characters that NFC may change or join: marks, Hangul parts, letters with a canonical replacement (ranges
# that hold them, so some harmless ones too), and everything beyond the basic plane.
_UNSETTLED = (r"[\p{M}\u0374\u037E\u0387\u0958-\u095F\u09DC-\u09DF\u0A33-\u0A5E\u0B5C\u0B5D\u0F43-\u0FB9\u1100-\u11FF\u1F71-\u1FFD"
              r"\u2000\u2001\u2126\u212A\u212B\u2329\u232A\u2ADC\uF900-\uFAFF\uFB1D-\uFB4E\x{10000}-\x{10FFFF}]")

# Texts of characters before the first mark, and of dashes and quotation marks, without control characters: ``clean_text`` changes
# nothing in them, and far fewer kinds of characters have to be told apart.
_SETTLED = r"\A[\x09\x0A\x0D\x20-\x7E\x80-\u02FF\u2010-\u2027\u20AC]*+\z"


def compose_nfc(c: Column) -> Column:
    """Unicode NFC. Only values that it may change are sent to Python."""
    return F.coalesce(_compose(F.when(c.rlike(_UNSETTLED), c)), c)


def drop_unprintable(c: Column) -> Column:
    """Drop control and private-use characters; the replacement character becomes '?'."""
    kept = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\uE000-\uF8FF]", "")
    return F.replace(kept, F.lit("\ufffd"), F.lit("?"))


def clean_text(c: Column, compose: bool = True) -> Column:
    return drop_unprintable(compose_nfc(c) if compose else c)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _compose_all(rows: pd.Series) -> pd.Series:
    return rows.map(lambda row: [v and unicodedata.normalize("NFC", v) for v in row], na_action="ignore")


def clean_cells(df: DataFrame, names: list[str]) -> DataFrame:
    """``clean_text`` of many columns. A row goes to Python once, and with values only if NFC may change one of them."""
    cells = [F.col("`" + n.replace("`", "``") + "`") for n in names]
    # characters count one by one, so a row is judged as one text
    whole = F.concat_ws("", *cells)
    marked = df.withColumn("__settled", whole.rlike(_SETTLED))
    composed = marked.withColumn("__composed", _compose_all(F.when(~F.col("__settled") & whole.rlike(_UNSETTLED), F.array(*cells))))
    cleaned = {n: F.when(F.col("__settled"), c).otherwise(drop_unprintable(F.coalesce(F.get("__composed", F.lit(i)), c))) for i, (n, c) in enumerate(zip(names, cells))}
    return composed.withColumns(cleaned).drop("__composed", "__settled")


def is_plain(c: Column) -> Column:
    """True where ``clean_text`` changes nothing, as the text has printable ASCII, tabs and line ends alone."""
    return c.rlike(r"\A[\x09\x0A\x0D\x20-\x7E]*+\z")


def file_safe(c: Column) -> Column:
    """Lower case, every character other than letters, digits and underscore becomes '_'."""
    return F.regexp_replace(F.lower(c), "[^a-zA-Z0-9_]", "_")


def export_safe(c: Column) -> Column:
    """Keep letters, digits, space, hyphen and underscore; spaces become underscores."""
    return F.replace(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N} _\-]", "")), F.lit(" "), F.lit("_"))


def shorten(c: Column, limit: int, keep: int, tail: str = "...") -> Column:
    """Values longer than ``limit`` are cut to ``keep`` characters plus ``tail``."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, keep), F.lit(tail))).otherwise(c)


def head_with_dots(c: Column, keep: int = 200) -> Column:
    return F.concat(F.substring(c, 1, keep), F.lit("..."))


def token_estimate(c: Column) -> Column:
    """Rough size of a text: one token for every four characters."""
    return F.floor(F.length(c) / 4).cast("bigint")


def table_token_estimate(rows: Column, columns: Column, base: int = 2000) -> Column:
    """Base prompt size plus ten tokens per cell of a sample of at most ten rows."""
    return (F.lit(base) + F.least(rows, F.lit(10)) * columns * 10).cast("bigint")


def code_block(c: Column, language: str = "python") -> Column:
    """Body of the first fenced block in the given language, else of any fence, else the text."""
    named = F.regexp_extract(c, f"(?si)(```{language}\\s*.*?```)", 1)
    inner = F.regexp_extract(c, f"(?si)```{language}\\s*(.*?)```", 1)
    plain = F.regexp_extract(c, r"(?s)(```\s*.*?```)", 1)
    plain_inner = F.regexp_extract(c, r"(?s)```\s*(.*?)```", 1)
    return strip(F.when(named != "", inner).when(plain != "", plain_inner).otherwise(c))


def json_object(c: Column) -> Column:
    """The JSON object inside a response: fenced block first, then the outermost braces."""
    fenced = (
        F.when(F.contains(c, F.lit("```json")),
               F.split_part(F.split_part(c, F.lit("```json"), F.lit(2)), F.lit("```"), F.lit(1)))
        .when(F.contains(c, F.lit("```")), F.split_part(c, F.lit("```"), F.lit(2)))
        .otherwise(c)
    )
    braces = F.regexp_extract(fenced, r"(?s)(\{.*\})", 1)
    return F.when(braces != "", braces).otherwise(fenced)


def hex_head(content: Column, n: int = 256) -> Column:
    return F.lower(F.hex(F.substring(content, 1, n)))


def printable_head(content: Column, n: int = 256) -> Column:
    """First bytes as text, everything outside printable ASCII shown as '.'."""
    return F.regexp_replace(F.decode(F.substring(content, 1, n), "ISO-8859-1"), r"[^ -~]", ".")


def human_size(size: Column) -> Column:
    """Byte count with one decimal and a unit from B to PB."""
    amount = size.cast("double")

    def shown(power: int, unit: str) -> Column:
        # Java's format rounds ties up; rounding to the even digit first settles them
        return F.format_string(f"%.1f {unit}", F.bround(amount / float(1024 ** power), 1))

    out = shown(5, "PB")
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        out = F.when(amount < float(1024 ** (power + 1)), shown(power, unit)).otherwise(out)
    return out

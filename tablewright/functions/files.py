"""Expressions that type a file from its name and first bytes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ARCHIVES = ["zip", "tar", "gzip", "tar.gz"]
UNREAD_ARCHIVES = ["rar", "7z"]

# Media types and extensions that are taken for tables.
TABULAR_MIMES = ["text/csv", "text/tab-separated-values", "text/plain", "application/json",
                 "application/x-parquet"]
TABULAR_EXTENSIONS = [".csv", ".tsv", ".parquet", ".txt", ".json"]


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(name: Column) -> Column:
    """Last extension with its dot, lower case; empty for none and for names that only start with a dot."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]*)$", 1))


def _starts(head: Column, hexed: str) -> Column:
    return F.startswith(F.hex(F.substring(head, 1, 8)), F.lit(hexed))


def file_kind(name: Column, head: Column) -> Column:
    """zip, tar, gzip, tar.gz, rar, 7z, parquet or plain: magic bytes first, then the extension."""
    lowered = F.lower(name)
    packed_tar = F.endswith(lowered, F.lit(".tar.gz")) | F.endswith(lowered, F.lit(".tgz"))
    ext = extension(name)
    return (
        F.when(_starts(head, "504B0304") | _starts(head, "504B0506"), "zip")
        .when(F.substring(head, 258, 5) == F.lit(b"ustar"), "tar")
        .when(_starts(head, "1F8B"), F.when(packed_tar, "tar.gz").otherwise("gzip"))
        .when(_starts(head, "526172211A07"), "rar")
        .when(_starts(head, "377ABCAF271C"), "7z")
        .when(_starts(head, "50415231"), "parquet")
        .when(ext == ".zip", "zip").when(ext == ".tar", "tar")
        .when(ext == ".gz", F.when(F.contains(lowered, F.lit(".tar")), "tar.gz").otherwise("gzip"))
        .when(ext == ".tgz", "tar.gz").when(ext == ".rar", "rar").when(ext == ".7z", "7z")
        .otherwise("plain"))


def text_encoding(head: Column) -> Column:
    """Encoding a byte-order mark names, else NULL."""
    return (F.when(_starts(head, "EFBBBF"), "UTF-8").when(_starts(head, "FFFE"), "UTF-16LE")
            .when(_starts(head, "FEFF"), "UTF-16BE"))


def looks_textual(head: Column) -> Column:
    """No control bytes other than blanks, form feed, escape and bell; or a UTF-16 mark."""
    # Latin-1 maps every byte to the character of the same number
    raw = F.decode(F.substring(head, 1, 4096), "ISO-8859-1")
    return ~raw.rlike(r"[\x00-\x06\x0E-\x1A\x1C-\x1F]") | F.coalesce(F.startswith(text_encoding(head), F.lit("UTF-16")), F.lit(False))


def media_type(name: Column, head: Column) -> Column:
    kind, ext = file_kind(name, head), extension(name)
    first = F.substring(F.ltrim(F.regexp_replace(F.decode(F.substring(head, 1, 256), "ISO-8859-1"),
                                                 r"[\t\r\n]", " ")), 1, 1)
    return (
        F.when(kind == "zip", "application/zip").when(kind == "tar", "application/x-tar")
        .when(kind.isin("gzip", "tar.gz"), "application/gzip").when(kind == "rar", "application/x-rar")
        .when(kind == "7z", "application/x-7z-compressed").when(kind == "parquet", "application/x-parquet")
        .when(F.length(head) == 0, "inode/x-empty")
        .when(~looks_textual(head), "application/octet-stream")
        .when(first.isin("{", "["), "application/json")
        .when(ext == ".csv", "text/csv").when(ext == ".tsv", "text/tab-separated-values")
        .otherwise("text/plain"))


def is_tabular(name: Column, head: Column) -> Column:
    return media_type(name, head).isin(TABULAR_MIMES) | extension(name).isin(TABULAR_EXTENSIONS)


def is_hidden(member: Column) -> Column:
    return member.rlike(r"(^|/)\.")


def reader_of(name: Column, head: Column) -> Column:
    """csv, tsv, parquet, json or sniff, by extension, then media type; NULL when nothing can read it."""
    mime, ext = media_type(name, head), extension(name)
    text = mime.isin("text/csv", "text/tab-separated-values", "text/plain", "application/json")
    return (
        F.when(mime == "application/x-parquet", "parquet")
        .when((ext == ".csv") & text, "csv").when((ext == ".tsv") & text, "tsv")
        .when((ext == ".json") & (mime == "application/json"), "json")
        .when(mime == "text/csv", "csv").when(mime == "text/tab-separated-values", "tsv")
        .when(text, "sniff"))


def first_bytes(content: Column, n: int = 1024) -> Column:
    return F.substring(content, 1, n)

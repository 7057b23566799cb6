"""Expansion of zip, tar, gzip and tar.gz archives, nested ones included.

Members are listed first and then dealt out, so the members of one large zip or tar are unpacked
by many tasks. A gzip stream cannot be entered in the middle: one task unpacks it, copying in
small pieces. Unpacked members go to a staging folder in shared storage, under a name that depends
on archive and member only, so a repeated task writes the same file again.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.functions import files as ff
from tablewright.session import materialise, scratch_path
from tablewright.sources.files import HEAD_BYTES, list_files, open_path, typed, with_heads
from tablewright.sources.paths import qualified

MAX_DEPTH = 5
COPY_BYTES = 4 << 20
PLAN_SCHEMA = "root string, chain string, path string, kind string, member string, at bigint, size bigint, error string"
MEMBER_SCHEMA = "root string, chain string, path string, name string, size bigint, error string"


def _hidden(member: str) -> bool:
    return any(part.startswith(".") and part not in (".", "..") for part in member.split("/"))


def _open(path: str):
    system, inner = open_path(path)
    return system.open_input_file(inner)


def _stem(name: str) -> str:
    return name.rsplit(".", 1)[0] if "." in name.lstrip(".") else name


def _plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per member of zip and tar; one row per gzip stream."""
    for batch in batches:
        rows = []
        for root, chain, path, name, kind in zip(batch["root"], batch["chain"], batch["path"], batch["name"], batch["kind"]):
            base = {"root": root, "chain": chain, "path": path, "kind": kind, "member": None, "at": None,
                    "size": None, "error": None}
            try:
                if kind == "zip":
                    with _open(path) as raw, zipfile.ZipFile(raw) as z:
                        found = [(i.filename, None, i.file_size) for i in z.infolist() if not i.is_dir()]
                elif kind == "tar":
                    with _open(path) as raw, tarfile.open(fileobj=raw, mode="r:") as t:
                        found = [(m.name, m.offset_data, m.size) for m in t if m.isfile()]
                elif kind == "gzip":
                    found = [(_stem(name), None, None)]
                else:
                    found = [(None, None, None)]
                rows += [{**base, "member": m, "at": at, "size": size} for m, at, size in found
                         if m is None or not _hidden(m)]
            except Exception as exc:  # a broken archive is a finding, not a failed job
                rows.append({**base, "error": f"{type(exc).__name__}: {exc}"})
        yield pd.DataFrame(rows, columns=["root", "chain", "path", "kind", "member", "at", "size", "error"])


class _Span(io.RawIOBase):
    """A stretch of an open file as a stream."""

    def __init__(self, raw, at: int, size: int):
        raw.seek(at)
        self._raw, self._left = raw, size

    def read(self, n: int = -1) -> bytes:
        n = self._left if n < 0 else min(n, self._left)
        data = self._raw.read(n) if n else b""
        self._left -= len(data)
        return data


def _stage(stream, staging: str, source: str, member: str) -> tuple[str, int]:
    """Copy a stream to its staging place; returns (path, bytes)."""
    mark = hashlib.md5(f"{source}!{member}".encode()).hexdigest()[:20]
    name = re.sub(r"[^A-Za-z0-9._\-]", "_", member.rsplit("/", 1)[-1]) or "member"
    system, inner = open_path(f"{staging}/{mark}/{name}")
    folder = inner.rsplit("/", 1)[0]
    system.create_dir(folder, recursive=True)
    # the attempt writes aside and moves into place, so a half-written file is never seen
    import uuid

    aside = f"{folder}/_{uuid.uuid4().hex}"
    size = 0
    with system.open_output_stream(aside, compression=None) as out:
        while piece := stream.read(COPY_BYTES):
            out.write(piece)
            size += len(piece)
    system.move(aside, inner)
    return f"{staging}/{mark}/{name}", size


def _unpack(staging: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {"path": None, "raw": None, "zip": None}

        def opened(path: str):
            # rows arrive sorted by archive, so each archive is opened once per task
            if held["path"] != path:
                if held["raw"] is not None:
                    held["raw"].close()
                held.update(path=path, raw=_open(path), zip=None)
            return held["raw"]

        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                base = {"root": r.root, "chain": r.chain, "path": r.path, "name": None, "size": None, "error": r.error}
                if r.error is not None:
                    rows.append(base)
                    continue

                def put(stream, member: str) -> None:
                    path, size = _stage(stream, staging, r.path, member)
                    rows.append({"root": r.root, "chain": f"{r.chain}!{member}" if r.chain else member, "path": path,
                                 "name": member.rsplit("/", 1)[-1], "size": size, "error": None})

                try:
                    raw = opened(r.path)
                    if r.kind == "zip":
                        if held["zip"] is None:
                            held["zip"] = zipfile.ZipFile(raw)
                        with held["zip"].open(r.member) as stream:
                            put(stream, r.member)
                    elif r.kind == "tar":
                        put(_Span(raw, int(r.at), int(r.size)), r.member)
                    elif r.kind == "gzip":
                        raw.seek(0)
                        put(gzip.GzipFile(fileobj=raw), r.member)
                    else:
                        raw.seek(0)
                        with tarfile.open(fileobj=raw, mode="r|gz") as t:
                            for m in t:
                                if m.isfile() and not _hidden(m.name):
                                    put(t.extractfile(m), m.name)
                except Exception as exc:
                    rows.append({**base, "error": f"{type(exc).__name__}: {exc}"})
            yield pd.DataFrame(rows, columns=["root", "chain", "path", "name", "size", "error"])
        if held["raw"] is not None:
            held["raw"].close()

    return run


def unpack_once(archives: DataFrame, staging: str, tasks: int | None = None) -> DataFrame:
    """Members of the given archives (root, chain, path, name, kind), staged."""
    spark = archives.sparkSession
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    planned = archives.select("root", "chain", "path", "name", "kind").mapInPandas(_plan, PLAN_SCHEMA)
    # a fixed number of partitions: rows are tiny but each stands for a file of any size
    dealt = planned.repartition(tasks).sortWithinPartitions("path", "member")
    return dealt.mapInPandas(_unpack(staging), MEMBER_SCHEMA)


def expand(spark: SparkSession, paths: list[str] | str, staging: str | None = None, max_depth: int = MAX_DEPTH,
           head_bytes: int = HEAD_BYTES) -> DataFrame:
    """Every plain file behind the paths, archives opened down to ``max_depth`` levels.

    (root, chain, path, name, size, head, extension, kind, mime, is_tabular, reader, error).
    ``chain`` names the members leading to a file, joined by '!'. Archives below the depth limit,
    archives that fail, and those that no standard codec opens, appear with an error.
    """
    staging = qualified(spark, staging or scratch_path(spark, "members"))
    level = list_files(spark, paths).select(
        F.col("path").alias("root"), F.lit("").alias("chain"), "path", "name", "size",
        F.lit(None).cast("string").alias("error"))
    leaves = []
    for depth in range(max_depth + 1):
        broken = level.where(F.col("error").isNotNull())
        sound = typed(with_heads(level.where(F.col("error").isNull()), head_bytes))
        # written once per level: the next level and the leaves both read it
        sound = materialise(sound, f"level{depth}")
        is_archive = F.col("kind").isin(ff.ARCHIVES)
        plain = sound.where(~is_archive)
        unread = F.when(F.col("kind").isin(ff.UNREAD_ARCHIVES), F.concat(F.lit("no codec for "), "kind"))
        leaves += [plain.withColumn("error", unread), broken]
        nested = sound.where(is_archive)
        if depth == max_depth:
            leaves.append(nested.withColumn("error", F.lit(f"archive nested deeper than {max_depth} levels")))
            break
        if nested.isEmpty():
            break
        level = materialise(unpack_once(nested, f"{staging}/d{depth}"), f"members{depth}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), leaves)


def _member_bytes(r, raw, opened) -> Iterator[tuple[str, bytes]]:
    """(member, bytes) of a planned row; a tar.gz stream gives all its members."""
    if r.kind == "zip":
        yield r.member, opened.read(r.member)
    elif r.kind == "tar":
        yield r.member, _Span(raw, int(r.at), int(r.size)).read()
    elif r.kind == "gzip":
        raw.seek(0)
        yield r.member, gzip.GzipFile(fileobj=raw).read()
    else:
        raw.seek(0)
        with tarfile.open(fileobj=raw, mode="r|gz") as t:
            for m in t:
                if m.isfile() and not _hidden(m.name):
                    yield m.name, t.extractfile(m).read()


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members as rows; a batch is passed on as soon as it holds a few megabytes."""
    path, raw, opened = None, None, None
    columns = ["archive", "member", "size", "content", "error"]
    for batch in batches:
        rows, held = [], 0
        for r in batch.itertuples(index=False):
            if r.error is not None:
                rows.append((r.root, r.member, None, None, r.error))
                continue
            try:
                if path != r.path:
                    if raw is not None:
                        raw.close()
                    path, raw, opened = r.path, _open(r.path), None
                if r.kind == "zip" and opened is None:
                    opened = zipfile.ZipFile(raw)
                for member, data in _member_bytes(r, raw, opened):
                    rows.append((r.root, member, len(data), data, None))
                    held += len(data)
                    if held > COPY_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
            except Exception as exc:  # as in _unpack: a finding
                rows.append((r.root, r.member, None, None, f"{type(exc).__name__}: {exc}"))
        yield pd.DataFrame(rows, columns=columns)
    if raw is not None:
        raw.close()


def read_members(spark: SparkSession, paths: list[str] | str, tasks: int | None = None) -> DataFrame:
    """(archive, member, size, content, error) of the members of zip, tar, tar.gz and gzip bundles of small files.

    Members are read straight into rows, without a staged copy; what cannot be read is a row with an error.
    """
    files = list_files(spark, paths).select(
        F.col("path").alias("root"), F.lit("").alias("chain"), "path", "name", "size")
    bundles = typed(with_heads(files, 512)).where(F.col("kind").isin(ff.ARCHIVES))
    planned = bundles.select("root", "chain", "path", "name", "kind").mapInPandas(_plan, PLAN_SCHEMA)
    dealt = planned.repartition(tasks or spark.sparkContext.defaultParallelism).sortWithinPartitions("path", "member")
    return dealt.mapInPandas(_contents, "archive string, member string, size bigint, content binary, error string")

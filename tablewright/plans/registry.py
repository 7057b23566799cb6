"""Schema registry: a folder of JSON files, one schema per file, read and written by Spark."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.plans.schema import STANDARD, TargetSchema
from tablewright.sources.paths import delete_path, path_exists, write_text


def schema_file_name(name: str) -> str:
    return re.sub(r"[^a-zA-Z0-9_]", "_", name.lower()) + ".json"


class SchemaRegistry:
    """Schemas by name. Files that do not parse are kept aside in ``skipped``."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root.rstrip("/") if root else None
        self.skipped: list[str] = []
        self._schemas: dict[str, TargetSchema] = {STANDARD.name: STANDARD}
        if self.root and path_exists(spark, self.root):
            self._load()

    def files(self) -> DataFrame:
        """(path, text) of every schema file; whole files, as each holds one document."""
        return (self.spark.read.option("pathGlobFilter", "*.json").text(self.root, wholetext=True)
                .select(F.input_file_name().alias("path"), F.col("value").alias("text")))

    def _load(self) -> None:
        for row in self.files().orderBy("path").toLocalIterator():
            try:
                schema = TargetSchema.from_dict(json.loads(row.text))
            except (ValueError, KeyError, TypeError, AttributeError) as exc:
                self.skipped.append(f"{row.path}: {exc}")
                continue
            self._schemas[schema.name] = schema

    def get(self, name: str) -> TargetSchema | None:
        return self._schemas.get(name)

    def names(self) -> list[str]:
        return list(self._schemas)

    @staticmethod
    def create(name: str, columns: list[dict], description: str = "") -> TargetSchema:
        return TargetSchema.from_dict({"name": name, "columns": columns, "description": description})

    def save(self, schema: TargetSchema) -> None:
        if self.root:
            write_text(self.spark, f"{self.root}/{schema_file_name(schema.name)}", schema.to_json())
        self._schemas[schema.name] = schema

    def delete(self, name: str) -> bool:
        """Remove a schema; builtin and unknown names are refused."""
        schema = self._schemas.get(name)
        if schema is None or schema.builtin:
            return False
        if self.root:
            delete_path(self.spark, f"{self.root}/{schema_file_name(name)}")
        del self._schemas[name]
        return True

    def table(self) -> DataFrame:
        """One row per column of every schema."""
        rows = [
            (s.name, s.version, s.builtin, i, c.name, c.type, c.required, c.rule_text())
            for s in self._schemas.values() for i, c in enumerate(s.columns)
        ]
        return self.spark.createDataFrame(
            rows, "schema string, version string, builtin boolean, position int, column string, "
                  "type string, required boolean, rule string")
